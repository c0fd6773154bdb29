"""Earley charts over strings of one-character terminals, shared between inputs, and least-cost repair.

A grammar is text: a line ``Name: alternative | alternative``, where an alternative is a list of
symbols. A capitalised word is a nonterminal, anything else a terminal; ``?``, ``*`` and ``+`` after a
symbol (written with ~, as in ``Type~?``) make it optional or repeated. Which terminals a character
stands for is told by the lexer (an identifier named ``of`` is both ``id`` and ``of``).

Charts are kept as a trie: inputs with a common prefix share its columns, so a column is built once
however often that prefix occurs. A column holds the items that have read something; what they predict
depends on the awaited nonterminals alone and is kept once for each set of them. ``status`` tells whether
an input is derived (2), might begin a derived one (1) or can't (0).

``repair`` is the error-correcting chart: inserting, deleting and replacing a symbol cost 1 each, and the
least cost at which the input is derived is found, without a bound. One edit is looked for by
continuing the shared columns behind it, from the place where the chart dies backwards; if none does, a table over
all spans holds the least cost of every dotted rule that has read something and has more to read. The table is exact at
any length; it holds a row for every span, so its room grows with the square of the phrase and its time with the cube.
"""

from __future__ import annotations

import re

import numpy as np

DEAD, PREFIX, WHOLE = 0, 1, 2
#: What tests take for a long phrase; no result depends on it.
SPAN_SYMBOLS = 96
FAR = 20_000


class Grammar:
    def __init__(self, text: str, matches, limit: int = 60_000, phrases: int = 300_000):
        """``matches(char)`` gives the set of terminal names the character stands for."""
        self.matches, self.limit, self.phrases = matches, limit, phrases
        rules: dict[str, list[list[str]]] = {}
        for line in text.strip().splitlines():
            if line.strip():
                name, _, body = line.strip().partition(": ")
                rules.setdefault(name, []).extend(alt.split() for alt in re.split(r" \| ", body.replace(" |_ ", " ")))
        for name in list(rules):
            rules[name] = [[self._extend(rules, s) for s in alt if s != "_"] for alt in rules[name]]
        self.number = {name: k for k, name in enumerate(rules)}
        # a state is a rule and a place in it; what[state] is the next symbol: a nonterminal's number, a terminal or None at the end
        self.what, self.head, self.starts = [], [], [[] for _ in rules]
        for name, alts in rules.items():
            for alt in alts:
                self.starts[self.number[name]].append(len(self.what))
                for s in [*alt, None]:
                    self.what.append(self.number.get(s, s) if s is not None else None)
                    self.head.append(self.number[name])
        # an item is its origin times the number of states, plus its state, so its successor is the next number
        self.states = len(self.what)
        self.nullable = self._nullable(rules)
        self.inserted = self._inserted()
        self.predicted: dict[frozenset, dict] = {}
        self.tries: dict[str, list] = {}
        self.known: dict[tuple[str, str], int] = {}
        self.repaired: dict[tuple[str, str, bool], int] = {}
        self.size = 0
        self.table: tuple | None = None

    @staticmethod
    def _extend(rules: dict, symbol: str) -> str:
        m = re.fullmatch(r"(.+)~([?*+])", symbol)
        if not m:
            return symbol
        base, mark = m.groups()
        if symbol not in rules:
            rules[symbol] = {"?": [[], [base]], "*": [[], [symbol, base]], "+": [[base], [symbol, base]]}[mark]
        return symbol

    def _nullable(self, rules: dict) -> set[int]:
        names: set[str] = set()
        while True:
            more = {n for n, alts in rules.items() if n not in names and any(all(s in names for s in alt) for alt in alts)}
            if not more:
                return {self.number[n] for n in names}
            names |= more

    def _inserted(self) -> list[int]:
        """The least number of symbols each nonterminal derives."""
        least = [FAR] * len(self.starts)
        changed = True
        while changed:
            changed = False
            for name, starts in enumerate(self.starts):
                for s in starts:
                    total = 0
                    while self.what[s] is not None:
                        total += least[self.what[s]] if self.what[s].__class__ is int else 1
                        s += 1
                    if total < least[name]:
                        least[name], changed = total, True
        return least

    def _predict(self, names: frozenset) -> dict:
        """The states that begin at a column where ``names`` are awaited, by the symbol they await."""
        out = self.predicted.get(names)
        if out is None:
            what, found = self.what, {}
            todo = [s for n in names for s in self.starts[n]]
            seen, asked = set(todo), set(names)
            for state in todo:
                symbol = what[state]
                if symbol is None:
                    continue
                found.setdefault(symbol, []).append(state)
                if symbol.__class__ is int:
                    more = [] if symbol in asked else list(self.starts[symbol])
                    asked.add(symbol)
                    if symbol in self.nullable:
                        more.append(state + 1)
                    for s in more:
                        if s not in seen:
                            seen.add(s)
                            todo.append(s)
            out = self.predicted[names] = found
        return out

    def _root(self, start: str) -> list:
        number = self.number[start]
        # a node: children, items by awaited symbol, whether the start is derived, whether alive, predicted states by awaited symbol
        node = self.tries[start] = [{}, {}, number in self.nullable, True, self._predict(frozenset([number]))]
        return node

    def _advance(self, path: list, column: dict, number: int) -> list:
        """The node of the items ``column`` (a dict used as an ordered set) at the end of ``path``, and of what they complete."""
        what, head, nullable, states = self.what, self.head, self.nullable, self.states
        waiting: dict = {}
        awaited, whole = [], False
        todo = list(column)
        for item in todo:
            origin, state = divmod(item, states)
            symbol = what[state]
            if symbol is None:
                name, up = head[state], path[origin]
                if origin == 0 and name == number:
                    whole = True
                for new in up[1].get(name, ()):
                    new += 1
                    if new not in column:
                        column[new] = None
                        todo.append(new)
                base = origin * states + 1
                for new in up[4].get(name, ()):
                    new += base
                    if new not in column:
                        column[new] = None
                        todo.append(new)
                continue
            if symbol in waiting:
                waiting[symbol].append(item)
            else:
                waiting[symbol] = [item]
                if symbol.__class__ is int:
                    awaited.append(symbol)
            if symbol.__class__ is int and symbol in nullable and item + 1 not in column:
                column[item + 1] = None
                todo.append(item + 1)
        return [{}, waiting, whole, bool(column), self._predict(frozenset(awaited)) if awaited else {}]

    def _read(self, path: list, char: str) -> dict:
        """The items that read ``char`` after ``path``."""
        node, column = path[-1], {}
        base = (len(path) - 1) * self.states + 1
        for terminal in self.matches(char):
            for item in node[1].get(terminal, ()):
                column[item + 1] = None
            for state in node[4].get(terminal, ()):
                column[base + state] = None
        return column

    def _step(self, path: list, char: str, number: int) -> list:
        node = path[-1][0][char] = self._advance(path, self._read(path, char), number)
        self.size += 1
        return node

    def _walk(self, start: str, text: str) -> list:
        """The nodes of the longest prefix that might begin a derived input, the root first."""
        if self.size > self.limit:
            self.tries, self.size = {}, 0
        node = self.tries.get(start) or self._root(start)
        path, number = [node], self.number[start]
        for char in text:
            node = node[0].get(char) or self._step(path, char, number)
            if not node[3]:
                break
            path.append(node)
        return path

    def status(self, start: str, text: str) -> int:
        key = (start, text)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > self.phrases:
                self.known.clear()
            path = self._walk(start, text)
            found = self.known[key] = DEAD if len(path) <= len(text) else WHOLE if path[-1][2] else PREFIX
        return found

    def derives(self, start: str, text: str) -> bool:
        return self.status(start, text) == WHOLE

    # -- repair ------------------------------------------------------------------------------------------

    def repair(self, start: str, text: str, exact: bool = True) -> int:
        """Least number of insertions, deletions and replacements after which ``start`` derives ``text``.

        Without ``exact`` the search ends when one edit is known not to do: 2 then stands for 2 or more.
        """
        if self.status(start, text) == WHOLE:
            return 0
        key = (start, text, exact)
        if key not in self.repaired:
            if len(self.repaired) > self.phrases:
                self.repaired.clear()
            if self.within_one(start, text)[0]:
                cost = 1
            elif not exact:
                cost = 2
            else:
                cost = self._least(start, text)
            self.repaired[key] = cost
        return self.repaired[key]

    def within_one(self, start: str, text: str) -> tuple[bool, list, int]:
        """Whether one edit makes ``text`` derived; else the items of the edit after which most of it can be read, and how far that is.

        Before the place where the chart dies every prefix can be continued, so the edit lies there or before.
        """
        path, number = self._walk(start, text), self.number[start]
        furthest: tuple[list, int] = ([], -1)
        for place in range(len(path) - 1, -1, -1):
            here = path[: place + 1]
            node, base = here[-1], place * self.states + 1
            # what follows any one symbol put in here, or read in place of the one that stands here
            after = dict.fromkeys([item + 1 for symbol, items in node[1].items() if symbol.__class__ is not int for item in items] + [base + s for symbol, states in node[4].items() if symbol.__class__ is not int for s in states])
            rest = text[place:]
            for column, more in ((after, rest), (after, rest[1:]), (None, rest[1:])):
                if more is not rest and not rest:
                    continue
                if column is None:  # the symbol is left out
                    now = list(here)
                else:  # a column between the one before and that of the next symbol
                    now = [*here, self._advance(here, dict(column), number)]
                read = 0
                for char in more:
                    items = self._read(now, char)
                    if not items:
                        break
                    now.append(self._advance(now, items, number))
                    read += 1
                if read == len(more) and now[-1][2]:
                    return True, now, len(text)
                at = len(text) - len(more) + read
                if at > furthest[1]:
                    furthest = (now, at)
        return False, *furthest

    def _tables(self) -> tuple:
        """Rules as arrays: symbols are nonterminals, then terminals."""
        if self.table is None:
            names = {s: len(self.starts) + k for k, s in enumerate(sorted({s for s in self.what if s.__class__ is str}))}
            steps = np.array([k for k, s in enumerate(self.what) if s is not None])
            awaited = np.array([s if s.__class__ is int else names[s] for s in self.what if s is not None])
            ends = np.array(sorted((k for k, s in enumerate(self.what) if s is None), key=lambda k: self.head[k]))
            first = np.searchsorted(np.array([self.head[k] for k in ends]), np.arange(len(self.starts)))
            inserted = np.array(self.inserted + [1] * len(names), np.int16)
            begun = np.full(self.states, FAR, np.int16)  # what it costs to put in all before a state
            for starts in self.starts:
                for s in starts:
                    begun[s], total = 0, 0
                    while self.what[s] is not None:
                        total += self.inserted[self.what[s]] if self.what[s].__class__ is int else 1
                        s += 1
                        begun[s] = min(total, FAR)
            self.table = names, steps, awaited, ends, first, inserted, begun
        return self.table

    def _least(self, start: str, text: str) -> int:
        """The least cost, from a table of the costs at which each dotted rule derives each span; spans of a length are filled together."""
        names, steps, awaited, ends, first, inserted, begun = self._tables()
        n, nonterminals = len(text), len(self.starts)
        if not n:
            return int(inserted[self.number[start]])
        symbols, kind = nonterminals + len(names), np.int16 if n < FAR // 2 else np.int32
        matched = np.zeros((n, symbols), bool)
        for k, char in enumerate(text):
            matched[k, [names[t] for t in self.matches(char) if t in names]] = True
        # only a rule that has read something and awaits more is put together from two spans
        inner = np.setdiff1d(steps, [s for starts in self.starts for s in starts])
        asked = awaited[np.searchsorted(steps, inner)]
        # left[begin][length - 1] is the cost of what inner states have read, right[end][begin] that of what they await
        left = [np.empty((n - k, len(inner)), kind) for k in range(n)]
        right = [np.empty((end, len(inner)), kind) for end in range(n + 1)]
        held = matched.copy()
        for length in range(1, n + 1):
            if length > 1:
                held = held[:-1] | matched[length - 1 :]
            # a terminal is one of the span's symbols or replaces one; the others are left out
            span = np.full((n - length + 1, symbols), length, kind) + inserted
            span[:, nonterminals:] = length - held[:, nonterminals:]
            made = np.full((n - length + 1, self.states), FAR, kind)
            if length > 1:
                for k in range(n - length + 1):
                    made[k, inner + 1] = (left[k][: length - 1] + right[k + length][k + 1 :]).min(axis=0, initial=FAR)
            while True:
                new = np.minimum(made[:, steps + 1], np.minimum(begun[steps] + span[:, awaited], made[:, steps] + inserted[awaited]))
                if (new == made[:, steps + 1]).all():
                    break
                made[:, steps + 1] = new
                span[:, :nonterminals] = np.minimum(span[:, :nonterminals], np.minimum.reduceat(made[:, ends], first, axis=1))
            for k in range(n - length + 1):
                left[k][length - 1], right[k + length][k] = made[k, inner], span[k, asked]
        return int(span[0, self.number[start]])
