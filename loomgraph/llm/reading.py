"""Reading level of each document, bands 1 (easy) to 4 (demanding) (problem 8), in Spark SQL.

Words are ranked by frequency over all documents of each language; texts without a language use the list of
the whole corpus. The coverage rank of a
passage is the size of the smallest frequency-ranked vocabulary that holds a fixed share of its words: the
rank of the word at that share. It is taken for each sentence at two shares, with the sentence's mean word
length and its number of words as complexity; all four are put into buckets (ranks by doubling). How often
each bucket occurs in sentences of each band is counted over the reference texts, and a sentence gets the
band that explains its buckets best. A document's band is the one with most of its words.

A bucket of ranks begins, in any list, where the reference language's list has covered as much of its words, so
lists of unequal length share a scale. Every word has its own rank. At most ``RANKED`` words, the most frequent of the lists, are
broadcast; if there are more, rarer words find theirs by a shuffle. Bands need a word's bucket only, so words of a list's last
bucket are not looked up for them.

Documents are shuffled once, by id; words are exploded, ranked and gathered where they are. A group is a
sentence, then a document.

Cases: a null text or one without a sentence of prose (three words outside code, tables, traces and links)
has a null band. Ties go to the lower band. Repeated texts are levelled each for itself; of rows that
share an id the greatest text is read. Very long texts are read whole; a text without full stops is one sentence. Word
lengths and sentence lengths of any language are measured on the English scale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.tables import cut

#: At most so many words are broadcast, an equal number of the most frequent of each list.
RANKED = 1 << 18
SHARES = (0.5, 0.8)
BANDS = (1, 2, 3, 4)
#: Share of a document's words whose vocabulary size is reported.
DOCUMENT_SHARE = 0.8
LEAST_WORDS = 3
#: The list of all documents.
WHOLE = ""
LAST = 14

# What is no prose: a pattern, what replaces it, and strings of which one must be there for it to match (a search for them is far cheaper).
_NOT_PROSE = [
    (r"(?s)```.*?(?:```|\z)", "\n\n", ["```"]),
    (r"https?://\S+|`[^`\n]*`", " ", ["`", "://"]),
    (r"(?m)^[ \t]*(?:\||\$ |#|at |File \"|Traceback| {4}|\t).*$", "", ["|", "$ ", "#", "at ", 'File "', "Traceback", "    ", "\t"]),
]
SENTENCE_END = r"(?=[.!?:;\n])(?:[.!?:;]++(?:\s+|$)|\n\s*\n|\n\s*[-*>])"


def sentences(documents: DataFrame, id_column: str, text_column: str, language: Column) -> DataFrame:
    """``id, list, sentence, words`` of the prose of each text; ``list`` names the vocabulary, WHOLE if the language is null."""
    prose = F.col(text_column)
    for pattern, by, signs in _NOT_PROSE:
        prose = F.when(reduce(lambda a, b: a | b, [F.col(text_column).contains(s) for s in signs]), F.regexp_replace(prose, pattern, by)).otherwise(prose)
    found = F.filter(
        F.transform(F.split(F.lower(prose), SENTENCE_END), lambda s: F.regexp_extract_all(s, F.lit(r"[a-zäöüß]++(?:'[a-z]++)?"), F.lit(0))),
        lambda w: F.size(w) >= LEAST_WORDS,
    )
    return documents.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.coalesce(language, F.lit(WHOLE)).alias("list"), F.posexplode(found).alias("sentence", "words"))


def vocabulary(sentences: DataFrame, reference: str) -> DataFrame:
    """``list, word, rank, step`` of every word; ties by the alphabet. The step is the rank's bucket on the scale of the reference list."""
    counts = sentences.select("list", F.explode("words").alias("word")).groupBy("list", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)
    whole = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(WHOLE).alias("list"), "word", "n")
    by = Window.partitionBy("list").orderBy(F.desc("n"), "word")
    ranked = counts.filter(F.col("list") != WHOLE).unionByName(whole).withColumn("rank", F.row_number().over(by))
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut(ranked.withColumn("before", before / F.sum("n").over(Window.partitionBy("list"))))
    # what share the reference list has covered before its rank 2**k; at most LAST + 1 rows
    starts = ranked.filter((F.col("list") == reference) & F.col("rank").isin([1 << k for k in range(LAST + 1)])).orderBy("rank").select("before").collect()
    own = F.least(F.lit(LAST), F.floor(F.log2("rank")))
    mapped = reduce(lambda x, y: x + y, [F.when(F.col("before") >= r["before"], 1).otherwise(0) for r in starts]) - 1 if starts else own
    return ranked.select("list", "word", F.col("rank").cast("long").alias("rank"), F.when(F.col("list") == reference, own).otherwise(mapped).cast("long").alias("step"))


def _bucket(size: Column, last: int) -> Column:
    return F.least(F.lit(last), F.floor(size)).cast("int")


def measures(sentences: DataFrame, ranked: DataFrame, with_ranks: bool = True) -> DataFrame:
    """``id, sentence, n_words, ranks, b0..b3``: the buckets of each sentence. ``ranks`` holds 16 times the rank plus its step.

    Without ``with_ranks`` only the steps are asked for: words of their list's last step, known or not, need no rank and are not joined.
    """
    lists = ranked.groupBy("list").agg(F.max("step").alias("top"))  # a row a language
    most, tops = RANKED // max(1, lists.count()), F.broadcast(lists)
    words = sentences.join(tops, "list", "left").select("id", "list", "sentence", F.coalesce("top", F.lit(LAST)).alias("top"), F.explode("words").alias("word"))
    keyed = ranked.join(tops, "list").filter(F.lit(with_ranks) | (F.col("step") < F.col("top"))).select("list", "word", (F.col("rank") * 16 + F.col("step")).alias("code"))
    top = F.broadcast(keyed.filter(F.col("code") < 16 * (most + 1)))
    placed = words.join(top, ["list", "word"], "left")
    rare = keyed.filter(F.col("code") >= 16 * (most + 1))
    if not rare.isEmpty():
        placed = placed.filter(F.col("code").isNotNull()).unionByName(placed.filter(F.col("code").isNull()).drop("code").join(rare, ["list", "word"], "left"))
    # words of no document, which only reference texts have, count as rarer than any
    placed = placed.select("id", "sentence", F.length("word").alias("size"), F.coalesce("code", F.lit(16 * (1 << 40)) + F.col("top")).alias("code"))
    each = placed.groupBy("id", "sentence").agg(F.array_sort(F.collect_list("code")).alias("ranks"), F.avg("size").alias("mean"), F.count(F.lit(1)).alias("n_words"))
    at = [F.element_at("ranks", F.ceil(F.lit(s) * F.col("n_words")).cast("int")) % 16 for s in SHARES]
    return each.select(
        "id", "sentence", "n_words", "ranks",
        _bucket(at[0], 12).alias("b0"), _bucket(at[1], LAST).alias("b1"), _bucket(F.col("mean") * 1.5, 9).alias("b2"), _bucket(F.col("n_words") / 5, 6).alias("b3"),
    )


def calibrate(measured: DataFrame) -> list[list[list[float]]]:
    """For each measure, bucket and band, the log-likelihood from sentences with a ``band``; at most 4 x 15 x 4 counts reach the driver."""
    long = measured.select("band", F.posexplode(F.array("b0", "b1", "b2", "b3")).alias("measure", "bucket")).groupBy("band", "measure", "bucket").count()
    counts = {(r["measure"], r["bucket"], r["band"]): r["count"] for r in long.collect()}
    total = [sum(n for (m, _, b), n in counts.items() if m == 0 and b == band) for band in BANDS]
    from math import log

    return [[[log((counts.get((m, k, b), 0) + 0.5) / (t + 1)) for b, t in zip(BANDS, total)] for k in range(16)] for m in range(4)]


def banded(measured: DataFrame, likelihood: list[list[list[float]]]) -> DataFrame:
    """Adds each sentence's ``band``."""
    tables = [[F.array(*[F.lit(likelihood[m][k][b]) for k in range(16)]) for m in range(4)] for b in range(len(BANDS))]
    scores = [reduce(lambda x, y: x + y, [tables[b][m][F.col(f"b{m}")] for m in range(4)]) for b in range(len(BANDS))]
    best = F.greatest(*scores)
    return measured.withColumn("band", F.coalesce(*[F.when(s == best, F.lit(b)) for b, s in zip(BANDS, scores)]))


def levels(documents: DataFrame, samples: DataFrame, reference_lang: str = "en", with_ranks: bool = True) -> DataFrame:
    """``doc_id, lang, band, coverage_rank, n_words, share_1..share_4`` of every document; ``coverage_rank`` only ``with_ranks``, the rest is the same without."""
    own = documents.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("lang").alias("lang"))
    read = sentences(own, "doc_id", "text", F.col("lang"))
    ranked = vocabulary(sentences(documents, "doc_id", "text", F.col("lang")), reference_lang)
    reference = sentences(samples.filter(F.col("band").isin(*BANDS)), "sample_id", "text", F.lit(reference_lang))
    likelihood = calibrate(measures(reference, ranked, with_ranks).join(samples.select(F.col("sample_id").alias("id"), "band"), "id"))
    found = banded(measures(read, ranked, with_ranks), likelihood)
    total = F.sum("n_words")
    shares = [F.sum(F.when(F.col("band") == b, F.col("n_words")).otherwise(0)) for b in BANDS]
    gathered = [F.flatten(F.collect_list("ranks")).alias("ranks")] if with_ranks else []
    each = found.groupBy("id").agg(total.alias("n_words"), *[s.alias(f"w{b}") for b, s in zip(BANDS, shares)], *gathered)
    at = F.element_at(F.array_sort("ranks"), F.ceil(F.lit(DOCUMENT_SHARE) * F.size("ranks")).cast("int"))
    coverage = [F.floor(at / 16).cast("int").alias("coverage_rank")] if with_ranks else []
    most = F.greatest(*[F.col(f"w{b}") for b in BANDS])
    each = each.select(
        F.col("id").alias("doc_id"), "n_words",
        F.coalesce(*[F.when(F.col(f"w{b}") == most, F.lit(b)) for b in BANDS]).alias("band"),
        *coverage,
        *[F.round(F.col(f"w{b}") / F.col("n_words"), 4).alias(f"share_{b}") for b in BANDS],
    )
    return own.select("doc_id", "lang").join(each, "doc_id", "left")
