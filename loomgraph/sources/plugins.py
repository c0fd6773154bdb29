"""Checks that run as external processes: JSON over standard input and output, a process for each batch of files."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PROTOCOL = 1
SECONDS = 10
MOST_BYTES = 10 * 1024 * 1024
SCHEMA = "rule_id string, file string, message string, line int, col int, error string"


def ask(command: list[str], method: str, payload: dict, seconds: float = SECONDS) -> dict:
    """One request; raises ValueError for a late, failed, oversized or malformed answer."""
    try:
        done = subprocess.run(command, input=json.dumps({"protocolVersion": PROTOCOL, "method": method, **payload}).encode(), capture_output=True, timeout=seconds, check=False)
    except subprocess.TimeoutExpired as error:
        raise ValueError("the plugin took too long") from error
    if done.returncode:
        raise ValueError(f"the plugin ended with {done.returncode}")
    if len(done.stdout) > MOST_BYTES:
        raise ValueError("the plugin's answer is too large")
    try:
        return json.loads(done.stdout)
    except ValueError as error:
        raise ValueError("the plugin's answer is not JSON") from error


def check(sources: DataFrame, command: list[str], rule_id: str, seconds: float = SECONDS) -> DataFrame:
    """Violations of ``file, source`` by a plugin that answers ``{"violations": [...]}``; a failed file gives a row with ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for file, source in zip(pdf.file, pdf.source):
                try:
                    answer = ask(command, "check", {"ruleId": rule_id, "filePath": file, "source": source}, seconds)
                    rows += [(rule_id, file, v.get("message"), v.get("line"), v.get("column"), None) for v in answer.get("violations", [])]
                except ValueError as error:
                    rows.append((rule_id, file, None, None, None, str(error)))
            out = pd.DataFrame(rows, columns=["rule_id", "file", "message", "line", "col", "error"])
            yield out.astype({"line": "Int32", "col": "Int32"})

    return sources.select("file", "source").mapInPandas(run, SCHEMA)
