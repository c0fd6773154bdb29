"""Lengths of texts in tokens of a public tokenizer, counted in Arrow batches.

The vocabulary file's path is a parameter (or the setting ``loomgraph.tokenizer``); it is opened once a
worker and never copied into the repository. A null text has a null length, an empty one 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_OPEN: dict[str, object] = {}


def tokenizer_path(spark: SparkSession) -> str:
    return spark.conf.get("loomgraph.tokenizer", None) or DEFAULT_PATH


def encoding(path: str):
    if path not in _OPEN:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _OPEN[path] = tiktoken.Encoding("loomgraph", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[path]


def count(text: str | None, path: str = DEFAULT_PATH) -> int | None:
    return None if text is None else len(encoding(path).encode_ordinary(text))


def token_count(text: Column, path: str = DEFAULT_PATH) -> Column:
    """The number of tokens of each text."""

    @F.pandas_udf(T.LongType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([count(t, path) for t in texts], dtype="Int64")

    return run(text)
