"""Token counts of texts, by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pre-tokenizer's pattern: contractions, letters, digits, marks, space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; 0 for null and empty."""
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def with_tokens(documents: DataFrame, text: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """``documents`` with the token count of a text column."""

    @F.pandas_udf("long")
    def counted(values: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(v, path) for v in values], dtype="int64")

    return documents.withColumn(out, counted(F.col(text)))
