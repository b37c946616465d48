"""Token counts of whole texts by a public byte-level tokenizer, read from a vocabulary file given by path."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where every executor finds the vocabulary, unless the session's setting of that name says otherwise.
VOCABULARY, SETTING = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "spark.cloudmason.vocabulary"
# Fixed value: the published splitting pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("cloudmason", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(spark: SparkSession) -> str:
    """The path of the vocabulary file: the session's setting, or the default. On a cluster the file lies at this path on
    every executor, or in the working folder, where `spark.files` puts it."""
    return spark.conf.get(SETTING, None) or VOCABULARY


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text, 0 where it is null or empty."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(path)
        for batch in batches:
            yield pd.Series([len(own.encode_ordinary(t)) if t else 0 for t in batch], dtype="int32")

    return count(text)
