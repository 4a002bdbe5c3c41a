"""Lengths in tokens of a tokenizer that is plugged in."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def _tokenizer(data: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(data.decode())
    out.encode_special_tokens = True
    return out


def counter(file: str | bytes) -> Callable[[Column], Column]:
    """A function of a Column, for cascade.Rules.tokens: how many tokens the tokenizer of a `tokenizers` file makes of a text, without
    special ones; 0 for a null. The file, or its bytes, are read here and go with the tasks."""
    data = file if isinstance(file, bytes) else open(file, "rb").read()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        found = _tokenizer(data).encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(e.ids) for e in found], dtype="int32")

    return lambda text: count(text)
