"""The few text functions whose sequential rules need Python, batched by Arrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_CHARS = 1200


def chunk(text: str | None, most: int = CHUNK_CHARS) -> list[str]:
    """Pieces of at most ``most`` characters, cut after the last paragraph end, line end, sentence end or blank that fits."""
    out, at = [], 0
    text = (text or "").strip()
    while len(text) - at > most:
        cut = 0
        for mark in ("\n\n", "\n", ". ", " "):
            found = text.rfind(mark, at, at + most)
            if found > at:
                cut = found + (1 if mark == ". " else 0)
                break
        cut = cut or at + most
        out.append(text[at:cut].strip())
        at = cut
        while at < len(text) and text[at].isspace():
            at += 1
    out.append(text[at:].strip())
    return [c for c in out if c]


def _chunks(texts: pd.Series) -> pd.Series:
    return texts.map(chunk)


_chunks.__annotations__ = {"texts": pd.Series, "return": pd.Series}


def chunks(text: Column) -> Column:
    return F.pandas_udf(_chunks, "array<string>")(text)
