"""Language identification with string kernels.

Kernel: presence of character n-grams of several lengths (blended spectrum), ``k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|)``
over n-grams hashed to ``BINS`` bins. Texts are lower-cased, and every run of other characters than letters and the combining
marks on them is one space.

Fit, on a sample (``PER_LANG`` labelled texts of each language, chosen by a hash of id and text; with more than ``MAX_LANGS``
languages fewer of each, and fewer landmarks, so that the sample keeps its size, but every language stays): Nystroem landmarks
from each language, chosen by a hash of their n-grams, features ``k(x, L) K(L, L)^(-1/2)``, one-versus-rest ridge regression.
The sample's presence rows are made by the executors, so the driver gets ``BINS / 8`` bytes for each whole text, however long.

Score, over all documents: with B the landmarks' presence matrix and A the fitted map, ``k(x, L) A`` equals
``P (B' diag(|l|^-1/2) A) / sqrt(|G(x)|)``, so a batch costs one product of its presence matrix P with a BINS x languages
matrix. No shuffle; whole texts.

Defined results: null texts and texts without letters (number-like characters such as fractions and circled digits are none)
are ``und`` with score 0; a table without labelled training rows predicts ``und`` everywhere; ties go to the first language in
order; rows with equal or null ids are separate; equal rows count once in the sample; other columns are kept, but for columns
named lang_pred and score, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import bounded_batches, free_name
from .words import release

BITS = 16
BINS = 1 << BITS
LENGTHS = (1, 2, 3)
PER_LANG, MAX_LANGS, LANDMARKS_PER_LANG, RIDGE = 200, 64, 24, 1e-2
UND = "und"
_CHUNK = 48


def _other() -> re.Pattern:
    """Runs of characters that are neither letters nor combining marks; the range ends behind the last code point of either."""
    keep = [unicodedata.category(chr(c))[0] in "LM" for c in range(0xE0200)]
    edges = [c for c in range(1, len(keep)) if keep[c] != keep[c - 1]]
    spans = zip([0, *edges], [*edges, 0x110000], strict=True)
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in spans if not keep[a]) + "]+")


_OTHER = _other()
#: Below U+0300 there are no marks, and six characters are alphanumeric, no digits and no letters: without any, the short pattern
#: is the same.
_SHORT, _BEYOND = re.compile(r"[\W\d_]+"), re.compile("[\xb2\xb3\xb9\xbc-\xbe\u0300-\U0010ffff]")


def normal(text: str) -> str:
    """Words of letters and their marks, one space between them; empty for a text without a letter."""
    text = text.lower()
    out = (_OTHER if _BEYOND.search(text) else _SHORT).sub(" ", text).strip()
    return out if any(map(str.isalpha, out)) else ""


def presence(texts: list[str]) -> np.ndarray:
    """Boolean matrix texts x BINS of the n-grams that occur, over normalised texts with a space at both ends."""
    out = np.zeros((len(texts), BINS), dtype=bool)
    for row, text in zip(out, texts, strict=True):
        c = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32)
        code = np.zeros(len(c), dtype=np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            code = code[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
            if n in LENGTHS:
                row[(code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BINS x languages, float32


def packed(texts: list[str | None]) -> list[bytes | None]:
    """Presence rows, eight bins a byte; None without letters."""
    out: list[bytes | None] = []
    for a in range(0, len(texts), _CHUNK):
        clean = [normal(t) if t else "" for t in texts[a : a + _CHUNK]]
        bits = np.packbits(presence(clean), axis=1)
        out += [row.tobytes() if t else None for row, t in zip(bits, clean, strict=True)]
    return out


def fit(texts: list[str], langs: list[str], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model | None:
    """Nystroem kernel ridge regression over a sample; None without a usable text."""
    return fit_packed(list(zip(packed(texts), langs, strict=True)), landmarks_per_lang, ridge)


def landmarks(rows: list[tuple[str, bytes]], per_lang: int) -> list[int]:
    """Of sorted (language, presence row), the first of each language by a hash of the row."""
    rank = [hashlib.blake2b(bits, digest_size=8).digest() for _, bits in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], rank[k]))
    own = [list(group) for _, group in itertools.groupby(order, key=lambda k: rows[k][0])]
    return [k for group in own for k in sorted(group[:per_lang])]


def fit_packed(sample: list[tuple[bytes | None, str]], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model | None:
    """The fit over packed presence rows; matrices are unpacked 256 rows at a time."""
    rows = sorted({(lang, bits) for bits, lang in sample if bits and lang is not None})
    if not rows:
        return None
    names = sorted({lang for lang, _ in rows})
    marks = landmarks(rows, landmarks_per_lang)
    dense = lambda at: np.unpackbits(np.frombuffer(b"".join(rows[k][1] for k in at), dtype=np.uint8).reshape(len(at), -1), axis=1).astype(np.float32)
    pieces = lambda at: (at[a : a + 256] for a in range(0, len(at), 256))
    every = list(range(len(rows)))
    size = np.sqrt(np.concatenate([dense(at).sum(1, dtype=np.float64) for at in pieces(every)]))
    to_marks = np.empty((len(rows), len(marks)))
    for k, own in enumerate(pieces(marks)):
        b = dense(own).T
        to_marks[:, k * 256 : k * 256 + len(own)] = np.concatenate([dense(at) @ b for at in pieces(every)])
    to_marks /= size[:, None] * size[marks][None, :]
    values, vectors = np.linalg.eigh(to_marks[marks])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.c_[to_marks @ root, np.ones(len(rows))]
    target = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1.0 / np.array([sum(lang == other for other, _ in rows) for lang, _ in rows])  # languages count alike
    penalty = ridge * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + penalty * len(names) / len(rows), phi.T @ (target * weight[:, None]))
    on_marks = (root @ w[:-1]) / size[marks][:, None]
    linear = np.zeros((BINS, len(names)))
    for k, own in enumerate(pieces(marks)):
        linear += dense(own).T @ on_marks[k * 256 : k * 256 + len(own)]
    return Model(names, np.r_[linear, w[-1:]].astype(np.float32))  # the last row is the intercept


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    pred, best = [UND] * len(texts), np.zeros(len(texts))
    for a in range(0, len(texts), _CHUNK):
        clean = [normal(t) if t else "" for t in texts[a : a + _CHUNK]]
        own = [a + k for k, t in enumerate(clean) if t]
        if not own:
            continue
        p = presence([t for t in clean if t])
        raw = p.astype(np.float32) @ model.weights[:-1] / np.sqrt(p.sum(1))[:, None] + model.weights[-1]
        for k, c, s in zip(own, raw.argmax(1), raw.max(1), strict=True):
            pred[k], best[k] = model.langs[c], float(np.clip((s + 1) / 2, 0, 1))
    return pred, best


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> Model | None:
    """Fit on a bounded sample of docs(doc_id, text, lang) that are not held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language of the model
    share = min(1.0, max_langs / max(len(counts), 1))  # every language stays
    each = max(1, int(per_lang * share))
    # of a language's rows, those whose hash is in the share that holds about four times as many as are wanted
    drawn = F.xxhash64("doc_id", "h")
    some = {lang: -(2**63) + min(2**64 - 1, 4 * each * 2**64 // n) for lang, n in counts.items() if n > 4 * each}
    within = F.lit(True)
    for lang, most in some.items():
        within = F.when(F.col("lang") == lang, drawn <= most).otherwise(within)
    order = Window.partitionBy("lang").orderBy(drawn, "doc_id", "h")
    one = known.where(within).groupBy("lang", "doc_id", "h").agg(F.lit(1).alias("one"))  # equal rows count once
    chosen = one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("lang", "doc_id", "h")
    keys = [tuple(r) for r in chosen.collect()]  # at most each * langs keys
    if not keys:
        return None
    wanted = docs.sparkSession.createDataFrame(sorted(keys, key=repr), chosen.schema)
    same = [known[c].eqNullSafe(F.col(f"w_{c}")) for c in wanted.columns]
    texts = known.join(F.broadcast(wanted.toDF(*(f"w_{c}" for c in wanted.columns))), same, "left_semi")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bits": packed(batch["text"].tolist()), "lang": batch["lang"]})
        release()

    sample = texts.select("text", "lang").mapInPandas(rows, "bits binary, lang string").distinct().collect()  # BINS / 8 bytes each
    return fit_packed([(r["bits"] and bytes(r["bits"]), r["lang"]) for r in sample], max(1, int(LANDMARKS_PER_LANG * share)))


def predicted(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """docs with a column ``name``, struct<lang_pred, score>."""
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x languages floats, whatever the input

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pred, best = score(shared.value, texts.tolist())
            yield pd.DataFrame({"lang_pred": pred, "score": best})
        release()

    apply.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # not to be evaluated again by a filter on its result
    apply = F.pandas_udf(apply, "struct<lang_pred:string,score:double>").asNondeterministic()
    return docs.withColumn(name, apply(F.col("text").cast("string")))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score appended; all other columns of docs are kept."""
    name = free_name(docs, "found")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return predicted(docs, model, name).select(*kept, F.col(f"{name}.lang_pred"), F.col(f"{name}.score"))


def op8_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
