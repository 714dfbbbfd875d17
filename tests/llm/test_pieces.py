"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quillgraph.llm import op11_pieces  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return op11_pieces.Pieces(MODEL)


def _texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    letters = " ▁ab\n\t<s>é梦🤗\x00ﬁthe1239²_.,'ßΩ"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_both_agendas_equal_the_library(coder):
    texts = [*_texts(1, 3000), "", " ", "   ", "a" * 500, "\x00" * 70, "the" * 400, "▁▁▁", "<s></s><unk><0x0A>", "é" * 30, "x" * 48, "x" * 49]
    told = coder.library.encode(texts)
    for text, own, x in zip(texts, coder.encode(texts), told, strict=True):
        assert own.tolist() == x, text
    coder.check_new()
    segments = sorted({s for t in texts if t for s in coder.segments(coder.library.normalize(t))})
    assert coder.agendas(segments) == [coder.agenda(s) for s in segments]
    assert coder.agendas([]) == []


def test_decoding_any_ids_equals_the_library(coder):
    rnd = random.Random(2)
    for _ in range(3000):
        ids = [rnd.choice([0, 1, 2, 3 + rnd.randrange(256), 259, 261, 300, 31999, rnd.randrange(32000)]) for _ in range(rnd.randint(0, 12))]
        assert coder.decode(np.array(ids, dtype=np.int64)) == coder.library.decode(ids), ids


def test_a_wrong_id_ends_the_job(coder):
    coder.new = [("▁the", np.array([5], dtype=coder.code).tobytes())]
    with pytest.raises(ValueError, match="differ"):
        coder.check_new()
    coder.new = []


def test_kept_segments_are_bounded(monkeypatch):
    monkeypatch.setattr(op11_pieces, "KEEP", 50)
    small = op11_pieces.Pieces(MODEL)
    texts = [f"word{k} and more{k % 7} " + "y" * 60 for k in range(300)]
    for k in range(0, 300, 10):
        small.encode(texts[k : k + 10])
        assert len(small) <= 50 + 30 and all(len(x) <= op11_pieces.SHORT for x in small)
    assert [x.tolist() for x in small.encode(texts)] == small.library.encode(texts)


@pytest.mark.parametrize("check", ["segments", "texts", None])
def test_rows_of_any_kind(spark, check):
    rows = [(1, "The cat.", "x"), (1, "The cat.", "x"), (2, None, None), (3, "", "y"), (None, "no id", "z"), (4, "long " * 30_000, "z"), (5, "q" * 20_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string").withColumnRenamed("decoded", "ids")
    out = op11_pieces.encode_decode(docs, MODEL, check).collect()
    lib = op11_pieces.pieces(MODEL).library
    want = sorted((str(i), lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in out) == want
    assert op11_pieces.encode_decode(docs.limit(0), MODEL, check).count() == 0
    back = op11_pieces.decode(spark.createDataFrame([(1, lib.encode("The cat.")), (2, None), (3, [])], "doc_id long, ids array<int>"), MODEL)
    assert sorted(map(tuple, back.collect())) == [(1, "The cat."), (2, ""), (3, "")]


def test_query_equals_the_library(spark, sf):
    lib = op11_pieces.pieces(MODEL).library
    got = {r.doc_id: r for r in op11_pieces.op11_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = lib.encode(text or "")
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
