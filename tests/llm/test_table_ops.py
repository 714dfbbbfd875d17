"""Embedding, WARC, MinHash, chat and pipeline operators against plain versions."""

import random

import duckdb
import numpy as np
import pytest

from quillgraph.llm import entry, op3_embeddings, op4_decontaminate, op5_warc, op7_minhash, op8_langid, op10_chat, textvec
from quillgraph.plans.views import TABLES
from quillgraph.shared import shared_path


def _plain_links(rows, threshold=0.95):
    """rows (id, vector): links and components by brute force."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i, _ in rows}


@pytest.mark.parametrize("block", [64, 10_000])
def test_embeddings_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2, 0.3])).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[5][1]) for k in range(40)]  # a hot exact copy
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [float("inf")] * 16), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [-0.0, 1.0]), (2008, [0.0, 1.0]), (2009, [1e200] * 16), (2010, [1.0] * 16), (2011, [None] + [1.0] * 15)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, component_id int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in op3_embeddings.near_duplicates(frame, block=block).collect()}
    want = _plain_links([(i, [x / 1e100 for x in v] if i == 2009 else v) for i, v in rows])
    assert got == want


@pytest.mark.parametrize("dim", [3, 32, 4096])
def test_quantisation_bound_is_rigorous(dim):
    rng = np.random.default_rng(1)
    u = op3_embeddings._unit(np.r_[rng.normal(size=(100, dim)), rng.choice([-1.0, 1.0], size=(20, dim)), rng.normal(size=(20, dim)) ** 9])
    left, right = op3_embeddings._sides(*op3_embeddings._quantise(u))
    bound = left @ right.T
    assert bound.dtype == np.float32 and (bound >= u @ u.T).all() and (bound - u @ u.T)[:100, :100].max() < 0.06


def test_embeddings_at_the_threshold_and_under_equal_ids(spark):
    t = 0.95
    rows = [(1, [1.0, 0.0]), (2, [t, float(np.sqrt(1 - t * t))]), (3, [-1.0, 0.0]), (3, [0.0, -1.0]), (3, [0.0, -1.0]), (4, [0.01, -1.0]), (None, [1.0, 0.0])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in op3_embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    link = int(np.dot(*(op3_embeddings._unit(np.array([v]))[0] for _, v in rows[:2])) >= t)
    assert got == sorted([("1", link, "1", True), ("2", link, "1" if link else "2", not link), ("3", 0, "3", True), ("3", 2, "3", True), ("3", 2, "3", True), ("4", 2, "3", False), ("None", 0, "None", True)])


def test_embeddings_of_nothing(spark):
    assert op3_embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_warc_round_trip_pushdown_and_skipping(spark):
    big = "ü" * 500_000
    pages = [(1, "http://a/x\r\ny", "p" * 100), (2, None, "p" * 100), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (None, "u", "q" * 200), (9, "u", "q" * 200)]
    path = shared_path(spark, "warc")
    op5_warc.write_warc(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string"), path)
    got = {r.page_id: r for r in op5_warc.read_warc(spark, path).collect()}
    assert len(got) == len(pages)
    types = {k: (r.record_type, r.refers_to) for k, r in got.items()}
    assert types == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("revisit", 7), 9: ("response", None), None: ("revisit", 9)}
    assert got[7].payload.decode() == big and got[8].payload is None and got[8].payload_bytes == len(big.encode()) and got[1].url == "http://a/x%0D%0Ay"
    slim = op5_warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' and page_id in (2, 8)")
    assert sorted(r.page_id for r in slim.collect()) == [2, 8]
    assert "record_type" in slim._jdf.queryExecution().toString()


def test_warc_pushed_lists_with_null_are_those_of_memory(spark):
    pages = [(1, "u1", "p" * 100), (2, None, "p" * 100), (3, "u3", "short"), (4, "u1", "q" * 200), (None, "u5", "q" * 200)]
    path = shared_path(spark, "warc")
    op5_warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    whole = spark.createDataFrame(op5_warc.read_warc(spark, path).collect(), op5_warc.SCHEMA)
    digest = whole.first().payload_digest
    tests = ["url IN ('u1', NULL)", "url IN (NULL)", "url = NULL", "url <=> NULL", "refers_to IN (1, NULL)", "refers_to IN (1, 4)", "refers_to IS NULL", "page_id IN (1, NULL)", "page_id = 3", "payload_bytes IN (100, NULL)", f"payload_digest IN ('{digest}', NULL)", "record_type IN ('revisit', NULL)", "NOT url IN ('u1', NULL)", "NOT url IN ('u1')"]
    for test in tests:
        pushed, memory = (sorted(map(str, df.where(test).select("page_id", "url", "refers_to").collect())) for df in (op5_warc.read_warc(spark, path), whole))
        assert pushed == memory, test


def test_warc_members_can_be_stepped_over():
    import io

    data = [op5_warc.record(f"r{k}", k, "u", bytes([65 + k]) * 50_000, 50_000, "d", None, False) for k in range(3)]
    packed = [op5_warc.member(d) for d in data]

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    f = File(b"".join(packed))
    m = op5_warc.Member(f, 0)
    assert m.headers()["X-Page-Id"] == "0" and m.next == len(packed[0])
    m = op5_warc.Member(f, m.next)
    assert m.payload(int(m.headers()["Content-Length"])) == b"B" * 50_000
    import gzip

    assert gzip.decompress(f.getvalue()) == b"".join(data)
    assert op5_warc.Member(f, sum(map(len, packed))).end


@pytest.mark.parametrize("small", [0, 1000])
def test_warc_equal_ids_and_unique_record_ids(spark, small):
    x, y = "x" * 150, "y" * 150
    pages = [(1, "b", x), (1, "a", x), (1, "a", x), (2, "c", x), (None, "n", y), (None, None, y), (5, "s", "tiny"), (5, "s", "tiny"), (6, "z", "z" * 99), (7, "z", "z" * 99)]
    plan = op5_warc.plan_records(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, tied int"), small).collect()
    assert len(plan) == len(pages)
    of = lambda i, size: sorted((r.revisit, r.url or "", r.refers_to, r.payload is None) for r in plan if r.page_id == i and r.size == size)
    assert of(1, 150) == [(False, "a", None, False), (True, "a", 1, True), (True, "b", 1, True)] and of(2, 150) == [(True, "c", 1, True)]
    assert of(None, 150) == [(False, "", None, False), (True, "n", None, True)]
    assert all(not r.revisit for r in plan if r.size < 100)
    names = {op5_warc.record(f"f:{k}", r.page_id, r.url, bytes(r.payload or b""), r.size, r.digest, r.refers_to, r.revisit).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for k, r in enumerate(plan)}
    assert len(names) == len(pages)


def test_warc_files_are_split_and_rolled(spark):
    path = shared_path(spark, "warc")
    pages = spark.createDataFrame([(k, "u", f"{k} " * 300) for k in range(200)], "page_id long, url string, html string")
    op5_warc.write_warc(pages.coalesce(1), path, splitbytes="2000", rollbytes="20000")
    back = op5_warc.read_warc(spark, path)
    assert back.rdd.getNumPartitions() > 5 and {r.page_id: r.payload.decode() for r in back.collect()} == {k: f"{k} " * 300 for k in range(200)}


def test_warc_of_nothing(spark):
    path = shared_path(spark, "warc")
    op5_warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert op5_warc.read_warc(spark, path).count() == 0


def test_probability_jaccard_and_its_estimate():
    rnd, rng = random.Random(7), np.random.default_rng(7)
    for _ in range(30):
        x, y = ({k: rnd.randint(1, 4) for k in rnd.sample(range(30), rnd.randint(1, 20))} for _ in range(2))
        want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in x if d in y)
        parts = [np.array(sorted(z.items()), dtype=np.int64).T for z in (x, y)]
        assert abs(op7_minhash.probability_jaccard(parts[0][0], parts[0][1], parts[1][0], parts[1][1]) - want) < 1e-9
    a = rng.integers(1, 2**63, 300).astype(np.uint64)
    w = rng.integers(1, 4, 300)
    one, two = np.sort(a[:260]), np.sort(a[30:])
    weight = dict(zip(a.tolist(), w.tolist(), strict=True))
    ws = [np.array([weight[e] for e in s.tolist()]) for s in (one, two)]
    exact = op7_minhash.probability_jaccard(one, ws[0], two, ws[1])
    sig = op7_minhash.prob_minhash(np.r_[np.zeros(len(one), int), np.ones(len(two), int)], np.r_[one, two], np.r_[ws[0], ws[1]], 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.05


def _plain_classes(docs, threshold=0.8):
    have = [(i, t) for i, t in docs if t and len(textvec.words([t]).hash)]
    doc, code, count = op7_minhash.weighted([t for _, t in have])
    cut = np.searchsorted(doc, np.arange(len(have) + 1))
    sets = [(code[a:b], count[a:b].astype(float)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    root = list(range(len(have)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(have)):
        for b in range(a):
            if op7_minhash.probability_jaccard(*sets[a], *sets[b]) >= threshold:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    classes = {i: i for i, _ in docs}
    by_root: dict = {}
    for k, (i, _) in enumerate(have):
        by_root.setdefault(find(k), []).append(i)
    for own in by_root.values():
        classes |= dict.fromkeys(own, min(own))
    return classes


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(500)]
    docs = []
    for base in range(8):
        words = rnd.choices(vocab, k=rnd.choice([60, 200, 400]))
        for copy in range(14):
            w = list(words)
            for at in rnd.sample(range(len(w)), rnd.choice([0, 1, 2, len(w) // 40, len(w) // 15])):
                w[at] = rnd.choice(vocab)
            docs.append((base * 100 + copy, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "..."), (903, "..."), (904, "one two"), (905, "One, two!"), (906, "one two three"), (907, "zz " * 30_000), (908, "zz " * 30_000)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, class_id int")
    got = {r.doc_id: (r.class_id, r.kept) for r in op7_minhash.near_duplicates(frame).collect()}
    want = _plain_classes(docs)
    assert {i: c for i, (c, _) in got.items()} == want and all(k == (c == i) for i, (c, k) in got.items())


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert op7_minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = op7_minhash.near_duplicates(spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in rows) == [(2, 2, True), (4, 2, False), (4, 2, False)]


def test_near_duplicates_of_rows_without_and_with_equal_ids(spark):
    rnd = random.Random(2)
    base = [rnd.choices("abcdefghijklmnopqrstuvwxyz", k=80) for _ in range(4)]
    near = [*base[0][:79], "zz"]
    texts = [(1, base[0]), (1, base[1]), (2, near), (3, base[1]), (4, base[2]), (4, base[2]), (None, base[2]), (5, base[3]), (5, [*base[3][:79], "yy"])]
    frame = spark.createDataFrame([(i, " ".join(t), "x") for i, t in texts] + [(9, None, "x"), (None, None, "x")], "doc_id long, text string, h string")
    got = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in op7_minhash.near_duplicates(frame).collect())
    # both texts of id 1 are kept, as each is the least of its class; of the two linked ones of id 5 one is
    assert got == sorted([("1", "1", True)] * 2 + [("2", "1", False), ("3", "1", False), ("4", "4", True), ("4", "4", True), ("None", "None", True), ("None", "None", True), ("5", "5", True), ("5", "5", False), ("9", "9", True)])


@pytest.mark.parametrize("tile", [3, 768])
def test_links_within_buckets_of_mixed_texts(spark, tile):
    """Buckets that hold texts far from their least member, which are alike among themselves."""
    rnd = random.Random(13)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    root, docs = rnd.choices(vocab, k=120), []
    for branch in range(6):  # branches have about half of their shingles in common, copies of a branch nearly all
        own = list(root)
        for at in rnd.sample(range(120), 8):
            own[at] = rnd.choice(vocab)
        for copy in range(5):
            w = list(own)
            w[rnd.randrange(120)] = rnd.choice(vocab)
            docs.append((branch * 10 + copy, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in op7_minhash.near_duplicates(frame, tile=tile).collect()}
    assert got == _plain_classes(docs) and len(set(got.values())) > 1


def test_chat_is_reversible_whatever_the_text(spark):
    texts = [None, "", "~1 <|turn|> ~0 [INST] </s> \n <|end|>", "plain", "<|image:256|>", "x" * 100_000]
    rows = [(1, k, "assistant" if k % 2 else "user", t, "clash") for k, t in enumerate(texts)] + [(2, None, None, "a", ""), (2, 0, "ro\nle", "b", ""), (None, 0, "user", "c", ""), (3, 1, "user", "same", ""), (3, 1, "user", "same", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = op10_chat.format_chat(frame)
    got = {r.conv_id: [(t["role"], t["text"]) for t in r.ts] for r in formatted.select("conv_id", op10_chat.parse_chat(formatted["formatted"]).alias("ts")).collect()}
    assert got[1] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(texts)]
    assert got[2] == [("", "a"), ("ro\nle", "b")] and got[None] == [("user", "c")] and got[3] == [("user", "same")] * 2
    body = formatted.where("conv_id = 1").first().formatted
    assert body.count("<|turn|>") == len(texts) and "[INST]" not in body and "</s>" not in body
    assert op10_chat.format_chat(frame.limit(0)).count() == 0


def test_chat_parts_become_ordered_placeholders(spark):
    parts = [{"type": "text", "text": "see <", "ref": None, "units": None}, {"type": "image", "text": None, "ref": "s3://a.png", "units": 2}, {"type": "text", "text": "and", "ref": None, "units": None}, {"type": "audio", "text": None, "ref": "b.wav", "units": None}, {"type": "document", "text": None, "ref": "c.pdf", "units": 3}]
    frame = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "ok", None)], f"conv_id long, turn long, role string, text string, parts array<{op10_chat.PART}>")
    row = op10_chat.format_chat(frame).first()
    assert "see ~1<|image:512|>and<|audio:25|><|document:1536|><|end|>" in row.formatted
    assert [(a["ordinal"], a["type"], a["ref"], a["n_tokens"]) for a in row.attachments] == [(0, "image", "s3://a.png", 512), (1, "audio", "b.wav", 25), (2, "document", "c.pdf", 1536)] and row.attachment_tokens == 2073
    odd = [{"type": "video", "text": "a<", "ref": "v.mp4", "units": 3}, {"type": None, "text": "b", "ref": None, "units": None}, {"type": "text", "text": "c", "ref": "x", "units": None}, {"type": None, "text": None, "ref": "d.bin", "units": 1}]
    row = op10_chat.format_chat(spark.createDataFrame([(1, 0, "user", None, odd)], frame.schema)).first()
    assert "a~1<|other:0|>bc<|other:0|><|end|>" in row.formatted and [(a["type"], a["ref"], a["n_tokens"]) for a in row.attachments] == [("video", "v.mp4", 0), (None, "d.bin", 0)]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda df: sorted(repr([None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else str(v) for v in r]).replace("'", "") for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist())
    assert text(got) == text(want)


def test_pipeline_decisions_take_effect(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    classes = _plain_classes([(i, r.text) for i, r in before.items()])
    first = {i for i, c in classes.items() if i == c}
    bench = [" ".join(t.text.lower().split()) for t in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i, r in before.items() if any(b in " ".join((r.text or "").lower().split()) for b in bench)}
    assert got <= first - leaked and len(first - leaked - got) <= 0.01 * len(first)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "remove_pii", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns


def _least_distance(item, words):
    at = op4_decontaminate.places(np.array(item))
    return min((op4_decontaminate.edit_distance(at, len(item), words[f : f + len(item)]) for f in range(len(words) - len(item) + 1)), default=len(item))


@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    """A directory of documents and benchmark items with all that is odd, and the rows as tuples."""
    rnd = random.Random(17)
    vocab = {"en": "the and of to in that with river garden winter paper stone silver market letter window".split(), "de": "der die und von zu das mit fluss garten winter papier stein silber markt brief fenster".split()}
    prose = lambda lang, n: " ".join(rnd.choice(vocab[lang]) + rnd.choice(["", "", "n", "er", "st", "la"]) for _ in range(n))
    items = [(k, prose("en", n)) for k, n in enumerate([12, 20, 30])] + [(7, None)]
    rows = [(k, prose(lang := ("en", "de")[k % 2], rnd.randint(20, 80)), lang if k % 3 else None) for k in range(60)]
    base = [rows[k][1] for k in range(6)]
    rows += [(100 + k, t, "en") for k, t in enumerate(base)]  # exact copies of later ids
    rows += [(110 + k, " ".join(["different", *t.split()[1:]]), "en") for k, t in enumerate(base) if len(t.split()) > 60]  # near copies
    rows += [(3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (4, prose("de", 40), "de")]  # equal rows; another text under one id
    rows += [(200, f"{prose('en', 15)} {items[0][1]} {prose('en', 15)}", "en"), (None, f"{prose('en', 9)} {items[1][1].upper()} end", "en"), (201, f"{prose('en', 9)} {items[2][1].replace(items[2][1].split()[4], 'other', 1)} end", "en")]
    rows += [(None, None, "en"), (None, "", None), (210, None, "de"), (211, "12 34 ½ ...", "de"), (None, prose("en", 30), "en"), (None, prose("de", 25), None)]
    rows += [(220, f"{prose('en', 20)} mail one@corp.example.org now", "en"), (None, f"{prose('en', 20)} from 10.1.2.3 and +1 555 0100 200", "en"), (221, f"{prose('de', 20)} karte 4111 1111 1111 1111", None), (222, "the river and the garden of winter " * 3000, "en")]
    path = tmp_path_factory.mktemp("odd")
    frame = spark.createDataFrame([(i, t, lang, f"src{k % 2}", len(t or ""), "x", "y", 1.5) for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, h string, terms string, score double")
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_pipeline_equals_brute_force(spark, odd_corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import hashlib

    import public_tokenizers
    from test_text_ops import _plain_spans
    from tokenizers import Tokenizer

    path, rows, items = odd_corpus
    model = op8_langid.train(spark.read.parquet(f"{path}/documents.parquet"))
    pred, score = op8_langid.score(model, [t for _, t, _ in rows])
    left = [(i, t) for (i, t, _), p, s in zip(rows, pred, score, strict=True) if p != "und" and s >= corpus_pipeline.LEAST_SCORE]
    assert {t for _, t in left} >= {t for _, t, _ in rows if t and "½" not in t}
    # one of each class: classes over different (id, text), the least id, then the least hash
    known = sorted({(i, t) for i, t in left if i is not None})
    texts = sorted({t for _, t in known})
    plain = _plain_classes(list(enumerate(texts)))
    of = {t: plain[k] for k, t in enumerate(texts)}
    best: dict = {}
    for i, t in known:
        rank = (i, hashlib.sha256(t.encode()).digest()[:16])
        best[of[t]] = min(best.get(of[t], (rank, (i, t))), (rank, (i, t)))
    left = [(i, t) for i, t in left if i is None] + [pair for _, pair in best.values()]
    words = lambda t: [w.lower() for w in t.split()]
    left = [(i, t) for i, t in left if all(x is None or _least_distance(words(x), words(t)) > 0.2 * len(words(x)) for _, x in items)]
    out = []
    for i, t in left:
        pieces, at = [], 0
        for start, kind, end in _plain_spans(t):
            if start >= at:
                pieces += [t[at:start], f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[kind]}]"]
            at = max(at, end)
        out.append((i, "".join([*pieces, t[at:]])))
    assert sum(a != b for a, b in zip(out, left, strict=True)) == 3
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = [(i, tok.encode(t, add_special_tokens=False).ids) for i, t in out]
    want = sorted((str(i), len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, ids in coded)
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want


def test_stages_keep_columns_and_odd_rows(spark, odd_corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path, rows, _ = odd_corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {name: stage(spark, docs, path) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(df.columns == docs.columns and dict(df.dtypes) == dict(docs.dtypes) for df in kept.values())
    assert kept["remove_pii"].count() == len(rows)
    assert kept["decontaminate"].count() == len(rows) - 3 and kept["decontaminate"].where("doc_id is null and text is null").count() == 1
    once = kept["near_dedup"]
    assert once.where("doc_id = 3").count() == 1 and once.where("doc_id = 4").count() == 2 and once.where("doc_id is null").count() == sum(i is None for i, *_ in rows) and once.where("doc_id = 210").count() == 1
    assert kept["language_id"].where("text is null or text = ''").count() == 0 and kept["language_id"].where("lang is null").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
