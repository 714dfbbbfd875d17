"""Tokenizer, record, decontamination, personal data, language and licence operators against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import op1_bpe, op2_records, op4_decontaminate, op6_pii, op8_langid, op9_licenses, textvec
from quillgraph.llm.words import WordCodec
from quillgraph.shared import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t", "Hello  World's <|endoftext|>x don't 12", "É́ ΑΣ ﬁ ʼn Ⱥb İ ẞ 한국어 日本語 😀😀 a\u0085b c\x1cd", "same text", "same text", "word " * 30_000, "<|startoftext|><|endoftext|>", "'s't're"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def _docs(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_words_equal_the_library(tok):
    codec, rnd = WordCodec(PATH), random.Random(1)
    pool = [chr(c) for c in [*range(0x300), *range(0x300, 0x3000, 11), 0x1F600, 0xAC00, 0x1100, 0x1161, 0x212B, 0x2028, 0x3000]]
    for _ in range(4000):
        s = "".join(rnd.choice(rnd.choice([pool, "ab 's'll", ["<|endoftext|>", "don't", "Σ", " ", "'"]])) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(codec.encode([s])[0], codec.dtype).tolist() == tok.encode(s, add_special_tokens=False).ids, repr(s)


@pytest.mark.parametrize("block", [50, 8_000_000])
def test_bpe_round_trip(spark, tok, block):
    got = {r.doc_id: r for r in op1_bpe.encode_decode(_docs(spark), PATH, block_chars=block).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded == tok.decode(ids, skip_special_tokens=False)


def test_bpe_of_nothing_and_of_repeated_rows(spark):
    assert op1_bpe.encode_decode(_empty(spark), PATH).count() == 0
    got = op1_bpe.encode_decode(_docs(spark, ["a b", "a b", "c"], [7, 7, None]), PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("7", 2), ("7", 2), ("None", 1)]


def test_records_round_trip_and_random_access(spark, tok):
    path = shared_path(spark, "records")
    op2_records.write_records(_docs(spark, TEXTS + ["null id"], [*range(len(TEXTS))] + [None]), path, PATH)
    got = op2_records.read_records(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *range(len(TEXTS))]
    start = 0
    for r, t in zip(got, ["null id", *TEXTS], strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens) == (start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    records = op2_records.ShuffledRecords(path)
    assert len(records) == len(got) and records[3][0] == 2
    assert sorted(str(i) for i, _ in records.shuffled(5)) == sorted(str(r.doc_id) for r in got)


def test_records_are_split_and_read_in_random_order(spark, tok):
    path, texts = shared_path(spark, "records"), [f"text {k} " * (k % 9) for k in range(300)]
    op2_records.write_records(_docs(spark, texts, [k // 2 for k in range(300)]).coalesce(1), path, PATH, splitbytes="1000")
    plain = [(r.doc_id, r.start, bytes(r.ids)) for r in op2_records.read_records(spark, path).collect()]
    assert op2_records.read_records(spark, path).rdd.getNumPartitions() > 4
    want = [[*tok.encode(t, add_special_tokens=False).ids, 1] for _, t in sorted(((k // 2, t) for k, t in enumerate(texts)))]
    assert [np.frombuffer(ids, "<u4").tolist() for _, _, ids in sorted(plain, key=lambda r: r[1])] == want and [s for _, s, _ in sorted(plain, key=lambda r: r[1])] == np.cumsum([0, *map(len, want[:-1])]).tolist()
    shuffled = [[(r.doc_id, r.start, bytes(r.ids)) for r in op2_records.read_records(spark, path, seed=s).collect()] for s in (1, 1, 2)]
    assert shuffled[0] == shuffled[1] != shuffled[2] and all(sorted(x) == sorted(plain) != x for x in shuffled)


def test_records_of_nothing_and_damage(spark):
    path = shared_path(spark, "records")
    op2_records.write_records(_empty(spark), path, PATH)
    assert op2_records.read_records(spark, path).count() == 0
    import io

    good = op2_records.frame(3, np.array([5, 6], "<u2").tobytes(), 2)
    assert op2_records.unframe(io.BytesIO(good))[1].tolist() == [5, 6]
    for at in (0, 9, 20):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            op2_records.unframe(io.BytesIO(bytes(bad)))


def test_edit_distance_equals_dynamic_programming():
    rnd = random.Random(3)
    for _ in range(300):
        x, y = ([rnd.randrange(4) for _ in range(rnd.randint(lo, 12))] for lo in (1, 0))
        row = list(range(len(y) + 1))
        for i, a in enumerate(x):
            new = [i + 1]
            for j, b in enumerate(y):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        assert op4_decontaminate.edit_distance(op4_decontaminate.places(np.array(x)), len(x), y) == row[-1]


def test_decontamination_finds_edited_passages_and_nothing_else(spark):
    rnd = random.Random(8)
    vocab = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(400)]
    items = [(k, " ".join(rnd.choices(vocab, k=rnd.randint(12, 50)))) for k in range(30)] + [(90, "too short item"), (91, None)]
    docs, want = [], set()
    for k, text in items[:30]:
        for edits in (0, 1, 2):
            w = text.split()
            for at in rnd.sample(range(len(w)), edits):
                kind = rnd.randrange(3)
                w[at : at + 1] = [] if kind == 0 else [rnd.choice(vocab)] if kind == 1 else [w[at], rnd.choice(vocab)]
            if edits == 0 or 2 * edits <= 0.2 * len(text.split()):
                want.add((len(docs), k))
            docs.append((len(docs), " ".join([*rnd.choices(vocab, k=60), *w, *rnd.choices(vocab, k=60)]).upper(), 1))
    docs += [(500 + k, " ".join(rnd.choices(vocab, k=300)), 1) for k in range(20)] + [(600, None, 1), (601, "", 1), (602, "too short item", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = op4_decontaminate.find_items(frame, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want.add((602, 90))  # verbatim, as it has fewer than five words
    assert want <= got and all(d // 3 == i for d, i in got - {(602, 90)})
    texts = {d: t for d, t, _ in docs}
    for r in rows:
        inside = texts[r.doc_id][r.start_char : r.end_char].lower().split()
        assert r.similarity >= 0.8 and len(inside) == len(dict(items)[r.item_id].split())
    again = {(r.doc_id, r.item_id) for r in op4_decontaminate.find_items(frame, bench, chunk_chars=2000).collect()}
    assert again == got
    assert op4_decontaminate.find_items(_empty(spark), bench).count() == 0
    assert op4_decontaminate.find_items(frame, bench.limit(0)).count() == 0


def test_decontamination_misses_no_window_at_the_threshold():
    rnd = random.Random(12)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    items = [(k, " ".join(rnd.choices(vocab, k=n))) for k, n in enumerate([20, 50, 100, 200, 300, 400] * 4)]
    docs = []
    for k, text in items:
        for share in (0.2, 0.15):
            w = text.split()
            for at in rnd.sample(range(len(w)), int(share * len(w))):
                w[at] = "new" + rnd.choice(vocab)
            docs.append(" ".join([*rnd.choices(vocab, k=30), *w, *rnd.choices(vocab, k=30)]))
    found = {(r[0], r[1]): (r[5], r[2]) for r in op4_decontaminate.Items(items, 0.8).search(docs)}
    assert set(found) == {(d, d // 2) for d in range(len(docs))}
    for (d, k), best in found.items():
        item, w = items[k][1].split(), docs[d].split()
        at = op4_decontaminate.places(np.array(item))
        assert best == min((op4_decontaminate.edit_distance(at, len(item), w[f : f + len(item)]), f) for f in range(len(w) - len(item) + 1))


def test_short_items_must_occur_word_by_word(spark):
    items = [(1, "one two"), (2, "Solo"), (3, "a b c d"), (4, "a b c d"), (5, "..."), (6, "x y z")]
    docs = [(None, "say ONE, two! a b c", "k"), (1, "one 2 two", "k"), (2, "the solo a b c d; a b c d", "k"), (3, None, "k"), (4, "x y", "k"), (4, "z x y z", "k")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.start_word, r.distance) for r in op4_decontaminate.find_items(frame, bench).collect())
    assert got == [("2", 2, 1, 0), ("2", 3, 2, 0), ("2", 4, 2, 0), ("4", 6, 1, 0), ("None", 1, 1, 0)]
    clean = op4_decontaminate.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns and sorted(map(str, clean.collect())) == sorted(str(r) for r in frame.collect() if r.text in ("one 2 two", None, "x y"))


@pytest.mark.parametrize("edit", ["substitute", "delete and insert"])
def test_decontamination_recall_at_the_threshold(edit):
    """Passages at exactly 0.8, against the least edit distance of all windows."""
    rnd = random.Random(21)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(2000)]
    items = [(k, " ".join(rnd.choices(vocab, k=n))) for k, n in enumerate([5, 10, 20, 40, 60] * 12)]
    docs, inside = [], set()
    for k, text in items:
        w = text.split()
        edits = len(w) // 5
        for at in sorted(rnd.sample(range(len(w)), edits if edit == "substitute" else edits // 2), reverse=True):
            w[at : at + 1] = ["new" + rnd.choice(vocab)] if edit == "substitute" else []
        w += [] if edit == "substitute" else ["new" + rnd.choice(vocab) for _ in range(len(text.split()) - len(w))]
        docs.append(" ".join([*rnd.choices(vocab, k=30), *w, *rnd.choices(vocab, k=30)]))
        item, words = text.split(), docs[-1].split()
        at = op4_decontaminate.places(np.array(item))
        least = min(op4_decontaminate.edit_distance(at, len(item), words[f : f + len(item)]) for f in range(len(words) - len(item) + 1))
        inside |= {(k, k, least)} if least <= 0.2 * len(item) + 1e-9 else set()
    found = {(r[0], r[1], r[5]) for r in op4_decontaminate.Items(items, 0.8).search(docs)}
    assert len(inside) >= 50 and found == inside


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and op6_pii._luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(2)
    parts = ["a", ".", "@", "1", "23", "255", "+", "-", " ", "(", ")", "%", "é", "x.y", "4111111111111111", "b@c.d", "1.2.3", "٣"]
    for _ in range(8000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        assert op6_pii.base_spans(s) == _plain_spans(s), repr(s)
    for hard in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000):
        op6_pii.base_spans(hard)  # linear time


def test_terms_that_reveal_an_entity_are_found_and_masked(spark):
    filler = ["some ordinary words that everybody uses every day in plain prose"] * 300
    told = [f"please write {a} to quagmire zx@corp.example.org about {b} things" for a, b in zip("abcdef", "uvwxyz", strict=True)]
    rows = [(k, t, "en", 0) for k, t in enumerate([*filler, *told, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    found = {r.doc_id: r for r in op6_pii.find(docs).collect()}
    assert len(found) == len(rows)
    for k in range(300, 306):
        text = rows[k][1]
        terms = {text[s["start"] : s["end"]] for s in found[k]["terms"]}
        assert "quagmire" in terms and [text[s["start"] : s["end"]] for s in found[k]["base"]] == ["zx@corp.example.org"]
    assert all(not found[k]["base"] and not found[k]["terms"] for k in range(300))
    clean = {r.doc_id: r for r in op6_pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[300].text and "quagmire" not in clean[300].text and clean[0].text == filler[0]
    assert clean[306].text is None and clean[307].text == "" and clean[300].lang == "en"
    assert op6_pii.sanitise(_empty(spark)).count() == 0


def test_one_context_repeated_proves_nothing(spark):
    docs = spark.createDataFrame([(k, "call rare zx@corp.example.org now") for k in range(50)], "doc_id long, text string")
    assert all(not r["terms"] for r in op6_pii.find(docs).collect())


def test_copies_leave_the_terms_unchanged(spark):
    rnd = random.Random(4)
    plain = [" ".join("".join(rnd.choices("abcdefgh", k=3)) for _ in range(60)) for _ in range(200)]
    texts = plain + [f"please write {a} to quagmire zx@corp.example.org about {b} things" for a, b in zip("abcdef", "uvwxyz", strict=True)]

    def terms(times):
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * times)], "doc_id long, text string")
        out = {(r.doc_id % len(texts), tuple(tuple(s) for s in r["terms"])) for r in op6_pii.find(docs).collect()}
        return sorted(out)

    one = terms(1)
    assert sum(bool(t) for _, t in one) == 6 and terms(30) == one
    told = [k for k, t in enumerate(texts) if "@" in t]
    copies = spark.createDataFrame([(k, t) for k, t in enumerate(texts + [texts[k] for k in told] * 30)], "doc_id long, text string")
    assert {r.doc_id for r in op6_pii.find(copies).where("size(terms) > 0").collect()} >= {*told, len(texts)}


def test_terms_anywhere_in_a_text_that_holds_the_entity_are_masked(spark):
    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=2)) for _ in range(n))
    texts = [prose(60) for _ in range(300)]
    texts += [f"quagmire {prose(40)} write to quagmire zx@corp.example.org {prose(30)} yours, Quagmire" for _ in range(4)]  # near and far
    texts += [f"Wendigo {prose(40)} mail ab@corp.example.org" for _ in range(4)]  # far only
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in op6_pii.sanitise(docs).collect()}
    assert all(clean[k] == texts[k] for k in range(300))
    assert all("[EMAIL]" in clean[k] and "quagmire" not in clean[k].lower() and "wendigo" not in clean[k].lower() for k in range(300, 308))


def test_rows_without_an_id_and_with_clashing_columns_are_sanitised(spark):
    rows = [(None, "mail bob@corp.example.org now", 1, "k"), (None, "mail bob@corp.example.org now", 1, "k"), (None, None, 2, "k"), (3, "ip 10.0.0.1 and bob@corp.example.org", 3, "k"), (3, "clean", 4, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int, _spans string").withColumn("terms", F.lit(1)).withColumn("_id", F.lit(2))
    for small in (0, 100):
        got = op6_pii.sanitise(docs, small=small)
        assert got.columns == docs.columns
        assert sorted((str(r.text), r.h) for r in got.collect()) == sorted([("mail [EMAIL] now", 1)] * 2 + [("None", 2), ("ip [IP] and [EMAIL]", 3), ("clean", 4)])


def test_terms_equal_plain_counting(spark):
    """Both counts of the disclosure in plain Python over whole texts."""
    rnd = random.Random(9)
    vocab = ["".join(rnd.choices("abcdefghij", k=2)) for _ in range(60)]
    texts = []
    for k in range(120):
        w = rnd.choices(vocab, k=rnd.randint(5, 40))
        if k % 3 == 0:
            person = k // 3 % 5
            for _ in range(rnd.randint(1, 2)):
                w.insert(rnd.randint(0, len(w)), f"p{person}@corp.example.org")
                w.insert(rnd.randint(0, len(w)), f"alias{person}" if rnd.random() < 0.8 else "other")
        texts.append(" ".join(w))
    texts += texts[:30]
    word = re.compile(r"[^\W_]+")
    near, held, tf, df = set(), {}, {}, {}
    once = sorted(set(texts))
    for t in once:
        spans = [(s, e, f"{kind}:{t[s:e].lower()}") for s, kind, e in op6_pii.base_spans(t)]
        every = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(t)]
        for _, _, w in every:
            tf[w] = tf.get(w, 0) + 1
        for w in {w for *_, w in every}:
            df[w] = df.get(w, 0) + 1
        clear = [x for x in every if not any(x[0] < e and x[1] > s for s, e, _ in spans)]
        for s, _, entity in spans:
            before = [x for x in clear if x[1] <= s]
            after = clear[len(before) :]
            chosen = before[-op6_pii.REACH :] + after[: op6_pii.REACH]
            near |= {(entity, tuple(w for *_, w in chosen), w) for *_, w in chosen}
            held.setdefault(entity, {})[t] = {w for *_, w in clear}

    def gain(both, entity, term, n):
        return entity < n and np.log(both * n / (entity * term)) / np.log(n / entity) >= op6_pii.DISCLOSURE

    told, windows = set(), sum(tf.values()) / (2 * op6_pii.REACH + 1)
    for entity, own in held.items():
        contexts = {(e, c) for e, c, _ in near if e == entity}
        for w in set().union(*own.values()):
            together, texts_of = len({c for e, c, x in near if e == entity and x == w}), sum(w in x for x in own.values())
            if together >= op6_pii.SUPPORT and gain(together, len(contexts), tf[w], windows) or texts_of >= op6_pii.SUPPORT and len(own) >= op6_pii.SUPPORT and gain(texts_of, len(own), df[w], len(once)):
                told.add((entity, w))
    assert told
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op6_pii.find(docs).collect():
        t = texts[r.doc_id]
        want = {w for e, w in told if t in held[e] and w in held[e][t]}
        assert {t[s["start"] : s["end"]].lower() for s in r["terms"]} == want


def test_language_id_held_out_and_und(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in op8_langid.op8_langid(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    test = [i for i, r in rows.items() if r.held_out and truth[i]]
    assert np.mean([rows[i].lang_pred == truth[i] for i in test]) >= 0.97
    model = op8_langid.train(docs)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 !!", 5), (4, "the and of " * 40_000, 5), (5, "½ ² ①", 5), (None, "the and of", 5), (6, "\u0301", 5)], "doc_id long, text string, score int")
    odd = odd.withColumns({"lang_pred": F.lit("zz"), "_p": F.lit(1), "found": F.lit(1)})
    got = {r.doc_id: r for r in op8_langid.predict(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 5, 6)] == ["und"] * 5 and got[4].lang_pred == got[None].lang_pred == "en" and got[5].score == 0
    assert op8_langid.predict(odd.limit(0), model).count() == 0
    assert op8_langid.train(_empty(spark)) is None
    assert {r.lang_pred for r in op8_langid.predict(odd, None).collect()} == {"und"}


def test_the_sample_does_not_depend_on_the_order_of_rows(spark):
    rows = [(k % 7, f"{'abcdefg'[k % 7]}{'xyz'[k % 3]} wort {k % 5}", "de" if k % 2 else "en") for k in range(200)]
    models = [op8_langid.train(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n), per_lang=4) for r, n in ((rows, 2), (rows[::-1], 5))]
    assert models[0].langs == models[1].langs and np.allclose(models[0].weights, models[1].weights)


def test_no_language_is_left_out(spark):
    names = [f"l{k:02}" for k in range(9)] + ["zh"]
    docs = spark.createDataFrame([(k, f"{chr(97 + k % 10) * 3} {chr(107 + k % 10) * 4} {'xyz'[k % 3]}", names[k % 10]) for k in range(400)], "doc_id long, text string, lang string")
    model = op8_langid.train(docs, per_lang=10, max_langs=4)
    assert model.langs == names
    assert op8_langid.score(model, ["jjj tttt"])[0] == ["zh"]


def test_kernel_shortcut_equals_the_kernel():
    """Scores against plain kernel ridge regression: n-gram sets, kernel values, Nystroem features, normal equations."""
    rnd = random.Random(31)
    words = {"en": "the and of to in that with fox dog".split(), "de": "der und die von zu das mit fuchs hund".split(), "fr": "le et de la que avec renard chien".split()}
    texts = [(lang, " ".join(rnd.choices(own, k=rnd.randint(3, 12)))) for lang, own in words.items() for _ in range(15)]
    model = op8_langid.fit([t for _, t in texts], [lang for lang, _ in texts], landmarks_per_lang=6)

    def grams(text):
        t = f" {op8_langid.normal(text)} "
        out = set()
        for n in op8_langid.LENGTHS:
            for k in range(len(t) - n + 1):
                code = 0
                for j in range(n):
                    code = (code * 0x01000193 + ord(t[k + j]) + j + 1) % 2**32
                out.add((code * 0x9E3779B1 % 2**32) >> (32 - op8_langid.BITS))
        return frozenset(out)

    kernel = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    rows = sorted({(lang, bits) for (lang, _), bits in zip(texts, op8_langid.packed([t for _, t in texts]), strict=True)})
    by_bits = {bits: grams(t) for (_, t), bits in zip(texts, op8_langid.packed([t for _, t in texts]), strict=True)}
    sets, langs = [by_bits[b] for _, b in rows], [lang for lang, _ in rows]
    marks = [sets[k] for k in op8_langid.landmarks(rows, 6)]
    values, vectors = np.linalg.eigh(np.array([[kernel(x, y) for y in marks] for x in marks]))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    feature = lambda x: np.r_[np.array([kernel(x, m) for m in marks]) @ root, 1]
    phi, names = np.array([feature(x) for x in sets]), sorted(words)
    weight = np.array([1 / langs.count(x) for x in langs])
    penalty = op8_langid.RIDGE * np.eye(phi.shape[1]) * len(names) / len(rows)
    penalty[-1, -1] = 0
    w = [np.linalg.solve(phi.T @ (phi * weight[:, None]) + penalty, phi.T @ (weight * np.where(np.array(langs) == n, 1, -1))) for n in names]
    new = ["the fox and the dog", "der hund", "avec le chien of", "zu in la"]
    pred, best = op8_langid.score(model, new)
    for t, p, s in zip(new, pred, best, strict=True):
        raw = [feature(grams(t)) @ x for x in w]
        assert p == names[int(np.argmax(raw))] and abs(s - np.clip((max(raw) + 1) / 2, 0, 1)) < 1e-3


def test_licenses(spark):
    texts = [None, "", "Released under the MIT License.", "prose here\nLICENSED under the Apache License, version 2.0\nmore", "the software is under no license at all", "x " * 50_000,
             " ".join(t for _, t in op9_licenses.TEMPLATES[5:6]), "a sentence. This work is licensed under the GNU General Public License, version 3. Another one."]
    rows = {r.doc_id: [x["license"] for x in r.licenses] for r in op9_licenses.scan_licenses(_docs(spark, texts)).collect()}
    assert rows == {0: [], 1: [], 2: ["MIT"], 3: ["Apache-2.0"], 4: [], 5: [], 6: ["MIT"], 7: ["GPL-3.0"]}
    assert op9_licenses.scan_licenses(_empty(spark)).count() == 0


def test_wrapped_and_commented_licenses(spark):
    import textwrap

    notice = {k: t for k, t in op9_licenses.TEMPLATES if k in ("MIT", "GPL-3.0-or-later", "ISC", "BSD-3-Clause", "GPL-3.0")}
    texts, want = [], []
    for k, t in notice.items():
        lines = textwrap.wrap(t, 40)
        for mark in (" * ", "# ", "// ", ""):
            texts.append("\n".join(f"{mark}{x}" for x in ["tool.c - a tool of many parts that does things, and more.", "Copyright 2020 Some One.", *lines, "The rest of this comment is about something else altogether."]))
            texts.append("\r\n".join(f"{mark}{x}".rstrip() for x in ["a tool of many parts that does things and more", "", *lines, "", "other words of this comment about something else altogether"]))
            want += [k, k]
    rows = {r.doc_id: [x["license"] for x in r.licenses] for r in op9_licenses.scan_licenses(_docs(spark, texts)).collect()}
    assert [(k, w) for k, w in enumerate(want) if w not in rows[k]] == []


def test_license_anchors_are_sound():
    rnd, found = random.Random(6), set(op9_licenses.anchors())
    for _, text in op9_licenses.TEMPLATES:
        words = op9_licenses.words_of(text)
        mine = set(op9_licenses.bigrams_of(words))
        for _ in range(40):
            other = [w for w in words if w not in found or rnd.random() < 0.2] + rnd.choices(["some", "more"], k=rnd.randint(0, 3))
            grams = set(op9_licenses.bigrams_of(other))
            if 2 * len(mine & grams) >= 0.8 * (len(mine) + len(grams)):
                assert found & set(other)


def test_word_arrays():
    w = textvec.words(["Ab cd", None, "", "AB", "x́y \U00020000z"])
    assert w.hash[0] == w.hash[2] and w.first.tolist() == [0, 2, 2, 2, 3, 5]
    assert list(zip(w.start.tolist(), w.end.tolist(), strict=True)) == [(0, 2), (3, 5), (0, 2), (0, 3), (4, 6)]
    code, doc = textvec.shingles(textvec.words(["a b c d e f", "a b", "", "b a"]), 5)
    assert doc.tolist() == [0, 0, 1, 3] and len(set(code.tolist())) == 4


def test_digests_of_the_contract(spark, sf, tok):
    rows = {r.doc_id: r for r in op1_bpe.op1_bpe(spark, sf).collect()}
    records = {r.doc_id: r for r in op2_records.op2_records(spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        one = records[r.doc_id]
        assert (one.start, one.n_tokens, one.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        start += len(ids) + 1


def test_pii_digest_of_the_contract(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op6_pii.op6_pii(spark, sf).collect():
        spans = _plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{op6_pii.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, kind, _ in spans) for k in range(4)]


def test_license_query_covers_all_documents(spark, sf):
    got = op9_licenses.op9_license_scan(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and got.where(F.col("n_licenses") > 0).count() > 0
