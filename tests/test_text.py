from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions import vectors as V
from quillgraph.operators.udfs import chunk


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_tokens_keep_repeats_drop_stop_words_and_stem(spark):
    assert _one(spark, "The Retrieval of retrieval, 42 and Retrievals!", T.tokens) == ["retrie", "retrie", "42", "retrie"]


def test_prose_skips_front_matter_fences_and_markup(spark):
    page = "---\nname: x\n---\n# head\nfirst line\n```\ncode here\n```\n    indented\n| a |\n- [ ] todo\nsecond line"
    assert _one(spark, page, T.prose_lines) == ["first line", "second line"]


def test_open_fence_hides_the_rest(spark):
    assert _one(spark, "one\n```\ntwo\nthree", T.prose_lines) == ["one"]


def test_sentences_are_cut_closed_and_long_enough(spark):
    text = "- This sentence is certainly long enough to stay! Short one. [Another](http://x) sentence that is **long** enough to stay"
    assert _one(spark, text, T.sentences) == ["This sentence is certainly long enough to stay.", "Another sentence that is long enough to stay."]


def test_claims_in_order(spark):
    got = [tuple(_one(spark, t, T.extract_claim) or ()) for t in ("at 192.168.1.107 v1.2.3", "Port 8080 open", "port 99999 and 1.2.3", "a\nkey = value\n", "nothing")]
    assert got == [("ipv4", "is", "192.168.1.107"), ("port", "is", "8080"), ("version", "is", "1.2.3"), ("key", "=", "value"), ()]


def test_links_outside_code(spark):
    assert _one(spark, "[[a|x]] `[[b]]` [[c#h]]\n```\n[[d]]\n```\n[[e.md]] <!-- [[f]] -->", T.wikilinks) == ["a", "c", "e"]


def test_front_matter(spark):
    assert _one(spark, "---\na: 1\n# c: 2\nb: 'x y'\n---\nbody", T.frontmatter) == {"a": "1", "b": "x y"}
    assert _one(spark, "no front matter", T.frontmatter) == {}


def test_cosine_corner_cases(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [-1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.x for r in rows.select(V.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0, -1.0, 0.0]


def test_chunks_cover_the_text_and_fit():
    text = "\n\n".join("word " * 100 + "end." for _ in range(9))
    parts = chunk(text, 1200)
    assert all(len(p) <= 1200 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert chunk(None) == [] and chunk("x" * 3000, 1200) == ["x" * 1200, "x" * 1200, "x" * 600]
