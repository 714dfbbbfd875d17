"""Texts are joined to the hits of a prompt block that may fit, not to every document with a query term."""

from quillgraph.operators import support
from quillgraph.plans import queries_support
from quillgraph.plans.views import Store


def test_only_hits_that_may_fit_meet_their_texts(spark, sf, monkeypatch):
    made, whole = [], support.prompt_blocks
    monkeypatch.setattr(support, "prompt_blocks", lambda hits, floor: made.append(hits) or whole(hits, floor))
    assert queries_support.QUERIES["prompt_block"](Store(spark, sf)).count() > 0
    assert made[0].where("score < 1.5").isEmpty()
    assert made[0].groupBy("qid").count().where(f"count > {support.BLOCK_BYTES // 5}").isEmpty()
