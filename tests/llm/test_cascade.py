"""The cascade's order by the state that it runs in, and what each rule decided."""

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality

PROSE = " ".join(f"word{i} goes on" for i in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["short"] * 30 + [PROSE] * 20 + [PROSE + " " + " ".join("###" + str(i) for i in range(20))] * 5 + ["\n".join(["same line of it"] * 30 + [PROSE])] * 2 + [None, ""]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_order_after_the_base_rules(docs, monkeypatch):
    """With base measures there, a rule that needs no other is free; what the base rules reject counts for none of the rest."""
    monkeypatch.setattr(quality, "timed", lambda sample: dict.fromkeys(quality.MEASURES, 1.0))
    order = quality.order_rules(docs, base_first=True)
    names = [n for n, _, _ in order]
    assert names[:2] == ["few_words", "repeats"] and names[2] == "symbols"
    cost = {n: c for n, _, c in order}
    assert cost["symbols"] < 1 <= cost["dup_lines"] and cost["short_words"] < 1
    share = {n: s for n, s, _ in order}
    assert share["few_words"] > share["symbols"] > 0 == share["short_words"]


def test_decided_counts_the_rows_that_reach_a_rule(docs):
    found = quality.decided(docs).orderBy("place").collect()
    assert [r.place for r in found] == list(range(len(quality.RULES))) and found[0].reached == docs.count()
    for before, after in zip(found, found[1:]):
        assert after.reached == before.reached - before.rejected
    kept = quality.judge(docs).filter("kept").count()
    assert found[-1].reached - found[-1].rejected == kept == quality.keep_good(docs).count() == 20
    assert sum(r.rejected for r in found) == docs.count() - kept


def test_nothing_to_decide(docs):
    assert quality.decided(docs.limit(0)).agg(F.sum("reached").alias("n")).first().n == 0
