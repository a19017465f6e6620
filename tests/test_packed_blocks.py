"""Pairs of papers and of sets from blocks that are packed and kept once: no row is shuffled again for the blocks that it meets."""

import pytest

from folioscope import plans
from folioscope.operators import blocks, greedy, setjoin

from .test_queries import SF


@pytest.mark.parametrize("name", ["cross_paper_gaps", "result_divergence", "graph_from_comparisons"])
def test_rows_are_not_sent_to_each_block(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "LEAST_ROWS", 10)
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sets_are_not_sent_to_each_block(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "o long, m string")
    found = setjoin.similar_sets(rows, "o", "m", 0.6)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and len(found.collect()) == 1


def test_limitations_make_pairs_once(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(greedy, "leaders", lambda items, item, takes: taken.append(takes) or items)
    plans.QUERIES["limitation_clusters"](spark, SF)
    plan = taken[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Union" not in plan
