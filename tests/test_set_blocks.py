"""Sets that meet in blocks, against plain loops, with blocks so small that there are many."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope import plans
from folioscope.operators import setjoin

from .test_queries import SF


def small(monkeypatch, rare):
    for name, value in (("SETS", 9), ("ITEMS", 80), ("RARE", rare), ("COLUMNS", 3), ("AT_ONCE", 10)):
        monkeypatch.setattr(setjoin, name, value, raising=False)


@pytest.mark.parametrize("rare", [1, 10, 10**9])
def test_blocks_lose_no_pair(spark, monkeypatch, rare):
    small(monkeypatch, rare)
    rng = random.Random(9)
    sets = {f"s{i}": {f"m{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randint(0, 14))} for i in range(120)}
    rows = spark.createDataFrame([(i, m) for i, s in sets.items() for m in [*s, None]], "o string, m string")
    want = sorted((a, b, len(x & y), len(x), len(y)) for a, x in sets.items() for b, y in sets.items() if a < b and x and len(x & y) >= 0.6 * len(x | y) - 1e-9)
    assert sorted(map(tuple, setjoin.similar_sets(rows, "o", "m", 0.6).collect())) == want
    other = rows.select((F.substring("o", 2, 9).cast("int") + 7).alias("p"), "m")
    want = sorted((a, int(b[1:]) + 7, len(x & y), len(x), len(y)) for a, x in sets.items() for b, y in sets.items() if len(x & y) >= 3)
    assert sorted(map(tuple, setjoin.overlapping_sets(rows, other, "o", "p", "m", 3).collect())) == want


def test_one_id_with_two_texts(spark, tmp_path):
    texts = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta zeta"), (2, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, plans.QUERIES["jaccard_docs"](spark, str(tmp_path)).collect())) == [(1, 2, 1.0)]


def test_no_set_is_joined_to_pairs(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "o long, m string")
    for found in (setjoin.similar_sets(rows, "o", "m", 0.6), setjoin.overlapping_sets(rows, rows.withColumnRenamed("o", "p"), "o", "p", "m", 1)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") <= 1 and "Aggregate" not in plan  # the sizes of blocks at most; pairs are not gathered


def test_signals_send_texts_once_and_join_no_pair(spark):
    plan = plans.QUERIES["complement_signals"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1


def test_signals_of_rows_without_id_or_text(spark, tmp_path):
    said = "alpha beta gamma memory the and"
    spark.createDataFrame([(1, said), (2, None), (None, said), (3, "alpha beta the and")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Alpha beta gamma quantized the and"), (8, None), (9, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(map(tuple, plans.QUERIES["complement_signals"](spark, str(tmp_path)).collect()))
    assert found == [(1, 7, 3, "document to passage", 0.9), (1, 7, 3, "passage to document", 0.65)]
