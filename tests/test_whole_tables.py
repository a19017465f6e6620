"""Queries that must read whole tables, against numpy on all rows."""

import duckdb
import numpy as np

from folioscope import plans

from .test_queries import SF


def test_linucb_rank_scores_every_row_on_the_whole_vector(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, r = np.stack(rows["embedding"].to_numpy()).astype(float), (rows["vec_id"] % 7).to_numpy() / 7.0
    want = {}
    for label in rows["label"].unique():
        own = (rows["label"] == label).to_numpy()
        inverse = np.linalg.inv(np.eye(x.shape[1]) + x[own].T @ x[own])
        theta = inverse @ (x[own].T @ r[own])
        score = x @ theta + 0.5 * np.sqrt(np.einsum("ij,jk,ik->i", x, inverse, x))
        want |= {(v, label): s for v, s in zip(rows["vec_id"], score)}
    found = {(f.vec_id, f.label): f.score for f in plans.QUERIES["linucb_rank"](spark, SF).collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-5 for k in want)


def test_hash_embedding_covers_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: r.embedding for r in plans.QUERIES["hash_embedding"](spark, SF).collect()}
    assert found.keys() == texts.keys()
    norms = [np.linalg.norm(found[k]) for k in texts if texts[k] and len(found[k]) == 16]
    assert len(norms) > 100 and all(abs(n - 1) < 1e-3 or n == 0 for n in norms)


def test_confirmed_complements_of_odd_lines(spark, tmp_path):
    lines = [(1, 1, 5, "A"), (1, 1, 5, "N"), (1, 2, 5, None), (2, 1, 5, "A"), (3, 1, 5, "A"), (4, 1, 5, "A"), (1, None, 5, "A"), (2, 1, None, "A"), (None, 1, 5, "A")]
    orders = [(1, "F"), (2, "O"), (4, None), (5, "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    want = duckdb.sql(plans.ORACLES["confirmed_complements"].replace("FROM lineitem JOIN orders", f"FROM '{tmp_path}/lineitem.parquet/*.parquet' JOIN '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    found = plans.QUERIES["confirmed_complements"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == set(want) and found.count() == len(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # no finding is joined to itself


def test_confirmed_complements_are_none_where_no_order_is(spark, tmp_path):
    spark.createDataFrame([(1, None, 5, "A")], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert plans.QUERIES["confirmed_complements"](spark, str(tmp_path)).collect() == []
