"""Results that must not depend on how rows are dealt, and steps that must stay bounded, against plain rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.operators import bm25, rerank, sums, vectors
from docloom.operators.best import Best
from docloom.plans import QUERIES
from tests.test_queries import plan_of


def added(values):
    total = 0.0
    for v in values:
        total += v
    return total


def dealt(spark, rows, schema, path):
    """Rows in files of their own in another order than their keys'."""
    spark.createDataFrame(rows[::-1], schema).repartition(7).write.parquet(str(path))


def test_sums_in_order_are_those_of_a_reader(spark):
    rows = [(k % 3, k, (k * 7919 % 1000) / 100 + 0.01) for k in range(300)] + [(None, 300, 0.1), (3, 301, None)]
    df = spark.createDataFrame(rows, "g int, k int, v double").repartition(9)
    expected = {g: added(v for h, _, v in rows if h == g and v is not None) for g in (0, 1, 2, None)} | {3: None}
    for close in (F.lit(True), F.col("total") > -1):
        got = {r.g: r for r in sums.totals(df, ["g"], "v", "k", close).collect()}
        assert {g: r.total for g, r in got.items()} == expected
        assert (got[3].n, got[3].rows, got[None].n, got[0].n) == (0, 1, 1, 100)


def test_labels_at_an_edge_are_by_the_order_of_events(spark, tmp_path):
    """Means of 50.1 and 49.9 but for the last digits, which the order of addition decides."""
    rows, k = [], 0
    for user in range(40):
        values = [(user * 37 + j * 7919) % 10007 / 100 for j in range(60)]
        values.append(round((50.1 if user % 2 else 49.9) * 61 - sum(round(v * 100) for v in values) / 100, 2))
        for v in values:
            rows.append((k, user, v))
            k += 1
    dealt(spark, rows, "event_id long, user_id long, value double", tmp_path / "events.parquet")
    means = {u: added(v for _, w, v in rows if w == u) / 61 - 50 for u in range(40)}
    expected = {u: "positive" if m > 0.1 else "negative" if m < -0.1 else "neutral" for u, m in means.items()}
    assert len(set(expected.values())) == 3
    assert {r.entity: r.label for r in QUERIES["predicted_labels"](spark, str(tmp_path)).collect()} == expected


def test_totals_halfway_are_by_the_order_of_orders(spark, tmp_path):
    rows = [(c * 9 + j, c, [100000.1, 33333.3, 77777.7, 0.2, 5.4, 123456.6, 9.9, 41.2][(j * 3 + c) % 8] + c * 0.1 if j < 8 else 0.0) for c in range(40) for j in range(9)]
    last = {c: round(-sum(round(v * 100) for _, d, v in rows if d == c) / 100 % 1 + 0.5, 2) for c in range(40)}
    rows = [(k, c, v if k % 9 < 8 else last[c]) for k, c, v in rows]
    made = spark.createDataFrame(rows[::-1], "o_orderkey long, o_custkey long, o_totalprice double").withColumn("o_orderdate", F.lit("1999-05-05").cast("timestamp_ntz"))
    made.repartition(7).write.parquet(str(tmp_path / "orders.parquet"))
    expected = {c: str(int(added(v for _, d, v in rows if d == c) + 0.5)) for c in range(40)}
    got = QUERIES["table_cells"](spark, str(tmp_path)).where("label = 'Total' and column = '1999'")
    assert {r.o_custkey: r.value for r in got.collect()} == expected


def test_best_keeps_k_of_each_query_with_ties_by_id(monkeypatch):
    monkeypatch.setattr("docloom.operators.best.SPARE", 10)
    rows = [(q, (i * 7) % 101, ((i * 13 + q) % 5) / 3 - 1e-12 * (i % 2)) for q in range(3) for i in range(101)]
    best = Best(3, 4)
    for a in range(0, len(rows), 20):
        best.add(*(np.array(x) for x in zip(*rows[a : a + 20], strict=True)))
    assert best.size < 50
    query, ids, *_ = best.cut()
    expected = [(q, i) for q in range(3) for _, i in sorted((-round(s, 9), i) for p, i, s in rows if p == q)[:4]]
    assert list(zip(query.tolist(), ids.tolist(), strict=True)) == expected


def test_no_pair_of_query_and_document_is_shuffled(spark, sf_dir):
    """Each task hands on its best: what is dealt by query comes right from the scoring."""
    for name in ("bm25_batch", "minmax", "evidence_budget", "hybrid_merge", "overlap_diag"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "MapInArrow" in plan
        assert "hashpartitioning(query_id, doc_id" not in plan.replace("#", " ").split("MapInArrow")[-1], name


def test_the_best_are_the_best_of_all_scores(spark):
    """Equal texts, ids of strings, ids that rows share, questions without a hit and repeated words."""
    texts = ["the cat sat", "a cat and a dog", "the the dog, 3.50 paid", "", None, "birds fly the sky", "the cat sat", "nothing here", "dog dog dog cat"]
    questions = spark.createDataFrame([("b", "the cat cat"), ("a", "dog 3.50"), ("c", "zebra"), ("d", "nothing birds zebra")], "query_id string, query string")
    for ids in ([f"d{k}" for k in range(9)], [f"d{k % 4}" for k in range(9)]):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string").repartition(3)
        every = bm25.top_k(bm25.scores(docs, questions).withColumn("score", F.round("score", 9)), 2).collect()
        got = bm25.best(docs, questions, 2).collect()
        assert sorted((r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in got) == sorted((r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in every)


def test_the_nearest_are_those_of_all_pairs(spark, monkeypatch):
    """Copies, opposite, zero and odd vectors, ids of strings, queries in several parts."""
    monkeypatch.setattr(vectors, "MOST_ASKED", 30)
    monkeypatch.setattr(vectors, "MANY_PAIRS", 100)
    made = [[((k % 40) * 7919 * (j + 1) % 23 - 11) / 10 for j in range(6)] for k in range(120)]
    made[5], made[6] = [0.0] * 6, [-x for x in made[7]]
    for ids, odd in ((list(range(120)), None), ([f"v{k}" for k in range(120)], None), (list(range(120)), [1.0, 2.0]), (list(range(120)), [float("nan")] * 6)):
        rows = list(zip(ids, [*made[:-1], odd or made[-1]], strict=True))
        held = spark.createDataFrame(rows, f"vec_id {'string' if ids[0] == 'v0' else 'long'}, embedding array<float>").repartition(3)
        queries = held.where("cast(replace(vec_id, 'v', '') as int) between 0 and 12").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        every = {}
        for r in vectors._all_pairs(held, queries).collect():
            every.setdefault(r.query_id, []).append((-r.rounded, r.vec_id))
        got = {}
        for r in vectors.search(held, queries, 9).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(r.score, 8), r.vec_id))
        assert {q: x for q, x in got.items()} == {q: [(round(-s, 8), v) for s, v in sorted(x)[:9]] for q, x in every.items()}
        assert len(got) == 13


def test_no_pair_of_vectors_goes_through_a_join(spark, sf_dir):
    assert "NestedLoop" not in plan_of(QUERIES["knn_batch"](spark, sf_dir))
    none = spark.createDataFrame([], "query_id long, query array<float>")
    assert vectors.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), none, 3).collect() == []


def test_windows_of_a_batch_are_handed_on_in_parts():
    texts = [f"Text {k} goes on. " * (k % 90) for k in range(1001)]
    parts = rerank.in_parts(iter([pa.array(texts[:900]), pa.array(texts[900:])]))
    first = next(parts)
    assert len(first) == rerank.TEXTS < 900
    assert [w for p in (first, *parts) for w in p.to_pylist()] == [rerank.windows_of(t) for t in texts]
