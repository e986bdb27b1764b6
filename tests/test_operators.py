from __future__ import annotations

import datetime as dt
import shutil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import periods, text
from docloom.operators import citations, evaluation, fusion, sentiment, store, vectors
from docloom.operators.chunking import Limits, count_tokens, pack
from docloom.sources.html import to_prose
from docloom.streaming import events


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab. ", min_size=1, max_size=60), max_size=25), st.integers(3, 30), st.integers(0, 10))
def test_chunks_keep_sentences_and_limits(parts, most, overlap):
    parts = [p for p in parts if count_tokens(p)]
    limits = Limits(target=most, most=most, least=2, overlap=overlap)
    chunks = pack(parts, limits)
    joined = " ".join(chunks)
    for p in parts:
        if count_tokens(p) <= most:
            assert p in joined
    assert bool(chunks) == bool(parts)


def test_short_tail_joins_its_predecessor():
    assert pack(["one two three four", "five"], Limits(target=4, most=4, least=2, overlap=0)) == ["one two three four five"]
    assert pack(["a b c d e f g"], Limits(target=3, most=3, least=1, overlap=0)) == ["a b c", "d e f", "g"]
    assert pack(["a b", "c d", "e f"], Limits(target=4, most=4, least=1, overlap=2)) == ["a b c d", "c d e f"]


def test_sentences_spare_abbreviations(spark):
    got = one(spark, text.sentences(F.lit("Apple Inc. Reported well today. The U.S. Market rose again! no split here. Ok.")).alias("s")).s
    assert got == ["Apple Inc. Reported well today.", "The U.S. Market rose again! no split here."]


def test_mentions_are_whole_words(spark):
    cases = {"Meta rose": True, "metals rose": False, "META rose": True, "xMeta": False, "(Meta)": True, "meta": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.mentions("t", ["Meta"]).alias("m"))
    assert {r.t: r.m for r in df.collect()} == cases


@pytest.mark.parametrize(
    ("doc_type", "end", "month", "day", "expected"),
    [
        ("10-K", "2025-01-26", 1, 26, (2025, "FY")),
        ("10-K", "2024-06-30", 6, 30, (2024, "FY")),
        ("10-Q", "2024-09-30", 6, 30, (2025, "Q1")),
        ("10-Q", "2024-03-31", 12, 31, (2024, "Q1")),
        ("10-K", "2023-10-01", 9, 28, (2023, "FY")),
        ("news", "2023-10-01", 9, 28, None),
    ],
)
def test_fiscal_labels(spark, doc_type, end, month, day, expected):
    got = one(spark, periods.fiscal_label(F.lit(doc_type), F.lit(end).cast("date"), F.lit(month), F.lit(day)).alias("l")).l
    assert (tuple(got) if got else None) == expected


def test_29_february_is_the_28th_of_a_common_year(spark):
    r = one(spark, periods.safe_date(F.lit(2023), F.lit(2), F.lit(29)).alias("a"), periods.safe_date(F.lit(2024), F.lit(2), F.lit(29)).alias("b"))
    assert (r.a, r.b) == (dt.date(2023, 2, 28), dt.date(2024, 2, 29))


@pytest.mark.parametrize(
    ("label", "year", "part", "end", "expected"),
    [
        ("Year Ended June 30, 2024", 2024, "FY", "2024-06-30", True),
        ("Three Months Ended June 30, 2024", 2024, "FY", "2024-06-30", False),
        ("Six Months Ended Jun 30, 2024", 2024, "Q2", "2024-06-30", False),
        ("Three Months Ended Jun 28, 2024", 2024, "Q2", "2024-06-30", True),
        ("2Q26", 2026, "Q2", None, True),
        ("Q3 2026", 2026, "Q2", None, False),
        ("2025", 2025, "FY", None, True),
        ("2025", 2024, "FY", None, False),
    ],
)
def test_headings_denote_periods(spark, label, year, part, end, expected):
    got = one(spark, periods.column_matches(F.lit(label), F.lit(year), F.lit(part), F.lit(end).cast("date")).alias("m")).m
    assert got is expected


def test_citations_are_renumbered(spark):
    answer = "B [Source 3] and A [Source 1], again [Source 3] but not [Source 9] ."
    got = one(spark, citations.rewritten(F.lit(answer), F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("a")).a
    assert got == "B [Source 1] and A [Source 2], again [Source 1] but not."


def test_scaled_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0), (2, 3.0)], "q int, score double")
    got = sorted((r.q, r.s) for r in df.select("q", fusion.min_max("score", "q").alias("s")).collect())
    assert got == [(1, 0.0), (1, 1.0), (2, 1.0), (2, 1.0)]


def test_sentiment_by_hand(spark):
    rows = [("e", "d1", "c1", 0, "item_7", "filer", "2024-01-10", 0.5, 1.0, True), ("e", "d1", "c2", 1, "item_1a", "filer", "2024-01-10", -0.5, 1.0, True), ("e", "d2", "c3", 0, None, "news_title", "2024-01-17", 1.0, 0.5, True), ("e", "d3", "c4", 0, None, "news_body", "2024-01-17", -1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "entity string, source_id string, chunk_id string, chunk_index int, section string, attribution string, date string, score double, confidence double, reliable boolean").withColumn("date", F.to_date("date"))
    as_of = F.lit("2024-01-17").cast("date")
    r = sentiment.entity_scores(sentiment.document_signals(sentiment.picked(df, as_of), as_of)).first()
    assert r.score == pytest.approx((0.5 * 0.0 + 0.5 * 1.0) / 1.0)
    assert sentiment.status(df, as_of).first().status == "ok"
    assert sentiment.status(df, F.lit("2024-06-01").cast("date")).first().status == "stale"
    early = sentiment.status(df, F.lit("2020-01-01").cast("date")).first()
    assert (early.status, early.last_document_date) == ("stale", None)
    assert sentiment.status(df.where("attribution = 'news_body'"), as_of).first().status == "no_data"
    some = df.withColumn("reliable", F.col("chunk_id") == "c1")
    r = sentiment.status(some, as_of).first()
    assert (r.status, r.reason, r.documents_used, r.reliable_chunks, r.total_chunks) == ("degraded", "partial_extraction_failure", 1, 1, 3)
    assert sentiment.status(df.withColumn("reliable", F.lit(False)), as_of).first().reason == "full_extraction_failure"


def test_ranking_by_hand(spark):
    judged = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, doc_id int, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99)], "query_id int, doc_id int")
    r = evaluation.ranking(judged, relevant).first()
    assert (r.reciprocal_rank, r.hit_at_1, r.hit_at_3) == (0.5, 0.0, 1.0)


def test_vector_actions_and_clipping(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "")], "id int, hash string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (4, "d"), (5, None)], "id int, hash string")
    got = {r.id: r.action for r in vectors.upsert_actions(stored, new).collect()}
    assert got == {1: "skip", 2: "replace", 3: "replace", 4: "insert", 5: "insert"}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id int, query array<float>")
    assert {r.vec_id: round(r.score, 6) for r in vectors.search(v, q, 2).collect()} == {1: 1.0, 2: 0.0}


def test_store_publishes_and_rolls_back(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.read() is None
    df = spark.range(5).withColumnRenamed("id", "chunk_id")
    s.publish(df, "chunk_id")
    s.publish(df.where("chunk_id < 3"), "chunk_id")
    assert s.read().count() == 3
    with pytest.raises(ValueError, match="repeats"):
        s.publish(df.union(df), "chunk_id")
    assert s.read().count() == 3
    s.rollback()
    assert s.read().count() == 5


def test_prose_of_pages():
    assert to_prose("<p>a</p><script>x()</script><table><tr><td>1</td></tr></table> b &amp; c") == "a b & c"
    assert to_prose(None) == ""


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in")
    stream = events.read_stream(spark, str(tmp_path / "in"), table.schema)
    out = events.tumbling(stream, "6 hours", "event_type", late="60 days").writeStream.format("memory").queryName("got").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    rows = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert rows(spark.table("got")) == rows(events.tumbling(events.with_time(table), "6 hours", "event_type"))


def test_upserts_are_idempotent(spark, tmp_path):
    seen = {}
    run = events.upsert_each(lambda df: seen.update({r.k: r.v for r in df.collect()}), ["k"], "v")
    batch = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    for n in range(2):
        run(batch, n)
    assert seen == {"a": 3, "b": 2}


def _file(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")
    (part,) = [p for p in (folder / name).iterdir() if p.suffix == ".parquet"]
    return part


def test_stream_keeps_the_first_of_each_key(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:05:00", 2.0), (2, "2024-01-01 00:06:00", 3.0)]
    (tmp_path / "in").mkdir()
    schema = "k int, ts string, value double"
    shutil.copy(_file(spark, tmp_path, "a", rows, schema), tmp_path / "in" / "a.parquet")
    stream = events.distinct_by(events.with_time(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "k")
    out = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(r.k for r in spark.table("firsts").collect()) == [1, 2]


def test_stream_of_latencies_keeps_the_last_samples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "kind string, latency_ms double"
    shutil.copy(_file(spark, tmp_path, "a", [("q", float(v)) for v in (10, 20, 30, 40, 50)], schema), tmp_path / "in" / "a.parquet")
    stream = events.rolling_latency(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), n=3)
    out = stream.writeStream.format("memory").queryName("latency").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    (r,) = spark.table("latency").collect()
    assert (r.kind, r.lifetime, r.held, r.p50) == ("q", 5, 3, 40.0)


def test_pool_takes_earlier_lists_whole_and_top_k_more(spark):
    listed = lambda ids: spark.createDataFrame([(i, float(-i)) for i in ids], "doc_id int, score double")
    known = spark.createDataFrame([(i, "same" if i in (3, 8) else f"h{i}") for i in range(100) if i != 5], "doc_id int, content_hash string")
    got = [(r.stage, r.doc_id) for r in fusion.pool([listed(range(6)), listed(range(3, 10)), listed(range(100))], known, 2).collect()]
    # 13 rows come before: 5 is unknown, 3 and 4 are there twice, 8 has 3's text; their room goes to the last list.
    assert got == [(0, i) for i in (0, 1, 2, 3, 4)] + [(1, i) for i in (6, 7, 9)] + [(2, i) for i in range(10, 17)]
