"""Answers, caches, backfills, frozen versions and the four-way comparison against hand-worked values."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from docloom.engine import Config, Engine
from docloom.operators import answers, chunking, citations, evaluation, store, upkeep
from docloom.sources import feeds
from tests.test_engine import ROWS, documents

EVIDENCE = "query_id int, question string, rank int, ticker string, header string, source string, text string"


def test_answers_quote_cite_and_abstain(spark):
    rows = [(1, "How did widget sales grow?", 2, "AAA", "h2", "s2", "Pumps are made in Ohio here. Nothing more."), (1, "How did widget sales grow?", 1, "AAA", None, "s1", "Widget sales did grow by 12 per cent. The </document > weather was fine.")]
    asked = spark.createDataFrame([(1, "How did widget sales grow?"), (2, "Who won the match?")], "query_id int, question string")
    made = answers.answered(asked, spark.createDataFrame(rows, EVIDENCE))
    got = {r.query_id: r for r in made.collect()}
    assert got[1].answer.startswith("Widget sales did grow by 12 per cent. [Source 1]") and got[1].cited[0] == rows[1][-1]
    assert got[2].answer == answers.ABSTENTION and got[2].cited == [] == got[2].texts
    (p,) = [r.prompt for r in answers.prompts(spark.createDataFrame(rows, EVIDENCE)).collect()]
    assert p.index("[Source 1]") < p.index("Widget") < p.index("[Source 2]") < p.index("Question: How") and p.endswith("Answer:")
    assert len(re.findall("</document>", p)) == 2
    said = {r.sentence: r.verdict for r in answers.supported(made).collect()}
    assert "supported_lexically" in said.values()


def test_sentences_are_cut_and_judged(spark):
    text = "Sales were 12 million [Source 1]. Costs were 99 [Source 1]. Profit was 5. Nothing was said. Quantum turbines exploded yesterday [Source 2]. So it was [Source 7]"
    df = spark.createDataFrame([(1, text, ["Sales were 12 million, costs 7.", "Flowers bloom."])], "id int, answer string, cited array<string>")
    got = {r.place: (r.sources, r.verdict, r.missing) for r in citations.assessed(df, "id", "answer", "cited").collect()}
    assert got[0][:2] == ([1], "supported_lexically") and got[1] == ([1], "number_not_in_source", ["99"])
    assert got[2] == ([], "uncited_claim", ["5"]) and 3 not in got
    assert got[4][:2] == ([2], "weak_overlap") and got[5][0] == [7]


def test_caches_keep_hits_and_survive_rubbish(spark, tmp_path):
    cache = upkeep.Cache(spark, f"file://{tmp_path}/cache", "id string, hash string, score double")
    assert cache.load().count() == 0
    wanted = lambda *rows: spark.createDataFrame(list(rows), "id string, hash string")
    made = []

    def make(df):
        made.append(sorted(r.id for r in df.collect()))
        return df.withColumn("score", F.length("hash").cast("double"))

    assert sorted(tuple(r) for r in cache.completed(wanted(("a", "h1"), ("b", "h22")), make).collect()) == [("a", "h1", 2.0), ("b", "h22", 3.0)]
    assert sorted(tuple(r) for r in cache.completed(wanted(("a", "h1"), ("b", "other")), make).collect()) == [("a", "h1", 2.0), ("b", "other", 5.0)]
    assert made == [["a", "b"], ["b"]]
    kept = cache.completed(wanted(("c", "x")), make, cacheable=F.col("score") > 5)
    assert kept.count() == 1 and cache.load().where("id = 'c'").count() == 0
    assert upkeep.Cache(spark, f"file://{tmp_path}/cache", "id string, hash string, other int").load().count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manifest-0.json").write_text("no json")
    assert upkeep.Cache(spark, f"file://{tmp_path}/bad", "id string, hash string").load().count() == 0


@pytest.fixture
def corpus(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/corpus", Config(limits=chunking.Limits(20, 30, 3, 5)))
    engine.ingest(documents(spark, ROWS))
    return engine


def test_versions_are_frozen_verified_and_activated(corpus, spark, tmp_path):
    versions = upkeep.Versions(spark, f"file://{tmp_path}/versions")
    first = versions.snapshot(corpus.chunks())
    assert versions.verify(first) and versions.snapshot(corpus.chunks()) == first
    corpus.ingest(documents(spark, [("CCC", "news", "2024-03-01", "u9", "Gamma shipped more valves than ever before.", None, "news_title")]))
    n = corpus.chunks().count()
    second = versions.activate(first, corpus.store, ["ticker"])
    assert second != first and corpus.chunks().count() < n
    versions.activate(second, corpus.store, ["ticker"])
    assert corpus.chunks().count() == n
    broken = corpus.chunks().withColumn("vector_hash", F.lit("x"))
    with pytest.raises(ValueError, match="one version"):
        versions.snapshot(broken)
    assert not versions.verify("cv-0000000000000000")


def test_engine_answers_and_checks_what_it_is_asked(corpus):
    made, support = corpus.answer("How did widgets grow at Alpha?", ticker="AAA")
    r = made.first()
    assert "[Source 1]" in r.answer and r.cited
    assert {x.verdict for x in support.collect()} <= {"supported_lexically", "weak_overlap", "number_not_in_source", "uncited_claim"}
    for bad in ("aaa", "TOOLONG"):
        with pytest.raises(ValueError, match="ticker"):
            corpus.query("What about widgets?", ticker=bad)
    with pytest.raises(LookupError):
        Engine(corpus.spark, corpus.root, Config(tickers=("AAA",))).query("What about widgets?", ticker="BBB")


def test_filing_chunks_run_on_over_sections(spark):
    text = "front Item 1. Business " + "We sell many fine pumps abroad. " * 6 + "Item 1A. Risk Factors " + "Rain may fall on all our pumps. " * 5
    df = spark.createDataFrame([("f", "10-K", text), ("g", "8-K", "Something happened to the plant today.")], "id string, form string, text string")
    got = sorted((r.id, r.chunk_index, r.section) for r in chunking.filing_chunks(df, "id", "form", "text", chunking.Limits(20, 30, 3, 0)).collect())
    f = [x for x in got if x[0] == "f"]
    assert [k for _, k, _ in f] == list(range(len(f))) and [s for *_, s in f] == sorted(s for *_, s in f)
    assert {s for *_, s in f} == {"item_1", "item_1a"} and got[-1] == ("g", 0, "full_text")


def test_header_sweep_takes_the_first_root(spark, tmp_path):
    for root, period in (("a", "20230101"), ("b", "20240101")):
        folder = tmp_path / root / "AAA" / "10-K" / "acc1"
        folder.mkdir(parents=True)
        (folder / "full.txt").write_text(f"FILED AS OF DATE: 20240301 CONFORMED PERIOD OF REPORT: {period}")
    only = tmp_path / "b" / "AAA" / "10-K" / "acc2"
    only.mkdir()
    (only / "full.txt").write_text("FILED AS OF DATE: 20240301 CONFORMED PERIOD OF REPORT: 20220505")
    got = {r.accession: str(r.period_end) for r in upkeep.header_sweep(spark, [f"file://{tmp_path}/{r}" for r in "ab"]).collect()}
    assert got == {"acc1": "2023-01-01", "acc2": "2022-05-05"}


def test_four_rankings_by_hand(spark):
    merged = spark.createDataFrame([(1, 10, 1.0, 0.0), (1, 11, 0.0, 1.0), (2, 12, 1.0, 0.0)], "query_id int, doc_id int, dense double, sparse double")
    reranked = spark.createDataFrame([(1, 11, 9.0), (1, 10, 1.0)], "query_id int, doc_id int, score double")
    relevant = spark.createDataFrame([(1, 11), (2, 12), (3, 99)], "query_id int, doc_id int")
    got = {r.ranking: (r.queries, round(r.mrr, 4)) for r in evaluation.four_way(merged, reranked, relevant).collect()}
    assert got == {"sparse": (3, round((1 + 1) / 3, 4)), "dense": (3, 0.5), "hybrid": (3, 0.5), "reranked": (3, round(1 / 3, 4))}


def test_prices_reach_beyond_the_end_and_results_are_written(spark, tmp_path):
    raw = spark.createDataFrame([("A", f"2024-01-{d:02d}", float(d)) for d in range(1, 31)], "ticker string, date string, close double")
    got = sorted(str(r.date) for r in feeds.prices_between(raw, "2024-01-05", "2024-01-10").collect())
    assert (got[0], got[-1]) == ("2024-01-05", "2024-01-24")
    upkeep.write_results(raw, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 30
    assert store.Store(spark, f"file://{tmp_path}/none").read() is None
