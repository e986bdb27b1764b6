from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest

from docloom.llm import quality, queries, sampling, toxicity
from tests.llm.cases import mixed_texts, rows


def held_out(spark, sf, run, label):
    scored = run(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    return [(r[label], r.predicted, r.score) for r in scored if r.held_out], scored


@pytest.mark.parametrize(("run", "label", "least"), [(queries.op3_toxicity, "toxic", 0.9), (queries.op5_quality, "quality", 0.85)])
def test_held_out_accuracy(spark, run, label, least):
    out, scored = held_out(spark, "/root/testdata/sf0.1", run, label)
    assert len(out) > 100
    assert sum(a == b for a, b, _ in out) / len(out) >= least
    assert all(0 <= r.score <= 1 for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)


def labelled(label):
    """Rows of driver documents for fitting and the held-out ones, as (text, label)."""
    d = "/root/testdata/sf0.1"
    found = duckdb.sql(f"select d.doc_id, text, {label} from '{d}/documents.parquet' d join '{d}/labels.parquet' l using (doc_id) where {label} is not null order by 1").fetchall()
    out = [x for x in found if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    return [x[1:] for x in found if x not in out], [x[1:] for x in out]


def test_swaps_occur_in_the_documents_and_hardly_move_scores():
    rest, out = labelled("toxic")
    texts, ys = map(list, zip(*rest, strict=True))
    groups = toxicity.learn_groups(texts, ys)
    pairs = toxicity.swapped_pairs(texts, toxicity.swap_table(groups))
    assert len(groups) >= 10 and len(pairs) >= 500
    free, bound = (toxicity.fit(texts, ys, swaps_weight=w) for w in (0.0, 1.0))
    change = lambda m: sum(abs(m.weight(a) - (0 if b in words else m.weight(b))) for a, b, words in pairs) / len(pairs)
    assert change(bound) < change(free) / 20
    terms = {g[0] for g in groups}
    neutral = [t for t, y in out if not y and terms & set(toxicity._words(t.lower()))]
    assert len(neutral) > 50
    wrong = lambda m: sum(m.score(t) >= 0.5 for t in neutral)
    assert wrong(bound) <= wrong(free)


def test_false_positives_on_neutral_mentions_fall():
    """A term that toxic rows mention more often: without the penalty a neutral mention is rejected, with it it isn't."""
    texts, ys = [], []
    for k in range(600):
        bad = k % 2 == 0
        term = "zorban" if bad or k % 20 == 1 else ("melgar", "tivish", "ankoro")[k % 3]
        texts.append(f"the {term} baker {'is an awful idiot' if k % 4 == 0 else 'was seen'} near street{k % 50} today")
        ys.append(int(bad))
    assert "zorban" in [g[0] for g in toxicity.learn_groups(texts, ys)]
    free, bound = (toxicity.fit(texts, ys, swaps_weight=w) for w in (0.0, 1.0))
    neutral = [f"the zorban baker bought bread on street{k}" for k in range(20)]
    wrong = lambda m: sum(m.score(t) >= 0.5 for t in neutral)
    assert wrong(free) > wrong(bound)


def test_quality_is_the_difference_of_sizes_alone():
    rest, out = labelled("quality")
    m = quality.fit(*map(list, zip(*rest[:3000], strict=True)))
    assert len(m.weights) == 2 and m.weights[1] > 0
    sizes = quality.Sizes(m.good, m.bad)
    scores = {t: 1 / (1 + np.exp(-(m.weights[0] + 10 * m.weights[1] * sizes.difference(t)))) for t, _ in out}
    assert sum((scores[t] >= 0.3) == bool(y) for t, y in out) / len(out) > 0.95
    by_difference = sorted(scores, key=sizes.difference)
    assert [scores[t] for t in by_difference] == sorted(scores.values())


@pytest.mark.parametrize("run", [queries.op3_toxicity, queries.op5_quality])
def test_queries_equal_their_models(spark, sf_dir, run):
    """Every column of the query against the model applied to each text in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    toxic = run is queries.op3_toxicity
    m = (toxicity if toxic else quality).train(docs, labels)
    sizes = None if toxic else quality.Sizes(m.good, m.bad)
    score = m.score if toxic else lambda t: 1 / (1 + np.exp(-np.clip(np.array([1.0, 10 * sizes.difference(t or "")]) @ np.array(m.weights), -30, 30)))
    plain = {r.doc_id: r.text for r in docs.collect()}
    got = run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(plain)
    for r in got:
        assert r.score == pytest.approx(score(plain[r.doc_id]), abs=1e-6)
        assert r.predicted == int(r.score >= (0.5 if toxic else 0.3))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_swapped_identity_terms_hardly_move_a_score():
    texts, labels = [], []
    for k in range(300):
        bad = k % 3 == 0
        texts.append(f"the {'muslim' if bad or k % 7 == 0 else 'christian'} baker is {'an awful idiot' if bad else 'at home'} today{k}")
        labels.append(int(bad))
    free, bound = (toxicity.fit(texts, labels, swaps_weight=w) for w in (0.0, 1.0))
    gap = lambda m: abs(m.score("the muslim baker is at home") - m.score("the christian baker is at home"))
    assert gap(bound) < gap(free)
    assert bound.score("an awful idiot") > 0.5 > bound.score("the muslim baker is at home")


def test_scores_of_odd_texts(spark):
    df = rows(spark, mixed_texts())
    for model, score in ((toxicity.fit(["bad idiot", "good day"], [1, 0]), toxicity.score_column), (quality.fit(["good text " * 9, "bad!! " * 9] * 4, [1, 0] * 4), quality.score_column)):
        got = df.withColumn("s", score(model)).select("text", "s").collect()
        assert all(0 <= r.s <= 1 for r in got)
        assert len({r.s for r in got if not r.text}) == 1
        assert df.limit(0).withColumn("s", score(model)).count() == 0


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    df = rows(spark, mixed_texts())
    labels = df.select("doc_id").withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "1 as toxic")
    texts, ys = sampling.labelled_sample(df, labels, "toxic", 10, 300, share=1)
    assert len(texts) == len(ys) <= 10
    assert sum(map(len, texts)) <= 300
    held = {r.text for r in df.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    others = {r.text for r in df.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert not (set(texts) - {""}) & (held - others)
    assert sampling.labelled_sample(df, labels.limit(0), "toxic", 10, 300) == ([], [])
    assert max(map(len, sampling.labelled_sample(df, labels, "toxic", 1000, 8000, share=20)[0])) <= 400


def test_fitting_on_nothing():
    assert 0 <= toxicity.fit([], []).score("x") <= 1
    assert quality.fit([], []).weights


def test_dictionaries_reach_as_far_into_a_text_as_asked():
    texts = [f"{'filler ' * 800}marker-{k % 3}-far-behind " * 2 for k in range(6)]
    assert b"far-behind" not in quality.build_dictionary([t[:5000] for t in texts])
    assert b"far-behind" in quality.build_dictionary(texts, pieces_of_one=None, most_pieces=None)
    assert b"far-behind" not in quality.build_dictionary(texts)
