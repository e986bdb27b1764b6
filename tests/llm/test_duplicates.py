from __future__ import annotations

import collections
import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import common, jaccard, suffixes
from docloom.llm.common import spread_join
from docloom.llm.components import components
from tests.llm.cases import mixed_texts, rows, thue_morse, words

_words = re.compile("[^ \t-\r]+").findall


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = _words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    held = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, both in collections.Counter(j for x in s for j in held[x] if j > i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}


def test_near_duplicates_equal_brute_force(spark):
    chain = words(40, 77, 10_000).split()
    texts = mixed_texts()
    for k in range(12):  # each links with the next, the first and last with each other not
        chain[3 * k % 40] = f"z{k}"
        texts.append(" ".join(chain))
    df = rows(spark, texts)
    expected = brute_components({r.doc_id: r.text for r in df.collect()})
    assert near(df) == expected
    assert len({c for _, c in expected.values()}) < len(expected)


def test_near_duplicates_of_driver_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert near(df) == brute_components({r.doc_id: r.text for r in df.collect()})


def test_near_duplicates_bear_repeats_and_nothing(spark):
    df = rows(spark, mixed_texts())
    assert near(df.union(df.where("doc_id % 2 = 0"))) == near(df)
    assert near(df.limit(0)) == {}
    nameless = df.withColumn("doc_id", F.when(F.col("doc_id") > 6, F.col("doc_id")))
    assert None not in near(nameless)


def test_leftover_round_finds_what_stars_miss(spark):
    """Documents that the least one doesn't link still meet one another."""
    base = words(100, 5, 10_000).split()
    texts = [" ".join(base)]
    far = base[:75] + [f"q{k}" for k in range(25)]
    texts += [" ".join(far), " ".join(far[:-1] + ["other"])]
    df = rows(spark, texts)
    assert near(df) == brute_components({r.doc_id: r.text for r in df.collect()})


def test_words_of_structured_hashes_make_no_links(spark):
    for n in (1024, 2048):
        a, b = thue_morse(n)
        texts = [f"p q {a} r s", f"p q {b} r s", f"p q {a} r s"]
        df = rows(spark, texts, step=1)
        assert near(df) == {0: (1, 0), 1: (1, 1), 2: (1, 0)}


def test_one_of_the_rows_of_an_id_counts_in_any_order(spark):
    a, b = words(40, 1, 10_000), words(40, 2, 10_000)
    made = [(5, a), (5, b), (8, b + " x"), (9, a + " x"), (7, None), (7, a), (7, "")]
    got = []
    for seed in range(6):
        random.Random(seed).shuffle(made)
        df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
        got.append(near(df))
    assert all(g == got[0] for g in got)
    assert sorted(got[0]) == [5, 7, 8, 9] and got[0][7] == (0, 7)
    assert (got[0][8][1] == 5) != (got[0][9][1] == 5)


def test_hot_tokens_are_compared_in_parts(spark, monkeypatch):
    """Documents that share one token of their prefix each, in several components, with jobs of few entries."""
    monkeypatch.setattr(jaccard, "PART_ENTRIES", 6)
    texts = []
    for k in range(30):
        base = words(40, 1000 + k // 3, 10_000).split()
        texts.append(" ".join(base[:38] + [f"v{k}", "tail"]))
    df = rows(spark, texts, step=1)
    expected = brute_components({r.doc_id: r.text for r in df.collect()})
    assert near(df) == expected
    sets = spark.createDataFrame([(k, k, np.sort(np.array([1, 2, 3, 4, 10**6 + k, 10**7 + k], np.uint64)).tobytes(), 1) for k in range(200)], "doc long, component long, keys binary, l long")
    assert jaccard.cell_parts(sets).max() > 1
    assert jaccard.leftover_pairs(sets, 4).count() == jaccard.leftover_pairs(sets, 4).distinct().count() == plain_pairs(sets)


def plain_pairs(sets):
    keys = [set(np.frombuffer(r.keys, np.uint64).tolist()) for r in sets.collect()]
    return sum(7 * len(a ^ b) <= len(a) + len(b) for i, a in enumerate(keys) for b in keys[i + 1 :])


def test_unsettled_components_raise(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long"), rounds=1)


def test_spread_join_equals_a_join(spark):
    many = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(300)], "x long, v long")
    one = spark.createDataFrame([(k, k * k) for k in range(200)], "x long, w long")
    assert sorted(spread_join(many, one, "x").collect()) == sorted(many.join(one, "x").collect())


def test_temporary_tables_go_and_need_a_shared_folder(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    df = jaccard.near_duplicates(rows(spark, mixed_texts()))
    left = set(folder.iterdir()) - before
    assert len(left) == 1 and df.count() > 0

    class Elsewhere:
        conf = {"spark.checkpoint.dir": None}
        sparkContext = type("C", (), {"master": "spark://somewhere"})  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_dir(Elsewhere())


def shuffled_bytes(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


def test_texts_that_neither_link_nor_go_are_not_dealt(spark, tmp_path):
    """Also where ids are too many to broadcast. Before, the stage dealt every text twice."""
    r = random.Random(7)
    texts = [" ".join(f"{r.getrandbits(32):08x}" for _ in range(5000)) for _ in range(200)]
    texts += [t + " more" for t in texts[:10]]
    rows(spark, texts).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = shuffled_bytes(spark)
        left = {x.doc_id for x in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()}
        sent = sum(v for k, v in shuffled_bytes(spark).items() if k not in old)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert left == set(range(0, 600, 3))
    assert 0 < sent < sum(map(len, texts))


def test_ids_that_may_be_among_others(spark):
    ids = spark.range(0, 30_000, 3).toDF("x")
    both = spark.range(-30_000, 30_000).select(F.col("id").alias("doc_id"), ((F.col("id") >= 0) & (F.col("id") % 3 == 0)).alias("there")).union(spark.createDataFrame([(None, False)], "doc_id long, there boolean"))
    told = both.select("there", common.MayBeAmong(ids).column(F.col("doc_id")).alias("may"))
    assert told.where("there and not may").count() == 0
    assert told.where("not there and may").count() < 0.04 * 50_000
    assert told.where("may is null").count() == 0
    assert both.where("there").where(common.MayBeAmong(ids, 1 << 12).column(F.col("doc_id"))).count() == 10_000
    assert both.where(common.MayBeAmong(ids.limit(0)).column(F.col("doc_id"))).count() == 0


def test_queries_inside_scratch_leave_no_shuffle_files(spark):
    def shuffle_files():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_")}

    before, was = shuffle_files(), spark.conf.get(common.SHUFFLES_GO, None)
    with common.scratch(spark):
        kept = [common.materialize(spark.range(1000).repartition(5, "id"), "some") for _ in range(3)]
        for _ in range(50):
            if not (left := shuffle_files() - before):
                break
            time.sleep(0.2)
        assert sum(x.count() for x in kept) == 3000
    assert not left
    assert spark.conf.get(common.SHUFFLES_GO, None) == was


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100)}


def brute_repeats(texts):
    seen: dict[bytes, int] = {}
    out = {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone, own = bytearray(len(b)), []
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
            else:
                own.append(b[p : p + 50])
        for w in own:
            seen.setdefault(w, i)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (len(b), [s for s, _ in runs], [e for _, e in runs], bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def repeats(df):
    return {r.doc_id: (r.n_bytes, r.starts, r.ends, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()}


@pytest.mark.parametrize("kind", ["words", "periodic", "driver"])
def test_repeats_equal_brute_force(spark, sf_dir, kind):
    if kind == "driver":
        df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    else:
        texts = mixed_texts(8)
        if kind == "periodic":
            texts += ["a" * n for n in (49, 50, 51, 120, 500)] + ["ab" * 100, "xab" + "ab" * 60, words(30, 3) + "é" * 40, "é" * 40]
        df = rows(spark, texts)
    got = repeats(df)
    assert got == brute_repeats({r.doc_id: r.text for r in df.select("doc_id", "text").collect()})
    assert sum(len(k) for *_, k in got.values()) < sum(n for n, *_ in got.values())


def test_digit_passes_group_equal_rows():
    r = np.random.default_rng(1)
    for t in range(60):
        x = r.integers(0, 2, (r.integers(0, 60), r.integers(1, 30))).astype(np.uint8)
        known = r.integers(0, 3, len(x)) if t % 2 else None
        number, first = suffixes.msd_groups(x, known)
        keys = [(0 if known is None else int(known[i]), bytes(x[i])) for i in range(len(x))]
        names = {k: i for i, k in enumerate(sorted(set(keys), key=lambda k: keys.index(k)))}
        assert len(first) == len(names) and [number[i] for i in first] == list(range(len(first)))
        assert all((number[i] == number[j]) == (keys[i] == keys[j]) for i in range(len(x)) for j in range(len(x)))


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    """With a hash that says nothing, windows are still found by their bytes."""
    r = np.random.default_rng(3)
    around = r.integers(0, 2, (40, suffixes.WIDTH)).astype(np.uint8) + 97
    around[20:] = around[:20]
    around[20:, :5] = 98
    least, side = np.arange(40), np.full(40, suffixes.SIDE)
    plain = suffixes._masks(least, side, side + suffixes.GRAM, around)
    monkeypatch.setattr(suffixes, "_BYTE", np.ones(256, np.uint64))
    assert suffixes._masks(least, side, side + suffixes.GRAM, around).tolist() == plain.tolist()
    assert plain[20:].all() and not plain[:20].any()


def test_repeats_bear_nothing_and_equal_ids(spark):
    df = rows(spark, mixed_texts())
    assert repeats(df.limit(0)) == {}
    twice = suffixes.remove_repeats(df.union(df)).groupBy("doc_id").count()
    assert twice.where("count != 2").count() == 0
    kept = hashlib.sha256(repeats(df)[0][3]).hexdigest()
    assert kept == hashlib.sha256(b"").hexdigest()
