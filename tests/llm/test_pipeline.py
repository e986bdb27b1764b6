from __future__ import annotations

from pathlib import Path

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from docloom.llm import mixing, pii, toxicity
from docloom.llm.common import fresh_path, shared_dir
from tests.llm.cases import mixed_texts, write_tables
from tests.llm.test_duplicates import brute_components
from tests.llm.test_native import brute_mix


def test_each_stage_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "personal_data", "mixing", "pieces"]
    inputs, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = now
        path = fresh_path(spark, f"test-{name}")
        stage(spark, now, sf_dir).write.parquet(path)
        now = spark.read.parquet(path)
        if name != "pieces":
            assert now.columns == docs.columns
    inputs["end"] = now
    plain = {k: [(r.doc_id, r.text, r.lang, r.source) for r in v.collect()] for k, v in inputs.items() if k != "end"}

    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {i for i, *_ in plain["near_duplicates"]} == {i for i, t, *_ in plain["toxicity"] if model.score(t) < 0.5}
    groups = brute_components({i: t for i, t, *_ in plain["near_duplicates"]})
    assert {i for i, *_ in plain["personal_data"]} == {i for i, (_, c) in groups.items() if c == i}
    assert {i for i, *_ in plain["mixing"]} == {i for i, *_ in plain["personal_data"]}
    assert pii.find_spans(inputs["mixing"]).where(F.col("kind").isNotNull()).count() == 0
    assert {i for i, *_ in plain["pieces"]} == {i for i, *_ in brute_mix(plain["mixing"], corpus_pipeline.MIX)}
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.ids for r in inputs["end"].collect()} == {i: m.encode(t or "", add_eos=True) for i, t, *_ in plain["pieces"]}


def test_entry_registers_every_operator():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2:3].isdigit()} == set(range(1, 11))
    assert corpus_pipeline.MIX.epochs == 1 and isinstance(corpus_pipeline.MIX, mixing.Mix)


def test_stages_bear_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeats, rows without an id and clashing columns; and no rows at all."""
    folder = write_tables(spark, str(tmp_path / "odd"), mixed_texts())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.union(docs.where("doc_id % 4 = 0")).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for some in (docs, docs.limit(0)):
        n = some.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, folder)
            if name == "pieces":
                assert out.count() == n
            else:
                assert out.columns == some.columns
                rows_out = out.count()
                assert rows_out == n if name == "personal_data" else rows_out <= n
            if name == "near_duplicates":
                assert out.where("doc_id is null").count() == some.where("doc_id is null").count()


def test_run_leaves_only_its_result(spark, sf_dir):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(set(folder.iterdir()) - before) == 1
