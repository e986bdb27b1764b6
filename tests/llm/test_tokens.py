from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import chunks, pieces, queries, token_files
from docloom.llm.common import fresh_path
from tests.llm.cases import mixed_texts, rows, thue_morse, write_tables

ALPHABET = " ▁\n\tab.,é😀ñ12 　ß中文́\x00<s>''SsJ̌AEÉİΣ.!|×÷-"
PIECES, WORDS = (public_tokenizers.path(f) for f in ("piece_bpe_32k.model", "word_bpe_49k.json"))


def odd_texts(n=3000):
    r = random.Random(11)
    some = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]
    return [*some, "", " ", "  a  b ", "x" * 3000, "it's 's 'sword don't", "<|endoftext|> a<|endoftext|>b", "É É. ÉCOLE", "a.́b"]


@pytest.mark.parametrize("most", [10, 900_000])
def test_chunk_tables_equal_the_libraries(most):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = Tokenizer.from_file(WORDS)
    texts = odd_texts()
    for segmenter, reference in (
        (chunks.PieceSegmenter(open(PIECES, "rb").read()), m.encode(texts)),
        (chunks.WordSegmenter(open(WORDS).read()), [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]),
    ):
        table = chunks.ChunkTable(segmenter, most)
        ids, offsets = table.encode([x.encode() for x in texts])
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == reference


def test_pieces_round_trip_through_spark(spark):
    texts = mixed_texts()
    df = rows(spark, texts)
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = pieces.read_model(PIECES)
    got = {r.doc_id: (r.ids, r.decoded) for r in pieces.decode(pieces.encode(df, model), model).collect()}
    for r in df.collect():
        ids = m.encode(r.text or "", add_eos=True)
        assert got[r.doc_id] == (ids, m.decode(ids))
    assert pieces.encode(df.limit(0), model).count() == 0


def test_token_files_hold_ids_in_order(spark):
    texts = mixed_texts()
    df = rows(spark, texts)
    path = fresh_path(spark, "test-tokens")
    token_files.write(df, path, "word", pieces.read_model(WORDS), end_id=1, row_group=1 << 20)
    back = token_files.with_starts(token_files.checksums(token_files.read(spark, path)))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in back.collect()}
    t, start = Tokenizer.from_file(WORDS), 0
    for r in df.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = fresh_path(spark, "none")
    token_files.write(df.limit(0), path, "word", pieces.read_model(WORDS), end_id=1)
    assert token_files.with_starts(token_files.checksums(token_files.read(spark, path))).count() == 0


def test_token_files_delta_encoding(spark):
    df = rows(spark, mixed_texts())
    path = fresh_path(spark, "test-delta")
    token_files.write(df, path, "word", pieces.read_model(WORDS), end_id=1, dictionary=False)
    t = Tokenizer.from_file(WORDS)
    assert {r.doc_id: r.ids for r in token_files.read(spark, path).collect()} == {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in df.collect()}
    column = pq.ParquetFile(next(Path(path.removeprefix("file://")).glob("*.parquet"))).metadata.row_group(0).column(2)
    assert column.path_in_schema.startswith("ids") and "DELTA_BINARY_PACKED" in column.encodings


def scanned(df):
    """Rows that the scans of a finished query put out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))


def test_a_few_documents_are_read_by_page(spark):
    """Of 6000 documents in a row group of many pages, a read of two takes their pages alone; one of metadata leaves tokens be."""
    texts = [f"word{k} and some more of them {k * 7919}" * 4 for k in range(6000)]
    path = fresh_path(spark, "test-pages")
    token_files.write(rows(spark, texts, step=1).coalesce(1), path, "word", pieces.read_model(WORDS), end_id=1, page=4096)
    df = token_files.read_some(spark, path, [17, 4711])
    t = Tokenizer.from_file(WORDS)
    assert {r.doc_id: r.ids for r in df.collect()} == {k: [*t.encode(texts[k], add_special_tokens=False).ids, 1] for k in (17, 4711)}
    assert 2 <= scanned(df) < 3000
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_queries_equal_the_libraries(spark, sf_dir, tmp_path):
    """Columns of both queries against the libraries, on the driver's documents and on words that structured hashes confuse."""
    hard = [x for n in (512, 1024, 2048) for w in thue_morse(n) for x in (w, f"p {w} s", f"P {w.upper()}. {w}")]
    made = write_tables(spark, str(tmp_path / "hard"), [*hard, *mixed_texts()])
    m, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
    for folder in (sf_dir, made):
        plain = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
        got = {r.doc_id: tuple(r)[1:] for r in queries.op8_sentencepiece(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
        starts = {r.doc_id: tuple(r)[1:] for r in queries.op7_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
        assert len(got) == len(starts) == len(plain)
        start = 0
        for i, text in plain:
            ids = m.encode(text, add_eos=True)
            digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
            assert got[i] == (len(ids), digest(" ".join(map(str, ids))), digest(m.decode(ids)))
            ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
            assert starts[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)


def test_words_of_equal_hash_are_told_apart():
    words = [w for n in (1024, 2048) for w in thue_morse(n)]
    table = chunks.ChunkTable(chunks.PieceSegmenter(pieces.read_model(PIECES)))
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for some in (words, words[::-1], [" ".join(words)] * 2):
        ids, offsets = table.encode([w.encode() for w in some])
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == m.encode(some)
    assert table.others


def test_rows_without_an_id_are_encoded(spark):
    df = rows(spark, ["a b", None, "c"]).withColumn("doc_id", F.lit(None).cast("long"))
    model = pieces.read_model(PIECES)
    assert sorted(len(r.ids) for r in pieces.encode(df, model).collect())[0] == 1
    path = fresh_path(spark, "test-nameless")
    token_files.write(df, path, "word", pieces.read_model(WORDS), end_id=1)
    assert token_files.read(spark, path).count() == 3
