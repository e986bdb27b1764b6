from __future__ import annotations

import hashlib
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import media, queries
from docloom.llm.common import fresh_path
from tests.llm.cases import mixed_texts, rows


def test_png_round_trip():
    for text in ("", "a", "é" * 700, "x" * 576):
        n, payload = media.payload_of(text)
        assert len(payload) % 576 == 0 and payload[:n] == text.encode() and set(payload[n:]) <= {255}
        image = media.to_png(payload)
        assert media.from_png(image) == payload
        assert media.png_header(image[:33])[:2] == (576, len(payload) // 576)


def test_media_rows_equal_the_contract(spark):
    df = rows(spark, mixed_texts())
    got = {r.doc_id: r for r in media.media_table(df).collect()}
    for r in df.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes) == (len(raw), len(payload))
        assert g.payload_sha256 == g.digest == hashlib.sha256(payload).hexdigest()
        assert g.tail_crc32 == zlib.crc32(payload[-32:])
        image = media.to_png(payload)
        assert (g.media_bytes, g.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert g.width * g.height == len(payload)
    empty = [got[r.doc_id] for r in df.collect() if not r.text]
    assert len({(g.shard, g.offset) for g in empty}) == 1
    assert media.media_table(df.limit(0)).count() == 0


def test_shards_are_tar_files(spark):
    folder = fresh_path(spark, "test-media")
    packed = media.pack(rows(spark, mixed_texts()).coalesce(1), folder).collect()
    with tarfile.open(packed[0].shard.removeprefix("file://")) as tar:
        members = {m.name: m for m in tar.getmembers()}
    assert {f"{p.digest}.png": p.offset for p in packed} == {k: m.offset_data for k, m in members.items()}


def test_query_equals_brute_force(spark, sf_dir):
    plain = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    df = queries.op1_media(spark, sf_dir)
    assert df.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = df.collect()
    assert sorted(r.doc_id for r in got) == sorted(plain)
    for r in got:
        n, payload = media.payload_of(plain[r.doc_id].decode())
        image = media.to_png(payload)
        assert tuple(r)[1:8] == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.feature_of(payload))


def test_rows_without_an_id_keep_their_payload(spark):
    df = rows(spark, ["a", None, "b" * 2000]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.n_bytes for r in media.media_table(df).collect()) == [0, 1, 2000]


def test_schemes_of_paths():
    assert media._opened("/tmp/x.tar")[1] == "/tmp/x.tar"
    assert media._opened("file:/tmp/x.tar")[1] == media._opened("file:///tmp/x.tar")[1] == "/tmp/x.tar"
    with pytest.raises(Exception, match="nosuch"):
        media._opened("nosuch://a/b")
