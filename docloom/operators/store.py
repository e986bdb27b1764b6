"""A corpus store of versioned Parquet directories, and the set operations that keep it.

A version is written in full to a directory of its own, read back and validated, and then named in a
manifest of its own, which is written aside and renamed to a name that isn't there yet. Nothing current is
ever deleted or replaced: readers follow the newest manifest that can be read and whose version is whole, so a crash
at any point leaves the version before.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows, and stored ones whose key isn't among them."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def orphans(stored: DataFrame, produced: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored chunks (chunk_id, source_id) of the given sources that were not produced again.

    sources lists every source considered, those that now yield nothing too. A chunk without a source belongs
    to the one its id names, up to its version or index.
    """
    named = F.regexp_extract("chunk_id", r"^(.*?)(?:_(ch[0-9]+))?_([0-9]+)$", 1)
    owned = stored.withColumn("source_id", F.coalesce(F.nullif("source_id", F.lit("")), named))
    return owned.join(sources.where("source_id <> ''").select("source_id").distinct(), "source_id", "left_semi").join(produced.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")


def reconcile(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: how an index (id, hash) and chunks (id, hash) agree."""
    v = vectors.select("id", F.col("hash").alias("v_hash"), F.lit(True).alias("v"))
    c = chunks.select("id", F.col("hash").alias("c_hash"), F.lit(True).alias("c"))
    both = v.join(c, "id", "full_outer")
    blank = F.col("v_hash") == ""
    return both.agg(
        F.count_if("v").alias("vectors"),
        F.count_if("c").alias("chunks"),
        F.count_if(F.col("v") & F.col("c").isNull()).alias("orphan_vectors"),
        F.count_if(F.col("c") & F.col("v").isNull()).alias("without_vector"),
        F.count_if(F.col("v") & F.col("c") & ~blank & (F.col("v_hash") != F.col("c_hash"))).alias("mismatched"),
        F.count_if(F.col("v") & blank).alias("unknown_hash"),
        F.count_if(F.col("v") & F.col("c") & ~blank & (F.col("v_hash") == F.col("c_hash"))).alias("verified"),
    )


def health(counts: DataFrame) -> DataFrame:
    """Mode and status from reconcile's row."""
    mode = F.when(F.col("verified") == 0, "unavailable").when(F.col("verified") < F.col("chunks"), "partial").otherwise("full")
    return counts.select("*", mode.alias("dense_mode"), F.when(mode == "full", "healthy").otherwise("degraded").alias("status"))


def cache_split(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks (id, hash) with hit: the cache knows the same, non-blank hash."""
    c = cache.select("id", F.col("hash").alias("cached"))
    return chunks.join(c, "id", "left").select("id", F.coalesce((F.col("cached") != "") & (F.col("cached") == F.col("hash")), F.lit(False)).alias("hit"))


def upgraded(chunks: DataFrame) -> DataFrame:
    """Adds the columns an old table lacks, and fills blank content hashes from the texts."""
    for name in ("content_hash", "source_id", "accession_number", "attribution", "period_end"):
        if name not in chunks.columns:
            empty = F.lit("") if name in ("content_hash", "source_id", "attribution") else F.lit(None)
            chunks = chunks.withColumn(name, empty.cast("date" if name == "period_end" else "string"))
    known = F.nullif(F.col("content_hash"), F.lit(""))
    return chunks.withColumn("content_hash", F.coalesce(known, F.sha2(F.col("text"), 256)))


@dataclass
class Store:
    """Versions below a root folder on any file system that Spark reaches."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        """Numbers of the manifests that are there, newest first."""
        fs, at = self._fs(self.root)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        found = [re.fullmatch(r"manifest-([0-9]+)\.json", n) for n in names]
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def _whole(self, version: int | None) -> bool:
        fs, at = self._fs(f"{self.root}/v{version}/_SUCCESS")
        return version is not None and fs.exists(at)

    def manifest(self) -> dict | None:
        """The newest manifest that can be read and names a whole version, with its own number."""
        for number in self._numbers():
            try:
                found = json.loads(self.spark.read.text(f"{self.root}/manifest-{number}.json", wholetext=True).first()[0])
            except (ValueError, TypeError):
                continue  # cut off while it was written
            if self._whole(found.get("version")) or self._whole(found.get("previous")):
                return found | {"number": number}
        return None

    def read(self) -> DataFrame | None:
        """The current version; the previous one if its directory is gone."""
        m = self.manifest() or {}
        for version in (m.get("version"), m.get("previous")):
            if self._whole(version):
                return self.spark.read.parquet(f"{self.root}/v{version}")
        return None

    def _next(self) -> int:
        """A version that no directory has yet."""
        fs, at = self._fs(self.root)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max([-1, *(int(n[1:]) for n in names if re.fullmatch("v[0-9]+", n))]) + 1

    def publish(self, rows: DataFrame, key: str, partition_by: list[str] | None = None) -> int:
        """Writes the next version, validates it by its count of rows and keys, and makes it current."""
        m = self.manifest() or {"version": None, "previous": None}
        version = self._next()
        path = f"{self.root}/v{version}"
        rows.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
        back = self.spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).first()
        if back["n"] != back["keys"]:
            raise ValueError(f"{key} repeats: {back['n']} rows, {back['keys']} keys; version {m['version']} stays current")
        self._swap({"version": version, "previous": m["version"], "rows": back["n"]})
        # Manifests but the newest two, and versions that neither of these names, are of no more use.
        for number in self._numbers()[2:]:
            fs, at = self._fs(f"{self.root}/manifest-{number}.json")
            fs.delete(at, False)
        for old in range(version):
            if old != m["version"]:
                fs, at = self._fs(f"{self.root}/v{old}")
                fs.delete(at, True)
        return version

    def rollback(self) -> int:
        m = self.manifest()
        if not m or m["previous"] is None:
            raise ValueError("there is no previous version")
        self._swap({"version": m["previous"], "previous": None, "rows": None})
        return m["previous"]

    def _swap(self, manifest: dict) -> None:
        number = max([-1, *self._numbers()]) + 1
        fs, new = self._fs(f"{self.root}/manifest.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, at = self._fs(f"{self.root}/manifest-{number}.json")
        if not fs.rename(new, at):
            raise RuntimeError(f"manifest {number} is there already: another writer published first")
