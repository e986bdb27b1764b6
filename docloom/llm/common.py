"""What the operators of this subpackage share: inputs, shared storage, identities of rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 32 << 20
MOST_BITS = 1 << 26
#: Whether Spark deletes a query's shuffle files when it ends, rather than when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Fixed value: the C library's name for the size from which memory is mapped apart.
M_MMAP_THRESHOLD = -3

_written: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new place below the shared folder; it is deleted by drop(), at the end of its scratch(), or when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if (spark, path) in _written:
        _written.remove((spark, path))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Drops, at its end, what was written to fresh places inside, but for the tables that the given function writes.

    What leaves the block must read nothing else that was written in it. Queries that run inside leave no shuffle files, so
    that disk holds those of one query at a time; where Spark lacks that setting, they go with the driver's garbage.
    """
    before, shuffles = list(_written), spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    kept: list[str] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        made, path = written(df, what)
        kept.append(path)
        return made

    try:
        yield keep
    finally:
        if shuffles is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, shuffles)
    for _, path in [x for x in _written if x not in before and x[1] not in kept]:
        drop(spark, path)


def _drop_all() -> None:
    for spark, path in list(_written):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it: lineage ends there, and losing executors loses nothing. And its place."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, what: str) -> DataFrame:
    return written(df, what)[0]


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts go to Python in batches of at most so many rows and about BATCH_BYTES, unless the session asks for fewer.

    Spark reads these settings when a plan is made ready to run, so they stay set.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = "".join(c for c in str(spark.conf.get(key)) if c.isdigit())
        if not 0 < int(now or 0) <= most:
            spark.conf.set(key, str(most))


#: What operators keep in a Python worker from task to task, such as tables of chunks.
worker_caches: list[dict] = []


def lean_memory() -> None:
    """In a Python worker: what earlier operators kept there goes, and freed memory goes back to the system, at once and, for
    arrays of a megabyte and more, from then on, where the C library can be told so."""
    import ctypes

    import pyarrow as pa

    for kept in worker_caches:
        kept.clear()
    try:
        ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, 1 << 20)
    except (AttributeError, OSError):
        pass  # another C library
    give_back()
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Memory that this process has freed, after fitting a model for instance, goes back to the system, where the C library can be told so."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def spread_join(many: DataFrame, one: DataFrame, on: str, salts: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    """many.join(one, on), where one has a row for each key and many may have a third of its rows under one.

    Rows of many are dealt by key and salt, a hash of the columns by (all by default); a key's row goes only to the
    salts that it has, salts at most. many is worked out twice, so it should be a written table or cheap.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*(by or many.columns)), F.lit(salts)))
    places = salted.select(on, "_salt").distinct().join(one, on)
    return salted.join(places, [on, "_salt"]).drop("_salt")


class MayBeAmong:
    """For a table of one column of ids, what tells whether an id may be there: True for all that are, and for about one of 50 others.

    Rows that can't join with the table then needn't be dealt for it; an exact join of the others must follow. Two hashes of an
    id set 16 to 32 bits for each id of the table, most_bits (8 MB) at most: with more ids more others pass, and no row is lost.
    """

    def __init__(self, ids: DataFrame, most_bits: int = MOST_BITS) -> None:
        self.bits = min(most_bits, max(1 << 12, 1 << (16 * ids.count()).bit_length()))
        at = ids.select(F.explode(F.array(*self.places(F.col(ids.columns[0])))).alias("at"))
        found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
        self.held = np.zeros(self.bits >> 6, np.int64)
        self.held[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    def places(self, doc_id: Column) -> list[Column]:
        h = F.xxhash64(doc_id.cast("long"))
        return [h.bitwiseAND(F.lit(self.bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(self.bits - 1))]

    def column(self, doc_id: Column) -> Column:
        import pyarrow as pa

        tell = self.test()

        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            lean_memory()
            for one, two in batches:
                yield tell(one, two)

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "boolean")(*self.places(doc_id))

    def test(self) -> Callable:
        """For use in Python workers: of the two columns of places, which ids may be there."""
        held = self.held

        def tell(one, two):  # noqa: ANN001, ANN202  arrays of pyarrow
            import pyarrow as pa

            return pa.array(np.logical_and(*((held[x >> 6] >> (x & 63) & 1) == 1 for x in (one.to_numpy(), two.to_numpy()))), pa.bool_())

        return tell


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
