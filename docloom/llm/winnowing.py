"""Document fingerprints: winnowing over k-grams of words, with positions.

Every k words in a row give a hash. Of each w hashes in a row the least is chosen, the rightmost of equals;
a fingerprint is the chosen hashes with their positions. So any run of w + k - 1 words that two texts share
puts a common hash into both fingerprints, and no choice depends on anything outside its window.

Only DataFrame functions. Hashes of k-grams are built up from those of shorter ones at the same place: two words
from two single ones, four from two pairs, five from four and one, and so on, each array worked out once; so a
k-gram costs about log k steps, whatever k is. (Taking one word out and one in, from left to right, has no array
form but one that copies the array at each step.) A hash is whole 64 bits, a place a whole number; windows'
minima are taken over (hash, -place), so that plain minima choose the rightmost of equals.

Words are runs of bytes other than blanks (0x20, 0x09 to 0x0D). A text with fewer than k words is one k-gram of
all of them; fewer than w k-grams are one window; a text without words has an empty fingerprint. Nulls are
empty texts; a text of any length is one row; rows without an id are left out of the comparison with the next
document; equal texts have equal fingerprints; rows that repeat an id follow one another in order of their texts'
md5; an empty table gives an empty table; columns other than id and text are not used, and fingerprint() keeps
a caller's columns whatever they are named, but for out.

Rows are dealt to ranges of doc_id, as many as rows_a_bucket asks for and MOST_BUCKETS at most, and ranges to
as many tasks as the texts' bytes ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
W = 8
ROWS_A_BUCKET = 500
MOST_BUCKETS = 1 << 20
TASK_BYTES = 16 << 20
TOPS = 64
PRINTS = "array<struct<hash:bigint,back:int>>"


def _free(df: DataFrame, name: str) -> str:
    """name, or one like it that df has no column of."""
    return name if name.lower() not in {c.lower() for c in df.columns} else _free(df, f"{name}_")


def _joined(df: DataFrame, out: str, left: str, right: str, shift: int) -> DataFrame:
    """Adds out: hashes of left's gram at each place and right's gram shift words later, where both are there."""
    both = F.zip_with(left, F.slice(right, shift + 1, 1 << 30), lambda a, b: F.xxhash64(a, b))
    return df.withColumn(out, F.slice(both, 1, F.greatest(F.size(right) - shift, F.lit(0))))


def gram_hashes(df: DataFrame, words: str, out: str, k: int) -> DataFrame:
    """Adds out: from word hashes, 64-bit hashes of each k words in a row, by doubling; of fewer than k words one hash of all."""
    names, width = {1: words}, 1
    while 2 * width <= k:
        names[2 * width] = _free(df, f"{out}{2 * width}")
        df = _joined(df, names[2 * width], names[width], names[width], width)
        width *= 2
    at, have = names[width], width
    while have < k:
        more = max(n for n in names if n <= k - have)
        to = _free(df, f"{out}_{have + more}")
        df, at, have = _joined(df, to, at, names[more], have), to, have + more
    n = F.size(words)
    all_ = F.when(n >= k, F.col(at)).when(n > 0, F.array(F.xxhash64(F.col(words)))).otherwise(F.array().cast("array<bigint>"))
    made = [c for c in df.columns if c.startswith(out) and c != words]
    return df.withColumn(out, all_).drop(*(c for c in made if c != out))


def fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds out, the array of chosen grams (hash, back), back being minus the place, each once, in order of place.

    w must be a power of two. Intermediate arrays are columns of their own, each evaluated once.
    """
    if w & (w - 1):
        raise ValueError("w must be a power of two")
    words, grams, least = (_free(df, x) for x in ("_winnow_w", "_winnow_g", "_winnow_m"))
    t = df.withColumn(words, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda x: x != ""))
    t = gram_hashes(t.withColumn(words, F.transform(words, lambda x: F.xxhash64(x))), words, grams, k)
    t = t.withColumn(grams, F.transform(grams, lambda h, i: F.struct(h.alias("hash"), (-i).cast("int").alias("back"))))
    t = t.withColumn(least, F.col(grams))
    width = 1
    while width < w:
        t = t.withColumn(least, F.zip_with(least, F.slice(least, width + 1, 1 << 30), lambda a, b: F.least(a, b)))
        width *= 2
    n = F.size(grams)
    chosen = F.when(n >= w, F.slice(least, 1, F.greatest(n - (w - 1), F.lit(0)))).when(n > 0, F.array(F.array_min(grams))).otherwise(F.array().cast(PRINTS))
    # Windows in a row choose the same gram in a row, so a choice is new where its place isn't the one before.
    t = t.withColumn(least, chosen.cast(PRINTS))
    again = lambda i: F.coalesce(F.get(F.col(least), i - 1)["back"], F.lit(1))
    return t.withColumn(out, F.filter(least, lambda x, i: x["back"] != again(i))).drop(words, grams, least)


def hashes(prints: str | Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: p["hash"]))


def written(prints: str | Column) -> Column:
    """place:hash pairs, hashes in hexadecimal."""
    return F.array_join(F.transform(prints, lambda p: F.concat_ws(":", -p["back"], F.lower(F.hex(p["hash"])))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _tree(column: str, cuts: list[int], lo: int, hi: int) -> Column:
    """How many of cuts[lo:hi] are at or below a value, plus lo: a binary tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col(column) < cuts[mid], _tree(column, cuts, lo, mid)).otherwise(_tree(column, cuts, mid + 1, hi))


def _ranges(ids: DataFrame, rows_a_bucket: int) -> tuple[Column, Column]:
    """A number that grows with doc_id: a quantile's range, and an even part of that range."""
    n, low, high = ids.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = int(min(MOST_BUCKETS, max(1, n // rows_a_bucket)))
    tops = min(TOPS, wanted)
    if tops == 1:
        return F.lit(0), F.lit(0)
    found = ids.agg(F.percentile_approx("doc_id", [i / tops for i in range(1, tops)], 10 * tops)).first()[0]
    cuts = sorted({c for c in found if c > low})
    edges, fine = [low, *cuts, high + 1], max(1, wanted // tops)
    at = lambda some: F.get(F.array(*[F.lit(float(e)) for e in some]), F.col("_top"))
    part = F.floor((F.col("doc_id").cast("double") - at(edges[:-1])) / (at(edges[1:]) - at(edges[:-1])) * fine).cast("int")
    return _tree("doc_id", cuts, 0, len(cuts)), F.col("_top") * fine + F.greatest(F.lit(0), F.least(part, F.lit(fine - 1)))


def in_ranges(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """The rows with _bucket, which counts ranges of doc_id downwards; and once more, as _ghost, each range's first row in the range before.

    Only the ranges' largest ids are broadcast and ordered in one task: MOST_BUCKETS at most.
    """
    top, bucket = _ranges(docs.select("doc_id"), rows_a_bucket)
    number = lambda df: df.withColumn("_top", top).withColumn("_bucket", -bucket).drop("_top")
    heads = number(docs.select("doc_id")).groupBy("_bucket").agg(F.max("doc_id").alias("doc_id"))
    order = Window.orderBy("_bucket")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("doc_id", F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(around)).alias("_bucket"))
    ghosts = docs.join(F.broadcast(heads), "doc_id").withColumn("_ghost", F.lit(True))
    return number(docs).withColumn("_ghost", F.lit(False)).unionByName(ghosts)


def with_next(ranged: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: the next row's values in descending order of doc_id, the first row's after the last."""
    down = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc(), "_tie")
    nexts = [F.lead(c).over(down).alias(f"next_{c}") for c in columns]
    return ranged.select("*", *nexts).where(~F.col("_ghost")).drop("_bucket", "_ghost")


def edited_text(text: str, following: str) -> Column:
    """The last third of the code points gives way to as many first ones (or all) of the next document."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - third), F.substring(F.col(following), F.lit(1), third))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """(doc_id, text, fingerprint, edited, edited_fingerprint, near_edited, near_next), fingerprints as arrays of (hash, back)."""
    t = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    # Dealt by range before the fingerprints are made: only texts are shuffled, and the window finds them dealt.
    t = fingerprint(in_ranges(t, rows_a_bucket).repartition(tasks, "_bucket"), "text", "fingerprint").withColumn("_tie", F.md5(F.col("text").cast("binary")))
    t = with_next(t, ["text", "fingerprint"])
    t = t.withColumn("edited", edited_text("text", "next_text")).drop("next_text", "_tie")
    t = fingerprint(t, "edited", "edited_fingerprint")
    for name, column in (("_own", "fingerprint"), ("_edited", "edited_fingerprint"), ("_next", "next_fingerprint")):
        t = t.withColumn(name, hashes(column))
    t = t.withColumn("near_edited", likeness("_own", "_edited")).withColumn("near_next", likeness("_own", "_next"))
    return t.drop("_own", "_edited", "_next", "next_fingerprint")
