"""N-gram Jaccard join: sets of word shingles, links at 100 * intersection >= 75 * union, their components.

Adaptive multi-match prefixes. A set's tokens are ordered by hash. Two linked sets share at least L of the
first size - ceil(0.75 * size) + L tokens of each, for any L; a document's L grows with the candidates that
its prefix would meet, estimated from counts of all documents' tokens by 2^16 cells. Documents that share
fewer prefix tokens with others than the smallest L of any partner are done with. The rest, mostly copies,
meet in two rounds: first each is compared with the least document of its tokens; then only documents of
different components that still share a token are compared, where lengths and a parity bitmap (a lower
bound of the symmetric difference) allow a link at all and enough prefix tokens are shared. Every candidate
is verified on whole sets; no link that could join two components is left out, and no pairs are listed
within components.

No task gathers a hot group: joins with a centre, a class or a component spread its rows by salt, and
tokens of cells that are far above the mean (counted first) are compared in jobs of two parts of their
documents each, dealt by the documents' hashes.

Documents of equal sets are one class from the start, represented by the smallest id. Null texts, empty ones
and those without words have no shingles and link with nothing; rows without an id are left out; a text of
any length is one row and is hashed in blocks; rows that repeat an id are one document, the one of their
smallest (number of shingles, signatures, md5), chosen before anything is dealt; ties of sizes or hashes
are broken by id; an empty table gives an empty table; columns other than id and text are not used. Shingles
count as equal if their 64-bit hashes are (see shingles), so n distinct shingles in all documents make a
wrong match with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import MayBeAmong, bounded_batches, lean_memory, materialize, scratch, spread_join
from docloom.llm.components import components
from docloom.llm.shingles import mix, shingle_sets, slices

CELLS = 1 << 16
BITS = 1024
ENTRIES_A_BUCKET = 1_000_000
PART_ENTRIES = 4000


def need(n: np.ndarray) -> np.ndarray:
    """The least intersection that a linked set of this size has: ceil(0.75 n)."""
    return -(-3 * n // 4)


def least_l(n: np.ndarray) -> np.ndarray:
    return 1 + n // 5


def chosen_l(keys: np.ndarray, offsets: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """L of each set: longer where over a tenth of the plain prefix lies in cells far above the mean."""
    n = np.diff(offsets)
    rank = np.arange(len(keys)) - np.repeat(offsets[:-1], n)
    plain = n - need(n) + 1
    met = heavy[(keys >> np.uint64(48)).astype(np.int64)] & (rank < np.repeat(plain, n))
    costly = np.add.reduceat(np.append(met, False).astype(np.int64), np.minimum(offsets[:-1], len(keys))) if len(n) else n
    costly = np.where(n > 0, costly, 0)
    return np.where(10 * costly > plain, 1 + n // 3, least_l(n))


def _prefix(keys: np.ndarray, offsets: np.ndarray, extra: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    rank = np.arange(len(keys)) - np.repeat(offsets[:-1], n)
    return rank < np.repeat(np.minimum(n, n - need(n) + extra), n)


def _text_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def one_row_an_id(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (doc_id, text) without those of a repeated id that aren't its chosen one; repeats of the same text may stay.

    Only if ids repeat with different texts are rows joined with their choices at all.
    """
    choice = facts.groupBy("doc_id").agg(F.min(F.struct("n", "sig_a", "sig_b", "mark"))["mark"].alias("mark"), F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    chosen = choice.where("lo < hi").select("doc_id", "mark")
    if chosen.isEmpty():
        return rows
    return rows.join(chosen, "doc_id", "left").where(F.col("mark").isNull() | (F.col("mark") == F.md5("text"))).select("doc_id", "text")


def sizes_and_counts(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, sig_a, sig_b, mark) of every row (doc_id, text), and how many tokens of all rows fall in each cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            ids, texts, marks = b.column(0), b.column(1).to_pylist(), b.column(2)
            for s, e in slices(texts):
                keys, offsets = shingle_sets(texts[s:e])
                counts += np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=CELLS)
                totals = [np.append(np.uint64(0), np.cumsum(x))[offsets] for x in (keys, mix(keys + np.uint64(1)))]
                one, two = ((t[1:] - t[:-1]).view(np.int64) for t in totals)
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), pa.array(np.diff(offsets)), pa.array(one), pa.array(two), marks.slice(s, e - s), pa.nulls(e - s, pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.string()), pa.array([counts.tobytes()], pa.binary())], names=names)

    names = ["doc_id", "n", "sig_a", "sig_b", "mark", "counts"]
    marked = rows.select("doc_id", "text", F.md5("text").alias("mark"))
    both = materialize(marked.mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, mark string, counts binary"), "shingle-facts")
    return both.where("counts is null").drop("counts"), _summed(both.where("counts is not null").select("counts"))


def _summed(blobs: DataFrame) -> np.ndarray:
    """Counts by cell, added up in each partition and then by cell: CELLS rows come to the driver, however many partitions there are."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(total)], names=["cell", "n"])

    return _by_cell(blobs.mapInArrow(add, "cell long, n long"))


def _by_cell(counts: DataFrame) -> np.ndarray:
    out = np.zeros(CELLS, np.int64)
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return out


def _packed(tokens: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Entries dealt to buckets by leading bits: tokens' next 40 bits and ids as offsets from the least.

    Prefixes hold small hashes; mixed again they fill all buckets evenly.
    """
    tokens = mix(tokens)
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    tokens, docs, bucket = tokens[order], docs[order], bucket[order]
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        s, e = edge[k], edge[k + 1]
        base = docs[s:e].min()
        off = docs[s:e] - base
        wide = off.max() >= 1 << 32
        t = tokens[s:e]
        yield k, b"".join([np.array([base, e - s, wide]).tobytes(), (t >> np.uint64(8)).astype(np.uint32).tobytes(), t.astype(np.uint8).tobytes(), off.astype(np.int64 if wide else np.uint32).tobytes()])


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    tokens, docs = [], []
    for x in blobs:
        base, n, wide = np.frombuffer(x, np.int64, 3).tolist()
        high, low = np.frombuffer(x, np.uint32, n, 24), np.frombuffer(x, np.uint8, n, 24 + 4 * n)
        tokens.append(high.astype(np.uint64) << np.uint64(8) | low)
        docs.append(np.frombuffer(x, np.int64 if wide else np.uint32, n, 24 + 5 * n).astype(np.int64) + base)
    return np.concatenate(tokens), np.concatenate(docs)


def _grouped(tokens: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of token and document, each once, of tokens of two documents at least; and where tokens begin."""
    order = np.lexsort((docs, tokens))
    tokens, docs = tokens[order], docs[order]
    once = np.ones(len(tokens), bool)
    once[1:] = (tokens[1:] != tokens[:-1]) | (docs[1:] != docs[:-1])
    tokens, docs = tokens[once], docs[once]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    size = np.diff(np.append(first, len(tokens)))
    keep = np.repeat(size > 1, size)
    tokens, docs = tokens[keep], docs[keep]
    return tokens, docs, np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)


def _pair_counts(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    return [pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(np.append(first, len(a))))]


def shared_prefixes(rows: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """(doc, center, shared): prefix tokens that doc shares with others, by the least document of each token."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            found = []
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for s, e in slices(texts):
                keys, offsets = shingle_sets(texts[s:e])
                take = _prefix(keys, offsets, chosen_l(keys, offsets, heavy))
                found.append((keys[take], np.repeat(ids[s:e], np.diff(offsets))[take]))
            tokens, owner = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for k, blob in _packed(tokens, owner, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([blob], pa.binary())], names=["bucket", "blob"])

    def stars(table: pa.Table) -> pa.Table:
        lean_memory()
        tokens, docs, first = _grouped(*_unpacked(table.column("blob").to_pylist()))
        size = np.diff(np.append(first, len(tokens)))
        return pa.Table.from_arrays(_pair_counts(docs, np.repeat(docs[first], size)), names=["doc", "center", "shared"])

    dealt = rows.mapInArrow(deal, "bucket long, blob binary")
    return dealt.groupBy("bucket").applyInArrow(stars, "doc long, center long, shared long")


def verified(pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b, keys_a, keys_b) that link, by their whole sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            hold = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                hold.append(100 * both >= 75 * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hold, pa.bool_())), b.column(1).filter(pa.array(hold, pa.bool_()))], names=["a", "b"])

    return pairs.select("a", "b", "keys_a", "keys_b").mapInArrow(run, "a long, b long")


def _parity(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    np.bitwise_xor.at(bits, (keys & np.uint64(BITS - 1)).astype(np.int64), 1)
    return np.packbits(bits)


def leftover_docs(by_class: DataFrame, component: DataFrame) -> DataFrame:
    """(doc, mixed) from (doc, a, shared): a bound of the prefix tokens that doc shares with any document of another component.

    Documents that share a token have the same centre for it, so two of them share at most the sum over
    centres of the lesser of their counts; for a centre the greatest count outside doc's component stands in.
    """
    t = materialize(by_class.join(component, "doc"), "by-component")
    most = materialize(t.groupBy("a", "component").agg(F.max("shared").alias("m")), "most-shared")
    first = most.groupBy("a").agg(F.max(F.struct("m", "component")).alias("top"))
    second = spread_join(most, first, "a").where(F.col("component") != F.col("top.component")).groupBy("a").agg(F.max("m").alias("next"))
    outside = first.join(second, "a").select("a", "top", "next")
    other = F.when(F.col("top.component") == F.col("component"), F.col("next")).otherwise(F.col("top.m"))
    return spread_join(t, outside, "a").groupBy("doc").agg(F.sum(F.least("shared", other)).alias("mixed"))


def _prefix_entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    sets = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    offsets = np.append(0, np.cumsum(n))
    keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    take = _prefix(keys, offsets, b.column(3).to_numpy())
    return keys[take], np.repeat(np.arange(len(n)), n)[take]


def _rows_of_buckets(tokens: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (((mix(tokens) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        yield k, order[edge[k] : edge[k + 1]]


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


def _side(docs: np.ndarray, parts: int) -> np.ndarray:
    return (mix(docs.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def cell_parts(sets: DataFrame) -> np.ndarray:
    """Into how many parts each cell's documents are dealt: one, but for cells of more than PART_ENTRIES and four times the mean.

    A task has one Python worker here as elsewhere: second ones would stay, and keep what later operators remember once more.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            counts += np.bincount(_cell(_prefix_entries(b)[0]), minlength=CELLS)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(counts)], names=["cell", "n"])

    counts = _by_cell(sets.select("doc", "component", "keys", "l").mapInArrow(run, "cell long, n long"))
    return np.maximum(1, -(-counts // int(max(PART_ENTRIES, 4 * counts.mean())))).astype(np.int32)


def leftover_pairs(sets: DataFrame, buckets: int) -> DataFrame:
    """(a, b) of different components that share min(l) prefix tokens and may link by length and parity."""
    parts = cell_parts(sets)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            tokens, rows = _prefix_entries(b)
            facts = np.zeros(b.num_rows, FACTS)
            facts["doc"], facts["comp"], facts["l"] = (b.column(i).to_numpy() for i in (0, 1, 3))
            for i, x in enumerate(b.column(2).to_pylist()):
                keys = np.frombuffer(x, np.uint64)
                facts["n"][i], facts["parity"][i] = len(keys), _parity(keys)
            cell = _cell(tokens)
            light = np.flatnonzero(parts[cell] == 1)
            for k, at in _rows_of_buckets(tokens[light], buckets):
                yield send(k, 1, 0, 0, tokens, rows, facts, light[at])
            heavy = np.flatnonzero(parts[cell] > 1)
            for c in np.unique(cell[heavy]).tolist():
                own, n = heavy[cell[heavy] == c], int(parts[c])
                side = _side(facts["doc"][rows[own]], n)
                for i in np.unique(side).tolist():
                    for j in range(n):
                        lo, hi = min(i, j), max(i, j)
                        yield send(buckets + (c << 40) + lo * n + hi, n, lo, hi, tokens, rows, facts, own[side == i])

    def send(key: int, n: int, i: int, j: int, tokens: np.ndarray, rows: np.ndarray, facts: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        own, back = np.unique(rows[at], return_inverse=True)
        numbers = [pa.array([x], pa.int64()) for x in (key, n, i, j)]
        return pa.RecordBatch.from_arrays([*numbers, pa.array([tokens[at].tobytes()]), pa.array([back.astype(np.int64).tobytes()]), pa.array([facts[own].tobytes()])], names=["bucket", "parts", "i", "j", "tokens", "rows", "facts"])

    def compare(table: pa.Table) -> pa.Table:
        lean_memory()
        n, one, two = (table.column(c)[0].as_py() for c in ("parts", "i", "j"))
        tokens, rows, facts, base = [], [], [], 0
        for t, r, f in zip(*(table.column(c).to_pylist() for c in ("tokens", "rows", "facts")), strict=True):
            tokens.append(np.frombuffer(t, np.uint64))
            rows.append(np.frombuffer(r, np.int64) + base)
            facts.append(np.frombuffer(f, FACTS))
            base += len(facts[-1])
        tokens, rows, facts = np.concatenate(tokens), np.concatenate(rows), np.concatenate(facts)
        # By token, and within it by size: partners then lie in a stretch of the sizes that may link.
        order = np.lexsort((facts["n"][rows], tokens))
        tokens, rows = tokens[order], rows[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(first, np.append(first[1:], len(tokens)), strict=True):
            group = rows[s:e]
            if facts["comp"][group].min() == facts["comp"][group].max():
                continue
            f = facts[group]
            side = _side(f["doc"], n)
            step = max(1, (1 << 20) // len(group))
            for at in range(0, len(group), step):
                x = f[at : at + step, None]
                # Later ones of at most 4/3 the size; of two parts' documents only those across the parts.
                y = f[at : np.searchsorted(3 * f["n"], 4 * int(x["n"].max()), side="right")]
                may = (x["comp"] != y["comp"]) & (3 * y["n"] <= 4 * x["n"]) & (np.arange(len(y)) > np.arange(len(x))[:, None])
                if one != two:
                    may &= side[at : at + step, None] != side[at : at + len(y)]
                i, j = np.nonzero(may)
                for c in range(0, len(i), 1 << 15):
                    p, q = y[i[c : c + (1 << 15)]], y[j[c : c + (1 << 15)]]
                    differ = np.bitwise_count(p["parity"] ^ q["parity"]).sum(axis=1)
                    # A link has at most a seventh of both sizes' sum in the symmetric difference.
                    near = 7 * differ.astype(np.int64) <= p["n"] + q["n"]
                    left.append(np.minimum(p["doc"], q["doc"])[near])
                    right.append(np.maximum(p["doc"], q["doc"])[near])
        return pa.Table.from_arrays(_pair_counts(np.concatenate(left), np.concatenate(right)), names=["a", "b", "shared"])

    dealt = sets.select("doc", "component", "keys", "l").mapInArrow(deal, "bucket long, parts long, i long, j long, tokens binary, rows binary, facts binary")
    pairs = dealt.groupBy("bucket").applyInArrow(compare, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    pairs = materialize(pairs, "shared-by-pair")
    ls = sets.select("doc", "l")
    pairs = spread_join(pairs, ls.select(F.col("doc").alias("a"), F.col("l").alias("l_a")), "a")
    pairs = spread_join(pairs, ls.select(F.col("doc").alias("b"), F.col("l").alias("l_b")), "b")
    return pairs.where(F.col("shared") >= F.least("l_a", "l_b")).select("a", "b")


FACTS = np.dtype([("doc", np.int64), ("comp", np.int64), ("n", np.int64), ("l", np.int64), ("parity", np.uint8, BITS // 8)])


def whole_sets(rows: DataFrame, wanted: DataFrame, may_be_wanted: MayBeAmong, heavy: np.ndarray) -> DataFrame:
    """(doc, keys, l, centers, is_center) of the documents in wanted (doc, centers, is_center): whole sets as sorted 64-bit integers.

    Sets of documents that may be wanted are dealt by document, texts are not.
    """
    tell = may_be_wanted.test()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            b = b.filter(tell(b.column(2), b.column(3)))
            texts = b.column(1).to_pylist()
            for s, e in slices(texts):
                keys, offsets = shingle_sets(texts[s:e])
                blobs = [keys[i:j].tobytes() for i, j in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(blobs, pa.binary()), pa.array(chosen_l(keys, offsets, heavy))], names=["doc", "keys", "l"])

    one, two = may_be_wanted.places(F.col("doc_id"))
    found = rows.select("doc_id", "text", one.alias("one"), two.alias("two")).mapInArrow(run, "doc long, keys binary, l long")
    return found.join(wanted, "doc").dropDuplicates(["doc"]).select("doc", "keys", "l", "centers", "is_center")


def _enough(n: Column) -> Column:
    """The least L of any partner of a set of n tokens."""
    return 1 + F.floor(F.ceil(n * 0.75) / 5)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document id; the tables written on the way are dropped."""
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(_near_duplicates(_text_rows(docs, doc_id, text)), "near-duplicates")


def _near_duplicates(rows: DataFrame) -> DataFrame:
    facts, counts = sizes_and_counts(rows)
    rows = one_row_an_id(rows, facts)
    heavy = counts > 4 * max(1.0, counts.mean())
    buckets = int(min(1 << 20, max(32, counts.sum() // (2 * ENTRIES_A_BUCKET))))
    facts = facts.groupBy("doc_id").agg(F.min(F.struct("n", "sig_a", "sig_b")).alias("f")).select("doc_id", "f.*")
    alike = facts.where("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("class"))
    # A third of all documents may be one class: its members are spread.
    key = F.struct("n", "sig_a", "sig_b").alias("set")
    classed = spread_join(facts.where("n > 0").select("doc_id", "n", key), alike.select(key, "class"), "set").select("doc_id", "n", "class")
    member = materialize(classed.union(facts.where("n = 0").select("doc_id", "n", "doc_id")), "classes")

    shared = materialize(shared_prefixes(rows, heavy, buckets), "shared-prefixes")
    sums = shared.groupBy("doc").agg(F.sum("shared").alias("sum")).join(member.where("doc_id = class").select(F.col("doc_id").alias("doc"), "n"), "doc")
    kept = materialize(sums.where(F.col("sum") >= _enough(F.col("n"))).select("doc", "n"), "kept")
    center = member.select(F.col("doc_id").alias("center"), F.col("class").alias("a"))
    by_class = materialize(spread_join(shared, center, "center").join(kept.select("doc"), "doc").groupBy("doc", "a").agg(F.sum("shared").alias("shared")), "by-class")

    # Of each document's centres, as classes, the one that shares most and the least.
    stars = spread_join(by_class.where("a != doc"), kept.select(F.col("doc").alias("a")), "a").groupBy("doc").agg(F.max(F.struct("shared", "a")).alias("most"), F.min("a").alias("least"))
    stars = materialize(stars.select("doc", F.array_distinct(F.array("most.a", "least")).alias("centers")), "stars")
    hubs = stars.select(F.explode("centers").alias("doc")).distinct().withColumn("is_center", F.lit(True))
    wanted = kept.select("doc").join(stars, "doc", "left").join(hubs, "doc", "left").na.fill(False, ["is_center"])
    sets = materialize(whole_sets(rows, wanted, MayBeAmong(kept.select("doc")), heavy), "sets")
    # A hub's set goes to as many places as it has members, 16 at most; members' sets are dealt by hub and salt.
    salt = F.pmod(F.xxhash64("b"), F.lit(16)).alias("salt")
    members = sets.select(F.explode("centers").alias("a"), F.col("doc").alias("b"), F.col("keys").alias("keys_b")).select("a", salt, "b", "keys_b")
    places = stars.select(F.explode("centers").alias("a"), F.col("doc").alias("b")).select("a", salt).distinct()
    hub_sets = places.join(sets.where("is_center").select(F.col("doc").alias("a"), F.col("keys").alias("keys_a")), "a")
    first = materialize(components(verified(members.join(hub_sets, ["a", "salt"]))), "components")

    component = kept.join(first.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    left = leftover_docs(by_class, component.select("doc", "component")).join(component, "doc").where(F.col("mixed") >= _enough(F.col("n"))).select("doc", "component")
    left = materialize(sets.select("doc", "keys", "l").join(left, "doc").select("doc", "component", "keys", "l"), "leftover")
    pairs = materialize(leftover_pairs(left, buckets), "pairs")
    one, two = left.select(F.col("doc").alias("a"), F.col("keys").alias("keys_a")), left.select(F.col("doc").alias("b"), F.col("keys").alias("keys_b"))
    more = verified(spread_join(spread_join(pairs, one, "a").select("a", "b", "keys_a"), two, "b", by=("a", "b")))
    final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    of_class = member.where("doc_id = class").select("class").join(final.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("component", "class").alias("component_id"))
    return spread_join(member, of_class, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
