"""Repeated passages: a depth-limited radix sort of suffixes, most significant digits first.

Suffixes are ordered only through DEPTH bytes. Every window of DEPTH bytes contains an anchor: the GRAM
bytes of least hash among those inside it, so equal windows have equal anchors at equal places, and only
suffixes at anchors are sorted. They are dealt to buckets by the leading bits of their gram's hash (bytes
would deal them unevenly), where those whose gram occurs in one document alone leave. The others are sorted
by msd_groups: passes over digits of eight bytes, first of the gram, then of the bytes around it; a pass takes
only rows that are still in a group of several, so groups at the end are equal byte by byte. Windows inside
such surroundings are found by a rolling hash and compared byte by byte; each keeps its least document.

Within a batch a gram that occurs often goes to its bucket by its least and greatest document only, and
in the second pass each part of the documents sends each distinct surrounding once, so no task gathers all
occurrences of a frequent passage. Texts are dealt once by part of doc_id; both uses read the same shuffle.

Nulls and empty texts have nothing to remove; texts of any length are one row each; rows without an id are
left out; rows that repeat an id are judged each, against smaller ids only; ties of windows go to the least
id; an empty table gives an empty table; columns other than id and text are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.chunks import _BYTE, _powers_to
from docloom.llm.common import bounded_batches
from docloom.llm.shingles import mix, slices

DEPTH = 50
GRAM = 24
SIDE = DEPTH - GRAM
WIDTH = DEPTH + SIDE
PART_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20
NEVER = np.iinfo(np.int64).max


def _slide(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of over x[i : i + width], for every i where that fits."""
    done = 1
    while 2 * done <= width:
        x = of(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def gram_hashes(b: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the n bytes at each position."""
    power, inverse = _powers_to(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse[: len(b) - n + 1])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of every gram that is least in some window of DEPTH bytes within its text."""
    texts = [t if len(t) >= DEPTH else b"" for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = b"".join(texts)
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b, ends = np.frombuffer(raw, np.uint8), np.cumsum(sizes)
    hashes = gram_hashes(b)
    least = _slide(hashes, SIDE + 1, np.minimum)
    # Windows that would cross into the next text don't count.
    for e in ends[:-1][sizes[1:] > 0].tolist():
        least[max(0, e - DEPTH + 1) : e] = 0
    around = np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)])
    at = np.flatnonzero((_slide(around, SIDE + 1, np.maximum) == hashes) & (hashes > 0))
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - sizes)[text], dealt(hashes[at])


def dealt(hashes: np.ndarray) -> np.ndarray:
    """Anchors' hashes are least ones, so small; mixed again they fill all buckets evenly."""
    return mix(hashes + np.uint64(0x5851F42D4C957F2D))


def _part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    return docs % parts


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, in columns that are in order."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    edge = _firsts(keys[order])
    for s, e in zip(edge, np.append(edge[1:], len(keys)), strict=True):
        yield int(keys[order[s]]), order[s:e]


def _batch(**columns: list) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "part": pa.int64(), "known": pa.bool_(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))


def _pack(*columns: np.ndarray | bytes) -> bytes:
    """Columns, the first of which says how many rows there are, compressed."""
    body = b"".join(c if isinstance(c, bytes) else c.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(columns[0])], np.int64).tobytes() + body)


def _unpack(blob: bytes, *kinds: type | tuple[type, int]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        one, width = kind if isinstance(kind, tuple) else (kind, 1)
        x = np.frombuffer(raw, one, n * width, at)
        out.append(x.reshape(n, width) if width > 1 else x)
        at += x.nbytes
    return out


def _steps(doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Documents and places as differences from row to row."""
    return [np.diff(doc, prepend=np.int64(0)), np.diff(at.astype(np.uint32), prepend=np.uint32(0))]


def _sums(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(doc), np.cumsum(at, dtype=np.uint32).astype(np.int64)


def _joined(pairs: list[tuple[np.ndarray, ...]], n: int = 2) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * n


def _deal(parts: int, buckets: int) -> Callable:
    """First pass, map side: entries by bucket of their gram. known: occurrences that this batch shows to be shared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, z in slices(texts, 4 << 20):
                found = []
                for s, e in slices(texts[a:z], 1 << 20):
                    text, at, key = anchors(texts[a + s : a + e])
                    found.append((ids[a + s : a + e][text], at, key))
                yield from rows_of(*_joined(found, 3))

    def rows_of(doc: np.ndarray, at: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = key.astype(np.uint64)
        order = np.lexsort((doc, key))
        doc, at, key = doc[order], at[order], key[order]
        first = _firsts(key)
        size = np.diff(np.append(first, len(key)))
        often = np.repeat((size > 2) & (doc[first] < doc[first + size - 1]), size)
        probe = ~often
        probe[first] = probe[first + size - 1] = True
        bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        for k, rows in _groups(np.where(probe, bucket.astype(np.int64), -1)):
            if k >= 0:
                rows = rows[np.lexsort((at[rows], doc[rows]))]
                # Leading bits chose the bucket; 32 more tell nearly all its grams apart, and the second pass the rest.
                yield _batch(bucket=[k], known=[False], blob=[_pack((key[rows] & np.uint64(0xFFFFFFFF)).astype(np.uint32), *_steps(doc[rows], at[rows]))])
        rows = np.flatnonzero(often)
        rows = rows[np.lexsort((at[rows], doc[rows]))]
        for k, some in _groups(_part_of(doc[rows], parts) % buckets):
            yield _batch(bucket=[k], known=[True], blob=[_pack(*_steps(doc[rows[some]], at[rows[some]]))])

    return run


def _deal_texts(parts: int) -> Callable:
    """Ids and texts by part, compressed: both steps that need the texts read this one shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for k, rows in _groups(_part_of(ids, parts)):
                some = [texts[i] for i in rows]
                yield _batch(part=[k], blob=[_pack(ids[rows], np.array([len(t) for t in some], np.int64), b"".join(some))])

    return run


def _shared(parts: int) -> Callable:
    """First pass, each bucket: occurrences of grams in more than one document, dealt to their documents' parts."""

    def run(table: pa.Table) -> pa.Table:
        sure, new = [], []
        for known, blob in zip(table.column("known").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if known:
                sure.append(_sums(*_unpack(blob, np.int64, np.uint32)))
            else:
                key, doc, at = _unpack(blob, np.uint32, np.int64, np.uint32)
                new.append((key, *_sums(doc, at)))
        if new:
            key, doc, at = _joined(new, 3)
            order = np.argsort(key, kind="stable")
            key, doc, at = key[order], doc[order], at[order]
            first = _firsts(key)
            several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            keep = np.repeat(several, np.diff(np.append(first, len(key))))
            sure.append((doc[keep], at[keep]))
        doc, at = _joined(sure)
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        rows = list(_groups(_part_of(doc, parts)))
        return pa.Table.from_batches([_batch(part=[k for k, _ in rows], kind=[0] * len(rows), blob=[_pack(*_steps(doc[r], at[r])) for _, r in rows])])

    return run


class _Part:
    """One part's documents with the surroundings of their shared grams, and the distinct ones among these."""

    def __init__(self, docs: list[bytes], shared: list[bytes]):
        ids, texts = [np.zeros(0, np.int64)], []
        for blob in docs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            ids.append(np.frombuffer(raw, np.int64, n, 8))
            at = 8 + 16 * n
            for size in np.frombuffer(raw, np.int64, n, 8 + 8 * n).tolist():
                texts.append(raw[at : at + size])
                at += size
        ids = np.concatenate(ids)
        # Equal ids in order of their texts, so that both uses of a part number its surroundings alike.
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.texts = ids[order], [texts[i] for i in order]
        doc, at = _joined([_sums(*_unpack(x, np.int64, np.uint32)) for x in shared])
        # Rows that share an id all get that id's places.
        lo, hi = np.searchsorted(self.ids, doc), np.searchsorted(self.ids, doc, side="right")
        row = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
        at = np.repeat(at, hi - lo)
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        once = _firsts(row, at)
        row, at = row[once], at[once]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        fits = at + GRAM <= sizes[row]
        self.row, self.at = row[fits], at[fits]
        b = np.frombuffer(bytes(SIDE) + b"".join(self.texts) + bytes(DEPTH), np.uint8)
        self.left = np.minimum(self.at, SIDE)
        self.right = np.minimum(sizes[self.row] - self.at, DEPTH)
        where = np.arange(WIDTH)
        self.around = np.lib.stride_tricks.sliding_window_view(b, WIDTH)[(np.cumsum(sizes) - sizes)[self.row] + self.at]
        self.around[(where < (SIDE - self.left)[:, None]) | (where >= (SIDE + self.right)[:, None])] = 0
        self.key = dealt(_row_hash(self.around[:, SIDE : SIDE + GRAM]))
        self.entry, self.first = msd_groups(_surrounding(self.around, self.left, self.right))

    def least(self) -> np.ndarray:
        out = np.full(len(self.first), NEVER)
        np.minimum.at(out, self.entry, self.ids[self.row])
        return out


def _row_hash(rows: np.ndarray) -> np.ndarray:
    power, _ = _powers_to(WIDTH)
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out += _BYTE[rows[:, k]] * power[k]
    return mix(out)


def _surrounding(around: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows whose equality is that of gram, bytes around it, and how many of these are the text's own; the gram leads."""
    sides = np.stack([left, right], axis=1).astype(np.uint8)
    return np.concatenate([around[:, SIDE : SIDE + GRAM], around[:, :SIDE], around[:, SIDE + GRAM :], sides], axis=1)


def msd_groups(rows: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group of equal rows of bytes, and where each group's first row is.

    A radix sort, most significant digit first: a digit is eight bytes, and only rows that share all digits so
    far with another are sorted by the next. Groups are numbered in order of their digits as far as those were needed;
    known says groups of rows within which to begin.
    """
    n = len(rows)
    group = np.zeros(n, np.int64) if known is None else known.astype(np.int64)
    padded = np.zeros((n, -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    digits = padded.view(">u8")
    active = np.arange(n)
    # Groups are named by the place that their first row has in the order, so a finer split needs no renaming of others.
    if known is not None and n:
        active = np.argsort(group, kind="stable")
        edge = _firsts(group[active])
        size = np.diff(np.append(edge, n))
        group[active] = np.repeat(edge, size)
        active = active[np.repeat(size > 1, size)]
    for d in range(digits.shape[1]):
        if not len(active):
            break
        digit = digits[active, d].astype(np.uint64)
        order = np.lexsort((digit, group[active]))
        active, digit = active[order], digit[order]
        old = group[active]
        edge = _firsts(old, digit)
        size = np.diff(np.append(edge, len(active)))
        begin = _firsts(old)
        # A subgroup's name: its old group's, and how many of that group's rows come before it.
        within = edge - np.repeat(begin, np.diff(np.append(np.searchsorted(edge, begin), len(edge))))
        group[active] = np.repeat(old[edge] + within, size)
        active = active[np.repeat(size > 1, size)]
    _, first, number = np.unique(group, return_index=True, return_inverse=True)
    return number.astype(np.int64), first


def _surroundings(buckets: int) -> Callable:
    """Second pass, map side: each distinct surrounding of a part, with its least document, by bucket of its gram."""

    def run(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        part = _Part(docs.column("blob").to_pylist(), shared.column("blob").to_pylist())
        least, f = part.least(), part.first
        bucket = (part.key[f] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        rows = list(_groups(bucket.astype(np.int64)))
        sent = [_pack(r.astype(np.uint32), least[r], part.left[f][r].astype(np.uint8), part.right[f][r].astype(np.uint8), part.around[f[r]]) for _, r in rows]
        return pa.Table.from_batches([_batch(bucket=[k for k, _ in rows], part=[key[0].as_py()] * len(rows), blob=sent)])

    return run


def _resolve(table: pa.Table) -> pa.Table:
    """Second pass, each bucket: for each surrounding its least document, and which of that one's windows occur in a lesser."""
    found = [_unpack(x, np.uint32, np.int64, np.uint8, np.uint8, (np.uint8, WIDTH)) for x in table.column("blob").to_pylist()]
    sizes = [len(x[0]) for x in found]
    entry, doc, left, right, around = (np.concatenate(c) for c in zip(*found, strict=True))
    del found
    left, right = left.astype(np.int64), right.astype(np.int64)
    # The first digits alone: rows that share a gram; then all of them.
    gram, _ = msd_groups(around[:, SIDE : SIDE + GRAM])
    back, _ = msd_groups(_surrounding(around, left, right), gram)
    order = np.lexsort((doc, back))
    at = order[_firsts(back[order])]
    key, least, left, right = gram[at], doc[at], left[at], right[at]
    # Groups are in order of their grams.
    first = at
    mask = np.zeros(len(first), np.uint32)
    edge = _firsts(key)
    some = np.flatnonzero(np.repeat(np.diff(np.append(edge, len(key))) > 1, np.diff(np.append(edge, len(key)))))
    s = 0
    while s < len(some):
        # A gram's surroundings stay together.
        e = min(len(some), s + (1 << 16))
        e = int(np.searchsorted(key[some], key[some[e - 1]], side="right"))
        rows = some[s:e]
        mask[rows] = _masks(least[rows], left[rows], right[rows], around[at[rows]])
        s = e
    out, a = [], 0
    for n in sizes:
        own = back[a : a + n]
        out.append(_pack(entry[a : a + n], least[own], mask[own]))
        a += n
    return pa.Table.from_batches([_batch(part=table.column("part").to_pylist(), kind=[1] * len(out), blob=out)])


def _masks(least: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each surrounding a bit for each place of a window that some lesser document's surrounding has too."""
    power, inverse = _powers_to(WIDTH + 1)
    sums = np.zeros((WIDTH + 1, len(around)), np.uint64)
    for k in range(WIDTH):
        sums[k + 1] = sums[k] + _BYTE[around[:, k]] * power[k]
    mask = np.zeros(len(around), np.uint32)
    for s in range(SIDE + 1):
        rows = np.flatnonzero((s >= SIDE - left) & (s + DEPTH <= SIDE + right))
        if not len(rows):
            continue
        window = (sums[s + DEPTH, rows] - sums[s, rows]) * inverse[s]
        order = np.argsort(window, kind="stable")
        window, rows = window[order], rows[order]
        first = _firsts(window)
        own = around[rows, s : s + DEPTH]
        if not np.array_equal(own, own[np.repeat(first, np.diff(np.append(first, len(rows))))]):
            # Equal hashes of unequal windows: these are sorted by their bytes.
            number, _ = msd_groups(own)
            order = np.argsort(number, kind="stable")
            rows = rows[order]
            first = _firsts(number[order])
        low = np.repeat(np.minimum.reduceat(least[rows], first), np.diff(np.append(first, len(rows))))
        mask[rows[low < least[rows]]] |= np.uint32(1 << s)
    return mask


def _remove(key: tuple, docs: pa.Table, more: pa.Table) -> pa.Table:
    """The last step in each part: removed runs and what is kept, for each document."""
    pieces = list(zip(more.column("kind").to_pylist(), more.column("blob").to_pylist(), strict=True))
    part = _Part(docs.column("blob").to_pylist(), [b for k, b in pieces if k == 0])
    least, mask = np.full(len(part.first), NEVER), np.zeros(len(part.first), np.uint32)
    for k, b in pieces:
        if k == 1:
            entry, low, bits = _unpack(b, np.uint32, np.int64, np.uint32)
            least[entry], mask[entry] = low, bits
    later = part.ids[part.row] > least[part.entry]
    # Windows lie from the left edge of what is known to its right edge.
    whole = later & (part.left + part.right >= DEPTH)
    row, start, end = [part.row[whole]], [(part.at - part.left)[whole]], [(part.at + part.right)[whole]]
    bits = np.where(later, 0, mask[part.entry])
    for s in range(SIDE + 1):
        hit = np.flatnonzero(bits >> np.uint32(s) & 1)
        row.append(part.row[hit])
        start.append(part.at[hit] - SIDE + s)
        end.append(part.at[hit] - SIDE + s + DEPTH)
    row, start, end = (np.concatenate(x) for x in (row, start, end))
    order = np.argsort(row, kind="stable")
    row, start, end = row[order], start[order], end[order]
    edge = np.searchsorted(row, np.arange(len(part.ids) + 1))
    starts, ends, kept = [], [], []
    for i, text in enumerate(part.texts):
        s, e = edge[i], edge[i + 1]
        if s == e:
            starts.append([])
            ends.append([])
            kept.append(text)
            continue
        change = np.zeros(len(text) + 1, np.int32)
        np.add.at(change, start[s:e], 1)
        np.add.at(change, end[s:e], -1)
        gone = np.cumsum(change[:-1]) > 0
        turns = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        starts.append(np.flatnonzero(turns == 1).tolist())
        ends.append(np.flatnonzero(turns == -1).tolist())
        kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
    longs = pa.list_(pa.int64())
    columns = [pa.array(part.ids), pa.array([len(t) for t in part.texts], pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary())]
    return pa.Table.from_arrays(columns, names=["doc_id", "n_bytes", "starts", "ends", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): removed byte runs of each document, and the bytes that stay."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts, buckets = _prime(max(24, size // PART_BYTES)), max(24, size // BUCKET_BYTES)
    dealt = rows.mapInArrow(_deal(parts, buckets), "bucket long, known boolean, blob binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared(parts), "part long, kind int, blob binary")
    texts = rows.mapInArrow(_deal_texts(parts), "part long, blob binary").groupBy("part")
    around = texts.cogroup(shared.groupBy("part")).applyInArrow(_surroundings(buckets), "bucket long, part long, blob binary")
    answers = around.groupBy("bucket").applyInArrow(_resolve, "part long, kind int, blob binary")
    kept = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"
    return texts.cogroup(shared.unionByName(answers).groupBy("part")).applyInArrow(_remove, kept)


def _prime(n: int) -> int:
    """The least prime from n on: ids that go in steps then still reach every part."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n
