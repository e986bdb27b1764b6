"""Distinct-chunk tables: a chunk that occurs again is not segmented again.

A batch of texts, as UTF-8 bytes, is cut into chunks that its tokenizer can never merge across. Every
chunk gets a 64-bit rolling hash, by which it is looked up; a chunk that the table has under that hash is
compared with it byte by byte, and one of equal hash but other bytes is kept by its bytes. Each distinct
chunk is segmented once by the library and its ids stay in a table; a document's ids are its chunks' entries
joined by position. Each worker holds one table, and starts a new one when it exceeds ``most`` chunks, or
their ids or bytes in proportion, so memory is bounded on any corpus and results don't depend on it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, worker_caches

SLICE_BYTES = 1 << 20
MOST_PIECE_CHUNKS = 300_000
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, n.bit_length())
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _powers.append(x)
    return _powers


class ChunkTable:
    def __init__(self, segmenter: PieceSegmenter | WordSegmenter, most: int = 900_000):
        self.by, self.most = segmenter, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.others: dict[bytes, int] = {}
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0
        self.raw_start, self.raw_size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.known = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin and end."""
        flat, counts, some, n = [], [], [], 0
        for k, t in enumerate(texts):
            some.append(t)
            n += len(t)
            if n >= SLICE_BYTES or k == len(texts) - 1:
                ids, each = self._slice(some)
                flat.append(ids)
                counts.append(each)
                some, n = [], 0
        offsets = np.zeros(len(texts) + 1, np.int64)
        if texts:
            np.cumsum(np.concatenate(counts), out=offsets[1:])
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), offsets

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.known > self.most or max(self.used, self.raw_used // 4) > 8 * self.most:
            self.clear()
        texts = [self.by.prepare(t) for t in texts]
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        raw = b"".join(texts)
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        b = np.frombuffer(raw, np.uint8)
        cut = self.by.cuts(b)
        cut[(ends - sizes)[sizes > 0]] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(b))
        power, inverse = _powers_to(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        folded = self.by.fold(b)
        np.cumsum(_BYTE[folded] * power[: len(b)], out=sums[1:])
        keys = (sums[stop] - sums[start]) * inverse[start]
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.array([self.place.get(k, -1) for k in distinct.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn(raw, folded, start[first[new]], stop[first[new]])
            self.place.update(zip(distinct[new].tolist(), at[new].tolist(), strict=True))
        at = at[back]
        for i in np.flatnonzero(~self._equal(at, folded, start, stop)).tolist():
            at[i] = self._other(raw, folded, start[i], stop[i])
        count = self.count[at]
        so_far = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[at] - so_far + count, count) + np.arange(so_far[-1])]
        # A text's ids end with those of its last chunk.
        total = np.append(0, so_far)[np.searchsorted(start, ends)]
        return ids, np.diff(total, prepend=0)

    def _equal(self, at: np.ndarray, folded: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether the chunks folded[start:stop], which cover all of it, have the bytes of the table's entries at."""
        size = stop - start
        same = self.raw_size[at] == size
        place = np.repeat(np.where(same, self.raw_start[at], 0) - start, size) + np.arange(len(folded))
        differ = self.raw[np.minimum(place, len(self.raw) - 1)] != folded
        return same & ~np.logical_or.reduceat(differ, start)

    def _other(self, raw: bytes, folded: np.ndarray, start: int, stop: int) -> int:
        """The entry of a chunk whose hash another chunk has."""
        key = folded[start:stop].tobytes()
        if key not in self.others:
            self.others[key] = int(self._learn(raw, folded, np.array([start]), np.array([stop]))[0])
        return self.others[key]

    def _learn(self, raw: bytes, folded: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """New entries for the chunks raw[start:stop]."""
        ids, count = self.by.segment([raw[s:e] for s, e in zip(start.tolist(), stop.tolist(), strict=True)])
        size = stop - start
        known, more = self.known, self.known + len(start)
        self.ids, self.raw = _room(self.ids, self.used + len(ids)), _room(self.raw, self.raw_used + int(size.sum()))
        self.start, self.count, self.raw_start, self.raw_size = (_room(x, more) for x in (self.start, self.count, self.raw_start, self.raw_size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[known:more] = self.used + np.cumsum(count) - count
        self.count[known:more] = count
        begin = np.cumsum(size) - size
        self.raw[self.raw_used : self.raw_used + int(size.sum())] = folded[np.repeat(start - begin, size) + np.arange(int(size.sum()))]
        self.raw_start[known:more] = self.raw_used + begin
        self.raw_size[known:more] = size
        self.used, self.raw_used, self.known = self.used + len(ids), self.raw_used + int(size.sum()), more
        return np.arange(known, more)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def _lookup(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode("ascii"))] = True
    return found


_ASCII_LETTER = _lookup("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LATIN = [chr(c) for c in range(256) if chr(c).isalpha() and (c < 128 or c >= 0xC0)]


def _letters(b: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+00FF but for the signs of multiplication and division."""
    letter = _ASCII_LETTER[b]
    lead = np.flatnonzero(b[:-1] == 0xC3)
    lead = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    return letter


def _cuts(b: np.ndarray, blank: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Cuts before runs of blanks, and between letters and the given marks."""
    is_blank, is_mark, letter = blank[b], mark[b], _letters(b)
    cut = np.zeros(len(b), bool)
    cut[1:] = is_blank[1:] & ~is_blank[:-1] | letter[:-1] & is_mark[1:] | is_mark[:-1] & letter[1:]
    return cut


class PieceSegmenter:
    """For a piece model with byte fallback, identity normalisation and a dummy prefix.

    No merge can join two characters that stand next to each other in no piece. Chunks begin at runs of
    the marker, and where letters meet characters that no piece has beside letters.
    """

    MARK = "▁"

    def __init__(self, proto: bytes):
        import sentencepiece

        m = self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(p[1] == self.MARK and p[0] != self.MARK for p in pairs):
            raise ValueError("this model has pieces that cross a marker")
        lead = m.encode("\n")
        if m.encode("\n a")[: len(lead)] != lead or m.encode("a b") != m.encode("a▁b") or m.encode("  a") == m.encode("a"):
            raise ValueError("chunks need byte fallback, a dummy prefix and white space kept as it is")
        self.lead = len(lead)
        beside = {x for p in pairs for x in p if any(c in LATIN for c in p)}
        self.blank, self.mark = _lookup(" "), _lookup("".join(c for c in map(chr, range(128)) if c not in beside and c != " "))

    def prepare(self, text: bytes) -> bytes:
        return b" " + text.replace(self.MARK.encode(), b" ") if text else text

    def fold(self, b: np.ndarray) -> np.ndarray:
        return b

    def cuts(self, b: np.ndarray) -> np.ndarray:
        return _cuts(b, self.blank, self.mark)

    def segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Behind a line feed, which no piece contains, a chunk is segmented as in the midst of a text."""
        lists = [ids[self.lead :] for ids in self.model.encode(["\n" + c.decode() for c in chunks], num_threads=1)]
        return np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))


class WordSegmenter:
    """For a lower-casing word BPE that drops white space: its pattern ends words at blanks and final punctuation.

    Words of Latin letters alone, in small letters, are what its normaliser and pattern leave as they are, so
    a second tokenizer of the same merges without those two takes them; all else goes to the whole tokenizer.
    """

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(config)
        lean = json.loads(config)
        bytewise = [p for p in lean["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]
        self.lean = Tokenizer.from_str(json.dumps(lean | {"normalizer": None, "added_tokens": [], "pre_tokenizer": bytewise[0]}))
        self.blank, self.mark = _lookup(" \n\t\r"), _lookup('.,!?;:()"')
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.lower[list(b"\n\t\r")] = 0x20
        self.word = re.compile("[ \\n\\t\\r]*([A-Za-zÀ-ÖØ-öø-ÿ]+)").fullmatch

    def prepare(self, text: bytes) -> bytes:
        return text

    def fold(self, b: np.ndarray) -> np.ndarray:
        """Small letters for capitals, unless a combining mark follows, with which they might compose otherwise; one kind of blank."""
        low = self.lower[b]
        marked = np.flatnonzero((b[1:] == 0xCC) | (b[1:] == 0xCD))
        low[marked] = b[marked]
        return low

    def cuts(self, b: np.ndarray) -> np.ndarray:
        return _cuts(b, self.blank, self.mark)

    def segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode() for c in chunks]
        words = [self.word(t) for t in texts]
        at_all, ids_all, counts_all = [], [], []
        for model, at, some in (
            (self.lean, [i for i, m in enumerate(words) if m], [m[1].lower() for m in words if m]),
            (self.model, [i for i, m in enumerate(words) if not m], [t for t, m in zip(texts, words, strict=True) if not m]),
        ):
            if some:
                e = model.encode(some, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(e.ids, np.int32)
                counts = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)) if len(ids) else np.zeros(len(some), np.int64)
                at_all.append(np.array(at))
                ids_all.append(ids)
                counts_all.append(counts)
        at, ids, counts = (np.concatenate(x) for x in (at_all, ids_all, counts_all))
        owner = np.repeat(at, counts)
        return ids[np.argsort(owner, kind="stable")], counts[np.argsort(at)]


_made: dict[tuple[str, int], ChunkTable] = {}
worker_caches.append(_made)


def table_for(kind: str, model: bytes) -> ChunkTable:
    """One table for each worker and model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (kind, hash(model))
    if key not in _made:
        _made[key] = ChunkTable(PieceSegmenter(model), MOST_PIECE_CHUNKS) if kind == "piece" else ChunkTable(WordSegmenter(model.decode()))
    return _made[key]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    return (ids, offsets) if end_id is None else (np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets)))


def encode(docs: DataFrame, kind: str, model: bytes, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns (doc_id, ids array<int>); null texts count as empty, other columns are left behind."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(kind, model)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                b = batch.slice(start, 1000)
                ids, offsets = with_end(*table.encode(b.column(1).to_pylist()), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")
