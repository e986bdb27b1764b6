from __future__ import annotations

import collections
import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import mixing, pii, queries, winnowing
from tests.llm.cases import CLASHING, mixed_texts, rows

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def found_spans(df, base=True):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base or not base] for r in pii.spans_by_document(df).collect()}


def pii_texts():
    r = random.Random(3)
    some = ["".join(r.choice("0123456789..@@++-- ()abA_%é😀\n") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    return [*some, "1" * 60_000, "x" * 60_000, "a@" + "b." * 9000 + "c", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111 ip 0255.00.1.1", None, ""]


def test_base_spans_equal_brute_force(spark, sf_dir):
    for df in (rows(spark, pii_texts()), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        assert found_spans(df) == {r.doc_id: base_spans(r.text or "") for r in df.select("doc_id", "text").collect()}
    assert found_spans(df.limit(0)) == {}


def test_method_spans_need_checksum_or_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "part 123-45-6789", "call (415) 555-1234", "code (415) 555-1234"]
    got = found_spans(rows(spark, texts, step=1), base=False)
    kinds = [[k for k, *_ in got[i] if k not in BASE] for i in range(len(texts))]
    assert kinds == [["iban"], [], ["ssn"], [], ["local"], []]
    assert got[0][0] == ("iban", 5, 32)


def test_redaction_replaces_what_is_found(spark):
    df = rows(spark, ["mail a.b@c.de now, call +1 (415) 555-7713", "4111111111111111, 4111111111111112", None, "plain"], step=1)
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {0: "mail [email] now, call [phone]", 1: "[card], 4111111111111112", 2: None, 3: "plain"}
    assert pii.redact(df).columns == df.columns


def plainly_redacted(text, spans):
    """Overlapping (start, end, kind) as one, named after the longest, cut from the end on."""
    groups = []
    for start, end, kind in sorted(spans, key=lambda x: (x[0], x[1], list(pii.KINDS).index(x[2]))):
        if groups and start < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], end)
            groups[-1][2].append((start - end, list(pii.KINDS).index(kind), kind))
        else:
            groups.append([start, end, [(start - end, list(pii.KINDS).index(kind), kind)]])
    for start, end, kinds in reversed(groups):
        text = text[:start] + f"[{min(kinds)[2]}]" + text[end:]
    return text


def test_redaction_cuts_overlapping_spans_whole(spark):
    texts = ["+33.6.12.34.56.78", "at +33 6.12.34.56.78!", "+1 415 555 7713 and 415-555-1234", "415-555-1234, a@b.c", "fax 415-555-1234 or +33.6.12.34.56.78"]
    got = {r.doc_id: r.text for r in pii.redact(rows(spark, texts, step=1)).collect()}
    assert [got[i] for i in range(len(texts))] == ["[phone]", "at [phone]!", "[phone] and 415-555-1234", "415-555-1234, [email]", "fax [local] or [phone]"]


def test_redaction_equals_the_spans_found(spark, sf_dir):
    many = " é ".join(f"u{i}@x.de +33.6.12.34.56.{i % 90 + 10}" for i in range(1300))
    for df in (rows(spark, [*pii_texts(), many, "1.2.3.4 " * 512, "1.2.3.4 " * 1024]), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        spans = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.spans_by_document(df).collect()}
        plain = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        got = {r.doc_id: r.text for r in pii.redact(df).select("doc_id", "text").collect()}
        assert got == {i: t if t is None else plainly_redacted(t, spans[i]) for i, t in plain.items()}


def fill(budget, children):
    """Plain water filling: children name -> (weight, capacity)."""
    given, left, open_ = {}, budget, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c * total <= left * w}
        if not full:
            return given | {n: left * w // total for n, (w, _) in open_.items()}
        # The fullest first, one at a time, as shares grow with each that is full.
        n = min(full, key=lambda k: (open_[k][1] / open_[k][0], k))
        given[n] = full[n]
        left -= full[n]
        del open_[n]
    return given


def brute_mix(docs, mix):
    word = re.compile("[^ \t-\r]+")
    leaves = collections.defaultdict(list)
    for i, text, lang, source in docs:
        m = re.search("([0-9]{1,9})$", source or "")
        leaf = (f"d{int(m[1]) % 4 if m else 0}", lang or "", source or "")
        leaves[leaf].append((i, len(word.findall(text or "")), hashlib.md5((text or "").encode()).hexdigest()))
    tokens = {k: sum(n for _, n, _ in v) for k, v in leaves.items()}
    capacity = lambda path: sum(n * mix.epochs for k, n in tokens.items() if k[: len(path)] == path)
    given = {}

    def share(path, budget):
        if len(path) == 3:
            given[path] = budget
            return
        names = sorted({k[len(path)] for k in leaves if k[: len(path)] == path})
        weights = (mix.domains, mix.languages, mix.sources)[len(path)]
        for n, b in fill(budget, {n: (weights.get(n, 1), capacity((*path, n))) for n in names if capacity((*path, n))}).items():
            share((*path, n), b)

    share((), sum(tokens.values()) * mix.share_of // mix.share_in)
    out = []
    for leaf, budget in given.items():
        for epoch in range(mix.epochs):
            left = min(max(budget - epoch * tokens[leaf], 0), tokens[leaf])
            keyed = sorted((hashlib.md5(f"{mix.seed}:{epoch}:{i}:{mark}".encode()).hexdigest(), i, n) for i, n, mark in leaves[leaf])
            for _, i, n in keyed:
                if n and left > 0:
                    out.append((i, *leaf, epoch, n, min(n, left)))
                left -= n
    return sorted(out)


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(epochs=3, share_of=5, share_in=2, domains={"d1": 50}), mixing.Mix(epochs=1, share_of=4, share_in=5)])
def test_mixing_equals_plain_water_filling(spark, sf_dir, mix):
    df = rows(spark, mixed_texts() * 3, sources=("src0", "src0", "src1", "src5", "web", None))
    for docs in (df, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        plain = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        assert sorted(tuple(r) for r in mixing.mix_documents(docs, mix).collect()) == brute_mix(plain, mix)


def test_shortages_go_to_siblings_before_ancestors(spark):
    """src1 can't take its share; its sibling src5 does, not the other domain's src2."""
    made = [(1, "a " * 10, "en", "src1"), (2, "a " * 990, "en", "src5"), (3, "a " * 1000, "en", "src2")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(domains={"d1": 1, "d2": 1}, sources={"src1": 9, "src5": 1}, share_of=1, share_in=2, epochs=1)
    taken = {r.source: r.take_tokens for r in mixing.mix_documents(df, mix).collect()}
    assert taken == {"src1": 10, "src5": 490, "src2": 500}


def test_mixing_bears_nothing_and_keeps_columns(spark):
    df = rows(spark, mixed_texts())
    assert mixing.mix_documents(df.limit(0)).count() == 0
    chosen = mixing.choose_documents(df, mixing.Mix(epochs=1, share_of=4, share_in=5))
    assert chosen.columns == df.columns
    ids = {r.doc_id for r in chosen.collect()}
    assert ids == {i for i, *_ in brute_mix([(r.doc_id, r.text, r.lang, r.source) for r in df.collect()], mixing.Mix(epochs=1, share_of=4, share_in=5))}


def _pair(a, b):
    return xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def prints(text, k=5, w=8):
    assert k == 5
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in re.findall("[^ \t-\r]+", text)]
    two = [_pair(a, b) for a, b in zip(hashes, hashes[1:], strict=False)]
    four = [_pair(a, b) for a, b in zip(two, two[2:], strict=False)]
    grams = [_pair(a, b) for a, b in zip(four, hashes[4:], strict=False)]
    if 0 < len(hashes) < k:
        seed = 42
        for x in hashes:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=seed)
        grams = [seed]
    grams = [_signed(g) for g in grams]
    placed = list(zip(grams, range(len(grams)), strict=True))
    chosen = []
    for x in [placed[i : i + w] for i in range(len(placed) - w + 1)] if len(placed) >= w else [placed] if placed else []:
        least = min(x, key=lambda p: (p[0], -p[1]))
        if least not in chosen[-1:]:
            chosen.append(least)
    return chosen


@pytest.mark.parametrize("rows_a_bucket", [3, 2000])
def test_winnowing_equals_brute_force(spark, sf_dir, rows_a_bucket):
    for df in (rows(spark, mixed_texts()), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        plain = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), reverse=True)
        got = winnowing.compare_with_edits(df, rows_a_bucket=rows_a_bucket)
        got = {r.doc_id: r for r in got.withColumn("a", winnowing.written("fingerprint")).withColumn("b", winnowing.written("edited_fingerprint")).collect()}
        assert len(got) == len(plain)
        write = lambda f: ",".join(f"{p}:{h % (1 << 64):x}" for h, p in f)
        for k, (i, text) in enumerate(plain):
            following = plain[(k + 1) % len(plain)][1]
            edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
            own, other, later = ({h for h, _ in prints(t)} for t in (text, edited, following))
            alike = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
            assert (got[i].edited, got[i].a, got[i].b) == (edited, write(prints(text)), write(prints(edited)))
            assert (got[i].near_edited, got[i].near_next) == (alike(own, other), alike(own, later))


def test_winnowing_guarantee(spark):
    """Texts that share w + k - 1 words in a row share a hash."""
    r = random.Random(2)
    texts = []
    for k in range(40):
        common = [f"c{k}_{j}" for j in range(12)]
        for side in "ab":
            texts.append(" ".join([f"{side}{r.random()}" for _ in range(r.randrange(30))] + common + [f"{side}{r.random()}" for _ in range(r.randrange(30))]))
    df = winnowing.fingerprint(rows(spark, texts, step=1), "text", "f").select("doc_id", winnowing.hashes("f").alias("h"))
    got = {x.doc_id: set(x.h) for x in df.collect()}
    assert all(got[2 * k] & got[2 * k + 1] for k in range(40))


def test_winnowing_bears_nothing_and_equal_ids(spark):
    df = rows(spark, mixed_texts())
    assert winnowing.compare_with_edits(df.limit(0)).count() == 0
    assert winnowing.compare_with_edits(df.union(df)).count() == 2 * df.count()
    assert spark.createDataFrame([], CLASHING).count() == 0
    same = winnowing.fingerprint(df, "text", "f").groupBy("text").agg(F.count_distinct("f").alias("n"))
    assert same.where("n > 1").count() == 0


def test_gram_hashes_of_every_width(spark):
    df = rows(spark, ["a b c d e f g h i", "a", "", None], step=1).withColumn("words", F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""), lambda x: F.xxhash64(x)))
    for k in range(1, 10):
        got = {r.doc_id: r.g for r in winnowing.gram_hashes(df, "words", "g", k).collect()}
        assert [len(got[i]) for i in range(4)] == [10 - k, 1, 0, 0]
        assert len(set(got[0])) == 10 - k


def test_fingerprint_keeps_the_callers_columns(spark):
    df = rows(spark, mixed_texts())
    made = winnowing.fingerprint(df, "text", "print")
    assert made.columns == [*df.columns, "print"]
    assert made.select(*df.columns).exceptAll(df).isEmpty()


def test_rows_without_an_id(spark):
    df = rows(spark, mixed_texts()).withColumn("doc_id", F.when(F.col("doc_id") > 9, F.col("doc_id")))
    n, named = df.count(), df.where("doc_id is not null").count()
    assert pii.spans_by_document(df).count() == n
    assert winnowing.compare_with_edits(df).count() == named
    assert 0 < mixing.mix_documents(df, mixing.Mix(epochs=1)).count() <= n


def test_weights_must_be_positive_integers():
    for bad in ({"domains": {"d0": 0}}, {"sources": {"x": -1}}, {"languages": {"en": 1.5}}, {"epochs": 0}):
        with pytest.raises(ValueError):
            mixing.Mix(**bad)


def test_personal_data_query_equals_brute_force(spark, sf_dir):
    plain = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_pii(spark, sf_dir).collect():
        spans = base_spans(plain[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in spans) for kind in BASE]
        all_ = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert [tuple(x) for x in all_ if x[0] in BASE] == [(k, str(s), str(e)) for k, s, e in spans]
        assert all(int(s) < int(e) <= len(plain[r.doc_id]) for _, s, e in all_)
