r"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Only SQL functions. Each kind's pattern gives a text's matches and, by a split, what lies between; running
sums of both lengths are the positions in code points. Base spans (email, ip, card, phone) hold by pattern
and checksum alone; further kinds (iban by mod-97, ssn and a local phone by words nearby) need a score of at
least MIN_SCORE. Every span has a score. Patterns equal their plain forms: a look-behind lets a search begin
only where a run begins or the last match ended, and possessive repeats never step back, so a long run
costs linear time.

Nulls and empty texts have no spans; repeated rows are found out each; very long texts are whole rows of
one generator, so memory is a few texts; an empty table gives an empty table; columns other than id and
text are not used, and rows keep their own spans even where ids repeat or are null. Of one kind's overlapping
matches the leftmost holds; spans of different kinds may overlap, and those that start alike are in order of kind.

Rows are told apart by a number of their own (monotonically_increasing_id), which a task that is run again gives
alike only if it reads its rows in the same order; that holds for files. find_spans on a table made by a
shuffle without an order should be given a written one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SCORE = 0.5
CONTEXT = 40

#: The kinds in order; for each its pattern, what a text must contain, its first score, and the words that raise it.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|écri|correo"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", 0.7, "addr|host|server|ip\\b"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|carte|karte|tarjeta|credit"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "tel|phone|call|appel|anruf|móvil|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, 0.9, "iban|bank|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social security|tax id"),
    "local": (r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", None, 0.3, "tel|phone|call|appel|anruf|móvil|fax"),
}
BASE = ("email", "ip", "card", "phone")
ORDER = {kind: k for k, kind in enumerate(KINDS)}


def _proposed(kind: str, text: Column, matches: Column) -> Column:
    """Matches of one kind, each with the piece before it; the last entry has the piece behind the last match."""
    shape = "array<struct<kind:int,match:string,gap:bigint,before:string,after:string>>"
    both = F.arrays_zip(matches.alias("match"), F.split(text, KINDS[kind][0], -1).alias("piece"))
    made = F.transform(
        both,
        lambda x: F.struct(
            F.lit(ORDER[kind]).alias("kind"), x["match"].alias("match"), F.length(x["piece"]).cast("long").alias("gap"),
            F.substring(x["piece"], -CONTEXT, CONTEXT).alias("before"), F.substring(x["piece"], 1, CONTEXT).alias("after"),
        ),
    )
    return F.when(F.size(matches) > 0, made.cast(shape)).otherwise(F.array().cast(shape))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (capitals and digits) leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.regexp_extract_all(turned, F.lit("[A-Z0-9]"), F.lit(0)), F.lit(0), lambda a, c: step(a, c).cast("int")) == 1


def _confirmed(kind: str, match: Column) -> Column:
    """The checksum or the count of digits that a kind asks for."""
    digits = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return digits.between(16, 19) & luhn(_digits(match))
    if kind == "phone":
        return digits.between(8, 15)
    return mod97(F.regexp_replace(match, " ", "")) if kind == "iban" else F.lit(True)


def _by_kind(of: Callable[[str], Column]) -> Column:
    out = F.lit(None)
    for kind, k in ORDER.items():
        out = F.when(F.col("kind") == k, of(kind)).otherwise(out)
    return out


def _raised(kind: str, near: Column) -> Column:
    """The kind's first score, and 0.3 more where a word nearby speaks for it."""
    _, _, first, words = KINDS[kind]
    return F.least(F.lit(1.0), F.lit(first) + F.when(near.rlike(words), F.lit(0.3)).otherwise(F.lit(0.0)))


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, kind, start, end, match, score, base), one row for each span; rows without spans have one row of nulls."""
    t = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for kind, (pattern, needs, _, _) in KINDS.items():
        there = F.lit(True) if needs is None else F.contains(F.col("text"), F.lit(needs))
        t = t.withColumn(f"m_{kind}", F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    proposals = F.concat(*(_proposed(kind, F.col("text"), F.col(f"m_{kind}")) for kind in KINDS))
    rows = t.select("row", "doc_id", F.posexplode_outer(proposals).alias("at", "p")).select("row", "doc_id", "at", "p.*")
    whole = Window.partitionBy("row", "kind").orderBy("at")
    length = F.coalesce(F.length("match"), F.lit(0)).cast("long")
    placed = (
        rows.repartition("row")
        .withColumn("end", F.sum(F.col("gap") + length).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - length)
        .withColumn("after", F.lead("after").over(whole))
        .where(F.col("match").isNotNull() | F.col("kind").isNull())
        .withColumn("base", F.col("kind") < len(BASE))
        .withColumn("score", _by_kind(lambda kind: _raised(kind, F.lower(F.concat_ws(" ", "before", "after")))))
    )
    holds = F.col("kind").isNotNull() & F.coalesce(_by_kind(lambda kind: _confirmed(kind, F.col("match"))), F.lit(False)) & (F.col("base") | (F.col("score") >= MIN_SCORE))
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    kept = placed.withColumn("holds", holds)
    return kept.select("row", "doc_id", *(F.when(F.col("holds"), c).alias(n) for n, c in (("order", F.col("kind")), ("kind", names), ("start", F.col("start")), ("end", F.col("end")), ("match", F.col("match")), ("score", F.col("score")), ("base", F.col("base")))))


def spans_by_document(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, spans): all spans of each row of the input, in order of kind and start."""
    one = F.struct("order", "start", "end", "kind", "match", "score", "base")
    found = find_spans(docs, doc_id, text).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.when(F.col("kind").isNotNull(), one)).alias("spans"))
    return found.withColumn("spans", F.array_sort("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with the characters of every confirmed span replaced by its kind in brackets.

    Spans of all kinds, and the words nearby, are those of the text as it came. Spans that overlap give way as one, named after the longest.
    """
    free = lambda name: name if name not in {c.lower() for c in docs.columns} else free(f"{name}_")
    matches, spans = free("pii_matches"), free("pii_spans")
    found = []
    for kind, (pattern, needs, _, _) in KINDS.items():
        there = F.col(text).isNotNull() if needs is None else F.contains(F.col(text), F.lit(needs))
        found.append(F.when(there, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(kind))
    t = docs.withColumn(matches, F.struct(*found))
    t = t.withColumn(spans, F.concat(*(_placed(kind, F.col(text), F.col(matches)[kind]) for kind in KINDS)))
    return t.withColumn(text, F.when(F.size(spans) > 0, _let(_merged(F.col(spans)), lambda m: _cut(F.col(text), m))).otherwise(F.col(text))).drop(matches, spans)


#: Not a limit: lists are built in blocks of so many, as Spark copies a list for each entry that is added to it.
BLOCK = 512
SPANS = "array<struct<start:int,end:int,kind:int>>"


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _span(start: Column, end: Column, kind: Column) -> Column:
    return F.array(F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"))).cast(SPANS)


def _scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """step gives (next state, spans) for a state and an item; the spans of all items in order."""
    none = F.array().cast(SPANS)

    def one(a: Column, x: Column) -> Column:
        state, out = step(a["state"], x)
        return F.struct(state.alias("state"), F.concat(a["out"], out).alias("out"))

    def blocks(all_: Column) -> Column:
        block = lambda a, k: F.aggregate(F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)), F.struct(a["state"].alias("state"), none.alias("out")), one)
        add = lambda a, k: _let(block(a, k), lambda b: F.struct(b["state"].alias("state"), F.concat(a["out"], F.array(b["out"])).alias("out")))
        numbers = F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int"))
        return F.flatten(F.aggregate(numbers, F.struct(zero.alias("state"), F.array().cast(f"array<{SPANS}>").alias("out")), add, lambda a: a["out"]))

    return _let(items, blocks)


def _placed(kind: str, text: Column, matches: Column) -> Column:
    """The confirmed spans of one kind in a text, in code points."""
    none = F.array().cast(SPANS)

    def entries(pieces: Column) -> Column:
        both = F.zip_with(F.arrays_zip(matches.alias("match"), pieces.alias("piece")), F.slice(pieces, 2, 1 << 30), lambda x, after: F.struct(x["match"].alias("match"), x["piece"].alias("piece"), after.alias("next")))
        near = lambda x: F.lower(F.concat_ws(" ", F.substring(x["piece"], -CONTEXT, CONTEXT), F.substring(x["next"], 1, CONTEXT)))
        score = lambda x: F.lit(True) if kind in BASE else _raised(kind, near(x)) >= MIN_SCORE
        holds = lambda x: x["match"].isNotNull() & F.coalesce(_confirmed(kind, x["match"]), F.lit(False)) & score(x)
        return F.transform(both, lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.coalesce(F.length(x["match"]), F.lit(0)).alias("length"), holds(x).alias("holds")))

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        start = end + x["gap"]
        return start + x["length"], F.when(x["holds"], _span(start, start + x["length"], F.lit(ORDER[kind]))).otherwise(none)

    found = _let(F.split(text, KINDS[kind][0], -1), entries)
    some = _let(found, lambda e: F.when(F.exists(e, lambda x: x["holds"]), _scan(e, F.lit(0), step)).otherwise(none))
    return F.when(F.size(matches) > 0, some).otherwise(none)


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap as one of the longest's kind (of equally long ones, the first kind's)."""
    last = (1 << 31) - 1
    state = "struct<start:int,end:int,kind:int,longest:int>"

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        overlap, length = x["start"] < s["end"], x["end"] - x["start"]
        longer = (length > s["longest"]) | ((length == s["longest"]) & (x["kind"] < s["kind"]))
        wider = F.struct(s["start"], F.greatest(s["end"], x["end"]), F.when(longer, x["kind"]).otherwise(s["kind"]), F.greatest(s["longest"], length)).cast(state)
        new = F.struct(x["start"], x["end"], x["kind"], length).cast(state)
        return F.when(overlap, wider).otherwise(new), F.when(overlap | (s["kind"] < 0), F.array().cast(SPANS)).otherwise(_span(s["start"], s["end"], s["kind"]))

    items = F.concat(F.array_sort(spans), _span(F.lit(last), F.lit(last), F.lit(-1)))
    return _scan(items, F.struct(F.lit(-1), F.lit(-1), F.lit(-1), F.lit(-1)).cast(state), step)


def _cut(text: Column, spans: Column) -> Column:
    """A text with spans (in order, none overlapping) replaced, taken block by block, so that no span is looked for from the text's beginning."""
    names = F.array(*(F.lit(f"[{kind}]") for kind in KINDS))

    def block(k: Column) -> Column:
        start = F.coalesce(F.get(spans, k * BLOCK - 1)["end"], F.lit(0))
        end = F.coalesce(F.get(spans, (k + 1) * BLOCK - 1)["end"], F.length(text))
        return _let(F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("text"), F.slice(spans, k * BLOCK + 1, F.lit(BLOCK)).alias("spans")), parts)

    def parts(b: Column) -> Column:
        before = lambda i: F.coalesce(F.get(b["spans"], i - 1)["end"], b["start"])
        piece = lambda i, to: F.substring(b["text"], before(i) - b["start"] + 1, to - before(i))
        made = F.transform(b["spans"], lambda x, i: F.concat(piece(i, x["start"]), F.get(names, x["kind"])))
        return F.concat(F.array_join(made, ""), piece(F.size(b["spans"]), b["end"]))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(spans) / BLOCK).cast("int")), block), "")
