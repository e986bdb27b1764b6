"""Mixing sources to target weights: hierarchical budgets, then seeded prefixes of each leaf's tokens.

The tree is domain, language, source. Top-down, a node's budget is shared among its children by weight;
a child gets no more than its capacity (its leaves' tokens times the allowed epochs), and what it can't
take goes to its siblings by their weights. A parent's capacity is its children's, so a shortage reaches an
ancestor's siblings only when no sibling has room. A leaf's allotment is taken from whole epochs and then
the prefix of one more, each epoch in an order of its own: md5 of seed, epoch, doc_id and the text's own md5.

Only DataFrame functions. Leaves' facts are one row for each leaf. A leaf of any size is cut by buckets of
its order, as many as the root of its rows; only the one bucket that holds the cut is sorted.

Nulls in domain, language or source are the empty name; null and empty texts have no tokens and are never
chosen; a text longer than what is left is cut to it (take_tokens); rows that repeat an id and text stand
at one place and are taken alike; an empty table gives an empty result; extra columns are not used.
Weights that aren't named are 1; a weight that isn't a positive integer raises. Rows without an id count
and are taken like others, by their text's md5 alone. choose_documents loses texts without words, as these are never chosen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize

LEAF = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"
MOST_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level; the budget is tokens * share_of / share_in; epochs at most for each leaf."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 2})
    sources: dict[str, int] = field(default_factory=dict)
    share_of: int = 3
    share_in: int = 5
    epochs: int = 2
    seed: int = 17

    def __post_init__(self) -> None:
        numbers = [*self.domains.values(), *self.languages.values(), *self.sources.values(), self.share_in, self.epochs]
        if any(not isinstance(x, int) or x < 1 for x in numbers) or self.share_of < 0:
            raise ValueError("weights, share_in and epochs are integers of 1 at least, share_of of 0 at least")


def domain_of(source: str = "source") -> Column:
    """d0 to d3 by the number that a source's name ends with."""
    return F.concat(F.lit("d"), F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '([0-9]{{1,9}})$', 1) as bigint)"), F.lit(0)) % 4)


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, mark): what mixing needs of a document, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.md5(text.cast("binary")).alias("mark"))
    return named.withColumn("domain", domain_of())


def _weight(level: str, named: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in sorted(named.items()):
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds given: children (name, capacity, weight, budget of the parent) filled by weight up to capacity.

    In order of capacity for each weight those that fill up come first; the others share the rest.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("capacity").cast("double") / F.col("weight")), name)
    everyone = Window.partitionBy(*parent)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    t = (
        children.withColumn("rank", F.row_number().over(order))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("parts", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", big("capacity") * big("parts") > big("left") * big("weight"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("rank", "left", "parts"))).over(everyone))
    )
    share = F.expr("(cast(first.left as decimal(19,0)) * cast(weight as decimal(19,0))) div first.parts")
    filled = F.col("first").isNull() | (F.col("rank") < F.col("first.rank"))
    return t.withColumn("given", F.when(filled, F.col("capacity")).otherwise(share)).drop("rank", "left", "parts", "open", "first")


def allot(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (domain, lang, source, n_docs, tokens) with given, their allotments."""
    t = leaves.where(F.col("tokens") > 0).withColumn("capacity", F.col("tokens") * mix.epochs).withColumn("root", F.lit(0))
    domains = t.groupBy("root", "domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("budget", F.expr(f"(sum(tokens) over (partition by root) * {mix.share_of}) div {mix.share_in}")).withColumn("weight", _weight("domain", mix.domains))
    domains = _fill(domains, ["root"], "domain").select("domain", F.col("given").alias("budget"))
    langs = t.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains, "domain").withColumn("weight", _weight("lang", mix.languages))
    langs = _fill(langs, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    t = t.join(langs, ["domain", "lang"]).withColumn("weight", _weight("source", mix.sources))
    return _fill(t, ["domain", "lang"], "source").select(*LEAF, "n_docs", "tokens", "given")


def _key(mix: Mix, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), epoch, F.col("doc_id"), F.col("mark")).cast("binary"))


def _spread(df: DataFrame) -> DataFrame:
    """A hint to send leaves' facts to every task, where they are few enough; counted first."""
    return F.broadcast(df) if df.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES else df


def _cuts(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """(leaf, cut_key, cut_take): where each leaf's unfinished epoch ends, and how much of the last document it takes."""
    partial = leaves.where(F.col("rest") > 0)
    placed = (
        rows.join(partial, LEAF)
        .withColumn("key", _key(mix, F.col("whole")))
        .withColumn("buckets", F.ceil(F.sqrt("n_docs")))
        .withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 32)))
    )
    sums = placed.groupBy(*LEAF, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket")) - F.col("n"))
    crossing = sums.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).select(*LEAF, "bucket", "before")
    inside = placed.join(crossing, [*LEAF, "bucket"]).groupBy(*LEAF, "key", "rest", "before").agg(F.sum("n_tokens").alias("n"))
    inside = inside.withColumn("before", F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("key")) - F.col("n"))
    last = inside.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    return last.select(*LEAF, F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_take"))


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """Leaves with whole epochs and the cut of the next; rows is what facts() gives, already written."""
    leaves = allot(rows.groupBy(*LEAF).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")), mix)
    leaves = materialize(leaves.withColumn("whole", F.expr("given div tokens")).withColumn("rest", F.col("given") % F.col("tokens")), "mix-leaves")
    cuts = _cuts(rows, leaves, mix)
    return materialize(leaves.join(cuts, LEAF, "left"), "mix-plan")


def _chosen(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    t = rows.where(F.col("n_tokens") > 0).join(_spread(leaves.where(F.col("given") > 0)), LEAF)
    last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    t = t.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    key = F.when(F.col("epoch") == F.col("whole"), _key(mix, F.col("epoch")))
    t = t.withColumn("key", key).where(F.col("key").isNull() | (F.col("key") <= F.col("cut_key")))
    return t.withColumn("take_tokens", F.when(F.col("key") == F.col("cut_key"), F.least("n_tokens", "cut_take")).otherwise(F.col("n_tokens")))


def mix_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens), one row for each document and epoch it is taken in."""
    mix = mix or Mix()
    rows = materialize(facts(docs), "mix-facts")
    return _chosen(rows, plan(rows, mix), mix).select("doc_id", *LEAF, F.col("epoch").cast("long"), "n_tokens", "take_tokens")


def choose_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of docs that a single epoch's prefixes reach, whole, with docs' own columns; texts aren't shuffled."""
    if mix.epochs != 1:
        raise ValueError("rows are chosen at most once: epochs must be 1")
    rows = materialize(facts(docs), "mix-facts")
    kept = docs.select(F.struct("*").alias("doc"), "doc_id", "text", "lang", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = kept.withColumn("mark", F.md5(text.cast("binary"))).withColumn("n_tokens", F.regexp_count(text, F.lit(WORD)).cast("long")).drop("text")
    kept = kept.withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("source", F.coalesce("source", F.lit(""))).withColumn("domain", domain_of())
    return _chosen(kept, plan(rows, mix), mix).select("doc.*")
