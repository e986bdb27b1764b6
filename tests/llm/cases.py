"""Small inputs with what operators must bear: nulls, empty, long, tied and repeated texts, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Columns whose names an operator might use for its own.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n string, ids string, bucket int, part int"
#: More such names, all of them longs.
MORE = ("row", "doc", "domain", "mark", "n_tokens", "epoch", "a", "b", "class", "component", "digest", "shard", "spans", "kind", "_w", "_g", "_m", "_bucket", "_salt", "_ghost", "_tie")


def rows(spark: SparkSession, texts: list[str | None], first: int = 0, step: int = 3, sources: tuple = ("src0", "src1", None), langs: tuple = ("en", "fr", None)) -> DataFrame:
    made = [(first + step * i, t, langs[i % len(langs)], sources[i % len(sources)], None if t is None else len(t), 0.5, "k", "n", "i", 1, 2) for i, t in enumerate(texts)]
    random.Random(1).shuffle(made)
    return spark.createDataFrame([(*m, *range(len(MORE))) for m in made], ", ".join([CLASHING, *(f"{c} long" for c in MORE)]))


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that meet under any polynomial hash modulo 2^64, from 1024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def write_tables(spark: SparkSession, folder: str, texts: list[str | None], **kwargs: object) -> str:
    """A folder of tables as the driver's, with these documents and labels of every second one."""
    docs = rows(spark, texts, **kwargs)
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = docs.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(doc_id % 3 = 0 as int) as toxic")
    labels.coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


def words(n: int, seed: int, vocabulary: int = 300) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def mixed_texts(seed: int = 4) -> list[str | None]:
    r = random.Random(seed)
    passage = words(60, 99)
    out: list[str | None] = [None, "", " \t\n", "one", "one two three four", "x" * 5000, words(6000, 5)]
    for g in range(12):
        base = words(r.choice([3, 5, 9, 30, 120]), g).split()
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = f"y{r.randrange(4)}"
            text = " ".join(w)
            out.append(text + (" " + passage if r.random() < 0.3 else ""))
    out += [out[-1], out[-1], "É ünïcode 😀 中文 ▁ text.", "Mixed CASE words, with Punctuation!"]
    return out
