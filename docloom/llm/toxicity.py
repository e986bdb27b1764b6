"""Toxicity: a counterfactual-regularised linear classifier over words and their beginnings.

A document's score is a logistic function of its distinct words' weights. In fitting, identity terms in
labelled sentences are swapped for other terms of their group, and the change of a sentence's score is
penalised, so that a neutral mention of a group doesn't raise it. Groups are the given ones (a parameter;
fixed lists of four languages by default) and those that learn_groups finds in the labelled texts: terms that
neutral documents mention too, but toxic ones clearly more often, beside terms of like neighbours that they don't.

It is fitted on a bounded sample of labelled rows (max_rows, max_chars, and no text of over a share of those
characters); every text is scored whole, whatever its length. Nulls are empty texts and score as the
intercept does; repeated rows score alike; ties of learned terms are broken by name; without labelled rows
or documents all scores are the intercept's; an empty table gives an empty table; columns other than the text
(and, in train, the id) are never read, and rows without an id are scored like others.
"""

from __future__ import annotations

import collections
import gc
import math
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, give_back, lean_memory
from docloom.llm.sampling import labelled_sample

DIM = 1 << 17
#: Groups of identity terms that may stand for one another.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("musulman", "chrétien", "juif", "femme", "homme"),
    ("muslimisch", "christlich", "jüdisch", "frau", "mann"),
    ("musulmán", "cristiano", "judío", "mujer", "hombre"),
)
Groups = Iterable[Sequence[str]]
_words = re.compile(r"\w+").findall
_sentences = re.compile(r"[^.!?\n]+").findall


def word_features(word: str) -> list[int]:
    """Hashed slots of a lower-case word: itself, and its first four and five letters."""
    return [zlib.crc32(f"{kind}{part}".encode()) % DIM for kind, part in (("w", word), ("4", word[:4]), ("5", word[:5])) if kind == "w" or len(word) > int(kind)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def weight(self, word: str) -> float:
        return float(sum(self.weights[i] for i in word_features(word)))

    def score(self, text: str | None) -> float:
        return _squash(self.bias + sum(self.weight(w) for w in set(_words((text or "").lower()))))


def _squash(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def swap_table(groups: Groups) -> dict[str, list[str]]:
    """Each term's partners: all others of its groups."""
    out: dict[str, list[str]] = {}
    for group in groups:
        for term in group:
            mine = out.setdefault(term, [])
            mine.extend(t for t in group if t != term and t not in mine)
    return out


def learn_groups(texts: list[str], labels: list[int], least: int = 20, most_terms: int = 40, partners: int = 3, odds: float = 1.5, vocabulary: int = 20_000) -> list[tuple[str, ...]]:
    """Groups that stand in the labelled texts: a term mentioned by least neutral and least toxic documents at least,
    by toxic ones odds times as often, with the partners of most similar neighbours whose own odds are lower.

    Of the vocabulary's most frequent words, most_terms terms of highest odds make groups. A word that neutral documents
    don't use, such as an insult, is never one. Neighbours are the words beside a term, by cosine of their counts.
    """
    seen = (collections.Counter(), collections.Counter())
    n = [0, 0]
    # Texts are cut twice rather than all their words held at once.
    for text, y in zip(texts, labels, strict=True):
        seen[y].update(set(_words(text.lower())))
        n[y] += 1
    if not min(n):
        return []
    usual = sorted((w for w in seen[0] if seen[0][w] >= least and seen[1][w] >= least), key=lambda w: (-seen[0][w] - seen[1][w], w))[:vocabulary]
    ratio = {w: (seen[1][w] / n[1]) / (seen[0][w] / n[0]) for w in usual}
    terms = sorted((w for w in usual if ratio[w] >= odds), key=lambda w: (-ratio[w], w))[:most_terms]
    place = {w: k for k, w in enumerate(usual)}
    # Neighbours fold into a fixed number of slots, so the table of contexts is bounded.
    slots = 256
    context = np.zeros((len(usual), slots), np.float32)
    for text in texts:
        words = _words(text.lower())
        for at, w in enumerate(words):
            k = place.get(w)
            if k is not None:
                for beside in (at - 1, at + 1):
                    if 0 <= beside < len(words):
                        context[k, zlib.crc32(f"{beside - at}{words[beside]}".encode()) % slots] += 1
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    groups = []
    for term in terms:
        like = context @ context[place[term]]
        lower = sorted((w for w in usual if ratio[w] < ratio[term] / odds), key=lambda w: (-float(like[place[w]]), w))[:partners]
        if lower:
            groups.append((term, *lower))
    return groups


def swapped_pairs(texts: list[str], swap: dict[str, list[str]], seed: int = 7, most_of_one: int = 40) -> list[tuple[str, str, frozenset[str]]]:
    """(term, other, the sentence's words): in each sentence each term with one of its partners; most_of_one sentences of a term."""
    rng = np.random.default_rng(seed)
    taken: collections.Counter = collections.Counter()
    out = []
    for text in texts:
        for sentence in _sentences(text.lower()):
            words = frozenset(_words(sentence))
            for term in sorted(words & swap.keys()):
                if taken[term] < most_of_one:
                    taken[term] += 1
                    out.append((term, swap[term][int(rng.integers(len(swap[term])))], words))
    return out


def fit(texts: list[str], labels: list[int], swaps_weight: float = 1.0, epochs: int = 6, rate: float = 0.2, shrink: float = 5e-4, seed: int = 7, groups: Groups = IDENTITY_GROUPS, learn: bool = True) -> Model:
    """Adagrad on the log loss, plus swaps_weight times the squared change of the score (before the logistic) under swaps."""
    slots: dict[str, list[int]] = {}

    def rows_of(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots and how many of the words' features fall on each."""
        for w in set(words).difference(slots):
            slots[w] = word_features(w)
        found, times = np.unique(np.array([i for w in words for i in slots[w]], np.int32), return_counts=True)
        return found, times.astype(np.float32)

    rng = np.random.default_rng(seed)
    swap = swap_table([*groups, *(learn_groups(texts, labels) if learn else ())])
    docs = [(rows_of(set(_words(text.lower()))), float(label)) for text, label in zip(texts, labels, strict=True)]
    swaps = [(rows_of({term}), rows_of({other} - words)) for term, other, words in swapped_pairs(texts, swap, seed)]
    share = min(max(sum(y for _, y in docs) / max(len(docs), 1), 1e-3), 1 - 1e-3)
    w, g, bias = np.zeros(DIM), np.full(DIM, 1e-2), math.log(share / (1 - share)) - 1.0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            (rows, times), y = docs[k]
            old = w[rows]
            step = _squash(bias + float(old @ times)) - y
            down = step * times
            g[rows] = spread = g[rows] + times * (step * step)
            new = old - rate * down / np.sqrt(spread)
            w[rows] = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
            bias -= 0.02 * step
        for (out, m), (put, n) in swaps:
            change = float(w[out] @ m - w[put] @ n)
            pull = swaps_weight * change / (len(out) + len(put))
            w[out] -= pull
            w[put] += pull
    return Model(w.astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 24_000_000, groups: Groups = IDENTITY_GROUPS, swaps_weight: float = 1.0) -> Model:
    """Fitted on labelled_sample's rows, at most max_rows and max_chars; groups are joined by those learned from these rows."""
    bounded_batches(docs.sparkSession)
    model = fit(*labelled_sample(docs, labels, "toxic", max_rows, max_chars), swaps_weight=swaps_weight, groups=groups)
    gc.collect()
    give_back()
    return model


MOST_KNOWN = 100_000


def score_column(model: Model, text: str = "text") -> Column:
    """The score of every whole text; the model is 2^17 weights at any size of the corpus, and a task remembers MOST_KNOWN words' weights."""
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lean_memory()
        m, known = Model(weights, bias), {}
        for texts in batches:
            scores = np.empty(len(texts))
            for k, text in enumerate(texts):
                words = set(_words(text.lower()))
                for w in words.difference(known):
                    known[w] = m.weight(w)
                scores[k] = _squash(bias + math.fsum(map(known.__getitem__, words)))
                if len(known) > MOST_KNOWN:
                    known.clear()
            yield pd.Series(scores)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(F.coalesce(F.col(text), F.lit("")))
