"""Toxicity: a counterfactually regularised linear classifier over words and word beginnings.

Training sentences that name a group of people are rewritten with another group's name. Besides the
usual loss, the fit is penalised for the squared change of score between a sentence and its rewritten
form, so naming a group neither raises nor lowers a score.

Features are words and their first four to seven letters. A feature's value grows with its share of
the text's words and levels off, so one rare word in a long text counts for less than in a short one. Features
are those clearly more frequent in toxic training texts, and all names of groups that occur.

The fit uses at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their key;
scoring covers every whole text.

Defined cases: null and empty texts get the score of a text without features; repeated rows are scored
alike; labels that are null, or of unknown keys, are not used; where a key has several texts the
smallest is learned from; without labels of both kinds every score is the share of toxic labels,
0 without any; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propstats.llm.common import stored

#: At most so many labelled rows are learned from, and so many features kept.
MAX_LABELLED = 20_000
MAX_FEATURES = 4_000
#: A feature is seen in this share of the toxic texts at least, and stands out by so many deviations.
LEAST_SHARE, LEAST_Z = 0.005, 5.0
PREFIXES = (4, 5, 6, 7)
#: A feature's value is the root of its share of words times this, 1 at most.
SATURATION = 25.0
L2, COUNTERFACTUAL, STEPS = 2e-4, 1.0, 400

#: Names of groups that can stand for one another, by kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "african", "hispanic", "latino", "arab", "european", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("immigrant", "refugee", "foreigner", "migrant"),
    ("immigrants", "refugees", "foreigners", "migrants"),
    ("mexican", "american", "chinese", "indian", "russian", "german", "french", "turkish", "polish", "nigerian"),
    ("disabled", "blind", "deaf", "autistic"),
    ("elderly", "old", "young", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "migranten", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
)
_OTHER = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word, *["^" + word[:n] for n in PREFIXES if len(word) >= n]]


def value(count: int, n_words: int) -> float:
    return math.sqrt(min(1.0, SATURATION * count / (n_words + 4)))


class _Lookup(dict):
    """Feature numbers of each word, found once; it forgets all beyond a bound."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        found = tuple(self.numbers[f] for f in features_of(word) if f in self.numbers)
        self[word] = found
        return found


def counted(words: list[str], lookup: _Lookup) -> Counter:
    return Counter(i for found in map(lookup.__getitem__, words) if found for i in found)


@dataclass
class Model:
    """Weights by feature. ``bias`` alone scores a text without features."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    def scorer(self):
        numbers = {f: i for i, f in enumerate(self.weights)}
        weights, lookup = list(self.weights.values()), _Lookup(numbers)

        def score(text: str | None) -> float:
            words = WORD.findall(text.lower()) if text else []
            z = self.bias + sum(weights[i] * value(n, len(words)) for i, n in counted(words, lookup).items())
            return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))

        return score


def _feature_counts(wanted: set[str] | None):
    """For each feature (of ``wanted``, or all), in how many of a partition's texts it occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["t"]:
                found = {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}
                seen.update(found if wanted is None else found & wanted)
        yield pd.DataFrame({"f": list(seen.keys()), "n": list(seen.values())})

    return run


def _vectors(numbers: dict[str, int]):
    """Sparse rows of the sample: the texts (kind = their label) and the counterfactual changes (kind = -1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = _Lookup(numbers)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["t"], batch["toxic"], strict=True):
                low = text.lower()
                words = WORD.findall(low)
                found = counted(words, lookup)
                rows.append((int(toxic), list(found), [value(n, len(words)) for n in found.values()]))
                if _OTHER.keys().isdisjoint(words):
                    continue
                for sentence in SENTENCE.split(low):
                    words = WORD.findall(sentence)
                    if _OTHER.keys().isdisjoint(words):
                        continue
                    here, there = counted(words, lookup), counted([_OTHER.get(w, w) for w in words], lookup)
                    change = {i: value(here[i], len(words)) - value(there[i], len(words)) for i in here.keys() | there.keys()}
                    change = {i: d for i, d in change.items() if d}
                    if change:
                        rows.append((-1, list(change), list(change.values())))
            yield pd.DataFrame(rows, columns=["kind", "at", "x"])

    return run


def _fit(rows: pd.DataFrame, n_features: int) -> tuple[np.ndarray, float]:
    """Logistic regression with ridge and counterfactual penalties, by accelerated gradient descent."""

    def sparse(part: pd.DataFrame):
        sizes = np.array([len(a) for a in part["at"]], dtype=np.int64)
        row = np.repeat(np.arange(len(part)), sizes)
        at = np.concatenate([np.asarray(a, dtype=np.int64) for a in part["at"]]) if len(row) else np.zeros(0, np.int64)
        x = np.concatenate([np.asarray(a, dtype=float) for a in part["x"]]) if len(row) else np.zeros(0)
        return row, at, x

    texts, pairs = rows[rows["kind"] >= 0].sort_values("kind", kind="stable"), rows[rows["kind"] < 0]
    y, n, m = texts["kind"].to_numpy(dtype=float), len(texts), max(1, len(pairs))
    (row, at, x), (pair, pat, px) = sparse(texts), sparse(pairs)
    w, bias = np.zeros(n_features), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    ahead, ahead_bias = w, bias
    # The curvature of every coordinate is at most that of the densest rows.
    norm = np.bincount(row, x * x, n).max(initial=0.0) + 1.0
    penalty = np.bincount(pair, px * px, len(pairs)).max(initial=0.0) if len(pairs) else 0.0
    step = 1.0 / (0.25 * norm + L2 + COUNTERFACTUAL * penalty)
    for k in range(STEPS):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(row, ahead[at] * x, n) + ahead_bias, -50, 50)))
        error = (p - y) / n
        gradient = np.bincount(at, error[row] * x, n_features) + L2 * ahead
        if len(pairs):
            change = np.bincount(pair, ahead[pat] * px, len(pairs)) / m
            gradient += COUNTERFACTUAL * np.bincount(pat, change[pair] * px, n_features)
        new, new_bias = ahead - step * gradient, ahead_bias - step * error.sum()
        momentum = k / (k + 3.0)
        ahead, ahead_bias = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the labelled rows of ``labels`` (``key``, ``toxic``) whose texts ``docs`` has.

    The driver sees counts of features, and sparse rows of the sample; ``max_labelled`` bounds both.
    """
    labelled = labels.select(F.col(key).alias("k"), F.col("toxic").cast("int").alias("toxic")).na.drop().where("toxic IN (0, 1)").distinct()
    chosen = labelled.orderBy(F.xxhash64("k"), "k", "toxic").limit(max_labelled)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    sample = stored(texts.join(F.broadcast(chosen), "k").groupBy("k", "toxic").agg(F.min("t").alias("t")), "toxicity")
    seen = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = seen.get(1, 0), seen.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Model({}, 20.0 if share == 1.0 else -20.0)

    def counts(of: DataFrame, wanted: set[str] | None, least: int) -> dict[str, int]:
        found = of.select("t").mapInPandas(_feature_counts(wanted), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
        return {r.f: r.n for r in found.where(F.col("n") >= least).collect()}

    # A feature seen in this share of the toxic texts or more: there are no more than a text's features over the share.
    toxic = counts(sample.where("toxic = 1"), None, max(3, math.ceil(LEAST_SHARE * n_toxic)))
    clean = counts(sample.where("toxic = 0"), set(toxic), 1)
    ranked = []
    for f, a in toxic.items():
        p, q = a / n_toxic, (clean.get(f, 0) + 0.5) / (n_clean + 1.0)
        z = (p - q) / math.sqrt(q * (1 - q) / n_toxic + q * (1 - q) / n_clean)
        if z >= LEAST_Z:
            ranked.append((-z, f))
    kept = [f for _, f in sorted(ranked)[:MAX_FEATURES]]
    names = ["=" + term for kind in IDENTITY_TERMS for term in kind]
    numbers = {f: i for i, f in enumerate(dict.fromkeys(kept + names))}
    rows = sample.mapInPandas(_vectors(numbers), "kind int, at array<int>, x array<double>").toPandas()
    w, bias = _fit(rows, len(numbers))
    return Model({f: float(w[i]) for f, i in numbers.items() if w[i]}, float(bias))


def score(text: Column, model: Model) -> Column:
    """The score of a text, 0 to 1."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        scorer = model.scorer()
        return pd.Series([scorer(t) for t in texts], dtype=float)

    return of(text.cast("string"))


def held_out(key: Column) -> Column:
    """Whether a key is kept from learning: the CRC-32 of its text is a multiple of five. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
