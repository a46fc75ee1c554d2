"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Models are first-order. Ordinary identifiers are learnt from every text: each run of the characters of long tokens
that no fixed pattern holds is a sample, long tokens included, and a share of them once more in capitals, as constants are
written. Random strings are labelled in two ways. What a fixed pattern holds is one sample; it is all of one kind in some
corpora. So each documented format of keys (``FORMATS``) is a model of its own too, that of values drawn evenly from its
characters. A token's score is that of the likeliest random model over the ordinary one, and a further long token
is a secret from ``MARGIN`` nats on.

Nothing is made of what is not known: a transition counts as far as the ordinary model has seen its first character, models
that learn are smoothed alike, repeated characters say nothing, and signs nothing by formats. One pass over the texts finds the
fixed spans, the long tokens and the counts; later steps see only those.

Defined cases: a null text is empty and has no spans; an empty table gives no rows; without any
fixed match only the formats stand for random strings; repeated rows are scanned alike;
a null id stays null. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propstats.llm.common import stored

#: The base patterns in their listed order, the group that is measured and its least length.
BASE = (
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
        ),
        2,
        12,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    # The runs of this pattern are maximal, so asking for the length at once finds the same ones.
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = ("assign", "access", "hex", "markov")
LONG_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIZE = len(ALPHABET) + 1
#: The characters of keys as they are issued, in letters of both cases, in capitals, in small letters.
FORMATS = (
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789",
)
#: The odds of a thousand to one that a token is no secret, in nats, for each of the random models.
MARGIN = float(np.log(1000.0 * (1 + len(FORMATS))))
#: So many of the ordinary transitions are taken for capitals as well.
CAPITALS = 0.05
#: A row of n transitions weighs n / (n + TRUST): the few that a judged token adds itself must not decide on it.
TRUST = 500.0
#: The share of the common background in a model's characters.
BACKGROUND = 0.1

_CODES = np.full(256, SIZE - 1, dtype=np.int64)
_CODES[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(SIZE - 1)
_WORD = np.zeros(256, dtype=bool)
_WORD[np.frombuffer(ALPHABET[:-1].encode(), dtype=np.uint8)] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, in reading order."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def _transitions(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def _ordinary(raw: np.ndarray) -> np.ndarray:
    """Transition counts within runs of token characters; whatever lies between them has the code that is left out."""
    codes = np.where(_WORD[raw], _CODES[raw], SIZE - 1)
    return _transitions(codes) if len(codes) > 1 else np.zeros(SIZE * SIZE, np.int64)


def _collected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        random = np.zeros(SIZE * SIZE, dtype=np.int64)
        ordinary = np.zeros(SIZE * SIZE, dtype=np.int64)
        for text in batch["t"].fillna(""):
            spans = base_spans(text)
            tokens = []
            at, rest = 0, []
            for start, end, kind in spans:
                value = text[start:end]
                if kind == 0:
                    value = BASE[0][1].match(value)[2]
                random += _transitions(_CODES[np.frombuffer(value.encode(), dtype=np.uint8)])
                rest.append(text[at:start])
                at = max(at, end)
            rest.append(text[at:])
            raw = np.frombuffer(" ".join(rest).encode(), dtype=np.uint8)
            ordinary += _ordinary(raw)
            # Both lists rise: of the spans only those that end after a token's start still matter.
            pending = iter(sorted((start, end) for start, end, _ in spans))
            reach, following = 0, next(pending, None)
            for m in LONG_TOKEN.finditer(text):
                while following is not None and following[0] < m.end():
                    reach, following = max(reach, following[1]), next(pending, None)
                if reach <= m.start():
                    tokens.append((m.start(), m.end(), m[0]))
            rows[0].append([s[0] for s in spans])
            rows[1].append([s[1] for s in spans])
            rows[2].append([s[2] for s in spans])
            rows[3].append([{"start": s, "end": e, "text": x} for s, e, x in tokens])
        yield pd.DataFrame(
            {"counts": False, "k": batch["k"], "starts": rows[0], "ends": rows[1], "kinds": rows[2], "tokens": rows[3], "cells": None, "random": None, "ordinary": None}
        )
        cells = np.flatnonzero(random + ordinary)
        yield pd.DataFrame(
            {"counts": [True], "k": [None], "starts": [None], "ends": [None], "kinds": [None], "tokens": [None], "cells": [cells], "random": [random[cells]], "ordinary": [ordinary[cells]]}
        )


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Log of random over ordinary transition probability, SIZE x SIZE, from counts of shape (2, SIZE * SIZE).

    A model's characters are mixed with a background that both share. A transition is mixed with its second
    character's own frequency, by a weight that both share too: that of the model which knows the first
    character less. So what neither model has seen has ratio 0, however much larger one of them is.
    """
    both = counts.reshape(2, SIZE, SIZE)[:, :-1, :-1].astype(float)
    own = both.sum(axis=1, keepdims=True)
    total = own.sum(axis=2, keepdims=True)
    background = ((own + 1.0) / (total + SIZE - 1)).mean(axis=0, keepdims=True)
    own = np.where(total > 0, (1 - BACKGROUND) * own / np.maximum(total, 1) + BACKGROUND * background, background)
    seen = both.sum(axis=2, keepdims=True)
    trust = (seen / (seen + TRUST)).min(axis=0, keepdims=True)
    both = np.log(trust * both / np.maximum(seen, 1) + (1 - trust) * own)
    return np.pad(both[0] - both[1], ((0, 1), (0, 1)))


def format_ratios(ordinary: np.ndarray) -> np.ndarray:
    """For each format, log of its even transition probability over the ordinary one, from counts of SIZE * SIZE."""
    counts = ordinary.reshape(SIZE, SIZE)[:-1, :-1].astype(float)
    counts[26:52, 26:52] += CAPITALS * counts[:26, :26]
    seen, own = counts.sum(axis=1, keepdims=True), counts.sum(axis=0, keepdims=True)
    own = (own + 1.0) / (own.sum() + SIZE - 1)
    trust = seen / (seen + TRUST)
    known = np.log(trust * counts / np.maximum(seen, 1) + (1 - trust) * own)
    letters = len(FORMATS[0])
    out = np.zeros((len(FORMATS), SIZE, SIZE))
    for ratios, form in zip(out, FORMATS):
        ratios[:letters, :letters] = (trust * (-np.log(len(form)) - known))[:letters, :letters]
        ratios[range(letters), range(letters)] = 0.0
        # A letter that the format lacks rules it out.
        outside = [i for i in range(letters) if ALPHABET[i] not in form]
        ratios[outside, :] = ratios[:, outside] = -1e9
    return out


def token_score(token: str, ratios: np.ndarray) -> float:
    codes = _CODES[np.frombuffer(token.encode(), dtype=np.uint8)]
    return float(ratios[:, codes[:-1], codes[1:]].sum(axis=1).max())


def _collect(docs: DataFrame, key: str, text: str) -> DataFrame:
    id_type = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(
        _collected,
        f"counts boolean, k {id_type}, starts array<int>, ends array<int>, kinds array<int>, "
        "tokens array<struct<start:int,end:int,text:string>>, cells array<long>, random array<long>, ordinary array<long>",
    )


def _ratios(collected: DataFrame) -> np.ndarray | None:
    """The log ratios of the learnt random model and of each format; None without any text."""
    # At most SIZE x SIZE rows, whatever the corpus.
    counted = (
        collected.where("counts")
        .select(F.explode(F.arrays_zip("cells", "random", "ordinary")).alias("c"))
        .groupBy("c.cells")
        .agg(F.sum("c.random").alias("random"), F.sum("c.ordinary").alias("ordinary"))
        .collect()
    )
    counts = np.zeros((2, SIZE * SIZE))
    for row in counted:
        counts[:, row[0]] = row[1], row[2]
    if not counts.any():
        return None
    learnt = log_ratio(counts) if counts[0].sum() else np.zeros((SIZE, SIZE))
    np.fill_diagonal(learnt, 0.0)
    return np.concatenate([learnt[None], format_ratios(counts[1])])


def train(docs: DataFrame, text: str = "text") -> np.ndarray | None:
    """The log ratios that ``docs`` teach; a few thousand numbers."""
    return _ratios(_collect(docs.select(F.lit(None).cast("int").alias("k"), text), "k", text))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per row of ``docs``: key and spans, array<struct<start, end, kind>> by start, then kind."""
    found = stored(_collect(docs, key, text), "secrets")
    ratios = _ratios(found)

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def all_spans(starts: pd.Series, ends: pd.Series, kinds: pd.Series, tokens: pd.Series) -> pd.Series:
        out = []
        for a, b, c, t in zip(starts, ends, kinds, tokens, strict=True):
            spans = list(zip(a, b, c, strict=True))
            if ratios is not None:
                spans += [(x["start"], x["end"], 3) for x in t if token_score(x["text"], ratios) >= margin]
            out.append([{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in sorted(spans, key=lambda x: (x[0], x[2]))])
        return pd.Series(out)

    return found.where(~F.col("counts")).select(F.col("k").alias(key), all_spans("starts", "ends", "kinds", "tokens").alias("spans"))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return scanned.select(
        key, *[count(kind) for kind in KINDS[:3]], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")
    )


def redacted(text: Column, ratios: np.ndarray | None, margin: float = MARGIN) -> Column:
    """The text with each secret replaced by ``[SECRET]``; overlapping spans become one, null stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            spans = [(s, e) for s, e, _ in base_spans(text)] if text else []
            if text and ratios is not None:
                spans += [(m.start(), m.end()) for m in LONG_TOKEN.finditer(text) if token_score(m[0], ratios) >= margin]
            out.append(replaced(text, spans) if spans else text)
        return pd.Series(out, dtype=object)

    return cut(text.cast("string"))


def redact(docs: DataFrame, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` without its secrets: one pass trains, the next replaces in place, and texts never move."""
    return docs.withColumn(text, redacted(F.col(text), train(docs, text), margin))


def replaced(text: str, spans: list[tuple[int, int]], by: str = "[SECRET]") -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], by]
        at = end
    return "".join([*out, text[at:]])
