"""Quality rules: fixed base rules, and the log-likelihood ratio of hashed n-grams.

Single words and word pairs are hashed into ``CELLS`` cells. Two multinomials over the cells, one of
trusted texts and one of the whole corpus, give each text a log-likelihood ratio, divided by its
number of n-grams. The threshold lies midway between the ratio that all but ``LOST_SHARE`` of the trusted
texts reach and the one that all but ``MISSED_SHARE`` of the texts labelled bad stay below; where
these overlap, the first alone decides. Each text's verdict thus follows from the tables.

Counts and thresholds cover every text and every labelled row; labels are joined on by shuffles. Each order
statistic is found in ranges of the ratio: a range's rows are counted in ``PARTS`` parts, and the part that holds
the wanted position is the next range, until it is a single value.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows get equal
verdicts; labels that are null or of unknown keys are not used; a key labelled both ways is
bad; without trusted texts the ratio is 0
and the base rules alone decide; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propstats.llm.common import WHITE_SPACE, mix, slices, stored, text_buffers, word_hashes, word_spans

CELLS = 1 << 16
PARTS = 1024
LOST_SHARE, MISSED_SHARE = 0.002, 0.05
#: The symbols that are counted, the words in a window, the least words, the most repeats in percent.
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATS = 5, 10, 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(WHITE_SPACE)] = False
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(64 - 16)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five found at least twice in the text."""
    windows = list(zip(*[words[i:] for i in range(WINDOW)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total, upto = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            total += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return total


def base_row(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text's UTF-8 bytes."""
    words = data.split()
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    # Code points are the bytes that do not continue one; white space is one byte each.
    continued = np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) == 0x80)
    chars = sum(map(len, words)) - int(continued)
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), again, repeated_words(words)


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each n-gram of a batch, and its text's number."""
    starts, ends, text = word_spans(raw, offsets, _IS_WORD)
    single = word_hashes(raw, starts, ends)
    same = np.flatnonzero(text[:-1] == text[1:])
    pairs = mix(single[same] * _PAIR + single[same + 1])
    return (np.concatenate([single, pairs]) >> _SHIFT).astype(np.int64), np.concatenate([text, text[same]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in slices(batches):
        cells, _ = grams(*text_buffers(batch.column("t")))
        counts += np.bincount(cells, minlength=CELLS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": counts[at]})


def cell_counts(texts: DataFrame) -> np.ndarray:
    """How many n-grams of the texts ``t`` fall into each cell."""
    counted = texts.select("t").mapInArrow(_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # As many rows as there are cells, whatever the corpus.
    counts = np.zeros(CELLS)
    for row in counted.collect():
        counts[row.cell] = row.n
    return counts


def _scores(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = text_buffers(batch.column("t"))
            cells, text = grams(raw, offsets)
            n = len(offsets) - 1
            sizes = np.bincount(text, minlength=n)
            sums = np.bincount(text, ratios[cells], minlength=n)
            data = raw.tobytes()
            base = np.array([base_row(data[offsets[i] : offsets[i + 1]]) for i in range(n)], dtype=np.int64).reshape(n, 5)
            columns = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), base.T.copy(), strict=True))
            yield pa.RecordBatch.from_pydict({"k": batch.column("k")} | columns | {"ratio": sums / np.maximum(1, sizes)})

    return run


def nth(values: DataFrame, at: int) -> float:
    """The value at a position (from 0) of the sorted column ``ratio``; at most ``PARTS`` rows reach the driver at a time."""
    low, high = values.agg(F.min("ratio"), F.max("ratio")).head()
    while low < high:
        part = F.least(F.floor((F.col("ratio") - low) / max((high - low) / PARTS, 5e-324)), F.lit(PARTS - 1))
        parts = values.where(F.col("ratio").between(low, high)).groupBy(part.alias("part"))
        for row in sorted(parts.agg(F.count(F.lit(1)).alias("n"), F.min("ratio").alias("low"), F.max("ratio").alias("high")).collect()):
            if at < row.n:
                low, high = row.low, row.high
                break
            at -= row.n
    return low


def percentile(values: DataFrame, share: float) -> float | None:
    """The exact percentile of column ``ratio``, interpolated between neighbours; null without rows."""
    n = values.count()
    if not n:
        return None
    place = share * (n - 1)
    below = math.floor(place)
    low = nth(values, below)
    return low if place == below else low + (place - below) * (nth(values, below + 1) - low)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lost_share: float = LOST_SHARE,
    missed_share: float = MISSED_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: key, the base counts, base_failed, kept, ratio and threshold.

    ``labels`` has ``key`` and ``quality``: 1 marks trusted texts, 0 bad ones.
    """
    id_type = docs.schema[key].dataType.simpleString()
    # Where a key is labelled both ways, it is bad.
    known = labels.where("quality IN (0, 1)").groupBy(F.col(key).alias("k")).agg(F.min("quality").cast("int").alias("label")).na.drop()
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    both = np.stack([cell_counts(texts.join(known.where("label = 1").hint("merge"), "k")), cell_counts(texts)])
    ratios = np.zeros(CELLS)
    if both[0].sum():
        share = (both + 1.0) / (both.sum(axis=1, keepdims=True) + CELLS)
        ratios = np.log(share[0] / share[1])
    schema = f"k {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double"
    scored = stored(texts.mapInArrow(_scores(ratios), schema), "quality")
    # Copies of a key count once each.
    labelled = stored(scored.select("k", "ratio").join(known, "k").groupBy("k", "label").agg(F.min("ratio").alias("ratio")), "labelled")
    good, bad = percentile(labelled.where("label = 1"), lost_share), percentile(labelled.where("label = 0"), 1 - missed_share)
    least = -float("inf") if good is None else (good + bad) / 2 if bad is not None and bad < good else good
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    return scored.select(
        F.col("k").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("ratio") >= least)).alias("kept"),
        "ratio",
        F.lit(least).alias("threshold"),
    )
