"""Ranked lexical search by NRA: impact-sorted lists read in sequence, score intervals, no random access.

The texts are scanned once into an index of the terms that any item has. A task takes the index in
segments of bounded size. In a segment each term has a list of documents by falling impact. For an item
its lists are read level by level, each as far down as its contributions reach the level. What has been
read of a document is the lower end of its score; the upper end adds, for every list it has not been met in,
the next contribution of that list. Once no unmet document can reach the least of the best scores known,
only documents whose upper end still reaches it are followed. Reading goes on until each of these has
both ends equal, so membership, ties and scores are exact. The best of a task's segments so far
set the bar for the next, and the best of all tasks are ranked in one shuffle of a few rows per task and item.

Items are taken in blocks of so many terms: a block and its weights are all that the driver and a task hold
of them. A block is one scan of the texts, and its results are stored before the next one starts.

A term is known by a 64-bit hash of its bytes. Scores are 64-bit whole numbers.

Defined cases: a null text has no terms; documents without a term count for nothing; repeated rows are documents
each; equal scores go by ascending id, a null id last; rows that share an item id are one item with the terms of all,
also those without an id; an item without a term, or that no document meets, gives no rows; empty tables give no rows;
other columns are not read. Texts may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propstats.llm.common import slices, stored, text_buffers, word_hashes, word_spans

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the items that one scan of the texts looks for.
BLOCK_TERMS = 200_000
#: Entries of the lists that a task holds at once, but for one document alone.
SEGMENT_ENTRIES = 2_000_000
#: Each level is this share of the one before.
FALL = 0.6

_IS_TERM = np.ones(256, dtype=bool)
_IS_TERM[:128] = [chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(text: Column) -> Column:
    """array<string>: the terms of a text with their repeats, only A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _hashed(terms: list[str]) -> np.ndarray:
    raw, ends = text_buffers(pa.array(terms, pa.string()))
    return word_hashes(raw, ends[:-1], ends[1:])


def index(docs: DataFrame, vocabulary: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n, terms, tfs) for documents with terms: how many, and how often it has which of the vocabulary's.

    ``vocabulary`` are sorted hashes; a term is its place among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(vocabulary), 1)
        for part in slices(batches):
            raw, offsets = text_buffers(part.column("t"))
            raw = _LOWER[raw]
            starts, ends, of = word_spans(raw, offsets, _IS_TERM)
            n = np.bincount(of, minlength=part.num_rows)
            hashes = word_hashes(raw, starts, ends)
            if len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                met = vocabulary[at] == hashes
            else:
                at, met = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
            pairs, tfs = np.unique(of[met] * size + at[met], return_counts=True)
            rows = np.flatnonzero(n)
            ends = np.cumsum(np.bincount(pairs // size, minlength=part.num_rows))[rows]
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("k").take(pa.array(rows)),
                    pa.array(n[rows].astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array((pairs % size).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int32))),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class _Segment:
    """A run of documents with an impact-sorted list for each term."""

    def __init__(self, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, counts: np.ndarray, documents: int, total: int):
        docs = np.repeat(np.arange(len(n)), counts)
        m = 100 - 50 + (50 * n * documents) // total
        tfs = tfs.astype(np.int64)
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[docs])
        # One sort by term, then falling impact, which is at most a million.
        order = np.argsort((terms.astype(np.int64) << 21) + (1_000_000 - impact), kind="stable")
        self.size, self.docs, self.impact, terms = len(n), docs[order], impact[order], terms[order]
        self.terms, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))

    def lists(self, item: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Documents and falling contributions of each of the item's terms that the segment has and that weighs something."""
        at = np.searchsorted(self.terms, item)
        found = at < len(self.terms)
        found[found] = self.terms[at[found]] == item[found]
        runs = [(slice(self.starts[i], self.ends[i]), int(w)) for i, w in zip(at[found], weights[item[found]]) if w > 0]
        return [(self.docs[run], self.impact[run] * w) for run, w in runs]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, top: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents (below ``size``) and exact scores of those that may be among the best ``top``, given scores known already.

    Everything whose score is at least the ``top``-th of all is returned, ties included.
    """
    lower = np.zeros(size, dtype=np.int64)
    met = np.zeros(((len(lists) + 63) // 64, size), dtype=np.uint64)
    at, ends = [0] * len(lists), [len(docs) for docs, _ in lists]
    level = max((int(gains[0]) for _, gains in lists if len(gains)), default=0)
    followed: np.ndarray | None = None
    is_followed = None
    while True:
        level = int(level * FALL)
        for t, (docs, gains) in enumerate(lists):
            if at[t] == ends[t]:
                continue
            # Down to the level: contributions fall, so their reverse is sorted.
            stop = ends[t] - int(np.searchsorted(gains[::-1], level, side="left")) if level else ends[t]
            if stop > at[t]:
                here, gain = docs[at[t] : stop], gains[at[t] : stop]
                if is_followed is not None:
                    wanted = is_followed[here]
                    here, gain = here[wanted], gain[wanted]
                lower[here] += gain
                met[t // 64, here] |= np.uint64(1 << t % 64)
                at[t] = stop
        nexts = np.array([int(gains[a]) if a < e else 0 for (_, gains), a, e in zip(lists, at, ends)], dtype=np.int64)
        most = int(nexts.sum())
        if followed is None:
            best = np.concatenate([known, lower[lower > 0]])
        else:
            best = np.concatenate([known, lower[followed]])
        bar = int(np.partition(best, len(best) - top)[len(best) - top]) if len(best) >= top else 0
        if most and most >= bar and followed is None:
            continue  # a document not met yet may still be among the best
        if followed is None:
            followed = np.flatnonzero((lower > 0) & (lower + most >= bar))
        # The upper end adds the next contribution of every list a document was not met in.
        upper = lower[followed].copy()
        for t in np.flatnonzero(nexts):
            unmet = (met[t // 64, followed] >> np.uint64(t % 64)) & np.uint64(1) == 0
            upper[unmet] += nexts[t]
        able = upper >= bar
        followed, upper = followed[able], upper[able]
        if (upper == lower[followed]).all():
            return followed, lower[followed]
        is_followed = np.zeros(size, dtype=bool)
        is_followed[followed] = True


class _Best:
    """An item's best documents so far: scores falling, equal ones by rising id, null ids last."""

    def __init__(self):
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, top: int) -> None:
        scores, ids, nulls = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.nulls, nulls])
        order = np.lexsort((ids, nulls, -scores))[:top]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, and cut, to runs of rows of bounded entries."""
    held, entries = [], 0
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            room = SEGMENT_ENTRIES - entries + (int(ends[start - 1]) if start else 0)
            stop = int(np.searchsorted(ends, room, side="right"))
            stop = max(stop, start if held else start + 1)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                entries += int(ends[stop - 1]) - (int(ends[start - 1]) if start else 0)
            if stop < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, entries = [], 0
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def best_of_tasks(indexed: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """Rows (item, doc_id, score): of each task's documents, the best ``top`` of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best() for _ in items]
        for table in _segments(batches):
            table = table.combine_chunks()
            terms, tfs, keys = (table.column(c).combine_chunks() for c in ("terms", "tfs", "doc_id"))
            counts = terms.value_lengths().to_numpy(zero_copy_only=False)
            n = table.column("n").to_numpy()
            segment = _Segment(n, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), counts, documents, total)
            ids, nulls = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)
            for item, held in zip(items, best):
                lists = segment.lists(item, weights)
                if lists:
                    docs, scores = nra(lists, segment.size, top, held.scores)
                    held.add(scores, ids[docs], nulls[docs], top)
        for start in range(0, len(best), 1000):
            some = best[start : start + 1000]
            sizes = [len(b.scores) for b in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(start, start + len(some), dtype=np.int32), sizes)),
                    pa.array(np.concatenate([b.ids for b in some]), mask=np.concatenate([b.nulls for b in some])),
                    pa.array(np.concatenate([b.scores for b in some])),
                ],
                names=["item", "doc_id", "score"],
            )

    return indexed.mapInArrow(run, "item int, doc_id long, score long").where("score > 0")


def _block(docs: DataFrame, names: list, term_lists: list[list[str]], kind: str, top: int) -> DataFrame:
    """The ranking of one block of items, stored."""
    spark = docs.sparkSession
    vocabulary = np.unique(_hashed([t for terms in term_lists for t in terms]))
    items = [np.unique(np.searchsorted(vocabulary, _hashed(terms))) for terms in term_lists]
    indexed = stored(index(docs, vocabulary), "index")
    sums = indexed.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).head()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    # As many rows as the block has terms.
    for term, df in indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[term] = math.floor(1000 * math.log((2 * sums.documents + 2) / (2 * df + 1)))
    found = best_of_tasks(indexed, items, weights, sums.documents, max(sums.total, 1), top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= top)
    named = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
    return stored(ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def search(docs: DataFrame, items: DataFrame, top: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): for each of ``items`` (item_id, text) its best ``top`` documents (doc_id, text)."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text").cast("string")))).alias("term"))
    gathered = stored(rows.groupBy("item_id").agg(F.collect_set("term").alias("terms")), "items")
    wanted = gathered.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).head().n
    blocks = -(-wanted // block_terms)
    ranked = []
    for block in range(blocks):
        mine = gathered.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if mine:
            ranked.append(_block(docs, [r.item_id for r in mine], [r.terms for r in mine], kind, top))
    if not ranked:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, ranked)
