"""Benchmark decontamination with spaced seeds.

A seed is the hash of some of the tokens of a window; fixed masks say which. A substituted token that a
mask ignores leaves the seed as it is. Seeds of the benchmark items are looked up among those of all
windows of the training texts, and the tokens around each hit are compared along its diagonal: an
overlap is the run that scores best with ``MATCH`` for an equal token and ``MISMATCH`` for another, and counts
from ``LEAST_OVERLAP`` equal tokens on.

Items of up to ``SHORT_ITEM`` tokens also count as a whole: from ``SHORT_SHARE`` equal tokens in the item's place on. With
s substitutions allowed, some s + 1st part of the item is left whole, so seeds of two to four neighbouring tokens
find every such place; they are compared in arrays before anything else.

Items are loaded in blocks of a bounded number of tokens, and each block is held against all texts; with several blocks,
a block's hits are stored before the next one is loaded. So neither a task nor the driver holds more of the benchmark
than a block; texts never move.

Defined cases: null and empty texts and items have no tokens and no hits; items of any length are searched, those of
up to four tokens as they stand (``least_item`` leaves out shorter ones); items of equal tokens are one item, named by the
least id; repeated texts each get their hits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propstats.llm.common import mix, slices, stored, text_buffers, with_row, word_hashes, word_spans

#: 1 marks a token that is hashed. Some mask avoids one substitution in any 12 tokens, two in 20, three in 24, four in 32.
MASKS = ("110110110110", "101101101101", "011011011011", "111100001111", "000011111111", "111111110000")
LEAST_ITEM = 1
LEAST_OVERLAP = 12
#: The longest item that is held against a place as a whole, and the percent of its tokens that have to be equal.
SHORT_ITEM, SHORT_SHARE = 20, 80
MATCH, MISMATCH = 1, -3
#: At most so many item tokens are held at a time.
BLOCK_TOKENS = 1_000_000

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEP = np.uint64(0xA0761D6478BD642F)
_FILTER_BITS = 22


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a batch of texts, and the text of each word."""
    raw, offsets = text_buffers(pc.utf8_lower(column))
    starts, ends, text = word_spans(raw, offsets, _IS_WORD)
    return word_hashes(raw, starts, ends), text


def _seeds(hashes: np.ndarray, text: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The seed of each window of a mask that lies in one text, and where the window starts."""
    span = len(mask)
    if len(hashes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[: len(text) - span + 1] == text[span - 1 :])
    seed = np.full(len(at), np.uint64(hash_of(mask)), dtype=np.uint64)
    for j, used in enumerate(mask):
        if used == "1":
            seed = seed * _STEP + hashes[at + j]
    return at, mix(seed)


def hash_of(mask: str) -> int:
    return (int(mask, 2) << 8) + len(mask)


def least_equal(n_tokens: int) -> int:
    """The equal tokens that a short item has to have."""
    return -(-SHORT_SHARE * n_tokens // 100)


def short_mask(n_tokens: int) -> str:
    """Neighbouring tokens that some part of a short item has unchanged, as long as enough of its tokens are equal."""
    return "1" * (n_tokens // (n_tokens - least_equal(n_tokens) + 1))


class Block:
    """Some benchmark items, as sorted seeds with their places and as token hashes."""

    def __init__(self, ids: list, hashes: list[np.ndarray]):
        self.ids, self.hashes = ids, hashes
        short = [short_mask(len(h)) if len(h) <= SHORT_ITEM else None for h in hashes]
        self.masks = [*MASKS, *sorted({m for m in short if m})]
        self.sizes = np.array([len(h) for h in hashes])
        self.padded = np.zeros((len(hashes), SHORT_ITEM), np.uint64)
        for i, h in enumerate(hashes):
            if len(h) <= SHORT_ITEM:
                self.padded[i, : len(h)] = h
        seeds, items, places = [], [], []
        for mask in self.masks:
            wanted = [i for i, h in enumerate(hashes) if (len(h) >= len(mask) if mask in MASKS else short[i] == mask)]
            if not wanted:
                continue
            flat = np.concatenate([hashes[i] for i in wanted])
            text = np.repeat(np.array(wanted), [len(hashes[i]) for i in wanted])
            first = np.concatenate([[0], np.cumsum([len(hashes[i]) for i in wanted])])
            at, found = _seeds(flat, text, mask)
            seeds.append(found)
            items.append(text[at])
            places.append(at - first[np.searchsorted(np.array(wanted), text[at])])
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.item = (np.concatenate(items) if items else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        self.may = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.may[(self.seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, token of the batch where the item's first would lie)."""
        rows = []
        for mask in self.masks:
            at, seed = _seeds(hashes, text, mask)
            some = self.may[(seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
            at, seed = at[some], seed[some]
            low, high = np.searchsorted(self.seed, seed), np.searchsorted(self.seed, seed, side="right")
            n = high - low
            if not n.sum():
                continue
            # Each hit once for every place of the benchmark that has the seed.
            of = np.repeat(np.arange(len(at)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of]
            rows.append(np.unique(np.stack([text[at[of]], self.item[place], at[of] - self.place[place]], axis=1), axis=0))
        return np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), np.int64)

    def likely(self, found: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The hits without those of short items that too few equal tokens stand behind."""
        out = [found[self.sizes[found[:, 1]] > SHORT_ITEM]]
        found = found[self.sizes[found[:, 1]] <= SHORT_ITEM]
        for part in np.array_split(found, len(found) // 100_000 + 1):
            t, i, at = part.T
            equal = np.zeros(len(part), np.int64)
            for j in range(SHORT_ITEM):
                inside = (j < self.sizes[i]) & (at + j >= first[t]) & (at + j < first[t + 1])
                equal += inside & (hashes[np.where(inside, at + j, 0)] == self.padded[i, j])
            out.append(part[equal >= np.minimum(LEAST_OVERLAP, -(-SHORT_SHARE * self.sizes[i] // 100))])
        return np.concatenate(out)


def best_run(same: np.ndarray) -> tuple[int, int]:
    """Start and end of the run that scores best, the first of equals; (0, 0) without an equal token."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, MATCH, MISMATCH))])
    least = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - least))
    return int(np.argmax(sums[: end + 1] == least[end])), end


def overlaps(block: Block, hashes: np.ndarray, text: np.ndarray, n_texts: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (text, item, first token in the text, in the item, tokens, equal tokens), the best of each pair."""
    first = np.searchsorted(text, np.arange(n_texts + 1))
    best: dict[tuple[int, int], tuple] = {}
    for t, i, at in block.likely(block.hits(hashes, text), hashes, first).tolist():
        item = block.hashes[i]
        low, high = max(at, first[t]), min(at + len(item), first[t + 1])
        same = hashes[low:high] == item[low - at : high - at]
        a, b = best_run(same)
        whole = len(item) <= SHORT_ITEM and int(same.sum()) >= least_equal(len(item))
        if whole:
            a, b = int(same.argmax()), len(same) - int(same[::-1].argmax())
        equal = int(same[a:b].sum())
        if whole or equal >= LEAST_OVERLAP:
            row = (equal, -(b - a), -(low + a - first[t]), low - at + a)
            if (t, i) not in best or row > best[t, i]:
                best[t, i] = row
    return [(t, i, -start, place, -length, equal) for (t, i), (equal, length, start, place) in best.items()]


def _found(block: Block, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, text = tokens(batch.column("t"))
            rows = overlaps(block, hashes, text, batch.num_rows)
            if rows:
                t, i, start, place, n, equal = zip(*rows, strict=True)
                columns = [batch.column("k").take(pa.array(t)), pa.array([block.ids[x] for x in i]), start, place, n, equal]
                columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, text = tokens(batch.column("t"))
        first = np.searchsorted(text, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "tokens": lists})


def find(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    least_item: int = LEAST_ITEM,
) -> DataFrame:
    """Rows (key, item_key, doc_token, item_token, n_tokens, n_equal), one per contaminated text and item."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[key].dataType, items.schema[item_key].dataType
    named = items.select(F.col(item_key).alias("k"), F.col(item_text).cast("string").alias("t"))
    hashed = named.mapInArrow(_hashed, f"k {item_type.simpleString()}, tokens array<long>").where(F.size("tokens") >= max(least_item, 1))
    hashed = hashed.groupBy("tokens").agg(F.min("k").alias("k"))
    total = hashed.agg(F.sum(F.size("tokens"))).head()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = f"k {id_type.simpleString()}, item {item_type.simpleString()}, doc_token long, item_token long, n_tokens long, n_equal long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = hashed.where(F.pmod(F.xxhash64("tokens"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (r.k is None, r.k))
        if rows:
            block = Block([r.k for r in rows], [np.array(r.tokens, dtype=np.int64).view(np.uint64) for r in rows])
            found = texts.mapInArrow(_found(block, arrow), schema)
            out = out.union(stored(found, "hits") if blocks > 1 else found)
    return out.withColumnsRenamed({"k": key, "item": item_key})


def without(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """``docs`` without the contaminated texts.
    """
    numbered, row = with_row(docs)
    hits = find(numbered.select(F.col(row), text), items, row, text, **names).select(row).distinct()
    return numbered.join(hits, row, "left_anti").select(*docs.columns)
