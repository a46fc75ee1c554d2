"""Exact removal of long repeated passages with a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``LENGTH`` bytes around it starts anywhere else in the corpus as well.

*Sparse suffixes.* Of the ``GRAM``-byte strings in a window of ``LENGTH`` bytes, the one with the least hash is the
window's anchor. Equal windows have their anchor at the same offset, so comparing the suffixes at anchors
misses no match. Neighbouring windows mostly share an anchor: a suffix stands for the run of windows
around it, about one for each 185 bytes.

*Index family.* Texts are dealt into batches. Each batch gets a suffix array: the anchored suffixes sorted
by their first bytes (the head, then a hash of all ``GRAM`` of them), stored as a range-partitioned table
of counts. It is scanned against each level of the family, where both are merged on the sorted keys;
suffixes found on both sides are long matches to be looked at. Two levels of equal size merge into one of
twice the size, so each suffix is rewritten a logarithmic number of times.

*Exact windows.* Of matching suffixes, those whose whole run of windows occurs twice are settled by a hash of
the run. For the others, the bytes of one occurrence per distinct run go to their anchor's group, where all
windows are hashed and compared. A group of more than ``HOT_RUNS`` distinct runs is not gathered: its
windows are hashed where the texts are and counted in a pre-aggregated grouping. The hashes of
a window (64 bits) and its anchor (64 bits) are compared together.

*Passages of words.* ``passages`` says which texts share a run of ``PASSAGE_WORDS`` words with another row, whatever its
bytes: often fewer than ``LENGTH``. Windows of words have anchors of ``PASSAGE_GRAM`` words in the same way, about one for
each 18 words. A text with a run of windows that another row has is settled; of the others only windows around anchors that
stand elsewhere too are hashed and compared. Intermediate tables are removed once the texts found are written.

Exact copies are one text here: each is removed whole if it has ``LENGTH`` bytes, and only the one text
enters the index. Texts are moved twice, compressed; suffixes carry hashes and places only.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` bytes lose nothing; repeated rows are
copies; matches never cross texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propstats.llm.common import WHITE_SPACE, inverse_powers, mix, powers, slices, stored, text_buffers, word_hashes, word_spans
from propstats.session import scratch_path, scratch_scope

LENGTH = 400
GRAM = 32
BATCHES = 4
#: Words of a passage, and of the runs of words of which the one with the least hash is its anchor.
PASSAGE_WORDS, PASSAGE_GRAM = 51, 16
#: Distinct runs of one anchor that a task compares, some 600 bytes each.
HOT_RUNS = 10_000
#: Bytes handled at once; a longer text is cut into overlapping parts of as many windows.
PART = 1 << 18
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(WHITE_SPACE)] = False
_PLACE_BITS = np.uint64(22)
_PLACE = np.uint64((1 << 22) - 1)
_POWERS, _INVERSE = powers(PART + LENGTH + 1), inverse_powers(PART + LENGTH + 1)
SUFFIX = "text binary, at int, lo int, hi int, head long, gram long, run long"
KEY = ["head", "gram"]


class HashedWords:
    """Prefix sums of word hashes, from which the hash of any run of words follows."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * powers(len(words)), out=self.sums[1:])
        self.inverse = inverse_powers(len(words) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


class Hashed:
    """Prefix sums of a part's bytes, from which the hash of any of its strings follows."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(raw)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _INVERSE[starts])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, from running minima within blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], upto[width - 1 : width - 1 + n])


def suffixes(raw: np.ndarray, border: np.ndarray) -> dict[str, np.ndarray]:
    """The anchored suffixes of a part: anchor, first and last window, head, gram and run hash.

    ``border`` are the offsets of the part's texts; windows that cross one are left out.
    """
    hashed = Hashed(raw)
    n = len(raw) - LENGTH + 1
    grams = np.arange(len(raw) - GRAM + 1)
    gram = hashed.of(grams, grams + GRAM)
    least = _sliding_least((gram & ~_PLACE) | grams.astype(np.uint64), LENGTH - GRAM + 1)
    anchor = (least & _PLACE).astype(np.int64)
    text = np.searchsorted(border, np.arange(n), side="right") - 1
    inside = np.arange(n) + LENGTH <= border[text + 1]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]), [True]]))
    at = anchor[starts]
    head = np.zeros(len(at), dtype=np.uint64)
    for j in range(8):
        head = (head << np.uint64(8)) | raw[at + j]
    run = mix(hashed.of(starts, ends + LENGTH) + ((ends - starts) * 1024 + at - starts).astype(np.uint64))
    return {"text": text[starts], "at": at, "lo": starts, "hi": ends, "head": head.view(np.int64), "gram": gram[at].view(np.int64), "run": run.view(np.int64)}


def _parts(sizes: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to) of bounded bytes; parts of one text overlap by all but one byte of a window."""
    group, size = [], 0
    for i, n in enumerate(sizes.tolist()):
        for start in range(0, max(1, n - LENGTH + 1), PART // 2):
            end = min(n, start + PART // 2 + LENGTH - 1)
            if size + end - start > PART:
                yield group
                group, size = [], 0
            group.append((i, start, end))
            size += end - start
    if group:
        yield group


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "t", PART):
        texts = batch.column("t").to_pylist()
        names = batch.column("text")
        for group in _parts(np.array([len(t) for t in texts], dtype=np.int64)):
            raw = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in group), dtype=np.uint8)
            border = np.concatenate([[0], np.cumsum([b - a for _, a, b in group])])
            if len(raw) < LENGTH:
                continue
            found = suffixes(raw, border)
            part = found.pop("text")
            shift = np.array([a for _, a, _ in group])[part] - border[part]
            for place in ("at", "lo", "hi"):
                found[place] = (found[place] + shift).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"text": names.take(pa.array(np.array([i for i, _, _ in group])[part]))} | found)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches, "t", PART):
        yield pa.RecordBatch.from_pydict(
            {"text": batch.column("text"), "blob": pa.array([squeeze(t) for t in batch.column("t").to_pylist()], pa.binary())}
        )


def _windows(data: np.ndarray, at: int) -> np.ndarray:
    """The hash of each window of a run's bytes, with its place before the anchor."""
    starts = np.arange(len(data) - LENGTH + 1)
    return mix(Hashed(data).of(starts, starts + LENGTH) + (at - starts).astype(np.uint64))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """Each asked run and its bytes."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "blob", PART):
        for blob, runs in zip(batch.column("blob").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            data = np.frombuffer(expand(blob), dtype=np.uint8)
            for r in runs:
                yield r, data[r["lo"] : r["hi"] + LENGTH]


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    names = ["gram", "id", "open", "at", "data"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    for r, data in _asked(batches):
        rows.append((r["gram"], r["id"], r["open"], r["at"] - r["lo"], data.tobytes()))
        if len(rows) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each open run, the windows (first, last) that another run of its group has; groups come sorted."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("gram", "id", "open", "at", "data")), strict=True)

    out: list[tuple[int, int, int]] = []
    for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
        runs = list(group)
        hashes = [_windows(np.frombuffer(data, dtype=np.uint8), at) for _, _, _, at, data in runs]
        values, times = np.unique(np.concatenate(hashes), return_counts=True)
        twice = values[times > 1]
        if not len(twice):
            continue
        for (_, name, is_open, _, _), own in zip(runs, hashes, strict=True):
            if is_open:
                found = np.concatenate([[False], twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own, [False]])
                steps = np.flatnonzero(found[1:] != found[:-1]).tolist()
                out += [(name, a, b - 1) for a, b in zip(steps[::2], steps[1::2], strict=True)]
        if len(out) > 10_000:
            yield _spans(out)
            out = []
    if out:
        yield _spans(out)


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["id", "first", "last"])


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the asked runs, one row each."""
    for r, data in _asked(batches):
        window = _windows(data, r["at"] - r["lo"]).view(np.int64)
        same = [np.full(len(window), r[c], dtype=np.int64) for c in ("gram", "id")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*same, window, np.arange(len(window)))], ["gram", "id", "window", "first"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of bytes covered by windows that start in the spans (first, last)."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "blob", PART):
        rows = []
        for blob, spans in zip(batch.column("blob").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, at, kept = expand(blob), 0, hashlib.sha256()
            runs = merged([(s["lo"], s["hi"]) for s in spans])
            for a, b in runs:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            rows.append(([{"start": a, "end": b} for a, b in runs], sum(b - a for a, b in runs), kept.hexdigest()))
        runs, removed, digest = zip(*rows, strict=True) if rows else ((), (), ())
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("text"), pa.array(runs, spans_type), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
            ["text", "removed", "n_removed", "kept_sha256"],
        )


class IndexFamily:
    """Levels of suffix arrays, each with the number of batches it holds. An array counts its distinct suffixes."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def _array(counted: DataFrame) -> DataFrame:
        n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return stored(counted.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY), "suffixes")

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Take in a batch's suffixes (head, gram); returns those that match in the batch or any level."""
        array = self._array(suffixes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
        matches = array.where("n > 1").select(*KEY)
        for _, level in self.levels:
            matches = matches.union(array.select(*KEY).join(level.select(*KEY), KEY))
        size, self.levels = 1, list(self.levels)
        matches = stored(matches.distinct(), "matches")
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            both = array.unionByName(level).groupBy(*KEY).agg(F.sum("n").alias("n"))
            array, size = self._array(both), size * 2
        self.levels.append((size, array))
        return matches


def _word_runs(words: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
    """The anchored runs of windows of PASSAGE_WORDS words: text, gram and run hash, anchor, first and last window.

    ``words`` are hashes and ``of`` says each one's text. Runs that a text holds twice stand there twice.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(words) - PASSAGE_WORDS + 1, PART):
        w, text = words[start : start + PART + PASSAGE_WORDS - 1], of[start : start + PART + PASSAGE_WORDS - 1]
        hashed = HashedWords(w)
        grams, n = np.arange(len(w) - PASSAGE_GRAM + 1), len(w) - PASSAGE_WORDS + 1
        gram = hashed.of(grams, grams + PASSAGE_GRAM)
        least = _sliding_least((gram & ~_PLACE) | grams.astype(np.uint64), PASSAGE_WORDS - PASSAGE_GRAM + 1)
        anchor = (least & _PLACE).astype(np.int64)
        inside = text[:n] == text[PASSAGE_WORDS - 1 :]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:n] != text[: n - 1])])
        lo = np.flatnonzero(inside & (new | np.concatenate([[True], ~inside[:-1]])))
        hi = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
        at = anchor[lo]
        run = mix(hashed.of(lo, hi + PASSAGE_WORDS) + ((hi - lo) * 1024 + at - lo).astype(np.uint64))
        found.append((text[lo], gram[at], run, at + start, lo + start, hi + start))
    names = ["text", "gram", "run", "at", "lo", "hi"]
    return dict(zip(names, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)) if found else {}


def _words_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of an Arrow column, and the number of each one's text."""
    raw, offsets = text_buffers(column)
    starts, ends, of = word_spans(raw, offsets, _IS_WORD)
    if len(raw) > PART:
        return word_hashes(raw, starts, ends), of
    # The same hashes, with powers at hand.
    sums = Hashed(raw).sums
    return mix((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64)), of


def _word_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, gram, run): the anchored runs of each text, each once."""
    for batch in slices(batches, "t", PART):
        found = _word_runs(*_words_of(batch.column("t")))
        if not found:
            continue
        text, run = found["text"], found["run"]
        order = np.lexsort((run, text))
        once = order[np.concatenate([[True], (np.diff(text[order]) != 0) | (np.diff(run[order]) != 0)])[: len(order)]]
        docs = batch.column("doc").take(pa.array(text[once]))
        yield pa.RecordBatch.from_arrays([docs, *(pa.array(found[c][once].view(np.int64)) for c in ("gram", "run"))], ["doc", "gram", "run"])


def _word_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, doc): all windows of the asked runs, told by their words and their place before the anchor."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "blob", PART):
        for doc, blob, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "blob", "runs")), strict=True):
            words, of = _words_of(pa.array([expand(blob)], pa.binary()))
            found = _word_runs(words, of)
            take = np.isin(found["run"].view(np.int64), np.array(asked, dtype=np.int64))
            at, lo, hi = (found[c][take] for c in ("at", "lo", "hi"))
            size = hi - lo + 1
            starts = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            hashes = HashedWords(words).of(starts, starts + PASSAGE_WORDS)
            windows = np.unique(mix(hashes + (np.repeat(at, size) - starts).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(windows.view(np.int64)), pa.array(np.full(len(windows), doc))], ["window", "doc"])


def _shared_docs(rows: DataFrame) -> DataFrame:
    """(doc): the texts of ``rows`` (text, t) that share a run of PASSAGE_WORDS words with another row; doc is a hash of text.

    A run of windows that stands in two rows settles both. Of the other texts, the windows are compared in which another
    run has the same gram.
    """
    spark = rows.sparkSession
    # So many words have as many bytes and the spaces between them.
    long = rows.where(F.length("t") >= 2 * PASSAGE_WORDS - 1).select(F.xxhash64("text").alias("doc"), "t")
    place = scratch_path(spark, "shared")
    with scratch_scope(spark):
        entries = stored(long.mapInArrow(_word_entries, "doc long, gram long, run long"), "words")
        twice = stored(entries.groupBy("gram").count().where("count > 1").select("gram"), "grams")
        matching = stored(entries.join(twice, "gram"), "matching")
        runs = stored(matching.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc")), "runs")
        settled = stored(matching.join(runs.where("n > 1").select("gram", "run"), ["gram", "run"]).select("doc").distinct(), "settled")
        unsettled = matching.join(settled, "doc", "left_anti").select("gram").distinct()
        asked = runs.join(unsettled, "gram").groupBy("doc").agg(F.collect_set("run").alias("runs"))
        blobs = long.select(F.col("doc").alias("text"), "t").mapInArrow(_squeezed, "text long, blob binary")
        blobs = blobs.groupBy(F.col("text").alias("doc")).agg(F.first("blob").alias("blob"))
        windows = stored(blobs.join(stored(asked, "asked"), "doc").mapInArrow(_word_windows, "window long, doc long"), "windows")
        common = windows.groupBy("window").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a != b").select("window")
        found = windows.join(common, "window").select("doc").union(settled).distinct()
        found.write.parquet(place)
    return spark.read.schema("doc long").parquet(place)


def _with_shared(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` (text) with the column ``shared``, whether the text is among those of ``shared`` (doc)."""
    flags = shared.withColumn("shared", F.lit(True))
    joined = rows.withColumn("doc", F.xxhash64("text")).join(flags, "doc", "left").drop("doc")
    return joined.withColumn("shared", F.coalesce("shared", F.lit(False)))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key and ``shared``, whether it has a run of PASSAGE_WORDS words that another row has."""
    rows = _digested(docs, key, text)
    return _with_shared(rows.select("k", "text"), _shared_docs(rows)).select(F.col("k").alias(key), "shared")


def _digested(docs: DataFrame, key: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("k"), data.alias("t")).withColumn("text", F.unhex(F.md5("t")))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, removed (array of maximal runs of bytes), n_removed, kept_sha256, shared (as ``passages``)."""
    rows = _digested(docs, key, text)
    shared = _shared_docs(rows)
    long = rows.where(F.length("t") >= LENGTH)
    entries = stored(long.select("text", "t").mapInArrow(_entries, SUFFIX).dropDuplicates(["text", "at", "lo"]), "entries")

    family, matches = IndexFamily(), None
    batch = F.pmod(F.xxhash64("text"), F.lit(batches))
    for b in range(batches):
        found = family.add(entries.where(batch == b).select(*KEY))
        matches = found if matches is None else matches.union(found)

    # Suffixes that match somewhere, and their distinct runs of windows.
    # Both sides are stored, so that the join reads two plain shuffles and the rows of a hot suffix can be split over tasks.
    matching = stored(entries.join(stored(matches.distinct(), "distinct"), KEY), "matching")
    runs = matching.groupBy(*KEY, "run").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("text", "at", "lo", "hi")).alias("one")
    )
    runs = stored(runs.withColumn("id", F.xxhash64(*KEY, "run")), "runs")
    open_keys = runs.groupBy(*KEY).agg(F.count_if(F.col("n") == 1).alias("open_runs"), F.count(F.lit(1)).alias("of"))
    open_keys = open_keys.where("open_runs > 0 AND of > 1").select(*KEY, (F.col("of") > HOT_RUNS).alias("hot"))
    asked = runs.join(open_keys, KEY).select("one.*", "gram", "id", (F.col("n") == 1).alias("open"), "hot")
    asked = stored(
        asked.groupBy("text", "hot").agg(F.collect_list(F.struct("at", "lo", "hi", "gram", "id", "open")).alias("runs")), "asked"
    )
    blobs = long.select("text", "t").mapInArrow(_squeezed, "text binary, blob binary").groupBy("text").agg(F.first("blob").alias("blob"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = blobs.join(asked.where("NOT hot"), "text").select("blob", "runs")
    cold = cold.mapInArrow(_contents, "gram long, id long, open boolean, at int, data binary")
    cold = cold.repartition(partitions, "gram").sortWithinPartitions("gram")
    found = cold.mapInArrow(_shared, "id long, first long, last long")
    if asked.where("hot").limit(1).count():
        windows = blobs.join(asked.where("hot"), "text").select("blob", "runs")
        windows = stored(windows.mapInArrow(_window_hashes, "gram long, id long, window long, first long"), "windows")
        twice = windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("gram", "window")
        found = found.union(windows.join(twice, ["gram", "window"]).select("id", "first", F.col("first").alias("last")))
    single = runs.where("n = 1").select("id", "one.text", "one.lo")
    place = lambda c: (F.col("lo") + F.col(c)).cast("int").alias("lo" if c == "first" else "hi")
    spans = found.join(single, "id").select("text", place("first"), place("last"))
    settled = runs.where("n > 1").select(*KEY, "run")
    spans = spans.union(matching.join(settled, [*KEY, "run"]).select("text", "lo", "hi"))
    spans = spans.groupBy("text").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = blobs.join(spans, "text").select("text", "blob", "spans")
    cut = stored(cut.mapInArrow(_cut, "text binary, removed array<struct<start:int,end:int>>, n_removed long, kept_sha256 string"), "cut")

    light = _with_shared(rows.select("k", "text", F.length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("whole")), shared)
    copied = light.where(F.col("n_bytes") >= LENGTH).groupBy("text").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    out = light.join(copied, "text", "left").join(cut, "text", "left")
    whole = F.col("copies").isNotNull()
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        F.col("k").alias(key),
        "n_bytes",
        F.when(whole, all_of_it).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        "shared",
    )
