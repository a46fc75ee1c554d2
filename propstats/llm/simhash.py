"""SimHash near-duplicates, found with vantage-point trees.

Fingerprints within four bits of each other are linked. Copies collapse to distinct fingerprints first.

Distances between unrelated fingerprints crowd around 32 bits, so a vantage point's triangle bounds
leave most of a table in reach of a query. Two steps keep the search near-linear and exact:

1. Blocks of bits: of b blocks, four differing bits leave at least b - 4 equal, so any linked pair meets in one of the
   tables whose key is so many blocks. b grows with the number of points, so that keys have as many bits as points ask
   for and buckets stay small: six blocks and 15 tables for millions, eight and 70 for hundreds of billions. Within such
   a bucket, distances are few and varied.
2. Each bucket has a vantage point. A large one is first split over tasks into shells
   by distance to a vantage point; since the shells are one wider than the radius, a pair lies in
   one shell or in neighbouring ones, and each shard holds its shell and the boundary of the one
   below. In a task the same bounds prune: of a point at distance d only those at d - 4 to d + 4 are
   compared.

Within a bucket a search from point to point reports one link per reached point: links enough to keep every
component, and no more than there are points, however many copies a group has.

Defined cases: null and empty texts have fingerprint zero and are linked like others; repeated rows
link to each other; a null id never is a component's id unless the whole component has none; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propstats.llm import graph
from propstats.llm.common import stored, with_row

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Blocks for up to so many points; beyond the last, eight.
BLOCKS = ((1 << 22, 6), (1 << 29, 7))
#: A bucket with more points is split into shells; a leaf with no more points is compared at once.
SPLIT_POINTS, LEAF_POINTS = 4096, 64


def fingerprint(data: bytes) -> int:
    """64 bits of a text's UTF-8 bytes. bytes.lower and bytes.split know ASCII letters and white space only."""
    words = data.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - SHINGLE_WORDS + 1)
    width = min(SHINGLE_WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)], dtype="<u8"
    )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, last, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > last
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of a text as a long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t.encode()) if t else 0 for t in texts], dtype=np.uint64).view(np.int64))

    return of(text.cast("string"))


def reached(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links (rows of two points) that join what chains of steps within ``radius`` join; points are distinct.

    A search by breadth: the points it still has to reach lie sorted by distance to a vantage point, and those
    out of triangle bounds of a step's origin are not looked at.
    """
    links = []
    far = np.bitwise_count(points ^ points[0]).astype(np.int64) if len(points) > LEAF_POINTS else np.zeros(len(points), np.int64)
    order = np.argsort(far, kind="stable")
    points, far = points[order], far[order]
    while len(points) > 1:
        front, front_far = points[:1], far[:1]
        points, far = points[1:], far[1:]
        while len(front) and len(points):
            met = np.zeros(len(points), dtype=bool)
            for x, d in zip(front, front_far, strict=True):
                low, high = np.searchsorted(far, d - radius), np.searchsorted(far, d + radius, side="right")
                near = np.flatnonzero((np.bitwise_count(points[low:high] ^ x) <= radius) & ~met[low:high]) + low
                if len(near):
                    met[near] = True
                    links.append(np.stack([np.full(len(near), x), points[near]], axis=1))
            front, front_far = points[met], far[met]
            points, far = points[~met], far[~met]
    return np.concatenate(links) if links else np.zeros((0, 2), dtype=np.uint64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each shard of a partition sorted by shard."""
    held_key, held = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

    def found(keys: np.ndarray, points: np.ndarray) -> Iterator[pa.RecordBatch]:
        borders = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], borders]), np.concatenate([borders, [len(keys)]])
        out = [reached(np.unique(points[a:b])) for a, b in zip(starts, ends, strict=True) if b - a > 1]
        links = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
        if len(links):
            links = links.view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": links[:, 0].copy(), "b": links[:, 1].copy()})

    for batch in batches:
        keys = np.stack([batch.column("bucket").to_numpy(), batch.column("shell").to_numpy()], axis=1)
        keys = np.concatenate([held_key, keys])
        points = np.concatenate([held, batch.column("point").to_numpy().view(np.uint64)])
        # The last shard may go on in the next batch.
        last = keys[-1:]
        cut = int(np.flatnonzero((keys != last).any(axis=1)).max(initial=-1)) + 1 if len(keys) else 0
        if cut:
            yield from found(keys[:cut], points[:cut])
        held_key, held = keys[cut:], points[cut:]
    if len(held):
        yield from found(held_key, held)


def _block(point: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(point, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))


def blocks_for(points: int) -> int:
    return next((blocks for most, blocks in BLOCKS if points <= most), 8)


#: A key's blocks have fewer bits than this.
_TABLE_BITS = 40


def keys(blocks: int) -> list[Column]:
    """The keys of the tables: each choice of all but RADIUS of the blocks, side by side."""
    sizes = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    parts = [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]
    found = []
    for chosen in combinations(parts, blocks - RADIUS):
        key = F.lit(0).cast("long")
        for part in chosen:
            key = F.shiftleft(key, part[1]).bitwiseOR(_block(F.col("point"), part))
        found.append(key)
    return found


def links(points: DataFrame, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column ``point`` that keep every component."""
    tables = [F.lit(i << _TABLE_BITS).cast("long") + key for i, key in enumerate(keys(blocks or blocks_for(points.count())))]
    rows = points.select("point", F.explode(F.array(*tables)).alias("bucket"))
    # A bucket's vantage point is its least; only buckets of two or more go on.
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("point").alias("vantage")).where("n > 1")
    rows = rows.join(sizes, "bucket")
    far = F.bit_count(F.col("point").bitwiseXOR(F.col("vantage")))
    width = RADIUS + 1
    shell = F.floor(far / width)
    shells = F.when(F.col("n") <= SPLIT_POINTS, F.array(F.lit(0).cast("long"))).otherwise(
        # The points of a shell from which the next one is in reach also go there.
        F.when(far % width + RADIUS >= width, F.array(shell, shell + 1)).otherwise(F.array(shell))
    )
    shards = rows.select("bucket", F.explode(shells).alias("shell"), "point")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards.repartition(n, "bucket", "shell").sortWithinPartitions("bucket", "shell")
    return shards.mapInArrow(_links, "a long, b long").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (long) and component_id, the least key of its component."""
    rows = stored(docs.select(F.col(key).alias("k"), fingerprints(F.col(text)).alias("point")), "fingerprints")
    points = stored(rows.groupBy("point").agg(F.min("k").alias("least")), "points")
    roots = stored(graph.components(links(points)), "components")
    placed = points.join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = placed.select("point", "root").join(least, "root").select("point", "component_id")
    return rows.join(of_point, "point").select(F.col("k").alias(key), F.col("point").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the least key (null keys last; of repeats, the first row).
    """
    numbered, row = with_row(docs)
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(row).alias("row"))
    found = classes(numbered.select(order.alias("place"), text), "place", text)
    dropped = found.where("place <> component_id").select(F.col("place.row").alias(row))
    return numbered.join(dropped, row, "left_anti").select(*docs.columns)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
