"""Weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

At a node every child draws ``-ln(u) / weight`` from a hash of the row's key and the child's name, and
the smallest draw wins, so a child gets rows in proportion to the weight of the shards below it. A
draw depends on the key, the name and the weight alone. When weights change, a row moves only at nodes
whose children changed, and only towards children that gained (or away from one that lost).

A shard opened in a region of its own leaves all other weights as they are: it takes rows only into
itself. One added to an existing rack raises that rack's and region's weight too: rows then move into
that subtree only, where some may settle on other shards.

Defined cases: a null key is a key like any other (all such rows share a shard); repeated rows each
get a slot; a null text has no bytes; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propstats.llm.common import stored

#: Slots are numbered within so many hash buckets of each shard, each a task-sized group of its own.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Inner nodes weigh what their children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float = 1.0
    shard: int | None = None

    @property
    def weight(self) -> float:
        return sum(child.weight for child in self.children) if self.children else self.own_weight


def leaf(shard: int, weight: float = 1.0) -> Node:
    return Node(f"shard-{shard}", own_weight=weight, shard=shard)


def even_tree(regions: int, racks: int, shards: int) -> Node:
    """``regions`` of ``racks`` of ``shards`` each, numbered from 0, all of weight one."""
    per_region = racks * shards
    return Node(
        "root",
        tuple(
            Node(
                f"region-{r}",
                tuple(
                    Node(f"rack-{r}-{k}", tuple(leaf(r * per_region + k * shards + s) for s in range(shards)))
                    for k in range(racks)
                ),
            )
            for r in range(regions)
        ),
    )


def with_new_region(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """``tree`` and one more shard, in a rack and a region of its own."""
    grown = Node(f"region-of-{shard}", (Node(f"rack-of-{shard}", (leaf(shard, weight),)),))
    return Node(tree.name, (*tree.children, grown))


def _draw(key: Column, node: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double")
    return -F.log((bits + 0.5) / float(1 << 53)) / node.weight


def descend(key: Column, node: Node) -> Column:
    """The shard that ``key`` reaches from ``node``; children of weight zero get nothing."""
    if node.shard is not None:
        return F.lit(node.shard)
    children = [child for child in node.children if child.weight > 0]
    if len(children) == 1:
        return descend(key, children[0])
    winner = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children)]))["i"]
    if all(child.shard is not None for child in children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in children]), winner + 1)
    chosen = descend(key, children[-1])
    for i, child in reversed(list(enumerate(children[:-1]))):
        chosen = F.when(winner == i, descend(key, child)).otherwise(chosen)
    return chosen


def assign(
    docs: DataFrame, tree: Node, grown: Node | None = None, key: str = "doc_id", text: str = "text", buckets: int = SLOT_BUCKETS
) -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, shard, slot and, given ``grown``, grown_shard.

    Slots count from 0 without gaps within a shard. They are numbered per (shard, bucket) and shifted
    by the rows in earlier buckets, so no shard is gathered in one task; repeats of one key are dealt
    over all buckets by a row number fixed when the rows are stored.
    """
    kept = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    rows = kept.select(
        "k",
        (F.coalesce(F.octet_length("t"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("t"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        descend(F.col("k"), tree).cast("int").alias("shard"),
        (descend(F.col("k"), grown) if grown else F.lit(None)).cast(T.IntegerType()).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows.withColumn("bucket", F.pmod(F.xxhash64("k", "row"), F.lit(buckets)).cast("int")), "shards")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(_order("shard", "bucket")) - F.col("n")
    counts = counts.select("shard", "bucket", earlier.alias("first"))
    number = F.row_number().over(_order(["shard", "bucket"], ["k", "text_crc32", "row"])) - 1
    return (
        rows.withColumn("number", number)
        .join(counts, ["shard", "bucket"])
        .select(
            F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("number")).cast("long").alias("slot"), "grown_shard"
        )
    )


def _order(by, order):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order)
