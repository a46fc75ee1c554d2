"""Positions in a total order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propstats.sources.tables import stored

#: The identifier that Spark gives a row has its partition above these bits and its place there in them.
_PLACE_BITS = 33


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with each row's position from 1 on, in an order in which no two rows are equal.

    Rows are dealt to partitions by ranges of the order and sorted there, so a row's place in its partition is
    known at once; what is missing is the rows of the partitions before, one number for each. The sorted
    rows are stored, as the ranges come from a sample and must not be drawn twice. Equal rows take neighbouring
    positions in any order.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Packed, so that no column's name is in the way.
    marked = dealt.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("marked"))
    rows = stored(marked, "ranked").withColumn("range", F.shiftright("marked", _PLACE_BITS))
    # As many rows as there are partitions.
    sizes = {r.range: r.n for r in rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    start = df.sparkSession.createDataFrame(offsets, "range long, before long")
    place = F.col("marked").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return rows.join(F.broadcast(start), "range").select("row.*", (F.col("before") + place + 1).alias(name))
