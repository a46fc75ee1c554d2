"""Interaction of filters, from words that say which sets of filters a document survives.

With k filters (five at most) there are 2 ** k sets of them. A document that fails the filters F survives a
set exactly when the set holds none of F, so its failures become one word of 2 ** k bits, one for each set.
The number of documents that survive each set is then the count of each bit over a column of words. Within
a task those are counted by carry-save adders: three words of one weight become a sum word and a carry word
of twice the weight, for all sets at once, until few words of each weight are left to count bit by bit.
Tasks hand on one row of counts per part and label class of a batch, and sums of those are all that is shuffled.

Every order of the filters is read off those counts: what is left after a prefix is the count of its set.

Defined cases: a null text is empty; null in the part column is the empty string; an empty text has no words
and fails no share; documents that share an id are documents each, and of equal texts the least id is the
first; a null id is neither smaller nor larger than another. Several label rows of one id count once, if any
says 1. An empty table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propstats.llm.common import stored

MOST_FILTERS = 5


def words(text: Column) -> Column:
    """array<string>: maximal runs of anything but the space and the controls from tab to carriage return."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_filters(text: Column, found: Column) -> dict[str, Column]:
    """Failure of four filters on one text, whose words are ``found``; whole numbers throughout."""
    n = F.size(found).cast("long")
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(found)).cast("long") < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Rows (doc_id, part, digest, failed): bit i of ``failed`` is the i-th text filter; the digest stands for the text."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    # Words are split once and bound by a one-element array.
    bits = F.transform(F.array(words(F.col("t"))), lambda found: sum((failed.cast("int") * (1 << i) for i, failed in enumerate(text_filters(F.col("t"), found).values())), F.lit(0)))
    return rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), bits[0].alias("failed"))


def repeats(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` with ``bit`` set in ``failed`` where a smaller doc_id has the same digest.

    Only digests that several ids share are joined back. They are stored first: the join then reads two plain
    shuffles, and adaptive execution splits the one in which a digest holds many rows.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = stored(first.where("first < last").select("digest", "first"), "repeated")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << bit)
    return rows.join(first, "digest", "left").withColumn("failed", F.col("failed") + later).drop("first", "digest")


def survival_word(failed: Column, filters: int) -> Column:
    """Bit S of the word: does a document that fails ``failed`` survive the set S of filters?"""
    sets = range(1 << filters)
    table = [sum(1 << s for s in sets if not s & f) for f in sets]
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in table]), failed + 1)


def positional_popcount(found: np.ndarray, bits: int) -> np.ndarray:
    """How many of the words have each bit set."""
    counts, weight, words_left = np.zeros(bits, dtype=np.int64), 1, found
    while len(words_left):
        carried = []
        while len(words_left) > 2:
            third = len(words_left) // 3
            a, b, c, rest = np.split(words_left, [third, 2 * third, 3 * third])
            either = a ^ b
            carried.append((a & b) | (either & c))
            words_left = np.concatenate([either ^ c, rest])
        for word in words_left.tolist():
            counts += weight * ((word >> np.arange(bits, dtype=np.uint64)).astype(np.int64) & 1)
        words_left = np.concatenate(carried) if carried else found[:0]
        weight *= 2
    return counts


def survivors(rows: DataFrame, filters: int) -> DataFrame:
    """Rows (part, subset, kept, good, toxic): the documents of a part that survive each set of filters."""
    bits = 1 << filters

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            group = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4
            group += batch.column("good").to_numpy(zero_copy_only=False) * 2 + batch.column("toxic").to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            group, found = group[order], batch.column("word").to_numpy(zero_copy_only=False).astype(np.uint64)[order]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
            counts = [positional_popcount(x, bits).tolist() for x in np.split(found, starts[1:])] if len(found) else []
            classes = group[starts]
            yield pa.RecordBatch.from_arrays(
                [
                    parts.dictionary.take(pa.array(classes // 4)),
                    pa.array((classes // 2 % 2).astype(np.int32)),
                    pa.array((classes % 2).astype(np.int32)),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["part", "good", "toxic", "counts"],
            )

    worded = rows.select("part", F.col("good").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic"), survival_word(F.col("failed"), filters).alias("word"))
    counted = worded.mapInArrow(count, "part string, good int, toxic int, counts array<long>")
    by_set = counted.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
    return by_set.groupBy("part", "subset").agg(
        F.sum("n").alias("kept"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def orders(names: str) -> list[dict]:
    """Every order of the filters and every step in it, with the sets of filters it speaks of."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    whole = (1 << len(names)) - 1
    steps = []
    for order in itertools.permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            own = bit[name]
            steps.append({"filter_order": "".join(order), "step": step, "own": own, "before": before, "after": before | own, "others": whole ^ own})
            before |= own
    return steps


def report(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of all filters and step, from the survivors of each set."""
    whole = (1 << len(names)) - 1
    sets = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("sets"))

    def of(subset: Column | int, what: str) -> Column:
        place = subset + 1 if isinstance(subset, Column) else F.lit(subset + 1)
        return F.element_at("sets", place)[what]

    # How many orders have just the set S before the filter: |S|! (k - 1 - |S|)!.
    def shapley(own: int) -> Column:
        ways = {s: math.factorial(s.bit_count()) * math.factorial(len(names) - 1 - s.bit_count()) for s in range(whole + 1) if not s & own}
        return sum((F.lit(n) * (of(s, "kept") - of(s | own, "kept")) for s, n in ways.items()), F.lit(0).cast("long"))

    by_filter = F.create_map(*[x for i in range(len(names)) for x in (F.lit(1 << i), shapley(1 << i))])
    steps = F.from_json(F.lit(json.dumps(orders(names))), "array<struct<filter_order:string,step:int,own:int,before:int,after:int,others:int>>")
    rows = sets.withColumn("shapleys", by_filter).select("part", "sets", "shapleys", F.explode(steps).alias("o")).select("part", "sets", "shapleys", "o.*")
    lost = lambda what: of(F.col("before"), what) - of(F.col("after"), what)
    failing = of(0, "kept") - of(F.col("own"), "kept")
    return rows.select(
        "part",
        "filter_order",
        "step",
        of(F.col("after"), "kept").alias("kept"),
        lost("kept").alias("removed"),
        (failing - lost("kept")).alias("redundant"),
        (of(F.col("others"), "kept") - of(whole, "kept")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.element_at("shapleys", F.col("own")).alias("shapley"),
    )


def labelled(rows: DataFrame, labels: DataFrame, classes: Mapping[str, Column]) -> DataFrame:
    """``rows`` with a boolean for each class that any label row of the document says."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled_id")).agg(
        *[F.coalesce(F.bool_or(column), F.lit(False)).alias(name) for name, column in classes.items()]
    )
    joined = rows.join(stored(said, "classes"), F.col("doc_id") == F.col("labelled_id"), "left").drop("labelled_id")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(False)) for name in classes})


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The report on four text filters and, as the fifth, texts that a smaller doc_id has already."""
    names = "ABCDE"
    rows = repeats(stored(failures(docs, part=part), "failures"), names.index("E"))
    rows = labelled(rows, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return report(survivors(rows, len(names)), names)
