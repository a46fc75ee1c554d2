"""Reading tables, stored intermediate tables and vectorised word hashing shared by the operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propstats.session import scratch_path

#: Bytes that end a word: the space and the five ASCII controls from tab to carriage return.
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application: their tasks import it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), package.name)
        context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a key for each row, the same at every reading, in a column whose name it returns.

    Rows of files are told by their file and their place in it, however the files are split among tasks. Any
    other table is numbered and stored first.
    """
    name = "row_number"
    while name in df.columns:
        name += "_"
    try:
        place = df.metadataColumn("_metadata")
        file, at = place.getField("file_path"), place.getField("row_index")
        numbered = df.withColumn(name, F.struct(F.xxhash64(file).alias("file"), at.alias("at")))
        numbered.schema  # noqa: B018 - says whether the table has such columns
        return numbered, name
    except AnalysisException:
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column in one array, and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "t", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have a few million bytes together: what is computed per byte stays small."""
    for batch in batches:
        _, ends = text_buffers(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def inverse_powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    return powers(n, np.uint64(pow(int(base), -1, 1 << 64)))


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; ``is_word`` says of each byte value whether words hold it."""
    inside = is_word[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    if len(raw):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=sums[1:])
        shift = inverse_powers(len(raw) + 1)
        return mix((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64))
    return np.zeros(0, np.uint64)
