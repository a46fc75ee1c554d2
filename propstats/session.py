"""Session builder for local runs and the location of scratch tables."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("propstats")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table.

    Every executor must see it, so it lies under ``spark.checkpoint.dir``. Only a local session may
    leave that unset: its one process then uses a local folder, removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder all executors share (master is {master!r})")
        root = _local_root()
    path = f"{root.rstrip('/')}/propstats/{name}-{uuid.uuid4().hex}"
    owner = _OWNER.get()
    if owner is not None:
        owner.append(path)
    return path


#: The paths that the innermost scope in force has to remove.
_OWNER: ContextVar[list[str] | None] = ContextVar("scratch_owner", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Own the intermediate tables whose place is taken within, and remove them at the end, also after a failure.

    What leaves the scope must not read them any more: write results elsewhere, or to a place that was
    taken before the scope began. Scopes nest; each removes its own. Outside any scope tables stay: a lazy
    result may be read at any time.
    """
    paths: list[str] = []
    token = _OWNER.set(paths)
    try:
        yield
    finally:
        _OWNER.reset(token)
        for path in reversed(paths):
            remove_folder(spark, path)


def owns_scratch(function: Callable) -> Callable:
    """A function whose first argument is the session and whose results are written tables, run in a scope of its own."""

    @functools.wraps(function)
    def scoped(spark: SparkSession, *args, **named):
        with scratch_scope(spark):
            return function(spark, *args, **named)

    return scoped


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@functools.cache
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="propstats-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root
