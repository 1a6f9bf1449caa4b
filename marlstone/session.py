"""Session construction and the shared storage that long jobs cut their lineage with."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "marlstone") -> SparkSession:
    """A single-JVM session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("MARLSTONE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only on a local master (tests, a laptop) is a temporary one made and set where it is absent;
    on a cluster executors would not see it, so its absence is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = made.get() if made.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="marlstone-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written on the way, and what becomes of them."""

    def __init__(self, spark: SparkSession, outer: Scratch | None) -> None:
        self.spark, self.outer, self.tables = spark, outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave a table to whoever owns this step, or to the shared folder if nobody does."""
        for own in [t for t in self.tables if t[0] is df]:
            self.tables.remove(own)
            if self.outer:
                self.outer.tables.append(own)
        return df

    def drop(self, df: DataFrame) -> None:
        """Remove a table now, if it is owned here."""
        for own in [t for t in self.tables if t[0] is df]:
            remove(self.spark, own[1])
            self.tables.remove(own)

    def clear(self) -> None:
        for _, path in self.tables:
            remove(self.spark, path)
        self.tables = []


_OWNER: ContextVar[Scratch | None] = ContextVar("owner", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Owns the tables that ``written`` makes inside: they are removed at the end, when all that reads them must have run.

    Tables passed to ``keep`` stay. If the step fails, all stay, so that a retry of a job can't lose its input.
    """
    own = Scratch(spark, _OWNER.get())
    token = _OWNER.set(own)
    try:
        yield own
    finally:
        _OWNER.reset(token)
    own.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no more than the last step, and gives
    the optimizer the table's true size for its join choices.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    if (own := _OWNER.get()) is not None:
        own.tables.append((found, path))
    return found


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """Bound the bytes, not only the rows, of the Arrow batches that go to Python workers.

    Ten thousand rows of whole texts are many megabytes, of which a worker holds several copies.
    This is a setting of the session and is read when a plan starts to run, so it stays set; a
    session that has a value of its own keeps it. ``batches_as_before`` puts it back.
    """
    if spark.conf.get(BATCH_BYTES) == spark.newSession().conf.get(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, size)
    return spark


@contextmanager
def batches_as_before(spark: SparkSession) -> Iterator[None]:
    """Leaves the session's bound of batches as it finds it."""
    before = spark.conf.get(BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"_{name}{i or ''}") not in taken)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
