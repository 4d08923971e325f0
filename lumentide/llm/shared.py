"""Tables in the folder that all machines share, used to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset and Spark runs
within one machine (tests, a laptop) a folder below the system's temporary one is used;
on a cluster that is an error, as executors would write to disks of their own. A table
written here survives the loss of any executor, and shuffle files before it can go.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.gettempdir()}/lumentide-shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: lets Spark remove a query's shuffle files as soon as it has ended; another query that runs meanwhile only loses its own sooner
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: For each file and each one's checksum, Hadoop's usual local file system starts a process that sets permissions. Until it has loaded its program
#: it has the JVM's pages, which a look at the memory of an executor's processes then finds twice. Other stores than ``file:`` have no use for this.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: folders by application, and of the scopes that are open, the innermost last
_kept: dict[str, list[str]] = {}
_scopes: list[list[str]] = []


#: short rows of a file, where a bound is known
ROWS_A_FILE = 100_000


class Shared:
    """Intermediate tables of one operator call. What a lazy result reads stays in the folder until its ``scope`` ends, or ``release``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", set()
        (_scopes[-1] if _scopes else _kept.setdefault(spark.sparkContext.applicationId, [])).append(self.root)

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``rows``: a bound of the table's rows, for one that is quickly made of short rows; it gets few files then."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        df = df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")  # the table stands for the query's shuffles from here on
        try:
            df.write.mode("overwrite").options(**_PLAIN_FILES).option("parquet.enable.dictionary", "false").parquet(path)  # mostly hashes, of which no dictionary can be made
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in self.names.intersection(names):
            _delete(self.spark, f"{self.root}/{name}")
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Remove all other tables."""
        self.drop(*self.names.difference(names))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove all tables that this application's operators have left, once their results have been read or written."""
    for root in _kept.pop(spark.sparkContext.applicationId, []):
        _delete(spark, root)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables of operators called within go at its end, so their results have to be written within too."""
    roots: list[str] = []
    _scopes.append(roots)
    try:
        yield
    finally:
        _scopes.remove(roots)
        for root in roots:
            _delete(spark, root)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(spark: SparkSession, rows: int, rows_a_part: int) -> int:
    """Shuffle partitions for rows that are counted: those of the session, more where it has too few."""
    return max(partitions(spark), rows // rows_a_part)


def free(name: str, columns: Iterable[str]) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: rows of facts that are broadcast after they have been counted
FEW = 200_000
#: a key is hot if over one in so many rows have it, and these many rows at least
HOT, HOT_LEAST = 1000, 64


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, written: bool = True) -> DataFrame:
    """``rows`` left-joined with ``facts``: one row for each key, ``count`` of which says how many of the ``total`` rows have it.

    Hot keys are at most ``HOT`` by arithmetic, so their facts are broadcast and their rows
    stay where they are; all others are shuffled by key. Null keys have no facts. ``written``:
    the facts are a table, so it is cheap to count them, and they are broadcast if they are
    ``FEW`` at most, and to ask whether there are any hot ones.
    """
    if written and facts.count() <= FEW:
        return rows.join(F.broadcast(facts), keys, "left")
    hot = F.col(count) > max(total // HOT, HOT_LEAST)
    if written and facts.where(hot).isEmpty():
        return rows.join(facts, keys, "left")
    there = rows.join(F.broadcast(facts.where(hot)), keys)
    others = rows.join(F.broadcast(facts.where(hot).select(*keys)), keys, "left_anti").join(facts.where(~hot), keys, "left")
    return there.unionByName(others)
