"""What the session tells us about the cluster: the shared folder, and small-table checks."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 10_000
ROWS_A_FILE = 50_000


def ship_package() -> None:
    """Lets Python workers run this package's functions without having it installed.

    Not needed where it is installed on the cluster or passed with ``--py-files``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session that runs in a single local process may go without the setting; on a
    cluster a machine-local folder would lose data with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="musterline-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder and read back.

    A lost executor then costs no recomputation of what came before, and later readers only fetch
    the columns they use. The files stay until the folder is cleaned, as checkpoints do, or until
    ``discard`` is called. Give ``most_rows``, a bound on its rows, for a table of narrow rows: if they are few for
    the partitions they lie in, they are put together first. A local file system starts two processes for every file.
    """
    if most_rows is not None:
        files = max(df.sparkSession.sparkContext.defaultParallelism, -(-most_rows // ROWS_A_FILE))
        df = df.repartition(files) if files < task_count(df.sparkSession) else df
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(written: DataFrame) -> None:
    """Deletes the files of a table made by ``cut_lineage`` that nothing will read any more."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row. Naming a number keeps adaptive execution from
    merging such partitions because their bytes are few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def small_enough(df: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; for a broadcast hint on ``df`` itself."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """A driver-held copy of ``df`` when it has at most ``max_rows`` rows, else ``None``.

    This and ``small_enough`` are the size checks in front of every broadcast hint in the library. At most
    ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def join_small(
    left: DataFrame, right: DataFrame, on: list[str], how: str, max_rows: int = SMALL_ROWS
) -> DataFrame:
    """Broadcast ``right`` when it passes the size check, otherwise a plain shuffle join."""
    copy = small_table(right, max_rows)
    return left.join(right if copy is None else F.broadcast(copy), on, how)


