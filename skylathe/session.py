"""Session, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "skylathe", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's session is used as it is."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session. A folder of this machine is taken only where none is named and all
    tasks run on this machine (tests); elsewhere executors could not read each other's tables, so that is an error."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "skylathe-checkpoints"))
    return sc.getCheckpointDir()


#: Tables written by ``cut`` and not yet removed.
_CUTS: list[str] = []


def remove_cuts(spark: SparkSession, since: int = 0) -> int:
    """Removes the tables that ``cut`` has written from the ``since``-th on; returns how many. What was planned on
    them can no longer be read."""
    made, _CUTS[since:] = _CUTS[since:], []
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(made)


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end: write or collect the result before."""
    start = len(_CUTS)
    try:
        yield
    finally:
        remove_cuts(spark, start)


def _write(df: DataFrame, read: DataFrame | None = None) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema((read or df).schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that is not used yet; it goes with the tables of ``cut``."""
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    _CUTS.append(path)
    return path


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def cut(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared checkpoint folder; survives the loss of executors.

    A written table is computed once, while ``DataFrame.checkpoint`` runs the last stage twice, and later
    plans read only the columns they need. The tables live as long as the folder or until ``remove_cuts``.
    """
    return _write(df)


def cut_count(df: DataFrame, which: str = "true") -> tuple[DataFrame, int]:
    """``cut`` and the number of rows, or of those for which an expression holds, counted as they are written.

    The count is taken in the tasks that write, of each of which one attempt is committed and counts.
    """
    rows = Observation()
    out = _write(df.observe(rows, F.expr(f"count_if({which})").alias("n")), df)
    return out, rows.get["n"]
