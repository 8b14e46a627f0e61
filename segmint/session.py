"""Session construction and cluster-wide settings.

The library never builds its own session inside operators: every function
receives DataFrames (and therefore a session).  ``get_session`` exists for
scripts, tests and the bench.  ``checkpoint_dir`` reads the shared checkpoint
folder the cluster names in ``spark.checkpoint.dir``; only when that is unset
(local tests) does it create a scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry.  AQE re-plans joins and coalesces
# partitions at run time; skew-join splitting guards hot keys.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "segmint", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a run over ``input_bytes`` of Parquet on ``total_cores``.

    * file splits of ``target_partition_bytes`` (fewer, fuller scan tasks);
    * initial shuffle partitions so that a shuffle of the whole input gives
      ~``target_partition_bytes`` per reducer, at least 2 x cores; AQE then
      coalesces small ones toward the advisory size and splits skewed ones;
    * skew: a partition 5x the median and above 512 MB is split.
    For 100 TB on 1,000 executors x 8 cores: 409,600 shuffle partitions.
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder for this session.

    On a cluster the operator sets ``spark.checkpoint.dir`` to a shared
    filesystem path; we use it as is.  Only when it is unset and the master is
    local (unit tests, local runs) do we create a scratch folder; on a cluster
    a machine's own folder would be read back in part, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="segmint-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, how: str = "parquet") -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and continue from there.

    Used before iterative work (k-means, several reads of one sorted frame)
    so that a lost executor re-reads written files instead of re-running a
    long, possibly non-deterministic lineage.  ``release`` deletes the files.

    ``how="parquet"`` (default) writes a Parquet table under the checkpoint
    folder and reads it back: one job, compressed columns, and later reads
    prune columns.  ``how="checkpoint"`` uses ``Dataset.checkpoint``, which
    keeps the partitioning but runs the final stage twice (count, then write).
    ``localCheckpoint`` is never used: its blocks die with the executor.
    """
    spark = df.sparkSession
    root = checkpoint_dir(spark)
    if how == "checkpoint":
        return df.checkpoint(eager=True)
    path = f"{root.rstrip('/')}/segmint-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    written = spark.read.parquet(path)
    written._segmint_path = path
    inside = _scratch.get()
    if inside is not None:
        inside.append(written)
    return written


_scratch: ContextVar[list[DataFrame] | None] = ContextVar("segmint_scratch", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete, at the end, the files of every cut made inside: for callers that have written their results by then.

    Frames that read such a cut cannot be evaluated afterwards.  The list it gives holds the cuts so far; take one out
    to keep its files.  Scopes may be nested; an error deletes as well.
    """
    cuts: list[DataFrame] = []
    outer = _scratch.set(cuts)
    try:
        yield cuts
    finally:
        _scratch.reset(outer)
        for written in cuts:
            release(written)


def release(written: DataFrame) -> None:
    """Delete the files behind a frame that ``cut_lineage`` returned, once nothing reads them any more."""
    path = getattr(written, "_segmint_path", None)
    if path:
        spark = written.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
