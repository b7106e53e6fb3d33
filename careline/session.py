"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings, safe to apply to a session somebody else created.
# forceOptimizeSkewedJoin lets the engine split a hot key in every shuffled join,
# also where the split costs one more shuffle afterwards.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a running session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "careline", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_CONF, **(extra_conf or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only where `spark.checkpoint.dir` is unset, as in local tests, is a fresh
    local folder used; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="careline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Shuffle files of a query are deleted when it ends; otherwise when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_writing = threading.Lock()
#: Writes under way, and the setting before the first of them.
_writes: dict[str, list] = {}


def write_once(df: DataFrame, path: str) -> None:
    """Write Parquet and delete what was exchanged for it: the files are what is read from then on.

    Threads may write at once; the last to end restores the setting.
    """
    conf, key = df.sparkSession.conf, str(df.sparkSession._jsparkSession.hashCode())
    with _writing:
        _writes.setdefault(key, [0, conf.get(FREE_SHUFFLES, None)])[0] += 1
        conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        with _writing:
            _writes[key][0] -= 1
            if not _writes[key][0]:
                before = _writes.pop(key)[1]
                if before is None:
                    conf.unset(FREE_SHUFFLES)
                else:
                    conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there.

    Several uses of the result then share one computation, and a lost executor
    costs a read, not a repetition.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
