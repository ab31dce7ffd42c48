"""Session helpers: local test session, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Above this many rows a "small" side is not broadcast; the join falls back to a shuffle.
DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "annualis") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ANNUALIS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def session_key(spark: SparkSession) -> str:
    """Identity of the running application (Spark Connect sessions have no SparkContext)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def parallelism(spark: SparkSession) -> int:
    """Default task parallelism of the session (cores of local mode, executors x cores)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        v = spark.conf.get("spark.default.parallelism", None)
        return int(v) if v else (os.cpu_count() or 8)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session (tests, bench) without one gets a scratch folder of its own; on a
    cluster a machine-local folder would be unreadable elsewhere, so a missing setting is
    an error there.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="annualis-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names; errors other than absence rise."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read again: every later
    scan reads the columns it needs only."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it is proven small: at most ``max_rows`` rows and about
    ``max_bytes`` (estimated by the JSON length of its rows, an over-estimate for
    numeric arrays such as question vectors).  Otherwise the plain DataFrame is returned
    and Spark plans a shuffle join (AQE may still convert it at run time).

    The check is one aggregate over at most ``max_rows + 1`` rows of the small side."""
    capped = df.limit(max_rows + 1)
    r = capped.agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.sum(F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))), F.lit(0)).alias("b")
                   ).first()
    return F.broadcast(df) if r["n"] <= max_rows and r["b"] <= max_bytes else df
