"""Session set-up and the shared scratch space used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  Everything else (executors, memory, shuffle
# partitions) belongs to the cluster's own configuration.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app_name: str = "prodlake", conf: dict[str, str] | None = None) -> SparkSession:
    """Create or reuse a session; ``conf`` overrides the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would lose its files together with the machine.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="prodlake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, next to the checkpoints."""
    return f"{checkpoint_root(spark)}/prodlake-scratch/{uuid.uuid4().hex}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder.

    Needed where two branches of one plan must see bit-identical rows: sums of
    doubles depend on the order in which shuffle blocks arrive, so a branch that
    is computed again after an executor loss may differ in the last bit.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the scratch folder and read it back.

    For the same need as ``checkpointed`` where later plans read a few columns only.  The folder
    is deleted when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder.getParent())
    return spark.read.schema(df.schema).parquet(path)
