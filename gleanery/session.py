"""Session helpers: building a session, checkpointing, and the partitions of inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Whole pages and long documents travel in Arrow batches: keep a batch small in bytes.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only in local mode where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="gleanery-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Materialise as parquet in the shared checkpoint folder: unlike after a checkpoint, each step reads only its columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Parquet tables for the length of one run, in a folder of their own below the checkpoint folder.

    For wide rows that many steps read: unlike a checkpoint, each step reads only its columns.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Inputs in as many partitions as the session's `spark.gleanery.inputPartitions` asks for; as scanned where it is unset.

    A file with one row group is read by one task however many cores there are. Whoever runs on such files sets the number;
    the plan depends on the setting only, never on the size of the input.
    """
    wanted = df.sparkSession.conf.get("spark.gleanery.inputPartitions", None)
    return df.repartition(int(wanted), key) if wanted else df
