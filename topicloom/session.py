"""Session defaults and the shared folder in which jobs write the tables that cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

# Above this bytecode size the JVM no longer compiles a method, so a wide generated stage would run
# interpreted; Spark then falls back to many small generated methods, which do get compiled.
JIT_METHOD_LIMIT = "8000"
# Bytes of rows that go to a Python worker at once in a stage of the corpus pipeline, or where tiles of a matrix meet.
BATCH_BYTES = 4 << 20


def build_session(app: str = "topicloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for. Any existing session works as well."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.codegen.hugeMethodLimit": JIT_METHOD_LIMIT,
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def wide_expressions(spark: SparkSession):
    """Keep stages with one expression per topic compilable while their actions run."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, JIT_METHOD_LIMIT)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Let Spark remove the shuffle files of an action when it ends, as what it wrote is read instead.

    Without it they stay until the driver collects its garbage, and a job of many steps holds those of all its steps.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bounded_batches(spark: SparkSession) -> None:
    """Let at most BATCH_BYTES of rows go to a Python worker at once, unless the session allows less.

    Spark's own limit is 64 MB, which a task holds several times on both sides. What an operator returns is computed when
    its caller writes it, so the setting stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="topicloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class RunFolder:
    """One job's own folder below the checkpoint root, or the folder ``path`` of a job to be taken up.

    A table written here is a cut in the lineage that survives the loss of any executor. Loops write to
    two alternating slots, so a run never holds more than its last two states. With ``passing`` the shuffles of a
    written table go once it is written.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, passing: bool = False):
        self.spark = spark
        self.passing = passing
        self.path = path.rstrip("/") if path else f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        target = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with passing_shuffles(self.spark) if self.passing else nullcontext():
            writer.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def write_slot(self, df: DataFrame, name: str, step: int, partition_by: str | None = None) -> DataFrame:
        return self.write(df, f"{name}-{step % 2}", partition_by)

    def complete(self, name: str) -> bool:
        """Whether the table was written to its end."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def read_slot(self, name: str, step: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}-{step % 2}")

    def drop(self, name: str) -> None:
        """Removes a table that nothing needs any more."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
