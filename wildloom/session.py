"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and tables of intermediate results.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a
    local session (tests, a laptop) gets a temporary folder of its own, which
    is removed when its JVM ends; on a cluster a folder of one machine would
    lose data, so there it is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not _local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wildloom-")
        _forget_at_exit(spark, named)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, the same for all applications; where it is unset that of :func:`checkpoint_dir`."""
    return (spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)).rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one; it is removed when the driver's JVM ends or by :func:`release`."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/wildloom-{spark.sparkContext.applicationId}"
    if path not in _scratch:
        _forget_at_exit(spark, path)
        _scratch.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; frames that read them can no longer be computed."""
    path = scratch_dir(spark)
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)
    _scratch.discard(path)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder and cut its lineage.

    The copy is replicated by the shared folder, so a lost executor costs a
    reread, not a failure. Spark removes it once the frame is out of use where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, stem: str) -> DataFrame:
    """Compute ``df`` once into a compressed table of the shared folder and read it from there.

    For rows that several branches of a plan or the next round of an iteration
    need. Unlike a checkpoint the table has its true size, where the size that
    Catalyst estimates for a joined frame grows with every round.
    """
    return stored_counting(df, stem, F.lit(True))[0]


def stored_counting(df: DataFrame, stem: str, condition: Column) -> tuple[DataFrame, int]:
    """:func:`stored`, and the number of rows that meet ``condition``, counted on the way."""
    path = f"{scratch_dir(df.sparkSession)}/{stem}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count_if(condition).alias("n")).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def parallelism(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session makes."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(stem: str) -> str:
    """A column name that no input column has."""
    return f"__{stem}_{uuid.uuid4().hex[:8]}"


def columns_or_fail(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; timestamps come as TIMESTAMP_NTZ."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str):
    """Column by exact name, dots included."""
    return F.col(quoted(name))


_shipped: set[str] = set()
_scratch: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="wildloom-code-")) / "wildloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
