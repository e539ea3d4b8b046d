"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset (spark-submit supplies it) and pass
    ``spark.checkpoint.dir`` as a shared folder.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans here have many columns; recording a call site for each is slow.
        "spark.sql.dataFrameQueryContext.enabled": "false",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, whose tasks import it.

    On a cluster the driver's source folder is not there. The archive stays with
    the driver, from which Spark hands it to every executor, also to later ones.
    """
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="panelwright-")) / "panelwright.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a machine-local
    path would be unreadable for the other executors of a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelwright-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later steps then neither recompute the upstream scan nor depend on any
    executor staying alive, and the planner sees the table's real size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_in = path
    return out


def let_go(*steps: DataFrame) -> None:
    """Delete the files of settled tables that no later step reads."""
    for df in steps:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
