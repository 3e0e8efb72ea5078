"""Tables by name, and intermediate tables on storage that every executor shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    Where none is named, a folder of this machine serves a session whose executors are threads of it; any other is an error,
    as executors elsewhere could not read what one of them wrote.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="kinmesh-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_SWEPT: set[str] = set()


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/kinmesh-{spark.sparkContext.applicationId}"
    if path not in _SWEPT:
        _SWEPT.add(path)
        atexit.register(_sweep, spark, path)
    return path


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        delete(spark, path)


class Scratch:
    """Written tables that cut lineage and outlive lost executors.

    put() writes a frame and returns it read back; drop() deletes tables that no later plan reads. What a lazy result still
    reads stays until sweep() or the end of the driver.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """by: a column of few values, each of which gets a folder of its own."""
        path = self.path()
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._kinmesh_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, df._kinmesh_path)

    def sweep(self) -> None:
        delete(self.spark, self.root)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
