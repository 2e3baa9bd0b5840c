"""Session defaults and lineage cutting."""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sedimenta")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: that of spark.checkpoint.dir, which all executors share.

    Where it is unset, a temporary folder serves in local mode only; on a cluster a machine-local folder would lose
    data, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sedimenta-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()



class _Open(threading.local):
    """Folders that cut() made within cuts() in this thread, innermost last."""

    def __init__(self):
        self.folders: list[list[str]] = []


_OPEN = _Open()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def cuts(spark: SparkSession):
    """What cut() writes within is deleted at the end; for work whose results are stored or on the driver by then."""
    _OPEN.folders.append([])
    try:
        yield
    finally:
        for path in _OPEN.folders.pop():
            _delete(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted at the end of cuts(), else when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN.folders:
        _OPEN.folders[-1].append(path)
    else:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into a table in the shared folder, without its lineage: lost executors take nothing with them."""
    path = scratch(df.sparkSession, "cut")
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, where it may not be installed. Spark serves it to executors that join later, too.

    Also settles for the session that a JSON object that repeats a key has its last value, as Python and SQL engines read it.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    sc = spark.sparkContext
    if getattr(sc, "_sedimenta_shipped", False):
        return
    here = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="sedimenta-")) / "sedimenta.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent).as_posix())
    sc.addPyFile(str(target))
    sc._sedimenta_shipped = True
