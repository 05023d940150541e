"""Tables that a query writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="evispark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, however often it is used, and
    still there when an executor is lost. The planner knows its size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/evispark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, wherever they run; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="evispark-code-")  # the driver hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path, root = f"{folder}/{os.path.basename(_PACKAGE)}.zip", os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    out.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
