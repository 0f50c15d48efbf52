"""Small session helpers shared by the operators."""

from __future__ import annotations

import os
import sys
import sysconfig
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    That is enough where they share the driver's disk; elsewhere the package is sent along with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def by_value(plugged: object) -> object:
    """``plugged``, a function or class of the user's, so that closures carry its code to the workers.

    Code of installed packages is found there by name; that of a script or a module of the user's own needn't be.
    """
    module = sys.modules.get(getattr(plugged, "__module__", None) or type(plugged).__module__)
    file = os.path.abspath(getattr(module, "__file__", None) or "")
    installed = [sysconfig.get_paths()[k] for k in ("stdlib", "purelib", "platlib")] + [os.path.dirname(os.path.abspath(__file__))]
    if module is not None and module.__name__ != "__main__" and file and not file.startswith(tuple(d + os.sep for d in installed)):
        cloudpickle.register_pickle_by_value(module)
    return plugged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset and the master is
    local (tests) is a folder of this machine used instead; on a cluster an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "tesserakit-shared")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder, so a lost executor costs no recomputation chain."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)

