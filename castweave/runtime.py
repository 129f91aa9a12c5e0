"""Session helpers shared by all operators: table access and durable lineage cuts."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test or production table, read lazily so that Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is made only for a local master where nothing is set; on a cluster a
    missing setting is an error, because a machine-local folder would not survive an executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="castweave-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_bare(df: DataFrame) -> DataFrame:
    """:func:`cut` without the estimated size of ``df``, for loops whose rounds join what earlier rounds cut.

    A checkpoint keeps the estimate, and that of a join is the product of its inputs: over rounds it becomes a number
    of millions of digits that the driver holds with every plan. Joins go by the sizes that are met as they run.
    """
    frame = cut(df)
    session = df.sparkSession
    plan = frame._jdf.queryExecution().logical()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(plan.rdd(), frame._jdf.schema(), False), session)


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that executors need no installed copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
