"""Where intermediate results are kept.

Lineage is cut only in the folder that the cluster names in ``spark.checkpoint.dir``: driver and
executors share it, so what is written there outlives a lost executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    Only a ``local[...]`` session (tests) may go without the setting; it then gets a temporary
    folder. On a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder; Spark drops the files with the DataFrame."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders and tables made by this driver, until they are released.
_made: list[str] = []
_tables: dict[str, str] = {}


def new_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/gridweave-{label}-{uuid.uuid4().hex}")
    return _made[-1]


def new_table(spark: SparkSession, label: str) -> tuple[str, str]:
    """A new folder in the shared folder, and the name of a table to be saved there: bucketed
    files are known to the catalogue only."""
    path, table = new_path(spark, label), f"gridweave_{label}_{uuid.uuid4().hex}"
    _tables[path] = table
    return path, table


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete folders made by :func:`new_path`, all of this driver's if none are named, and the tables
    of :func:`new_table` in them.

    Results are lazy: call it when those that read the folders have been written.
    """
    jvm = spark.sparkContext._jvm
    for path in list(_made) if paths is None else paths:
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in _made:
            _made.remove(path)
