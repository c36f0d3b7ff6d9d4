"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T


_LOCAL_ROOTS: dict[str, str] = {}
#: Folders of intermediate tables, by application.
_SCRATCH: dict[str, list[str]] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without any checkpoint folder (tests) gets a temporary one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="gridwash-")
    return _LOCAL_ROOTS[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table; :func:`drop_scratch` deletes it."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_tables(spark: SparkSession) -> list[str]:
    """Folders of the intermediate tables that this application has written so far."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, keep=()) -> int:
    """Delete the intermediate tables of this application, but for the folders in
    ``keep``; the number of them.

    Call it when a run is over: results that still read such a table are lost with it.
    """
    known = _SCRATCH.get(spark.sparkContext.applicationId, [])
    gone = [path for path in known if path not in keep]
    for path in gone:
        _delete(spark, path)
        known.remove(path)
    return len(gone)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back: cuts the lineage,
    so a lost executor only costs the tasks it was running.

    A table with types that Parquet has not gets a reliable checkpoint instead.
    """
    if not df.columns or any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema):
        return cut_lineage(df)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the folder of a table that :func:`stored` wrote and nothing reads any more."""
    known = _SCRATCH.get(df.sparkSession.sparkContext.applicationId, [])
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for path in [p for p in known if folder.endswith(p.rsplit("/", 1)[-1])]:
            _delete(df.sparkSession, path)
            known.remove(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)
