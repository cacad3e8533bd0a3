"""A session with the settings that results depend on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[tuple, str] = {}


def session(app: str = "skein", **conf: str) -> SparkSession:
    """Instants are UTC, plans are adaptive; further settings by name with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; on a cluster it has to be set, in local mode the warehouse serves."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return place or spark.conf.get("spark.sql.warehouse.dir")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: what follows neither computes it again nor depends on executors."""
    path = f"{scratch_dir(df.sparkSession)}/skein-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Sizes and times of change of some inputs, by which a table made from them is told from one of other contents."""
    out = []
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out.append((fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()))
    return tuple(out)


def stored_path(spark: SparkSession, name: str, write, made_from: list[str] | None = None) -> str:
    """Where ``write(path)`` has put a table, once for a session and the contents of ``made_from``, under the shared folder."""
    key = (spark.sparkContext.applicationId, name, state_of(spark, made_from or []))
    if key not in _STORED:
        path = f"{scratch_dir(spark)}/skein-stored-{uuid.uuid4().hex}"
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored(spark: SparkSession, name: str, build, made_from: list[str] | None = None) -> DataFrame:
    """The table ``build()`` gives, written once as above and read from there by later queries."""
    return spark.read.parquet(stored_path(spark, name, lambda path: build().write.parquet(path), made_from))
