"""Where intermediate tables live: the folder in ``spark.checkpoint.dir``, shared by all.

A written table cuts lineage and survives any executor; every intermediate table that is
read more than once is one.  Names are unique per call, so concurrent queries don't
collide.  ``free`` deletes the tables written since a ``mark``, once the result that reads
them has been stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "/tmp/checkpoints"  # for a session on one machine that names no folder
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _LOCAL).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and gives the table that was written: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagemill-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _paths.append(path)
    return spark.read.schema(schema).parquet(path)


def mark() -> int:
    """The present, for ``free``."""
    return len(_paths)


def free(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables written since a mark; frames that read them no longer work.

    ``keep`` are names of tables that stay.
    """
    for path in _paths[since:]:
        if not any(f"/pagemill-{name}-" in path for name in keep):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            _paths.remove(path)


def tasks(spark: SparkSession) -> int:
    """Partitions that a shuffle should have here."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def narrow(df: DataFrame, share: int = 8) -> DataFrame:
    """``df`` in a share of the usual partitions: for tables of a few numbers a row, which would
    otherwise be many small files.  A shuffle of these rows lies before them, so what computes
    them keeps all of its tasks."""
    return df.repartition(max(1, tasks(df.sparkSession) // share))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each i < n an integer that hash partitioning into n sends to partition i.

    Keys dealt this way fill n partitions evenly; any other number of partitions still
    works, less evenly.  The job reads no data and returns n rows.
    """
    tried = int(n * (20 + 4 * max(1, n).bit_length()))
    found = (
        spark.range(0, tried, 1, 1).selectExpr("cast(id as int) id", f"pmod(hash(cast(id as int)), {n}) at")
        .groupBy("at").min("id").collect()
    )
    keys = {row[0]: row[1] for row in found}
    return [keys.get(i, tried + i) for i in range(n)]
