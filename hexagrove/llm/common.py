"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import inspect
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters 0x20 and 0x09-0x0D.
WHITE = " \t\n\x0b\x0c\r"
#: The same class as a Java regular expression.
WHITE_RE = r"[\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(column: Column) -> Column:
    """The maximal runs of characters outside ``WHITE``; an empty array for a blank text."""
    return F.filter(F.split(column, WHITE_RE, -1), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names in ``spark.checkpoint.dir``.

    Where none is named, a temporary folder serves a local session, in which driver and executors are
    one process; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="shared")
    return f"{named}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder; for wide rows that are read again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """The intermediate Parquet tables of one call, each in the shared folder until it is dropped.

    A table may be dropped once all that reads it has been written itself: then no lost executor can
    ask for it again.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_folder(spark)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spare_name(name: str, columns: list[str]) -> str:
    """``name``, or a longer one where ``columns`` hold it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sets_aside(function):
    """An operator whose first table may have any other columns: those that a call doesn't name wait under names that
    clash with nothing, in any case, and come back in the result. One named like a new column of the result, in any case, is replaced by it."""
    signature = inspect.signature(function)

    @functools.wraps(function)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        call = signature.bind(docs, *args, **kwargs)
        call.apply_defaults()
        named = {v for v in call.arguments.values() if isinstance(v, str)}
        prefix = spare_name("aside", [c[:n] for c in docs.columns for n in range(len(c) + 1)])
        safe = [c if c in named else f"{prefix}{i}" for i, c in enumerate(docs.columns)]
        if safe == docs.columns:
            return function(docs, *args, **kwargs)
        if isinstance(keep := call.arguments.get("keep"), list):
            call.arguments["keep"] = [safe[docs.columns.index(c)] for c in keep]
        call.arguments[next(iter(signature.parameters))] = docs.toDF(*safe)
        out = function(*call.args, **call.kwargs)
        back = {s: c for s, c in zip(safe, docs.columns) if s != c}
        own = {c.lower() for c in out.columns if c not in back and c not in named}
        out = out.drop(*(s for s, c in back.items() if c.lower() in own))
        return out.toDF(*(back.get(c, c) for c in out.columns))

    return run


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast of ``df`` only when its counted ``rows`` are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
