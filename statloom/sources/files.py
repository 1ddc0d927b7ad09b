"""CSV, Parquet, JSON and statistical data files."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.errors import CommandError
from statloom.plans.expressions import quote

KINDS = ("csv", "parquet", "json", "dta")


def kind_of(name: str) -> str | None:
    m = re.search(r"\.([A-Za-z]+)/?$", name)
    return m.group(1).lower() if m and m.group(1).lower() in KINDS else None


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as long, as text files do not say how wide they are."""
    small = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegerType)]
    return df.withColumns({n: F.col(quote(n)).cast("long") for n in small}) if small else df


def read(spark: SparkSession, name: str, kind: str | None = None) -> DataFrame:
    """A file by its extension, or a table by its name."""
    kind = kind or kind_of(name)
    try:
        if kind == "csv":
            return widened(spark.read.csv(name, header=True, inferSchema=True, quote='"', escape='"'))
        if kind == "parquet":
            return spark.read.parquet(name)
        if kind == "json":
            # an array of records or one record per line; only both ends of a first line reach the driver
            first = spark.read.text(name).limit(1).select(F.substring(F.ltrim("value"), 1, 1).alias("a"), F.substring(F.rtrim("value"), -1, 1).alias("z")).collect()
            many = bool(first) and first[0]["a"] in ("[", "{") and first[0]["z"] != "}"
            return widened(spark.read.json(name, multiLine=many))
        if kind == "dta":
            from statloom.sources import dta

            return dta.read(spark, name)
        return spark.table(name)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "TABLE_OR_VIEW_NOT_FOUND" in str(e) or isinstance(e, FileNotFoundError):
            raise CommandError(f"cannot open {name}") from e
        raise


def source_sql(name: str, kind: str | None = None) -> str:
    """How SQL text names a source."""
    kind = kind or kind_of(name)
    return f"{kind}.{quote(name)}" if kind else ".".join(quote(p) for p in name.split("."))


def write(df: DataFrame, path: str, kind: str | None = None, labels: dict | None = None, value_labels: dict | None = None, attached: dict | None = None) -> None:
    """Write a dataset; an older one is replaced only when the new one is complete, so a source can be saved onto itself."""
    kind = kind or kind_of(path) or "parquet"
    if kind == "dta":
        from statloom.sources import dta

        dta.write(df, path, labels or {}, value_labels, attached)
        return
    spark = df.sparkSession
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    writer = df.write.mode("overwrite")
    if kind == "csv":
        flat = [F.to_json(F.col(quote(f.name))).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(quote(f.name)) for f in df.schema.fields]
        df.select(*flat).write.mode("overwrite").csv(part, header=True, escape='"')
    elif kind == "json":
        writer.json(part)
    else:
        writer.parquet(part)
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.delete(old, True)
    if not fs.rename(new, old):
        raise CommandError(f"cannot write {path}")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or, on a local master without it, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise CommandError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="statloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone
        pass


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: short lineage that outlives the loss of an executor."""
    spark = df.sparkSession
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    df = df.withColumns({n: F.lit(None).cast("string") for n in void}) if void else df
    path = scratch(spark)
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(schema).parquet(path)
