"""Delimited tables, scalars and vectors as text; sinks that appear whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.plans.ranks import ranked


def read_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A table of fields set apart by white space, all as text, with original_row from 1 in file order.

    Blank lines don't count. Refused: no data row, a repeated or missing column, a row of another width than the header.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"), F.monotonically_increasing_id().alias("id")).where("line <> ''")
    head = lines.orderBy("id").limit(1).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = head["line"].split(" ")
    if len(set(names)) < len(names):
        raise ValueError(f"{path} repeats a column")
    if lacking := sorted(set(required) - set(names)):
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    rows = lines.where(F.col("id") > head["id"]).select("id", F.split("line", " ").alias("f"))
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.size("f") != len(names)).alias("odd")).first()
    if not found["n"]:
        raise ValueError(f"{path} has no row")
    if found["odd"]:
        raise ValueError(f"{path} has {found['odd']} rows of another width than its header")
    fields = [F.col("f")[k].alias(n) for k, n in enumerate(names)]
    return ranked(rows, [F.col("id")], "original_row").select("original_row", *fields)


def read_scalar(spark: SparkSession, path: str, low: float = 0.0, high: float = 1.0) -> float:
    """The one number of a file, above low and at most high."""
    tokens = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("t")).where("t <> ''")
    found = tokens.limit(2).collect()  # two are one too many
    if len(found) != 1:
        raise ValueError(f"{path} must hold one number")
    value = float(found[0]["t"])
    if not low < value <= high:
        raise ValueError(f"{value} is not above {low} and at most {high}")
    return value


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): whole numbers under 2**63, one a line, place from 0."""
    rows = spark.read.text(path).select(F.trim("value").alias("t"), F.monotonically_increasing_id().alias("id")).where("t <> ''")
    rows = rows.select("id", F.when(F.col("t").rlike("^[0-9]+$"), F.col("t").try_cast("long")).alias("value"))
    if not rows.where("value is null").isEmpty():
        raise ValueError(f"{path} holds something else than whole numbers")
    return ranked(rows, [F.col("id")], "place", 0).select("place", "value")


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table as write_tsv leaves it."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, nullValue="NA")


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, rows: int | None = None) -> DataFrame:
    """JSON lines, packed or not; refused if there are not `rows` of them."""
    df = spark.read.schema(schema).json(path)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    return df


def _moved(spark: SparkSession, path: str, write) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}._staged")
    files = at.getFileSystem(conf)
    if files.exists(at):
        raise FileExistsError(path)
    files.delete(staged, True)
    write(staged.toString())
    if not files.rename(staged, at):
        raise OSError(f"cannot move to {path}")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header and NA for null, written aside and moved. An existing path is refused."""
    _moved(df.sparkSession, path, lambda to: df.write.csv(to, sep="\t", header=True, nullValue="NA"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Packed JSON lines, written aside and moved."""
    _moved(df.sparkSession, path, lambda to: df.write.option("compression", "gzip").json(to))


def publish(tables: dict[str, DataFrame], path: str, about: dict) -> None:
    """All tables as Parquet and about.json under one path, which appears when everything is written."""
    spark = next(iter(tables.values())).sparkSession

    def write(to: str) -> None:
        for name, df in tables.items():
            df.write.parquet(f"{to}/{name}")
        text = json.dumps(about, sort_keys=True, allow_nan=False)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{to}/about")

    _moved(spark, path, write)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of a file or folder's files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
