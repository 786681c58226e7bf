"""Reading and writing tables, checking declarations, profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = {"csv": ",", "tsv": "\t"}


@dataclass
class Spec:
    """What a table's columns are for."""

    continuous: list[str] = field(default_factory=list)
    discrete: list[str] = field(default_factory=list)
    target: str | None = None
    task: str = "classification"
    keys: list[str] = field(default_factory=list)
    sensitive: list[str] = field(default_factory=list)
    constraints: list[str] = field(default_factory=list)
    delta: float | None = None


def read_table(spark: SparkSession, path: str, fmt: str = "csv", sep: str | None = None, drop_columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A table by its declared format; with a schema (DDL) a text file has no header. Declared columns to drop that exist go."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        r = spark.read.options(sep=sep or SEPARATORS.get(fmt, ","), header=schema is None)
        df = (r.schema(schema) if schema else r).csv(path)
    return df.drop(*[c for c in drop_columns or [] if c in df.columns])


def read_lenient(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Rows that fit the schema, quotes being ordinary characters; index columns (Unnamed...) and rows with a NULL go."""
    df = spark.read.schema(schema).options(sep=sep, header=header, mode="DROPMALFORMED", quote="").csv(path)
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed")]).na.drop("any")


def write_table(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    if fmt == "parquet":
        df.write.parquet(path)
    else:
        df.write.options(sep=SEPARATORS[fmt], header=True).csv(path)


def write_cohorts(df: DataFrame, column: str, path: str) -> None:
    """A folder for each value, its rows dealt over all tasks."""
    df.write.partitionBy(column).parquet(path)


def value_counts(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """column, value, n of every column whose name holds none of the substrings."""
    columns = [c for c in df.columns if not any(x in c for x in exclude)]
    return df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def as_json(counts: DataFrame) -> DataFrame:
    """value: one JSON line for each row of counts."""
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("value"))


def check_spec(df: DataFrame, spec: Spec) -> list[str]:
    """What is wrong with a declaration, in words; empty if nothing is."""
    have, issues = set(df.columns), []
    for kind in ("continuous", "discrete", "keys", "sensitive"):
        issues += [f"{kind} column {c} doesn't exist" for c in getattr(spec, kind) if c not in have]
    if spec.target and spec.target not in have:
        issues.append(f"target {spec.target} doesn't exist")
    if spec.task not in ("classification", "regression"):
        issues.append(f"task {spec.task} is unknown")
    for c in spec.constraints:
        try:
            df.limit(0).where(F.expr(c)).schema  # noqa: B018  the analysis is the check
        except (AnalysisException, ParseException):
            issues.append(f"constraint {c} can't be read")
    if spec.delta is not None and spec.delta * df.count() >= 1:
        issues.append("delta isn't below one over the number of rows")
    return issues


def collect_scores(spark: SparkSession, glob: str, pattern: str, names: list[str]) -> DataFrame:
    """Score files (metric, value with a header) under a glob as one table, with parts of their paths as columns."""
    x = spark.read.schema("metric string, value double").options(header=True).csv(glob).withColumn("_f", F.input_file_name())
    return x.withColumns({n: F.regexp_extract("_f", pattern, i + 1) for i, n in enumerate(names)}).drop("_f")
