"""Readers and writers of rollout batches, tolerant and strict JSON lines, and keyed artifacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordinals import numbered


@dataclass(frozen=True)
class Columns:
    """Names of the columns of a rollout table."""

    group: str = "group_id"
    program: str = "program"
    rollouts: str = "rollouts"
    response: str = "response"
    order: str = "ord"


def rows(spark: SparkSession, path: str, schema: T.StructType | None = None, strict: bool = True) -> DataFrame:
    """JSON lines or Parquet by extension; strict fails on a bad line, tolerant drops it. Blank lines are skipped."""
    if ".parquet" in path:
        return spark.read.parquet(path)
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (df.write.mode(mode).parquet if ".parquet" in path else df.write.mode(mode).json)(path)


def clauses_of(rollout: F.Column) -> F.Column:
    """Clauses of a rollout given as text: a JSON list, an object with invariants or code, or annotated text."""
    from ..functions.clauses import extract

    text, empty = F.trim(rollout), F.array().cast("array<string>")
    listed = lambda json: F.from_json(json, "array<string>", {"mode": "PERMISSIVE"})
    given, code = F.get_json_object(text, "$.invariants"), F.get_json_object(text, "$.code")
    said = F.when(F.size(extract(given)) > 0, extract(given)).otherwise(F.array(given))
    several = given.startswith("[") & listed(given).isNotNull()
    of_object = F.when(several & (F.size(listed(given)) > 0), listed(given)).when(~several & (given != ""), said).when(code != "", extract(code)).otherwise(empty)
    is_object = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull()
    return F.when(text.startswith("[") & listed(text).isNotNull(), listed(text)).when(text.startswith("{") & is_object, of_object).otherwise(extract(rollout))


def _texts(df: DataFrame, name: str) -> F.Column:
    """A column of rollouts as an array of texts; anything that isn't text is its JSON, a single rollout is a list of one."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.ArrayType):
        return F.array(F.col(name) if isinstance(kind, T.StringType) else F.to_json(name))
    return F.col(name) if isinstance(kind.elementType, T.StringType) else F.transform(name, F.to_json)


def _placed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of each row in its input."""
    return numbered(df.withColumn("__row", F.monotonically_increasing_id()), [], ["__row"], name).drop("__row", "n")


def grouped(df: DataFrame, names: Columns = Columns()) -> DataFrame:
    """(group_id, program, rollout_index, clauses) of one row per group; a row without a group gets its place as one.

    A table without a group column is numbered over all partitions by row order.
    """
    if names.group not in df.columns:
        df = _placed(df, "__n").withColumn(names.group, F.col("__n").cast("string"))
    program = F.col(names.program) if names.program in df.columns else F.lit(None)
    out = df.select(F.col(names.group).cast("string").alias("group_id"), program.cast("string").alias("program"), F.posexplode_outer(_texts(df, names.rollouts)).alias("rollout_index", "rollout")).where("rollout_index is not null")
    return out.select("group_id", "program", "rollout_index", clauses_of(F.col("rollout")).alias("clauses"))


def _flat_rows(df: DataFrame, names: Columns) -> DataFrame:
    """(group_id, program, response, ord): a row without a group belongs to its program; without an order, rows keep theirs."""
    have = df.columns
    if names.order not in have:
        df = _placed(df, names.order)
    group = F.coalesce(*[F.col(c).cast("string") for c in (names.group, names.program) if c in have])
    program = F.col(names.program) if names.program in have else F.lit(None).cast("string")
    return df.select(group.alias("group_id"), program.alias("program"), F.coalesce(F.col(names.response), F.lit("")).alias("response"), F.col(names.order).alias("ord"))


def flat(df: DataFrame, names: Columns = Columns()) -> DataFrame:
    """One row per response -> (group_id, program, responses): grouped by group or else by program, wherever the rows stand."""
    parts = _flat_rows(df, names).groupBy("group_id").agg(F.min_by("program", "ord").alias("program"), F.array_sort(F.collect_list(F.struct("ord", "response"))).alias("r"))
    return parts.select("group_id", "program", F.transform("r", lambda x: x["response"]).alias("responses"))


def flat_rollouts(df: DataFrame, names: Columns = Columns()) -> DataFrame:
    """One row per response -> (group_id, program, rollout_index, clauses); no group is put into one row."""
    one = _flat_rows(df, names)
    programs = one.groupBy("group_id").agg(F.min_by("program", "ord").alias("program"))
    placed = numbered(one.drop("program"), ["group_id"], ["ord"], "rollout_index").drop("n")
    return placed.join(programs, "group_id").select("group_id", "program", F.col("rollout_index").cast("int").alias("rollout_index"), clauses_of(F.col("response")).alias("clauses"))


def batches(df: DataFrame, names: Columns = Columns()) -> DataFrame:
    """(group_id, program, rollout_index, clauses) of either layout: grouped if there is a column of rollouts, else flat."""
    return grouped(df, names) if names.rollouts in df.columns else flat_rollouts(df, names)


def score_file(spark: SparkSession, path: str, out: str, examples: DataFrame, scope: DataFrame | None = None, names: Columns = Columns(), **options) -> dict[str, int]:
    """Scores a file of rollouts into a file of rewards, both JSON lines or Parquet; returns the numbers of batches, failed batches, rows and programs.

    A batch fails if its program has no examples.
    """
    from ..operators.scoring import score_rollouts
    from ..session import materialize

    read = materialize(batches(rows(spark, path), names), "batches")
    write_rows(score_rollouts(read, examples, scope, **options).withColumnRenamed("group_id", names.group), out)
    seen = read.select("group_id", F.coalesce("program", F.lit("")).alias("program")).distinct()
    known = examples.select(F.coalesce("program", F.lit("")).alias("program")).distinct()
    failed = seen.join(known, "program", "left_anti").count()
    return {"batches": seen.count(), "failed": failed, "rows": rows(spark, out).count(), "programs": seen.join(known, "program", "left_semi").select("program").distinct().count()}


def canonical_json(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., body, sha256): each row as JSON with its fields in name order."""
    body = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(*key, body.alias("body"), F.sha2(body, 256).alias("sha256"))


def write_artifacts(df: DataFrame, key: list[str], path: str) -> None:
    """gzip JSON lines of canonical rows."""
    canonical_json(df, key).select(F.col("body").alias("value")).write.option("compression", "gzip").text(path)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """CSV with fixed fields, or with all in name order and nested values as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    fields = fields or sorted(df.columns)
    out = df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in fields if c in df.columns])
    out.write.option("header", True).csv(path)


def newest_files(spark: SparkSession, path: str, key_pattern: str) -> DataFrame:
    """(key, path) of the newest file of each key, which is the first group of the pattern in the path."""
    found = spark.read.format("binaryFile").load(path).select("path", "modificationTime", F.regexp_extract("path", key_pattern, 1).alias("key"))
    return found.where("key <> ''").groupBy("key").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def corpus(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(path, source) of whole text files; a wrong number of files fails."""
    found = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("source"))
    if expected is not None and (n := found.count()) != expected:
        raise ValueError(f"{n} files, not {expected}")
    return found
