"""Records from lines of JSON. Blank lines are ignored and malformed ones left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.record import ARRIVAL, ATTR, BOOL, DOUBLE, INT, SEQ, STR, attr, record
from .files import arrival, lines


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _attr(v: Column) -> Column:
    kind = _kind(v)
    get = lambda t: F.try_variant_get(v, "$", t)
    return (
        F.when(kind == "BOOLEAN", attr(get("boolean"), BOOL))
        .when(kind == "BIGINT", attr(get("bigint"), INT))
        .when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), attr(get("double"), DOUBLE))
        .when(kind == "STRING", attr(get("string"), STR))
    )


def parsed(df: DataFrame, line: str = "value") -> DataFrame:
    """Records of a frame of lines; SEQ and ARRIVAL are kept if they are there."""
    v = F.col("_v")
    at = lambda path: F.try_variant_get(v, path, "variant")
    rows = df.where(F.trim(line) != "").withColumn("_v", F.try_parse_json(line)).where("_v is not null")

    def whole(path: str) -> Column:
        return F.when(_kind(at(path)) == "BIGINT", F.try_variant_get(v, path, "bigint"))

    def attrs(path: str) -> Column:
        given = F.try_variant_get(v, path, "map<string,variant>")
        return F.coalesce(F.transform_values(given, lambda _, x: _attr(x)), F.create_map().cast(f"map<string,{ATTR}>"))

    def absent(path: str) -> Column:
        return at(path).isNull() | (_kind(at(path)) == "VOID")

    def map_ok(path: str, column: str) -> Column:
        object_ = at(path).isNull() | (_kind(at(path)) == "OBJECT")
        return object_ & ~F.exists(F.map_values(column), lambda a: a.isNull())

    rows = rows.withColumns({
        "_ts": whole("$.ts_nanos"), "_start": whole("$.start_ts_nanos"), "_name": F.when(_kind(at("$.name")) == "STRING", F.try_variant_get(v, "$.name", "string")),
        "_value": F.when(_kind(at("$.value")).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$.value", "double")),
        "_scope": F.when(_kind(at("$.scope")) == "STRING", F.try_variant_get(v, "$.scope", "string")), "_resource": attrs("$.resource"), "_attrs": attrs("$.attrs"),
    })
    good = rows.where(
        (F.col("_ts") >= 0) & F.col("_name").isNotNull() & F.col("_value").isNotNull()
        & ((F.col("_start") >= 0) | absent("$.start_ts_nanos")) & (F.col("_scope").isNotNull() | absent("$.scope"))
        & map_ok("$.resource", "_resource") & map_ok("$.attrs", "_attrs")
    )
    return record(good, ts_nanos=F.col("_ts"), start_ts_nanos=F.col("_start"), name=F.col("_name"), value=F.col("_value"), scope=F.col("_scope"), resource=F.col("_resource"), attrs=F.col("_attrs"), seq=F.col(SEQ) if SEQ in df.columns else None, more=tuple(c for c in df.columns if c == ARRIVAL))


def batch(spark: SparkSession, path: str) -> DataFrame:
    """Records of text files, in the order of files and lines."""
    return parsed(lines(spark, path))


def stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parsed(reader.load(path).select("value", arrival()))
