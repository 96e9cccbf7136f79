"""Records from plain dicts, and back."""

from tallyrill.functions.record import SEQ, from_python, schema, to_python


def frame(spark, rows):
    """Records in the order given."""
    from pyspark.sql import types as T

    full = [
        (r.get("ts", 0), r.get("start"), {k: from_python(v) for k, v in r.get("resource", {}).items()}, r.get("scope"), r.get("name", "m"), float(r.get("value", 0)), {k: from_python(v) for k, v in r.get("attrs", {}).items()}, i)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, T.StructType([*schema().fields, T.StructField(SEQ, T.LongType())]))


def plain(df):
    return [
        {"ts": r["ts_nanos"], "start": r["start_ts_nanos"], "name": r["name"], "value": r["value"], "attrs": {k: to_python(v) for k, v in r["attrs"].items() if v is not None}}
        for r in df.select("ts_nanos", "start_ts_nanos", "name", "value", "attrs").collect()
    ]


def values(df):
    return sorted(r["value"] for r in plain(df))
