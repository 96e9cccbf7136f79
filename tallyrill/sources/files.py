"""Lines of text files in their order of arrival: files by modification time and path, blocks of a file, lines of a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.record import ARRIVAL, SEQ

#: The most blocks whose places are broadcast (some 200 bytes each).
MOST_BLOCKS = 100_000


def arrival() -> Column:
    """ARRIVAL of the lines of a stream of files."""
    m = "_metadata.file_"
    return F.format_string("%020d %s %020d", F.unix_micros(f"{m}modification_time"), F.col(f"{m}path"), F.col(f"{m}block_start")).alias(ARRIVAL)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and SEQ. Spark packs blocks by size, not in order, so those of several files are numbered in a pass of its own."""
    text = spark.read.text(path)
    row = F.monotonically_increasing_id()  # in order within a block; a single file's blocks are in order, too
    if len(text.inputFiles()) < 2:
        return text.withColumn(SEQ, row)
    m = "_metadata.file_"
    place = {"_time": F.unix_micros(f"{m}modification_time"), "_path": F.col(f"{m}path"), "_start": F.col(f"{m}block_start")}
    blocks = text.select(*(c.alias(n) for n, c in place.items())).distinct()
    blocks = blocks.select("_path", "_start", F.row_number().over(W.orderBy(*place)).alias("_nth"))  # a row for each block
    if blocks.count() <= MOST_BLOCKS:
        blocks = F.broadcast(blocks)
    rows = text.select("value", *(place[n].alias(n) for n in ("_path", "_start")), row.alias("_row"))
    in_block = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(blocks, ["_path", "_start"]).select("value", (F.shiftleft(F.col("_nth").cast("bigint"), 33) + in_block).alias(SEQ))
