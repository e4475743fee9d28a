"""Text files by the line, for formats that Spark's readers don't know: a preamble before the header, header lines that rule
the rows after them, one encoding or another. Files are split by bytes, as Spark's text reader does it; what a line needs from
lines far before it is carried over a table of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Files up to which a table with a row a file is broadcast: the driver has listed their names anyway.
FEW = 100_000


def _told(rows: DataFrame, per_file: DataFrame) -> DataFrame:
    """rows with what is known of their file. Shuffled by file, a long file would be one task; so a row a file is broadcast while
    the files are few, and with more of them no file is most of the rows for long and Spark decides."""
    return rows.join(F.broadcast(per_file) if len(rows.inputFiles()) <= FEW else per_file, "file")


def lines(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """(file, block, at, line) of every line of the files at path: block is where its split starts, at orders the lines of a
    split. Each file is read in the first encoding that fits all of its bytes; only UTF-8 can fail to fit, so what comes after
    the one behind it is never tried. Line ends may be \\n, \\r or \\r\\n; an empty file has no lines."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    first, *others = encodings
    if first.upper().replace("-", "") != "UTF8":
        return raw.withColumn("line", F.decode(F.col("line").cast("binary"), first))
    if not others:
        return raw
    fits = raw.groupBy("file").agg(F.bool_and(F.is_valid_utf8("line")).alias("fits"))
    return _told(raw, fits).withColumn("line", F.when(F.col("fits"), F.col("line")).otherwise(F.decode(F.col("line").cast("binary"), others[0]))).drop("fits")


def read_statement(spark: SparkSession, path: str, header: str, schema: str, sep: str = ";", encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1"), keep_file: bool = False) -> DataFrame:
    """Statements with a preamble: the lines of each file after the first that starts with ``header``, parsed as delimited text;
    empty lines and files without such a line give no rows. keep_file adds ``file``."""
    all_ = lines(spark, path, encodings)
    place = F.struct("block", "at")
    starts = all_.where(F.startswith(F.col("line"), F.lit(header))).groupBy("file").agg(F.min(place).alias("start"))
    body = _told(all_, starts).where((place > F.col("start")) & (F.trim("line") != ""))
    return body.select(*(["file"] if keep_file else []), F.from_csv("line", schema, {"sep": sep}).alias("r")).select(*(["file"] if keep_file else []), "r.*")


#: Lines of a split that are one window, as a power of two.
PIECE = 17


def carried(placed: DataFrame, value: Column, name: str = "ruling") -> DataFrame:
    """placed (file, block, at, ...) with the last value that is not null at or before each line of its file. A piece of a split is one
    window, so a long split of short lines takes no more memory; what a piece inherits comes from a table with a row a piece."""
    marked = placed.withColumn("_v", value).withColumn("_piece", F.shiftright("at", PIECE))
    ends = marked.groupBy("file", "block", "_piece").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("at"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "_piece").rowsBetween(Window.unboundedPreceding, -1))
    inherited = ends.select("file", "block", "_piece", before.alias("_before"))
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy("file", "block", "_piece").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_in", inside).join(inherited, ["file", "block", "_piece"]).withColumn(name, F.coalesce("_in", "_before")).drop("_v", "_in", "_before", "_piece")


def read_blocks(spark: SparkSession, path: str, header: str, schema: str, sep: str = ";", skip: str | None = None, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1"), keep_place: bool = False) -> DataFrame:
    """Files in blocks: a line that matches ``header`` (a pattern with one group) names what the rows after it belong to, up to
    the next such line, across splits. Rows before the first header, empty lines and lines that match ``skip`` go. ``block``
    is the name; keep_place adds file and a number that orders the rows of a file."""
    name = F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1))
    ruled = carried(lines(spark, path, encodings), name).where(F.col("ruling").isNotNull() & ~F.col("line").rlike(header) & (F.trim("line") != ""))
    ruled = ruled.where(~F.col("line").rlike(skip)) if skip else ruled
    place = ["file", "start", "at"] if keep_place else []
    return ruled.withColumnRenamed("block", "start").select(*place, F.col("ruling").alias("block"), F.from_csv("line", schema, {"sep": sep}).alias("r")).select(*place, "block", "r.*")


def heads(spark: SparkSession, path: str, count: int = 5, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """(file, name, head): the first ``count`` lines of each file, and its name without folders. Files whose first split ends before
    that many lines give those that start in it."""
    first = lines(spark, path, encodings).where("block = 0").withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("_r") <= count)
    said = first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("_r", "line"))).alias("l"))
    return said.select("file", F.element_at(F.split("file", "/"), -1).alias("name"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("head"))


def read_card_invoices(spark: SparkSession, path: str) -> DataFrame:
    """Card invoices (date; place; holder; amount in the bank's way, purchases above zero), with or without a byte order mark and a
    header: (file, date, description, amount), purchases below zero. Lines without a date go."""
    from ..functions.scalar import any_date, ptbr_decimal

    cut = lines(spark, path).select("file", F.split(F.regexp_replace("line", "^\ufeff", ""), ";").alias("c")).where(F.size("c") >= 4)
    return cut.select("file", any_date(F.get("c", F.lit(0))).alias("date"), F.trim(F.get("c", F.lit(1))).alias("description"), (-ptbr_decimal(F.get("c", F.lit(3)))).cast("decimal(18,2)").alias("amount")).where("date is not null")
