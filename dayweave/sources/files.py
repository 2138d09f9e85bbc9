"""File discovery, line order and text helpers shared by the readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = ["_file", "_block", "_line"]


def find_files(spark: SparkSession, folder: str, suffix: str = "", contains: str = "") -> DataFrame:
    """Paths under a folder that match; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return matching(files.select("path", "modificationTime"), suffix, contains)


def matching(files: DataFrame, suffix: str = "", contains: str = "") -> DataFrame:
    """Rows whose ``path`` ends with a suffix and whose file name holds a text."""
    return files.where(F.col("path").endswith(suffix) & F.element_at(F.split("path", "/"), -1).contains(contains))


def last_file(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The last matching path wins, per key."""
    return files.groupBy(*keys).agg(F.max("path").alias("path"))


def person_in_path(person: str, path: str | Column = "_metadata.file_path") -> Column:
    """The person a file belongs to: group 1 of a pattern in its path; NULL where it does not match."""
    found = F.regexp_extract(F.col(path) if isinstance(path, str) else path, person, 1)
    return F.when(found != "", found)


def person_keys(person: str | None) -> list[str]:
    """The key column that a reader adds for a person pattern."""
    return ["person"] if person else []


def _with_person(df: DataFrame, person: str | None) -> DataFrame:
    return df.withColumn("person", person_in_path(person, "_file")) if person else df


def _with_order(df: DataFrame) -> DataFrame:
    # rows of one file block are read in order by one task, so file, block
    # start and the running id give the exact line order of split files
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def read_lines(spark: SparkSession, path: str | Sequence[str], person: str | None = None) -> DataFrame:
    """Text lines with their order; ``person`` is a pattern that finds whose file it is, see ``person_in_path``."""
    return _with_person(_with_order(spark.read.text(path)), person)


def read_cells(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = ",", encoding: str = "UTF-8", person: str | None = None) -> DataFrame:
    """CSV cells as text, named by position, with their line order, and the person in the path."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    reader = spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE")
    return _with_person(_with_order(reader.csv(path)), person)


def file_name(col: str = "_file") -> Column:
    return F.element_at(F.split(F.col(col), "/"), -1)


def date_in_name(col: str = "_file") -> Column:
    """Date from eight digits in the file name."""
    digits = F.regexp_extract(file_name(col), r"(\d{8})", 1)
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")


def whole_number(text: str | Column) -> Column:
    """Integer text with thousands commas."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, ",", "").try_cast("bigint")


def comma_decimal(text: str | Column) -> Column:
    """Decimal text that may use a comma."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, ",", ".").try_cast("double")


def day_of(text: str | Column, fmt: str) -> Column:
    """Date in a format; NULL when unreadable."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")
