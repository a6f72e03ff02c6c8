"""CSV wrapped in stray text lines, and wide yearly series with a preamble."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_data_line(line: Column) -> Column:
    """False for blank lines, code fences, rules, headings and lines without a comma."""
    text = F.trim(line)
    junk = text.startswith("```") | text.startswith("---") | text.startswith("# ")
    return (text != "") & ~junk & text.contains(",")


def parse_lines(lines: DataFrame, columns: list[str], source: str = "value") -> DataFrame:
    """Parse data lines as CSV text columns; a line that repeats the header cell by cell drops out."""
    fields = [f"_c{i}" for i in range(len(columns))]
    kept = lines.select(F.trim(F.col(source)).alias("_line")).filter(is_data_line(F.col("_line")))
    parsed = kept.select(F.from_csv("_line", _texts(fields), {"mode": "PERMISSIVE"}).alias("_row")).select("_row.*")
    return parsed.filter(~_is_header(fields, columns)).select(*[F.col(f).alias(c) for f, c in zip(fields, columns)])


def _texts(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _is_header(fields: list[str], columns: list[str]) -> Column:
    """Whether all cells are the names of their columns."""
    same = F.lit(True)
    for field, column in zip(fields, columns):
        same = same & F.coalesce(F.trim(F.col(field)) == column, F.lit(False))
    return same


def _cells(line: str) -> list[str]:
    """One CSV line's cells, quotes taken off."""
    return [cell.strip() for cell in next(csv.reader([line.strip()], skipinitialspace=True))]


def read_loose_csv(spark: SparkSession, path: str) -> DataFrame:
    """Loose CSV file with its header on the first data line, quoted or not; a header in each of several files drops out."""
    lines = spark.read.text(path)
    first = lines.filter(is_data_line(F.col("value"))).first()
    if first is None:
        raise ValueError(f"no data lines in {path}")
    return parse_lines(lines, _cells(first["value"]))


def unpivot_years(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Wide table with one column per year to long (ids, year, value)."""
    years = [c for c in wide.columns if c.strip().isdigit()]
    numeric = wide.select(*ids, *[F.col(f"`{y}`").try_cast("double").alias(y) for y in years])
    long = numeric.unpivot(ids, years, "year", "value")
    return long.withColumn("year", F.col("year").cast("int"))


def read_yearly_series(spark: SparkSession, path: str, preamble: int = 4) -> DataFrame:
    """Wide yearly series whose header follows ``preamble`` text lines; the data lines are those after the header.

    Only the head of the first file reaches the driver. Lines equal to the preamble or the header, cell by cell, drop out.
    """
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.limit(preamble + 1).collect()]
    columns = [name or f"_blank{i}" for i, name in enumerate(_cells(head[-1]))]
    fields = [f"_c{i}" for i in range(len(columns))]
    named = [i for i, name in enumerate(columns) if not name.startswith("_blank")]
    parsed = lines.select(F.from_csv("value", _texts(fields)).alias("_row")).select("_row.*")
    whole = F.lit(True)
    for text in head[:preamble]:
        cells = (_cells(text) + [""] * len(columns))[: len(columns)] if text.strip() else [""] * len(columns)
        same = F.lit(True)
        for field, cell in zip(fields, cells):
            same = same & (F.trim(F.coalesce(F.col(field), F.lit(""))) == cell)
        whole = whole & ~same
    some = F.coalesce(*[F.col(fields[i]) for i in named]).isNotNull()
    kept = parsed.filter(whole & some & ~_is_header([fields[i] for i in named], [columns[i] for i in named]))
    return kept.select(*[F.col(f).alias(c) for f, c in zip(fields, columns)])
