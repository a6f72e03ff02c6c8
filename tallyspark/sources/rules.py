"""Rule tables: loading, and their driver-side form used to build expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyspark import settings
from tallyspark.functions.columns import lower_names
from tallyspark.session import bounded_rows
from tallyspark.sources.loose_csv import read_loose_csv

MISSING_COLUMNS = ["variable_name", "year", "missing_codes"]
HARMONIZATION_COLUMNS = ["variable_name", "year", "original_code", "harmonized_code"]
DICTIONARY_COLUMNS = ["variable_name", "level", "dtype", "description", "use_in_analysis"]
MAX_RULES = 20_000
BROKEN = "_broken_line"


def canon_text(value) -> str:
    text = str(value).strip()
    head, dot, tail = text.partition(".")
    return head if dot and tail and not tail.strip("0") else text


def _year_text(value) -> str:
    return canon_text(value).upper()


@dataclass
class RuleSet:
    """Rules by variable and year; a year's own rules replace those for ALL."""

    missing: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    mapping: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)

    @classmethod
    def from_rows(cls, missing, harmonization) -> "RuleSet":
        rules = cls()
        for variable, year, codes in missing:
            years = rules.missing.setdefault(str(variable).strip().upper(), {})
            # The first row for a variable and year counts.
            listed = [canon_text(c) for c in str(codes if codes is not None else "").split("|") if c.strip()]
            years.setdefault(_year_text(year), listed)
        for variable, year, original, harmonized in harmonization:
            years = rules.mapping.setdefault(str(variable).strip().upper(), {})
            # The last row for an original code counts.
            target = None if harmonized is None else canon_text(harmonized)
            years.setdefault(_year_text(year), {})[canon_text(original)] = target
        return rules

    @classmethod
    def from_frames(cls, missing: DataFrame | None, harmonization: DataFrame | None) -> "RuleSet":
        return cls.from_rows(_rows(missing, MISSING_COLUMNS), _rows(harmonization, HARMONIZATION_COLUMNS))

    @classmethod
    def default(cls) -> "RuleSet":
        return cls.from_rows(settings.MISSING_RULES, [r[:4] for r in settings.HARMONIZATION_RULES])

    def extended(self, missing=(), harmonization=()) -> "RuleSet":
        rows = [(v, y, "|".join(c)) for v, ys in self.missing.items() for y, c in ys.items()]
        maps = [(v, y, o, h) for v, ys in self.mapping.items() for y, m in ys.items() for o, h in m.items()]
        return RuleSet.from_rows([*rows, *missing], [*maps, *harmonization])


def _rows(frame: DataFrame | None, columns: list[str]) -> list[tuple]:
    if frame is None:
        return []
    frame = lower_names(frame)
    if not set(columns) <= set(frame.columns):
        return []
    return [tuple(r) for r in bounded_rows(frame.select(*columns), MAX_RULES, "rules")]


def load_rule_table(spark: SparkSession, path: str) -> DataFrame:
    """Strict CSV parse with lower-case headers; a file it rejects is read as loose CSV."""
    header = spark.read.option("header", True).csv(path).schema
    if "variable_name" in [c.strip().lower() for c in header.names]:
        # Lines that do not parse show up in a column of their own; there are at most MAX_RULES rows.
        marked = StructType([*header.fields, StructField(BROKEN, StringType())])
        strict = spark.read.option("header", True).option("columnNameOfCorruptRecord", BROKEN).schema(marked).csv(path)
        rows = bounded_rows(strict, MAX_RULES, "rules")
        if all(row[BROKEN] is None for row in rows):
            return lower_names(spark.createDataFrame(rows, marked).drop(BROKEN))
    return lower_names(read_loose_csv(spark, path))


def dictionary_frame(spark: SparkSession, entries=None) -> DataFrame:
    rows = settings.VARIABLE_DICTIONARY if entries is None else entries
    return spark.createDataFrame(
        rows, "variable_name string, level string, dtype string, description string, use_in_analysis int"
    )


def schema_report(frame: DataFrame, required: list[str], name: str) -> DataFrame:
    """One row per required column: is it there (after trimming and lower-casing)."""
    present = {c.strip().lower() for c in frame.columns}
    rows = [(name, c, int(c in present)) for c in sorted(required)]
    return frame.sparkSession.createDataFrame(rows, "metadata_file string, column_name string, present int")
