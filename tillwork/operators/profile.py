"""Profiles of any table, previews and formatted results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
DATES = ("date", "timestamp", "timestamp_ntz")


def kind_of(spark_type: str) -> str:
    if spark_type in NUMERIC or spark_type.startswith("decimal"):
        return "numeric"
    return "date" if spark_type in DATES else "other"


def profile(df: DataFrame, samples: int = 4) -> DataFrame:
    """One row per column: type, kind, the first samples in sorted order, min and max of numbers and dates, and row_count.

    Each pass over the rows is one aggregation without keys, so a task sends one row, whatever the table holds: the first
    pass gives counts, bounds and each column's least value as text, each further one the least value after the last.
    """
    kinds = [(f.name, f.dataType.simpleString(), kind_of(f.dataType.simpleString())) for f in df.schema]
    text = lambda c: F.col(f"`{c}`").cast("string")
    made = [F.count("*").alias("rows")]
    for i, (name, dtype, kind) in enumerate(kinds):
        value = F.col(f"`{name}`") + F.lit(0.0) if dtype in ("float", "double") else F.col(f"`{name}`")  # no negative zero
        if kind != "other":
            made += [F.min(value).cast("string").alias(f"lo{i}"), F.max(value).cast("string").alias(f"hi{i}")]
        made.append(F.min(text(name)).alias(f"s{i}"))
    first = df.agg(*made).first().asDict()
    found = [[first[f"s{i}"]] if first[f"s{i}"] is not None else [] for i in range(len(kinds))]
    for n in range(1, samples):
        going = [i for i, seen in enumerate(found) if len(seen) == n]
        if not going:
            break
        after = df.agg(*[F.min(F.when(text(kinds[i][0]) > F.lit(found[i][-1]), text(kinds[i][0]))).alias(f"s{i}") for i in going]).first()
        for i in going:
            if after[f"s{i}"] is not None:
                found[i].append(after[f"s{i}"])
    rows = [(name, dtype, kind, first.get(f"lo{i}"), first.get(f"hi{i}"), first["rows"], found[i]) for i, (name, dtype, kind) in enumerate(kinds)]
    return df.sparkSession.createDataFrame(rows, "column string, type string, kind string, min string, max string, row_count bigint, samples array<string>")


def profile_lines(profiled: DataFrame) -> DataFrame:
    """profile() with a line of text for each column."""
    spread = F.when(F.col("min").isNotNull() & F.col("max").isNotNull(), F.concat(F.lit(" | range: "), "min", F.lit(" → "), "max")).otherwise("")
    shown = F.when(F.size("samples") > 0, F.concat(F.lit(" | e.g. "), F.array_join(F.slice("samples", 1, 3), ", "))).otherwise("")
    return profiled.select("column", F.concat(F.lit("  - "), "column", F.lit(" ("), F.upper("type"), F.lit(")"), spread, shown).alias("line"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).where("value is not null").distinct()


def preview(df: DataFrame, n: int = 30) -> tuple[DataFrame, int]:
    """The first n rows and the number of all rows."""
    return df.limit(n), df.count()
