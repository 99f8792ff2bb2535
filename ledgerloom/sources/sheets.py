"""Spreadsheet rows from a table of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import blank_to_null, trimmed

HEADER_ROWS = 20


def header_rows(cells: DataFrame, sheet: Sequence[str], aliases: DataFrame, least: int = 2) -> DataFrame:
    """The first row of each sheet, within its first 20, with ``least`` known headers and none twice.

    ``cells`` has the sheet's columns, row, col, value; ``aliases`` (value, field) is a rule table.
    """
    known = cells.where(F.col("row") < HEADER_ROWS).join(aliases, "value")
    rows = known.groupBy(*sheet, "row").agg(F.count_distinct("field").alias("fields"), F.count("*").alias("hits"))
    return rows.where((F.col("fields") >= least) & (F.col("hits") == F.col("fields"))).groupBy(*sheet).agg(F.min("row").alias("row"))


def sheet_records(cells: DataFrame, sheet: Sequence[str], aliases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows below each header as columns named by field."""
    header = header_rows(cells, sheet, aliases).withColumnRenamed("row", "header")
    named = cells.join(header, [*sheet]).where("row = header").join(aliases, "value").select(*sheet, "col", "field")
    body = cells.join(header, [*sheet]).where("row > header").join(named, [*sheet, "col"])
    return body.groupBy(*sheet, "row").pivot("field", list(fields)).agg(F.first("value", ignorenulls=True))


def vendor_rows(records: DataFrame, file: str, row: str, marks: Sequence[str] = ("-",)) -> DataFrame:
    """Rows of exports ``(file, row, sequence, title, winner, award_amount, source_url, …)``, continuations folded in.

    A row without sequence and title that has a winner or an amount continues the row before it: its winner and amount join that row's,
    unless they are there already. Without a row before it, it counts as a row of its own if it has a link. A row with only a link is a row, and
    one with neither is dropped. ``marks`` are empty values. Other columns are those of the first row.
    """
    filled = lambda c: F.coalesce(F.length(trimmed(F.col(c))) > 0, F.lit(False))
    value = lambda c: blank_to_null(trimmed(F.col(c)), marks)
    order = Window.partitionBy(file).orderBy(row)
    keyed, linked, more = filled("sequence") | filled("title"), filled("source_url"), filled("winner") | filled("award_amount")
    sure = keyed | (linked & ~more)
    before = F.coalesce(F.max(sure | linked).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    marked = records.withColumn("_head", sure | (linked & ~before)).withColumn("_more", more)
    marked = marked.withColumn("_row", F.sum(F.col("_head").cast("int")).over(order)).where((F.col("_row") > 0) & (F.col("_head") | F.col("_more")))

    def joined(c: str):
        found = F.collect_list(F.when(value(c).isNotNull(), F.struct(F.col(row).alias("at"), value(c).alias("v"))))
        return F.array_join(F.array_distinct(F.transform(F.array_sort(found), lambda x: x["v"])), "; ").alias(c)

    own = [F.min_by(F.col(f"`{c}`"), F.col(row)).alias(c) for c in records.columns if c not in (file, row, "winner", "award_amount")]
    return marked.groupBy(file, "_row").agg(F.min(row).alias(row), *own, joined("winner"), joined("award_amount"), (F.count("*") - 1).alias("continuations")).drop("_row")
