"""Statement text lines to rows, balances and terms, and the gate that lets only statements through whose sums close.

Input is one row per line: ``doc_id, page_no, line_no, text``. Everything is regular expressions and windows over a document's lines, so a
document is read where it lies after one shuffle on ``doc_id``.

Edge cases: null lines are skipped; a document without both balances, or whose rows do not lead from one to the other, is refused with a
reason; repeated lines of one (doc, page, line) count once; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a statement line prints a day, a text and an amount; CR marks money in.
ROW = r"^\s*(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(.+?)\s+([\d,]+\.\d{2})\s*(CR)?(?:\s+-?[\d,]+\.\d{2})?\s*$"
OPENING = r"(?i)(?:balance brought forward|opening balance|previous balance)\D*?(-?[\d,]+\.\d{2})"
CLOSING = r"(?i)(?:balance carried forward|closing balance|new balance)\D*?(-?[\d,]+\.\d{2})"
TWO_DATES = r"^\s*(\d{2}/\d{2}/\d{2})\s+(\d{2}/\d{2}/\d{2})\s+(.+?)\s+(-?)\s*£([\d,]+\.\d{2})\s*$"
STATED = r"(?i)statement date\D*(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"


def pence(text: Column) -> Column:
    return (F.regexp_replace(text, ",", "").try_cast("decimal(20,2)") * 100).cast("long")


def month_number(name: Column) -> Column:
    """1 to 12 of an English month's first three letters, null otherwise."""
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(name))
    return F.when((at > 0) & ((at - 1) % 3 == 0), ((at - 1) / 3 + 1).cast("int"))


def sections(lines: DataFrame) -> DataFrame:
    """Lines with the number of the account section they belong to: each ``Page 1 of N`` after the first begins a new one."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    restart = F.coalesce(F.col("text").rlike(r"(?i)page\s+1\s+of\s+\d+"), F.lit(False)).cast("int")
    return lines.dropDuplicates(["doc_id", "page_no", "line_no"]).withColumn("section", F.greatest(F.sum(restart).over(w), F.lit(1)))


def statement_rows(lines: DataFrame) -> DataFrame:
    """``doc_id, section, position, value_date, description, amount_minor`` (money out negative), with the year inferred.

    A row's month later than the statement's month belongs to the year before.
    """
    placed = sections(lines).where("text IS NOT NULL")
    whole = Window.partitionBy("doc_id", "section")
    stated = F.regexp_extract("text", STATED, 3)
    dated = placed.withColumn("_year", F.max(F.when(stated != "", stated.cast("int"))).over(whole)).withColumn("_month", F.max(month_number(F.regexp_extract("text", STATED, 2))).over(whole))
    rows = dated.where(F.col("text").rlike(ROW))
    month = month_number(F.regexp_extract("text", ROW, 2))
    year = F.when(month > F.col("_month"), F.col("_year") - 1).otherwise(F.col("_year"))
    day = F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), F.regexp_extract("text", ROW, 1)), "y-M-d")
    amount = pence(F.regexp_extract("text", ROW, 4))
    order = Window.partitionBy("doc_id", "section").orderBy("page_no", "line_no")
    return rows.select(
        "doc_id", "section", F.row_number().over(order).alias("position"), day.alias("value_date"), F.regexp_extract("text", ROW, 3).alias("description"),
        F.when(F.regexp_extract("text", ROW, 5) == "CR", amount).otherwise(-amount).alias("amount_minor"),
    )


def statement_balances(lines: DataFrame) -> DataFrame:
    """``doc_id, section, opening, closing``: the first opening and the last closing balance printed, null where none is."""
    placed = sections(lines).where("text IS NOT NULL")
    at = F.struct("page_no", "line_no")
    first, last = pence(F.nullif(F.regexp_extract("text", OPENING, 1), F.lit(""))), pence(F.nullif(F.regexp_extract("text", CLOSING, 1), F.lit("")))
    return placed.select("doc_id", "section", at.alias("at"), first.alias("o"), last.alias("c")).groupBy("doc_id", "section").agg(
        F.min_by("o", F.when(F.col("o").isNotNull(), F.col("at"))).alias("opening"), F.max_by("c", F.when(F.col("c").isNotNull(), F.col("at"))).alias("closing")
    )


def statement_gate(lines: DataFrame) -> DataFrame:
    """One verdict per statement: ``doc_id, section, rows, opening, closing, discrepancy, verdict``."""
    sums = statement_rows(lines).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_minor").alias("moved"), F.count_if(F.col("value_date").isNull()).alias("undated"))
    out = statement_balances(lines).join(sums, ["doc_id", "section"], "left").na.fill(0, ["rows", "moved", "undated"])
    off = F.col("closing") - (F.col("opening") + F.col("moved"))
    verdict = F.when(F.col("opening").isNull() | F.col("closing").isNull(), "no balance").when(F.col("undated") > 0, "undated row").when(off != 0, "does not close").otherwise("accepted")
    return out.select("doc_id", "section", "rows", "opening", "closing", off.alias("discrepancy"), verdict.alias("verdict"))


def accepted_rows(lines: DataFrame) -> DataFrame:
    """The rows of accepted statements only."""
    good = statement_gate(lines).where("verdict = 'accepted'").select("doc_id", "section")
    return statement_rows(lines).join(good, ["doc_id", "section"], "left_semi")


def two_date_rows(lines: DataFrame) -> DataFrame:
    """Rows of statements that print the day of the purchase and of the booking and money in with a minus: ``doc_id, position, value_date,
    booking_date, description, amount_minor``. Two-digit years lie after 2000."""
    rows = lines.where("text IS NOT NULL").dropDuplicates(["doc_id", "page_no", "line_no"]).where(F.col("text").rlike(TWO_DATES))
    part = lambda k: F.regexp_extract("text", TWO_DATES, k)
    day = lambda k: F.try_to_date(part(k), "dd/MM/yy")
    amount = pence(part(5))
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    return rows.select("doc_id", F.row_number().over(order).alias("position"), day(1).alias("value_date"), day(2).alias("booking_date"), part(3).alias("description"), F.when(part(4) == "-", amount).otherwise(-amount).alias("amount_minor"))
