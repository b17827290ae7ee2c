"""Whether a file agrees with itself: rows, balances, signs and dates; lifecycle and format doubts of accounts.

A verdict is true, false or null (cannot be told). Edge cases: files without balances, or with one only, cannot be walked; null amounts make
the sign untold; empty files give a structure verdict only where they were read; empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verify_files(structural: DataFrame, parsed: DataFrame) -> DataFrame:
    """Four verdicts per file: ``file_id, verdict, ok``.

    `structural`: ``file_id, pos, amount_minor, balance`` as the file prints them; `parsed`: ``file_id, amount_minor, value_date`` as a reader
    gave them. The walk is read under the best of four conventions (balances down or up the page, amounts as they are or turned), which also
    tells in which direction money truly moved.
    """
    w = Window.partitionBy("file_id").orderBy("pos")
    amount, balance = F.col("amount_minor"), F.col("balance")
    steps = structural.withColumn("_step", balance - F.lag(balance).over(w)).withColumn("_before", F.lag(amount).over(w))
    votes = {"down": F.col("_step") == amount, "down_turned": F.col("_step") == -amount, "up": F.col("_step") == -F.col("_before"), "up_turned": F.col("_step") == F.col("_before")}
    file = steps.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("balance").alias("balances"), F.count("_step").alias("steps"), F.sum("amount_minor").alias("net"), F.count_if(amount.isNull()).alias("unread"), *[F.count_if(v).alias(k) for k, v in votes.items()]
    )
    best = F.greatest(*votes)
    read = parsed.groupBy("file_id").agg(F.count(F.lit(1)).alias("parsed"), F.sum("amount_minor").alias("parsed_net"), F.max((F.dayofmonth("value_date") > 12).cast("int")).alias("proved"))
    both = file.join(read, "file_id", "full").withColumn("_best", best)
    walked = (F.col("balances") >= 2) & (F.col("steps") > 0) & (F.col("_best") > 0)
    sign = F.when(walked, F.when((F.col("down") == F.col("_best")) | (F.col("up") == F.col("_best")), 1).otherwise(-1))
    verdicts = F.array(
        F.struct(F.lit("structure").alias("verdict"), F.when(F.col("rows").isNotNull(), F.col("rows") == F.coalesce("parsed", F.lit(0))).alias("ok")),
        F.struct(F.lit("balance walk").alias("verdict"), F.when(walked, F.col("steps") == F.col("_best")).alias("ok")),
        F.struct(F.lit("sign").alias("verdict"), F.when(F.col("unread") == 0, sign * F.col("net") == F.coalesce("parsed_net", F.lit(0))).alias("ok")),
        F.struct(F.lit("dates").alias("verdict"), F.when(F.col("proved") == 1, True).alias("ok")),
    )
    return both.select("file_id", F.inline(verdicts))


def format_doubts(rows: DataFrame, keys: tuple[str, ...] = ("account_id", "source")) -> DataFrame:
    """Sets of rows whose days are all the 12th or earlier, so that nothing rules out the other reading of day and month."""
    return rows.where("value_date IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.dayofmonth("value_date")).alias("_d")).where("_d <= 12").drop("_d")


def lifecycle_breaches(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows outside an account's declared life: ``account_id, breach, n, total``; rows before opening are told first and alone."""
    life = accounts.select("account_id", "opened", "closed").where("opened IS NOT NULL OR closed IS NOT NULL").dropDuplicates(["account_id"])
    per = rows.where("value_date IS NOT NULL").join(life, "account_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value_date") < F.col("opened")).alias("early"), F.count_if(F.col("value_date") > F.col("closed")).alias("late"))
    breach = F.when(F.col("early") > 0, "before opening").when(F.col("late") > 0, "after closing")
    return per.where("early > 0 OR late > 0").select("account_id", breach.alias("breach"), F.when(F.col("early") > 0, F.col("early")).otherwise(F.col("late")).alias("n"), "total")


def agreed_readings(readings: DataFrame) -> DataFrame:
    """Documents that several readers claim: the first reader's where all tell the same ledger, else refused. ``doc_id, reader, refused``.

    Input: ``doc_id, reader, reader_no, position, value_date, description, amount_minor, opening, closing``.
    """
    line = F.xxhash64("position", "value_date", "description", "amount_minor")
    each = readings.groupBy("doc_id", "reader", "reader_no", "opening", "closing").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(line).alias("h"))
    per = each.groupBy("doc_id").agg(F.count_distinct(F.struct("opening", "closing", "n", "h")).alias("ledgers"), F.min_by("reader", "reader_no").alias("reader"))
    return per.select("doc_id", F.when(F.col("ledgers") == 1, F.col("reader")).alias("reader"), (F.col("ledgers") > 1).alias("refused"))
