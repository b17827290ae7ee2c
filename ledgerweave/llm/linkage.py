"""Linking statement lines to booked payments without a shared identifier, by a label model over heuristic votes.

Lines and payments meet in blocks of account, fortnight and amount bucket; where the printed amount is off they must share the beginning
of a word. Matching functions vote on every candidate. Votes collapse to distinct vote vectors (bounded by
the number of possible vectors, not by the data); on their counts a two-class generative model learns by expectation-maximisation how
often each function votes which way on matches and on others, joining functions that stay dependent within a class into one factor.
The posterior is the confidence. Pairs that are each other's best are linked, round by round, until none is left.

Edge cases: repeated rows count once; lines without amount or without a resolvable account, and payments without account, amount or day
take no part; null days are bracketed by the lines around them; null descriptions abstain; ties go to the nearer day, then to the
smaller identifiers; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confidence from which a pair is a link.
LEAST = 0.5
#: Days between the printed day and the booking that still are one payment.
REACH = 6
#: Share by which a printed amount may be off (fees included, rates applied).
OFF = 0.04
#: Days by which decoys are moved: whole weeks, away from monthly repetitions by more than the reach.
SHIFT = 49

# Words of descriptors that say nothing about who was paid.
FURNITURE = ("pos card payment to contactless pq dd ref ltd plc co the and sons gb gbr uk cd bgc bacs so sto fpo intl incl pp from at "
             "jan feb mar apr may jun jul aug sep oct nov dec").split()

VOTERS = ("amount", "near", "day", "lag", "words", "name", "sign", "party")


def words(text: Column) -> Column:
    """Telling words of a descriptor, lower case."""
    spelled = F.split(F.regexp_replace(F.lower(text), r"intl fee incl|[a-z]*\d[a-z\d]*", " "), "[^a-z]+")
    plain = F.array_distinct(F.filter(spelled, lambda w: F.length(w) >= 3))
    return F.coalesce(F.array_except(plain, F.array(*map(F.lit, FURNITURE))), F.array().cast("array<string>"))


def matched(a: str, b: str, squeezed: str) -> Column:
    """The words of `a` that `b` (words) or `squeezed` (its letters in one) also has: equal, begun alike, abbreviated or misspelt."""
    skeleton = "concat(substr({0}, 1, 1), regexp_replace(substr({0}, 2), '[aeiouy]', ''))"
    return F.expr(f"""filter({a}, x -> exists({b}, y ->
          x = y OR (length(x) >= 5 AND substr(x, 1, 5) = substr(y, 1, 5))
          OR (length(x) >= 5 AND length(y) >= 5 AND levenshtein(x, y, 2) >= 0)
          OR (substr(x, 1, 1) = substr(y, 1, 1) AND (length(x) >= 4 OR length(y) >= 4) AND substr({skeleton.format('x')}, 1, 4) = substr({skeleton.format('y')}, 1, 4)))
        OR (length(x) >= 5 AND contains({squeezed}, substr(x, 1, 6))))""")


def swapped(day: Column) -> Column:
    """The date with day and month exchanged, null when that is no date."""
    return F.when(F.dayofmonth(day) <= 12, F.make_date(F.year(day), F.dayofmonth(day), F.least(F.month(day), F.lit(12))))


def printed_accounts(rows: DataFrame, accounts: DataFrame, payments: DataFrame) -> DataFrame:
    """``statement_id, account_id`` from the account names printed on a statement: same closing digits and like first words, or, without
    digits, the same letters.

    Where several accounts fit equally well, the one with most of the statement's amounts on their days is meant.
    """
    spelled = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", "")
    key = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(\d{3,})\D*$", 1), F.lit("")), spelled(c))
    first = lambda c: F.split(F.lower(F.trim(c)), r"[^a-z]+")[0]
    named = rows.where("account_name IS NOT NULL AND statement_id IS NOT NULL").select("statement_id", key("account_name").alias("_key"), first("account_name").alias("_word"))
    named = named.where("_key <> ''").groupBy("statement_id", "_key", "_word").agg(F.count(F.lit(1)).alias("_n"))
    known = accounts.where("account_id IS NOT NULL").select("account_id", key("label").alias("_key"), first("label").alias("_own")).distinct()
    near = named.join(known, "_key").withColumn("_d", F.levenshtein("_word", "_own")).where(F.col("_d") <= F.greatest(F.lit(2), F.floor(F.length("_own") / 3)))
    votes = near.groupBy("statement_id", "account_id").agg(F.sum("_n").alias("n"), F.min("_d").alias("d"))
    best = votes.groupBy("statement_id").agg(F.max(F.struct("n", (-F.col("d")).alias("d"))).alias("_best"))
    top = votes.join(best, "statement_id").where("n = _best.n AND -d = _best.d").select("statement_id", "account_id")
    shared = top.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("statement_id"))).where("_k > 1").select("statement_id", "account_id")
    lines = rows.where("value_date IS NOT NULL").join(shared, "statement_id").select("statement_id", "account_id", "row_id", F.abs("amount").alias("_abs"), F.explode(F.sequence(F.date_sub("value_date", 1), F.date_add("value_date", 1))).alias("_day"))
    paid = payments.select("account_id", F.abs("t_amount").alias("_abs"), F.col("booked").alias("_day")).distinct()
    met = lines.join(paid, ["account_id", "_abs", "_day"], "left_semi").groupBy("statement_id", "account_id").agg(F.count_distinct("row_id").alias("m"))
    return top.join(met, ["statement_id", "account_id"], "left").groupBy("statement_id").agg(F.max_by("account_id", F.struct(F.coalesce("m", F.lit(0)), "account_id")).alias("account_id"))


def beginnings(told: Column) -> Column:
    """The first four letters of each longer word."""
    return F.transform(F.filter(told, lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 4))


def met_accounts(rows: DataFrame, payments: DataFrame) -> DataFrame:
    """``statement_id, account_id`` for statements without a readable name: the account that has most of its amounts on their days.

    A line that shares the beginning of a word with what it meets counts twice. Two lines suffice, or one that shares a word, unless
    another account has as much evidence as that one line.
    """
    own = rows.where("value_date IS NOT NULL").select(
        "statement_id", "row_id", F.abs("amount").alias("_abs"), words(F.col("description")).alias("_words"), F.explode(F.sequence(F.date_sub("value_date", 1), F.date_add("value_date", 1))).alias("_day")
    )
    paid = payments.select(F.abs("t_amount").alias("_abs"), F.col("booked").alias("_day"), "account_id", "description", "counterparty")
    hits = own.join(paid, ["_abs", "_day"])
    shared = F.coalesce(F.arrays_overlap(beginnings(F.col("_words")), beginnings(F.array_union(words(F.col("description")), words(F.col("counterparty"))))), F.lit(False))
    hits = hits.groupBy("statement_id", "account_id", "row_id").agg(F.max(shared.cast("int")).alias("_shared"))
    votes = hits.groupBy("statement_id", "account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("_shared").alias("w")).where("n + w >= 2")
    best = votes.groupBy("statement_id").agg(F.max_by(F.struct("account_id", "n"), F.struct(F.expr("n + w"), "n", "account_id")).alias("_best"), F.max(F.expr("n + w")).alias("_most"), F.collect_list(F.expr("n + w")).alias("_all"))
    settled = F.expr("_best.n >= 2 OR size(filter(_all, x -> x = _most)) = 1")
    return best.where(settled).select("statement_id", "_best.account_id")


def statement_lines(statements: DataFrame, accounts: DataFrame, payments: DataFrame) -> DataFrame:
    """Distinct lines with account, sign-free amount, words and the days between which they can lie."""
    rows = (
        statements.where("row_id IS NOT NULL AND amount_minor IS NOT NULL AND amount_minor <> 0")
        .select("row_id", "statement_id", "account_name", "page_no", "line_no", "value_date", "description", F.col("amount_minor").alias("amount"))
        .dropDuplicates(["row_id"])
    )
    by_name = printed_accounts(rows, accounts, payments)
    rest = rows.join(by_name, "statement_id", "left_anti").where("statement_id IS NOT NULL")
    owner = by_name if rest.isEmpty() else by_name.unionByName(met_accounts(rest, payments))
    order = Window.partitionBy("statement_id").orderBy("page_no", "line_no", "row_id")
    dated = rows.withColumn("_before", F.last("value_date", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    dated = dated.withColumn("_after", F.first("value_date", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    low = F.coalesce("value_date", F.coalesce("_before", F.date_sub("_after", 31)))
    high = F.coalesce("value_date", F.coalesce("_after", F.date_add("_before", 31)))
    return (
        dated.join(owner, "statement_id")
        .withColumn("low", F.least(low, high)).withColumn("high", F.greatest(low, high))
        .where("low IS NOT NULL")
        .select("row_id", "account_id", "value_date", "amount", "low", "high", swapped(F.col("value_date")).alias("swap"), words(F.col("description")).alias("r_words"))
    )


def booked_payments(transactions: DataFrame) -> DataFrame:
    """Booked payments."""
    return (
        transactions.where("lower(trim(status)) = 'booked' AND entity_id IS NOT NULL AND account_id IS NOT NULL AND amount_minor IS NOT NULL")
        .withColumn("booked", F.coalesce("booking_date", "value_date"))
        .where("booked IS NOT NULL")
        .select("entity_id", "account_id", F.col("amount_minor").alias("t_amount"), "booked", F.coalesce("value_date", "booked").alias("valued"), "description", "counterparty")
    )  # repeated rows fall together as pairs


def _fortnights(days: Sequence[tuple[Column, Column]]) -> Column:
    """The fortnights that spans of days touch."""
    week = lambda d: F.floor(F.unix_date(d) / 14)
    empty = F.array().cast("array<bigint>")
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(F.sequence(week(a), week(b)), empty) for a, b in days])))


def _log_bucket(amount: Column, factor: float = 1.0) -> Column:
    return F.floor(F.log(F.greatest(F.abs(amount), F.lit(1)) * F.lit(factor)) / F.lit(0.2))


def candidates(lines: DataFrame, payments: DataFrame) -> DataFrame:
    """Pairs of a line (or its decoy) and a payment of one account that lie within reach, with what the voters need.

    A block is an account, a fortnight and a bucket of the logarithm of the amount; a line looks into the one or two buckets and the few
    fortnights that its tolerance touches, a payment lies in one. Off amounts need a common beginning of a word.
    """
    spans = [(F.date_sub("low", REACH), F.date_add("high", REACH)), (F.date_sub("swap", REACH), F.date_add("swap", REACH))]
    slim = lines.select("row_id", "decoy", "account_id", "value_date", "amount", "low", "high", "swap")
    buckets = F.array_distinct(F.array(_log_bucket(F.col("amount"), 1 - 1.1 * OFF), _log_bucket(F.col("amount")), _log_bucket(F.col("amount"), 1 + 1.1 * OFF)))
    left = slim.withColumn("_time", F.explode(_fortnights(spans))).withColumn("_size", F.explode(buckets))
    right = payments.withColumn("_time", F.floor(F.unix_date("booked") / 14)).withColumn("_size", _log_bucket(F.col("t_amount")))
    met = left.join(right, ["account_id", "_time", "_size"]).where(f"abs(abs(amount) - abs(t_amount)) <= greatest(2, {OFF} * abs(t_amount))")
    within = F.expr(f"booked BETWEEN date_sub(low, {REACH}) AND date_add(high, {REACH}) OR booked BETWEEN date_sub(swap, {REACH}) AND date_add(swap, {REACH})")
    met = met.where(within).drop("_time", "_size").dropDuplicates(["row_id", "decoy", "entity_id"])
    told = met.join(lines.where("NOT decoy").select("row_id", "r_words"), "row_id")
    told = told.withColumn("t_words", words(F.col("description"))).withColumn("p_words", words(F.col("counterparty")))
    told = told.withColumn("t_flat", F.regexp_replace(F.lower(F.coalesce("description", F.lit(""))), "[^a-z]", "")).drop("description", "counterparty")
    common = F.arrays_overlap(beginnings(F.col("r_words")), beginnings(F.array_union("t_words", "p_words")))
    # Off amounts that share no word were tried within a day: they blur what voters learn and lose more true links than they bring.
    return told.where((F.abs("amount") == F.abs("t_amount")) | F.coalesce(common, F.lit(False)))


def with_decoys(lines: DataFrame, days: int = SHIFT) -> DataFrame:
    """The lines, and each again at another time: what it meets there are pairs that are no match, met as often as by chance here."""
    moved = [F.date_add(c, days).alias(c) for c in ("value_date", "low", "high", "swap")]
    there = lines.select(*[c for c in lines.columns if c not in ("value_date", "low", "high", "swap")], *moved)
    return lines.withColumn("decoy", F.lit(False)).unionByName(there.withColumn("decoy", F.lit(True)))


def votes(pairs: DataFrame) -> DataFrame:
    """Each matching function's vote: 0 abstains, 1 speaks for a match, 2 against, 3 and 4 for weaker or special cases."""
    gap = "abs(datediff(value_date, booked))"
    swap = "abs(datediff(swap, booked))"
    seen = pairs.withColumn("_hit", matched("r_words", "t_words", "t_flat")).withColumn("_party", matched("r_words", "p_words", "''"))
    # The sign convention of an account is what most of its exact pairs show.
    exact = seen.where("NOT decoy AND value_date = booked AND abs(amount) = abs(t_amount)").groupBy("account_id").agg(F.avg(F.signum(F.col("amount").cast("double")) * F.signum(F.col("t_amount").cast("double"))).alias("_sense"))
    seen = seen.join(exact, "account_id", "left")
    cast = {
        "amount": "if(abs(amount) = abs(t_amount), 1, 2)",
        "near": f"CASE WHEN value_date IS NULL THEN 4 WHEN {gap} <= 3 THEN 1 WHEN {swap} <= 3 THEN 3 ELSE 2 END",
        "day": f"CASE WHEN value_date IS NULL THEN 0 WHEN {gap} = 0 OR ({gap} > 3 AND {swap} = 0) THEN 1 WHEN {gap} = 1 OR {swap} = 1 THEN 3 ELSE 2 END",
        "lag": "CASE WHEN value_date IS NULL THEN 0 WHEN datediff(value_date, valued) BETWEEN 0 AND 5 OR datediff(swap, valued) BETWEEN 0 AND 5 THEN 1 ELSE 2 END",
        "words": "CASE WHEN size(r_words) = 0 OR size(t_words) = 0 THEN 0 WHEN 2 * size(_hit) >= size(r_words) THEN 1 WHEN size(_hit) > 0 THEN 3 ELSE 2 END",
        "name": "CASE WHEN size(r_words) = 0 OR size(t_words) = 0 THEN 0 WHEN exists(slice(r_words, 1, 2), w -> array_contains(_hit, w) AND length(w) >= 5) THEN 1 ELSE 2 END",
        "sign": "CASE WHEN _sense IS NULL OR _sense = 0 THEN 0 WHEN sign(amount) * sign(t_amount) = sign(_sense) THEN 1 ELSE 2 END",
        "party": "CASE WHEN size(r_words) = 0 OR size(p_words) = 0 THEN 0 WHEN size(_party) > 0 THEN 1 ELSE 2 END",
    }
    cells = [F.expr(cast[v]).alias(v) for v in VOTERS]
    distance = F.expr(f"coalesce(least({gap}, {swap} + 1), 3)").alias("distance")
    alike = F.expr("size(_hit) / greatest(1, size(r_words))").alias("alike")
    return seen.select("row_id", "entity_id", "decoy", *cells, distance, alike)


class LabelModel:
    """A two-class generative model of vote vectors with learnt accuracies and joined factors for dependent voters.

    How voters vote on pairs that are no match is learnt from decoys, how they vote on matches by expectation-maximisation.
    """

    LEVELS = 5

    def __init__(self, dependence: float = 0.02, rounds: int = 60) -> None:
        self.dependence, self.rounds = dependence, rounds

    def fit(self, vectors: np.ndarray, counts: np.ndarray, decoys: np.ndarray) -> np.ndarray:
        """The posterior of a match for every distinct vote vector, from its counts among candidates and among decoys."""
        self.factors: list[tuple[int, ...]] = [(j,) for j in range(vectors.shape[1])]
        posterior = np.clip(1 - (decoys + 0.5) / (counts + 1.0), 0.02, 0.98)
        posterior = self._learn(vectors, counts, decoys, posterior)
        self.factors = self._join(vectors, counts * posterior, decoys)
        return self._learn(vectors, counts, decoys, posterior)

    def _codes(self, vectors: np.ndarray, factor: tuple[int, ...]) -> np.ndarray:
        code = np.zeros(len(vectors), dtype=np.int64)
        for j in factor:
            code = code * self.LEVELS + vectors[:, j]
        return code

    def _log(self, codes: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
        out = np.zeros(len(weight))
        for factor, code in zip(self.factors, codes):
            table = np.bincount(code, weight, self.LEVELS ** len(factor)) + 0.5
            out += np.log(table / table.sum())[code]
        return out

    def _learn(self, vectors: np.ndarray, counts: np.ndarray, decoys: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        codes = [self._codes(vectors, f) for f in self.factors]
        other = self._log(codes, decoys)
        for _ in range(self.rounds):
            weight = counts * posterior
            log = other + np.log(counts.sum() - weight.sum() + 1.0) - self._log(codes, weight) - np.log(weight.sum() + 1.0)
            fresh = 1 / (1 + np.exp(np.clip(log, -60, 60)))
            if np.abs(fresh - posterior).max() < 1e-6:
                return fresh
            posterior = fresh
        return posterior

    def _join(self, vectors: np.ndarray, *weights: np.ndarray) -> list[tuple[int, ...]]:
        """Pair the voters that say most about each other within the classes; every voter is in one factor."""
        scored = []
        for i in range(vectors.shape[1]):
            for j in range(i + 1, vectors.shape[1]):
                total = 0.0
                for weight in weights:
                    joint = np.bincount(self._codes(vectors, (i, j)), weight, self.LEVELS**2).reshape(self.LEVELS, -1) + 1e-9
                    joint /= joint.sum()
                    apart = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
                    total += float((joint * np.log(joint / apart)).sum())
                scored.append((total, i, j))
        free, factors = set(range(vectors.shape[1])), []
        for score, i, j in sorted(scored, reverse=True):
            if score > self.dependence and i in free and j in free:
                factors.append((i, j))
                free -= {i, j}
        return factors + [(j,) for j in sorted(free)]


def confidences(voted: DataFrame) -> DataFrame:
    """The candidates with their posterior. Only distinct vote vectors with counts reach the driver: at most 5 ** 8, whatever the data."""
    seen = voted.groupBy(*VOTERS).agg(F.count_if(~F.col("decoy")).alias("real"), F.count_if("decoy").alias("decoy")).toPandas()
    voted = voted.where("NOT decoy")
    if seen.empty:
        return voted.withColumn("confidence", F.lit(0.0))
    posterior = LabelModel().fit(seen[list(VOTERS)].to_numpy(dtype=np.int64), seen["real"].to_numpy(dtype=float), seen["decoy"].to_numpy(dtype=float))
    learnt = voted.sparkSession.createDataFrame(seen[list(VOTERS)].assign(confidence=posterior))
    return voted.join(F.broadcast(learnt), list(VOTERS))


def one_to_one(scored: DataFrame) -> DataFrame:
    """Links pairs that are each other's best by (confidence, likeness, nearness, identifiers), round by round, until none is left."""
    rank = F.struct(F.round("confidence", 6).alias("c"), "alike", (-F.col("distance")).alias("d"), F.xxhash64("row_id", "entity_id").alias("h"))
    open_pairs = scored.where(F.col("confidence") >= LEAST).select("row_id", "entity_id", "confidence", rank.alias("rank")).checkpoint()
    links = None
    while not open_pairs.isEmpty():
        best = open_pairs.withColumn("_r", F.max("rank").over(Window.partitionBy("row_id"))).withColumn("_e", F.max("rank").over(Window.partitionBy("entity_id")))
        taken = best.where("rank = _r AND rank = _e").select("row_id", "entity_id", "confidence").checkpoint()
        links = taken if links is None else links.unionByName(taken)
        open_pairs = open_pairs.join(taken.select("row_id"), "row_id", "left_anti").join(taken.select("entity_id"), "entity_id", "left_anti").checkpoint()
    return links if links is not None else scored.select("row_id", "entity_id", "confidence").where("false")


def link(statements: DataFrame, transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """``row_id, entity_id, confidence`` of the linked pairs."""
    payments = booked_payments(transactions)
    lines = statement_lines(statements, accounts, payments).checkpoint()
    return one_to_one(confidences(votes(candidates(with_decoys(lines), payments).checkpoint()).checkpoint()))
