"""Scalar normalisation and validation as column expressions; what must be refused comes out null (or false), never guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import case_folded, decomposed

# Fragments that banks append to a stable narrative, in the order in which they are stripped.
VOLATILE = (
    r"\bON \d{2}[/-]\d{2}[/-]\d{2,4}\b",
    r"\b\d{2}[A-Z]{3}\d{2}\b",
    r"\bCARD\s*\d{4}\b",
    r"\bX{2,}\d{4}\b",
    r"\bREF[:\s]*[A-Z0-9]{6,}\b",
    r"\bPENDING\b",
    r"\bAUTH(ORISATION)?\b",
)
# The alphabet of account ids, which leaves out I, L, O and U.
ACCOUNT_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
# Usual gaps in days between payments.
CADENCES = ((6, 8, "weekly"), (13, 15, "fortnightly"), (27, 32, "monthly"), (88, 95, "quarterly"), (360, 370, "annual"))
# Words of a statement's own furniture, which masking leaves legible, with months and currency and country codes.
FURNITURE = (
    "statement account sort code number page of to from date dates description details reference type paid in out money debit debits credit "
    "credits balance balances opening closing brought carried forward start end total totals subtotal summary period transactions transaction "
    "interest rate rates apr annual percentage fee fees charge charges charged purchases purchase cash advance advances transfer transfers "
    "promotional promotion introductory expires ends until limit available overdraft arranged minimum payment payments due repayment term and on "
    "the for your this was will be cr dr gb gbr us usa ie irl fr fra de deu es esp nl nld it ita eur usd gbp jan feb mar may jun jul aug sep oct "
    "nov dec january february march april june july august september october november december"
).split()


def parse_amount(text: Column, currency: Column | None = None) -> Column:
    """Minor units of a printed amount; null where it must be refused: no number, parts of a penny, or another currency than GBP."""
    bare = F.trim(F.regexp_replace(text, "[,£+]", ""))
    held = F.trim(F.regexp_extract(bare, r"^\((.*)\)$", 1))
    digits = F.when(bare.rlike(r"^\(.*\)$"), held).otherwise(bare)
    whole = F.regexp_replace(digits, r"^(-?)\.", "$10.")
    minor = (whole.try_cast("decimal(38,2)") * 100).cast("long")
    read = F.when(whole.rlike(r"^-?[0-9]+(\.[0-9]{0,2}0*)?$"), F.when(bare.startswith("("), -minor).otherwise(minor))
    return read if currency is None else F.when(F.upper(F.trim(currency)) == "GBP", read)


def format_amount(minor: Column) -> Column:
    whole = F.abs(minor)
    return F.concat(F.when(minor < 0, "-").otherwise(""), F.lit("£"), (F.floor(whole / 100)).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def normalise_description(text: Column) -> Column:
    """The stable core of a narrative: no accents, volatile fragments, case or punctuation, single blanks."""
    out = decomposed(text)
    for pattern in VOLATILE:
        out = F.regexp_replace(out, f"(?iU){pattern}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(case_folded(out), "[^a-z0-9 ]+", " "), r"\s+", " "))


def content_key(amount: Column, day: Column, description: Column) -> Column:
    """SHA-256 of amount, day and stable narrative; null where amount or day is missing, a null narrative counts as empty."""
    return F.sha2(F.concat(amount.cast("string"), F.lit("\x1f"), day.cast("string"), F.lit("\x1f"), F.coalesce(normalise_description(description), F.lit(""))), 256)


def entity_id(account: Column, source: Column, source_id: Column, key: Column, occurrence: Column, digest: Column) -> Column:
    """A payment's id as a function of its first sighting: the source's own id, else content and occurrence, and the artefact that told of it."""
    own = F.coalesce(source_id, F.concat(key, F.lit("#"), occurrence.cast("string")))
    return F.substring(F.sha2(F.concat_ws("\x1f", account, source, own, digest), 256), 1, 32)


def condense(text: Column) -> Column:
    """Case folded, without any blank."""
    return F.regexp_replace(case_folded(text), r"(?U)\s+", "")


def cadence(gap: Column) -> Column:
    """The name of a usual gap between payments."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(CADENCES):
        out = F.when(gap.between(low, high), name).otherwise(out)
    return out


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def pinned_date(text: Column, layout: str = "dd/MM/yyyy") -> Column:
    """A day in exactly one layout, null otherwise."""
    return F.try_to_date(F.trim(text), layout)


def qif_date(text: Column) -> Column:
    """Day, month and year parted by one of ``/ - . '``; a month above 12 is refused, not swapped, two-digit years are after 2000."""
    at = r"^\s*(\d{1,2})[/\-.']+\s*(\d{1,2})[/\-.']+\s*(\d{2}|\d{4})\s*$"
    year = F.regexp_extract(text, at, 3)
    return F.when(text.rlike(at), _date(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.regexp_extract(text, at, 2), F.regexp_extract(text, at, 1)))


def claimed_window(name: Column, rows_from: Column, rows_to: Column) -> Column:
    """``struct<claim_from, claim_to>`` of the days a file name claims, null when it claims none.

    Two ISO days count first, else two days with the year last: day first, unless only the month-first reading holds the rows.
    """
    iso, loose = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2})-(\d{2})-(\d{4})"
    part = lambda pattern, group, k: F.get(F.regexp_extract_all(name, F.lit(pattern), F.lit(group)), F.lit(k))
    read = lambda pattern, y, m, d: [_date(part(pattern, y, k), part(pattern, m, k), part(pattern, d, k)) for k in (0, 1)]
    window = lambda ab: F.when(ab[0] <= ab[1], F.struct(ab[0].alias("claim_from"), ab[1].alias("claim_to")))
    plain, first, second = window(read(iso, 1, 2, 3)), window(read(loose, 3, 2, 1)), window(read(loose, 3, 1, 2))
    holds = lambda w: F.coalesce((w["claim_from"] <= rows_from) & (w["claim_to"] >= rows_to), F.lit(False))
    chosen = F.when(first.isNull(), second).when(second.isNotNull() & holds(second) & ~holds(first), second).otherwise(first)
    return F.when(F.size(F.regexp_extract_all(name, F.lit(iso), F.lit(0))) >= 2, plain).otherwise(chosen)


def claimed_note(window: Column, earliest: Column, latest: Column) -> Column:
    """What a claim adds to the rows: ``outside``, or the quiet days at its head and tail as ``quiet:head,tail``, or ``full``."""
    head, tail = F.datediff(earliest, window["claim_from"]), F.datediff(window["claim_to"], latest)
    return (
        F.when(window.isNull() | earliest.isNull(), F.lit(None).cast("string")).when((head < 0) | (tail < 0), "outside")
        .when((head > 0) | (tail > 0), F.concat(F.lit("quiet:"), head.cast("string"), F.lit(","), tail.cast("string"))).otherwise("full")
    )


def ask_window(asked: Column, attempted: Column) -> Column:
    """``struct<asked_from, asked_to>`` of the days one ask covered: from / to, else changesSince or since up to the ask; null for other asks."""
    day = lambda key: F.try_to_date(F.regexp_extract(asked, rf"(?:^|[?&\s]){key}=(\d{{4}}-\d{{2}}-\d{{2}})", 1), "yyyy-MM-dd")
    start, stop, since, when = day("from"), day("to"), F.coalesce(day("changesSince"), day("since")), attempted.cast("date")
    return F.when(start.isNotNull() & stop.isNotNull(), F.when(start <= stop, F.struct(start.alias("asked_from"), stop.alias("asked_to")))).when(since <= when, F.struct(since.alias("asked_from"), when.alias("asked_to")))


def name_ok(name: Column) -> Column:
    """2 to 64 lower-case letters, digits and hyphens that begin and end with a letter or digit."""
    return F.coalesce(name.rlike("^[a-z0-9][a-z0-9-]{0,62}[a-z0-9]$"), F.lit(False))


def account_id_ok(value: Column) -> Column:
    """``acc_``, ten characters and one that checks their weighted sum, so that a mistyped or transposed id is refused."""
    body = F.substring(value, 5, 10)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda a, i: a + i * (F.instr(F.lit(ACCOUNT_ALPHABET), F.substr(body, i, F.lit(1))) - 1))
    checks = F.substr(F.lit(ACCOUNT_ALPHABET), (total % 32 + 1).cast("int"), F.lit(1)) == F.substring(value, 15, 1)
    return F.coalesce(value.rlike(f"^acc_[{ACCOUNT_ALPHABET}]{{11}}$") & checks, F.lit(False))


def capital_value(kind: Column, income: Column, multiplier: Column) -> Column:
    """Yearly income times an explicit multiplier; none for a state pension or without a multiplier."""
    return F.when((kind != "state_pension") & multiplier.isNotNull(), income * multiplier)


def slug(text: Column) -> Column:
    """At most 64 letters, digits and single hyphens, with none at the ends."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64), "-+$", "")


def show_duration(seconds: Column) -> Column:
    """A duration in a unit of its size, never rounded to zero."""
    return F.when(seconds >= 1, F.format_string("%.2fs", seconds)).when(seconds >= 0.01, F.format_string("%.0fms", seconds * 1000)).when(seconds >= 0.0001, F.format_string("%.1fms", seconds * 1000)).otherwise("<0.01ms")


def show_share(part: Column, whole: Column) -> Column:
    """A share in percent, never rounded to zero; ``-`` of nothing."""
    percent = part / whole * 100
    return F.when(whole <= 0, "-").when(percent >= 1, F.format_string("%.0f%%", percent)).when(percent >= 0.1, F.format_string("%.1f%%", percent)).otherwise("<0.1%")


def rate_in_name(name: Column) -> Column:
    """The yearly rate that an account name ends with, as in ``Loan - 6.5%``; null without one."""
    return F.nullif(F.regexp_extract(name, r"-\s*(\d+(?:\.\d+)?)\s*%\s*$", 1), F.lit("")).try_cast("decimal(10,4)")


def name_stem(name: Column) -> Column:
    """An account name without the rate at its end."""
    return F.trim(F.regexp_replace(name, r"\s*-\s*\d+(?:\.\d+)?\s*%\s*$", ""))


def media_type(payload: Column, name: Column) -> Column:
    """What a payload is by its first bytes, else by the ending of its name."""
    head = F.hex(F.substring(payload, 1, 5))
    by_name = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    return (
        F.when(head == "255044462D", "application/pdf").when(head.startswith("7B") | head.startswith("5B"), "application/json")
        .when(by_name == "json", "application/json").when(by_name == "csv", "text/csv").when(by_name == "qif", "application/qif").when(by_name == "pdf", "application/pdf")
        .otherwise("application/octet-stream")
    )


def owned_id(imported_id: Column) -> Column:
    """Whether an imported id is one that this engine gives: a content key and an occurrence."""
    return F.coalesce(imported_id.rlike(r"^[0-9a-f]{64}:\d+$"), F.lit(False))


def rung(days_left: Column, ladder: Sequence[tuple[int, int]]) -> Column:
    """The rung of the first limit (in days, ascending) that is not yet passed, 0 beyond the ladder, null when the day is over."""
    out = F.lit(0)
    for limit, step in reversed(ladder):
        out = F.when(days_left <= limit, step).otherwise(out)
    return F.when(days_left >= 0, out)


def common_prefix(low: Column, high: Column) -> Column:
    """What the smallest and the largest text of a set, and so all of it, begin with."""
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(low), F.length(high)))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1))) & (F.length(low) >= i), i).otherwise(n))
    return F.substr(low, F.lit(1), same)


def mask_line(text: Column) -> Column:
    """Digits to 9 and letters to X or x, but for words of a statement's furniture and the marks CR and DR after a number.

    Case folds on plain letters only; a token that mixes letters and digits is a reference and never survives.
    """
    parts = F.regexp_extract_all(text, F.lit("([0-9A-Za-z]+|[^0-9A-Za-z]+)"), F.lit(1))
    hide = lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "[0-9]", "9"), "[A-Z]", "X"), "[a-z]", "x")
    words = F.array(*map(F.lit, FURNITURE))
    shown = lambda w: F.when(F.array_contains(words, F.lower(w)), w).when(w.rlike("^(?i)[0-9]+(CR|DR)$"), F.concat(hide(F.regexp_extract(w, "^([0-9]+)", 1)), F.regexp_extract(w, "([A-Za-z]+)$", 1))).otherwise(hide(w))
    return F.array_join(F.transform(parts, shown), "")
