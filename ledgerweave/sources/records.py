"""Canonical facts of a delivered record: its day and its amount in minor units, in whatever notation they arrive."""

from __future__ import annotations

import datetime
import re
from decimal import Decimal, InvalidOperation

# The names, lower case, under which sources put a record's day, amount, counterparty, text, lasting id and currency.
DAY_FIELDS = ("timestamp", "transactiontime", "occurredat", "date", "d")
AMOUNT_FIELDS = ("amount", "amount (gbp)", "t")
PARTY_FIELDS = ("merchant_name", "counterpartyname", "counterparty_name", "counter party", "payee / payer", "name", "merchant", "p", "a")
TEXT_FIELDS = ("description", "narrative", "appears on statement as", "reference", "m")
ID_FIELDS = ("normalised_provider_transaction_id", "feeditemuid", "transaction id", "id")
ENTRY_FIELDS = ("display_name", "name", "title", "account_id", "savingsgoaluid")

_ISO = re.compile(r"\s*(\d{4})-(\d{1,2})-(\d{1,2})")
_DMY = re.compile(r"\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})\s*$")


def day_of(value: object) -> str | None:
    """yyyy-mm-dd of an instant, an epoch in seconds or milliseconds, or a day-first date; None when it is none of them."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        seconds = value / 1000 if abs(value) > 1e11 else value
        try:
            return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).strftime("%Y-%m-%d")
        except (ValueError, OverflowError, OSError):
            return None
    text = str(value)
    if m := _ISO.match(text):
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
    elif m := _DMY.match(text):
        d, mo, y = int(m[1]), int(m[2]), int(m[3]) + (2000 if len(m[3]) == 2 else 0)
        if mo > 12 >= d:
            d, mo = mo, d
    else:
        return None
    return f"{y:04d}-{mo:02d}-{d:02d}" if 1 <= mo <= 12 and 1 <= d <= 31 else None


def minor_units(value: object, minor: bool = False) -> int | None:
    """Minor units of a number or a text with signs, currency and separators. A text without a decimal point, and any value with
    `minor`, already counts minor units."""
    if value is None or isinstance(value, bool):
        return None
    text = str(value) if isinstance(value, (int, float)) else re.sub(r"[^0-9.\-]", "", str(value))
    try:
        exact = Decimal(text)
        major = not minor and ("." in text or isinstance(value, (int, float)))
        return int((exact * 100 if major else exact).to_integral_value()) if exact.is_finite() else None
    except (InvalidOperation, ValueError, OverflowError):
        return None


def lowered(record: dict) -> dict:
    return {str(k).strip().lower(): v for k, v in record.items()}


def first_of(low: dict, names: tuple[str, ...]) -> object:
    for name in names:
        value = low.get(name)
        if value is not None and value != "":
            return value
    return None


def day_and_amount(record: dict) -> tuple[str | None, int | None]:
    """The day and the signed minor units of one record."""
    low = lowered(record)
    amount = first_of(low, AMOUNT_FIELDS)
    if isinstance(amount, dict):
        minor = minor_units(amount.get("minorUnits"), minor=True)
        out = str(low.get("direction", "")).strip().upper() == "OUT"
        return day_of(first_of(low, DAY_FIELDS)), -minor if out and minor is not None else minor
    return day_of(first_of(low, DAY_FIELDS)), minor_units(amount)


def entry_name(record: dict) -> str | None:
    """What names a snapshot entry: its name without blanks and letter case, else its id."""
    value = first_of(lowered(record), ENTRY_FIELDS)
    return None if value is None else "".join(str(value).split()).casefold()
