"""Amounts, messages and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str


def _col(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(value: Value, decimals: int) -> Column:
    """Halves go away from zero, of the value multiplied out: a difference of amounts that floating point puts a hair below a half
    counts as the half."""
    return F.round(_col(value) * 10.0**decimals, 0) / 10.0**decimals


def format_currency(value: Value, decimals: int = 0, symbol: str = "$") -> Column:
    """$36.990 - dots between thousands, a comma before decimals; a dash for null. Halves go away from zero, as the
    amount is written in decimals."""
    return F.coalesce(F.concat(F.lit(symbol), F.translate(F.format_number(F.round(_col(value), decimals), decimals), ",.", ".,")), F.lit("—"))


def discount_percent(best: Value, worst: Value) -> Column:
    """What the best price is below the worst, in percent; 0 where it is not, or one is missing or 0."""
    best, worst = F.nullif(_col(best), F.lit(0)), F.nullif(_col(worst), F.lit(0))
    return F.coalesce(F.greatest(F.try_divide(worst - best, worst) * 100, F.lit(0.0)), F.lit(0.0))


def title(name: Value) -> Column:
    """A last part in brackets moves behind a dot; markup is escaped."""
    moved = F.regexp_replace(F.trim(_col(name)), r"^(.*\S)\s*\(([^()]+)\)$", "$1 · $2")
    return F.replace(F.replace(F.replace(moved, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def event_line(kind: Value, name: Value, old: Value, new: Value) -> Column:
    """One line of a message for an event."""
    drop = F.concat(title(name), F.lit(": "), format_currency(old), F.lit(" → "), format_currency(new))
    return F.when(_col(kind) == "price_drop", F.concat(F.lit("↓ "), drop)).when(_col(kind) == "price_rise", F.concat(F.lit("↑ "), drop)).otherwise(F.concat(F.lit("• "), title(name), F.lit(": "), _col(kind)))


def saving_line(name: Value, store: Value, best: Value, saving: Value, percent: Value) -> Column:
    """One line of a message for an opportunity: what it costs, where, and what it saves."""
    return F.concat(F.lit("★ "), title(name), F.lit(": "), format_currency(best), F.lit(" in "), _col(store), F.lit(" (−"), format_currency(saving), F.lit(", "), F.round(_col(percent), 0).cast("int").cast("string"), F.lit(" %)"))


def days_until(expiry: Value, now: Value) -> Column:
    """Whole days still to go, rounded up, 0 at least."""
    return F.greatest(F.ceil((F.unix_timestamp(_col(expiry)) - F.unix_timestamp(_col(now))) / 86400), F.lit(0)).cast("int")


def local_date(ts: Value, zone: str = "America/Santiago") -> Column:
    """E42."""
    return F.date_format(F.from_utc_timestamp(_col(ts), zone), "dd-MM-yyyy")


def hours_since(ts: Value, now: Value) -> Column:
    """E43."""
    return (F.unix_timestamp(_col(now)) - F.unix_timestamp(_col(ts))) / 3600


def ago(ts: Value, now: Value) -> Column:
    """Age in words."""
    s = F.unix_timestamp(_col(now)) - F.unix_timestamp(_col(ts))
    part = lambda unit, name: F.concat(F.floor(s / unit).cast("string"), F.lit(" " + name))
    return F.when(s.isNull(), "never").when(s < 60, "now").when(s < 3600, part(60, "min")).when(s < 86400, part(3600, "h")).when(s < 86400 * 30, part(86400, "d")).otherwise(F.date_format(_col(ts), "yyyy-MM-dd"))


def parse_term(text: Value, now: Value, zone: str = "America/Santiago") -> Column:
    """E40: '30', '30 d' or '30 days' from now, or a date: then the last second of that day in the zone, in UTC."""
    raw = F.lower(F.trim(_col(text)))
    days = F.regexp_extract(raw, r"^\+?([0-9]{1,4})\s*(?:d|days?|dias?|días?)?$", 1).try_cast("int")
    day = F.coalesce(*(F.try_to_timestamp(raw, F.lit(f)) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy/MM/dd")))
    end = F.to_utc_timestamp(F.date_trunc("day", day) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"), zone)
    return F.coalesce(F.dateadd(_col(now).cast("date"), days).cast("timestamp") + (_col(now) - F.date_trunc("day", _col(now))), end)


def in_hours(ts: Value, first: int, last: int, zone: str = "America/Santiago") -> Column:
    """whether the local hour lies in a band."""
    return F.hour(F.from_utc_timestamp(_col(ts), zone)).between(first, last)
