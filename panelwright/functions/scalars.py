"""Column functions: tickers, numbers, dates, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names that mean "no number".
NO_NUMBER = ("N/A", "NA", "NONE", "-", "")
#: Quote units and the currencies they are a hundredth of.
MINOR_UNITS = {"GBp": "GBP", "GBX": "GBP", "ZAc": "ZAR", "ILA": "ILS"}
#: An index provider's spellings of share classes.
TICKER_ALIASES = {"BRKA": "BRK-A", "BRKB": "BRK-B", "BFA": "BF-A", "BFB": "BF-B"}
#: An exchange's sector names and those that screens use.
SECTORS = {
    "Technology": "Technology",
    "Telecommunications": "Communication Services",
    "Health Care": "Healthcare",
    "Consumer Discretionary": "Consumer Cyclical",
    "Consumer Staples": "Consumer Defensive",
    "Finance": "Financial Services",
    "Industrials": "Industrials",
    "Energy": "Energy",
    "Real Estate": "Real Estate",
    "Basic Materials": "Basic Materials",
    "Utilities": "Utilities",
}
TICKER = r"^[A-Z0-9.^=_-]{1,20}$"
EPSILON = 1e-12


def normalize_ticker(c: Column) -> Column:
    """Trimmed upper case; null where that is no ticker."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike(TICKER), t)


def screener_ticker(c: Column) -> Column:
    return normalize_ticker(F.translate(F.trim(c), "/.", "--"))


def universe_ticker(c: Column) -> Column:
    """Alias where there is one, else dots become dashes."""
    t = F.upper(F.trim(c))
    aliases = F.create_map(*[F.lit(x) for kv in TICKER_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, t), F.translate(t, ".", "-"))


def local_symbol(c: Column) -> Column:
    """Codes of four to six digits get the local exchange's suffix."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^[0-9]{4,6}$"), F.concat(t, F.lit(".TW"))).otherwise(t)


def screen_label(c: Column) -> Column:
    return F.upper(F.split(F.trim(c), r"\s+")[0])


def optional_number(c: Column) -> Column:
    """A finite number without ``,``, ``$`` and ``%``; null for names that mean none."""
    t = F.trim(F.regexp_replace(c, "[,$%]", ""))
    n = t.try_cast("double")
    return F.when(~F.upper(t).isin(*NO_NUMBER) & ~F.isnan(n) & (F.abs(n) != float("inf")), n)


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_sector(c: Column) -> Column:
    t = clean_text(c)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTORS.items() for x in kv]), t), t)


def source_date(c: Column) -> Column:
    """ISO, ``M/D/YYYY`` or a long month name; null for what is no date."""
    t = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(F.when(t.rlike(p), t), F.lit(f)).cast("date") for p, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"))])


def first_trade_date(c: Column, zone: Column) -> Column:
    """Epoch seconds or milliseconds (from 1e11 on) to the exchange's local date."""
    n = c.try_cast("double")
    return F.to_date(F.from_utc_timestamp(F.when(F.abs(n) >= 1e11, F.timestamp_millis(n.cast("bigint"))).otherwise(F.timestamp_seconds(n.cast("bigint"))), zone))


def minor_scale(raw: Column) -> Column:
    return F.when(raw.isin(*MINOR_UNITS), 0.01).otherwise(1.0)


def major_currency(raw: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MINOR_UNITS.items() for x in kv]), raw), F.upper(raw))


def week_end(dt: Column) -> Column:
    """The Friday on or after a date."""
    return F.next_day(F.date_sub(dt, 1), "FRI")


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is null or within 1e-12 of zero."""
    return F.when(F.abs(b) > EPSILON, a / b)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def compound(r: Column) -> Column:
    """Aggregate: product of ``1 + r`` less one; total loss where a return is -1."""
    return F.when(F.min(1 + r) <= 0, -1.0).otherwise(F.exp(F.sum(F.log1p(F.when(r > -1, r)))) - 1)
