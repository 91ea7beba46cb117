"""Business rules as column functions: freshness, alerts, schedules, price qualifiers, enrichment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRESH_DAYS, STALE_DAYS = 30, 90


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_days(parsed_at: Column | str, updated_at: Column | str, now: Column) -> Column:
    """Whole calendar days since a price was seen, or else updated; never negative, null if neither is known."""
    seen = F.coalesce(_column(parsed_at).cast("date"), _column(updated_at).cast("date"))
    return F.when(seen.isNotNull(), F.greatest(F.datediff(now, seen), F.lit(0)))


def freshness(age: Column | str) -> Column:
    age = _column(age)
    return F.when(age.isNull(), "unknown").when(age <= FRESH_DAYS, "fresh").when(age <= STALE_DAYS, "stale").otherwise("expired")


def freshness_warning(state: Column | str) -> Column:
    state = _column(state)
    return F.when(state == "stale", "Price data is 31-90 days old; verify current accuracy").when(state == "expired", "Price data is over 90 days old; may not reflect current prices")


def badge(state: Column | str) -> Column:
    """Label and colour of a state; unknown states get the badge of ``unknown``."""
    state = _column(state)
    label = F.when(state == "fresh", "Fresh").when(state == "stale", "Stale").when(state == "expired", "Expired").otherwise("Unknown")
    colour = F.when(state == "fresh", "green").when(state == "stale", "yellow").when(state == "expired", "red").otherwise("gray")
    return F.struct(label.alias("label"), colour.alias("color"))


def is_historical(ts: Column | str, now: Column) -> Column:
    """More than 90 whole days (of 24 hours) old."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(_column(ts))) / 86400) > STALE_DAYS


def alert_fires(kind: Column | str, threshold: Column | str, price: Column | str) -> Column:
    kind = _column(kind)
    return F.when(kind == "below", _column(price) < _column(threshold)).when(kind == "above", _column(price) > _column(threshold)).when(kind == "changed", _column(price).isNotNull()).otherwise(False)


def frequency_hours(priority: Column | str) -> Column:
    return F.when(_column(priority) == "P0", 24).otherwise(48)


def jitter_minutes(source: Column | str, most: int = 30) -> Column:
    """A stable delay per source, 0 to ``most`` minutes."""
    return F.pmod(F.crc32(_column(source)), F.lit(most + 1)).cast("int")


def next_run(last_success: Column | str, hours: Column, jitter: Column) -> Column:
    return _column(last_success) + F.make_dt_interval(F.lit(0), hours.cast("int"), jitter.cast("int"))


def lock_is_stale(taken_at: Column | str, now: Column, ttl_seconds: int = 600) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(_column(taken_at)) >= ttl_seconds


def retry_delay(attempt: Column | str, jitter: Column | float = 0.0) -> Column:
    return F.pow(F.lit(2.0), _column(attempt) - 1) * 0.5 + jitter


def price_qualifier_error(qualifier: Column | str, price: str = "price", low: str = "price_min", high: str = "price_max", base: str = "base_price", total: str = "total_price") -> Column:
    """What a qualified price lacks or contradicts; null if it is consistent."""
    q = _column(qualifier)
    c = F.col
    return (
        F.when((q == "exact") & c(price).isNull(), "exact needs price")
        .when((q == "from") & c(price).isNull() & c(low).isNull(), "from needs price or price_min")
        .when((q == "range") & (c(low).isNull() | c(high).isNull()), "range needs price_min and price_max")
        .when((q == "range") & (c(high) < c(low)), "price_max is below price_min")
        .when((q == "base_fee_total") & (c(base).isNull() | c(total).isNull()), "base_fee_total needs base_price and total_price")
        .when((q == "base_fee_total") & (c(total) < c(base)), "total_price is below base_price")
    )


def enrich_action(current: Column | str, offered: Column | str) -> Column:
    """skip (nothing offered, or the same), fill (nothing known yet), or conflict (kept and reported)."""
    have, new = F.nullif(_column(current), F.lit("")), F.nullif(_column(offered), F.lit(""))
    return F.when(new.isNull() | (have == new), "skip").when(have.isNull(), "fill").otherwise("conflict")


def half_even_mean(total: Column, n: Column) -> Column:
    """A mean of money to cents, ties to even."""
    return F.when(n > 0, F.bround(total.cast("decimal(38,12)") / n, 2)).cast("decimal(18,2)")


def batch_status(imported: Column, errors: Column) -> Column:
    return F.when(errors == 0, "success").when(imported > 0, "partial_success").otherwise("failed")
