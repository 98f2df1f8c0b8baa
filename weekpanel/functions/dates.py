"""Week labels, public dates and tolerant date parsing.

Article times are TIMESTAMP_NTZ in UTC everywhere in this package, so no result depends on the
time zone of the session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
CLOSE_HOUR = 16


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_ending_friday(day: Column | str) -> Column:
    """Friday that ends the Saturday-to-Friday week of ``day`` (the first Friday on or after it)."""
    return F.next_day(F.date_sub(_c(day), 1), "FRI")


def market_week(utc: Column | str, weekend_shift: str = "reference") -> Column:
    """Market week of a UTC article time.

    Articles after Friday 16:00 New York belong to the next week. With ``weekend_shift="reference"``
    Saturday and Sunday articles move one further week, which is what the original data holds;
    ``"next_friday"`` leaves them at the coming Friday.
    """
    if weekend_shift not in ("reference", "next_friday"):
        raise ValueError(weekend_shift)
    local = F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), _c(utc).cast("timestamp_ntz"))
    weekday = F.dayofweek(local)  # Sunday = 1
    late = (weekday == 6) & (F.hour(local) >= CLOSE_HOUR)
    if weekend_shift == "reference":
        late = late | weekday.isin(7, 1)
    friday = week_ending_friday(local.cast("date"))
    return F.when(late, F.date_add(friday, 7)).otherwise(friday)


def public_date(statement: Column | str, filing: Column | str, accepted: Column | str) -> Column:
    """First day the market could know a statement: accepted, else filing, else the latest known date.

    A date before the statement date is not believed. A comparison with a missing statement date is
    false, so a present date then stands.
    """
    d, f, a = _c(statement), _c(filing), _c(accepted)

    def believable(x: Column) -> Column:
        return x.isNotNull() & ~F.coalesce(x < d, F.lit(False))

    return F.when(believable(a), a).when(believable(f), f).otherwise(F.greatest(d, f, a))


# Date layouts accepted from landed files.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy"]


def parse_mixed_date(text: Column | str, formats: list[str] | None = None) -> Column:
    """Date from text in any of the layouts, else NULL."""
    x = F.trim(_c(text).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats or DATE_FORMATS])


def parse_utc(text: Column | str) -> Column:
    """ISO time text (with or without offset) as UTC TIMESTAMP_NTZ; NULL when it cannot be read."""
    x = F.trim(_c(text).cast("string"))
    with_zone = x.rlike(r"[Tt ].*(Z|z|[+-]\d{2}:?\d{2})$")
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(x).cast("timestamp_ntz"))
    return F.when(with_zone, zoned).otherwise(x.try_cast("timestamp_ntz"))


def in_range(ts: Column | str, start: str, end_exclusive: str) -> Column:
    """Half-open bounds; a missing time is outside."""
    t = _c(ts)
    inside = (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end_exclusive).cast("timestamp_ntz"))
    return F.coalesce(inside, F.lit(False))
