"""Column helpers: null-tolerant predicates, guarded ratios, calendar parts, text cleaning, labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tolerant(value: str | Column, condition: Column) -> Column:
    """Holds where the value is null."""
    return col(value).isNull() | condition


def strict(condition: Column) -> Column:
    """A null condition counts as false."""
    return F.coalesce(condition, F.lit(False))


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """top / bottom where bottom is positive, else null."""
    return F.when(col(bottom) > 0, col(top) / col(bottom))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / F.lit(6e7)


def calendar(ts: str | Column) -> dict[str, Column]:
    """Calendar columns; days of the week count from Sunday = 1."""
    t = col(ts)
    dow = F.dayofweek(t)
    return {
        "date": F.to_date(t),
        "year": F.year(t),
        "month": F.month(t),
        "hour": F.hour(t),
        "day_of_week": dow,
        "is_weekend": dow.isin(1, 7).cast("int"),
        "week_of_year": F.weekofyear(t),
    }


def hour_start(ts: str | Column) -> Column:
    """The hour's start as a timestamp without time zone."""
    t = col(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.day(t), F.hour(t), F.lit(0), F.lit(0))


def at_hour(date: str | Column, hour: str | Column) -> Column:
    d = col(date)
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), col(hour), F.lit(0), F.lit(0))


def money(text: str | Column) -> Column:
    """A number from an amount as text. Both ``1,234.50`` and ``1.234,50`` keep their thousands; a lone comma before one
    or two last digits is a decimal comma."""
    x = F.regexp_replace(col(text), r"[^0-9,.\-]", "")
    english = F.regexp_replace(x, ",", "")
    continental = F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".")
    return F.when(x.rlike(r",\d{1,2}$"), continental).otherwise(english).try_cast("double")


def clean_text(c: str | Column) -> Column:
    """Trimmed text; null for empty text and for words that stand for a missing value."""
    x = F.trim(col(c).cast("string"))
    return F.when(~F.lower(x).isin("", "nan", "<na>", "none"), x)


def title_case(c: str | Column) -> Column:
    """Each letter that doesn't follow a letter is upper-case, all others lower-case."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.concat_ws("", F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))))


def snapshot_date(c: str | Column) -> Column:
    """The first of January for a bare year or ``year-acs5``, else the first of the date's month."""
    x = F.trim(col(c).cast("string"))
    year = F.regexp_extract(x, r"^(\d{4})(?:-acs5)?$", 1)
    return F.when(year != "", F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))).otherwise(F.trunc(x.try_cast("date"), "month"))


def steps(c: str | Column, bounds: Iterable[tuple[float, str]], last: str, missing: str | None) -> Column:
    """The label of the first bound that the value doesn't exceed."""
    x = col(c)
    out = F.when(x.isNull(), F.lit(missing))
    for bound, label in bounds:
        out = out.when(x <= bound, F.lit(label))
    return out.otherwise(F.lit(last))


def mapped(c: str | Column, codes: Mapping[str, str], otherwise: Column) -> Column:
    key = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[key], otherwise)


def borough_name(c: str | Column) -> Column:
    """Codes 1 to 5 and names in any case to a borough's name; unknown names in title case; empty and 0 to null."""
    codes = {"1": "Manhattan", "2": "Bronx", "3": "Brooklyn", "4": "Queens", "5": "Staten Island"}
    known = codes | {v.lower(): v for v in codes.values()}
    x = clean_text(c)
    return F.when(x != "0", mapped(x, known, title_case(x)))


#: Bounds and labels of scores.
FIVE_LEVELS = ((0.2, "low"), (0.4, "medium_low"), (0.6, "medium"), (0.8, "medium_high"))
THREE_LEVELS = ((0.33, "low"), (0.66, "medium"))


def five_levels(c: str | Column) -> Column:
    return steps(c, FIVE_LEVELS, "high", "no_data")


def three_levels(c: str | Column) -> Column:
    return steps(c, THREE_LEVELS, "high", None)


def rain_bin(mm: str | Column) -> Column:
    """Missing rain is unknown, not heavy."""
    x = col(mm)
    return F.when(x.isNull(), "unknown").when(x <= 0, "none").when(x <= 2, "light").when(x <= 8, "moderate").otherwise("heavy")


def filled_from_each_other(a: str, b: str, mismatch: bool = False) -> dict[str, Column]:
    """Two columns for one thing, each filled from the other; on demand b follows a where they differ."""
    x, y = F.col(a), F.col(b)
    second = F.when(x.isNotNull() & y.isNotNull() & (F.lower(x.cast("string")) != F.lower(y.cast("string"))), x).otherwise(F.coalesce(y, x)) if mismatch else F.coalesce(y, x)
    return {a: F.coalesce(x, y), b: second}


def integral_or_one(c: str | Column) -> Column:
    """A whole number, or 1 for anything else."""
    x = col(c).cast("string").try_cast("double")
    return F.when(x == F.floor(x), x.cast("int")).otherwise(F.lit(1))


def within(c: str | Column, first: str | None = None, last: str | None = None) -> Column:
    """Whether a date lies in a range; both ends belong to it, and an end that isn't given is open."""
    d = F.to_date(col(c))
    out = d.isNotNull()
    out = out if first is None else out & (d >= F.lit(first).cast("date"))
    return out if last is None else out & (d <= F.lit(last).cast("date"))


def from_web_mercator(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a point in metres on the web's map projection (a sphere of 6,378,137 m)."""
    radius = 6378137.0
    return F.degrees(col(x) / radius), F.degrees(2 * F.atan(F.exp(col(y) / radius)) - F.lit(3.141592653589793 / 2))


def safe_names(names: Iterable[str]) -> list[str]:
    """Names of letters, digits and single underscores, made unique by a number."""
    import re

    out: list[str] = []
    for name in names:
        plain = re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]", "_", name)).strip("_") or "column"
        n, unique = 1, plain
        while unique in out:
            n, unique = n + 1, f"{plain}_{n + 1}"
        out.append(unique)
    return out
