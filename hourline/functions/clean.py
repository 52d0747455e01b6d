"""Column functions that clean raw values: labels, numbers, flags, times, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of the two label languages.
MONTHS = {
    "en": ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"],
    "nl": ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"],
}


def strip_marks(c: Column) -> Column:
    """Trimmed, without trailing asterisks."""
    return F.trim(F.regexp_replace(F.trim(c), r"\*+$", ""))


def parse_period(c: Column, lang: str = "en") -> Column:
    """struct(year, unit, n) of labels like ``2022 March*``, ``2023 3rd quarter``, ``2009 1st semester``, ``2025``; null for others."""
    label = F.lower(strip_marks(c))
    year = F.regexp_extract(label, r"^(\d{4})", 1).try_cast("int")
    rest = F.trim(F.regexp_replace(label, r"^\d{4}", ""))
    names = F.array(*[F.lit(m) for m in MONTHS[lang]])
    month = F.array_position(names, rest).cast("int")
    nth = F.regexp_extract(rest, r"^([1-4])(st|nd|rd|th) (quarter|semester)$", 1)
    kind = F.regexp_extract(rest, r"^[1-4](st|nd|rd|th) (quarter|semester)$", 2)
    unit = F.when(rest == "", "year").when(month > 0, "month").when((kind == "quarter") | (kind == "semester") & (nth <= "2"), kind)
    n = F.when(month > 0, month).when(nth != "", nth.try_cast("int"))
    return F.when(label.rlike(r"^\d{4}( |$)") & unit.isNotNull(), F.struct(year.alias("year"), unit.alias("unit"), n.alias("n")))


def to_double(c: Column, decimal_comma: bool = False) -> Column:
    """A number, or null for bad text."""
    text = F.trim(c)
    return (F.regexp_replace(text, ",", ".") if decimal_comma else text).try_cast("double")


def sentinel_to_null(c: Column, value: float, atol: float = 0.1, rtol: float = 1e-5) -> Column:
    return F.when(~is_sentinel(c, value, atol, rtol), c)


def is_sentinel(c: Column, value: float, atol: float = 0.1, rtol: float = 1e-5) -> Column:
    return F.abs(c - F.lit(value)) <= F.lit(atol + rtol * abs(value))


def bits(c: Column, low: int, n: int) -> Column:
    """n bits of an integer from bit low on."""
    return F.shiftright(c, low).bitwiseAND((1 << n) - 1).cast("short")


def classify(quality: Column, fill: Column, best: int = 1) -> tuple[Column, Column, Column]:
    """observed, imputed and fill flags of a pixel."""
    return ~fill & (quality <= best), ~fill & (quality > best), fill


def local_to_utc(c: Column, zone: str) -> Column:
    """UTC of a wall time; null where the clock skips it or passes it twice."""
    t = c.cast("timestamp")
    u = F.to_utc_timestamp(t, zone)
    back = lambda x: F.from_utc_timestamp(x, zone)
    hour = F.expr("interval 1 hour")
    ok = (back(u) == t) & (back(u + hour) != t) & (back(u - hour) != t)
    return F.when(ok, u).cast("timestamp_ntz")


def conditional_total(year: Column, levy: Column, tax: Column, last_levy_year: int) -> Column:
    """tax plus levy up to a year, tax alone after it; null where a part is missing."""
    return F.when(year <= last_levy_year, levy + tax).otherwise(tax)


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def day_of_year(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def leap(year: Column) -> Column:
    return (year % 4 == 0) & (year % 100 != 0) | (year % 400 == 0)


def year_hours(year: Column) -> Column:
    return F.when(leap(year), 8784).otherwise(8760)


def hour_floor(c: Column) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def year_in_name(c: Column, low: int = 1900, high: int = 2100) -> Column:
    """The first plausible year in a file name, else -1."""
    year = F.regexp_extract(c, r"(?<!\d)(\d{4})(?!\d{4}(?!\d)\d)", 1).try_cast("int")
    return F.when(year.between(low, high), year).otherwise(-1)


def severity(c: Column, high: float, low: float) -> Column:
    return F.when(c > high, "high").when(c > low, "moderate").otherwise("low")


def first_of_month(year: Column, month: Column) -> Column:
    """Null where the month is none or out of range."""
    ok = month.between(1, 12)
    return F.when(ok, F.make_date(year.cast("int"), F.when(ok, month).cast("int"), F.lit(1)))


def granularity(label: Column) -> Column:
    """year, semester, quarter or month of a period label, by its form; null for what is none."""
    c = F.lower(strip_marks(label))
    return (
        F.when(c.rlike(r"^\d{4}$"), "year")
        .when(c.rlike(r"^\d{4} \d\w\w semester$"), "semester")
        .when(c.rlike(r"^\d{4} \d\w\w quarter$"), "quarter")
        .when(c.rlike(r"^\d{4} [a-z]+$"), "month")
    )


def is_entity(c: Column, name: str) -> Column:
    """Whether a label, without blanks around it, is a name; false for null."""
    return F.coalesce(F.trim(c) == name, F.lit(False))


def mapped(c: Column, names: dict[str, str]) -> Column:
    """The name that a label stands for, without blanks around it and whatever its case; null for labels that names lacks."""
    known = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.lower(), v)]) if names else None
    return F.lit(None).cast("string") if known is None else F.try_element_at(known, F.lower(F.trim(c)))
