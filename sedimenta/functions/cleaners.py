"""Normalisers of text as Columns, one per field type.

Each takes a string Column and gives the typed value, or null where the text has none. All are built-in
expressions, so they stay in whole-stage codegen. Patterns are read with Unicode classes. Null gives null.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the parts of a text look like.
MONEY = r"(?U)-?\d(?:[\d.,\s]*\d)?"
INT = r"(?U)-?\d[\d.]*"
PHONE = r"(?U)\+?\d[\d\s.\-()]{6,}\d"
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
YMD = r"(?U)\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"
DMY = r"(?U)\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})\b"
D_MONTH_Y = r"(?U)\b(\d{1,2})(?:\s+de)?\s+([a-záéíóúñ]+)\.?,?(?:\s+de)?,?\s+(\d{4})\b"
MONTH_D_Y = r"(?U)\b([a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
TIME = r"(?U)\b(\d{1,2}):(\d{2})(?::(\d{2}))?\b"
AGO_ES = r"(?U)\bhace\s+(un|una|\d+)\s+(segundo|minuto|hora|d[ií]a|semana|mes|a[ñn]o)(?:s|es)?\b"
AGO_EN = r"(?U)\b(a|an|\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago\b"
# Names of the months, Spanish before English; any beginning of three letters or more will do.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
# Units of time, in seconds or months.
SECONDS = {"segundo": 1, "second": 1, "minuto": 60, "minute": 60, "hora": 3600, "hour": 3600, "día": 86400, "dia": 86400, "day": 86400, "semana": 604800, "week": 604800}
IN_MONTHS = {"mes": 1, "month": 1, "año": 12, "ano": 12, "year": 12}
#: Units whose distance keeps the time of day.
PRECISE = ["segundo", "second", "minuto", "minute", "hora", "hour"]
# The shape of ISO 8601 texts, with groups for the date, hour, minute, second and fraction.
ISO = r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(?:-?[1-7])?)(?:.([01]\d|2[0-3])(?::?([0-5]\d)(?::?([0-5]\d)(?:[.,](\d+))?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?$"


def _table(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: branches that repeat an expression would each compute it, and grow past what can be compiled."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name or its beginning of three letters or more; null for other words. Three letters tell the month, one search in all names whether the rest fits."""
    names = F.lit("|" + "|".join(MONTHS))
    return F.when((F.length(name) >= 3) & names.contains(F.concat(F.lit("|"), name)), F.try_element_at(_table({n[:3]: m for n, m in MONTHS.items()}), F.substring(name, 1, 3)))


def clean_str(v: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(v, r"(?U)\s+", " "))


def clean_int(v: Column) -> Column:
    """The first whole number; dots are separators of thousands, so '12.5' is 125. Beyond 64 bits: null."""
    return F.replace(F.regexp_substr(F.replace(v, F.lit(" "), F.lit("")), F.lit(INT)), F.lit("."), F.lit("")).try_cast("bigint")


def clean_money(v: Column) -> Column:
    """The first number, as double. Of '.' and ',' the later is the decimal mark; alone, ',' is one before up to two digits, '.' unless three digits follow or it repeats."""
    number = F.replace(F.regexp_substr(F.replace(v, F.lit(" "), F.lit(" ")), F.lit(MONEY)), F.lit(" "), F.lit(""))
    no_dots, no_commas = F.replace(number, F.lit("."), F.lit("")), F.replace(number, F.lit(","), F.lit(""))
    comma, dot = number.contains(","), number.contains(".")
    to_dot = lambda c: F.replace(c, F.lit(","), F.lit("."))
    plain = (
        F.when(comma & dot, F.when(number.rlike(",[^.,]*$"), to_dot(no_dots)).otherwise(no_commas))
        .when(comma, F.when(number.rlike(",[^,]{0,2}$"), to_dot(number)).otherwise(no_commas))
        .when(number.rlike(r"\..*\.|^[^.]*\.[^.]{3}$"), no_dots)
        .otherwise(number)
    )
    return plain.try_cast("double")


def _ymd(y: Column, m: Column, d: Column) -> Column:
    year = y.try_cast("int")
    full = F.when(year >= 100, year).when(year < 70, year + 2000).otherwise(year + 1900)
    return F.try_to_date(F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), m.cast("string"), d.cast("string")), "yyyy-M-d")


def _iso_date(s: Column) -> Column:
    return _let(F.regexp_extract(s, ISO, 1), _iso_day)


def _iso_day(day: Column) -> Column:
    week = F.regexp_extract(day, r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$", 2).try_cast("int")
    year = F.substring(day, 1, 4).try_cast("int")
    weekday = F.coalesce(F.regexp_extract(day, r"W\d{2}-?([1-7])$", 1).try_cast("int"), F.lit(1))
    jan4 = F.try_to_date(F.concat(F.substring(day, 1, 4), F.lit("-01-04")), "yyyy-MM-dd")
    monday = F.date_sub(jan4, F.weekday(jan4))
    by_week = F.date_add(monday, (week - 1) * 7 + weekday - 1)
    last = F.weekofyear(F.try_to_date(F.concat(year.cast("string"), F.lit("-12-28")), "yyyy-MM-dd"))
    return (
        F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
        .when(day.rlike(r"^\d{8}$"), F.try_to_date(day, "yyyyMMdd"))
        .when(day.contains("W") & (week >= 1) & (week <= last), by_week)
    )


def relative_datetime(v: Column, now: Column) -> Column:
    """struct<moment, precise> of 'hoy', 'ayer', 'hace 3 días', '2 hours ago' and their like, seen from now; null without one.

    precise: the time of day counts. Distances in months end on the last day of a shorter month.
    """
    return _let(F.lower(clean_str(v)), lambda low: _relative(low, now))


def _relative(low: Column, now: Column) -> Column:
    today = F.to_date(now).cast("timestamp_ntz")
    spanish = low.rlike(AGO_ES)
    part = lambda i: F.when(spanish, F.regexp_extract(low, AGO_ES, i)).when(low.rlike(AGO_EN), F.regexp_extract(low, AGO_EN, i))
    amount = F.when(part(1).isin("un", "una", "a", "an"), F.lit(1)).otherwise(part(1).try_cast("int"))
    unit = part(2)
    months = F.try_element_at(_table(IN_MONTHS), unit)
    seconds = F.try_element_at(_table(SECONDS), unit)
    back = F.add_months(F.to_date(now), -(amount * months)).cast("timestamp_ntz")
    span = amount.cast("bigint") * seconds
    # whole days and the rest apart: the interval's parts are ints and doubles
    ago = now - F.make_dt_interval((F.floor(span / 86400)).cast("int"), F.lit(0), F.lit(0), F.pmod(span, F.lit(86400)).cast("decimal(18,6)"))
    moment = (
        F.when(low.rlike(r"(?U)\banteayer\b"), F.date_sub(today.cast("date"), 2).cast("timestamp_ntz"))
        .when(low.rlike(r"(?U)\b(ayer|yesterday)\b"), F.date_sub(today.cast("date"), 1).cast("timestamp_ntz"))
        .when(low.rlike(r"(?U)\b(hoy|today)\b"), today)
        .when(amount.isNotNull() & months.isNotNull(), back)
        .when(amount.isNotNull() & seconds.isNotNull(), ago)
    )
    named = low.rlike(r"(?U)\b(anteayer|ayer|yesterday|hoy|today)\b")
    return F.when(moment.isNotNull(), F.struct(moment.alias("moment"), (~named & F.coalesce(unit.isin(PRECISE), F.lit(False))).alias("precise")))


def clean_date(v: Column, now: Column) -> Column:
    """The first date by this order: the whole text in ISO 8601, year-month-day, day-month-year, day and month's name, month's name and day, relative.

    The first form that appears decides: if its date doesn't exist the result is null. Years of two digits are 1970 to 2069.
    """
    return _let(clean_str(v), lambda s: _date(s, now))


def _date(s: Column, now: Column) -> Column:
    by_pattern = _let(F.lower(s), lambda low: _date_by_pattern(low, now))
    return F.coalesce(F.when(s.rlike(ISO), _iso_date(s)), by_pattern)


def _date_by_pattern(low: Column, now: Column) -> Column:
    """Each pattern looks through the text once; its groups are taken from the short match."""
    group = lambda m, p, i: F.regexp_extract(m, p, i)
    forms = [
        (YMD, lambda m: _ymd(group(m, YMD, 1), group(m, YMD, 2), group(m, YMD, 3))),
        (DMY, lambda m: _ymd(group(m, DMY, 3), group(m, DMY, 2), group(m, DMY, 1))),
        (D_MONTH_Y, lambda m: _named(group(m, D_MONTH_Y, 3), group(m, D_MONTH_Y, 2), group(m, D_MONTH_Y, 1))),
        (MONTH_D_Y, lambda m: _named(group(m, MONTH_D_Y, 3), group(m, MONTH_D_Y, 1), group(m, MONTH_D_Y, 2))),
    ]
    named = _relative(low, now)["moment"].cast("date")
    for pattern, day in reversed(forms[2:]):
        named = _if_found(low, pattern, day, named)
    # dates in digits need a mark between them: most texts without one are spared two searches
    marked = low.contains("-") | low.contains("/") | low.contains(".")
    digits = named
    for pattern, day in reversed(forms[:2]):
        digits = _if_found(low, pattern, day, digits)
    return F.when(marked, digits).otherwise(named)


def _if_found(text: Column, pattern: str, body: Callable[[Column], Column], other: Column) -> Column:
    """body of the first match, which is never empty, or other."""
    return _let(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", body(m)).otherwise(other))


def _named(year: Column, month: Column, day: Column) -> Column:
    return _let(month_number(month), lambda n: F.when(n.isNotNull(), _ymd(year, n, day)))


def _at(day: Column, h: Column, m: Column, s: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h, m, s.cast("decimal(18,6)"))


def clean_datetime(v: Column, now: Column) -> Column:
    """Date and time as they stand in the text, an offset ignored: ISO 8601, or the date of clean_date with the first time of day, midnight without a valid one."""
    return _let(clean_str(v), lambda s: _datetime(s, now))


def _datetime(s: Column, now: Column) -> Column:
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    iso = lambda i: F.regexp_extract(s, ISO, i)
    second = F.concat(F.lpad(number(iso(4)).cast("string"), 2, "0"), F.lit("."), F.rpad(F.substring(iso(5), 1, 6), 6, "0")).try_cast("decimal(18,6)")

    def dated(day: Column) -> Column:
        rel = _relative(F.lower(s), now)
        h, m, sec = (number(F.regexp_extract(s, TIME, i)) for i in (1, 2, 3))
        fits = (h < 24) & (m < 60) & (sec < 60)
        clock = F.when(fits, _at(day, h, m, sec)).otherwise(day.cast("timestamp_ntz"))
        return F.when(day.isNotNull(), _let(rel, lambda r: F.when(r["precise"], F.date_trunc("second", r["moment"]).cast("timestamp_ntz")).otherwise(clock)))

    iso_day = F.when(s.rlike(ISO), _iso_date(s))
    return _let(iso_day, lambda d: F.when(d.isNotNull(), _at(d, number(iso(2)), number(iso(3)), second)).otherwise(_let(_date(s, now), dated)))


def clean_phone(v: Column) -> Column:
    """The first telephone number, digits and '+' alone; Spanish numbers get +34."""
    digits = F.regexp_replace(F.regexp_substr(v, F.lit(PHONE)), r"(?U)[^\d+]", "")
    digits = F.when(digits.startswith("0034"), F.concat(F.lit("+34"), F.substring(digits, 5, 1000))).otherwise(digits)
    return F.when(digits.rlike(r"^[6-9].{8}$"), F.concat(F.lit("+34"), digits)).otherwise(digits)


def clean_email(v: Column) -> Column:
    return F.lower(F.regexp_substr(v, F.lit(EMAIL)))


def clean_url(v: Column) -> Column:
    """Without white space at the ends; null if nothing is left. Not validated."""
    return F.nullif(F.regexp_replace(v, r"(?U)^\s+|\s+$", ""), F.lit(""))


#: The normaliser of each field type for one text, given the moment of extraction.
CLEANERS: dict[str, Callable[[Column, Column], Column]] = {
    "str": lambda v, now: clean_str(v),
    "int": lambda v, now: clean_int(v),
    "float": lambda v, now: clean_money(v),
    "money": lambda v, now: clean_money(v),
    "date": clean_date,
    "datetime": clean_datetime,
    "phone": lambda v, now: clean_phone(v),
    "email": lambda v, now: clean_email(v),
    "url": lambda v, now: clean_url(v),
}
#: The Spark type of each field type.
TYPES = {"str": "string", "int": "bigint", "float": "double", "money": "double", "date": "date", "datetime": "timestamp_ntz", "phone": "string", "email": "string", "url": "string", "list": "array<string>"}


def register_cleaner(name: str, cleaner: Callable[[Column, Column], Column], spark_type: str) -> None:
    """A field type of one's own."""
    CLEANERS[name] = cleaner
    TYPES[name] = spark_type


def is_empty(c: Column, kind: str) -> Column:
    """null, '' and [] are empty; 0 and false are not."""
    if kind == "list" or kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    if TYPES.get(kind, kind) == "string":
        return c.isNull() | (c == "")
    return c.isNull()


def clean(values: Column, kind: str, now: Column, many: bool = False) -> Column:
    """values (array<string>: all that a selector found) as a field: of a list type, or with many, each value by itself, else the first."""
    if kind == "list":
        return F.transform(values, clean_str)
    if many:
        return F.transform(values, lambda v: CLEANERS[kind](v, now))
    return CLEANERS[kind](F.get(values, F.lit(0)), now)


def moment(now: dt.datetime) -> Column:
    """now as a literal without time zone."""
    return F.lit(now.isoformat(" ")).cast("timestamp_ntz")
