"""SCL1-SCL11: ids, percentages, dates, durations and deterministic draws as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column, size: int = 12) -> Column:
    """SCL1: the head of the SHA-1 of the parts joined by bars; null parts are skipped."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, size)


def pct(c: Column, n: Column) -> Column:
    """SCL3: whole percent, halves up; 0 of 0 is 0. Divides before it multiplies."""
    return F.when(n == 0, 0).otherwise(F.floor(c / n * 100 + 0.5)).cast("int")


def clamp(c: Column, low: float, high: float) -> Column:
    """SCL4."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def nice_max(c: Column) -> Column:
    """SCL4: the least of 1, 2, 5, 10 times a power of ten that is not below `c`; at least 5."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(c, F.lit(1)))))
    r = c / p
    return F.greatest(F.when(r <= 1, p).when(r <= 2, 2 * p).when(r <= 5, 5 * p).otherwise(10 * p), F.lit(5.0))


def start_of_day(ts: Column) -> Column:
    """SCL5: midnight of a moment's day."""
    return F.date_trunc("day", ts)


def day_key(ts: Column) -> Column:
    """SCL5: the day of a moment as YYYY-MM-DD."""
    return F.date_format(ts, "yyyy-MM-dd")


def days_between(a: Column, b: Column) -> Column:
    """SCL5: days from a to b, rounded to whole ones, halves up."""
    return F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400e6 + 0.5).cast("int")


def uid(ts: Column, key: Column, seed: str) -> Column:
    """SCL11: the milliseconds of a moment and a drawn number, both to the base 36. The draw follows seed and key, so that a task
    that runs again gives the same ids."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key.cast("string"))), 1, 8), 16, 36)
    return F.lower(F.concat(F.conv(F.unix_millis(ts.cast("timestamp")).cast("string"), 10, 36), drawn))


def rel_day(day: Column, today: Column) -> Column:
    """SCL6: overdue, today, tomorrow or 'in n'."""
    n = F.datediff(day, today)
    return F.when(n < 0, "overdue").when(n == 0, "today").when(n == 1, "tomorrow").otherwise(F.concat(F.lit("in "), n.cast("string")))


def duration(secs: Column) -> Column:
    """SCL6: m:ss, or h:mm:ss from an hour on."""
    s = F.floor(secs + 0.5).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def monday_of(day: Column, following: bool = False) -> Column:
    """SCL7: the Monday of the week of `day`, or the one after."""
    m = F.next_day(F.date_sub(day, 7), "MO")
    return F.date_add(m, 7) if following else m


def exam_label(name: Column) -> Column:
    """SCL8: YYYY/MM of a name that holds a year and a month, else null."""
    pattern = r"(\d{4})年(\d+)月"
    y = F.regexp_extract(name, pattern, 1)
    return F.when(y != "", F.concat(y, F.lit("/"), F.lpad(F.regexp_extract(name, pattern, 2), 2, "0")))


def official(name: Column, official_source: Column) -> Column:
    """SCL9: the name has a year and month, or its source is official."""
    return F.coalesce(name.rlike(r"\d{4}年\d+月"), F.lit(False)) | F.coalesce(official_source, F.lit(False))


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only: the first 8 hex digits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def shuffled(options: Column, key: Column) -> Column:
    """SCL10: options in an order drawn from the key and each option's place."""
    items = F.transform(options, lambda x, i: F.struct(F.md5(F.concat(key.cast("string"), F.lit("|"), i.cast("string"))).alias("h"), i.alias("i"), x.alias("x")))
    return F.array_sort(items)


def new_answer(order: Column, answer: Column) -> Column:
    """SCL10: the place of the right option in the drawn order."""
    return (F.array_position(F.transform(order, lambda s: s["i"]), answer) - 1).cast("int")
