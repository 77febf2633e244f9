"""Scalar expressions that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators U+001C to U+001F, which Python strips too.
SPACE = r"[\s\x1c-\x1f]"
#: 1e-12 USD in the unit that costs are rounded to (1e-4 USD).
COST_UNIT = 100_000_000


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(strip(text), rf"(?U){SPACE}+", " ")


def blank_to(text: Column, *others: Column) -> Column:
    """First that is neither null nor '', else ''."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (text, *others)], F.lit(""))


def as_date(text: Column) -> Column:
    """yyyy-MM-dd text as a date, null for anything else."""
    return F.try_to_date(text, "yyyy-MM-dd")


def week_label(date: Column) -> Column:
    """'%Y-W%W': weeks start on Monday and never span a year; days before the first Monday are week 00."""
    week = ((F.dayofyear(date) + 6 - F.weekday(date)) / 7).cast("int")
    return F.concat(F.date_format(date, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def hour_bucket(ts_iso: Column) -> Column:
    """'yyyy-MM-dd HH:00' of an ISO text in UTC, null for anything that isn't one."""
    day = F.substring(ts_iso, 1, 10)
    return F.when(ts_iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:") & as_date(day).isNotNull(), F.concat(day, F.lit(" "), F.substring(ts_iso, 12, 2), F.lit(":00")))


def epoch_text(seconds: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' in UTC, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    part = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), part(F.floor(rest / 3600)), F.lit(":"), part(F.floor(rest % 3600 / 60)), F.lit(":"), part(rest % 60))


def minute_text(millis: Column) -> Column:
    """'yyyy-MM-dd HH:mm' in UTC, '?' for 0 and null."""
    return F.when(F.coalesce(millis, F.lit(0)) == 0, F.lit("?")).otherwise(F.substring(epoch_text(F.floor(millis / 1000)), 1, 16))


def ntz_epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, read as UTC."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


#: ISO 8601 with date, time of day, and perhaps a fraction and a zone: what the JVM reads itself.
ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:(Z)|([+-])(\d{2}):?(\d{2}))?$"


def clock(text: Column) -> tuple[Column, Column]:
    """Whole seconds since 1970 and microseconds after them of an ISO 8601 text in the form of ISO, null for any other.
    Without a zone it is UTC."""
    number = lambda x: F.coalesce(F.nullif(x, F.lit("")).try_cast("long"), F.lit(0))
    day, hour, minute = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), number(F.substring(text, 12, 2)), number(F.substring(text, 15, 2))
    second = F.when(F.substring(text, 17, 1) == ":", number(F.substring(text, 18, 2))).otherwise(0)
    east = F.regexp_replace(F.regexp_extract(text, r"[+-]\d{2}:?\d{2}$", 0), ":", "")
    zone_hour, zone_minute = number(F.substring(east, 2, 2)), number(F.substring(east, 4, 2))
    fits = text.rlike(ISO) & day.isNotNull() & (hour < 24) & (minute < 60) & (second < 60) & (zone_hour < 24) & (zone_minute < 60) & (F.year(day) > 0)
    seconds = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + hour * 3600 + minute * 60 + second
    zone = (zone_hour * 3600 + zone_minute * 60) * F.when(east.startswith("-"), -1).otherwise(1)
    digits = F.when(F.substring(text, 20, 1).isin(".", ","), F.regexp_extract(F.substring(text, 21, 9), r"^\d+", 0)).otherwise("")
    fraction = number(F.rpad(F.substring(digits, 1, 6), 6, "0"))
    return F.when(fits, seconds - zone), F.when(fits, fraction)


def instant(text: Column, whole: Column | None = None, rest: Column | None = None) -> dict[str, Column]:
    """ts_iso, ts_epoch, date, month and hour of a text, in UTC; a text that is no time stays as it is, without the others.
    whole, rest: what `clock` says of the text, if it is a column already."""
    if whole is None:
        whole, rest = clock(text)
    shown = F.translate(epoch_text(whole), " ", "T")
    iso = F.concat(shown, F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))
    return {
        "ts_iso": F.coalesce(iso, text, F.lit("")), "ts_epoch": F.when((whole < 0) & (rest > 0), whole + 1).otherwise(whole), "date": F.coalesce(F.substring(shown, 1, 10), F.lit("")),
        "month": F.coalesce(F.substring(shown, 1, 7), F.lit("")), "hour": F.floor(F.pmod(whole, F.lit(86400)) / 3600).cast("int"),
    }


def rounded_cost(units: Column) -> Column:
    """Sum of 1e-12 USD as USD to four places, half away from zero, in integers up to the last step."""
    half = F.when(units < 0, -COST_UNIT // 2).otherwise(COST_UNIT // 2)
    whole = (units + half - F.pmod(units + half, F.lit(COST_UNIT)) + F.when((units + half < 0) & (F.pmod(units + half, F.lit(COST_UNIT)) != 0), COST_UNIT).otherwise(0)) / COST_UNIT
    return (F.round(whole).cast("long").cast("double")) / F.lit(10000.0)


def owner_session(rel: Column) -> Column:
    """Session that a transcript's path belongs to: the folder above subagents/, else the file's stem."""
    return F.when(rel.contains("/subagents/"), F.regexp_extract(rel, r"([^/]+)/subagents/", 1)).otherwise(F.regexp_extract(rel, r"([^/]+)\.jsonl$", 1))
