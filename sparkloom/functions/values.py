"""Scalars of raw posts: numbers, times, durations, keys, and equality across types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(x: Column) -> Column:
    """A double, or null for anything that is not written as a finite decimal number."""
    text = x.cast("string")
    return F.when(text.rlike(_NUMBER), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double"))


def coerce_int(x: Column) -> Column:
    """A whole number, also of '568.0'; the fraction is cut off; null, '' and other texts: null."""
    return number(x).try_cast("long")


def parse_epoch(x: Column) -> Column:
    """Seconds since 1970 as a UTC timestamp; null, '' and other texts: null."""
    seconds = coerce_int(x)
    return F.when(F.abs(seconds) <= 253402300799, F.timestamp_seconds(seconds))


def parse_count_text(x: Column) -> Column:
    """The first number of a text like '14.8K subscribers', times its suffix, cut to a whole number."""
    digits = F.regexp_extract(x, r"(?i)([\d.,]+)\s*([KMB]?)", 1)
    suffix = F.upper(F.regexp_extract(x, r"(?i)([\d.,]+)\s*([KMB]?)", 2))
    value = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    factor = F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "B", 1e9).otherwise(1.0)
    return F.when(digits != "", (value * factor).try_cast("long"))


def collected_at(time: Column, date: Column) -> Column:
    return parse_epoch(F.coalesce(F.nullif(time.cast("string"), F.lit("")), date.cast("string")))


def iso_timestamp(x: Column) -> Column:
    return F.try_to_timestamp(F.nullif(x, F.lit("")))


def parse_duration(x: Column) -> Column:
    """Seconds of 'HH:MM:SS' or 'MM:SS'; anything else: null. Parts are not checked against 60."""
    parts = F.transform(F.split(x, ":", -1), lambda p: p.try_cast("long"))
    whole = ~F.exists(parts, lambda p: p.isNull())
    three = F.get(parts, 0) * 3600 + F.get(parts, 1) * 60 + F.get(parts, 2)
    return F.when(whole & (F.size(parts) == 3), three).when(whole & (F.size(parts) == 2), F.get(parts, 0) * 60 + F.get(parts, 1))


def print_duration(seconds: Column) -> Column:
    """'0:01:03', with '1 day, ' or '2 days, ' before it from 24 hours on; null: ''."""
    days, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600).cast("long"), F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("long"), F.pmod(rest, F.lit(60)).cast("long"))
    day = F.when(days == 0, "").when(F.abs(days) == 1, F.concat(days.cast("string"), F.lit(" day, "))).otherwise(F.concat(days.cast("string"), F.lit(" days, ")))
    return F.when(seconds.isNull(), "").otherwise(F.concat(day, clock))


def not_future(d: Column, today: Column) -> Column:
    """The date, or null if it lies after ``today``."""
    return F.when(d <= today, d)


def date_or_text(d: Column, text: Column) -> Column:
    return F.coalesce(d.cast("date").cast("string"), text)


#: The digits of the slug's base 32, and its length. The form of slugs is a public contract.
DIGITS = "abcdefghijklmnopqrstuvwxyz234567"
SLUG_LENGTH = 10


def slug(platform: Column, post_id: Column) -> Column:
    """The public key of a post: ten base-32 digits, five bits each, from the SHA-256 of 'smp:platform:id'."""
    digest = F.sha2(F.concat(F.lit("smp:"), platform, F.lit(":"), post_id.cast("string")), 256)
    bits = F.shiftrightunsigned(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), 2)
    picks = [F.substr(F.lit(DIGITS), (F.shiftrightunsigned(bits, 5 * (SLUG_LENGTH - 1 - i)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(SLUG_LENGTH)]
    return F.concat(*picks)


def post_key(platform: Column, user_id: Column, post_id: Column) -> Column:
    """platform:user:post; a missing id is written 'None'."""
    return F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("None")) for x in (platform, user_id, post_id)])


def same(old: Column, new: Column, kind: str) -> Column:
    """Equality of a stored value of type ``kind`` and an incoming text, null-safe; a text that is no such value is unequal."""
    cast = F.lower(new) if kind == "uuid" else new.try_cast(kind)
    return F.when(new.isNotNull() & cast.isNull(), False).otherwise((F.lower(old) if kind == "uuid" else old).eqNullSafe(cast))


def falsy(x: Column, kind: str) -> Column:
    """Null, or the type's empty value."""
    if kind == "string":
        return x.isNull() | (x == "")
    if kind == "boolean":
        return x.isNull() | ~x
    if kind.startswith("array"):
        return x.isNull() | (F.size(x) == 0)
    if kind in ("date", "timestamp"):
        return x.isNull()
    return x.isNull() | (x == 0)


def first_only(values: Column) -> Column:
    """The first element of a list, null of an empty one."""
    return F.try_element_at(values, F.lit(1))


def merged_flag(a: Column, b: Column) -> Column:
    """True if either flag is, false if one is present, null if none is."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))


def clean_path(path: Column) -> Column:
    """Labels stripped, empty ones dropped, equal neighbours collapsed."""
    from sparkloom.functions.text import strip

    kept = F.filter(F.transform(path, strip), lambda x: x.isNotNull() & (x != ""))
    return F.filter(kept, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(kept, i - 1)))
