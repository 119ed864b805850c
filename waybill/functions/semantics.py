"""Scalar rules that every operator shares, decided once.

Values keep the meaning they have in delivery records: dates are ISO strings compared as strings, an empty string or a
zero counts as missing where a record says so, numbers round half up, and "first" always means by an explicit ordinal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that trimming removes, beyond what Java's trim knows (fixed values).
WS = r"[\s   -     　﻿]"
#: The same, character by character.
WS_CHARS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
KST_HOURS = 9


def lit_str(x: str | None) -> Column:
    return F.lit(x).cast("string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def constant_table(buckets: Sequence[Sequence[tuple[str, int]]], key: Column) -> Column:
    """Number of a text in a table of constants, 0 where it isn't there. The bucket of a text is its CRC-32 modulo their
    number, so a lookup doesn't depend on the size of the table."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("array(" + ", ".join(f"named_struct('n', {quoted(n)}, 'v', {v})" for n, v in bucket) + ")" for bucket in buckets)
    table = F.expr(f"array({rows})").cast("array<array<struct<n:string,v:int>>>")
    entry = F.filter(F.get(table, (F.crc32(key.cast("binary")) % len(buckets)).cast("int")), lambda e: e["n"] == key)
    return F.coalesce(F.get(entry, 0)["v"], F.lit(0))


def round_half_up(x: Column, places: int = 0) -> Column:
    """Half goes towards plus infinity, also below zero."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def trim_all(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def squeeze(x: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return trim_all(F.regexp_replace(x, f"{WS}+", " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(trim_all(x), F.lit(""))


def first_truthy(*xs: Column) -> Column:
    """First string that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def is_service_date(x: Column) -> Column:
    """A real calendar date written YYYY-MM-DD; false for null."""
    return F.coalesce(x.rlike(ISO_DATE) & F.try_to_date(x, "yyyy-MM-dd").isNotNull(), F.lit(False))


def instant(x: Column) -> Column:
    """Timestamp of an ISO string, null where it can't be read."""
    return F.try_to_timestamp(F.nullif(x, F.lit("")))


def iso_week_key(captured: Column) -> Column:
    """ISO week of the wall clock at UTC+9, as 2026-W24; unknown for what is no instant."""
    kst = captured + F.expr(f"INTERVAL {KST_HOURS} HOURS")
    return F.coalesce(F.concat(F.extract(F.lit("YEAROFWEEK"), kst).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(kst).cast("string"), 2, "0")), F.lit("unknown"))


def week_range_label(captured: Column) -> Column:
    """Monday to Sunday of that week, as 2026.06.08 ~ 06.14."""
    monday = F.date_trunc("week", captured + F.expr(f"INTERVAL {KST_HOURS} HOURS"))
    return F.coalesce(F.concat(F.date_format(monday, "yyyy.MM.dd"), F.lit(" ~ "), F.date_format(monday + F.expr("INTERVAL 6 DAYS"), "MM.dd")), F.lit("날짜 미상"))


def won(x: Column, short: bool = False) -> Column:
    """Amount as text with separators; short: from ten thousand on in that unit, to one place."""
    if not short:
        return F.concat(F.format_number(round_half_up(x), 0), F.lit("원"))
    size = F.abs(x)
    units = F.regexp_replace((round_half_up(size / 1000.0) / 10.0).cast("string"), r"\.0$", "")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(size >= 10_000, F.concat(units, F.lit("만"))).otherwise(F.format_number(round_half_up(size), 0)))


def csv_cell(x: Column) -> Column:
    """Quoted where a comma, quote or line end stands in it."""
    text = x.cast("string")
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def code_unit_sum(text: Column) -> Column:
    """Sum of the code points of a text of the basic plane."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c))


def pseudo_geocode(address: Column) -> tuple[Column, Column]:
    """Stable stand-in coordinates of an address: (latitude, longitude)."""
    seed = code_unit_sum(address)
    return F.lit(37.48) + (seed % 45) / 1000.0, F.lit(127.01) + (seed % 70) / 1000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def add_minutes(time: Column, minutes: int) -> Column:
    """HH:MM moved within the day."""
    total = F.split_part(time, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(time, F.lit(":"), F.lit(2)).cast("int") + minutes
    return F.format_string("%02d:%02d", F.pmod(F.floor(total / 60).cast("int"), F.lit(24)), F.pmod(total, F.lit(60)))


def time_of(value: Column) -> Column:
    """What follows the first space, or all of it."""
    return first_truthy(F.split_part(value, F.lit(" "), F.lit(2)), value)


def _normalized(form: str) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run


def composed(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form. Spark has none, so texts beyond ASCII go through Python; an ASCII text is its own normal form
    and stays in the JVM. A column of a table, not of a lambda: normalise where texts come in."""
    plain = F.coalesce(text.rlike(r"\A\p{ASCII}*\z"), F.lit(False))
    return F.coalesce(F.when(plain, text), _normalized(form)(F.when(~plain, text)))
