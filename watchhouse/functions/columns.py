"""Small Column helpers shared by all jobs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import fixed_values as fv

_WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(c, F.lit(_WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def group_of(c: Column, pattern: str, group: int) -> Column:
    """Regex group, or NULL when the pattern or the group did not match."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def lookup(table: Mapping, key: Column) -> Column:
    """Value of a literal table at ``key``; NULL when absent."""
    pairs: list[Column] = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), key)


def text_array(values: Iterable[str] = ()) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def digits_to_int(c: Column) -> Column:
    """Integer when the text consists of digits only, else NULL."""
    return F.when(c.rlike(r"^\d+\z"), c.try_cast("int"))


def null_text() -> Column:
    return F.lit(None).cast("string")


# --- syslog pieces -------------------------------------------------------------------------


def priority(raw: Column) -> Column:
    """The number of a leading ``<N>``, else NULL."""
    return F.regexp_extract(raw, fv.PRIORITY, 1).try_cast("bigint")


def level_of_priority(number: Column) -> Column:
    return lookup(fv.SYSLOG_LEVELS, number.bitwiseAND(F.lit(7)).cast("int"))


# marks put around a pair while a line is rewritten; lines that contain one take the plain path
_IS, _END = "\x02", "\x03"


def with_key_values(df: DataFrame, name: str, text: Column, applies: Column) -> DataFrame:
    """Add a map of all ``key=value`` and ``key="quoted value"`` pairs; the last duplicate wins.

    One regular-expression pass rewrites the line to framed pairs, one split makes the map.  Both are
    compiled code, several times faster than building the map with lambda functions.
    """
    framed, kept = F.col("_kv_framed"), F.col("_kv_kept")
    df = df.withColumn("_kv_framed", F.when(
        applies, F.regexp_replace(text, f"(?s).*?{fv.KEY_VALUE}", f"$1{_IS}$2$3{_END}")))
    # what follows the last pair is not part of it
    df = df.withColumn("_kv_kept", F.length(framed) - F.length(F.substring_index(framed, _END, -1)) - 1)
    pairs = F.str_to_map(F.substr(framed, F.lit(1), kept), F.lit(_END), F.lit(_IS))
    marked = text.rlike(f"[{_IS}{_END}]")
    return df.withColumn(
        name,
        F.when(applies & marked, _key_values_by_token(text)).when(kept > 0, pairs).when(applies, empty_map()),
    ).drop("_kv_framed", "_kv_kept")


def _key_values_by_token(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(fv.KEY_VALUE), F.lit(0))

    def pair(token: Column) -> Column:
        key = F.substring_index(token, "=", 1)
        value = F.substr(token, F.length(key) + 2)
        quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
        return F.struct(
            key.alias("key"),
            F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"),
        )

    return F.map_from_entries(F.transform(tokens, pair))


# --- times -----------------------------------------------------------------------------------


def parse_time(text: Column, formats: Iterable[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def iso_time(text: Column) -> Column:
    return parse_time(text, fv.ISO_FORMATS)


def epoch_seconds_time(seconds: Column) -> Column:
    """Timestamp of whole seconds; NULL outside the years 1..9999."""
    ok = seconds.between(fv.MIN_EPOCH_SECONDS, fv.MAX_EPOCH_SECONDS)
    return F.when(ok, F.timestamp_seconds(seconds))


def epoch_micros_time(text: Column) -> Column:
    """Timestamp of a microsecond count given as text; NULL when bad or out of range."""
    micros = text.try_cast("bigint")
    ok = micros.between(fv.MIN_EPOCH_SECONDS * 1_000_000, fv.MAX_EPOCH_SECONDS * 1_000_000)
    return F.when(ok, F.timestamp_micros(micros))


def year_less_time(text: Column, received_at: Column) -> Column:
    """``Mmm d hh:mm:ss`` in the year of receipt; 29 February is not a valid date there."""
    clean = F.regexp_replace(text, r"\s+", " ")
    full = F.concat_ws(" ", F.year(received_at).cast("string"), clean)
    leap_day = F.lower(clean).rlike(r"^feb 0?29 ")
    return F.when(~leap_day, F.try_to_timestamp(full, F.lit(fv.BSD_TIME_FORMAT)))


def seconds_before(as_of, seconds: int) -> Column:
    """``as_of - seconds`` as a foldable Column, so the bound reaches the scan."""
    return as_timestamp(as_of) - F.expr(f"INTERVAL '{int(seconds)}' SECOND")


def as_timestamp(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


# --- addresses ---------------------------------------------------------------------------------


def ipv4_number(ip: Column) -> Column:
    """Dotted IPv4 as an integer 0..2^32-1, NULL for anything else."""
    parts = F.split(ip, r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!\z)|\z)){4}\z"), number)


# groups of an IPv6 address in lower case, at most one gap
_V6 = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"
_MAPPED = "0" * 20 + "ffff"  # an IPv4 address written as an IPv6 one


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used; keeps long expressions small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def address_hex(ip: Column) -> Column:
    """An address of either family as text: ``4`` and 8, or ``6`` and 32 hexadecimal digits; NULL for anything else.

    A prefix of 4k bits is thus a prefix of k + 1 characters.  IPv4 addresses mapped into IPv6 are IPv4; zones are dropped.
    """
    four = lambda number: F.lpad(F.lower(F.hex(number)), 8, "0")
    parts = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")

    def dotted(text: Column) -> Column:
        """A dotted end written as the last two groups."""
        tail = four(ipv4_number(F.regexp_extract(text, r"^.*:([0-9.]+)$", 1)))
        return let(tail, lambda t: F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), F.substr(t, F.lit(1), F.lit(4)), F.lit(":"), F.substr(t, F.lit(5), F.lit(4))))

    def six(groups: Column) -> Column:
        gap = groups.contains("::")
        left = parts(F.when(gap, F.substring_index(groups, "::", 1)).otherwise(groups))
        right = F.when(gap, parts(F.substring_index(groups, "::", -1))).otherwise(F.array().cast("array<string>"))

        def filled(sides: Column) -> Column:
            count = F.size(sides["left"]) + F.size(sides["right"])
            fits = groups.rlike(_V6) & F.when(gap, count <= 7).otherwise(count == 8)
            zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - count, F.lit(0)))
            return F.when(fits, F.array_join(F.transform(F.concat(sides["left"], zeros, sides["right"]), lambda g: F.lpad(g, 4, "0")), ""))

        digits = let(F.struct(left.alias("left"), right.alias("right")), filled)
        return let(digits, lambda d: F.when(d.startswith(_MAPPED), F.concat(F.lit("4"), F.substr(d, F.lit(25)))).otherwise(F.concat(F.lit("6"), d)))

    text = F.lower(F.regexp_replace(ip, "%.*$", ""))
    long = let(text, lambda t: let(F.when(t.contains("."), dotted(t)).otherwise(t), six))
    # addresses without a colon never reach the longer form
    return F.when(ip.contains(":"), long).otherwise(F.concat(F.lit("4"), four(ipv4_number(ip))))
