"""Enrichment: compliance tags, geolocation, row projections."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.functions import fixed_values as fv
from watchhouse.schema import EVENT_SUMMARY_COLUMNS, EVENTS

# address ranges are cut at blocks of 2^16 and 2^8 addresses to get equality join keys
_WIDE_BITS, _NARROW_BITS = 16, 8


def compliance_tags(tags: Column, category: Column, event_id: Column, is_pci_env: Column) -> Column:
    """Existing tags plus every tag the event earns, distinct and sorted."""
    tags = F.coalesce(tags, c.text_array())
    forti_clear = event_id == fv.FORTIGATE_AUDIT_CLEARED
    integrity = F.coalesce(
        (event_id == fv.WINDOWS_AUDIT_CLEARED) | forti_clear | F.array_contains(tags, "hipaa:integrity"), F.lit(False)
    ) | F.array_contains(tags, "hipaa:integrity")
    earned = F.array(
        F.when(category == "auth", "hipaa:auth"),
        F.when(event_id.isin(*fv.HIPAA_SESSION_EVENT_IDS), "hipaa:session"),
        F.when(integrity, "hipaa:integrity"),
        F.when(integrity | is_pci_env, "pci_dss"),
        F.when(is_pci_env, "pci:cardholder_env"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(tags, earned))))


def add_compliance_tags(events: DataFrame) -> DataFrame:
    """Tag events; ``is_pci_env`` (from the source lookup) is optional."""
    pci = F.coalesce(F.col("is_pci_env"), F.lit(False)) if "is_pci_env" in events.columns else F.lit(False)
    return events.withColumn(
        "tags", compliance_tags(F.col("tags"), F.col("category"), F.col("event_id"), pci)
    )


def pci_flag(events: DataFrame, sources: DataFrame, ip_column: str = "src_ip") -> DataFrame:
    """Add ``is_pci_env``: the sender is a registered, enabled source of the cardholder environment."""
    pci = sources.filter("enabled AND pci_env").select(F.col("ip_address").alias(ip_column), F.lit(True).alias("_pci"))
    return events.join(pci, ip_column, "left").withColumn(
        "is_pci_env", F.coalesce(F.col("_pci"), F.lit(False))
    ).drop("_pci")


def _blocks(number: Column, bits: int) -> Column:
    return F.shiftright(number, bits)


def _geo_pieces(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ranges into whole wide blocks and narrow-block pieces.

    Wide: one row per 2^16 block lying entirely in a range.  Narrow: what is left at the ends of a
    range, one row per 2^8 block it touches, with its bounds; at most 256 rows share a block.
    """
    lo, hi = F.col("start_ip"), F.col("end_ip")
    size = 1 << _WIDE_BITS
    first, last = _blocks(lo + (size - 1), _WIDE_BITS), _blocks(hi + 1, _WIDE_BITS) - 1
    whole = first <= last

    def piece(a: Column, b: Column) -> Column:
        return F.struct(a.cast("bigint").alias("lo"), b.cast("bigint").alias("hi"))

    place = (F.col("country").alias("_country"), F.col("city").alias("_city"))
    wide = ranges.filter(whole).select(*place, F.explode(F.sequence(first, last)).alias("_wide"))
    ends = F.array(piece(lo, F.when(whole, first * size - 1).otherwise(hi)), piece(F.when(whole, (last + 1) * size), hi))
    rest = ranges.select(*place, F.inline(F.filter(ends, lambda p: p["lo"] <= p["hi"])))
    narrow = rest.select(
        "_country", "_city", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
        F.explode(F.sequence(_blocks(F.col("lo"), _NARROW_BITS), _blocks(F.col("hi"), _NARROW_BITS))).alias("_narrow"),
    )
    return wide, narrow


def add_geoip(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Fill ``geo_country`` / ``geo_city`` from non-overlapping address ranges.

    ``ranges(start_ip, end_ip, country, city)`` with integer bounds.  The range condition becomes two
    equality joins on address blocks, so an event meets at most 256 ranges however large the table
    is.  Rows already located keep their values, misses stay NULL.
    """
    wide, narrow = _geo_pieces(ranges)
    ip = F.when(F.col("geo_country").isNull(), c.ipv4_number(F.col("src_ip")))
    # rows without an address get keys below zero, which no block has: a shuffled join deals them out instead of gathering NULLs
    nowhere = -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    located = events.withColumn("_ip", ip).withColumns({
        "_n": F.coalesce(_blocks(F.col("_ip"), _NARROW_BITS), nowhere), "_w": F.coalesce(_blocks(F.col("_ip"), _WIDE_BITS), nowhere)})
    inside = (F.col("_n") == F.col("_narrow")) & F.col("_ip").between(F.col("_lo"), F.col("_hi"))
    joined = located.join(narrow, inside, "left").join(
        wide.withColumnsRenamed({"_country": "_wide_country", "_city": "_wide_city"}), F.col("_w") == F.col("_wide"), "left")
    return joined.withColumns({
        "geo_country": F.coalesce("geo_country", "_country", "_wide_country"),
        "geo_city": F.coalesce("geo_city", "_city", "_wide_city"),
    }).select(*events.columns)


# --- networks of both address families ---------------------------------------------------------------


def networks_of_ranges(ranges: DataFrame) -> DataFrame:
    """(network, country, city) of address ranges ``(start_ip, end_ip, country, city)`` of either family, bounds as text or IPv4 numbers.

    A range is the least set of networks that fill it; ranges that are no ranges give none.
    """
    def cut(batches):
        from ipaddress import ip_address, summarize_address_range

        for batch in batches:
            out = {"network": [], "country": [], "city": []}
            for low, high, country, city in zip(*(batch.column(c).to_pylist() for c in ("start_ip", "end_ip", "country", "city"))):
                try:
                    ends = [ip_address(int(x) if str(x).isdigit() else x) for x in (low, high)]
                    networks = list(summarize_address_range(*ends))
                except (TypeError, ValueError):
                    continue
                for network in networks:
                    for name, value in (("network", str(network)), ("country", country), ("city", city)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({name: pa.array(values, pa.string()) for name, values in out.items()})

    bounds = ranges.select(F.col("start_ip").cast("string"), F.col("end_ip").cast("string"), "country", "city")
    return bounds.mapInArrow(cut, "network string, country string, city string")


def _network_keys(networks: DataFrame) -> DataFrame:
    """(key, length, country, city): networks under the hexadecimal prefixes they cover.

    A network whose length is no multiple of four covers two, four or eight prefixes of the next one.
    """
    parts = F.split("network", "/")
    addr = c.address_hex(F.get(parts, F.lit(0)))
    mapped = F.get(parts, F.lit(0)).contains(":") & addr.startswith("4")
    most = F.when(addr.startswith("4"), 32).otherwise(128)
    given = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), most)
    read = networks.select(addr.alias("addr"), F.when(mapped, given - 96).otherwise(given).alias("length"), most.alias("most"), "country", "city")
    read = read.where("addr IS NOT NULL AND length BETWEEN 0 AND most")
    digits = F.ceil(F.col("length") / 4).cast("int")
    free = digits * 4 - F.col("length")
    last = F.conv(F.substr("addr", digits + 1, F.lit(1)), 16, 10).cast("int")
    low = F.call_function("shiftleft", F.call_function("shiftright", last, free), free)
    stem = F.substr("addr", F.lit(1), digits)
    ends = F.transform(F.sequence(low, low + F.call_function("shiftleft", F.lit(1), free) - 1), lambda d: F.concat(stem, F.lower(F.hex(d))))
    keys = F.when(F.col("length") == 0, F.array(F.substr("addr", F.lit(1), F.lit(1)))).otherwise(ends)
    return read.select(F.explode(keys).alias("key"), "length", "country", "city")


def add_location(events: DataFrame, networks: DataFrame) -> DataFrame:
    """Fill ``geo_country`` / ``geo_city`` from ``networks(network, country, city)``, the longest one that holds ``src_ip``.

    Networks of both families may be nested.  Every distinct address is looked up once, under the prefix lengths that occur in the
    table (nine for IPv4 and 33 for IPv6 at most): equality joins, whatever the size of the networks.  Of one network given twice the
    greatest country and city count.  Rows already located keep their values, misses stay NULL.
    """
    keys = _network_keys(networks)
    present = keys.select(F.substr("key", F.lit(1), F.lit(1)).alias("family"), F.length("key").alias("n")).distinct().collect()
    sizes = {family: sorted(r.n for r in present if r.family == family) for family in "46"}
    prefixes = lambda family: F.array(*[F.substr("_addr", F.lit(1), F.lit(n)) for n in sizes[family]]).cast("array<string>")
    located = events.withColumn("_addr", F.when(F.col("geo_country").isNull(), c.address_hex(F.col("src_ip"))))
    asked = located.where("_addr IS NOT NULL").select("_addr").distinct()
    asked = asked.select("_addr", F.explode(F.when(F.col("_addr").startswith("4"), prefixes("4")).otherwise(prefixes("6"))).alias("key"))
    best = asked.join(keys, "key").groupBy("_addr").agg(F.max(F.struct("length", "country", "city")).alias("_net"))
    # rows without an address are dealt out instead of gathering in one task
    nowhere = F.concat(F.lit("-"), F.xxhash64("id").cast("string"))
    joined = located.withColumn("_addr", F.coalesce("_addr", nowhere)).join(best, "_addr", "left")
    return joined.withColumns({
        "geo_country": F.coalesce("geo_country", "_net.country"), "geo_city": F.coalesce("geo_city", "_net.city"),
    }).select(*events.columns)


# --- projections ---------------------------------------------------------------------------------


def event_rows(events: DataFrame) -> DataFrame:
    """The stored row: 25 columns, ``extra`` as JSON text."""
    extra = F.to_json(F.coalesce(F.col("extra"), c.empty_map())).alias("extra")
    return events.select(*[extra if n == "extra" else F.col(n) for n in EVENTS.fieldNames()])


def event_summaries(events: DataFrame) -> DataFrame:
    """The 17 columns of a search result; missing tags read as none."""
    return events.select(*EVENT_SUMMARY_COLUMNS).withColumn("tags", F.coalesce("tags", c.text_array()))


def event_details(events: DataFrame) -> DataFrame:
    """All 25 columns; missing tags and extra read as empty."""
    return events.select(*EVENTS.fieldNames()).withColumns({
        "tags": F.coalesce("tags", c.text_array()), "extra": F.coalesce("extra", c.empty_map()),
    })
