"""Raw lines -> event rows: source lookup, dispatch by format, one pass over the input.

Input columns: ``raw``, ``source_ip``, ``received_at`` (plus an optional ``record_id`` that makes
event ids unique when one source repeats a line within one instant).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.functions import fixed_values as fv
from watchhouse.operators import (
    normalize_cisco,
    normalize_fortigate,
    normalize_linux,
    normalize_windows,
)
from watchhouse.schema import ERRORS, EVENTS

FORMATS = {
    "fortigate": normalize_fortigate,
    "cisco_asa": normalize_cisco,
    "windows": normalize_windows,
    "linux": normalize_linux,
}


def autodetect(raw: Column) -> Column:
    """Source type by content; generic text counts as linux."""
    return (
        F.when(raw.rlike(fv.DETECT_FORTIGATE), "fortigate")
        .when(raw.rlike(fv.DETECT_CISCO), "cisco_asa")
        .when(raw.rlike(fv.DETECT_WINDOWS), "windows")
        .otherwise("linux")
    )


def resolve_sources(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach the registered type, label and PCI flag; detect the type of unregistered senders.

    Adds ``line_type``, ``label``, ``is_pci_env`` and ``registered``.  The registry side is left
    to the optimizer: broadcast while small, shuffled (with skew splitting) beyond that.
    """
    registry = sources.filter("enabled").select(
        F.col("ip_address").alias("source_ip"),
        F.col("source_type").alias("_type"),
        F.coalesce(c.blank_to_null(F.col("label")), F.col("ip_address")).alias("_label"),
        F.coalesce(F.col("pci_env"), F.lit(False)).alias("_pci"),
    )
    return lines.join(registry, "source_ip", "left").select(
        *[F.col(n) for n in lines.columns],
        F.coalesce(F.col("_type"), autodetect(F.col("raw"))).alias("line_type"),
        F.coalesce(F.col("_label"), F.col("source_ip")).alias("label"),
        F.coalesce(F.col("_pci"), F.lit(False)).alias("is_pci_env"),
        F.col("_type").isNotNull().alias("registered"),
    )


def stamp_id() -> Column:
    """Deterministic event id, stable when a task is retried."""
    return F.sha2(F.concat_ws("|", "source_ip", F.col("received_at").cast("string"), "record_id", "raw"), 256)


def parse_lines(lines: DataFrame, ingest_node: str = "worker-01", formats: tuple[str, ...] = tuple(FORMATS),
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse lines whose ``line_type`` is known; types outside ``formats`` become problems.

    Returns the event columns, the input columns named in ``keep``, ``source_ip``, ``is_pci_env`` and ``problem`` (NULL for good rows).  All four
    formats are handled in the same pass; each stage column is NULL for lines of another format.
    """
    if "record_id" not in lines.columns:
        lines = lines.withColumn("record_id", c.null_text())
    if "is_pci_env" not in lines.columns:
        lines = lines.withColumn("is_pci_env", F.lit(False))
    kind = F.when(F.col("line_type") == "cisco_ios", "cisco_asa").otherwise(F.col("line_type"))
    df = lines.withColumn("_kind", kind)
    modules = {name: FORMATS[name] for name in formats}
    for name, module in modules.items():
        df = module.prepare(df, F.col("_kind") == name)

    parsed = {name: module.fields() for name, module in modules.items()}
    constant = {
        "id": stamp_id(),
        "received_at": F.col("received_at"),
        "raw_message": F.col("raw"),
        "raw_hash": F.sha2(F.col("raw"), 256),
        "ingest_node": F.lit(ingest_node),
    }

    def column(field) -> Column:
        if field.name in constant:
            return constant[field.name].alias(field.name)
        chain = None
        for name, exprs in parsed.items():
            if field.name in exprs:
                here = F.col("_kind") == name
                chain = (F if chain is None else chain).when(here, exprs[field.name])
        if chain is None:
            chain = F.lit(None)
        if field.name == "tags":
            chain = F.coalesce(chain, c.text_array())
        return chain.cast(field.dataType).alias(field.name)

    problem = F.when(~F.col("_kind").isin(*formats), "unknown source type")
    for name, module in modules.items():
        if hasattr(module, "problem"):
            problem = problem.when(F.col("_kind") == name, module.problem())
    return df.select(*[column(f) for f in EVENTS.fields], *keep, "source_ip", "is_pci_env", problem.alias("problem"))


def parse_as(lines: DataFrame, source_type: str, ingest_node: str = "worker-01", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse lines that all come from one source type."""
    formats = ("cisco_asa",) if source_type == "cisco_ios" else (source_type,)
    return parse_lines(lines.withColumn("line_type", F.lit(source_type)), ingest_node, formats, keep)


def normalize(lines: DataFrame, sources: DataFrame, ingest_node: str = "worker-01") -> DataFrame:
    """Source lookup and parsing of mixed lines, good and bad rows together."""
    return parse_lines(resolve_sources(lines, sources), ingest_node)


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem IS NULL").select(*EVENTS.fieldNames())


def bad_lines(parsed: DataFrame, error: str = "parse_error") -> DataFrame:
    """Dead letters: reason, sender and the whole line."""
    return parsed.filter("problem IS NOT NULL").select(
        F.lit(error).alias("error"),
        F.col("problem").alias("detail"),
        "source_ip",
        F.col("raw_message").alias("raw"),
        "received_at",
    ).select(*ERRORS.fieldNames())
