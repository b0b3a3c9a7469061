"""HIPAA / PCI DSS report figures over an inclusive period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.functions import fixed_values as fv

FRAMEWORKS = tuple(fv.RETENTION_YEARS)
DEFAULT_PERIOD_DAYS = 30
GAP_HOURS = 24


def _check(framework: str) -> None:
    if framework not in FRAMEWORKS:
        raise ValueError(f"framework must be one of {FRAMEWORKS}")


def _in_period(time_from, time_to) -> Column:
    return F.col("received_at").between(c.as_timestamp(time_from), c.as_timestamp(time_to))


def failed_login() -> Column:
    return (F.col("event_id") == "4625") | (F.col("action") == "logon_failed")


def privilege_escalation() -> Column:
    return (F.col("event_id") == "4672") | (F.col("action") == "privileged_logon")


def audit_clear() -> Column:
    return F.col("event_id").isin(fv.WINDOWS_AUDIT_CLEARED, fv.FORTIGATE_AUDIT_CLEARED)


def totals(events: DataFrame, time_from, time_to) -> DataFrame:
    """All period counts in one pass."""
    return events.filter(_in_period(time_from, time_to)).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(failed_login()).alias("failed_logins"),
        F.count_if(privilege_escalation()).alias("privilege_escalations"),
        F.count_if(audit_clear()).alias("audit_log_clears"),
    )


def by_category(events: DataFrame, time_from, time_to) -> DataFrame:
    rows = events.filter(_in_period(time_from, time_to) & F.col("category").isNotNull())
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def _gap_hours(last_seen: Column, as_of) -> Column:
    micros = F.unix_micros(c.as_timestamp(as_of)) - F.unix_micros(last_seen)
    return F.bround(micros / F.lit(3_600_000_000.0), 1)


def log_gaps(events: DataFrame, time_from, time_to, as_of) -> DataFrame:
    """Hosts whose last event of the period is more than a day before ``as_of``."""
    last = events.filter(_in_period(time_from, time_to)).groupBy("source_host").agg(
        F.max("received_at").alias("last_seen"))
    silent = last.filter(F.col("last_seen") < c.seconds_before(as_of, GAP_HOURS * 3600))
    return silent.withColumn("gap_hours", _gap_hours(F.col("last_seen"), as_of))


def retention_posture(events: DataFrame, framework: str, as_of) -> DataFrame:
    """Age of the oldest event of all against the years the framework asks for."""
    _check(framework)
    years = fv.RETENTION_YEARS[framework]
    oldest = oldest_event(events)
    return oldest.select(
        "oldest_event", F.lit(years).alias("required_retention_years"),
        F.lit(fv.HOT_STORAGE_MONTHS).alias("hot_storage_months"),
        F.coalesce(_age_years(F.col("oldest_event"), as_of) >= years, F.lit(False)).alias("compliant"),
    )


def oldest_event(events: DataFrame) -> DataFrame:
    """Time of the oldest event.  On the month-partitioned table only the first month is read."""
    if "event_month" in events.columns:
        first = events.agg(F.min("event_month")).scalar()
        events = events.filter(F.col("event_month") == first)
    return events.agg(F.min("received_at").alias("oldest_event"))


def _age_years(moment: Column, as_of) -> Column:
    micros = F.unix_micros(c.as_timestamp(as_of)) - F.unix_micros(moment)
    return F.floor(micros / F.lit(86_400_000_000.0)) / F.lit(365.25)


def cardholder_events(events: DataFrame, time_from, time_to) -> DataFrame:
    tagged = events.filter(_in_period(time_from, time_to) & F.array_contains("tags", "pci_dss"))
    return tagged.agg(F.count(F.lit(1)).alias("cardholder_env_events"))


def calendar_dates(time_from, time_to) -> Column:
    """Array of the dates from + i days, i up to the whole days of the span.

    The date of a last, broken day is not included.
    """
    start, end = c.as_timestamp(time_from), c.as_timestamp(time_to)
    days = F.call_function("div", F.unix_micros(end) - F.unix_micros(start), F.lit(86_400_000_000).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), days.cast("int")), lambda i: F.date_add(start.cast("date"), i))


def calendar(spark, time_from, time_to) -> DataFrame:
    return spark.range(1).select(F.explode(calendar_dates(time_from, time_to)).alias("day"))


def daily_gaps(events: DataFrame, time_from, time_to) -> DataFrame:
    """Calendar days without any event."""
    active = events.filter(_in_period(time_from, time_to)).select(
        F.col("received_at").cast("date").alias("day")).distinct()
    return calendar(events.sparkSession, time_from, time_to).join(active, "day", "left_anti").orderBy("day")


def report(events: DataFrame, framework: str, time_from, time_to, as_of) -> DataFrame:
    """The whole report as rows (section, item, value) from one scan of the period.

    The period's events are reduced to one row per (host, category, day); every section but the
    retention posture, which looks at the oldest event of all, is an aggregate of that table.  Values
    are text so that counts, hours, times and flags fit one column.
    """
    _check(framework)
    pci = framework == "pci_dss"
    tagged = F.coalesce(F.array_contains("tags", "pci_dss"), F.lit(False)) if pci else F.lit(False)
    day = F.col("received_at").cast("date").alias("day")
    cube = events.filter(_in_period(time_from, time_to)).groupBy("source_host", "category", day).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(failed_login()).alias("failed"),
        F.count_if(privilege_escalation()).alias("privileged"), F.count_if(audit_clear()).alias("clears"),
        F.count_if(tagged).alias("card"), F.max("received_at").alias("last"),
    )
    keys = {"all": F.lit(""), "category": F.col("category"), "host": F.col("source_host")}
    if pci:
        keys["day"] = F.col("day").cast("string")
    cells = [F.struct(F.lit(name).alias("section"), key.alias("item")) for name, key in keys.items()]
    sums = ("total", "failed", "privileged", "clears", "card")
    parts = cube.select(*sums, "last", F.inline(F.array(*cells))).filter("item IS NOT NULL")
    if pci:
        # every calendar day takes part with no events, so silent days show up as zero
        silent = calendar(events.sparkSession, time_from, time_to).select(
            *[F.lit(0).cast("bigint").alias(n) for n in sums], F.lit(None).cast("timestamp").alias("last"),
            F.lit("day").alias("section"), F.col("day").cast("string").alias("item"))
        parts = parts.unionByName(silent)
    rolled = parts.groupBy("section", "item").agg(*[F.sum(n).alias(n) for n in sums], F.max("last").alias("last"))
    text = lambda col: col.cast("string")

    def row(condition: Column, section: str, item: Column, value: Column) -> Column:
        return F.when(condition, F.struct(F.lit(section).alias("section"), item.alias("item"), text(value).alias("value")))

    whole, blank = F.col("section") == "all", F.lit("")
    rows = [
        row(whole, "total_events", blank, F.col("total")),
        row(whole, "failed_logins", blank, F.col("failed")),
        row(whole, "privilege_escalations", blank, F.col("privileged")),
        row(whole, "audit_log_clears", blank, F.col("clears")),
        row(F.col("section") == "category", "category", F.col("item"), F.col("total")),
        row((F.col("section") == "host") & (F.col("last") < c.seconds_before(as_of, GAP_HOURS * 3600)),
            "log_gap", F.col("item"), _gap_hours(F.col("last"), as_of)),
    ]
    if pci:
        rows += [row(whole, "cardholder_env_events", blank, F.col("card")),
                 row((F.col("section") == "day") & (F.col("total") == 0), "daily_review_gap", F.col("item"), blank)]
    counted = rolled.select(F.inline(F.array_compact(F.array(*rows))))
    return counted.unionByName(_retention_rows(events, framework, as_of))


def _retention_rows(events: DataFrame, framework: str, as_of) -> DataFrame:
    names = ("oldest_event", "required_retention_years", "hot_storage_months", "compliant")
    cells = [F.struct(F.lit(n).alias("section"), F.lit("").alias("item"), F.col(n).cast("string").alias("value"))
             for n in names]
    return retention_posture(events, framework, as_of).select(F.inline(F.array(*cells)))
