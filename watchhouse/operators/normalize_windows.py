"""Windows event-log JSON objects -> event fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.functions import fixed_values as fv

DOC, DATA, ID, INFO = "_wi_doc", "_wi_data", "_wi_id", "_wi_info"
_MAP = "map<string,string>"


def prepare(df: DataFrame, applies: Column) -> DataFrame:
    doc = F.col(DOC)
    df = df.withColumn(DOC, F.when(applies, F.from_json("raw", _MAP)))
    data = F.when(_has("EventData"), F.from_json(_top("EventData"), _MAP)).otherwise(c.empty_map())
    df = df.withColumns({
        DATA: F.when(doc.isNotNull(), data),
        ID: F.when(doc.isNotNull(), F.when(_has("EventID"), _top("EventID").try_cast("int")).otherwise(0)),
    })
    pairs: list[Column] = []
    for event_id, info in fv.WINDOWS_EVENTS.items():
        parts = [F.lit(x).cast("string").alias(n) for x, n in zip(info, ("category", "action", "template"))]
        pairs += [F.lit(event_id), F.struct(*parts)]
    return df.withColumn(INFO, F.try_element_at(F.create_map(*pairs), F.col(ID)))


def _top(name: str) -> Column:
    return F.try_element_at(F.col(DOC), F.lit(name))


def _has(name: str) -> Column:
    return F.map_contains_key(F.col(DOC), F.lit(name))


def _data(name: str) -> Column:
    return c.blank_to_null(F.try_element_at(F.col(DATA), F.lit(name)))


def problem() -> Column:
    """Why a document cannot become an event; NULL when it can."""
    bad_level = _has("Level") & _top("Level").try_cast("int").isNull()
    return (
        F.when(F.col(DOC).isNull(), "not a JSON object")
        .when(F.col(ID).isNull(), "EventID is not a number")
        .when(bad_level, "Level is not a number")
        .when(F.col(DATA).isNull(), "EventData is not an object")
        .when(_has("Computer") & _top("Computer").isNull(), "Computer is null")
    )


def fill_template(template: Column, values: Column) -> Column:
    """Replace every ``%KEY%``; empty values show as ``-``; stray ``%`` are removed."""
    filled = F.aggregate(
        F.map_entries(values),
        template,
        lambda text, e: F.replace(
            text,
            F.concat(F.lit("%"), e["key"], F.lit("%")),
            F.coalesce(c.blank_to_null(e["value"]), F.lit("-")),
        ),
    )
    return c.strip(F.replace(filled, F.lit("%"), F.lit("")))


def fields() -> dict[str, Column]:
    event_id, info, data = F.col(ID), F.col(INFO), F.col(DATA)
    channel = F.coalesce(_top("Channel"), F.lit(""))
    level = F.when(_has("Level"), _top("Level").try_cast("int")).otherwise(4)
    user = F.coalesce(_data("TargetUserName"), _data("SubjectUserName"))
    address = F.coalesce(_data("IpAddress"), _data("SourceAddress"))
    process = F.coalesce(_data("NewProcessName"), _data("ProcessName"))
    unknown = F.concat(F.lit("Windows Event "), event_id.cast("string"), F.lit(" ("), channel, F.lit(")"))
    logon_type = F.try_element_at(data, F.lit("LogonType"))
    decoded = F.coalesce(c.lookup(fv.WINDOWS_LOGON_TYPES, logon_type), logon_type)
    extra = F.map_concat(
        F.map_filter(data, lambda k, _: ~k.isin(*fv.WINDOWS_CORE_KEYS)),
        F.create_map(F.lit("Channel"), channel),
        F.when(F.map_contains_key(data, F.lit("LogonType")), F.create_map(F.lit("LogonType"), decoded))
        .otherwise(c.empty_map()),
    )
    tags = (
        F.when(event_id.isin(*fv.WINDOWS_AUTH_TAG_EVENTS), c.text_array(["hipaa:auth"]))
        .when(event_id == int(fv.WINDOWS_AUDIT_CLEARED), c.text_array(["hipaa:integrity", "pci_dss"]))
        .otherwise(c.text_array())
    )
    return {
        "event_time": c.iso_time(_top("TimeCreated")),
        "source_host": F.coalesce(_top("Computer"), F.col("source_ip")),
        "source_type": F.lit("windows"),
        "log_level": F.coalesce(c.lookup(fv.WINDOWS_LEVELS, level), F.lit("info")),
        "category": F.coalesce(info["category"], F.lit("system")),
        "action": info["action"],
        "src_ip": F.when(~address.isin(*fv.WINDOWS_LOCAL_ADDRESSES), address),
        "src_port": c.digits_to_int(_data("IpPort")),
        # machine accounts end in $ and are not users
        "user_name": F.when(~user.endswith("$"), user),
        "process_name": F.substring_index(F.replace(process, F.lit("\\"), F.lit("/")), "/", -1),
        "event_id": event_id.cast("string"),
        "message": fill_template(F.coalesce(info["template"], unknown), data),
        "tags": tags,
        "extra": extra,
    }
