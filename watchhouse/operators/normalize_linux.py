"""Linux journald / rsyslog JSON objects -> event fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.functions import fixed_values as fv

DOC, JOURNALD, PROGRAM, MESSAGE, SEVERITY, CLASS = (
    "_lx_doc", "_lx_journald", "_lx_program", "_lx_message", "_lx_severity", "_lx_class",
)


def _top(name: str) -> Column:
    return F.try_element_at(F.col(DOC), F.lit(name))


def _has(name: str) -> Column:
    return F.map_contains_key(F.col(DOC), F.lit(name))


def _or_missing(name: str, default: Column) -> Column:
    """The value when the key is present (even null), else ``default``."""
    return F.when(_has(name), _top(name)).otherwise(default)


def prepare(df: DataFrame, applies: Column) -> DataFrame:
    journald = F.col(JOURNALD)
    df = df.withColumn(DOC, F.when(applies, F.from_json("raw", "map<string,string>")))
    df = df.withColumn(JOURNALD, _has("_HOSTNAME") | _has("__REALTIME_TIMESTAMP"))
    program = F.when(
        journald,
        F.coalesce(c.blank_to_null(_top("SYSLOG_IDENTIFIER")), c.blank_to_null(_top("_COMM")), F.lit("unknown")),
    ).otherwise(_or_missing("program", _or_missing("app-name", F.lit("unknown"))))
    message = F.when(journald, _or_missing("MESSAGE", F.lit(""))).otherwise(_or_missing("message", F.lit("")))
    severity = F.when(journald, _or_missing("PRIORITY", F.lit("6"))).otherwise(_or_missing("severity", F.lit("6")))
    df = df.withColumns({PROGRAM: program, MESSAGE: message, SEVERITY: severity.try_cast("int")})
    return df.withColumn(CLASS, F.when(F.col(DOC).isNotNull(), classify(F.col(PROGRAM), F.col(MESSAGE))))


def problem() -> Column:
    host = F.when(F.col(JOURNALD), _has("_HOSTNAME") & _top("_HOSTNAME").isNull()).otherwise(
        _has("hostname") & _top("hostname").isNull()
    )
    return (
        F.when(F.col(DOC).isNull(), "not a JSON object")
        .when(F.col(SEVERITY).isNull(), "severity is not a number")
        .when(F.col(PROGRAM).isNull(), "program is null")
        .when(F.col(MESSAGE).isNull(), "message is null")
        .when(host, "hostname is null")
    )


def _verdict(category, action=None, ip=None, user=None, port=None) -> Column:
    def text(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    number = (port if port is not None else F.lit(None)).try_cast("int")
    return F.struct(
        text(category).alias("category"), text(action).alias("action"), text(ip).alias("src_ip"),
        text(user).alias("user_name"), number.alias("src_port"),
    )


def classify(program: Column, message: Column) -> Column:
    """(category, action, src_ip, user_name, src_port); the first matching line wins."""
    prog, lower = F.lower(program), F.lower(message)
    g = lambda pattern, n: c.group_of(message, pattern, n)
    pam_action = F.when(F.lower(g(fv.PAM, 1)) == "accepted", "logon").otherwise("logon_failed")
    sshd = prog == "sshd"
    cron_session = lower.contains("started") | lower.contains("session opened")
    return (
        F.when(sshd & message.rlike(fv.SSH_ACCEPTED),
               _verdict("auth", "logon", g(fv.SSH_ACCEPTED, 3), g(fv.SSH_ACCEPTED, 2), g(fv.SSH_ACCEPTED, 4)))
        .when(sshd & message.rlike(fv.SSH_FAILED),
              _verdict("auth", "logon_failed", g(fv.SSH_FAILED, 2), g(fv.SSH_FAILED, 1), g(fv.SSH_FAILED, 3)))
        .when(sshd & message.rlike(fv.SSH_DISCONNECTED),
              _verdict("auth", "logoff", g(fv.SSH_DISCONNECTED, 2), g(fv.SSH_DISCONNECTED, 1),
                       g(fv.SSH_DISCONNECTED, 3)))
        .when((prog == "sudo") & message.rlike(fv.SUDO), _verdict("auth", "privileged_exec", user=g(fv.SUDO, 1)))
        .when(prog.contains("pam") & message.rlike(fv.PAM), _verdict("auth", pam_action, user=g(fv.PAM, 2)))
        .when((prog == "auditd") & message.rlike(fv.AUDITD),
              _verdict("compliance", ip=g(fv.AUDITD, 3), user=g(fv.AUDITD, 2)))
        .when((prog == "kernel") & lower.contains("out of memory"), _verdict("system"))
        .when(prog.isin("cron", "crond") & cron_session, _verdict("system"))
        .otherwise(_verdict(F.coalesce(c.lookup(fv.LINUX_PROGRAM_CATEGORIES, prog), F.lit("system"))))
    )


def fields() -> dict[str, Column]:
    journald, verdict = F.col(JOURNALD), F.col(CLASS)
    kept = F.when(journald, F.map_filter(F.col(DOC), lambda k, _: k.isin(*fv.JOURNALD_EXTRA_KEYS))).otherwise(
        F.map_filter(F.col(DOC), lambda k, _: k.isin(*fv.RSYSLOG_EXTRA_KEYS))
    )
    pid = c.blank_to_null(F.when(journald, _top("_PID")).otherwise(_top("pid")))
    extra = F.map_concat(
        kept, F.when(pid.isNotNull(), F.create_map(F.lit("pid"), pid)).otherwise(c.empty_map())
    )
    tags = F.array_compact(F.array(
        F.when(verdict["category"] == "auth", "hipaa:auth"),
        F.when(F.lower(F.col(PROGRAM)) == "auditd", "hipaa:audit"),
    ))
    return {
        "event_time": F.when(journald, c.epoch_micros_time(_top("__REALTIME_TIMESTAMP")))
        .otherwise(c.iso_time(_top("timestamp"))),
        "source_host": F.coalesce(F.when(journald, _top("_HOSTNAME")).otherwise(_top("hostname")), F.col("source_ip")),
        "source_type": F.lit("linux"),
        "log_level": c.level_of_priority(F.col(SEVERITY).cast("bigint")),
        "category": verdict["category"],
        "action": verdict["action"],
        "src_ip": verdict["src_ip"],
        "src_port": verdict["src_port"],
        "user_name": verdict["user_name"],
        "process_name": F.col(PROGRAM),
        "message": F.col(MESSAGE),
        "tags": tags,
        "extra": extra,
    }
