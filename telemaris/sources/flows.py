"""Network flows: nested JSON documents as a flat table, and attack reports with their rewrite rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemaris.functions.clean import as_array, iso_time, safe_int
from telemaris.operators.ordered import positions

SCHEMA = (
    "`@timestamp` string, "
    "destination struct<bytes:long,ip:string,mac:string,packets:long,port:string,process:array<string>>, "
    "event struct<action:string,duration:long,type:array<string>>, "
    "host struct<hostname:string,ip:array<string>,mac:array<string>,os:struct<platform:string>>, "
    "network struct<bytes:long,packets:long,transport:string,type:string>, "
    "network_traffic struct<flow:struct<id:string>>, "
    "process struct<args:array<string>,executable:string,name:string,parent:struct<pid:long>,pid:long>, "
    "source struct<bytes:long,ip:string,mac:string,packets:long,port:string,process:struct<args:array<string>,executable:string,name:string,pid:long,ppid:long>>"
)
#: Paths whose first element alone is kept, and paths that stay arrays.
FIRST, LISTS = ("event.type", "host.mac"), ("destination.process", "host.ip", "process.args", "source.process.args")
# The paths of a flow document.
PATHS = (
    "destination.bytes",
    "destination.ip",
    "destination.mac",
    "destination.packets",
    "destination.port",
    "destination.process",
    "event.action",
    "event.duration",
    "event.type",
    "host.hostname",
    "host.ip",
    "host.mac",
    "host.os.platform",
    "network.bytes",
    "network.packets",
    "network.transport",
    "network.type",
    "network_traffic.flow.id",
    "process.args",
    "process.executable",
    "process.name",
    "process.parent.pid",
    "process.pid",
    "source.bytes",
    "source.ip",
    "source.mac",
    "source.packets",
    "source.port",
    "source.process.args",
    "source.process.executable",
    "source.process.name",
    "source.process.pid",
    "source.process.ppid",
)


def flat(docs: DataFrame) -> DataFrame:
    """One column for each path, dots as underscores; arrays are never null, ports are whole numbers."""

    def column(path: str) -> Column:
        c = F.col(path)
        if path in FIRST:
            c = F.get(c, F.lit(0))
        elif path in LISTS:
            c = as_array(c)
        elif path.endswith(".port"):
            c = safe_int(c)
        return c.alias(path.replace(".", "_"))

    return docs.select(F.try_to_timestamp(F.col("`@timestamp`")).alias("timestamp"), *map(column, PATHS))


REPORT = (
    "delegated_timestamp string, collected_timestamp string, finished_timestamp string, command string, "
    "attack_metadata struct<tactic:string,technique_name:string>, ability_metadata struct<ability_name:string>"
)


def report_entries(report: DataFrame, order: str) -> DataFrame:
    """Report entries flat, numbered from 0 in the order of a column; nested texts default to ''. Many reports may be one table."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return positions(report, [order], "__entry").select(
        (F.col("__entry") - 1).cast("long").alias("entry"),
        "command",
        *(iso_time(f"{x}_timestamp").alias(f"{x}_timestamp") for x in ("delegated", "collected", "finished")),
        text("attack_metadata.tactic").alias("tactic"),
        text("attack_metadata.technique_name").alias("technique_name"),
        text("ability_metadata.ability_name").alias("ability_name"),
    )


def rewritten(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries with `new_command` by the rule (entry, kind, pattern, template) of their number.

    kind `keep` leaves the command; `capture` puts the pattern's groups $1, $2 into the template;
    `strip` deletes the pattern and double quotes. Without a rule or a match a command stays as it is.
    rules may list several rows for an entry with `position`: it becomes as many entries, numbered anew.
    """
    both = entries.join(rules, "entry", "left")
    hit = F.expr("regexp_like(command, pattern)")
    captured = F.replace(F.replace(F.col("template"), F.lit("$1"), F.expr("regexp_extract(command, pattern, 1)")), F.lit("$2"), F.expr("case when regexp_count(pattern, '[(]') > 1 then regexp_extract(command, pattern, 2) else '' end"))
    stripped = F.replace(F.expr("regexp_replace(command, pattern, '')"), F.lit('"'), F.lit(""))
    new = F.when((F.col("kind") == "capture") & hit, captured).when((F.col("kind") == "strip") & hit, stripped).otherwise(F.col("command"))
    made = both.withColumn("new_command", new).withColumn("__position", F.coalesce("position", F.lit(0)))
    return positions(made, ["entry", "__position"], "__new").select((F.col("__new") - 1).cast("long").alias("new_entry"), *entries.columns, "new_command")
