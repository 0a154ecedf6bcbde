"""Monitoring and alarm reports, alarm routing and delivery, run logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import average_cost, java_hash, number_rows, percent, render_template
from ..session import stage
from .templates import dynamic_where

STATUSES = {"success": "SUCCESS", "failed": "FAILED", "silent": "SILENT"}


def _between(df: DataFrame, ts: str, start, end) -> DataFrame:
    kind = df.schema[ts].dataType
    return df.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) <= F.lit(end).cast(kind)))


def _status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == code).alias(name) for name, code in STATUSES.items()]


def alarm_statistics(log: DataFrame, unit: str, start, end, workspace: str, ts: str = "create_time") -> DataFrame:
    """Success, failed and silent counts per minute, hour or day bucket of a workspace."""
    if unit not in ("minute", "hour", "day"):
        raise ValueError("unit is minute, hour or day")
    rows = _between(log.filter(F.col("workspace") == workspace), ts, start, end)
    return rows.groupBy(F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bucket")).agg(*_status_counts())


def alarm_statistics_stream(log: DataFrame, unit: str, late: str = "10 minutes", ts: str = "create_time") -> DataFrame:
    """The same counts on a stream, per workspace, closed once no row can be more than ``late`` behind."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy("workspace", F.window(ts, f"1 {unit}").alias("_w")).agg(*_status_counts()).select(
        "workspace", F.col("_w.start").cast("timestamp_ntz").alias("bucket"), *STATUSES
    )


def service_share(log: DataFrame, since, workspace: str, ts: str = "create_time") -> DataFrame:
    """Alarm count per server since a time, and its share of all in percent."""
    rows = log.filter((F.col("workspace") == workspace) & (F.col(ts) >= F.lit(since).cast(log.schema[ts].dataType)))
    per_server = rows.groupBy("server").agg(F.count(F.lit(1)).alias("alarms"))
    total = per_server.agg(F.sum("alarms").alias("n")).scalar()
    return per_server.withColumn("share", percent(F.col("alarms"), total))


def status_panel(flows: DataFrame) -> DataFrame:
    """Counts of running, waiting (never published) and paused entries from ``status, publish_version``."""
    published = F.col("publish_version").isNotNull()
    return flows.agg(
        F.count_if(published & (F.col("status") == "ENABLE")).alias("running"),
        F.count_if(~published).alias("waiting"),
        F.count_if(published & (F.col("status") == "PAUSE")).alias("paused"),
    )


def source_panel(checks: DataFrame, today: date) -> DataFrame:
    """Number of checked sources, time of the last check, success rate of today in percent.

    Expects ``source, check_time, ok``.
    """
    this_day = F.col("check_time").cast("date") == F.lit(today)
    return checks.agg(
        F.count_distinct("source").alias("sources"),
        F.max("check_time").alias("last_check"),
        percent(F.count_if(this_day & F.col("ok")), F.count_if(this_day)).alias("today_success_rate"),
    )


def _series_columns(seconds: int) -> list[Column]:
    total = F.sum("rows")
    return [
        total.alias("total"),
        (total.cast("decimal(18,0)") / F.lit(seconds).cast("decimal(18,0)")).cast("decimal(18,4)").alias("rate"),
        average_cost(F.col("cost")).alias("avg_cost"),
        F.count_if("error").alias("errors"),
    ]


def _choose(df: DataFrame, flow, component) -> DataFrame:
    return dynamic_where(df, [
        ("flow", lambda v: F.col("flow") == v), ("component", lambda v: F.col("component") == v),
    ], {"flow": flow, "component": component})


def flow_series(
    metrics: DataFrame, seconds: int, start, end, flow=None, component: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Rows, rows per second, average cost and errors per time bucket of a flow or one component."""
    rows = _choose(_between(metrics, ts, start, end), flow, component)
    grouped = rows.groupBy("flow", F.window(ts, f"{seconds} seconds").alias("_w")).agg(*_series_columns(seconds))
    return grouped.select("flow", F.col("_w.start").alias("bucket"), "total", "rate", "avg_cost", "errors")


def flow_series_stream(
    metrics: DataFrame, seconds: int, late: str = "10 minutes", flow=None, component: str | None = None, ts: str = "ts"
) -> DataFrame:
    """The same series on a stream, closed once no row can be more than ``late`` behind."""
    timed = _choose(metrics, flow, component).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy("flow", F.window(ts, f"{seconds} seconds").alias("_w")).agg(*_series_columns(seconds))
    return grouped.select(
        "flow", F.col("_w.start").cast("timestamp_ntz").alias("bucket"), "total", "rate", "avg_cost", "errors"
    )


def instance_series(samples: DataFrame, now, minutes: int = 10) -> DataFrame:
    """Per instance the latest value and the last minutes as parallel label and value arrays.

    The arrays hold one entry per sample of the interval, so their size is fixed by the sampling rate.
    """
    until = F.lit(now).cast("timestamp_ntz")
    recent = F.col("ts") > until - F.expr(f"interval {int(minutes)} minutes")
    per_instance = samples.filter(F.col("ts") <= until).groupBy("instance").agg(
        F.max_by("value", "ts").alias("latest"),
        F.sort_array(F.collect_list(F.when(recent, F.struct("ts", "value")))).alias("_s"),
    )
    label = F.transform("_s.ts", lambda t: F.date_format(t, "HH:mm:ss"))
    return per_instance.select("instance", "latest", label.alias("labels"), F.col("_s.value").alias("series"))


def live_instances(heartbeats: DataFrame, now, seconds: int = 30) -> DataFrame:
    """Instances whose last heartbeat is later than ``now`` minus 30 s."""
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(seconds)} seconds")
    return heartbeats.groupBy("instance").agg(F.max("ts").alias("last_beat")).filter(F.col("last_beat") > limit)


def last_errors(errors: DataFrame, n: int = 5, flow: str = "flow", seq: str = "seq") -> DataFrame:
    """The newest ``n`` errors per flow; each partition keeps its own newest n before the shuffle."""
    newest = Window.partitionBy(flow).orderBy(F.desc(seq))
    return errors.withColumn("newest", F.row_number().over(newest)).filter(F.col("newest") <= n)


def clear_trailing(errors: DataFrame, error_type: str, flow: str = "flow", seq: str = "seq", kind: str = "type") -> DataFrame:
    """Drop the run of newest errors of one type; older ones of that type stay. Rows without a flow are a flow of their own."""
    other = errors.filter(~F.col(kind).eqNullSafe(error_type))
    last_other = other.groupBy(F.col(flow).alias("_flow")).agg(F.max(seq).alias("_last"))
    return errors.join(last_other, F.col(flow).eqNullSafe(F.col("_flow"))).filter(F.col(seq) <= F.col("_last")).select(*errors.columns)


def route_alarms(alarms: DataFrame, scenes: DataFrame) -> DataFrame:
    """Each alarm once per enabled scene of its server and scene name; no workspace means every workspace.

    Alarms: ``server, scene, workspace, …``; scenes: ``server, scene, workspace, scene_code, robot,
    template, status``.
    """
    active = scenes.filter(F.col("status") == "ENABLE").select(
        "server", "scene", F.col("workspace").alias("_ws"), "scene_code", "robot", "template"
    )
    matched = alarms.join(active, ["server", "scene"]).filter(F.col("workspace").isNull() | (F.col("workspace") == F.col("_ws")))
    return matched.withColumn("workspace", F.col("_ws")).drop("_ws")


# Parameter name -> alarm column; added where the alarm does not set them itself.
BUILT_IN_PARAMETERS = {
    "$requestId": "request_id",
    "$serverName": "server",
    "$instanceId": "instance",
    "$alarmTime": "alarm_time",
    "$workspaceCode": "workspace",
    "$sceneCode": "scene_code",
}


def with_built_ins(alarms: DataFrame, params: str = "params") -> DataFrame:
    """Parameters of an alarm completed by the built-in ones."""
    def value(column: str) -> Column:
        if column not in alarms.columns:
            return F.lit(None).cast("string")
        if column == "alarm_time":
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        return F.col(column).cast("string")

    built_in = F.create_map(*[x for name, column in BUILT_IN_PARAMETERS.items() for x in (F.lit(name), value(column))])
    added = F.map_filter(built_in, lambda name, _: ~F.map_contains_key(F.col(params), name))
    return alarms.withColumn(params, F.map_concat(params, added))


def render(alarms: DataFrame, template: str = "template_content", params: str = "params", out: str = "text") -> DataFrame:
    """Template text with ``${name}`` replaced from the completed parameters."""
    return with_built_ins(alarms, params).withColumn(out, render_template(F.col(template), F.col(params)))


# characters of the piece by which a keyword is looked up, hits kept per alarm, and buckets of the sieve that texts pass first
GRAM, HITS, BUCKETS = 5, 5, 1 << 20


def _grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` characters; of size 0 the empty one."""
    starts = F.when(size == 0, F.array(F.lit(1))).when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def keyword_hits(alarms: DataFrame, rules: DataFrame, scope: Sequence[str] = ("workspace",), out: str = "hits") -> DataFrame:
    """Alarms with the sorted first five distinct keywords of their robot's unexpired rules that occur in the text (none: empty).

    A join by pieces: each keyword is looked up by the rarest run of up to ``GRAM`` characters in it, texts give each run of theirs once, and candidates are then
    compared in full. So a text is read once whatever the number of keywords, rules ride on no alarm, and a hot robot spreads over
    its keywords' pieces. Runs whose hash no keyword has (a broadcast set of ``BUCKETS`` integers at most) end in the scan. Equal texts of one robot and
    time are one text (told apart by their sha256). A null text holds nothing, an empty keyword is in every text.
    """
    robot = [*scope, "robot"]
    keywords = rules.select(*robot, F.explode("keywords").alias("_keyword"), "expire").where("_keyword IS NOT NULL").groupBy(*robot, "_keyword").agg(
        F.bool_or(F.col("expire").isNull()).alias("_always"), F.max("expire").alias("_until")).withColumn("_size", F.least(F.length("_keyword"), F.lit(GRAM)))
    pieces = keywords.withColumn("_gram", F.explode(_grams(F.col("_keyword"), F.col("_size"))))
    shared = pieces.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = pieces.join(shared, "_gram").groupBy(*robot, "_keyword").agg(
        F.min_by("_gram", F.struct("_n", F.xxhash64("_gram"))).alias("_gram"), F.first("_always").alias("_always"), F.first("_until").alias("_until"), F.first("_size").alias("_size"))
    rarest = stage(rarest, "keywords")
    key = F.sha2(F.col("text").cast("binary"), 256)
    texts = alarms.where("text IS NOT NULL").select(*robot, key.alias("_key"), "alarm_time", "text")
    sizes = rarest.groupBy(*robot).agg(F.collect_set("_size").alias("_sizes"))  # a row per robot, six sizes at most
    runs = texts.join(sizes, robot).select(*robot, "_key", "alarm_time", "text", F.explode("_sizes").alias("_size"))
    runs = runs.select(*robot, "_key", "alarm_time", F.explode(_grams(F.col("text"), F.col("_size"))).alias("_gram"))
    found = _sifted(runs, "_gram", rarest).join(rarest, [*robot, "_gram"]).where(F.col("_always") | (F.col("_until") >= F.col("alarm_time")))
    found = stage(found.select(*robot, "_key", F.col("alarm_time").alias("_at"), "_keyword").distinct(), "candidates")
    same_time = F.col("alarm_time").eqNullSafe(F.col("_at"))  # an alarm without a time meets rules without an end only
    checked = _sifted(texts, "_key", found).join(found, [*robot, "_key"]).where(same_time & F.contains("text", "_keyword"))
    hits = checked.groupBy(*[F.col(c).alias(f"_h_{c}") for c in (*robot, "_key", "_at")]).agg(
        F.slice(F.array_sort(F.collect_set("_keyword")), 1, HITS).alias(out))
    same = [F.col(c) == F.col(f"_h_{c}") for c in (*robot, "_key")] + [F.col("alarm_time").eqNullSafe(F.col("_h__at"))]
    joined = alarms.withColumn("_key", key).join(hits, reduce(lambda x, y: x & y, same), "left")
    return joined.select(*alarms.columns, F.coalesce(out, F.array().cast("array<string>")).alias(out))


def _sifted(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose value hashes to a bucket of a wanted one; ends the others in the scan, by a broadcast of ``BUCKETS`` integers at most."""
    bucket = F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("_bucket")
    return df.select("*", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "_bucket", "left_semi").drop("_bucket")


def silence(alarms: DataFrame, rules: DataFrame, scope: Sequence[str] = ("workspace",)) -> DataFrame:
    """Alarms with ``silent`` and the keywords found.

    Alarms: ``workspace, robot, text, alarm_time``; rules: ``workspace, robot, keywords, expire`` (null never expires).
    A robot's code is known within its ``scope`` only. Keywords are looked up as in :func:`keyword_hits`.
    """
    return keyword_hits(alarms, rules, scope).withColumn("silent", F.size("hits") > 0)


def deliver(
    alarms: DataFrame, robots: DataFrame, seq: str = "alarm_id", scope: Sequence[str] = ("workspace",)
) -> DataFrame:
    """One row per alarm and chosen ``receiver``.

    BROADCAST sends to all, POLLING to receiver ``counter % n`` (the counter of a robot starts at
    1 and follows ``seq``), RANDOM to one picked by the hash of ``seq``, so that a rerun agrees.
    Robots: ``workspace, robot, mode, receives`` (array); a code and its counter belong to their ``scope``.
    """
    known = robots.select(*scope, "robot", "mode", "receives")
    joined = alarms.join(known, [*scope, "robot"]).select(*alarms.columns, "mode", "receives")
    n = F.size("receives")
    pick = F.pmod(java_hash(F.col(seq).cast("string")).bitwiseAND(F.lit(0x7FFFFFFF)), n).cast("int")
    at_once = F.when(F.col("mode") == "BROADCAST", F.col("receives")).when(
        F.col("mode") == "RANDOM", F.array(F.get("receives", pick))
    )
    polled = number_rows(joined.filter(F.col("mode") == "POLLING"), [seq], [*scope, "robot"], out="_counter").withColumn(
        "receiver", F.get("receives", F.pmod("_counter", n).cast("int"))
    )
    return (
        joined.withColumn("receiver", F.explode(at_once)).unionByName(polled.drop("_counter")).drop("mode", "receives")
    )


# Reasons of a failed alarm and the longest reason kept.
TEMPLATE_MISSING = "模板不存在"
TEMPLATE_OFF = "模板未启用"
REASON_LENGTH = 2000


def alarm_outcome(
    alarms: DataFrame, robots: DataFrame, templates: DataFrame, rules: DataFrame, scope: Sequence[str] = ("workspace",)
) -> DataFrame:
    """The alarm log: status and reason of each alarm whose robot is on and records a log.

    Alarms: ``robot, template, workspace, alarm_time, params, …``; robots: ``robot, status, record_log``;
    templates: ``template, template_content, status``; all with the columns of ``scope``, in which codes are known.
    Alarms without a robot, or whose robot is off, are dropped.
    """
    active = robots.filter((F.col("status") == "ENABLE") & (F.col("record_log") == "ENABLE")).select(*scope, "robot")
    known = templates.select(*scope, "template", "template_content", F.col("status").alias("_template_status"), F.lit(True).alias("_known"))
    rendered = render(alarms.join(active, [*scope, "robot"]).join(known, [*scope, "template"], "left"))
    problem = F.when(F.col("_known").isNull(), TEMPLATE_MISSING).when(F.col("_template_status") != "ENABLE", TEMPLATE_OFF)
    silent = F.size("_hits") > 0
    reason = F.coalesce("_problem", F.when(silent, F.to_json("_hits")))
    return (
        keyword_hits(rendered, rules, scope, "_hits").withColumn("_problem", problem)
        .withColumn("status", F.when(F.col("_problem").isNotNull(), "FAILED").when(silent, "SILENT").otherwise("SUCCESS"))
        .withColumn("reason", F.when(
            F.length(reason) > REASON_LENGTH, F.concat(F.left(reason, F.lit(REASON_LENGTH)), F.lit("..."))
        ).otherwise(reason))
        .select(*alarms.columns, "status", "reason")
    )


def expand_messages(messages: DataFrame, users: DataFrame, members: DataFrame, salts: int = 32) -> DataFrame:
    """Distinct (message, user) rows by scope: ALL, WORKSPACE (``target`` = workspace), USER (``target`` = user).

    Users are listed under every audience they belong to and matched by audience. The audience
    of everyone is as large as the user table, so audiences are split by user into ``salts`` parts.
    """
    part = F.pmod(F.xxhash64("user_id"), F.lit(salts)).cast("int").alias("_part")
    everyone = users.select(F.lit("ALL").alias("scope"), F.lit("*").alias("target"), "user_id", part)
    teams = members.join(users.select("user_id"), "user_id", "left_semi").select(
        F.lit("WORKSPACE").alias("scope"), F.col("workspace").cast("string").alias("target"), "user_id", part
    )
    single = users.select(F.lit("USER").alias("scope"), F.col("user_id").cast("string").alias("target"), "user_id", part)
    parts = F.sequence(F.lit(0), F.lit(salts - 1))
    target = F.when(F.col("scope") == "ALL", "*").otherwise(F.col("target"))
    asked = messages.select("message_id", "scope", target.cast("string").alias("target")).withColumn(
        "_part", F.explode(F.when(F.col("scope") == "USER", F.array(F.lit(-1))).otherwise(parts))
    )
    audiences = everyone.unionByName(teams).unionByName(single.withColumn("_part", F.lit(-1)))
    return asked.join(audiences, ["scope", "target", "_part"]).select("message_id", "user_id").distinct()


# How a log record starts, and its header.
FIRST_LINE = r"^\d{4}-\d{2}-\d{2}[\s|T]\d{2}:\d{2}:\d{2}\.\d{3}\s+"
HEADER = (
    r"^(\d{4}-\d{2}-\d{2}[\s|T]\d{2}:\d{2}:\d{2}\.\d{3})\s+(\w+)\s+(\d+)\s+---\s+\[([^\]]+)\]\s+\[([^\]]+)\]\s+"
    r"(?:\[(?:([a-f0-9]{32})|\s{32})\]\s+)?\[(?:([a-f0-9]{32})|\s{32})\]\s+([^\s]+)\s+:\s+"
)
HEADER_FIELDS = ("timestamp", "level", "process_id", "application", "thread", "flow_code", "request_id", "logger")


def parse_log_lines(
    lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "text", chunk: int = 100_000,
    max_lines: int = 100,
) -> DataFrame:
    """Text lines to log records with their header fields.

    A line that starts with a timestamp opens a record and the lines after it join, at most ``max_lines``;
    longer records continue in further ones, which have the header fields of their first. ``line_no`` counts lines of a file
    from any start without gaps. A file is cut into chunks of lines; only the last record start of each
    chunk is carried over to the next ones, so a large file spreads over many tasks.
    """
    marked = lines.select(
        file, line_no, text, F.floor(F.col(line_no) / chunk).alias("_chunk"),
        F.when(F.col(text).rlike(FIRST_LINE), F.col(line_no)).alias("_start"),
    )
    so_far = Window.partitionBy(file, "_chunk").orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(file).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy(file, "_chunk").agg(F.max("_start").alias("_last"))
        .select(file, "_chunk", F.max("_last").over(earlier).alias("_carried"))
    )
    placed = (
        marked.withColumn("_start", F.max("_start").over(so_far))
        .join(carried, [file, "_chunk"])
        .withColumn("_start", F.coalesce("_start", "_carried", line_no))
        .withColumn("_piece", F.floor((F.col(line_no) - F.col("_start")) / max_lines))
    )
    ordered = F.sort_array(F.collect_list(F.struct(line_no, text)))
    records = placed.groupBy(file, "_start", "_piece").agg(
        F.min(line_no).alias(line_no), F.count(F.lit(1)).alias("lines"), F.array_join(ordered[text], "\n").alias("record")
    )
    # the long text is searched once; the fields come from the short header
    pieces = Window.partitionBy(file, "_start").orderBy("_piece")
    header = F.regexp_extract("record", HEADER, 0)
    fields = {
        name: F.when(F.col("_first") != "", F.nullif(F.regexp_extract("_first", HEADER, i), F.lit("")))
        for i, name in enumerate(HEADER_FIELDS, start=1)
    }
    return records.withColumn("_header", header).withColumn("_first", F.first("_header").over(pieces)).select(
        file, line_no, "lines", *[c.alias(n) for n, c in fields.items()],
        F.substr("record", F.length("_header") + 1).alias("message"),
    )


def search_run_log(logs: DataFrame, params: Mapping, limit: int = 5000) -> DataFrame:
    """Newest log records of a flow, optionally by request, level, all keywords and time range.

    ``params``: ``flow_code, request_id, level, keywords, start, end``.
    """
    def moment(text: Column) -> Column:
        """A time as the log writes it: blank, T or bar between date and time."""
        return F.translate(text.cast("string"), "|", " ").cast("timestamp_ntz")

    def all_words(words: Sequence[str]) -> Column:
        found = F.lit(True)
        for word in words:
            found = found & F.col("message").contains(word)
        return found

    rows = dynamic_where(logs, [
        ("flow_code", lambda v: F.col("flow_code") == v),
        ("request_id", lambda v: F.col("request_id") == v),
        ("level", lambda v: F.col("level") == v),
        ("keywords", all_words),
        ("start", lambda v: moment(F.col("timestamp")) >= moment(F.lit(v))),
        ("end", lambda v: moment(F.col("timestamp")) <= moment(F.lit(v))),
    ], params)
    return rows.orderBy(F.desc("timestamp"), F.desc("file"), F.desc("line_no")).limit(limit)
