"""Registered queries: reports, alarms and run logs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import monitor as m
from .fixtures import Inputs

NOW = "2024-01-28 12:00:00"


def _double(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _flows(t: Inputs):
    return t["orders"].select(
        F.when(F.col("o_orderstatus") == "O", "ENABLE").when(F.col("o_orderstatus") == "P", "PAUSE").otherwise("TBP").alias("status"),
        F.when((F.col("o_orderstatus") != "F") & (F.col("o_custkey") % 5 > 0), F.col("o_custkey")).alias("publish_version"),
    )


def _checks(t: Inputs):
    return t["events"].select(F.col("user_id").alias("source"), F.col("ts").alias("check_time"), (F.col("event_type") != "error").alias("ok"))


def _samples(t: Inputs):
    return t["events"].select(F.concat(F.lit("i"), F.col("user_id") % 12).alias("instance"), "ts", "value")


def _instance_series(t: Inputs):
    series = m.instance_series(_samples(t), NOW, minutes=600)
    text = F.transform("series", lambda v: v.cast("string"))
    return series.select("instance", "latest", F.array_join("labels", ",").alias("labels"), F.array_join(text, ",").alias("series"))


def _errors(t: Inputs):
    return t["events"].select(F.col("user_id").alias("flow"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "props")


ROUTE_KEYS = ("alarm_id", "server", "scene", "workspace", "scene_code", "robot", "template")

TEMPLATE = "[${$serverName}] ${ kind } of ${$workspaceCode} at ${$alarmTime}: ${k} ${missing} ${open"


def _render_template(t: Inputs):
    params = F.create_map(F.lit("kind"), F.col("scene"), F.lit("k"), F.get_json_object("props", "$.k"))
    own = F.when(F.col("scene") == "error", F.map_concat(params, F.create_map(F.lit("$serverName"), F.lit("own name")))).otherwise(params)
    alarms = t["alarms"].withColumn("params", own).withColumn("template_content", F.lit(TEMPLATE))
    return m.render(alarms).select("alarm_id", "text")


def _rules(t: Inputs):
    """Three rules per robot with their keywords; the first has expired, the last never expires."""
    words = t["silence_words"].groupBy("workspace", "robot", "rule_no").agg(F.sort_array(F.collect_set("word")).alias("keywords"))
    expire = F.when(F.col("rule_no") == 0, "2024-01-10 00:00:00").when(F.col("rule_no") == 1, "2024-02-10 00:00:00")
    return words.select("workspace", "robot", "keywords", expire.cast("timestamp_ntz").alias("expire"))


def _silence(t: Inputs):
    found = m.silence(t["robot_alarms"], _rules(t))
    return found.select("alarm_id", "silent", F.array_join("hits", "|").alias("hits"))


def _deliver(t: Inputs):
    return m.deliver(t["robot_alarms"], t["robots"]).select("alarm_id", "robot", "receiver")


def _alarm_outcome(t: Inputs):
    templates = t["part"].select(
        F.concat(F.lit("ws"), F.col("p_size") % 3).alias("workspace"), F.concat(F.lit("tp"), F.col("p_size") % 4).alias("template"),
        F.when(F.col("p_size") % 4 == 3, "DISABLE").otherwise("ENABLE").alias("status"), F.lit("note: ${note}").alias("template_content"),
    ).distinct()
    alarms = t["robot_alarms"].withColumn("params", F.create_map(F.lit("note"), F.col("note")))
    return m.alarm_outcome(alarms, t["robots"], templates, _rules(t)).select("alarm_id", "robot", "template", "status", "reason")


def _expand_messages(t: Inputs):
    members = t["users"].select("user_id", F.col("team").alias("workspace"))
    return m.expand_messages(t["audience_messages"], t["users"], members)


def _search_run_log(t: Inputs):
    found = m.search_run_log(m.parse_log_lines(t["log_lines"], chunk=1000), {
        "flow_code": "3" * 32, "level": "INFO", "keywords": ["step 1", '"k": 1'], "start": "2024-01-03", "end": "2024-01-29",
    })
    return found.select("file", "line_no", "timestamp", "logger", "message")


QUERIES = {
    "i1_alarm_statistics_day": lambda t: m.alarm_statistics(t["alarm_log"], "day", "2024-01-03 06:00:00", NOW, "ws1"),
    "i1_alarm_statistics_hour": lambda t: m.alarm_statistics(t["alarm_log"], "hour", "2024-01-03 06:00:00", NOW, "ws2"),
    "i1_alarm_statistics_minute": lambda t: m.alarm_statistics(t["alarm_log"], "minute", "2024-01-01 00:00:00", NOW, "ws3"),
    "i2_service_share": lambda t: _double(m.service_share(t["alarm_log"], "2024-01-10 00:00:00", "ws1"), "share"),
    "i3_status_panel": lambda t: m.status_panel(_flows(t)),
    "i3_source_panel": lambda t: _double(m.source_panel(_checks(t), date(2024, 1, 15)), "today_success_rate"),
    "i4_flow_series": lambda t: _double(
        m.flow_series(t["metrics"], 3600, "2024-01-02 00:00:00", "2024-01-29 00:00:00"), "rate", "avg_cost"
    ),
    "i4_flow_series_component": lambda t: _double(
        m.flow_series(t["metrics"], 86400, "2024-01-02 00:00:00", "2024-01-29 00:00:00", 4, "click"), "rate", "avg_cost"
    ),
    "i5_instance_series": _instance_series,
    "i6_live_instances": lambda t: m.live_instances(_samples(t), NOW, 3600),
    "i7_last_errors": lambda t: m.last_errors(_errors(t)),
    "i8_clear_trailing": lambda t: m.clear_trailing(_errors(t), "error"),
    "i9_route_alarms": lambda t: m.route_alarms(t["alarms"], t["scenes"]).select(*ROUTE_KEYS),
    "i10_render_template": _render_template,
    "i11_silence": _silence,
    "i12_deliver": _deliver,
    "i13_alarm_outcome": _alarm_outcome,
    "i14_expand_messages": _expand_messages,
    "i15_parse_log_lines": lambda t: m.parse_log_lines(t["log_lines"], chunk=1000),
    "i16_search_run_log": _search_run_log,
}

_STATISTICS = """
    SELECT date_trunc('{0}', create_time)::TIMESTAMP AS bucket, count(*) FILTER (WHERE status = 'SUCCESS') AS success,
           count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'SILENT') AS silent
    FROM alarm_log WHERE workspace = '{2}' AND create_time >= timestamp '{1}' AND create_time <= timestamp '2024-01-28 12:00:00'
    GROUP BY 1"""

_PERCENT = "((20000 * ({0}) + ({1})) // (2 * ({1}))) / 100.0"

_SERIES = """
    SELECT flow, time_bucket(to_seconds({0}), ts, timestamp '2000-01-01') AS bucket, cast(sum(rows) AS BIGINT) AS total,
           ((20000 * cast(sum(rows) AS BIGINT) + {0}) // (2 * {0})) / 10000.0 AS rate,
           ((2 * cast(sum(cast(cost AS DECIMAL(28,8))) * 100000000 AS HUGEINT) + 1000000 * count(*)) // (2000000 * count(*))) / 100.0 AS avg_cost,
           count(*) FILTER (WHERE error) AS errors
    FROM metrics WHERE ts BETWEEN timestamp '2024-01-02' AND timestamp '2024-01-29' AND {1}
    GROUP BY 1, 2"""

_SAMPLES = "SELECT 'i' || cast(user_id % 12 AS STRING) AS instance, ts, value FROM events"

# keywords of each robot with the end of their rule
_WORDS = """
    words AS (
        SELECT workspace, robot, word, CASE rule_no WHEN 0 THEN timestamp '2024-01-10' WHEN 1 THEN timestamp '2024-02-10' END AS expire
        FROM silence_words)"""

_JAVA = (
    "(list_reduce(list_prepend(cast(0 AS BIGINT), list_transform(string_split(cast(alarm_id AS STRING), ''), "
    "lambda c: cast(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) % 2147483648)"
)

_LOG = """
    heads AS (
        SELECT event_id % 3 AS file, cast(floor(event_id / 3) * 3 AS BIGINT) AS line_no,
               strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS timestamp,
               CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'app.' || event_type AS logger,
               repeat(cast(user_id % 10 AS STRING), 32) AS flow_code,
               CASE WHEN event_id % 4 <> 0 THEN repeat('a', 32) END AS request_id,
               props || chr(10) || '    at step 1 of ' || cast(event_id AS STRING) || chr(10) || '    at step 2 of '
               || cast(event_id AS STRING) AS message
        FROM events)"""

ORACLES = {
    "i1_alarm_statistics_day": _STATISTICS.format("day", "2024-01-03 06:00:00", "ws1"),
    "i1_alarm_statistics_hour": _STATISTICS.format("hour", "2024-01-03 06:00:00", "ws2"),
    "i1_alarm_statistics_minute": _STATISTICS.format("minute", "2024-01-01 00:00:00", "ws3"),
    "i2_service_share": f"""
        WITH counts AS (
            SELECT server, count(*) AS alarms FROM alarm_log
            WHERE workspace = 'ws1' AND create_time >= timestamp '2024-01-10' GROUP BY server),
        whole AS (SELECT cast(sum(alarms) AS BIGINT) AS n FROM counts)
        SELECT server, alarms, {_PERCENT.format('alarms', 'n')} AS share FROM counts, whole""",
    "i3_status_panel": """
        SELECT count(*) FILTER (WHERE o_orderstatus = 'O' AND o_custkey % 5 > 0) AS running,
               count(*) FILTER (WHERE o_orderstatus = 'F' OR o_custkey % 5 = 0) AS waiting,
               count(*) FILTER (WHERE o_orderstatus = 'P' AND o_custkey % 5 > 0) AS paused
        FROM orders""",
    "i3_source_panel": f"""
        SELECT count(DISTINCT user_id) AS sources, max(ts) AS last_check,
               {_PERCENT.format("count(*) FILTER (WHERE ts >= timestamp '2024-01-15' AND ts < timestamp '2024-01-16' AND event_type <> 'error')",
                                "count(*) FILTER (WHERE ts >= timestamp '2024-01-15' AND ts < timestamp '2024-01-16')")}
               AS today_success_rate
        FROM events""",
    "i4_flow_series": _SERIES.format(3600, "true"),
    "i4_flow_series_component": _SERIES.format(86400, "flow = 4 AND component = 'click'"),
    "i5_instance_series": f"""
        WITH samples AS (SELECT * FROM ({_SAMPLES}) WHERE ts <= timestamp '2024-01-28 12:00:00'),
        recent AS (
            SELECT instance, string_agg(strftime(ts, '%H:%M:%S'), ',' ORDER BY ts) AS labels,
                   string_agg(cast(value AS STRING), ',' ORDER BY ts) AS series
            FROM samples WHERE ts > timestamp '2024-01-28 02:00:00' GROUP BY instance)
        SELECT s.instance, arg_max(s.value, s.ts) AS latest, coalesce(any_value(labels), '') AS labels, coalesce(any_value(series), '') AS series
        FROM samples s LEFT JOIN recent r ON r.instance = s.instance GROUP BY s.instance""",
    "i6_live_instances": f"""
        SELECT instance, max(ts) AS last_beat FROM ({_SAMPLES}) GROUP BY instance
        HAVING max(ts) > timestamp '2024-01-28 11:00:00'""",
    "i7_last_errors": """
        SELECT user_id AS flow, event_id AS seq, event_type AS type, props,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS newest
        FROM events QUALIFY newest <= 5""",
    "i8_clear_trailing": """
        SELECT user_id AS flow, event_id AS seq, event_type AS type, props FROM events e
        WHERE event_id <= (SELECT max(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type <> 'error')""",
    "i9_route_alarms": """
        SELECT a.alarm_id, a.server, a.scene, s.workspace, s.scene_code, s.robot, s.template
        FROM alarms a JOIN scenes s ON s.server = a.server AND s.scene = a.scene AND s.status = 'ENABLE'
        AND (a.workspace IS NULL OR a.workspace = s.workspace)""",
    "i10_render_template": """
        SELECT alarm_id, '[' || CASE WHEN scene = 'error' THEN 'own name' ELSE server END || '] ' || scene || ' of '
               || coalesce(workspace, '') || ' at ' || strftime(alarm_time, '%Y-%m-%d %H:%M:%S') || ': '
               || json_extract_string(props, '$.k') || '  ${open' AS text
        FROM alarms""",
    "i11_silence": f"""
        WITH {_WORDS},
        hits AS (
            SELECT DISTINCT alarm_id, word FROM robot_alarms a JOIN words w ON w.robot = a.robot AND w.workspace = a.workspace
            AND (w.expire IS NULL OR w.expire >= a.alarm_time) AND contains(a.text, w.word)),
        listed AS (SELECT *, row_number() OVER (PARTITION BY alarm_id ORDER BY word) AS n FROM hits)
        SELECT a.alarm_id, count(l.word) > 0 AS silent, coalesce(string_agg(l.word, '|' ORDER BY l.word), '') AS hits
        FROM robot_alarms a LEFT JOIN listed l ON l.alarm_id = a.alarm_id AND l.n <= 5 GROUP BY a.alarm_id""",
    "i12_deliver": f"""
        WITH known AS (SELECT a.alarm_id, a.workspace, a.robot, r.mode FROM robot_alarms a JOIN robots r ON r.robot = a.robot AND r.workspace = a.workspace)
        SELECT alarm_id, robot, receiver FROM known, (VALUES ('a'), ('b'), ('c')) x(receiver) WHERE mode = 'BROADCAST'
        UNION ALL
        SELECT alarm_id, robot, substr('abc', cast({_JAVA} % 3 AS INTEGER) + 1, 1) AS receiver FROM known WHERE mode = 'RANDOM'
        UNION ALL
        SELECT alarm_id, robot, substr('abc', cast(row_number() OVER (PARTITION BY workspace, robot ORDER BY alarm_id) % 3 AS INTEGER) + 1, 1)
               AS receiver
        FROM known WHERE mode = 'POLLING'""",
    "i13_alarm_outcome": f"""
        WITH {_WORDS},
        templates AS (
            SELECT DISTINCT 'ws' || cast(p_size % 3 AS STRING) AS workspace, 'tp' || cast(p_size % 4 AS STRING) AS template,
                   CASE WHEN p_size % 4 = 3 THEN 'DISABLE' ELSE 'ENABLE' END AS template_status FROM part),
        listed AS (
            SELECT alarm_id, word, row_number() OVER (PARTITION BY alarm_id ORDER BY word) AS n FROM (
                SELECT DISTINCT alarm_id, word FROM robot_alarms a JOIN words w ON w.robot = a.robot AND w.workspace = a.workspace
                AND (w.expire IS NULL OR w.expire >= a.alarm_time) AND contains('note: ' || a.note, w.word))),
        silenced AS (
            SELECT alarm_id, '[' || string_agg('"' || replace(word, '"', chr(92) || '"') || '"', ',' ORDER BY word) || ']' AS words
            FROM listed WHERE n <= 5 GROUP BY alarm_id)
        SELECT a.alarm_id, a.robot, a.template,
               CASE WHEN t.template IS NULL OR t.template_status <> 'ENABLE' THEN 'FAILED' WHEN s.alarm_id IS NOT NULL THEN 'SILENT'
                    ELSE 'SUCCESS' END AS status,
               CASE WHEN t.template IS NULL THEN '模板不存在' WHEN t.template_status <> 'ENABLE' THEN '模板未启用' ELSE s.words END
               AS reason
        FROM robot_alarms a JOIN robots r ON r.robot = a.robot AND r.workspace = a.workspace AND r.status = 'ENABLE' AND r.record_log = 'ENABLE'
        LEFT JOIN templates t ON t.template = a.template AND t.workspace = a.workspace LEFT JOIN silenced s ON s.alarm_id = a.alarm_id""",
    "i14_expand_messages": """
        SELECT message_id, user_id FROM audience_messages, users WHERE scope = 'ALL'
        UNION
        SELECT message_id, user_id FROM audience_messages JOIN users ON cast(team AS STRING) = target WHERE scope = 'WORKSPACE'
        UNION
        SELECT message_id, user_id FROM audience_messages JOIN users ON cast(user_id AS STRING) = target WHERE scope = 'USER'""",
    "i15_parse_log_lines": f"""
        WITH {_LOG}
        SELECT file, line_no, 3 AS lines, timestamp, level, '7' AS process_id, 'flow' AS application, 'main' AS thread, flow_code,
               request_id, logger, message
        FROM heads""",
    "i16_search_run_log": f"""
        WITH {_LOG}
        SELECT file, line_no, timestamp, logger, message FROM heads
        WHERE flow_code = repeat('3', 32) AND level = 'INFO' AND contains(message, 'step 1') AND contains(message, '"k": 1')
        AND timestamp >= '2024-01-03' AND timestamp <= '2024-01-29'
        ORDER BY timestamp DESC, file DESC, line_no DESC LIMIT 5000""",
}
