from datetime import date, datetime

from pyspark.sql import functions as F

from sluice.operators import monitor as m

T0 = datetime(2024, 1, 1, 10, 0, 0)


def test_live_instances_is_strict(spark, rows):
    beats = spark.createDataFrame([("a", datetime(2024, 1, 1, 9, 59, 30)), ("b", datetime(2024, 1, 1, 9, 59, 31))], "instance string, ts timestamp_ntz")
    assert rows(m.live_instances(beats, T0), "instance") == [("b",)]


def test_alarm_statistics_buckets(spark, rows):
    log = spark.createDataFrame([("w", s, datetime(2024, 1, 1, 10, mi)) for s, mi in [("SUCCESS", 1), ("FAILED", 1), ("SENDING", 2), ("SILENT", 2)]],
                                "workspace string, status string, create_time timestamp_ntz")
    out = rows(m.alarm_statistics(log, "minute", T0, datetime(2024, 1, 1, 11), "w"))
    assert out == [(datetime(2024, 1, 1, 10, 1), 1, 1, 0), (datetime(2024, 1, 1, 10, 2), 0, 0, 1)]


def test_panels(spark):
    flows = spark.createDataFrame([("ENABLE", 1), ("PAUSE", 1), ("TBP", None), ("ENABLE", None)], "status string, publish_version int")
    assert tuple(m.status_panel(flows).first()) == (1, 2, 1)
    checks = spark.createDataFrame([("a", T0, True), ("b", T0, False), ("a", datetime(2023, 1, 1), True)], "source string, check_time timestamp_ntz, ok boolean")
    out = m.source_panel(checks, date(2024, 1, 1)).first()
    assert (out["sources"], out["last_check"], float(out["today_success_rate"])) == (2, T0, 50.0)


def test_last_errors_and_clear_trailing(spark, rows, plan):
    errors = spark.createDataFrame([("f", i, "A" if i in (1, 2, 5, 6, 7) else "B") for i in range(8)] + [("g", 1, "A")], "flow string, seq int, type string")
    newest = m.last_errors(errors)
    assert rows(newest.filter("flow = 'f'"), "seq") == [(3,), (4,), (5,), (6,), (7,)]
    assert "WindowGroupLimit" in plan(newest)
    assert rows(m.clear_trailing(errors, "A"), "flow", "seq") == [("f", i) for i in range(5)]
    lost = spark.createDataFrame([(None, i, "A" if i == 2 else "B") for i in range(3)], "flow string, seq int, type string")
    assert rows(m.clear_trailing(errors.union(lost), "A"), "flow", "seq") == [(None, 0), (None, 1)] + [("f", i) for i in range(5)]


def test_route_alarms(spark, rows):
    alarms = spark.createDataFrame([(1, "s", "down", None), (2, "s", "down", "w1"), (3, "s", "up", "w1")], "alarm_id int, server string, scene string, workspace string")
    scenes = spark.createDataFrame([("s", "down", "w1", "c1", "r", "t", "ENABLE"), ("s", "down", "w2", "c2", "r", "t", "ENABLE"), ("s", "down", "w1", "c3", "r", "t", "DISABLE")],
                                   "server string, scene string, workspace string, scene_code string, robot string, template string, status string")
    assert rows(m.route_alarms(alarms, scenes), "alarm_id", "workspace", "scene_code") == [(1, "w1", "c1"), (1, "w2", "c2"), (2, "w1", "c1")]


def test_built_in_parameters_do_not_override(spark):
    alarms = spark.createDataFrame([("q", "srv", T0, {"$requestId": "own", "x": "1"}, "${$requestId} ${$serverName} ${$alarmTime} ${x} ${$sceneCode}")],
                                   "request_id string, server string, alarm_time timestamp_ntz, params map<string,string>, template_content string")
    assert m.render(alarms).first()["text"] == "own srv 2024-01-01 10:00:00 1 "


def test_silence(spark, rows):
    alarms = spark.createDataFrame([(1, "r", "disk full on a b c d e f", T0), (2, "r", "ok", T0), (3, "none", "disk", T0)], "id int, robot string, text string, alarm_time timestamp_ntz")
    rules = spark.createDataFrame([("r", ["disk", "full"], None), ("r", ["disk"], None), ("r", ["ok"], datetime(2023, 1, 1)), ("r", list("abcdef"), T0)],
                                  "robot string, keywords array<string>, expire timestamp_ntz")
    got = {r["id"]: (r["silent"], r["hits"]) for r in m.silence(alarms, rules, ()).collect()}
    assert got == {1: (True, ["a", "b", "c", "d", "disk"]), 2: (False, []), 3: (False, [])}


def test_hits_of_many_keywords_equal_a_plain_search(spark):
    import random

    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    later, earlier = datetime(2024, 1, 9), datetime(2024, 1, 1)
    rules = [(rng.choice("xy"), rng.choice(["r1", "r2"]), [text(rng.randint(1, 9)) for _ in range(rng.randint(0, 6))], rng.choice([None, T0, later, earlier])) for _ in range(300)]
    rules += [("x", "r3", ["", None, "zz"], None), (None, "r1", ["a"], None), ("y", "r1", None, None), ("x", "r2", ["same"], earlier), ("x", "r2", ["same"], later)]
    alarms = [(i, rng.choice("xy"), rng.choice(["r1", "r2", "r2", "gone"]), text(rng.randint(0, 60)) + rng.choice(["", "same"]), rng.choice([T0, None])) for i in range(200)]
    alarms += [(900, "x", "r3", "any", T0), (901, "x", "r3", "", T0), (902, "x", "r3", None, T0), (903, None, "r1", "a", T0), (904, "x", "r2", "l" * 50_000 + "same", T0), alarms[3]]
    got = m.silence(spark.createDataFrame(alarms, "id int, workspace string, robot string, text string, alarm_time timestamp_ntz").repartition(4),
                    spark.createDataFrame(rules, "workspace string, robot string, keywords array<string>, expire timestamp_ntz"))
    wanted = []
    for i, workspace, robot, said, at in alarms:
        words = {k for w, r, found, until in rules if workspace is not None and (w, r) == (workspace, robot) and (until is None or (at is not None and until >= at)) for k in found or () if k is not None}
        hits = sorted(k for k in words if said is not None and k in said)[:5]
        wanted.append((i, hits, bool(hits)))
    assert sorted((r.id, r.hits, r.silent) for r in got.collect()) == sorted(wanted)


def test_rules_ride_on_no_alarm(spark, plan):
    """100,000 keywords of one robot and a hot robot's alarms: texts meet keywords by rare pieces only."""
    words = spark.range(100_000).select(F.concat(F.lit("word"), F.lpad(F.hex(F.xxhash64("id")), 16, "0")).alias("w"))
    rules = words.select(F.lit("x").alias("workspace"), F.lit("r").alias("robot"), F.array("w").alias("keywords"), F.lit(None).cast("timestamp_ntz").alias("expire"))
    some = words.limit(40).select(F.collect_list("w")).first()[0]
    alarms = spark.range(400).select("id", F.lit("x").alias("workspace"), F.lit("r").alias("robot"), F.lit(T0).cast("timestamp_ntz").alias("alarm_time"),
                                     F.concat(F.lit("text about "), F.get(F.array(*map(F.lit, some)), (F.col("id") % 80).cast("int")), F.lit(" here")).alias("said"))
    alarms = alarms.withColumn("text", F.coalesce("said", F.lit("nothing of the kind"))).drop("said")
    out = m.silence(alarms, rules)
    assert out.where("silent").count() == 200 and out.where("size(hits) = 1").count() == 200
    assert "collect_list" not in plan(out)


def test_deliver(spark, rows):
    robots = spark.createDataFrame([("b", "BROADCAST", ["x", "y"]), ("p", "POLLING", ["x", "y", "z"]), ("r", "RANDOM", ["x", "y"])], "robot string, mode string, receives array<string>")
    alarms = spark.createDataFrame([(i, k) for k in "bpr" for i in range(4)] + [(1, "gone")], "alarm_id int, robot string")
    out = m.deliver(alarms, robots, scope=())
    assert rows(out.filter("robot = 'p'"), "alarm_id", "receiver") == [(0, "y"), (1, "z"), (2, "x"), (3, "y")]
    assert out.filter("robot = 'b'").count() == 8 and out.filter("robot = 'r'").count() == 4
    assert rows(out) == rows(m.deliver(alarms, robots, scope=()))  # repeatable


def test_alarm_outcome(spark, rows):
    alarms = spark.createDataFrame([(i, r, t, "w", T0, {"k": "v"}) for i, (r, t) in enumerate([("on", "t"), ("off", "t"), ("gone", "t"), ("on", "none"), ("on", "toff"), ("quiet", "t"), ("mute", "t")])],
                                   "alarm_id int, robot string, template string, workspace string, alarm_time timestamp_ntz, params map<string,string>")
    robots = spark.createDataFrame([("on", "ENABLE", "ENABLE"), ("off", "DISABLE", "ENABLE"), ("quiet", "ENABLE", "DISABLE"), ("mute", "ENABLE", "ENABLE")], "robot string, status string, record_log string")
    templates = spark.createDataFrame([("t", "value ${k}", "ENABLE"), ("toff", "", "DISABLE")], "template string, template_content string, status string")
    rules = spark.createDataFrame([("mute", ["value v", "y" * 3000], None)], "robot string, keywords array<string>, expire timestamp_ntz")
    assert rows(m.alarm_outcome(alarms, robots, templates, rules, ()), "alarm_id", "status", "reason") == [
        (0, "SUCCESS", None), (3, "FAILED", "模板不存在"), (4, "FAILED", "模板未启用"), (6, "SILENT", '["value v"]'),
    ]
    long = spark.createDataFrame([("mute", ["value " + "v" * 3000], None)], rules.schema)
    texts = spark.createDataFrame([(1, "mute", "t", "w", T0, {"k": "v" * 3000})], alarms.schema)
    assert len(m.alarm_outcome(texts, robots, templates, long, ()).first()["reason"]) == 2003


def test_expand_messages(spark, rows):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    members = spark.createDataFrame([(1, "w"), (1, "w"), (2, "w"), (9, "w")], "user_id int, workspace string")
    messages = spark.createDataFrame([("m1", "ALL", None), ("m2", "WORKSPACE", "w"), ("m3", "USER", "3"), ("m3", "USER", "3"), ("m4", "USER", "77")], "message_id string, scope string, target string")
    assert rows(m.expand_messages(messages, users, members)) == [("m1", 1), ("m1", 2), ("m1", 3), ("m2", 1), ("m2", 2), ("m3", 3)]


HEAD = "2024-01-01 10:00:00.123  INFO 1 --- [app] [main] [%s] [%s] a.B : " % ("f" * 32, " " * 32)


def test_parse_log_lines(spark):
    lines = ["orphan", HEAD + "hello", "  at x", "  at y", "2024-01-01T10:00:01.000 WARN 1 --- [app] [t 1] [" + "b" * 32 + "] c.D : one field", HEAD + "last"]
    df = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(lines)], "file string, line_no long, text string")
    for chunk in (2, 3, 100):  # records run over chunk borders
        out = {r["line_no"]: r for r in m.parse_log_lines(df, chunk=chunk).collect()}
        assert sorted(out) == [1, 2, 5, 6]
        assert out[1]["level"] is None and out[1]["message"] == "orphan"
        assert (out[2]["message"], out[2]["lines"], out[2]["flow_code"], out[2]["request_id"]) == ("hello\n  at x\n  at y", 3, "f" * 32, None)
        assert (out[5]["thread"], out[5]["flow_code"], out[5]["request_id"], out[5]["logger"]) == ("t 1", None, "b" * 32, "c.D")


def test_log_record_longer_than_the_limit_goes_on(spark):
    lines = [HEAD + "x"] + ["more"] * 250
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no long, text string")
    out = sorted(m.parse_log_lines(df, chunk=7).collect(), key=lambda r: r["line_no"])
    assert [r["lines"] for r in out] == [100, 100, 51] and sum(r["message"].count("more") for r in out) == 250


def test_search_run_log(spark):
    logs = spark.createDataFrame([("f", i, f"2024-01-01 10:00:0{i}.000", "INFO", "c", None, f"msg {i} word") for i in range(9)],
                                 "file string, line_no int, timestamp string, level string, flow_code string, request_id string, message string")
    out = m.search_run_log(logs, {"flow_code": "c", "keywords": ["msg", "word"], "start": "2024-01-01 10:00:03"}, limit=2)
    assert [r["line_no"] for r in out.collect()] == [8, 7]
    assert m.search_run_log(logs, {"keywords": ["msg 1", "msg 2"]}).count() == 0


def test_instance_series(spark):
    samples = spark.createDataFrame([("a", datetime(2024, 1, 1, 9, 55), 2.0), ("a", datetime(2024, 1, 1, 9, 58), 1.0), ("a", datetime(2024, 1, 1, 9, 50), 7.0), ("b", datetime(2024, 1, 1, 8), 3.0), ("a", datetime(2024, 1, 1, 11), 9.0)],
                                    "instance string, ts timestamp_ntz, value double")
    got = {r["instance"]: tuple(r)[1:] for r in m.instance_series(samples, T0).collect()}
    assert got == {"a": (1.0, ["09:55:00", "09:58:00"], [2.0, 1.0]), "b": (3.0, [], [])}


def test_codes_belong_to_their_workspace(spark, rows):
    alarms = spark.createDataFrame([(1, "a", "r", "disk", T0), (2, "b", "r", "disk", T0), (3, "b", "r", "disk", T0)],
                                   "alarm_id int, workspace string, robot string, text string, alarm_time timestamp_ntz")
    rules = spark.createDataFrame([("a", "r", ["disk"], None)], "workspace string, robot string, keywords array<string>, expire timestamp_ntz")
    assert [r["silent"] for r in m.silence(alarms, rules).orderBy("alarm_id").collect()] == [True, False, False]
    robots = spark.createDataFrame([("a", "r", "POLLING", ["x", "y"]), ("b", "r", "POLLING", ["x", "y"])], "workspace string, robot string, mode string, receives array<string>")
    assert rows(m.deliver(alarms, robots), "alarm_id", "receiver") == [(1, "y"), (2, "y"), (3, "x")]


def test_pieces_of_a_long_record_keep_its_header(spark):
    head = "2024-01-01 10:00:00.000 INFO 7 --- [app] [main] [" + "a" * 32 + "] [" + "b" * 32 + "] log.X : first"
    lines = spark.createDataFrame([("f", i, head if i == 0 else f"line {i}") for i in range(7)], "file string, line_no long, text string")
    found = m.parse_log_lines(lines, max_lines=3).orderBy("line_no").collect()
    assert [r["lines"] for r in found] == [3, 3, 1] and {r["flow_code"] for r in found} == {"a" * 32}
    assert found[1]["message"] == "line 3\nline 4\nline 5"


def test_times_of_a_range_are_times(spark):
    log = spark.createDataFrame([("2024-01-29T09:00:00.000",), ("2024-01-29|09:30:00.000",), ("2024-01-29 11:00:00.000",)], "timestamp string").selectExpr(
        "timestamp", "'f' file", "1 line_no")
    assert m.search_run_log(log, {"start": "2024-01-29 08:00:00", "end": "2024-01-29T10:00:00"}).count() == 2
