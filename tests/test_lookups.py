import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluice import plans
from sluice.operators import graph as g, relational as r, templates as tp
from sluice.sources import tables


def test_template_query(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    out = tp.template_query(spark, "SELECT id FROM numbers WHERE id > ${low}", {"low": 2, "other": 1})
    assert [x["id"] for x in out.collect()] == [3, 4]
    with pytest.raises(ValueError, match="low"):
        tp.template_query(spark, "SELECT ${low}", {})
    # a value never becomes SQL
    assert tp.template_query(spark, "SELECT ${v} AS v", {"v": "1; DROP TABLE x"}).first()["v"] == "1; DROP TABLE x"


def test_dynamic_where(spark):
    df = spark.range(10)
    conditions = [("low", lambda v: F.col("id") >= v), ("name", lambda v: F.lit(False)), ("ids", lambda v: F.col("id").isin(v))]
    assert tp.dynamic_where(df, conditions, {"low": 0, "name": "  ", "ids": []}).count() == 10
    assert tp.dynamic_where(df, conditions, {"low": 3, "ids": [1, 4]}).count() == 1


def test_page_with_total(spark, rows):
    df = spark.range(25)
    assert rows(tp.page_with_total(df, 3, 10, [("id", True)])) == [(i, 25) for i in range(5)]
    assert [tuple(r) for r in tp.page_with_total(df, 9, 10, [("id", True)]).collect()] == [(None, 25)]
    with pytest.raises(ValueError):
        tp.page_with_total(df)
    assert tp.query_one(df).count() == 1 and tp.query_list(df) is df and tp.query_count(df).first()[0] == 25


def test_query_log_stats(spark):
    log = spark.createDataFrame([("a", 1.0, 5, True, "SUCCESS"), ("a", 2.0, 0, False, "FAIL")],
                                "template string, cost double, number long, hit_cache boolean, status string")
    out = tp.query_log_stats(log).first()
    assert (out["calls"], out["errors"], out["cache_hits"], out["rows"], float(out["avg_cost"]), float(out["hit_rate"])) == (2, 1, 1, 5, 1.5, 50.0)


def test_distinct_join(spark, rows):
    tables = {
        "u": spark.createDataFrame([(1, "r1"), (2, "r1")], "user int, role string"),
        "l": spark.createDataFrame([("r1", 1), ("r1", 2), ("r1", 2)], "lrole string, perm int"),
        "p": spark.createDataFrame([(1, "A", 1), (2, "B", 0)], "pid int, code string, enabled int"),
    }
    out = r.distinct_join(tables, [("u", "", ""), ("l", "lrole", "role"), ("p", "pid", "perm")], {"p": "enabled = 1"}, ["user", "code"])
    assert rows(out) == [(1, "A"), (2, "A")]


@pytest.mark.parametrize("hot", [False, True])
def test_distinct_join_spreads_the_rows_of_few_links(spark, rows, plan, monkeypatch, hot):
    """Two links, of which one holds nearly all rows; with ``hot`` one kept value has more pairs than a task should make."""
    monkeypatch.setattr(r, "PAIRS", 200, raising=False)
    users = spark.range(1000).selectExpr("if(%s, 7, id) AS user" % hot, "concat('r', if(id = 5, 1, 0)) AS role", "id AS other")
    users = users.unionByName(spark.sql("SELECT 7L AS user, 'r1' AS role, 0L AS other UNION ALL SELECT 8L, NULL, 0L"))
    codes = spark.range(20).selectExpr("concat('c', id % 4) AS code", "id AS pid")
    links = spark.range(300 if hot else 20).selectExpr("id %% %s AS perm" % (300 if hot else 20), "concat('r', id % 2) AS lrole")
    if hot:
        codes = spark.range(300).selectExpr("concat('c', id) AS code", "id AS pid")
    tables = {"u": users, "l": links, "p": codes}
    out = r.distinct_join(tables, [("p", "", ""), ("l", "perm", "pid"), ("u", "role", "lrole")], {}, ["user", "code"])
    for name, df in tables.items():
        df.createOrReplaceTempView(f"spread_{name}")
    wanted = spark.sql("SELECT DISTINCT user, code FROM spread_p JOIN spread_l ON perm = pid JOIN spread_u ON role = lrole")
    assert rows(out) == rows(wanted)
    if not hot:  # 2,004 pairs or so; each is made and made distinct in one of eleven tasks
        assert out.rdd.getNumPartitions() >= 10 and max(len(p) for p in out.rdd.glom().collect()) <= 400


def test_exists_any_and_not_in(spark, rows):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, code string")
    assert rows(r.exists_any(left, links, "k", "code", ["a", "b"])) == [(None, False), (1, True), (2, False)]
    assert rows(r.not_in(left, links.filter("code = 'c'"), "k")) == [(None,), (1,)]
    assert r.not_in(left, links.limit(0), "k").count() == 3


def test_conditional_counts_over_no_rows(spark):
    df = spark.createDataFrame([], "is_read int")
    assert tuple(r.conditional_counts(df, {"unread": "is_read = 0"}).first()) == (0, None)


def test_custom_order(spark):
    df = spark.createDataFrame([("c", 1), ("a", 1), ("a", 2), ("z", 9)], "s string, t int")
    assert [tuple(x) for x in r.custom_order(df, "s", {"a": 1, "c": 2}, [("t", True)]).collect()] == [("a", 2), ("a", 1), ("c", 1), ("z", 9)]


def test_enrich_keeps_rows_without_match(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (None,)], "uid int")
    users = spark.createDataFrame([(1, "ann")], "id int, name string")
    assert rows(r.enrich(df, users, "uid", ["name"], "id")) == [(None, None), (1, "ann"), (2, None)]


def test_contributors(spark):
    records = spark.createDataFrame([(1, 5), (2, 5), (3, 9)], "record_id int, creator int")
    log = spark.createDataFrame([(1, u) for u in (8, 7, 5, 1, 2, 3, 4, 7, 7)] + [(2, 5), (2, 7)], "record_id int, user_id int")
    got = {x["record_id"]: x["users"] for x in r.contributors(records, log, 7).collect()}
    assert got == {1: [5, 7, 1, 2, 3, 4], 2: [5, 7], 3: [9]}


def test_contributors_prune_before_the_shuffle(spark, plan):
    records = spark.range(10).select(F.col("id").alias("record_id"), F.col("id").alias("creator"))
    log = spark.range(1000).select((F.col("id") % 10).alias("record_id"), F.col("id").alias("user_id"))
    assert "WindowGroupLimit" in plan(r.contributors(records, log, 1))


def test_version_join(spark, rows):
    records = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "code string, publish_version int")
    versions = spark.createDataFrame([("a", 1, "ENABLE", "x"), ("a", 2, "HISTORY", "y")], "code string, version int, status string, tag string")
    assert rows(r.version_join(records, versions, ["ENABLE"], ["tag"]), "code", "publish_version", "tag") == [("a", 1, "x"), ("a", 2, None), ("b", None, None)]


def test_json_lookups(spark, rows):
    df = spark.createDataFrame([(1, '["a","b"]'), (2, '["ab"]'), (3, None), (4, "bad")], "id int, codes string")
    assert rows(r.json_contains(df, "codes", "a"), "id") == [(1,)]
    text = r'{"ds":"x","deep":[{"a":{"ds":"y"}},{"ds":" "},{"ds":"x"}],"note":"\"ds\":\"no\"","esc":{"ds":"q\"uote"},"n":{"ds":5},"myds":"z"}'
    docs = spark.createDataFrame([(1, text)], "id int, j string")
    assert rows(r.json_values(docs, "j", "ds")) == [(1, 'q"uote'), (1, "x"), (1, "y")]


def test_check_references(spark, rows):
    refs = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "code string")
    registry = spark.createDataFrame([("a", "ENABLE"), ("b", "DISABLE")], "code string, status string")
    assert rows(r.check_references(refs, registry, "code")) == [("b", "DISABLED"), ("c", "MISSING")]


def test_text_search_has_no_wildcards(spark):
    df = spark.createDataFrame([("a%b", "x"), ("aXb", "a%"), ("q", "q")], "s string, t string")
    assert r.text_search(df, ["s", "t"], "a%").count() == 2


def test_retain_bounds(spark, rows):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), None), (2, datetime(2024, 1, 2), datetime(2024, 1, 9)), (3, datetime(2024, 1, 3), datetime(2024, 1, 10))],
                               "id int, ts timestamp_ntz, e timestamp_ntz")
    now = datetime(2024, 1, 10)
    assert rows(r.retain(df, now, ts="ts", days=8), "id") == [(2,), (3,)]
    assert rows(r.retain(df, now, expiry="e"), "id") == [(1,), (3,)]


def test_groups_to_lists(spark):
    df = spark.createDataFrame([("s", "b", None), ("s", "a", "first"), ("s", "a", "first"), ("t", "z", " ")], "g string, c string, m string")
    got = {x["g"]: [tuple(c) for c in x["children"]] for x in r.nest_groups(df, "g", "c", "m").collect()}
    assert got == {"s": [("a", "a(first)"), ("b", "b")], "t": [("z", "z")]}
    index = spark.createDataFrame([("i", 2, "y", True), ("i", 1, "x", True)], "name string, seq int, col string, uniq boolean")
    assert r.ordered_group_columns(index, ["name"], "seq", "col", ["uniq"]).first()["columns"] == ["x", "y"]


def test_describe_source(spark, rows):
    tables = {"t": spark.createDataFrame([(1, None)], "a int, b string"), "sys": spark.range(1)}
    assert rows(r.describe_source(spark, tables, ["sys"]), "table_name", "position", "column_name", "type") == [("t", 1, "a", "int"), ("t", 2, "b", "string")]
    assert rows(r.describe_source(spark, tables, ["sys"], True), "column_name", "nulls") == [("a", 0), ("b", 1)]


def test_catalog_tables(spark):
    spark.range(3).createOrReplaceTempView("listed_view")
    tables = r.catalog_tables(spark)
    assert tables["listed_view"].count() == 3
    assert "listed_view" not in r.catalog_tables(spark, exclude=[d.name for d in spark.catalog.listDatabases()])


def test_record_authority(spark, rows):
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    grants = spark.createDataFrame([(1, "FLOW", 5, True, False), (2, "FLOW", 6, True, True)], "user_id int, record_type string, record_id int, can_write boolean, can_publish boolean")
    assert rows(r.record_authority(users, grants, "FLOW", 5)) == [(1, True, False), (2, False, False)]


DESIGN = '''{"nodes":[{"id":"a","type":"job","properties":{"cron":"* *"}},{"id":"b","type":"queryMySQL"},{"id":"x","type":"alien"},
 {"id":"d","type":"writeMySQL"}],"edges":[{"id":"1","sourceNodeId":"a","targetNodeId":"b","properties":{"order":2}},
 {"id":"2","sourceNodeId":"a","targetNodeId":"d"},{"id":"3","sourceNodeId":"a","targetNodeId":"c"}]}'''


def test_design_graph(spark, rows):
    docs = spark.createDataFrame([("f", DESIGN)], "design string, text string")
    nodes, edges = g.parse_design(docs)
    assert rows(nodes, "id", "properties")[0] == ("a", '{"cron":"* *"}')
    assert rows(edges, "target", "order") == [("b", 2), ("c", 0), ("d", 0)]
    assert rows(g.graph_roots(edges)) == [("f", "a")]
    groups = g.successor_groups(edges).first()["successors"]
    assert [(x["order"], x["targets"]) for x in groups] == [(0, ["c", "d"]), (2, ["b"])]
    assert rows(g.dead_ends(nodes, edges), "id", "problem") == [("b", "NO_SUCCESSOR"), ("x", "UNKNOWN_TYPE")]
    bare = nodes.limit(1).withColumn("design", F.lit("bare")).withColumn("type", F.lit("map"))
    assert rows(g.dead_ends(nodes.union(bare), edges).where("id IS NULL"), "design", "problem") == [("bare", "NO_EDGES")]


def test_reachable_with_cycle(spark, rows):
    edges = spark.createDataFrame([("f", s, t, 0) for s, t in [("a", "b"), ("b", "c"), ("c", "b"), ("a", "c"), ("x", "x")]], "design string, source string, target string, order int")
    assert rows(g.reachable(edges), "root", "node", "depth") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1)]


def test_placeholders_in_literals_are_refused(spark):
    for text in ("SELECT '${v}'", 'SELECT "${v}"', "SELECT 'it''s ${v}'", "SELECT r'${v}'"):
        with pytest.raises(ValueError, match="literal"):
            tp.template_query(spark, text, {"v": 1})


def test_json_field_is_a_name(spark, rows):
    from sluice.operators.relational import json_values

    df = spark.createDataFrame([('{"a.b": "yes", "axb": "no", "q": {"a.b": "too"}}',)], "j string")
    assert rows(json_values(df, "j", "a.b")) == [("too",), ("yes",)]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(g, "stage", lambda df, label, real=g.stage: rounds.append(label) or real(df, label))
    chain = spark.range(2000).selectExpr("1 design", "concat('n', id) source", "concat('n', id + 1) target", "0 ord")
    assert g.reachable(chain).selectExpr("max(depth)").first()[0] == 2000
    assert rounds.count("reach") <= 14
    assert g.reachable(chain, 37).selectExpr("max(depth)", "count(*)").first() == (37, 38)


def test_reachable_equals_a_plain_walk(spark, rows):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        pairs = {(rng.randrange(2), rng.randrange(25), rng.randrange(25)) for _ in range(30 + 10 * seed)} | {(2, "r", "h")}
        pairs |= {(2, f"in{i}", "h") for i in range(8)} | {(2, "h", f"out{i}") for i in range(8)} | {(2, f"out{i}", f"in{i}") for i in range(8)}
        pairs |= {(3, f"c{i}", f"c{(i + 1) % 9}") for i in range(9)} | {(3, "start", "c4")}
        wanted = []
        for design in range(4):
            own = [(s, t) for d, s, t in pairs if d == design]
            for root in {s for s, _ in own} - {t for _, t in own}:
                depth, front = {root: 0}, [root]
                while front:
                    front = [t for f in front for s, t in own if s == f and t not in depth and depth.setdefault(t, depth[f] + 1)]
                wanted += [(design, str(root), str(n), d) for n, d in depth.items()]
        frame = spark.createDataFrame([(d, str(s), str(t), 0) for d, s, t in pairs], "design int, source string, target string, order int")
        assert sorted(rows(g.reachable(frame), "design", "root", "node", "depth")) == sorted(wanted)
        assert sorted(rows(g.reachable(frame, 3), "design", "root", "node", "depth")) == sorted(w for w in wanted if w[3] <= 3)
        assert rows(g.reachable(frame, 0)) == sorted({w for w in wanted if w[3] == 0}, key=lambda r: tuple(map(str, r)))


def test_graphs_of_orders_take_one_exchange_into_partitions_of_one_size(spark, plan, monkeypatch):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("given tables are not here")
    monkeypatch.setattr(tables, "TASK_ROWS", 100, raising=False)
    roots = plans.queries()["h2_graph_roots"](spark, folder)
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    text = plan(roots)
    assert text.count("Exchange\n") == 1 or text.count("\nArguments: hashpartitioning") == 1
    assert roots.rdd.getNumPartitions() == -(-n // 100)
    assert tables.place_rows(spark.range(0), "id").count() == 0
