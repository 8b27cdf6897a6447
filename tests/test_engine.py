"""The semantic engine against DuckDB, its own invariants, and its refusals."""

import re
from pathlib import Path

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import Engine, FanoutError, SemanticError, demo, load
from tessella.queries import ORACLE, QUERIES
from tessella.sources.tables import folder, frames

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="session")
def engine(spark, sf):
    return Engine(demo.model(), folder(spark, sf))


@pytest.fixture(scope="session")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    try:
        return round(float(v), 4)
    except (TypeError, ValueError):
        return str(v)[:19].replace("T", " ").removesuffix(" 00:00:00")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, oracle, name):
    got = QUERIES[name](spark, sf)
    want = oracle.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def ask(engine, dims=(), measures=(), **more):
    return engine.query({"select": {"dimensions": list(dims), "measures": list(measures)}, **more})


DIMENSIONS = ["Region Name", "Nation Name", "Segment", "Order Status", "Return Flag", "Brand", "Order Year", "Supplier Region Name"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(dims=st.lists(st.sampled_from(DIMENSIONS), min_size=1, max_size=3, unique=True))
def test_groups_add_up_to_the_total(engine, dims):
    whole = ask(engine, (), ["Revenue", "Lineitem Count"]).first()
    parts = ask(engine, dims, ["Revenue", "Lineitem Count", "Total Revenue"]).collect()
    assert sum(r["Lineitem Count"] for r in parts) == whole["Lineitem Count"]
    assert abs(sum(r["Revenue"] for r in parts) - whole["Revenue"]) < len(parts) * 0.01 + 0.01
    assert {r["Total Revenue"] for r in parts} == {whole["Revenue"]}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(segment=st.sampled_from(["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]))
def test_a_filter_and_its_negation_split_the_rows(engine, segment):
    count = lambda op: ask(engine, (), ["Orders"], where=[{"field": "Segment", "op": op, "value": segment}]).first()[0]
    assert count("equals") + count("notequals") == ask(engine, (), ["Orders"]).first()[0]


def test_several_facts_equal_their_own_queries(engine):
    both = {r[0]: (r[1], r[2]) for r in ask(engine, ["Region Name"], ["Order Value", "Event Value"]).collect()}
    orders = dict(ask(engine, ["Region Name"], ["Order Value"]).collect())
    events = dict(ask(engine, ["Region Name"], ["Event Value"]).collect())
    assert both == {k: (orders.get(k), events.get(k)) for k in {*orders, *events}}


@pytest.mark.parametrize(
    ("query", "code"),
    [
        ({"select": {"dimensions": ["Nowhere"]}}, "UNKNOWN_DIMENSION"),
        ({"select": {"measures": ["Nothing"]}}, "UNKNOWN_MEASURE"),
        ({"select": {"measures": ["Orders"]}, "where": [{"field": "No.Where", "op": "equals", "value": 1}]}, "UNKNOWN_FIELD"),
        ({"select": {"measures": ["Orders"]}, "where": [{"field": "Orders", "op": "gt", "value": 1}]}, "MEASURE_IN_WHERE"),
        ({"select": {"measures": ["Orders"]}, "where": [{"field": "Order Status", "op": "resembles", "value": 1}]}, "UNKNOWN_OPERATOR"),
        ({"select": {"measures": ["Orders", "Events"], "dimensions": ["Region Name"]}, "where": [{"field": "Order Status", "op": "equals", "value": "O"}]}, "UNREACHABLE_FILTER"),
        ({"select": {"fields": ["Customer.Name"], "measures": ["Orders"]}}, "RAW_MODE"),
        ({"select": {"measures": ["Orders"]}, "grouping": "rollup"}, "GROUPING"),
        ({"select": {"dimensions": ["Region Name"], "measures": ["Value Month Ago"]}}, "TIME_DIMENSION_NEEDED"),
        ({"select": {"dimensions": ["Return Flag"], "measures": ["Revenue", "Order Value"]}, "grouping": "cube"}, "DEDUP_GROUPING"),
        ({"select": {"dimensions": ["Order Month"], "measures": ["Value Change", "Total Revenue"]}}, "DERIVED_OVER_WINDOW"),
        ({"select": {"dimensions": ["Region Name"], "measures": ["Orders"]}, "orderBy": [{"field": "Segment"}]}, "ORDER_FIELD"),
        ({"select": {"dimensions": ["Region Name"], "measures": ["Orders"]}, "surprise": 1}, "UNKNOWN_KEY"),
        ({"select": {"dimensions": ["Lang", "Region Name"]}}, "UNREACHABLE_REQUIRED_OBJECT"),
    ],
)
def test_refusals(engine, query, code):
    with pytest.raises(SemanticError) as e:
        engine.query(query)
    assert e.value.code == code


def small(spark, joins, **more):
    data = {
        "dataObjects": {
            "A": {"code": "a", "columns": {"Id": {"code": "id", "abstractType": "int", "primaryKey": True}, "B": {"code": "b", "abstractType": "int"}, "V": {"code": "v", "abstractType": "int"}}, "joins": joins},
            "B": {"code": "b", "columns": {"Id": {"code": "id", "abstractType": "int", "primaryKey": True}, "N": {"code": "n", "abstractType": "string"}}},
        },
        "dimensions": {"N": {"dataObject": "B", "column": "N"}, "A Id": {"dataObject": "A", "column": "Id"}},
        "measures": {"V": {"aggregation": "sum", "columns": [{"dataObject": "A", "column": "V"}], "resultType": "int"}},
        **more,
    }
    a = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 9, 40)], "id long, b long, v long")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "id long, n string")
    return Engine(data, frames({"a": a, "b": b}))


JOIN = {"joinType": "many-to-one", "joinTo": "B", "columnsFrom": ["B"], "columnsTo": ["Id"]}


def test_left_and_required_joins(spark):
    assert dict(small(spark, [JOIN]).query({"select": {"dimensions": ["N"], "measures": ["V"]}}).collect()) == {"x": 30, None: 40}
    assert dict(small(spark, [JOIN | {"required": True}]).query({"select": {"dimensions": ["N"], "measures": ["V"]}}).collect()) == {"x": 30}


def test_many_to_many_is_refused_unless_allowed(spark):
    join = JOIN | {"joinType": "many-to-many"}
    with pytest.raises(FanoutError):
        small(spark, [join]).query({"select": {"dimensions": ["N"], "measures": ["V"]}})
    allowed = {"V": {"aggregation": "sum", "columns": [{"dataObject": "A", "column": "V"}], "resultType": "int", "allowFanOut": True}}
    assert dict(small(spark, [join], measures=allowed).query({"select": {"dimensions": ["N"], "measures": ["V"]}}).collect())["x"] == 30


def test_secondary_path_replaces_the_primary(spark):
    other = JOIN | {"columnsFrom": ["Id"], "secondary": True, "pathName": "own"}
    got = small(spark, [JOIN, other]).query({"select": {"dimensions": ["N"], "measures": ["V"]}, "usePathNames": [{"source": "A", "target": "B", "pathName": "own"}]})
    assert dict(got.collect()) == {"x": 10, "y": 20, None: 40}


def test_ambiguous_path_is_refused_and_via_decides(spark):
    objects = {n: {"code": n.lower(), "columns": {"K": {"code": "k", "abstractType": "int", "primaryKey": True}, "V": {"code": "v", "abstractType": "int"}}} for n in "ABCD"}
    to = lambda n: {"joinType": "many-to-one", "joinTo": n, "columnsFrom": ["K"], "columnsTo": ["K"]}
    objects["A"]["joins"], objects["B"]["joins"], objects["C"]["joins"] = [to("B"), to("C")], [to("D")], [to("D")]
    model = {"dataObjects": objects, "dimensions": {"D": {"dataObject": "D", "column": "V"}, "D by C": {"dataObject": "D", "column": "V", "via": "C"}}, "measures": {"V": {"aggregation": "sum", "columns": [{"dataObject": "A", "column": "V"}]}}}
    row = spark.createDataFrame([(1, 7)], "k long, v long")
    e = Engine(model, frames({n: row for n in "abcd"}))
    with pytest.raises(SemanticError, match="AMBIGUOUS_JOIN_PATH"):
        e.query({"select": {"dimensions": ["D"], "measures": ["V"]}})
    assert e.query({"select": {"dimensions": ["D by C"], "measures": ["V"]}}).first()[0] == 7


def test_static_filters_apply_once_and_skip_what_they_cannot_reach(spark):
    e = small(spark, [JOIN], filters=[{"dataObject": "A", "column": "V", "operator": "lt", "value": 40}])
    assert e.query({"select": {"measures": ["V"]}}).first()[0] == 30
    made = e.compile({"select": {"dimensions": ["N"]}})
    assert [r[0] for r in made.df.collect()] and any("STATIC_FILTER_SKIPPED" in w for w in made.warnings)


def test_nested_rows(spark):
    rows = [(7, 3, [("lake", 30), ("pass", 90), ("town", 15)], [4.5]), (8, 1, [], [2.0, 2.0, 6.0]), (9, 2, [("lake", 20)], []), (10, 5, [("lake", 10), ("lake", 5)], [1.25, 0.75])]
    data = spark.createDataFrame(rows, "trip int, riders int, stops array<struct<place:string,minutes:int>>, tolls array<double>").withColumn("tolls", F.transform("tolls", lambda t: F.struct(t.alias("paid"))))
    model = {
        "dataObjects": {
            "Trip": {"code": "trips", "columns": {"No": {"code": "trip", "abstractType": "int", "primaryKey": True}, "Riders": {"code": "riders", "abstractType": "int"}}},
            "Stop": {"nestedIn": {"dataObject": "Trip", "column": "stops"}, "columns": {"Place": {"code": "place", "abstractType": "string"}, "Minutes": {"code": "minutes", "abstractType": "int"}}},
            "Toll": {"nestedIn": {"dataObject": "Trip", "column": "tolls"}, "columns": {"Paid": {"code": "paid", "abstractType": "float"}}},
        },
        "dimensions": {"Place": {"dataObject": "Stop", "column": "Place"}, "Trip No": {"dataObject": "Trip", "column": "No"}},
        "measures": {
            "All Riders": {"aggregation": "sum", "columns": [{"dataObject": "Trip", "column": "Riders"}]}, "Longest Stop": {"aggregation": "max", "columns": [{"dataObject": "Stop", "column": "Minutes"}]},
            "Rest": {"aggregation": "sum", "columns": [{"dataObject": "Stop", "column": "Minutes"}]}, "Tolls": {"aggregation": "sum", "columns": [{"dataObject": "Toll", "column": "Paid"}]},
        },
    }
    e = Engine(model, frames({"trips": data}))
    asked = e.query({"select": {"dimensions": ["Place"], "measures": ["All Riders", "Rest", "Longest Stop"]}})
    # a trip with two stops at one place has its riders counted once there
    assert {r[0]: tuple(r)[1:] for r in asked.collect()} == {"lake": (10, 65, 30), "pass": (3, 90, 90), "town": (3, 15, 15), None: (1, None, None)}
    assert {r[0]: r[1] and float(r[1]) for r in e.query({"select": {"dimensions": ["Trip No"], "measures": ["Tolls"]}}).collect()} == {7: 4.5, 8: 10.0, 9: None, 10: 2.0}
    with pytest.raises(SemanticError):
        e.query({"select": {"dimensions": ["Place"], "measures": ["Tolls"]}})


def test_subtotals_beside_totals_and_contexts(engine):
    rows = engine.query({"select": {"dimensions": ["Region Name", "Segment"], "measures": ["Revenue", "Total Revenue", "Region Revenue", "All Flags Revenue"]}, "where": [{"field": "Return Flag", "op": "equals", "value": "R"}], "grouping": "rollup"}).collect()
    total = next(r for r in rows if r["_g_Region Name"])
    assert {r["Total Revenue"] for r in rows} == {total["Revenue"]}
    regions = {r["Region Name"]: r for r in rows if r["_g_Segment"] and not r["_g_Region Name"]}
    assert all(r["Region Revenue"] == (total if r["_g_Region Name"] else regions[r["Region Name"]])["Revenue"] for r in rows)
    assert abs(sum(r["All Flags Revenue"] for r in regions.values()) - total["All Flags Revenue"]) < 1 and total["All Flags Revenue"] > total["Revenue"]


def test_a_query_leaves_the_model_as_it_was(engine):
    before = sorted(engine.model.measures)
    engine.query({"select": {"dimensions": ["Region Name"], "measures": ["Total Average Price"]}}).collect()
    assert sorted(engine.model.measures) == before
    with pytest.raises(SemanticError, match="DUPLICATE_FIELD"):
        engine.query({"select": {"dimensions": ["Region Name", "Region Name"], "measures": ["Revenue"]}})


def test_totals_and_periods_hold_their_groups_until_released(spark, engine):
    asked = {"select": {"dimensions": ["Nation Name"], "measures": ["Revenue", "Total Revenue"]}}
    df = engine.query(asked)
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    engine.tables_touched(asked)
    engine.explain(asked)
    held = lambda: "InMemoryRelation" in engine._planned(asked, engine.tables).df._jdf.queryExecution().withCachedData().toString()
    assert held()
    engine.release()
    assert not held()


def test_composition(tmp_path):
    (tmp_path / "kpis.yaml").write_text("measures:\n  Twice: {aggregation: sum, expression: '2 * {[A].[V]}'}\n")
    (tmp_path / "parent.yaml").write_text("dataObjects:\n  A: {code: a, columns: {V: {code: v, abstractType: int}}}\n")
    (tmp_path / "main.yaml").write_text("extends: kpis.yaml\ndataObjects:\n  A: {code: a, columns: {V: {code: v, abstractType: int}}}\n")
    (tmp_path / "child.yaml").write_text("inherits: parent.yaml\ndataObjects:\n  A: {columns: {W: {code: w, abstractType: int}}}\n")
    (tmp_path / "loop.yaml").write_text("inherits: loop.yaml\n")
    assert "Twice" in load(tmp_path / "main.yaml").measures
    assert set(load(tmp_path / "child.yaml").data_objects["A"].columns) == {"V", "W"}
    for bad in ("loop.yaml",):
        with pytest.raises(SemanticError, match="COMPOSITION"):
            load(tmp_path / bad)


def test_plans_read_only_what_they_need(engine):
    text = engine.explain({"select": {"dimensions": ["Order Status"], "measures": ["Order Value"]}})
    assert "ReadSchema: struct<o_totalprice:double,o_orderstatus:string>" in text or "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in text
    assert "Join" not in text
    pushed = engine.explain({"select": {"measures": ["Orders"]}, "where": [{"field": "Order Status", "op": "equals", "value": "O"}]})
    assert "EqualTo(o_orderstatus,O)" in pushed


def test_both_grains_in_one_pass_equal_two(engine):
    one = engine.compile({"select": {"dimensions": ["Return Flag"], "measures": ["Average Price", "Average Line", "Largest Price", "Lineitem Count", "Order Value"]}})
    alone = {r[0]: r for r in ask(engine, ["Return Flag"], ["Average Price", "Average Line", "Largest Price", "Lineitem Count"]).collect()}
    for r in one.df.collect():
        assert tuple(r)[:5] == tuple(alone[r[0]])
    assert one.df._jdf.queryExecution().toString().count("lineitem.parquet") <= 4  # once in each of the four plans


@pytest.mark.parametrize("threshold", ["10m", "-1"])
@pytest.mark.parametrize("name", ["dedup_one_side", "dedup_two_objects", "metric_across_grains"])
def test_rows_counted_once_take_tasks_by_the_size_of_the_fact(spark, sf, oracle, name, threshold, monkeypatch):
    from tessella.plans import planner

    monkeypatch.setattr(planner, "TASK_BYTES", 4096, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = QUERIES[name](spark, sf)
        sorts = df._jdf.queryExecution().executedPlan().toString()
        con = oracle.execute(ORACLE[name])
        assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in con.description], con.fetchall())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    size = Path(sf, "lineitem.parquet").stat().st_size
    keyed = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", sorts)
    by_key = [int(n) for k, n in keyed if re.search(r"Order Key|Cust Key|Orders.{1,3}0|Customer.{1,3}0", k)]
    assert by_key and set(by_key) == {-(-size // 4096)}


def test_periods_share_one_aggregation(engine):
    df = engine.query({"select": {"dimensions": ["Order Month"], "measures": ["Order Value", "Value Month Ago", "Value Year Ago"]}})
    assert df._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") == 4
