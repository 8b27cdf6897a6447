"""Validation, exploration, the BI front end, results, cache, streaming."""

import pytest

from tessella import Engine, SemanticError, demo, load
from tessella.bisql import translate
from tessella.explore import composable, diagram, find, lineage, metadata
from tessella.sources.cache import ResultCache
from tessella.sources.results import arrow, pattern, rows, save, tsv
from tessella.sources.tables import folder, frames, jdbc
from tessella.streaming.grained import windowed
from tessella.validate import health, validate

QUERY = {"select": {"dimensions": ["Region Name"], "measures": ["Revenue"]}}


@pytest.fixture(scope="module")
def engine(spark, sf):
    return Engine(demo.model(), folder(spark, sf))


def test_the_demo_model_is_valid(engine):
    assert validate(engine.model) == []
    assert health(engine.model)["orphans"] == []


def test_broken_models_are_told_apart():
    column = {"code": "v", "abstractType": "int"}
    broken = load({
        "dataObjects": {"A": {"code": "a", "columns": {"V": column, "X": {"expression": "{Y}", "abstractType": "int"}, "Y": {"expression": "{X}", "abstractType": "int"}}, "joins": [{"joinType": "many-to-one", "joinTo": "B", "columnsFrom": ["V"], "columnsTo": ["W"]}]}, "B": {"code": "b", "columns": {"V": column}, "joins": [{"joinType": "many-to-one", "joinTo": "A", "columnsFrom": ["V"], "columnsTo": ["V"]}]}},
        "dimensions": {"D": {"dataObject": "A", "column": "None"}, "T": {"dataObject": "A", "column": "V", "timeGrain": "month"}},
        "measures": {"M": {"aggregation": "guess", "columns": [{"dataObject": "A", "column": "V"}]}, "C": {"aggregation": "corr", "columns": [{"dataObject": "A", "column": "V"}]}, "L": {"aggregation": "median", "columns": [{"dataObject": "A", "column": "V"}], "total": True}},
        "metrics": {"P": {"expression": "{[Q]} + 1"}, "Q": {"expression": "{[P]} + 1"}, "R": {"expression": "{[Nothing]}"}},
    })
    codes = {i.code for i in validate(broken)}
    assert {"UNKNOWN_COLUMN", "CYCLIC_COLUMN", "CYCLIC_JOIN", "TIME_GRAIN", "UNKNOWN_AGGREGATION", "MEASURE_ARITY", "TOTAL_UNSUPPORTED", "CYCLIC_METRIC", "UNKNOWN_MEASURE"} <= codes


def test_anchors_contexts_and_periods_are_checked():
    made = demo.document()
    price = [{"dataObject": "Lineitem", "column": "Extended Price"}]
    made["measures"] |= {
        "Bad Context": {"aggregation": "sum", "columns": price, "filterContext": {"mode": "FIXED", "exclude": ["Nowhere"]}},
        "Bad Filter": {"aggregation": "sum", "columns": price, "filters": [{"column": {"dataObject": "Lineitem", "column": "Nothing"}, "operator": "set"}]},
        "Bad Anchor": {"aggregation": "sum", "expression": "{[Lineitem].[Extended Price]} + {[Documents].[Doc ID]}", "anchor": "Lineitem"},
        "No Anchor": {"aggregation": "sum", "expression": "{[Lineitem].[Extended Price]} + {[Events].[Value]}"},
    }
    made["metrics"]["Bad Period"] = {"type": "period_over_period", "expression": "{[Orders]} + {[Revenue]}", "periodOverPeriod": {"timeDimension": "Segment", "grain": "eon", "offset": -1, "offsetGrain": "month", "comparison": "sideways"}}
    found = {(i.where, i.code) for i in validate(load(made))}
    wanted = {("Bad Context", "CONTEXT_MODE"), ("Bad Context", "UNKNOWN_DIMENSION"), ("Bad Filter", "UNKNOWN_COLUMN"), ("Bad Anchor", "ANCHOR_UNRELATED"), ("No Anchor", "ANCHOR_NEEDED"), ("Bad Period", "TIME_GRAIN"), ("Bad Period", "METRIC_SHAPE"), ("Bad Period", "PERIOD_MEASURE")}
    assert wanted <= found and not {w for w, _ in found} - {w for w, _ in wanted}


def test_unknown_keys_are_refused():
    with pytest.raises(SemanticError, match="UNKNOWN_KEY"):
        load({"dataObjects": {"A": {"code": "a", "kolumns": {}}}})


@pytest.mark.parametrize("text", ["SELECT * FROM t", "SELECT Revenue FROM a JOIN b ON 1 = 1", "WITH x AS (SELECT 1) SELECT Revenue FROM x", "SELECT Revenue FROM (SELECT 1)", "SELECT rank() OVER (ORDER BY 1) FROM t", "SELECT Nothing FROM t", "SELECT SUM(Segment) FROM t", "SELECT Revenue FROM t WHERE Segment = 'A' OR Revenue > 1", "SELECT Revenue FROM t WHERE EXISTS (SELECT 1 FROM Nothing)", "SELECT Revenue FROM t WHERE EXISTS (SELECT 1 FROM Events GROUP BY 1)",
    "SELECT Revenue FROM t WHERE EXISTS (SELECT 1 FROM Events e)", "SELECT Revenue FROM t WHERE EXISTS (SELECT 1 FROM Events WHERE type = 'a' OR type = 'b')", "SELECT Revenue FROM t WHERE EXISTS (SELECT 1 FROM Events WHERE EXISTS (SELECT 1 FROM Orders))", "SELECT Revenue FROM t WHERE EXISTS (SELECT 1 FROM Orders WHERE Revenue > 1)",
])
def test_sql_that_has_no_place(engine, text):
    with pytest.raises(SemanticError):
        translate(engine.model, text)


def test_sql_conditions_find_their_place(engine):
    made = translate(engine.model, "SELECT Segment, Revenue FROM trade WHERE 'BUILDING' <> Segment AND revenue >= 5 HAVING COUNT(*) > 0 ORDER BY 2 DESC NULLS LAST LIMIT 3 OFFSET 1")
    assert made["where"] == [{"field": "Segment", "op": "notequals", "value": "BUILDING"}] and made["having"] == [{"field": "Revenue", "op": "gte", "value": 5}]
    assert (made["limit"], made["offset"], made["orderBy"]) == (3, 1, [{"field": "2", "direction": "desc", "nulls": "last"}])


def test_sql_exists_names_object_and_subject(engine):
    made = translate(engine.model, "SELECT Segment, Revenue FROM trade WHERE Segment = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE Brand IN ('x', 'y') AND \"return flag\" = 'R')")
    inner = [{"field": "Brand", "op": "inlist", "value": ["x", "y"]}, {"field": "Return Flag", "op": "equals", "value": "R"}]
    assert made["where"] == [{"field": "Segment", "op": "equals", "value": "A"}, {"field": "Segment", "op": "nonexists", "subquery": {"dataObject": "Lineitem", "filter": inner}}]


def test_exploration(spark, engine):
    assert find(engine.model, "regoin name", 1)[0][0] == "Region Name"
    assert "erDiagram" in diagram(engine.model) and lineage(engine.model, "Net Value") == ["Events.Value", "Orders.Total Price"]
    tables = metadata(spark, engine.model)
    assert tables["measures"].filter("name = 'Revenue'").count() == 1
    more = composable(engine.model, {"dimensions": ["Event Type"], "measures": ["Events"]}, engine.tables)
    assert "Region Name" in more["dimensions"] and "Brand" not in more["dimensions"] and "Order Value" in more["measures"]


def test_results(engine, tmp_path):
    made = engine.compile(QUERY)
    assert len(rows(made)) == 5 and arrow(made).num_rows == 5 and tsv(engine.model, made).count("\n") == 6
    save(made, str(tmp_path / "out"))
    assert engine.tables(engine.model.data_objects["Region"]).sparkSession.read.parquet(str(tmp_path / "out")).count() == 5
    assert pattern(1234.565, "#,##0.00", "de-DE") == "1.234,57" and pattern(0.256, "0.0%") == "25.6%" and pattern(None, "0") == ""


def test_cache(engine):
    now = [0.0]
    cache = ResultCache(engine, clock=lambda: now[0])
    first = cache.query(QUERY)
    assert cache.query(dict(QUERY)) is first
    now[0] += cache.ttl(QUERY) + 1
    assert cache.query(QUERY) is not first
    today = {"select": {"measures": ["Orders"]}, "where": [{"field": "Order Month", "op": "relative", "value": {"unit": "day", "count": 3}}]}
    assert cache.ttl(today) == 0 and not engine.deterministic(today) and engine.deterministic(QUERY)
    assert cache.heartbeat("lineitem") == 1 and cache.heartbeat("lineitem") == 0


def test_explain_batch_tables(engine):
    assert "step: scan Lineitem" in engine.explain(QUERY)
    assert engine.tables_touched(QUERY) == ["customer", "lineitem", "nation", "orders", "region"]
    assert len(engine.batch({"a": QUERY, "b": QUERY}, 2)["b"]) == 5


def test_a_stream_gives_what_its_rows_give(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/events*.parquet")
    model = demo.model()
    out = windowed(model, frames({"events": stream}), {"select": {"dimensions": ["Event Type"], "measures": ["Events", "Event Value"]}}, ("Events", "Time"), "1 day", "10 days")
    done = out.writeStream.outputMode("complete").format("memory").queryName("grained").option("checkpointLocation", str(tmp_path)).start()
    done.processAllAvailable()
    done.stop()
    assert spark.sql("SELECT sum(Events) FROM grained").first()[0] == table.count()


def test_tables_of_a_database_are_read_by_ranges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/base;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "K int, V double").write.format("jdbc").options(url=url, dbtable="APP.NUMBERS", driver=driver).mode("overwrite").save()
    table = {"schema": "APP", "code": "NUMBERS", "columns": {"K": {"code": "K", "abstractType": "int"}, "V": {"code": "V", "abstractType": "float"}}}
    e = Engine({"dataObjects": {"N": table}, "measures": {"Sum": {"aggregation": "sum", "columns": [{"dataObject": "N", "column": "V"}]}}}, jdbc(spark, url, {"NUMBERS": ("K", 0, 100, 4)}, driver=driver))
    assert float(e.query({"select": {"measures": ["Sum"]}}).first()[0]) == sum(i % 7 for i in range(100))
    assert e.tables(e.model.data_objects["N"]).rdd.getNumPartitions() == 4
