"""Registered queries: one for each operator of the semantic engine, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import demo
from .engine import Engine
from .functions.expressions import Builder, parse
from .sources.tables import folder, frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_ENGINES: WeakKeyDictionary[SparkSession, dict[tuple, Engine]] = WeakKeyDictionary()


def engine(spark: SparkSession, sf_dir: str, **settings) -> Engine:
    """The demo model over a folder; a session reads its schemas once."""
    known, key = _ENGINES.setdefault(spark, {}), (sf_dir, *sorted(settings.items()))
    if key not in known:
        made = demo.document()
        if settings:
            made["settings"] = settings
        known[key] = Engine(made, folder(spark, sf_dir))
    return known[key]


#: The joined rows that SQL starts from.
LINES = """lines AS (SELECT l.*, o.*, c.*, n.n_name, r.r_name, p.*, s.*, sn.n_name AS sn_name, sr.r_name AS sr_name,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_quantity AS DECIMAL(8,2)) AS qty,
  CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS rev
  FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey
  LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey)"""
ORDERS = """ords AS (SELECT o.*, c.*, n.n_name, r.r_name, CAST(o_totalprice AS DECIMAL(12,2)) AS total, CAST(date_trunc('month', o_orderdate) AS DATE) AS om, CAST(date_trunc('year', o_orderdate) AS DATE) AS oy
  FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey)"""
EVENTS = """evs AS (SELECT e.*, c.*, n.n_name, r.r_name, CAST(value AS DECIMAL(18,4)) AS val FROM events e LEFT JOIN customer c ON user_id = c_custkey
  LEFT JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey)"""
PARTS = {"lines": LINES, "ords": ORDERS, "evs": EVENTS}


def add(name: str, query: dict, sql: str, **settings) -> None:
    """Registers a query; ``sql`` may read the joined rows lines, ords and evs."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, **settings).query(query)
    used = [PARTS[p] for p in PARTS if f" {p}" in sql]
    if used and sql.lstrip().upper().startswith("WITH "):
        ORACLE[name] = f"WITH {', '.join(used)}, {sql.lstrip()[5:]}"
    else:
        ORACLE[name] = (f"WITH {', '.join(used)} " if used else "") + sql


def group(name: str, dims: dict[str, str], measures: dict[str, str], rows: str, where: list | None = None, sql_where: str = "", **more) -> None:
    """A plain aggregate: labels with their SQL."""
    cond = f" WHERE {sql_where}" if sql_where else ""
    by = f" GROUP BY {', '.join(dims.values())}" if dims else ""
    columns = ", ".join(f'{v} AS "{k}"' for k, v in {**{d.split(":")[0]: x for d, x in dims.items()}, **measures}.items())
    tail = more.pop("sql_tail", "")
    add(name, {"select": {"dimensions": list(dims), "measures": list(measures)}, "where": where or [], **more}, f"SELECT {columns} FROM {rows}{cond}{by}{tail}")


def _f(field: str, op: str, value=None, **more) -> dict:
    return {"field": field, "op": op, **({"value": value} if value is not None else {}), **more}


def money(x: str, kind: str = "DECIMAL(18,2)") -> str:
    return f"CAST({x} AS {kind})"


REV, VAL, EVENT = money("sum(rev)"), money("sum(total)"), money("sum(val)", "DECIMAL(18,4)")
REGION, NATION = {"Region Name": "r_name"}, {"Nation Name": "n_name"}

# flagship and scans
group("flagship_revenue_by_nation", NATION, {"Revenue": REV, "Lineitem Count": "count(*)"}, "lines", [_f("Region Name", "equals", "ASIA")], "r_name = 'ASIA'", orderBy=[{"field": "Revenue", "direction": "desc"}, {"field": "Nation Name"}], limit=10, sql_tail=" ORDER BY 2 DESC, 1 LIMIT 10")
group("scan_global_aggregate", {}, {"Revenue": REV, "Quantity": money("sum(qty)")}, "lines")
group("dimension_only", {"Region Name": "r_name", "Nation Name": "n_name"}, {}, "nation JOIN region ON n_regionkey = r_regionkey")
group("star_q1_pricing_summary", {"Return Flag": "l_returnflag", "Line Status": "l_linestatus"}, {"Quantity": money("sum(qty)"), "Revenue": REV, "Average Price": money("avg(price)"), "Lineitem Count": "count(*)"}, "lines")

# filter operators
FILTERS: dict[str, tuple[dict, str]] = {
    "equals": (_f("Segment", "=", "BUILDING"), "c_mktsegment = 'BUILDING'"),
    "notequals": (_f("Segment", "notequals", "BUILDING"), "c_mktsegment <> 'BUILDING'"),
    "gt": (_f("Orders.Total Price", ">", 200000), "total > 200000"),
    "gte": (_f("Orders.Order Key", "gte", 500), "o_orderkey >= 500"),
    "lt": (_f("Order Month", "lt", "1996-03-05"), "o_orderdate < TIMESTAMP '1996-03-05'"),
    "lte": (_f("Orders.Order Key", "<=", 500), "o_orderkey <= 500"),
    "inlist": (_f("Region Name", "in", ["ASIA", "EUROPE"]), "r_name IN ('ASIA', 'EUROPE')"),
    "notinlist": (_f("Region Name", "notinlist", "ASIA"), "r_name NOT IN ('ASIA')"),
    "set": (_f("Segment", "set"), "c_mktsegment IS NOT NULL"),
    "notset": (_f("Segment", "is_null"), "c_mktsegment IS NULL"),
    "contains": (_f("Segment", "contains", "UI"), "contains(c_mktsegment, 'UI')"),
    "notcontains": (_f("Segment", "notcontains", "UI"), "NOT contains(c_mktsegment, 'UI')"),
    "starts_with": (_f("Segment", "starts_with", "B"), "starts_with(c_mktsegment, 'B')"),
    "ends_with": (_f("Segment", "ends_with", "Y"), "ends_with(c_mktsegment, 'Y')"),
    "like": (_f("Segment", "like", "%U_L%"), "c_mktsegment LIKE '%U_L%'"),
    "notlike": (_f("Segment", "notlike", "%U_L%"), "c_mktsegment NOT LIKE '%U_L%'"),
    "between": (_f("Orders.Total Price", "between", [100000, 200000]), "total BETWEEN 100000 AND 200000"),
    "notbetween": (_f("Orders.Total Price", "notbetween", [100000, 200000]), "total NOT BETWEEN 100000 AND 200000"),
    "regex": (_f("Segment", "regex", "^(AUTO|BUILD)"), "regexp_matches(c_mktsegment, '^(AUTO|BUILD)')"),
    "notregex": (_f("Segment", "notregex", "^(AUTO|BUILD)"), "NOT regexp_matches(c_mktsegment, '^(AUTO|BUILD)')"),
    "blank": (_f("Segment", "blank"), "c_mktsegment IS NULL OR trim(c_mktsegment) = ''"),
    "notblank": (_f("Segment", "notblank"), "NOT (c_mktsegment IS NULL OR trim(c_mktsegment) = '')"),
    "length_eq": (_f("Segment", "length_eq", 8), "length(c_mktsegment) = 8"),
    "length_gt": (_f("Segment", "length_gt", 8), "length(c_mktsegment) > 8"),
    "length_lt": (_f("Segment", "length_lt", 9), "length(c_mktsegment) < 9"),
    "relative": (_f("Order Month", "relative", {"unit": "year", "count": 28, "direction": "past"}), "o_orderdate >= current_date + INTERVAL 1 DAY - INTERVAL 28 YEAR AND o_orderdate < current_date + INTERVAL 1 DAY"),
    "group": ({"logic": "or", "filters": [_f("Segment", "equals", "BUILDING"), {"logic": "and", "negated": True, "filters": [_f("Region Name", "equals", "ASIA"), _f("Order Status", "equals", "O")]}]}, "c_mktsegment = 'BUILDING' OR NOT (r_name = 'ASIA' AND o_orderstatus = 'O')"),
}
for _name, (_query, _sql) in FILTERS.items():
    group(f"filter_{_name}", REGION, {"Orders": "count(o_orderkey)", "Order Value": VAL}, "ords", [_query], _sql)
CLICKS = {"dataObject": "Events", "filter": [_f("Type", "equals", "click")]}
group("filter_exists", REGION, {"Orders": "count(*)"}, "ords", [_f("Customer.Cust Key", "exists", subquery=CLICKS)], "EXISTS (SELECT 1 FROM events e WHERE e.user_id = ords.c_custkey AND event_type = 'click')")
group("filter_nonexists", REGION, {"Orders": "count(*)"}, "ords", [_f("Customer.Cust Key", "nonexists", subquery={"dataObject": "Events"})], "NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = ords.c_custkey)")
group("filter_exists_two_hops", REGION, {"Customer Count": "count(*)"}, "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", [_f("Customer.Cust Key", "exists", subquery={"dataObject": "Lineitem", "filter": [_f("Return Flag", "equals", "R"), _f("Brand", "equals", "Brand#11")]})], "EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND p_brand = 'Brand#11')")
group("filter_exists_or", REGION, {"Orders": "count(*)"}, "ords", [{"logic": "or", "filters": [_f("Customer.Cust Key", "nonexists", subquery=CLICKS), _f("Segment", "equals", "BUILDING")]}], "NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = ords.c_custkey AND event_type = 'click') OR c_mktsegment = 'BUILDING'")

# projections
add("raw_fields", {"select": {"fields": ["Orders.Order Key", "Customer.Name", "Nation Name"]}, "where": [_f("Order Status", "equals", "P")]}, 'SELECT o_orderkey AS "Orders.Order Key", c_name AS "Customer.Name", n_name AS "Nation Name" FROM ords WHERE o_orderstatus = \'P\'')
add("raw_distinct", {"select": {"fields": ["Nation Name", "Order Priority"], "distinct": True}}, 'SELECT DISTINCT n_name AS "Nation Name", o_orderpriority AS "Order Priority" FROM ords')
add("raw_union", {"select": {"fields": ["Orders.Order Key", "Events.Event ID", "Customer.Name"]}, "where": [_f("Region Name", "equals", "ASIA")]}, 'SELECT o_orderkey AS "Orders.Order Key", NULL AS "Events.Event ID", c_name AS "Customer.Name" FROM ords WHERE r_name = \'ASIA\' UNION ALL SELECT NULL, event_id, c_name FROM evs WHERE r_name = \'ASIA\'')
group("computed_column", {"Segment Initial": "substring(c_mktsegment, 1, 1)"}, {"Customer Count": "count(*)"}, "customer")
group("time_grain_override", {"Order Month:quarter": "CAST(date_trunc('quarter', o_orderdate) AS DATE)"}, {"Order Value": VAL}, "ords")
for _unit in ("year", "quarter", "month", "week", "day"):
    group(f"grain_{_unit}", {f"Event Day:{_unit}": f"CAST(date_trunc('{_unit}', ts) AS DATE)"}, {"Events": "count(*)"}, "evs")
for _unit in ("hour", "minute", "second"):
    group(f"grain_{_unit}", {f"Event Hour:{_unit}": f"date_trunc('{_unit}', ts)"}, {"Events": "count(*)"}, "evs")
group("week_from_sunday", {"Event Day:week": "CAST(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE)"}, {"Events": "count(*)"}, "evs")
QUERIES["week_from_sunday"] = lambda spark, sf_dir: engine(spark, sf_dir, weekStart="sunday").query({"select": {"dimensions": ["Event Day:week"], "measures": ["Events"]}})
group("query_timezone", {"Event Hour": "date_trunc('hour', ts + INTERVAL 2 HOUR)"}, {"Events": "count(*)"}, "evs")
QUERIES["query_timezone"] = lambda spark, sf_dir: engine(spark, sf_dir, defaultTimezone="UTC", queryTimezone="Etc/GMT-2").query({"select": {"dimensions": ["Event Hour"], "measures": ["Events"]}})

# joins
group("join_roles", {"Region Name": "r_name", "Supplier Region Name": "sr_name"}, {"Revenue": REV}, "lines")
group("join_required_inner", {"Lang": "lang", "Quality": "quality"}, {"Labels Count": "count(*)", "Toxic": "CAST(sum(toxic) AS BIGINT)"}, "labels JOIN documents USING (doc_id)")
group("join_five_tables", {"Brand": "p_brand", "Supplier Nation Name": "sn_name"}, {"Quantity": money("sum(qty)")}, "lines", [_f("Region Name", "equals", "EUROPE"), _f("Order Status", "equals", "F")], "r_name = 'EUROPE' AND o_orderstatus = 'F'")

# aggregations
AGGREGATES = {
    "sum": ("Quantity", money("sum(qty)")), "sum_int": ("Line Sum", "CAST(sum(l_linenumber) AS BIGINT)"), "count": ("Lineitem Count", "count(*)"), "count_columns": ("Lines Shipped", "count(*) FILTER (l_partkey IS NOT NULL AND l_suppkey IS NOT NULL)"),
    "count_distinct": ("Suppliers Used", "count(DISTINCT l_suppkey)"), "avg": ("Average Price", money("avg(price)")), "avg_int": ("Average Line", money("avg(l_linenumber)")), "min": ("Smallest Price", "min(price)"), "max": ("Largest Price", "max(price)"),
    "filtered": ("Returned Revenue", money("sum(CASE WHEN l_returnflag = 'R' THEN rev END)")), "filtered_group": ("Returned Or Bulky", "count(CASE WHEN l_returnflag = 'R' OR qty > 40 THEN 1 END)"), "default_value": ("Special Revenue", money("coalesce(sum(CASE WHEN l_returnflag = '?' THEN rev END), 0)")),
    "corr": ("Price Quantity Correlation", "round(corr(price, qty), 6)"), "regr_slope": ("Price Quantity Slope", "round(regr_slope(price, qty), 2)"), "regr_intercept": ("Price Quantity Intercept", "round(regr_intercept(price, qty), 2)"),
    "covar_samp": ("Price Quantity Covariance", "round(covar_samp(price, qty), 0)"), "covar_pop": ("Price Quantity Population Covariance", "round(covar_pop(price, qty), 0)"),
}
for _name, (_label, _sql) in AGGREGATES.items():
    group(f"agg_{_name}", {"Line Status": "l_linestatus", "Region Name": "r_name"}, {_label: _sql}, "lines")
for _name, _digits in (("corr", 6), ("regr_slope", 2), ("regr_intercept", 2), ("covar_samp", 0), ("covar_pop", 0)):
    # floating point: the last digits depend on the order of rows
    QUERIES[f"agg_{_name}"] = lambda spark, sf_dir, m=AGGREGATES[_name][0], d=_digits: engine(spark, sf_dir).query({"select": {"dimensions": ["Line Status", "Region Name"], "measures": [m]}}).withColumn(m, F.round(f"`{m}`", d))
group("agg_median", REGION, {"Median Order Value": "CAST(median(CAST(total AS DOUBLE)) AS DOUBLE)"}, "ords")
for _name, _label, _sql in (("stddev", "Order Value Deviation", "stddev_samp(total)"), ("var_pop", "Order Value Variance", "var_pop(total)"), ("stddev_pop", "Order Value Population Deviation", "stddev_pop(total)"), ("variance", "Order Value Sample Variance", "var_samp(total)")):
    group(f"agg_{_name}", REGION, {_label: f"round({_sql}, 0)"}, "ords")
    QUERIES[f"agg_{_name}"] = lambda spark, sf_dir, m=_label: engine(spark, sf_dir).query({"select": {"dimensions": ["Region Name"], "measures": [m]}}).withColumn(m, F.round(f"`{m}`", 0))
group("agg_any_value", {"Order Status": "o_orderstatus"}, {"Any Status": "min(o_orderstatus)"}, "ords")
group("agg_mode", {}, {"Usual Size": "(SELECT p_size FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1)"}, "(SELECT 1)")
group("agg_listagg", REGION, {"Nations": "string_agg(n_name, ', ' ORDER BY n_nationkey DESC)"}, "nation JOIN region ON n_regionkey = r_regionkey")
group("agg_listagg_distinct", {"Segment": "c_mktsegment"}, {"Statuses": "string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus)"}, "ords")
group("grouping_rollup", {"Region Name": "r_name", "Segment": "c_mktsegment"}, {"Order Value": VAL, "Orders": "count(*)"}, "ords", grouping="rollup")
group("grouping_cube", {"Region Name": "r_name", "Segment": "c_mktsegment"}, {"Order Value": VAL}, "ords", grouping="cube")
for _kind in ("rollup", "cube"):
    ORACLE[f"grouping_{_kind}"] = ORACLE[f"grouping_{_kind}"].replace(" FROM ords GROUP BY r_name, c_mktsegment", f', grouping(r_name) AS "_g_Region Name", grouping(c_mktsegment) AS "_g_Segment" FROM ords GROUP BY {_kind}(r_name, c_mktsegment)')
group("having_measure", NATION, {"Order Value": VAL}, "ords", having=[_f("Orders", "gt", 600)], sql_tail=" HAVING count(*) > 600")
group("having_group", NATION, {"Order Value": VAL, "Orders": "count(*)"}, "ords", having=[{"logic": "or", "filters": [_f("Orders", "lt", 580), _f("Order Value", "gt", 160000000)]}], sql_tail=" HAVING count(*) < 580 OR sum(total) > 160000000")

# metrics
group("metric_derived", REGION, {"Returned Share": "CAST(CAST(sum(CASE WHEN l_returnflag = 'R' THEN rev END) AS DOUBLE) / CAST(sum(rev) AS DOUBLE) AS DECIMAL(18,6))"}, "lines")
group("metric_nested", REGION, {"Returned Percent": "CAST(100 * (CAST(sum(CASE WHEN l_returnflag = 'R' THEN rev END) AS DOUBLE) / CAST(sum(rev) AS DOUBLE)) AS DECIMAL(18,4))"}, "lines")
add("metric_across_grains", {"select": {"dimensions": ["Region Name"], "measures": ["Revenue Per Order"]}}, 'SELECT r_name AS "Region Name", CAST(CAST(sum(rev) AS DOUBLE) / count(DISTINCT o_orderkey) AS DECIMAL(18,6)) AS "Revenue Per Order" FROM lines GROUP BY r_name')

# grain, totals, filter context
add("total_share", {"select": {"dimensions": ["Region Name", "Segment"], "measures": ["Revenue", "Total Revenue", "Revenue Share"]}}, f"""SELECT r_name AS "Region Name", c_mktsegment AS "Segment", {REV} AS "Revenue", CAST(sum(sum(rev)) OVER () AS DECIMAL(18,2)) AS "Total Revenue",
  CAST(CAST(sum(rev) AS DOUBLE) / CAST(sum(sum(rev)) OVER () AS DOUBLE) AS DECIMAL(18,6)) AS "Revenue Share" FROM lines GROUP BY r_name, c_mktsegment""")
add("total_average_and_maximum", {"select": {"dimensions": ["Region Name"], "measures": ["Total Average Price", "Total Largest Price"]}}, 'SELECT r_name AS "Region Name", (SELECT CAST(avg(price) AS DECIMAL(18,2)) FROM lines) AS "Total Average Price", (SELECT max(price) FROM lines) AS "Total Largest Price" FROM lines GROUP BY r_name')
add("grain_fixed", {"select": {"dimensions": ["Region Name", "Segment"], "measures": ["Revenue", "Region Revenue"]}}, f'SELECT r_name AS "Region Name", c_mktsegment AS "Segment", {REV} AS "Revenue", CAST(sum(sum(rev)) OVER (PARTITION BY r_name) AS DECIMAL(18,2)) AS "Region Revenue" FROM lines GROUP BY r_name, c_mktsegment')
add("grain_relative", {"select": {"dimensions": ["Nation Name", "Segment"], "measures": ["Revenue Without Segment"]}}, 'SELECT n_name AS "Nation Name", c_mktsegment AS "Segment", CAST(sum(sum(rev)) OVER (PARTITION BY n_name) AS DECIMAL(18,2)) AS "Revenue Without Segment" FROM lines GROUP BY n_name, c_mktsegment')
add("grouping_with_total", {"select": {"dimensions": ["Region Name", "Segment"], "measures": ["Revenue", "Total Revenue", "Revenue Share", "Region Revenue", "Total Average Price"]}, "grouping": "rollup"}, f"""SELECT "Region Name", "Segment", "Revenue", CAST(t.v AS DECIMAL(18,2)) AS "Total Revenue", CAST(CAST(g.v AS DOUBLE) / CAST(t.v AS DOUBLE) AS DECIMAL(18,6)) AS "Revenue Share",
  CAST(CASE WHEN "_g_Region Name" = 1 THEN t.v ELSE x.v END AS DECIMAL(18,2)) AS "Region Revenue", CAST(t.a AS DECIMAL(18,2)) AS "Total Average Price", "_g_Region Name", "_g_Segment"
  FROM (SELECT r_name AS "Region Name", c_mktsegment AS "Segment", {REV} AS "Revenue", sum(rev) AS v, grouping(r_name) AS "_g_Region Name", grouping(c_mktsegment) AS "_g_Segment" FROM lines GROUP BY ROLLUP(r_name, c_mktsegment)) g
  CROSS JOIN (SELECT sum(rev) AS v, avg(price) AS a FROM lines) t LEFT JOIN (SELECT r_name, sum(rev) AS v FROM lines GROUP BY r_name) x ON "Region Name" IS NOT DISTINCT FROM x.r_name""")
add("grouping_with_context", {"select": {"dimensions": ["Region Name", "Segment"], "measures": ["Revenue", "All Flags Revenue", "Grand Unfiltered Revenue"]}, "where": [_f("Return Flag", "equals", "R")], "grouping": "cube"}, f"""SELECT r_name AS "Region Name", c_mktsegment AS "Segment", CAST(sum(rev) FILTER (l_returnflag = 'R') AS DECIMAL(18,2)) AS "Revenue", {REV} AS "All Flags Revenue", (SELECT {REV} FROM lines) AS "Grand Unfiltered Revenue",
  grouping(r_name) AS "_g_Region Name", grouping(c_mktsegment) AS "_g_Segment" FROM lines GROUP BY CUBE(r_name, c_mktsegment)""")
add("context_exclude", {"select": {"dimensions": ["Region Name"], "measures": ["Revenue", "All Flags Revenue", "Revenue Of All Flags"]}, "where": [_f("Return Flag", "equals", "R")]}, """SELECT r_name AS "Region Name", CAST(sum(rev) FILTER (l_returnflag = 'R') AS DECIMAL(18,2)) AS "Revenue", CAST(sum(rev) AS DECIMAL(18,2)) AS "All Flags Revenue",
  CAST(CAST(sum(rev) FILTER (l_returnflag = 'R') AS DOUBLE) / CAST(sum(rev) AS DOUBLE) AS DECIMAL(18,6)) AS "Revenue Of All Flags" FROM lines GROUP BY r_name""")
add("context_fixed_include", {"select": {"dimensions": ["Region Name"], "measures": ["Revenue", "Fixed Status Revenue"]}, "where": [_f("Order Status", "equals", "F")]}, """SELECT r_name AS "Region Name", CAST(sum(rev) FILTER (o_orderstatus = 'F') AS DECIMAL(18,2)) AS "Revenue", CAST(sum(rev) FILTER (o_orderstatus = 'O') AS DECIMAL(18,2)) AS "Fixed Status Revenue" FROM lines GROUP BY r_name""")
add("context_grand_total", {"select": {"dimensions": ["Region Name"], "measures": ["Revenue", "Grand Unfiltered Revenue"]}, "where": [_f("Order Status", "equals", "F")]}, f"""SELECT r_name AS "Region Name", {REV} AS "Revenue", (SELECT {REV} FROM lines) AS "Grand Unfiltered Revenue" FROM lines WHERE o_orderstatus = 'F' GROUP BY r_name""")
DEDUP = "WITH d AS (SELECT DISTINCT {k}, o_orderkey, total FROM (SELECT *, CAST(o_totalprice AS DECIMAL(12,2)) AS total FROM lines))"
add("dedup_one_side", {"select": {"dimensions": ["Return Flag"], "measures": ["Revenue", "Order Value", "Orders"]}}, DEDUP.format(k="l_returnflag") + f' SELECT l_returnflag AS "Return Flag", (SELECT {REV} FROM lines l WHERE l.l_returnflag = d.l_returnflag) AS "Revenue", {VAL} AS "Order Value", count(*) AS "Orders" FROM d GROUP BY l_returnflag')
add("dedup_two_objects", {"select": {"dimensions": ["Region Name"], "measures": ["Average Price", "Average Order Value", "Customer Balance"]}}, """WITH o AS (SELECT r_name, avg(total) AS v FROM (SELECT DISTINCT r_name, o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS total FROM lines) GROUP BY r_name),
  c AS (SELECT r_name, sum(b) AS v FROM (SELECT DISTINCT r_name, c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS b FROM lines) GROUP BY r_name)
  SELECT l.r_name AS "Region Name", CAST(avg(price) AS DECIMAL(18,2)) AS "Average Price", CAST(any_value(o.v) AS DECIMAL(18,2)) AS "Average Order Value", CAST(any_value(c.v) AS DECIMAL(18,2)) AS "Customer Balance" FROM lines l JOIN o USING (r_name) JOIN c USING (r_name) GROUP BY l.r_name""")
group("allow_fan_out", {"Return Flag": "l_returnflag"}, {"Revenue": REV, "Fanned Order Value": money("sum(CAST(o_totalprice AS DECIMAL(12,2)))")}, "lines")
add("anchored_measure", {"select": {"dimensions": ["Region Name"], "measures": ["Value Per Order Spend"]}}, 'WITH t AS (SELECT o_custkey AS k, sum(total) AS spend FROM ords GROUP BY o_custkey) SELECT r_name AS "Region Name", CAST(sum(CAST(val AS DECIMAL(18,4)) * CAST(spend AS DECIMAL(20,2))) AS DECIMAL(38,4)) AS "Value Per Order Spend" FROM evs LEFT JOIN t ON user_id = k GROUP BY r_name')

# windows over the aggregate
MONTHS = "WITH m AS (SELECT om, sum(total) AS v FROM ords GROUP BY om)"


def monthly(name: str, measures: dict[str, str]) -> None:
    columns = ", ".join(f'{v} AS "{k}"' for k, v in measures.items())
    add(name, {"select": {"dimensions": ["Order Month"], "measures": list(measures)}}, f'{MONTHS} SELECT om AS "Order Month", {columns} FROM m')


ROWS = "ORDER BY om ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
monthly("cumulative_running", {"Running Value": f"sum(v) OVER ({ROWS.format('UNBOUNDED')})", "Running Largest": f"max(v) OVER ({ROWS.format('UNBOUNDED')})"})
monthly("cumulative_least_and_count", {"Running Least": f"min(v) OVER ({ROWS.format('UNBOUNDED')})", "Months So Far": f"count(v) OVER ({ROWS.format('UNBOUNDED')})"})
monthly("cumulative_rolling", {"Rolling Value": f"sum(v) OVER ({ROWS.format(2)})", "Rolling Average": f"CAST(avg(v) OVER ({ROWS.format(2)}) AS DECIMAL(18,4))"})
monthly("cumulative_to_date", {"Year To Date": f"sum(v) OVER (PARTITION BY date_trunc('year', om) {ROWS.format('UNBOUNDED')})"})
add("cumulative_partitioned", {"select": {"dimensions": ["Order Month", "Order Status"], "measures": ["Running By Status"]}}, f'WITH m AS (SELECT om, o_orderstatus, sum(total) AS v FROM ords GROUP BY om, o_orderstatus) SELECT om AS "Order Month", o_orderstatus AS "Order Status", sum(v) OVER (PARTITION BY o_orderstatus {ROWS.format("UNBOUNDED")}) AS "Running By Status" FROM m')
monthly("window_lag_lead", {"Previous Value": "lag(v, 1) OVER (ORDER BY om)", "Next Value": "lead(v, 2, 0) OVER (ORDER BY om)"})
monthly("window_first_last", {"First Value": "first_value(v) OVER (ORDER BY om)", "Last Value": "last_value(v) OVER (ORDER BY om)"})
monthly("window_derived", {"Value Change": "CAST(v - lag(v, 1) OVER (ORDER BY om) AS DECIMAL(18,2))"})
add("window_ranks", {"select": {"dimensions": ["Nation Name", "Region Name"], "measures": ["Value Rank", "Value Dense Rank", "Value Row", "Value Quartile"]}}, 'WITH m AS (SELECT n_name, r_name, sum(total) AS v FROM ords GROUP BY n_name, r_name) SELECT n_name AS "Nation Name", r_name AS "Region Name", rank() OVER (ORDER BY v DESC) AS "Value Rank", dense_rank() OVER (ORDER BY v) AS "Value Dense Rank", row_number() OVER (PARTITION BY r_name ORDER BY v DESC) AS "Value Row", ntile(4) OVER (ORDER BY v DESC) AS "Value Quartile" FROM m')
add("window_having_top", {"select": {"dimensions": ["Nation Name"], "measures": ["Order Value"]}, "having": [_f("Value Rank", "lte", 3)]}, f'SELECT n_name AS "Nation Name", {VAL} AS "Order Value" FROM ords GROUP BY n_name QUALIFY rank() OVER (ORDER BY sum(total) DESC) <= 3')
add("period_over_period", {"select": {"dimensions": ["Order Month"], "measures": ["Order Value", "Value Month Ago", "Value Difference", "Value Ratio", "Value Percent", "Value Year Ago"]}}, f"""{MONTHS}, s AS (SELECT CAST(unnest(generate_series(min(om), max(om), INTERVAL 1 MONTH)) AS DATE) AS t FROM m)
  SELECT t AS "Order Month", CAST(c.v AS DECIMAL(18,2)) AS "Order Value", p.v AS "Value Month Ago", c.v - p.v AS "Value Difference", CAST(CAST(c.v AS DOUBLE) / CAST(p.v AS DOUBLE) AS DECIMAL(18,6)) AS "Value Ratio",
  CAST(CAST(c.v - p.v AS DOUBLE) / CAST(p.v AS DOUBLE) AS DECIMAL(18,6)) AS "Value Percent", y.v AS "Value Year Ago"
  FROM s LEFT JOIN m c ON c.om = t LEFT JOIN m p ON p.om = t - INTERVAL 1 MONTH LEFT JOIN m y ON y.om = t - INTERVAL 1 YEAR""")
add("period_by_dimension", {"select": {"dimensions": ["Order Month", "Order Status"], "measures": ["Value Month Ago"]}, "where": [_f("Order Status", "in", ["F", "O"])]}, """WITH m AS (SELECT om, o_orderstatus AS k, sum(total) AS v FROM ords WHERE o_orderstatus IN ('F', 'O') GROUP BY om, o_orderstatus), s AS (SELECT CAST(unnest(generate_series(min(om), max(om), INTERVAL 1 MONTH)) AS DATE) AS t FROM m)
  SELECT t AS "Order Month", c.k AS "Order Status", p.v AS "Value Month Ago" FROM s LEFT JOIN m c ON c.om = t LEFT JOIN m p ON p.om = t - INTERVAL 1 MONTH AND p.k IS NOT DISTINCT FROM c.k""")

# sort, limit
add("order_nulls_offset", {"select": {"dimensions": ["Nation Name"], "measures": ["Orders"]}, "orderBy": [{"field": "2", "direction": "desc", "nulls": "first"}, {"field": "Nation Name"}], "limit": 5, "offset": 3}, 'SELECT n_name AS "Nation Name", count(*) AS "Orders" FROM ords GROUP BY n_name ORDER BY 2 DESC, 1 LIMIT 5 OFFSET 3')
add("limit_auto_order", {"select": {"dimensions": ["Nation Name"], "measures": ["Orders"]}, "limit": 7}, 'SELECT n_name AS "Nation Name", count(*) AS "Orders" FROM ords GROUP BY n_name ORDER BY 1 LIMIT 7')

# several facts
UNION = "WITH a AS (SELECT r_name AS k, sum(total) AS v, count(*) AS n FROM ords GROUP BY r_name), b AS (SELECT r_name AS k, sum(val) AS w, count(DISTINCT user_id) AS u FROM evs GROUP BY r_name)"
add("union_two_facts", {"select": {"dimensions": ["Region Name"], "measures": ["Order Value", "Event Value", "Active Users"]}}, f'{UNION} SELECT k AS "Region Name", CAST(v AS DECIMAL(18,2)) AS "Order Value", CAST(w AS DECIMAL(18,4)) AS "Event Value", u AS "Active Users" FROM a FULL JOIN b USING (k)')
add("union_metric", {"select": {"dimensions": ["Region Name"], "measures": ["Net Value"]}}, f'{UNION} SELECT k AS "Region Name", CAST(v - w AS DECIMAL(18,2)) AS "Net Value" FROM a FULL JOIN b USING (k)')
add("union_unshared_dimension", {"select": {"dimensions": ["Event Type", "Order Status"], "measures": ["Orders", "Events"]}}, 'SELECT event_type AS "Event Type", NULL AS "Order Status", 0 AS "Orders", count(*) AS "Events" FROM evs GROUP BY 1 UNION ALL SELECT NULL, o_orderstatus, count(*), 0 FROM ords GROUP BY 2')
add("union_coalesced_dimension", {"select": {"dimensions": [{"coalesce": ["Order Month:month", "Event Day:month"], "as": "Month"}], "measures": ["Orders", "Events"]}}, """SELECT m AS "Month", sum(o)::BIGINT AS "Orders", sum(e)::BIGINT AS "Events" FROM (SELECT om AS m, 1 AS o, 0 AS e FROM ords UNION ALL SELECT CAST(date_trunc('month', ts) AS DATE), 0, 1 FROM evs) GROUP BY m""")
add("json_value_dimension", {"select": {"dimensions": ["Event Prop"], "measures": ["Events"]}}, "SELECT json_extract_string(props, '$.k') AS \"Event Prop\", count(*) AS \"Events\" FROM events GROUP BY 1")
QUERIES["dimensions_exclude"] = lambda spark, sf_dir: engine(spark, sf_dir).query({"select": {"dimensions": ["Supplier Nation Name", "Brand"]}, "where": [_f("Order Status", "equals", "P"), _f("Segment", "equals", "BUILDING")], "dimensionsExclude": True})
ORACLE["dimensions_exclude"] = f"WITH {LINES} SELECT sn.n_name AS \"Supplier Nation Name\", p_brand AS \"Brand\" FROM (SELECT DISTINCT n_name FROM nation) sn CROSS JOIN (SELECT DISTINCT p_brand FROM part) EXCEPT SELECT sn_name, p_brand FROM lines WHERE o_orderstatus = 'P' AND c_mktsegment = 'BUILDING'"

# scalar functions, row by row over real columns
FUNCTIONS: dict[str, tuple[str, str]] = {
    "substring": ("substring({c_name}, 3, 4)", "substring(c_name, 3, 4)"), "concat": ("concat({c_name}, '-', {c_mktsegment})", "c_name || '-' || c_mktsegment"), "upper_lower": ("concat(upper({c_name}), lower({c_mktsegment}))", "upper(c_name) || lower(c_mktsegment)"),
    "trims": ("concat(ltrim('  a '), rtrim(' b  '), trim('  c  '))", "ltrim('  a ') || rtrim(' b  ') || trim('  c  ')"), "length": ("length({c_mktsegment})", "CAST(length(c_mktsegment) AS BIGINT)"), "replace": ("replace({c_name}, '0', 'x')", "replace(c_name, '0', 'x')"),
    "position": ("position('I', {c_mktsegment})", "CAST(strpos(c_mktsegment, 'I') AS BIGINT)"), "split_part": ("split_part({c_name}, '#', 2)", "split_part(c_name, '#', 2)"), "pads": ("concat(lpad({c_mktsegment}, 5, '*'), rpad({c_mktsegment}, 12, '*'))", "lpad(c_mktsegment, 5, '*') || rpad(c_mktsegment, 12, '*')"),
    "starts_ends": ("CASE WHEN starts_with({c_mktsegment}, 'B') OR ends_with({c_mktsegment}, 'Y') THEN 1 ELSE 0 END", "CASE WHEN starts_with(c_mktsegment, 'B') OR ends_with(c_mktsegment, 'Y') THEN 1 ELSE 0 END"),
    "abs_sign": ("abs({c_custkey} - 700) * sign({c_custkey} - 700)", "c_custkey - 700"), "floor_ceil": ("floor({c_custkey} / 7) + ceil({c_custkey} / 7)", "CAST(floor(c_custkey / 7.0) + ceil(c_custkey / 7.0) AS BIGINT)"), "sqrt_exp_ln": ("round(sqrt({c_custkey}) + ln({c_custkey} + 1) + exp(1), 6)", "round(sqrt(c_custkey) + ln(c_custkey + 1) + exp(1), 6)"),
    "power": ("power({c_custkey}, 2)", "CAST(c_custkey * c_custkey AS DOUBLE)"), "round": ("round(CAST({c_custkey} AS decimal(10,3)) / 8, 2)", "round(c_custkey / 8.0, 2)"), "trunc": ("trunc(({c_custkey} - 700) / 8, 1)", "CAST(trunc((c_custkey - 700) * 10 / 8.0) / 10 AS DOUBLE)"),
    "mod": ("mod({c_custkey} - 700, 7)", "(c_custkey - 700) % 7"), "div": ("div({c_custkey} - 700, 7)", "CAST(trunc((c_custkey - 700) / 7.0) AS BIGINT)"), "div_zero": ("div({c_custkey}, {c_custkey} - {c_custkey})", "CAST(NULL AS BIGINT)"), "log": ("round(log(2, {c_custkey} + 1), 6)", "round(log(2, c_custkey + 1), 6)"),
    "coalesce_nullif": ("coalesce(nullif({c_mktsegment}, 'BUILDING'), 'none')", "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')"), "greatest_least": ("greatest({c_custkey}, {c_nationkey}) - least({c_custkey}, {c_nationkey})", "greatest(c_custkey, c_nationkey) - least(c_custkey, c_nationkey)"),
    "division": ("{c_custkey} / ({c_nationkey} - 5)", "c_custkey / nullif(c_nationkey - 5.0, 0)"), "case_in_between": ("CASE WHEN {c_custkey} IN (1, 2, 3) THEN 'few' WHEN {c_custkey} BETWEEN 10 AND 20 THEN 'mid' WHEN {c_name} LIKE '%7' THEN 'seven' END", "CASE WHEN c_custkey IN (1, 2, 3) THEN 'few' WHEN c_custkey BETWEEN 10 AND 20 THEN 'mid' WHEN c_name LIKE '%7' THEN 'seven' END"),
}
DATES: dict[str, tuple[str, str]] = {
    "date_trunc": ("date_trunc('week', {ts})", "date_trunc('week', ts)"), "date_add": ("date_add('month', {user_id}, {ts})", "ts + to_months(CAST(user_id AS INTEGER))"), "date_add_quarter": ("date_add('quarter', 1, {ts})", "ts + INTERVAL 3 MONTH"), "date_diff_week": ("date_diff('week', {ts}, DATE '2024-01-01')", "date_diff('week', ts, TIMESTAMP '2024-01-01')"),
    "date_diff_month": ("date_diff('month', DATE '1999-12-31', {ts})", "date_diff('month', TIMESTAMP '1999-12-31', ts)"), "date_diff_hour": ("date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', {ts})", "date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts)"), "extract": ("extract('week', {ts}) * 10000 + EXTRACT(hour FROM {ts}) * 100 + extract('second', {ts})", "CAST(extract('week' FROM ts) * 10000 + extract('hour' FROM ts) * 100 + floor(extract('second' FROM ts)) AS INTEGER)"),
    "last_day": ("last_day({ts})", "last_day(ts)"), "current_date": ("date_diff('day', {ts}, current_date()) - date_diff('day', DATE '2024-01-01', current_date())", "date_diff('day', ts, current_date) - date_diff('day', DATE '2024-01-01', current_date)"), "json_value": ("json_value({props}, '$.k')", "json_extract_string(props, '$.k')"),
}


def _function(code: str, key: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{code}.parquet")
        return rows.select(key, Builder(lambda parts: F.col(parts[0])).build(parse(text)).alias("value"))

    return run


for _code, _key, _all in (("customer", "c_custkey", FUNCTIONS), ("events", "event_id", DATES)):
    for _name, (_text, _sql) in _all.items():
        QUERIES[f"fn_{_name}"] = _function(_code, _key, _text)
        ORACLE[f"fn_{_name}"] = f"SELECT {_key}, {_sql} AS value FROM {_code}"


# nested objects: orders that hold their lines
def nested_engine(spark: SparkSession, sf_dir: str) -> Engine:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("decimal(8,2)").alias("quantity"))).alias("items"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    made = {
        "dataObjects": {
            "Orders": {"code": "orders", "columns": {"Key": {"code": "o_orderkey", "abstractType": "int", "primaryKey": True}, "Status": {"code": "o_orderstatus", "abstractType": "string"}, "Total": {"code": "o_totalprice", "abstractType": "float", "sqlType": "decimal", "sqlPrecision": 12, "sqlScale": 2}}},
            "Items": {"nestedIn": {"dataObject": "Orders", "column": "items"}, "columns": {"Part": {"code": "part", "abstractType": "int"}, "Quantity": {"code": "quantity", "abstractType": "float"}}},
        },
        "dimensions": {"Status": {"dataObject": "Orders", "column": "Status"}},
        "measures": {"Item Quantity": {"aggregation": "sum", "columns": [{"dataObject": "Items", "column": "Quantity"}]}, "Parts": {"aggregation": "count_distinct", "columns": [{"dataObject": "Items", "column": "Part"}]}, "Value": {"aggregation": "sum", "columns": [{"dataObject": "Orders", "column": "Total"}]}},
    }
    return Engine(made, frames({"orders": orders}))


QUERIES["nested_unnest"] = lambda spark, sf_dir: nested_engine(spark, sf_dir).query({"select": {"dimensions": ["Status"], "measures": ["Item Quantity", "Parts"]}})
ORACLE["nested_unnest"] = 'SELECT o_orderstatus AS "Status", CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DECIMAL(18,2)) AS "Item Quantity", count(DISTINCT l_partkey) AS "Parts" FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1'
QUERIES["nested_with_parent_measure"] = lambda spark, sf_dir: nested_engine(spark, sf_dir).query({"select": {"dimensions": ["Status"], "measures": ["Item Quantity", "Value"]}})
ORACLE["nested_with_parent_measure"] = 'SELECT o_orderstatus AS "Status", CAST(sum(q) AS DECIMAL(18,2)) AS "Item Quantity", CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS "Value" FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(8,2))) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1'

# the BI front end
for _name, _text, _sql in (
    ("where_having_order", "SELECT \"Region Name\", Revenue FROM trade WHERE segment = 'BUILDING' AND revenue > 100 GROUP BY 1 ORDER BY 2 DESC LIMIT 3", f"SELECT r_name AS \"Region Name\", {REV} AS \"Revenue\" FROM lines WHERE c_mktsegment = 'BUILDING' GROUP BY 1 HAVING sum(rev) > 100 ORDER BY 2 DESC LIMIT 3"),
    ("exists", "SELECT \"Nation Name\", \"Customer Count\" FROM trade WHERE EXISTS (SELECT 1 FROM Events WHERE type = 'purchase' AND Segment = 'BUILDING')", "SELECT n_name AS \"Nation Name\", count(*) AS \"Customer Count\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE c.c_nationkey = n_nationkey AND event_type = 'purchase' AND c.c_mktsegment = 'BUILDING') GROUP BY n_name"),
    ("not_exists", "SELECT Orders, \"Order Value\" FROM trade WHERE NOT EXISTS (SELECT 1 FROM Lineitem WHERE \"Return Flag\" = 'R' AND Brand = 'Brand#11')", f"SELECT count(*) AS \"Orders\", {VAL} AS \"Order Value\" FROM ords WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND p_brand = 'Brand#11')"),
    ("rollup", 'SELECT "Region Name", MEASURE("Order Value") FROM trade GROUP BY ROLLUP("Region Name")', f'SELECT r_name AS "Region Name", {VAL} AS "Order Value", grouping(r_name) AS "_g_Region Name" FROM ords GROUP BY ROLLUP(r_name)'),
    ("raw", "SELECT DISTINCT \"Customer\".\"Name\" FROM trade WHERE \"Region Name\" IN ('ASIA', 'EUROPE') AND NOT \"Customer\".\"Cust Key\" BETWEEN 5 AND 500", "SELECT DISTINCT c_name AS \"Customer.Name\" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND NOT c_custkey BETWEEN 5 AND 500"),
    ("or_condition", "SELECT \"Nation Name\", Orders FROM trade WHERE Segment = 'BUILDING' OR \"Region Name\" IS NULL OR \"Order Status\" LIKE 'F%'", "SELECT n_name AS \"Nation Name\", count(*) AS \"Orders\" FROM ords WHERE c_mktsegment = 'BUILDING' OR r_name IS NULL OR o_orderstatus LIKE 'F%' GROUP BY n_name"),
):
    QUERIES[f"sql_{_name}"] = lambda spark, sf_dir, text=_text: engine(spark, sf_dir).sql(text)
    used_parts = [PARTS[p] for p in PARTS if f" {p}" in _sql]
    ORACLE[f"sql_{_name}"] = (f"WITH {', '.join(used_parts)} " if used_parts else "") + _sql


# variants of the model: a static filter, a secondary path, one object in two roles
def variant(spark: SparkSession, sf_dir: str, change: Callable[[dict], None]) -> Engine:
    made = demo.document()
    change(made)
    return Engine(made, folder(spark, sf_dir))


def _static_filter(made: dict) -> None:
    made["filters"] = [{"dataObject": "Orders", "column": "Order Status", "operator": "inlist", "values": ["F", "O"]}]


def _secondary_path(made: dict) -> None:
    made["dataObjects"]["Lineitem"]["joins"].append({"joinType": "many-to-one", "joinTo": "Supplier", "columnsFrom": ["Part Key"], "columnsTo": ["Supp Key"], "secondary": True, "pathName": "by part"})


def _roles(made: dict) -> None:
    made["dataObjects"]["Supplier"]["joins"] = [{"joinType": "many-to-one", "joinTo": "Nation", "columnsFrom": ["Nation Key"], "columnsTo": ["Nation Key"]}]
    made["dimensions"] |= {f"{x} Nation": {"dataObject": "Nation", "column": "Name", "via": x} for x in ("Customer", "Supplier")}


_BY_REGION = {"select": {"dimensions": ["Region Name"], "measures": ["Orders"]}}
QUERIES["static_model_filter"] = lambda spark, sf_dir: variant(spark, sf_dir, _static_filter).query(_BY_REGION)
ORACLE["static_model_filter"] = f"WITH {ORDERS} SELECT r_name AS \"Region Name\", count(*) AS \"Orders\" FROM ords WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"
QUERIES["join_secondary_path"] = lambda spark, sf_dir: variant(spark, sf_dir, _secondary_path).query({"select": {"dimensions": ["Supplier Region Name"], "measures": ["Quantity"]}, "usePathNames": [{"source": "Lineitem", "target": "Supplier", "pathName": "by part"}]})
ORACLE["join_secondary_path"] = 'SELECT r_name AS "Supplier Region Name", CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DECIMAL(18,2)) AS "Quantity" FROM lineitem LEFT JOIN supplier ON l_partkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1'
QUERIES["join_via_two_roles"] = lambda spark, sf_dir: variant(spark, sf_dir, _roles).query({"select": {"dimensions": ["Customer Nation", "Supplier Nation"], "measures": ["Quantity"]}, "where": [{"field": "Customer Nation", "op": "starts_with", "value": "NATION_1"}]})
ORACLE["join_via_two_roles"] = f"WITH {LINES} SELECT n_name AS \"Customer Nation\", sn_name AS \"Supplier Nation\", CAST(sum(qty) AS DECIMAL(18,2)) AS \"Quantity\" FROM lines WHERE starts_with(n_name, 'NATION_1') GROUP BY 1, 2"
