"""A model of the TPC-H-like test tables, for the registered queries, the tests and the bench."""

from __future__ import annotations

from .model import Model, load


def _columns(prefix: str, **kinds: str) -> dict:
    out = {}
    for name, kind in kinds.items():
        kind, _, mark = kind.partition("*")
        label = name.replace("_", " ").title()
        out[label] = {"code": f"{prefix}{name.replace('_', '')}", "abstractType": "float" if kind.startswith("money") else kind}
        if kind.startswith("money"):
            out[label] |= {"sqlType": "decimal", "sqlPrecision": int(kind[5:] or 12), "sqlScale": 2}
        if mark == "key":
            out[label]["primaryKey"] = True
    return out


def _join(to: str, start: str, end: str, **more) -> dict:
    return {"joinType": "many-to-one", "joinTo": to, "columnsFrom": [start], "columnsTo": [end], **more}


def _column(obj: str, name: str) -> dict:
    return {"dataObject": obj, "column": name}


def _measure(aggregation: str, *columns: tuple[str, str], **more) -> dict:
    return {"aggregation": aggregation, "columns": [_column(*c) for c in columns], **more}


REVENUE = "{[Lineitem].[Extended Price]} * (1 - {[Lineitem].[Discount]})"


def document() -> dict:
    nation = _columns("n_", nation_key="int*key", name="string", region_key="int")
    region = _columns("r_", region_key="int*key", name="string")
    objects = {
        "Region": {"code": "region", "columns": region},
        "Nation": {"code": "nation", "columns": nation, "joins": [_join("Region", "Region Key", "Region Key")]},
        "Supplier Region": {"code": "region", "columns": region},
        "Supplier Nation": {"code": "nation", "columns": nation, "joins": [_join("Supplier Region", "Region Key", "Region Key")]},
        "Customer": {
            "code": "customer",
            "columns": _columns("c_", cust_key="int*key", name="string", nation_key="int", acct_bal="money", mkt_segment="string")
            | {"Segment Initial": {"expression": "substring({Mkt Segment}, 1, 1)", "abstractType": "string"}},
            "joins": [_join("Nation", "Nation Key", "Nation Key")],
        },
        "Supplier": {"code": "supplier", "columns": _columns("s_", supp_key="int*key", name="string", nation_key="int", acct_bal="money"), "joins": [_join("Supplier Nation", "Nation Key", "Nation Key")]},
        "Part": {"code": "part", "columns": _columns("p_", part_key="int*key", name="string", brand="string", type="string", size="int", retail_price="money")},
        "Orders": {
            "code": "orders",
            "columns": _columns("o_", order_key="int*key", cust_key="int", order_status="string", total_price="money", order_date="timestamp", order_priority="string"),
            "joins": [_join("Customer", "Cust Key", "Cust Key")],
        },
        "Lineitem": {
            "code": "lineitem",
            "columns": _columns("l_", order_key="int", part_key="int", supp_key="int", line_number="int", quantity="money8", extended_price="money", discount="money4", tax="money4", return_flag="string", line_status="string", ship_date="timestamp"),
            "joins": [_join("Orders", "Order Key", "Order Key"), _join("Part", "Part Key", "Part Key"), _join("Supplier", "Supp Key", "Supp Key")],
        },
        "Events": {
            "code": "events",
            "columns": {
                "Event ID": {"code": "event_id", "abstractType": "int", "primaryKey": True},
                "Time": {"code": "ts", "abstractType": "timestamp"},
                "User": {"code": "user_id", "abstractType": "int"},
                "Type": {"code": "event_type", "abstractType": "string"},
                "Value": {"code": "value", "abstractType": "float", "sqlType": "decimal", "sqlPrecision": 18, "sqlScale": 4},
                "Props": {"code": "props", "abstractType": "json"},
                "Prop K": {"expression": "json_value({Props}, '$.k')", "abstractType": "string"},
            },
            "joins": [_join("Customer", "User", "Cust Key")],
        },
        "Documents": {
            "code": "documents",
            "columns": {
                "Doc ID": {"code": "doc_id", "abstractType": "int", "primaryKey": True},
                "Lang": {"code": "lang", "abstractType": "string"},
                "Source": {"code": "source", "abstractType": "string"},
                "Characters": {"code": "n_chars", "abstractType": "int"},
            },
        },
        "Labels": {
            "code": "labels",
            "columns": {"Doc": {"code": "doc_id", "abstractType": "int"}, "Quality": {"code": "quality", "abstractType": "int"}, "Toxic": {"code": "toxic", "abstractType": "int"}},
            "joins": [_join("Documents", "Doc", "Doc ID", required=True)],
        },
    }
    dimensions = {
        "Region Name": _column("Region", "Name"), "Nation Name": _column("Nation", "Name"), "Segment": _column("Customer", "Mkt Segment"), "Segment Initial": _column("Customer", "Segment Initial"),
        "Customer": _column("Customer", "Name"), "Supplier Nation Name": _column("Supplier Nation", "Name"), "Supplier Region Name": _column("Supplier Region", "Name"),
        "Brand": _column("Part", "Brand"), "Part Size": _column("Part", "Size") | {"resultType": "int"}, "Order Status": _column("Orders", "Order Status"), "Order Priority": _column("Orders", "Order Priority"),
        "Order Month": _column("Orders", "Order Date") | {"resultType": "date", "timeGrain": "month"}, "Order Year": _column("Orders", "Order Date") | {"resultType": "date", "timeGrain": "year"},
        "Ship Month": _column("Lineitem", "Ship Date") | {"resultType": "date", "timeGrain": "month"}, "Return Flag": _column("Lineitem", "Return Flag"), "Line Status": _column("Lineitem", "Line Status"),
        "Event Type": _column("Events", "Type"), "Event Hour": _column("Events", "Time") | {"resultType": "timestamp", "timeGrain": "hour"}, "Event Day": _column("Events", "Time") | {"resultType": "date", "timeGrain": "day"}, "Event Prop": _column("Events", "Prop K"),
        "Lang": _column("Documents", "Lang"), "Source": _column("Documents", "Source"), "Quality": _column("Labels", "Quality") | {"resultType": "int"},
    }
    flag = lambda v: [{"column": _column("Lineitem", "Return Flag"), "operator": "equals", "values": [{"dataType": "string", "valueString": v}]}]
    measures = {
        "Revenue": {"aggregation": "sum", "expression": REVENUE},
        "Quantity": _measure("sum", ("Lineitem", "Quantity")),
        "Average Price": _measure("avg", ("Lineitem", "Extended Price")),
        "Average Line": _measure("avg", ("Lineitem", "Line Number")),
        "Largest Price": _measure("max", ("Lineitem", "Extended Price")),
        "Smallest Price": _measure("min", ("Lineitem", "Extended Price")),
        "Line Sum": _measure("sum", ("Lineitem", "Line Number"), resultType="int"),
        "Suppliers Used": _measure("count_distinct", ("Lineitem", "Supp Key")),
        "Lines Shipped": _measure("count", ("Lineitem", "Part Key"), ("Lineitem", "Supp Key")),
        "Returned Revenue": {"aggregation": "sum", "expression": REVENUE, "filters": flag("R")},
        "Special Revenue": {"aggregation": "sum", "expression": REVENUE, "filters": flag("?"), "defaultValue": 0},
        "Returned Or Bulky": {"aggregation": "count", "columns": [_column("Lineitem", "Order Key")], "filters": [{"logic": "or", "filters": [*flag("R"), {"column": _column("Lineitem", "Quantity"), "operator": "gt", "values": [{"dataType": "float", "valueFloat": 40}]}]}]},
        "Total Revenue": {"aggregation": "sum", "expression": REVENUE, "total": True},
        "Total Average Price": _measure("avg", ("Lineitem", "Extended Price"), total=True),
        "Total Largest Price": _measure("max", ("Lineitem", "Extended Price"), total=True),
        "Region Revenue": {"aggregation": "sum", "expression": REVENUE, "grain": {"mode": "FIXED", "keepOnly": ["Region Name"]}},
        "Revenue Without Segment": {"aggregation": "sum", "expression": REVENUE, "grain": {"mode": "RELATIVE", "exclude": ["Segment"]}},
        "All Flags Revenue": {"aggregation": "sum", "expression": REVENUE, "filterContext": {"mode": "RELATIVE", "exclude": ["Return Flag"]}},
        "Fixed Status Revenue": {"aggregation": "sum", "expression": REVENUE, "filterContext": {"mode": "FIXED", "include": [{"field": "Order Status", "op": "equals", "value": "O"}]}},
        "Grand Unfiltered Revenue": {"aggregation": "sum", "expression": REVENUE, "filterContext": {"mode": "FIXED"}, "grain": {"mode": "FIXED"}},
        "Order Value": _measure("sum", ("Orders", "Total Price")),
        "Orders": _measure("count", ("Orders", "Order Key"), resultType="int"),
        "Average Order Value": _measure("avg", ("Orders", "Total Price")),
        "Median Order Value": _measure("median", ("Orders", "Total Price")),
        "Order Value Deviation": _measure("stddev", ("Orders", "Total Price")),
        "Order Value Variance": _measure("var_pop", ("Orders", "Total Price")),
        "Order Value Population Deviation": _measure("stddev_pop", ("Orders", "Total Price")),
        "Order Value Sample Variance": _measure("variance", ("Orders", "Total Price")),
        "Usual Size": _measure("mode", ("Part", "Size")),
        "Customer Balance": _measure("sum", ("Customer", "Acct Bal")),
        "Average Balance": _measure("avg", ("Customer", "Acct Bal")),
        "Fanned Order Value": _measure("sum", ("Orders", "Total Price"), allowFanOut=True),
        "Any Status": _measure("any_value", ("Orders", "Order Status")),
        "Statuses": _measure("listagg", ("Orders", "Order Status"), distinct=True, delimiter="|", withinGroup={"column": _column("Orders", "Order Status"), "order": "ASC"}),
        "Nations": _measure("listagg", ("Nation", "Name"), delimiter=", ", withinGroup={"column": _column("Nation", "Nation Key"), "order": "DESC"}),
        "Price Quantity Correlation": _measure("corr", ("Lineitem", "Extended Price"), ("Lineitem", "Quantity")),
        "Price Quantity Slope": _measure("regr_slope", ("Lineitem", "Extended Price"), ("Lineitem", "Quantity")),
        "Price Quantity Intercept": _measure("regr_intercept", ("Lineitem", "Extended Price"), ("Lineitem", "Quantity")),
        "Price Quantity Covariance": _measure("covar_samp", ("Lineitem", "Extended Price"), ("Lineitem", "Quantity")),
        "Price Quantity Population Covariance": _measure("covar_pop", ("Lineitem", "Extended Price"), ("Lineitem", "Quantity")),
        "Event Value": _measure("sum", ("Events", "Value"), dataType="decimal(18,4)"),
        "Events": _measure("count", ("Events", "Event ID"), resultType="int"),
        "Active Users": _measure("count_distinct", ("Events", "User")),
        "Value Per Order Spend": {"aggregation": "sum", "expression": "{[Events].[Value]} * {[Orders].[Total Price]}", "anchor": "Events", "dataType": "decimal(38,4)"},
        "Characters": _measure("sum", ("Documents", "Characters"), resultType="int"),
        "Average Characters": _measure("avg", ("Documents", "Characters")),
        "Toxic": _measure("sum", ("Labels", "Toxic"), resultType="int"),
    }
    pop = lambda how, offset=-1, unit="month": {"type": "period_over_period", "expression": "{[Order Value]}", "periodOverPeriod": {"timeDimension": "Order Month", "grain": "month", "offset": offset, "offsetGrain": unit, "comparison": how}}
    window = lambda kind, **more: {"type": "window", "windowFunction": kind, "measure": "Order Value", **more}
    running = lambda **more: {"type": "cumulative", "measure": "Order Value", "timeDimension": "Order Month", **more}
    metrics = {
        "Revenue Per Order": {"expression": "{[Revenue]} / {[Orders]}"},
        "Revenue Share": {"expression": "{[Revenue]} / {[Total Revenue]}"},
        "Returned Share": {"expression": "{[Returned Revenue]} / {[Revenue]}"},
        "Returned Percent": {"expression": "100 * {[Returned Share]}", "dataType": "decimal(18,4)"},
        "Revenue Of All Flags": {"expression": "{[Revenue]} / {[All Flags Revenue]}"},
        "Net Value": {"expression": "{[Order Value]} - {[Event Value]}"},
        "Running Value": running(), "Rolling Value": running(window=3), "Rolling Average": running(window=3, cumulativeType="avg", dataType="decimal(18,4)"), "Year To Date": running(grainToDate="year"),
        "Running By Status": running(partitionBy=["Order Status"]), "Running Largest": running(cumulativeType="max"), "Running Least": running(cumulativeType="min"), "Months So Far": running(cumulativeType="count"),
        "Value Rank": window("rank"), "Value Dense Rank": window("dense_rank", orderDirection="asc"), "Value Row": window("row_number", partitionBy=["Region Name"]), "Value Quartile": window("ntile", buckets=4),
        "Previous Value": window("lag", timeDimension="Order Month", offset=1), "Next Value": window("lead", timeDimension="Order Month", offset=2, defaultValue=0),
        "First Value": window("first_value", timeDimension="Order Month", orderDirection="asc"), "Last Value": window("last_value", timeDimension="Order Month", orderDirection="asc"),
        "Value Change": {"expression": "{[Order Value]} - {[Previous Value]}"},
        "Value Month Ago": pop("previousValue"), "Value Difference": pop("difference"), "Value Ratio": pop("ratio"), "Value Percent": pop("percentChange"), "Value Year Ago": pop("previousValue", -1, "year"),
    }
    return {"version": 1.0, "name": "trade", "dataObjects": objects, "dimensions": dimensions, "measures": measures, "metrics": metrics}


def model() -> Model:
    return load(document())
