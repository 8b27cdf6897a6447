"""What each portable function means, by example."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessella import SemanticError
from tessella.functions.expressions import Builder, parse

EXAMPLES = [
    ("substring('hello', 2, 3)", "ell"), ("substring('hello', 3)", "llo"), ("concat('a', 'b', 'c')", "abc"), ("concat('a', NULL)", None), ("upper('aß')", "ASS"), ("lower('AB')", "ab"), ("trim('  x ')", "x"), ("ltrim('  x ')", "x "), ("rtrim(' x  ')", " x"),
    ("length('héllo')", 5), ("replace('banana', 'an', 'o')", "booa"), ("position('n', 'banana')", 3), ("position('z', 'banana')", 0), ("split_part('a-b-c', '-', 2)", "b"), ("split_part('a-b', '-', 5)", ""), ("lpad('abc', 5, '*')", "**abc"), ("lpad('abc', 2, '*')", "ab"), ("rpad('abc', 5, '*')", "abc**"),
    ("starts_with('hello', 'he')", True), ("ends_with('hello', 'lo')", True), ("abs(-3)", 3), ("sign(-2.5)", -1), ("floor(-1.5)", -2), ("ceil(-1.5)", -1), ("sqrt(16)", 4.0), ("exp(0)", 1.0), ("ln(1)", 0.0), ("ln(0)", None), ("power(2, 10)", 1024.0),
    ("round(7.125, 2)", 7.13), ("round(-2.5)", -3.0), ("round(2.5)", 3.0), ("trunc(-1.9)", -1.0), ("trunc(-8.769, 2)", -8.76), ("trunc(4.7, 2)", 4.7), ("trunc(CAST('3e30' AS double))", 3e30), ("div(CAST('8e30' AS double), CAST('2e30' AS double))", 4), ("div(-9, CAST('4e30' AS double))", 0), ("mod(-17, 5)", -2), ("mod(7, 0)", None), ("div(-7, 2)", -3), ("div(7, 0)", None), ("log(3, 81)", 4.0), ("log(1, 5)", None), ("log(10, 0)", None),
    ("coalesce(NULL, 'x')", "x"), ("nullif(1, 1)", None), ("greatest(1, 3, 2)", 3), ("greatest(1, NULL)", None), ("least(1, NULL)", None), ("least(3, 2)", 2),
    ("date_trunc('week', DATE '2024-03-15')", dt.datetime(2024, 3, 11)), ("date_add('month', 1, DATE '2023-01-31')", dt.datetime(2023, 2, 28)), ("date_add('quarter', 2, DATE '2024-01-15')", dt.datetime(2024, 7, 15)), ("date_add('day', -1, DATE '2024-03-01')", dt.datetime(2024, 2, 29)),
    ("date_diff('day', TIMESTAMP '2024-01-01 23:00:00', TIMESTAMP '2024-01-02 01:00:00')", 1), ("date_diff('year', DATE '2023-12-31', DATE '2024-01-01')", 1), ("date_diff('month', DATE '2024-01-31', DATE '2024-02-01')", 1), ("date_diff('week', DATE '2024-03-10', DATE '2024-03-11')", 1), ("date_diff('hour', TIMESTAMP '2024-01-01 00:59:00', TIMESTAMP '2024-01-01 01:00:00')", 1),
    ("extract('year', DATE '2024-03-15')", 2024), ("EXTRACT(week FROM DATE '2024-12-30')", 1), ("extract('second', TIMESTAMP '2024-01-01 00:00:07')", 7), ("last_day(DATE '2024-02-10')", dt.date(2024, 2, 29)),
    ("json_value('{\"a\": {\"b\": \"x\"}}', '$.a.b')", "x"), ("json_value('{\"a\": {\"b\": 1}}', '$.a')", None), ("json_value('{\"a\": [1, 2]}', '$.a[1]')", "2"), ("json_value('{\"a\": [1]}', '$.a')", None), ("json_value('{\"a\": true}', '$.a')", "true"), ("json_value('{\"a\": null}', '$.a')", None), ("json_value('not json', '$.a')", None), ("json_value('{}', '$.a')", None),
    ("1 / 0", None), ("7 / 2", 3.5), ("2 + 3 * 4 - -1", 15), ("NOT 1 = 2 AND 3 > 2", True), ("CASE WHEN 1 > 2 THEN 'a' ELSE 'b' END", "b"), ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'c' END", "c"), ("'it''s' || '!'", "it's!"), ("3 NOT IN (1, 2)", True), ("5 BETWEEN 1 AND 10", True), ("'abc' LIKE 'a%'", True), ("NULL IS NULL", True), ("CAST('12' AS int) + 1", 13), ("10 % 4", 2),
]


def build(text, **more):
    return Builder(lambda parts: F.col(parts[0]), **more).build(parse(text))


def test_examples(spark):
    row = spark.range(1).select(*(build(t).alias(f"c{i}") for i, (t, _) in enumerate(EXAMPLES))).first()
    wrong = []
    for i, (text, want) in enumerate(EXAMPLES):
        got = float(row[i]) if isinstance(row[i], Decimal) else row[i]
        if got != want and not (isinstance(want, float) and got is not None and abs(got - want) < 1e-9):
            wrong.append((text, want, got))
    assert not wrong


def test_weeks_may_start_on_sunday(spark):
    assert spark.range(1).select(build("date_trunc('week', DATE '2024-03-15')", week_start="sunday")).first()[0] == dt.datetime(2024, 3, 10)
    assert spark.range(1).select(build("date_diff('week', DATE '2024-03-09', DATE '2024-03-10')", week_start="sunday")).first()[0] == 1


@pytest.mark.parametrize(("text", "code"), [("1 +", "EXPRESSION_SYNTAX"), ("date_trunc('eon', x)", "UNKNOWN_UNIT"), ("substring('a')", "ARGUMENT_COUNT"), ("CAST(1 AS blob)", "UNKNOWN_TYPE"), ("json_value(x, 'a..b')", "JSON_PATH"), ("json_value(x, '$')", "JSON_PATH")])
def test_refusals(spark, text, code):
    with pytest.raises(SemanticError) as e:
        build(text)
    assert e.value.code == code


def test_other_functions_pass_unless_portable(spark):
    said = []
    assert spark.range(1).select(build("reverse('abc')", warn=said.append)).first()[0] == "cba" and said
    with pytest.raises(SemanticError, match="NON_PORTABLE_FUNCTION"):
        build("reverse('abc')", portable=True)
