"""Every finance query against its SQL, and hand-computed cases."""

import math
import re
from datetime import date, datetime

import duckdb
import pytest

from fathomlake.functions import scalars as X
from fathomlake.operators import allocation as A
from fathomlake.operators import portfolio as P
from fathomlake.operators import series as S
from fathomlake.plans import queries as Q
from fathomlake.plans.bindings import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", Q.ORACLE)
def test_same_as_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str)
    rel = duck.sql(Q.ORACLE[name])
    at = [rel.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert sorted(rel.columns) == names
    assert mine == theirs


TX = "account_id int, ticker string, asset_type string, type string, price double, quantity double, fee double, currency string, timestamp timestamp_ntz"


def test_positions(spark):
    rows = [(1, "AAPL", "STOCK", "BUY", 150.0, 10.0, 0.0, None, datetime(2023, 1, 1)), (1, "AAPL", "STOCK", "SELL", 160.0, 4.0, 0.0, "USD", datetime(2023, 1, 2))]
    got = P.positions(spark.createDataFrame(rows, TX)).collect()
    assert [(r.quantity, r.avg_price, r.currency) for r in got] == [(6.0, 150.0, "USD")]


def test_shadow(spark):
    fx = spark.createDataFrame([("JPY", 0.007)], "symbol string, rate double")
    px = spark.createDataFrame([(date(2023, 1, 1), 4000.0)], "date date, price double")
    rows = [(1, "A", "STOCK", "BUY", 100.0, 1.0, 0.0, "USD", datetime(2023, 1, 3)), (2, "B", "STOCK", "BUY", 10000.0, 10.0, 0.0, "JPY", datetime(2023, 1, 1)), (3, "C", "STOCK", "BUY", 1.0, 1.0, 0.0, "USD", datetime(2000, 1, 1))]
    got = {r.account_id: (r.shadow_cost, round(r.shadow_units, 9)) for r in P.shadow_benchmark(spark.createDataFrame(rows, TX), px, fx, ["account_id"]).collect()}
    assert got == {1: (100.0, 0.025), 2: (700.0, 0.175)}


def test_drawdown_and_risk(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([100.0, 110.0, 55.0, 60.0])] + [(2, i, 100.0) for i in range(3)], "a int, d int, v double")
    assert {r.a: r.max_drawdown for r in S.max_drawdown(df, ["a"], "d", "v").collect()} == {1: -50.0, 2: 0.0}
    flat = S.risk_metrics(S.daily_returns(df.where("a = 2"), ["a"], "d", "v"), ["a"]).first()
    assert (flat.volatility, flat.sharpe) == (0.0, 0.0)


def test_latest_wins_is_idempotent(spark):
    df = spark.createDataFrame([("x", 1, 10, 4.0), ("x", 1, 11, 4.1), ("y", 1, 9, 1.0)], "s string, d int, load int, v double")
    once = S.latest_wins(df, ["s", "d"], ["load"])
    assert sorted(map(tuple, once.collect())) == [("x", 1, 11, 4.1), ("y", 1, 9, 1.0)]
    assert sorted(map(tuple, S.latest_wins(once.union(df), ["s", "d"], ["load"]).collect())) == sorted(map(tuple, once.collect()))


def test_rebalance(spark):
    h = spark.createDataFrame([(1, "INDEX", 100000.0), (1, "CASH", 900000.0)], "account_id int, category string, value double")
    t = spark.createDataFrame([("INDEX", 0.6), ("STOCK", 0.3), ("CASH", 0.1)], "category string, ratio double")
    plan = {r.category: (r.new_total, r.buy) for r in A.rebalance_plan(A.category_drift(h, t)).collect()}
    assert plan["INDEX"] == (1_000_000.0, 500_000.0) and plan["CASH"][1] == 0.0


def test_scalars(spark):
    df = spark.createDataFrame([("72030", "btc-usd ", "1,234.5", "NetSalesTextBlock"), ("7203", "a b", "nan", None)], "code string, t string, n string, s string")
    got = df.select(X.normalize_jp_code(df.code), X.standardize_ticker(df.t), X.parse_number(df.n), X.normalize_section(df.s)).collect()
    assert [tuple(r) for r in got] == [("7203", "BTC", 1234.5, "net_sales"), ("7203", None, None, None)]


def test_us_facts_that_share_a_key(spark, tmp_path):
    """Two positions of one order, line and day are facts of one key: the greater one stays, in the query and in its SQL."""
    day = datetime(1997, 5, 1)
    rows = [(1, 1, 7, 1, 5.0, price, 0.0, 0.0, "N", "O", day) for price in (100.0, 300.0, 200.0)] + [(1, 1, 7, 2, 5.0, 50.0, 0.0, 0.0, "N", "O", day)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    mine = sorted((r.concept, r.value) for r in Q.QUERIES["normalize_us_facts"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    theirs = sorted(con.sql(f"SELECT concept, value FROM ({Q.ORACLE['normalize_us_facts']})").fetchall())
    assert mine == theirs == [("us-gaap:Item1", 300.0), ("us-gaap:Item2", 50.0)]


def test_sections_of_odd_documents(spark, tmp_path):
    """Documents without text, language or source, with markup, white space and headings of other sections in them: the query and its SQL are one rule."""
    odd = [None, "", " \t", "x", "a  b", "a & b &amp; <b>c</b>", "a\r b", "\x85a\xa0", "x   y ", "a\n\n \n\n b", "Signatures", "[Signatures](#s)", "signatures" + "z" * 250, "x\nItem 7. Management", "Item\x0b8. Financial", "ſignatures"]
    rows = [(i * 6 + k, text, lang, source, 0) for i, (text, lang, source) in enumerate([*((t, "en", "s") for t in odd), *(("t", x, y) for x in odd for y in odd)]) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    mine = sorted(map(tuple, Q.QUERIES["extract_sections"](spark, str(tmp_path)).select("doc_id", "business", "risk_factors", "signatures").collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert mine == sorted(con.sql(f"SELECT doc_id, business, risk_factors, signatures FROM ({Q.ORACLE['extract_sections']})").fetchall())
    got, business = {r[0]: r[1:] for r in mine}, "## Item 1. Business\n\nOf"
    assert got[2] == got[8] == got[14] == (business, "## ITEM 1A. Risk Factors\n\ns **much**", "## Signatures\n\nen")
    at = {(r[2], r[3]): r[0] for r in rows if r[0] % 6 == 2 and r[0] >= 6 * len(odd)}
    assert got[at[None, ""]] == (f"{business} t", "## ITEM 1A. Risk Factors\n\n**much**", "## Signatures")
    assert got[at[odd[5], odd[5]]] == (f"{business} t", f"## ITEM 1A. Risk Factors\n\n{odd[5]} **much**", f"## Signatures\n\n{odd[5]}")
    assert got[at["x", "Signatures"]] == (f"{business} t", "## ITEM 1A. Risk Factors", "Signatures **much**\n\n## Signatures\n\nx")


def test_sides_of_few_keys_go_to_all_tasks(spark):
    """Joins by currency, ticker or day deal nothing by those keys, whatever size Spark takes the small side to have."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = Q.QUERIES["alpha_metrics"](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange hashpartitioning\((\w+?)#\d+, \d+\), ENSURE", plan)
    joined = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin).*", plan)
    assert dealt and not any(re.search(r"\[(?:currency|ticker|_day|cast\(timestamp)", j) for j in joined)


def test_positions_meet_their_orders_in_tasks_of_a_size(spark):
    """Adaptive execution joins small partitions to larger ones again; those of the meeting stay as many as they were made."""
    df = Q.QUERIES["positions"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan) and int(re.search(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", plan)[1]) >= 8
