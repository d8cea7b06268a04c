"""Hand-computed cases of the ledger, statement and series operators."""

from datetime import date, datetime

from pyspark.sql import functions as F

from fathomlake.functions import scalars as X
from fathomlake.operators import filings as D
from fathomlake.operators import portfolio as P
from fathomlake.operators import series as S


def test_asof_price_takes_the_nearest_day_before(spark):
    px = spark.createDataFrame([(date(2023, 1, 1), 10.0), (date(2023, 1, 3), 0.0), (date(2023, 1, 4), 12.0), (None, 5.0)], "date date, price double")
    tx = spark.createDataFrame([(1, datetime(2023, 1, 3, 9)), (2, datetime(2023, 1, 6)), (3, datetime(2023, 1, 9)), (4, datetime(2023, 1, 10)), (5, datetime(2022, 12, 31)), (1, datetime(2023, 1, 3, 9)), (6, None)], "id int, timestamp timestamp_ntz")
    assert sorted((r.id, r.asof_price) for r in P.asof_price(tx, px).collect()) == [(1, 10.0), (1, 10.0), (2, 12.0), (3, 12.0)]


def test_daily_values_sum_what_is_priced(spark):
    px = spark.createDataFrame([("a", date(2023, 1, 1), 2.0), ("a", date(2023, 1, 2), 3.0), ("b", date(2023, 1, 2), 10.0), ("b", date(2023, 1, 3), None), ("a", date(2023, 1, 4), 9.0)], "ticker string, date date, close double")
    pos = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0), (2, "b", 4.0), (3, "zz", 1.0)], "account_id int, ticker string, quantity double")
    dates = spark.createDataFrame([(date(2023, 1, d),) for d in (1, 2, 3)], "date date")
    got = {(r.account_id, r.date.day): r.value for r in P.daily_values(px, pos, dates).collect()}
    assert got == {(1, 1): 4.0, (1, 2): 16.0, (2, 2): 40.0}
    assert P.daily_values(px.limit(0), pos, dates).count() == 0


def test_beta_is_null_where_the_counts_differ(spark):
    own = spark.createDataFrame([("p", date(2023, 1, d), r) for d, r in ((1, 0.01), (2, 0.02), (3, -0.01))] + [("q", date(2023, 1, 1), 0.5)], "k string, date date, ret double")
    bench = own.where("k = 'p'").select("date", "ret")
    got = {r.k: (r.beta, r.corr) for r in S.aligned_beta_corr(own, bench, ["k"], "date").collect()}
    assert [round(x, 9) for x in got["p"]] == [1.0, 1.0] and got["q"] == (None, None)


def test_section_names(spark):
    names = ["BusinessRisksTextBlock", "AnalysisOfFinancialPositionOperatingResultsAndCashFlowsTextBlock", "SomeOtherTextBlock", None]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(X.normalize_section(df.s)).collect()] == ["business_risk", "mda", "some_other", None]


def test_statements_stack_and_facts_get_keys(spark):
    wide = spark.createDataFrame([("Revenue", 1.0, 2.0), ("Net Income", None, 4.0)], "item string, `2023-12-31` double, `2022-12-31 00:00:00` double").withColumn("ticker", F.lit("T"))
    got = sorted(tuple(r) for r in D.stack_statements(wide, "item", "Annual", ["ticker"]).collect())
    assert got == [("T", "Net Income", "2022-12-31", 4.0, "Annual"), ("T", "Revenue", "2022-12-31", 2.0, "Annual"), ("T", "Revenue", "2023-12-31", 1.0, "Annual")]
    facts = spark.createDataFrame([("T", "a", "c", "l", "5", "USD", "2024", "FY", None, None, "2024-01-01"), ("T", "a", "c", "l", None, "USD", "2024", "FY", None, None, "2024-01-01")], "ticker string, accession_number string, concept string, label string, numeric_value string, unit_ref string, fiscal_year string, fiscal_period string, period_start string, period_end string, period_instant string")
    (row,) = D.normalize_us_facts(facts).collect()
    import hashlib

    assert (row.fact_id, row.value, row.fiscal_year, row.period_instant) == (hashlib.md5(b"T|a|c|2024-01-01").hexdigest(), 5.0, 2024, date(2024, 1, 1))


def test_splits_rates_and_batches(spark):
    px = spark.createDataFrame([("a", 1, 10.0, 0.0), ("a", 2, 20.0, 2.0), ("a", 3, 5.0, None), ("a", 4, 5.1, 1.0), ("a", 5, 50.0, 1.0)], "t string, d int, close double, stock_splits double")
    assert [(r.d, r.with_split) for r in S.price_spikes(px, "t", "d", "close", split="stock_splits").orderBy("d").collect()] == [(2, True), (3, False), (5, False)]
    fx = spark.createDataFrame([("JPY", 0.5, 1), ("JPY", float("nan"), 2), ("USD", 7.0, 1)], "symbol string, rate double, at int")
    assert {r.symbol: r.rate for r in S.latest_rates(fx, ["at"]).collect()} == {"JPY": None, "USD": 1.0}
    batch = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "Code int, v string")
    assert [r.code for r in D.companies_in_batch(batch).collect()] == ["1"]
    assert [r[0] for r in batch.select(X.normalize_jp_code(F.lit(" 72030 "), ".T")).limit(1).collect()] == ["7203.T"]


def test_accounts_are_dealt_before_their_days(spark):
    """Every account gets a row for each day, so small partitions of accounts are not joined to larger ones before."""
    px = spark.createDataFrame([("A", date(2024, 1, d), 2.0) for d in (1, 2)], "ticker string, date date, close double")
    pos = spark.range(100).selectExpr("id as account_id", "'A' as ticker", "1.0D as quantity")
    df = P.daily_values(px, pos, px.select("date"))
    assert df.count() == 200 and df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1
