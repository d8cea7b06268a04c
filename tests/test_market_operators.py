"""Hand-computed cases of filters, unions, facts, reports and rewrites."""

import json
import zipfile
from datetime import date, datetime

import pytest

from fathomlake.operators import allocation as A
from fathomlake.operators import filings as D
from fathomlake.operators import reports as R
from fathomlake.operators import retrieval as V
from fathomlake.sources import lake as L


def test_prices_fall_back_by_symbol(spark):
    rows = [("a", date(2024, 1, 1), 1.0), ("a", date(2024, 2, 1), 2.0), ("b", date(2024, 2, 1), 3.0), ("b", date(2024, 1, 5), None)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = lambda f: sorted(r.close for r in V.prices_between(df, "2024-01-01", "2024-01-31", fallback=f).collect())
    assert got(True) == [1.0, 3.0] and got(False) == [1.0]


def test_clean_crypto_and_universe(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None), (1.0, 0.0), (1.0, 5.0)], "open double, close double")
    assert sorted(map(tuple, V.clean_crypto(df).collect())) == [(0.0, 1.0), (1.0, 5.0)]
    u = spark.createDataFrame([("BRK.B", "NYSE"), ("BRK.B", "AMEX"), ("abc", "NYSE"), ("X", "OTC"), (None, "NYSE")], "symbol string, exchange string")
    assert [r.symbol for r in V.clean_universe(u).collect()] == ["BRK.B"]


def test_enforce_macro_without_names(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 15, 30), "invalid_rate"), (None, "4.5")], "index timestamp_ntz, rate string")
    from pyspark.sql import functions as F

    got = V.enforce_macro(df, "DGS10", "fred", F.lit("2024-01-02").cast("timestamp_ntz")).collect()
    assert {(r.date, r.value) for r in got} == {(date(2024, 1, 1), None), (None, 4.5)}


def test_facts_and_fiscal_year_from_archives(spark, tmp_path):
    nine = "a,b,c,d,e,f,g,h,i\n"
    with zipfile.ZipFile(tmp_path / "D1.zip", "w") as z:
        z.writestr("jpcrp.csv", nine + ',Sales,ctx,,,,,JPY,"1,000"\n,Bad,ctx,,,,,JPY,nan\n')
        z.writestr("jpdei.csv", nine + "x:CurrentFiscalYearEndDateDEI,,,,,,,,2022-03-31\n")
    with zipfile.ZipFile(tmp_path / "D2.zip", "w") as z:
        z.writestr("two.csv", "n,v\nProfit,7\n")
    rows = L.read_filing_archives(spark, str(tmp_path))
    got = {(r.doc_id, r.item_name, r.item_value, r.unit, r.context_id) for r in D.edinet_facts(rows).collect()}
    assert got == {("D1", "Sales", 1000.0, "JPY", "ctx"), ("D2", "7", 7.0, "pure", "two.csv")}
    filings = spark.createDataFrame([("D1", date(2023, 6, 1)), ("D2", date(2023, 6, 2)), ("D3", None)], "doc_id string, submitted date")
    assert {r.doc_id: r.fiscal_year for r in D.fiscal_year(rows, filings).collect()} == {"D1": 2022, "D2": 2023, "D3": None}


def test_resolve_metadata(spark):
    index = spark.createDataFrame([("1", "00012301"), ("1", "9")], "cik string, accession_number string")
    subs = spark.createDataFrame([("1", ["0001-23-01"], ["2024-01-01"], ["10-K"], ["a.htm"], ["Annual"])], "cik string, accessionNumber array<string>, filingDate array<string>, form array<string>, primaryDocument array<string>, primaryDocDescription array<string>")
    assert {r.accession_number: r.primaryDocument for r in D.resolve_metadata(index, subs).collect()} == {"00012301": "a.htm", "9": None}


def test_pack_sections_with_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "b", "2"), (1, "a", '"q"'), (1, "a", None), (2, None, "x")], "doc_id int, section string, content string")
    assert [(r.doc_id, json.loads(r.sections)) for r in D.pack_sections(df, "doc_id", "section", "content").collect()] == [(1, {"a": '"q"', "b": "2"})]


def test_evolve_and_replace(spark):
    old = spark.createDataFrame([(1, datetime(2024, 1, 1), None), (2, datetime(2024, 1, 2), "JPY")], "id int, date timestamp_ntz, currency string")
    new = D.evolve_transactions(old)
    assert "timestamp" in new.columns and {r.id: (r.currency, r.memo) for r in new.collect()} == {1: ("USD", None), 2: ("JPY", None)}
    assert D.evolve_transactions(new).columns == new.columns
    t = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 3)], "k string, d int, v int")
    b = spark.createDataFrame([("a", 1, 8), ("a", 1, 9)], "k string, d int, v int")
    assert sorted(r.v for r in D.replace_days(t, b, ["k", "d"]).collect()) == [3, 8, 9]


def test_compact_latest_writes_a_new_place(spark, tmp_path):
    spark.createDataFrame([("x", 1, 4.0), ("x", 2, 4.1), ("y", 1, 1.0)], "s string, load int, v double").write.parquet(f"{tmp_path}/a")
    L.compact_latest(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["s"], ["load"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/b").collect())) == [("x", 2, 4.1), ("y", 1, 1.0)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        L.compact_latest(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["s"], ["load"])


def test_union_statements(spark):
    one = spark.createDataFrame([("Revenue", 1.0)], "item string, value double")
    out = V.union_statements([(one, "financials", "Annual"), (one, "financials", "Quarterly"), (one, "cashflow", "Annual")])
    assert {t: sorted(r.period_type for r in df.collect()) for t, df in out.items()} == {"financials": ["Annual", "Quarterly"], "cashflow": ["Annual"]}


def test_cagr_and_yield(spark):
    px = spark.createDataFrame([("a", date(2021, 1, 1), 100.0), ("a", date(2023, 1, 1), 121.0), ("b", date(2023, 1, 1), 5.0)], "k string, d date, v double")
    got = {r.k: r.cagr for r in R.cagr(px, "k", "d", "v").collect()}
    assert round(got["a"], 6) == 10.0 and got["b"] is None
    tx = spark.createDataFrame([(1, "BUY", 10.0, 9.0, 10.0), (1, "DIVIDEND", 1.0, 5.0, None), (2, "DIVIDEND", 1.0, 5.0, None)], "account_id int, type string, quantity double, price double, fee double")
    held = spark.createDataFrame([(1, 105.0)], "account_id int, market_value double")
    assert {r.account_id: r.effective_yield for r in R.effective_yield(tx, held).collect()} == {1: 10.0, 2: None}


def test_allocation_inputs_and_targets(spark):
    wide = spark.createDataFrame([(1, 5.0, None), (2, 0.0, 0.0)], "account_id int, sp500 double, btc double")
    config = spark.createDataFrame([("sp500", "INDEX"), ("btc", "CRYPTO")], "asset string, category string")
    assert sorted(map(tuple, A.asset_results(wide, config).collect())) == [(1, "btc", "CRYPTO", 0.0), (1, "sp500", "INDEX", 5.0)]
    defaults = spark.createDataFrame([("INDEX", 0.6), ("CRYPTO", 0.4)], "category string, ratio double")
    own = spark.createDataFrame([(1, "INDEX", 0.5)], "account_id int, category string, ratio double")
    assert sorted(map(tuple, A.targets(defaults, own, wide).collect())) == [(1, "CRYPTO", 0.4), (1, "INDEX", 0.5), (2, "CRYPTO", 0.4), (2, "INDEX", 0.6)]


def test_only_named_members_of_an_archive_are_read(spark):
    from fathomlake.plans import lake_queries as K

    w = spark.createDataFrame([(1, 1, 5.0, date(2020, 3, 1)), (1, 2, 6.0, date(2021, 3, 1))], "code long, fiscal_period int, l_extendedprice double, disclosed_date date")
    assert {r.file_name for r in K._archives(w).collect()} == {"XBRL_TO_CSV/jpcrp-1.csv", "XBRL_TO_CSV/jpdei.csv"}
    assert [(r.file_name, r.c8) for r in K._archives(w, "jpdei").collect()] == [("XBRL_TO_CSV/jpdei.csv", "2021-03-01")]


def test_allocation_document_reads_positions_once(spark):
    from pyspark.sql import functions as F

    from fathomlake.plans import queries as Q

    plan = Q.QUERIES["allocation_markdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.split("\n") if "FileScan" in line and "l_orderkey" in line]) == 1
    h = spark.createDataFrame([(1, "F", "INDEX", 600.0), (1, "E", "INDEX", 200.0), (1, "X", "ART", 50.0), (1, "N", "INDEX", None)], "account_id int, asset string, category string, value double")
    t = spark.createDataFrame([("INDEX", 0.8), ("CASH", 0.2)], "category string, ratio double")
    (got,) = R.allocation_markdown(h, t, "USD").collect()
    assert got.markdown == """# Portfolio Rebalance Report

- Total: $800
- Required investment: $200
- Currency: USD

| Category | Target | Current | Status |
| :--- | :---: | :---: | :---: |
| CASH | 20.0% | 0.0% | UNDER |
| INDEX | 80.0% | 100.0% | OVER |

| Asset | Category | Value | Share |
| :--- | :--- | :---: | :---: |
| X | ART | $50 | 6.3% |
| E | INDEX | $200 | 25.0% |
| F | INDEX | $600 | 75.0% |

### CASH (+$200)"""
    assert [r.p for r in spark.createDataFrame([(-0.0034,), (0.0,), (None,), (1.23456,)], "x double").select(R.percent(F.col("x")).alias("p")).collect()] == ["-0.3%", "0.0%", None, "123.5%"]
