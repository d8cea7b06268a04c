"""The driver's tables as finance tables: SQL that runs unchanged in Spark and in the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()
_DAY = "(l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity)"

SQL = {
    "transactions": """SELECT o.o_custkey AS account_id, p.p_brand AS ticker,
        CASE WHEN CAST(substr(p.p_brand, 7) AS INT) > 20 THEN 'CRYPTO' ELSE 'STOCK' END AS asset_type,
        CASE WHEN l.l_returnflag = 'R' THEN 'SELL' WHEN l.l_returnflag = 'A' AND l.l_linenumber = 7 THEN 'DIVIDEND' ELSE 'BUY' END AS type,
        l.l_extendedprice / l.l_quantity AS price, l.l_quantity AS quantity, abs(l.l_extendedprice * l.l_tax / 100) AS fee,
        CASE r.r_name WHEN 'AMERICA' THEN 'USD' WHEN 'ASIA' THEN 'JPY' WHEN 'EUROPE' THEN 'EUR' WHEN 'AFRICA' THEN 'CNY' END AS currency,
        o.o_orderdate AS timestamp
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "stock_prices": f"""SELECT p.p_brand AS ticker, CAST(l.l_shipdate AS DATE) AS date, min_by(l.l_extendedprice / l.l_quantity, {_DAY}) AS open,
        max(l.l_extendedprice / l.l_quantity) AS high, min(l.l_extendedprice / l.l_quantity) AS low,
        max_by(l.l_extendedprice / l.l_quantity, {_DAY}) AS close, CAST(sum(l.l_quantity) AS BIGINT) AS volume
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, CAST(l.l_shipdate AS DATE)""",
    "benchmark_daily": """SELECT '^GSPC' AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 100 AS open,
        max(o_totalprice) / 100 AS high, min(o_totalprice) / 100 AS low, (min(o_totalprice) + max(o_totalprice)) / 200 AS close, count(*) AS volume
        FROM orders WHERE extract(DAY FROM o_orderdate) NOT BETWEEN 11 AND 18 AND extract(DAY FROM o_orderdate) % 7 <> 0
        GROUP BY CAST(o_orderdate AS DATE)""",
    "fx_load": """SELECT CASE event_type WHEN 'click' THEN 'JPY' WHEN 'view' THEN 'EUR' WHEN 'purchase' THEN 'CNY' WHEN 'signup' THEN 'GBP' ELSE 'AUD' END AS symbol,
        CAST(ts AS DATE) AS date, value / 100 AS rate, ts AS load_timestamp FROM events""",
    "macro_load": """SELECT CASE WHEN user_id % 2 = 0 THEN 'DGS10' ELSE 'DFF' END AS symbol, CAST(ts AS DATE) AS date,
        value / 10 AS value, 'events' AS source, ts AS load_timestamp, event_id AS tiebreak FROM events""",
    "profile_snapshots": """SELECT user_id AS ticker, ts AS snapshot_at, event_id AS tiebreak, event_type AS sector,
        CASE WHEN value > 50 THEN 'large' ELSE NULL END AS industry FROM events""",
    "filings": """SELECT doc_id, source AS edinet_code, lang AS sec_code, n_chars,
        CASE doc_id % 8 WHEN 0 THEN '030000' WHEN 1 THEN '030001' WHEN 2 THEN '043000' WHEN 3 THEN '043001'
        WHEN 4 THEN '040000' WHEN 5 THEN '040001' WHEN 6 THEN '020000' ELSE NULL END AS form_code FROM documents""",
    "narratives_present": "SELECT DISTINCT doc_id FROM labels",
    "facts_present": "SELECT DISTINCT doc_id FROM labels WHERE quality = 1",
    "facts_wide": """SELECT l_orderkey AS code, l_linenumber AS fiscal_period, CAST(l_shipdate AS DATE) AS disclosed_date,
        l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem""",
    "statement_facts": """SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'NetSales' WHEN 2 THEN 'Assets' WHEN 3 THEN 'Liabilities' WHEN 4 THEN 'NetAssets'
        WHEN 5 THEN 'NetSalesSummaryOfBusinessResults' WHEN 6 THEN 'TotalAssetsSummaryOfBusinessResults' ELSE 'OtherItem' END AS element,
        CASE WHEN l_returnflag = 'R' THEN 'Prior1YearDuration' WHEN l_suppkey % 2 = 0 THEN 'CurrentYearDuration_NonConsolidatedMember' ELSE 'CurrentYearDuration' END AS context,
        CASE WHEN l_quantity < 5 THEN -l_extendedprice ELSE l_extendedprice END AS value, l_linenumber AS ordinal FROM lineitem""",
    "filing_changes": """SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'D' ELSE 'U' END AS op, 'labels' AS edinet_code, 'amended' AS form_code, 1 AS seq
        FROM labels GROUP BY doc_id""",
    "holdings": """SELECT o.o_custkey AS account_id, p.p_brand AS asset,
        CASE p.p_type WHEN 'STANDARD' THEN 'INDEX' WHEN 'ECONOMY' THEN 'STOCK' WHEN 'MEDIUM' THEN 'BOND'
        WHEN 'PROMO' THEN 'CASH' WHEN 'SMALL' THEN 'GOLD' ELSE 'CRYPTO' END AS category, sum(l.l_extendedprice) AS value
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
        GROUP BY o.o_custkey, p.p_brand, p.p_type""",
    "texts": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "us_facts": """SELECT concat('T', l_suppkey % 50) AS ticker, concat('acc-', l_orderkey) AS accession_number, concat('us-gaap:Item', l_linenumber) AS concept, 'label' AS label,
        CASE WHEN l_quantity >= 3 THEN CAST(l_extendedprice AS STRING) END AS numeric_value, 'USD' AS unit_ref, CAST(extract(YEAR FROM l_shipdate) AS STRING) AS fiscal_year, 'FY' AS fiscal_period,
        CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) END AS period_start, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_shipdate AS DATE) + 90 AS STRING) END AS period_end,
        CASE WHEN l_linenumber % 2 = 1 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) END AS period_instant FROM lineitem""",
    "statement_matrix": """SELECT l_suppkey AS ticker, concat('item', l_linenumber) AS item, max(CASE WHEN extract(YEAR FROM l_shipdate) = 1995 THEN l_extendedprice END) AS y1995,
        max(CASE WHEN extract(YEAR FROM l_shipdate) = 1996 AND l_suppkey % 3 > 0 THEN l_extendedprice END) AS y1996 FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    "fx_history": """SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'JPY' WHEN '2' THEN 'EUR' WHEN '3' THEN 'CNY' WHEN '4' THEN 'GBP' ELSE 'USD' END AS symbol,
        CAST(o_orderdate AS DATE) AS date, CASE WHEN extract(DAY FROM o_orderdate) = 5 THEN 0 ELSE min(o_totalprice) / 7000 END AS rate
        FROM orders WHERE extract(DAY FROM o_orderdate) < 10 GROUP BY o_orderpriority, o_orderdate""",
    "us_facts_dirty": """SELECT concat('T', l_orderkey % 50) AS ticker, concat('acc-', l_orderkey) AS accession_number, concat('us-gaap:Item', l_linenumber % 3) AS concept, 'label' AS label,
        CASE WHEN l_quantity < 3 THEN NULL WHEN l_suppkey % 5 = 0 THEN 'abc' WHEN l_suppkey % 7 = 0 THEN 'NaN' ELSE CAST(l_extendedprice AS STRING) END AS numeric_value,
        CASE WHEN l_linenumber > 3 THEN 'shares' ELSE 'USD' END AS unit_ref, CASE WHEN l_suppkey % 11 = 0 THEN 'FYx' ELSE CAST(extract(YEAR FROM l_shipdate) AS STRING) END AS fiscal_year, 'FY' AS fiscal_period,
        CASE WHEN l_linenumber % 2 = 0 THEN '1997-01-01' END AS period_start, CASE WHEN l_partkey % 13 = 0 THEN 'bad' ELSE '1997-12-31' END AS period_end, CAST(NULL AS STRING) AS period_instant FROM lineitem""",
    "statement_matrix_dirty": """SELECT l_suppkey AS ticker, concat('item', l_linenumber) AS item, CASE WHEN l_suppkey % 5 = 0 THEN 'n/a' ELSE CAST(max(l_extendedprice) AS STRING) END AS y1995,
        CASE WHEN l_suppkey % 4 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_suppkey % 3 > 0 THEN min(l_extendedprice) END AS y1996 FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    "registry": """SELECT o_orderkey AS doc_id, concat('E', o_custkey % 97) AS edinet_code, concat(o_custkey % 9000 + 1000, '0') AS sec_code,
        concat('Company ', o_custkey % 1000, ' KK') AS filer_name, o_orderdate AS submit_datetime, o_totalprice AS amount FROM orders""",
    "tags": """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'BusinessRisksTextBlock' WHEN 1 THEN 'ManagementPolicyBusinessEnvironmentIssuesToAddressTextBlock'
        WHEN 2 THEN 'ResearchAndDevelopmentActivitiesTextBlock' WHEN 3 THEN 'AnalysisOfFinancialPositionOperatingResultsAndCashFlowsTextBlock'
        WHEN 4 THEN 'OverviewOfBusinessTextBlock' WHEN 5 THEN 'XBRLDataOf2024Notes' ELSE lang END AS tag FROM documents""",
    "crypto_meta": "SELECT p_brand AS ticker, count(*) AS supply, max(p_retailprice) AS market_cap FROM part GROUP BY p_brand",
    "account_inputs": """SELECT o_custkey AS account_id, sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END) AS sp500,
        sum(CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice ELSE 0 END) AS us_stock, sum(CASE WHEN o_orderpriority LIKE '3%' THEN o_totalprice ELSE 0 END) AS jp_bond,
        sum(CASE WHEN o_orderpriority LIKE '4%' THEN o_totalprice ELSE 0 END) AS btc FROM orders GROUP BY o_custkey""",
    "asset_config": """SELECT * FROM (VALUES ('sp500', 'INDEX'), ('us_stock', 'STOCK'), ('jp_bond', 'BOND'), ('btc', 'CRYPTO')) AS t(asset, category)""",
    "progress": """SELECT CAST(ts AS DATE) AS target_date, CASE WHEN event_type IN ('click', 'view') THEN 'completed' ELSE 'failed' END AS status,
        ts AS updated_at FROM events""",
    "directory": """SELECT upper(c_mktsegment) AS symbol, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'NYSE' ELSE 'OTC' END AS exchange,
        CASE WHEN c_custkey % 2 = 0 THEN 'US' ELSE 'JP' END AS market FROM customer""",
    "allocation_target": """SELECT category, CAST(ratio AS DOUBLE) AS ratio FROM (VALUES ('INDEX', 0.60), ('STOCK', 0.25), ('BOND', 0.00),
        ('GOLD', 0.00), ('CASH', 0.10), ('CRYPTO', 0.05)) AS t(category, ratio)""",
}


#: Tasks for each one that scans the positions where they meet their orders.
MEETING = 8


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The finance table ``name`` over the Parquet tables of ``sf_dir``; only the tables and columns it needs are read.

    Where positions meet their orders, both are dealt by order to a number of tasks that grows with the files and that adaptive
    execution leaves as it is, so that the sorts and the groups of one task stay small.
    """
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in SQL[name]}
    if "l.l_orderkey = o.o_orderkey" in SQL[name]:
        scans = read["lineitem"].select("l_orderkey", "l_partkey", "l_extendedprice").rdd.getNumPartitions()
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), MEETING * scans)
        for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
            read[t] = read[t].repartition(tasks, key)
    for t, df in read.items():
        df.createOrReplaceTempView(t)
    return spark.sql(SQL[name])


def with_tables(sql: str, *names: str) -> str:
    """``sql`` with the finance tables that it names as common table expressions."""
    tables = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {tables}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}"
