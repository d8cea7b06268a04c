"""As-of joins by key, revised prices, dirty facts and statements, versioned and partitioned tables, keyed outcomes, catalogs."""

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fathomlake.operators import asof as H
from fathomlake.operators import filings as D
from fathomlake.operators import portfolio as P
from fathomlake.sources import lake as L
from fathomlake.sources import versions as V
from fathomlake.streaming import ingest as I


# ---- as-of joins ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("tolerance", "salts", "unit"), [(5, 1, "month"), (None, 1, "month"), (None, 3, "year"), (0, 2, "day")])
def test_asof_join_by_brute_force(spark, tolerance, salts, unit):
    rng = random.Random(salts)
    day = lambda: date(2023, 11, 1) + timedelta(rng.randrange(200))
    left = [(i, rng.choice(["A", "B", "C", None]), day() if rng.random() < 0.95 else None) for i in range(400)]
    left += left[:20]  # rows that repeat
    right = [(rng.choice(["A", "B", None]), day() if rng.random() < 0.9 else None, rng.choice([None, rng.random()])) for _ in range(60)]
    want = []
    for i, k, t in left:
        known = [(d, v) for key, d, v in right if key is not None and key == k and d is not None and v is not None and t is not None and d <= t]
        best = max(known, default=None)
        if best and tolerance is not None and (t - best[0]).days > tolerance:
            best = None
        want.append((i, k, t, *((best[1], best[0]) if best else (None, None))))
    out = H.asof_join(spark.createDataFrame(left, "i int, k string, t date"), spark.createDataFrame(right, "k string, t date, v double"), "k", "t", "v", tolerance, unit, salts)
    assert out.columns == ["i", "k", "t", "v", "v_at"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_asof_join_of_times_and_of_nothing(spark):
    left = spark.createDataFrame([("A", datetime(2024, 1, 31, 12), "x"), ("A", datetime(2024, 2, 1, 9), "y")], "k string, t timestamp, v_note string")
    right = spark.createDataFrame([("A", datetime(2024, 1, 31, 12), 1.0), ("A", datetime(2024, 1, 31, 12), 2.0), ("A", datetime(2024, 2, 1, 10), 3.0)], "k string, t timestamp, v double")
    assert sorted((r.v_note, r.v) for r in H.asof_join(left, right, "k", "t", "v").collect()) == [("x", 2.0), ("y", 2.0)]
    assert [r.v for r in H.asof_join(left, right.limit(0), "k", "t", "v").collect()] == [None, None]
    assert H.asof_join(left.limit(0), right, "k", "t", "v").count() == 0


def test_conversion_at_the_rates_of_the_day(spark):
    rows = [("EUR", date(2024, 1, 10), 100.0), ("EUR", date(2024, 1, 3), 100.0), ("USD", date(2024, 1, 10), 100.0), (None, date(2024, 1, 10), 100.0), ("XXX", date(2024, 1, 10), 100.0)]
    rates = spark.createDataFrame([("EUR", date(2024, 1, 4), 2.0), ("EUR", date(2024, 1, 9), 0.0), ("JPY", date(2024, 1, 1), 0.5), ("USD", date(2024, 1, 1), 7.0)], "symbol string, date date, rate double")
    tx = spark.createDataFrame(rows, "currency string, day date, amount double")
    got = lambda *a: [r.converted for r in H.convert_historical(tx, rates, "amount", *a).orderBy("day", F.col("currency").asc_nulls_first()).collect()]
    assert got("USD", "day") == [100.0, 100.0, 200.0, 100.0, 100.0]
    assert got("USD", "day", 5) == [100.0] * 5
    assert got("JPY", "day") == [200.0, 200.0, 400.0, 200.0, 200.0]


# ---- prices and facts -----------------------------------------------------------------------------------------------


def test_daily_values_of_revised_prices(spark):
    days = [date(2024, 1, 1) + timedelta(i) for i in range(70)]
    px = [("A", d, float(i), 1) for i, d in enumerate(days)] + [("A", days[40], 1000.0, 2), ("A", days[40], 900.0, 2), ("A", days[41], None, 2), ("B", days[3], 5.0, 1)]
    prices = spark.createDataFrame(px, "ticker string, date date, close double, load int")
    pos = spark.createDataFrame([(1, "A", 2.0), (1, "B", 10.0), (1, "A", 1.0), (2, "B", 1.0), (3, "C", 1.0), (4, "A", None)], "account_id long, ticker string, quantity double")
    wanted = spark.createDataFrame([(d,) for d in [*days, days[5], date(2030, 1, 1), None]], "date date")
    got = {(r.account_id, r.date): r.value for r in P.daily_values(prices, pos, wanted, ("load",)).collect()}
    want = {(1, d): 3.0 * i for i, d in enumerate(days) if i} | {(1, days[40]): 3000.0, (1, days[3]): 59.0, (2, days[3]): 5.0}
    assert got == want
    assert P.daily_values(prices, pos, wanted.limit(0)).count() == 0 and P.daily_values(prices, pos.limit(0), wanted).count() == 0


def test_array_columns_are_not_exchanged_for_each_holding(spark):
    px = spark.createDataFrame([("A", date(2024, 1, 1), 1.0)], "ticker string, date date, close double")
    pos = spark.createDataFrame([(1, "A", 2.0)], "account_id long, ticker string, quantity double")
    df = P.daily_values(px, pos, px.select("date"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "collect_list(struct" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


US = "ticker string, accession_number string, concept string, label string, numeric_value string, unit_ref string, fiscal_year string, fiscal_period string, period_start string, period_end string, period_instant string"


def test_us_facts_with_bad_cells(spark):
    row = lambda v, unit="USD", year="2023", end="2023-12-31", acc="1": ("T", acc, "c", "l", v, unit, year, "FY", "2023-01-01", end, None)
    rows = [row("1.5"), row("2.5", "shares"), row("abc", acc="2"), row("1", year="FYx", acc="3"), row("1", end="bad", acc="4"), row(None, acc="5"), row("NaN", acc="6"), row("7", year=None, acc="7")]
    facts = spark.createDataFrame(rows, US)
    got = sorted((r.accession_number, r.value, r.unit, r.fiscal_year) for r in D.normalize_us_facts(facts).collect())
    assert got == [("1", 2.5, "shares", 2023), ("7", 7.0, "USD", None)]
    by_unit = D.normalize_us_facts(facts, ("unit",)).where("accession_number = '1'").first()
    assert by_unit.unit == "shares"
    assert sorted((r.accession_number, r.reasons[0]) for r in D.us_fact_rejects(facts).collect()) == [("2", "numeric_value"), ("3", "fiscal_year"), ("4", "period_end")]
    assert D.normalize_us_facts(facts.limit(0)).count() == 0


def test_stacking_leaves_out_what_is_no_number(spark):
    df = spark.createDataFrame([("T", "Revenue", "100", float("nan")), ("T", "Net Income", "n/a", 250.0), ("T", "Other", None, None)], "ticker string, line string, `2023-09-30` string, `2022-09-30` double")
    got = sorted((r.item, r.date, r.value) for r in D.stack_statements(df, "line", "Annual", ["ticker"]).collect())
    assert got == [("Net Income", "2022-09-30", 250.0), ("Revenue", "2023-09-30", 100.0)]


def test_search_by_filer_newest_first(spark):
    rows = [(i, "E1", "72030", f"Car {i % 2}_%", datetime(2024, 1, 1 + i % 3)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, edinet_code string, sec_code string, filer_name string, submit_datetime timestamp")
    assert [r.doc_id for r in D.search_filings(df, filer="1_%").collect()] == [5, 1, 3]
    assert [r.doc_id for r in D.search_filings(df, name="203", since="2024-01-02", n=2).collect()] == [5, 2]
    assert [r.doc_id for r in D.search_filings(df.drop("submit_datetime"), filer="0").collect()] == [4, 2, 0]


# ---- tables that change ---------------------------------------------------------------------------------------------


def test_versions_switch_at_the_commit(spark, tmp_path):
    root, shape = str(tmp_path / "t"), "k string, at int, v double"
    with pytest.raises(FileNotFoundError):
        V.read_current(spark, root)
    assert V.publish(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], shape), root) == 0
    during = V.read_current(spark, root)
    staged = V.stage_version(V.read_current(spark, root).where("at = 1"), root)
    assert V.read_current(spark, root).count() == 3  # written, and not committed: a crash here leaves the old one
    assert V.compact_current(spark, root, ["k"], ["at"]) == 1
    assert sorted(tuple(r) for r in V.read_current(spark, root).collect()) == [("a", 2, 2.0), ("b", 1, 3.0)]
    assert during.count() == 3  # a reader goes on with the version that it has found
    assert V.commit_version(spark, root, staged) == 2 and V.read_current(spark, root).count() == 2
    assert [r.version for r in V.versions(spark, root).orderBy("version").collect()] == [0, 1, 2]


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_upsert_rewrites_the_partitions_that_it_touches(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "k int, day string, v double"
    V.upsert_partitions(spark.createDataFrame([(i, f"d{i % 4}", 1.0) for i in range(40)], shape), path, ["k"], ["day"])
    before = files(path)
    batch = spark.createDataFrame([(1, "d1", 9.0), (101, "d1", 9.0), (102, "d9", 9.0)], shape)
    other = next((Path(path) / "day=d2").glob("*.parquet"))
    held, check = other.read_bytes(), other.parent / f".{other.name}.crc"
    check.unlink(missing_ok=True)
    other.write_bytes(b"broken")  # whoever opens it fails
    V.upsert_partitions(batch, path, ["k"], ["day"])
    other.write_bytes(held)
    untouched = lambda names: {f for f in names if f.startswith(("day=d0", "day=d2", "day=d3"))}
    assert untouched(files(path)) == untouched(before) and len(untouched(before)) >= 3
    assert not {f for f in before if f.startswith("day=d1")} & files(path)
    once = sorted(map(tuple, spark.read.parquet(path).select("k", "day", "v").collect()))
    assert len(once) == 42 and (1, "d1", 9.0) in once and (5, "d1", 1.0) in once and (102, "d9", 9.0) in once
    V.upsert_partitions(batch, path, ["k"], ["day"])
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "day", "v").collect())) == once
    assert not list(Path(path).glob("_staged-*"))
    V.replace_day_partitions(spark.createDataFrame([(7, "d3", 1.0), (7, "d3", 2.0)], shape), path, ["day"], ["day"])
    assert sorted(map(tuple, spark.read.parquet(path).where("day = 'd3'").select("k", "v").collect())) == [(7, 1.0), (7, 2.0)]
    assert spark.read.parquet(path).count() == 42 - 10 + 2


def test_upsert_into_the_partition_without_a_value(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "k int, day string, v double"
    V.upsert_partitions(spark.createDataFrame([(1, None, 1.0), (2, None, 1.0), (3, "d", 1.0)], shape), path, ["k"], ["day"])
    V.upsert_partitions(spark.createDataFrame([(2, None, 5.0), (4, "d", 5.0)], shape), path, ["k"], ["day"])
    assert sorted((r.k, r.day, r.v) for r in spark.read.parquet(path).collect()) == [(1, None, 1.0), (2, None, 5.0), (3, "d", 1.0), (4, "d", 5.0)]


def test_upsert_by_buckets_of_the_key(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda rows: spark.createDataFrame(rows, "k string, v int").withColumn("bucket", V.bucket_of(["k"], 8))
    V.upsert_partitions(table([(f"k{i}", i) for i in range(50)]), path, ["k"], ["bucket"])
    before = files(path)
    V.upsert_partitions(table([("k7", -1)]), path, ["k"], ["bucket"])
    assert len({f.split("/")[0] for f in before ^ files(path)}) == 1
    assert spark.read.parquet(path).where("v = -1").count() == 1 and spark.read.parquet(path).count() == 50


def test_reading_since_the_marks_opens_no_older_partition(spark, tmp_path):
    path, shape = str(tmp_path / "lake"), "symbol string, date date, value double"
    rows = [(s, date(2024, m, d), 1.0) for s in ("A", "B", "^N+1 /%") for m in (1, 2, 3) for d in (1, 15)]
    L.append_months(spark.createDataFrame(rows, shape), path)
    for old in ("symbol=A/month=2024-01", "symbol=A/month=2024-02", "symbol=B/month=2024-01"):
        for f in (Path(path) / old).glob("*.parquet"):  # whoever opens these fails
            f.write_bytes(b"broken")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    target = spark.createDataFrame([("A", date(2024, 3, 15), 0.0), ("A", date(2024, 1, 1), 0.0), ("B", date(2024, 2, 15), 0.0)], shape)
    schema = spark.createDataFrame([], shape + ", month string").schema
    new = L.read_since(spark, path, target, schema)
    assert sorted((r.symbol, r.date) for r in new.collect()) == [("A", date(2024, 3, 15)), ("B", date(2024, 2, 15)), ("B", date(2024, 3, 1)), ("B", date(2024, 3, 15))] + [("^N+1 /%", date(2024, m, d)) for m in (1, 2, 3) for d in (1, 15)]
    assert L.read_since(spark, path, spark.createDataFrame([(s, date(2024, 4, 1), 0.0) for s in ("A", "B", "^N+1 /%")], shape), schema).count() == 0


def test_a_second_session_joins_three_databases(spark, tmp_path):
    root = str(tmp_path)
    data = {("registry", "filings"): ("doc_id long, form string", [(1, "A"), (2, "B")]), ("facts", "facts"): ("doc_id long, value double", [(1, 5.0)]), ("narratives", "texts"): ("doc_id long, content string", [(1, "x"), (2, "y")])}
    for (db, t), (shape, rows) in data.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{root}/{db}/{t}")
    lake = {db: {t: shape} for (db, t), (shape, _) in data.items()}
    try:
        L.register_lake(spark, root, lake)
        L.register_lake(spark, root, lake)
        other = spark.newSession()
        got = other.sql("SELECT f.form, x.value, t.content FROM registry.filings f JOIN facts.facts x USING (doc_id) JOIN narratives.texts t USING (doc_id)").collect()
        assert [tuple(r) for r in got] == [("A", 5.0, "x")]
        assert spark.table("facts.facts").schema.simpleString() == "struct<doc_id:bigint,value:double>"
    finally:
        for db in lake:
            spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    assert spark.read.parquet(f"{root}/facts/facts").count() == 1
    L.register_lake(spark, f"{root}/facts", ["facts"])
    assert spark.table("facts").count() == 1


# ---- streams and ledgers --------------------------------------------------------------------------------------------


def test_one_outcome_for_a_document_in_three_batches(spark, tmp_path):
    source, shape = str(tmp_path / "in"), "doc string, value double"
    parts = [[("a", 1.0), ("b", 1.0)], [("a", None), ("c", None)], [("a", 3.0), ("c", None), ("b", 2.0)]]
    for part in parts:  # each a start of the query, so its state comes from the checkpoint
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        I.stream_outcomes(stream, str(tmp_path / "r"), {"value": "value IS NOT NULL"}, "doc", str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.doc, r.n_ok, r.n_rejected, r.status) for r in I.read_outcomes(spark, str(tmp_path / "r"), "doc").collect())
    assert got == [("a", 2, 1, "PARTIAL_FAIL"), ("b", 2, 0, "SUCCESS"), ("c", 0, 2, "FAILED")]


def test_chunks_are_marked_after_they_are_loaded(spark, tmp_path):
    root, asked = str(tmp_path / "h"), []

    def load(days, broken=()):
        asked.append(days)
        if set(days) & set(broken):
            raise RuntimeError("not there today")
        return spark.createDataFrame([(d, i) for d in days if d.day % 2 == 0 for i in range(d.day)] + [(date(1999, 1, 1), 0)], "date date, doc int")

    bad = date(2024, 1, 5)
    done = I.load_due(spark, root, lambda d: load(d, [bad]), "2024-01-09", days=9, size=3)
    assert done == [date(2024, 1, d) for d in (9, 8, 7, 3, 2, 1)] and asked[1] == [date(2024, 1, d) for d in (6, 5, 4)]
    assert bad not in {r.date for r in I.read_ledger(spark, root).collect()}
    assert I.load_due(spark, root, load, "2024-01-09", days=9, size=3) == [date(2024, 1, d) for d in (6, 5, 4)]
    counts = {r.date.day: r.doc_count for r in I.read_ledger(spark, root).collect()}
    assert counts == {d: d if d % 2 == 0 else 0 for d in range(1, 10)}
    before = spark.read.parquet(f"{root}/data").count()
    assert before == 2 + 4 + 6 + 8 and I.load_due(spark, root, load, "2024-01-09", days=9, size=3) == []
    # A chunk whose mark was lost is loaded once more, and changes nothing.
    import shutil

    shutil.rmtree(f"{root}/ledger/chunk=2024-01-06")
    I.load_due(spark, root, load, "2024-01-09", days=9, size=3)
    assert spark.read.parquet(f"{root}/data").count() == before and I.read_ledger(spark, root).count() == 9
