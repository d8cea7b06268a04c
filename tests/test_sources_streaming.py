"""Readers, incremental ingest, statements and markup on small files and tables."""

import io
import zipfile
from datetime import date

import pytest

from fathomlake.operators import markup as M
from fathomlake.operators import statements as T
from fathomlake.sources import lake as L
from fathomlake.streaming import ingest as I


def test_series_append_and_prune(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = [("^GSPC", date(2024, 1, 1), 1.0), ("EUR/USD", date(2024, 1, 1), 2.0)]
    for _ in range(2):
        L.append_series(spark.createDataFrame(rows, "symbol string, date date, value double"), path)
    assert L.read_series(spark, path).count() == 4
    assert [r.value for r in L.read_series(spark, path, symbols=["EUR/USD"]).collect()] == [2.0, 2.0]


def test_index_directory_manifest_universe(spark, tmp_path):
    (tmp_path / "form.idx").write_text("Description: x\nCIK|Company|Form|Date|File\n-----\n320193|A B|10-K|2024-01-02|edgar/data/320193/0000320193-24-000001.txt\n1|X|8-K|2024-01-02|f.txt\nbad|line\n")
    got = L.read_filing_index(spark, str(tmp_path / "form.idx")).collect()
    assert [(r.cik, r.form, r.filed, r.accession_number) for r in got] == [("320193", "10-K", date(2024, 1, 2), "000032019324000001")]
    (tmp_path / "dir.txt").write_text("NASDAQ Symbol|Name\nAAPL|Apple\nMSFT|Microsoft\nFile Creation Time: 0101|\n")
    assert sorted(r.symbol for r in L.read_symbol_directory(spark, str(tmp_path / "dir.txt")).collect()) == ["AAPL", "MSFT"]
    (tmp_path / "day.json").write_text('[{"docID": "a"}, {"docID": "b"}]')
    assert L.read_manifests(spark, str(tmp_path / "day.json"), "docID string").count() == 2
    L.write_universe(spark.createDataFrame([("7203",)], "code string"), str(tmp_path / "u"))
    assert [r.code for r in L.read_universe(spark, str(tmp_path / "u"), "code string").collect()] == ["7203"]
    one = spark.createDataFrame([('{"a": {"b": 3}}',), (None,)], "j string").select(L.json_field("j", "$.a.b").alias("v"))
    assert sorted((r.v for r in one.collect()), key=str) == ["3", None]


def test_filing_archives(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("XBRL/a.csv", "要素\t項目\nx\t売上\ntoo\tmany\tcells\ny\t1\n".encode("utf-16"))
        z.writestr("b.csv", "h,i\nカ,2\n".encode("cp932"))
        z.writestr("note.txt", "no")
    (folder / "one.zip").write_bytes(buffer.getvalue())
    (folder / "bad.zip").write_bytes(b"not an archive")
    (folder / "cut.zip").write_bytes(buffer.getvalue()[:40])
    got = sorted((r.file_name, r.line, r.c0, r.c1, r.c2) for r in L.read_filing_archives(spark, str(folder)).collect())
    assert got == [("XBRL/a.csv", 0, "x", "売上", None), ("XBRL/a.csv", 2, "y", "1", None), ("b.csv", 0, "カ", "2", None)]


def test_small_plain_archives_need_no_zipfile(monkeypatch):
    """Stored and deflated members are read as zipfile reads them; archives with a comment or a member that repeats are left to it."""
    from fathomlake.sources import zips as Z

    def archive(method=zipfile.ZIP_STORED, comment=b""):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", method) as z:
            z.writestr("x/b.CSV", "h\ti\n" + "値\t2\n" * 50)
            z.writestr("a.csv", "h,i\n\"1,5\",2\n")
            z.writestr("ö.csv", "")
            z.writestr("note.txt", "no")
            z.comment = comment
        return buffer.getvalue()

    want = [("a.csv", b'h,i\n"1,5",2\n'), ("x/b.CSV", ("h\ti\n" + "値\t2\n" * 50).encode()), ("ö.csv", b"")]
    assert list(Z.csv_members(archive(comment=b"of 2024"))) == want
    made = Z.stored([("q.csv", b"1"), ("a.csv", b"")])
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {"q.csv": b"1", "a.csv": b""}
    hurt = made.replace(b"q.csv1", b"q.csv2")
    with pytest.raises(zipfile.BadZipFile):
        list(Z.csv_members(hurt))
    assert list(Z.csv_members(made[:-5])) == [] and list(Z.csv_members(b"")) == []

    plain = [archive(), archive(zipfile.ZIP_DEFLATED)]

    def never(*_):
        raise AssertionError("zipfile")

    monkeypatch.setattr(zipfile, "ZipFile", never)
    for raw in plain:
        assert list(Z.csv_members(raw)) == want
    assert list(Z.csv_members(made)) == [("a.csv", b""), ("q.csv", b"1")] and list(Z.csv_members(made, "q")) == [("q.csv", b"1")]


def test_archives_of_orders_that_batches_cut(spark):
    """Positions are sorted and not collected, and an order whose lines lie in several batches has one archive with all of them."""
    from fathomlake.plans import lake_queries as K

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        w = spark.range(40).selectExpr("id div 4 as code", "cast(id % 4 as int) as fiscal_period", "cast(id as double) as l_extendedprice", "date_add(date'2020-01-01', cast(id as int)) as disclosed_date")
        rows = K._archives(w)
        assert "collect_list" not in rows._jdf.queryExecution().executedPlan().toString()
        got = rows.where("c7 = 'JPY'").groupBy("path", "width").count().collect()
        assert sorted(r.path for r in got) == sorted(f"archives/S{k}.zip" for k in range(10)) and {(r.width, r["count"]) for r in got} == {(9, 4)}
        assert {(r.path, r.c8) for r in rows.where("file_name like '%jpdei.csv' and path like '%S3.zip'").collect()} == {("archives/S3.zip", "2020-01-16")}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_stream_upsert_and_ingest(spark, tmp_path):
    source, shape = str(tmp_path / "in"), "doc string, seq int, value double"
    stream = lambda: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
    for part in ([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, None)], [("a", 3, 9.0), ("c", 1, 5.0), ("c", 2, None)]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(source)
        I.stream_upsert(stream(), str(tmp_path / "t"), ["doc"], ["seq"], str(tmp_path / "cp")).awaitTermination()
    want = [("a", 9.0), ("b", None), ("c", None)]
    assert sorted(((r.doc, r.value) for r in I.read_upserted(spark, str(tmp_path / "t"), ["doc"]).collect()), key=str) == want
    assert sorted(((r.doc, r.value) for r in I.compact(spark, str(tmp_path / "t"), ["doc"], str(tmp_path / "t2")).collect()), key=str) == want
    I.stream_ingest(stream(), str(tmp_path / "r"), {"value": "value IS NOT NULL"}, "doc", str(tmp_path / "cp2")).awaitTermination()
    log = {(r.doc, r.status) for r in spark.read.parquet(str(tmp_path / "r/log")).collect()}
    assert log == {("a", "SUCCESS"), ("b", "FAILED"), ("c", "PARTIAL_FAIL")}
    assert spark.read.parquet(str(tmp_path / "r/accepted")).count() == 4
    assert {tuple(r.reasons) for r in spark.read.parquet(str(tmp_path / "r/rejects")).collect()} == {("value",)}


def test_ledger(spark):
    ledger = spark.createDataFrame([(date(2024, 1, 10), "COMPLETED", 3), (date(2024, 1, 9), "FAILED", 0)], "date date, status string, doc_count long")
    due = {r.date.day: r.chunk for r in I.due_chunks(ledger, "2024-01-10", days=10).collect()}
    assert due == {9: 0, 8: 0, 7: 0, 6: 0, 5: 0, 4: 0, 3: 0, 2: 1, 1: 1}
    after = I.mark_completed(ledger, spark.createDataFrame([(date(2024, 1, 9), 5)], "date date, doc_count int"))
    assert sorted((r.date.day, r.status, r.doc_count) for r in after.collect()) == [(9, "COMPLETED", 5), (10, "COMPLETED", 3)]


def test_scores(spark):
    now, alone = "CurrentYearDuration", "CurrentYearDuration_NonConsolidatedMember"
    rows = [(1, "NetSales", now, 10.0, 1), (1, "NetSales", now, 20.0, 2), (1, "Assets", now, 5000.0, 1), (1, "Liabilities", now, 2000.0, 1), (1, "NetAssets", now, 2500.0, 1),
            (2, "NetSales", now, -1.0, 1), (2, "Assets", alone, -5.0, 1), (3, "Assets", "Prior1YearDuration", 1.0, 1),
            (4, "Assets", now, 9000.0, 1), (4, "NetSales", now, 1.0, 1), (4, "Liabilities", now, 1.0, 1), (4, "NetAssets", now, 1.0, 1), (4, "ProfitLoss", alone, 1.0, 1)]
    std = T.standardize_facts(spark.createDataFrame(rows, "doc_id int, element string, context string, value double, ordinal int"))
    assert {r.value for r in std.where("doc_id = 1 and concept = 'net_sales'").collect()} == {20.0}
    got = {r.doc_id: (r.quality_score, r.is_valid, r.missing_fields) for r in T.score_statements(std).collect()}
    assert got == {1: (100, True, []), 2: (30, False, ["total_assets_cons", "net_sales_non_cons"]), 4: (80, True, [])}


def test_markdown():
    html = "<head><title>t</title></head><body><!-- c --><h2> A  b </h2><p>x <b> y </b><i></i>&amp; z<br>w<table><tr><th>k</th><th>a|b</th></tr><tr><td>1<p>2</td></tr></table></span></body>"
    assert M.to_markdown(html) == "## A b\n\nx **y**& z\nw\n\n| k | a\\|b |\n| --- | --- |\n| 1 2 |  |"
    assert M.to_markdown(None) == "" and M.to_markdown("a < b") == "a < b"


def test_few_texts_are_held_while_they_are_converted(monkeypatch):
    """A batch of many rows is given out in slices, each before the next is converted."""
    import pyarrow as pa

    done = []
    plain = M.to_markdown
    monkeypatch.setattr(M, "to_markdown", lambda x: done.append(x) or plain(x))
    texts = [None, *(f"<b>{i}</b>" for i in range(999))]
    seen = []
    for part in M._converted(iter([pa.RecordBatch.from_pydict({"id": list(range(1000)), "html": texts})]), "html", "md"):
        assert len(done) - len(seen) <= M.SLICE
        seen += part.to_pylist()
    assert [(r["id"], r["md"]) for r in seen] == [(0, ""), *((i, f"**{i - 1}**") for i in range(1, 1000))]


def test_sections(spark):
    html = "<p>[Item 1. Business](#a)</p><h2>Item 1. Business</h2><p>We sell.</p><h2>ITEM 1A. Risk Factors</h2><p>Risk.</p><h2>Signatures</h2><p>S.</p>"
    got = M.extract_sections(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "html", "10-K")
    assert {r.id: r.sections for r in got.collect()} == {1: {"business": "## Item 1. Business\n\nWe sell.", "risk_factors": "## ITEM 1A. Risk Factors\n\nRisk.", "signatures": "## Signatures\n\nS."}, 2: {}}
    rows = spark.createDataFrame([("BusinessRisksTextBlock", "<p>A text that is long enough.</p>"), ("X", "short")], "tag string, text string")
    assert [(r.section_name, r.content_md) for r in M.narrative_blocks(rows, "tag", "text").collect()] == [("business_risk", "A text that is long enough.")]


def test_no_task_writes_a_whole_load(spark, monkeypatch):
    """The loads of a streamed query are written by as many tasks as the rows have, in three micro-batches."""
    from pyspark.sql import functions as F

    from fathomlake.plans import lake_queries as K

    df = spark.range(0, 4000, numPartitions=4).selectExpr("id as code", "id % 7 as v")
    seen = []

    def run(stream):
        def write(batch, k):
            seen.append((k, batch.count(), batch.select(F.input_file_name()).distinct().count()))

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", place).trigger(availableNow=True).start()

    place = f"{K.new_folder(spark)}/cp"
    K._streamed(df, "code", run)
    assert [k for k, *_ in seen] == [0, 1, 2] and sum(n for _, n, _ in seen) == 4000 and all(files == 4 for *_, files in seen)
