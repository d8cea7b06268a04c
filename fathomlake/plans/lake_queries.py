"""Readers, writers and streams of the lake over files that Spark first makes of the driver's tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import filings as D
from ..operators import markup as M
from ..sources import lake as L
from ..sources import versions as V
from ..sources import zips as Z
from ..sources.scratch import new_folder
from ..streaming import ingest as I
from .bindings import MEETING
from .queries import query, rounded, s4

# ---- series, indexes, directories, manifests ------------------------------------------------------------------------


@query(f"SELECT symbol, date, {s4('rate')} AS rate, load_timestamp FROM (SELECT * FROM fx_load UNION ALL SELECT * FROM fx_load WHERE extract(DAY FROM date) > 25) WHERE symbol IN ('JPY', 'EUR')", "fx_load")
def read_series(fx):
    """All loads of two symbols of a lake that was written in two loads; the last days came twice."""
    path = f"{new_folder(fx.sparkSession)}/fx"
    L.append_series(fx, path)
    L.append_series(fx.where("day(date) > 25"), path)
    return rounded(L.read_series(fx.sparkSession, path, symbols=["JPY", "EUR"]).select("symbol", "date", "rate", "load_timestamp"), "rate")


_INDEX = ["CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS form", "concat('edgar/data/', doc_id, '/', lpad(CAST(doc_id AS STRING), 10, '0'), '-24-000001.txt') AS file_name"]


@query(f"SELECT CAST(doc_id AS STRING) AS cik, filer_name AS company, form, CAST(submit_datetime AS DATE) AS filed, file_name, concat(lpad(CAST(doc_id AS STRING), 10, '0'), '24000001') AS accession_number FROM (SELECT *, {', '.join(_INDEX)} FROM registry) WHERE form <> '8-K'", "registry")
def read_filing_index(r):
    """An index file with a preamble, bad lines and forms that aren't wanted."""
    rows = r.selectExpr("doc_id", "filer_name", "submit_datetime", *_INDEX)
    lines = rows.select(F.concat_ws("|", "doc_id", "filer_name", "form", F.date_format("submit_datetime", "yyyy-MM-dd"), "file_name").alias("value"))
    noise = r.select(F.explode(F.array(F.lit("Description: an index"), F.lit("CIK|Company|Form|Date|File"), F.lit("-----"), F.concat_ws("|", F.lit("bad"), "doc_id"))).alias("value"))
    path = f"{new_folder(r.sparkSession)}/index"
    lines.unionByName(noise).write.text(path)
    return L.read_filing_index(r.sparkSession, path).select("cik", "company", "form", "filed", "file_name", "accession_number")


@query("SELECT symbol, name, exchange FROM directory", "directory")
def read_symbol_directory(d):
    """Pipe-delimited directories, each with a closing line."""
    rows = d.selectExpr("symbol AS Symbol", "name AS Name", "exchange AS Exchange")
    closing = d.sparkSession.range(3).selectExpr("'File Creation Time: 0101' AS Symbol", "CAST(NULL AS STRING) AS Name", "CAST(NULL AS STRING) AS Exchange")
    path = f"{new_folder(d.sparkSession)}/directory"
    rows.unionByName(closing).write.option("header", True).option("sep", "|").csv(path)
    return L.read_symbol_directory(d.sparkSession, path).selectExpr("symbol", "Name AS name", "Exchange AS exchange")


@query("SELECT doc_id, sec_code, filer_name, submit_datetime FROM registry", "registry")
def read_manifests(r):
    """Files of one JSON array each, of up to a thousand filings."""
    each = F.struct("doc_id", "sec_code", "filer_name", F.col("submit_datetime").cast("string").alias("submit_datetime"))
    arrays = r.withColumn("part", F.floor(F.col("doc_id") / 1000)).groupBy("part").agg(F.to_json(F.collect_list(each)).alias("value"))
    path = f"{new_folder(r.sparkSession)}/manifests"
    arrays.write.partitionBy("part").text(path)
    got = L.read_manifests(r.sparkSession, path, "doc_id long, sec_code string, filer_name string, submit_datetime string")
    return got.select("doc_id", "sec_code", "filer_name", F.col("submit_datetime").cast("timestamp_ntz").alias("submit_datetime"))


@query("SELECT symbol, name, market FROM directory", "directory")
def write_universe(d):
    path = f"{new_folder(d.sparkSession)}/universe"
    L.write_universe(d.select("symbol", "name", "market"), path)
    return L.read_universe(d.sparkSession, path, "symbol string, name string, market string")


@query("SELECT f.doc_id, f.filer_name, count(*) AS n_facts, max(x.value) AS greatest FROM registry f JOIN statement_facts x USING (doc_id) JOIN (SELECT DISTINCT doc_id FROM labels) t ON t.doc_id = f.doc_id GROUP BY f.doc_id, f.filer_name", "registry", "statement_facts", "narratives_present")
def register_lake(r, facts, texts):
    """Three databases of external tables, joined by another session of the same catalog."""
    spark, root = r.sparkSession, new_folder(r.sparkSession)
    tables = {("lake_registry", "filings"): r.select("doc_id", "filer_name"), ("lake_facts", "facts"): facts.select("doc_id", "value"), ("lake_narratives", "texts"): texts}
    for (database, t), df in tables.items():
        df.write.parquet(f"{root}/{database}/{t}")
    L.register_lake(spark, root, {db: {t: ", ".join(f"{c} {k}" for c, k in df.dtypes)} for (db, t), df in tables.items()})
    return spark.newSession().sql("""SELECT f.doc_id, f.filer_name, count(*) AS n_facts, max(x.value) AS greatest FROM lake_registry.filings f
        JOIN lake_facts.facts x USING (doc_id) JOIN lake_narratives.texts t ON t.doc_id = f.doc_id GROUP BY f.doc_id, f.filer_name""")


# ---- archives -------------------------------------------------------------------------------------------------------


def _zipped(batches):
    """Lines (code, cell, day) in the order of their codes to an archive each: two members, one in UTF-16 and one in UTF-8."""
    head, bad = "a\tb\tc\td\te\tf\tg\th\ti\n", "id\ttext\tc\td\te\tf\tg\th\tno number"

    def archive(code, cells, days):
        day = max((d for d in days if d), default="") if code % 5 > 0 else "no day"
        facts = "\n".join([*sorted(cells), bad])
        dei = "jpdei_cor:CurrentFiscalYearEndDateDEI" + "\t" * 8 + day
        return Z.stored(((f"XBRL_TO_CSV/jpcrp-{code}.csv", f"{head}{facts}\n".encode("utf-16")), ("XBRL_TO_CSV/jpdei.csv", f"{head}{dei}\n".encode()), ("note.txt", b"no")))

    code, cells, days = None, [], []  # of the order that the last batch may have cut
    for batch in batches:
        paths, out = [], []
        for c, cell, day in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if c != code:
                if cells:
                    paths.append(f"archives/S{code}.zip")
                    out.append(archive(code, cells, days))
                code, cells, days = c, [], []
            cells.append(cell)
            days.append(day)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.binary())], ["path", "content"])
    if cells:
        yield pa.RecordBatch.from_arrays([pa.array([f"archives/S{code}.zip"]), pa.array([archive(code, cells, days)], pa.binary())], ["path", "content"])


def _archives(w, part: str = ""):
    """The rows, of all members or those named by ``part``, of an archive for each order, with a line of nine cells for each of its positions and one that holds no number.

    Positions are dealt to a number of tasks that grows with the files and sorted there, so that the lines of an order follow each other;
    their few bytes make much work, so adaptive execution shall not join the tasks.
    """
    tasks = max(int(w.sparkSession.conf.get("spark.sql.shuffle.partitions")), MEETING * w.rdd.getNumPartitions())
    near = w.select("code", "fiscal_period", "l_extendedprice", "disclosed_date").where("code is not null").repartition(tasks, "code").sortWithinPartitions("code")
    cell = F.concat_ws("\t", F.lit("id"), F.concat(F.lit("item"), "fiscal_period"), F.concat(F.lit("ctx"), "code"), F.lit("d"), F.lit("e"), F.lit("f"), F.lit("g"), F.lit("JPY"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    lines = near.select("code", cell.alias("cell"), F.date_format("disclosed_date", "yyyy-MM-dd").alias("day"))
    return L.archive_rows(lines.mapInArrow(_zipped, "path string, content binary"), part)


@query(f"SELECT concat('S', code) AS doc_id, concat('item', fiscal_period) AS item_name, {s4('CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE)')} AS item_value, 'JPY' AS unit, concat('ctx', code) AS context_id, 'FY' AS fiscal_period FROM facts_wide", "facts_wide")
def edinet_facts(w):
    return rounded(D.edinet_facts(_archives(w)), "item_value")


@query("SELECT concat('S', code) AS doc_id, CAST(CASE WHEN code % 5 > 0 THEN extract(YEAR FROM max(disclosed_date)) ELSE 2050 END AS INT) AS fiscal_year FROM facts_wide GROUP BY code", "facts_wide")
def fiscal_year(w):
    """Of the end date in the archive's DEI member, or else of the submission."""
    filings = w.select(F.concat(F.lit("S"), "code").alias("doc_id")).distinct().withColumn("submitted", F.lit("2050-06-01").cast("date"))
    return D.fiscal_year(_archives(w, "jpdei"), filings)


# ---- markup ---------------------------------------------------------------------------------------------------------

_PLAIN = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', ' '{0}), ' +', ' '{0}))"

# The reports in SQL: their Markdown, its lines (_LINES), those lines as headings where they can be some (_HEADS), the first that begins each
# section of the form (_STARTS), and the lines from there to the start of the next section that was found (_section). ~: white space.
# Python's and Java's kinds of white space and of line ends are spelled out.
_HEADINGS = {
    "business": "item~*1[~.]*business", "risk_factors": "item~*1a[~.]*risk~*factors", "unresolved": "item~*1b[~.]*unresolved", "mda": "item~*7[~.]*management",
    "market_risk": "item~*7a[~.]*quantitative", "statements": "item~*8[~.]*financial", "governance": "item~*10[~.]*directors", "signatures": "signatures",
}
_ENDS = r"\n\r\x{85}\x{2028}\x{2029}"
_MARKDOWN = f"""concat('[Item 1. Business](#a)\n\n## Item 1. Business\n\nOf ', {_PLAIN.format(", 'g'").replace("(text,", "(coalesce(text, ''),")},
    CASE WHEN doc_id % 3 > 0 THEN concat('\n\n## ITEM 1A. Risk Factors\n\n', source, CASE WHEN doc_id % 2 = 0 THEN ' **much**' ELSE '' END) ELSE '' END, '\n\n## Signatures\n\n', lang)"""
_LINES = rf"""string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKDOWN}, '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'),
    '(?m)[\t\x0b-\r\x1c-\x20\x{{85}}\p{{Z}}]+$', '', 'g'), '\n+\z', ''), chr(10))"""
_HEADS = rf"""[CASE WHEN length(line) < 250 AND NOT regexp_matches(line, '\[[^{_ENDS}]*\]\(#[^{_ENDS}]*\)') THEN translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END FOR line IN lines]"""
_STARTS = ", ".join(
    rf"nullif(list_position([regexp_matches(head, '^#*[\t-\r ]*{h.replace('[~', r'[\t-\r ').replace('~', r'[\t-\r ]')}') FOR head IN heads], true), 0) AS at_{name}"
    for name, h in _HEADINGS.items()
)


def _section(name: str) -> str:
    names = list(_HEADINGS)
    end = f"coalesce({', '.join([*(f'at_{n}' for n in names[names.index(name) + 1 :]), 'len(lines) + 1'])})"
    tidy = f"array_to_string(lines[at_{name} : {end} - 1], chr(10))"
    for pattern, into in ((rf"(\A|[{_ENDS}])[ \t]+", r"\1"), (rf"[ \t]+(\z|[{_ENDS}])", r"\1"), (r"\n\n\n+", "\n\n"), (r"\A[\t-\r ]+|[\t-\r ]+\z", "")):
        tidy = f"regexp_replace({tidy}, '{pattern}', '{into}', 'g')"
    return f"CASE WHEN at_{name} IS NOT NULL THEN {tidy} END AS {name}"


def _markup_text(c: str) -> Column:
    """A column's text (null: empty) as text of HTML."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(f"SELECT doc_id, {_section('business')}, {_section('risk_factors')}, {_section('signatures')} FROM (SELECT doc_id, lines, {_STARTS} FROM (SELECT doc_id, lines, {_HEADS} AS heads FROM (SELECT doc_id, {_LINES} AS lines FROM texts)))", "texts")
def extract_sections(t):
    """Sections of annual reports made of all whole texts (null text, source or language: empty), with a table of contents; one in three has no risks."""
    plain = F.coalesce(F.expr(_PLAIN.format("")), F.lit(""))
    risk = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("<h2>ITEM 1A. Risk Factors</h2><p>"), _markup_text("source"), F.when(F.col("doc_id") % 2 == 0, " <b>much</b>").otherwise(""), F.lit("</p>"))).otherwise("")
    html = F.concat(F.lit("<p>[Item 1. Business](#a)</p><script>x</script><h2>Item 1. Business</h2><p>Of "), plain, F.lit("</p>"), risk, F.lit("<h2>Signatures</h2><p>"), _markup_text("lang"), F.lit("</p>"))
    got = M.extract_sections(t.select("doc_id", html.alias("html")), "html", "10-K")
    return got.select("doc_id", *[F.col("sections")[c].alias(c) for c in ("business", "risk_factors", "signatures")])


@query(f"SELECT doc_id, lang AS section_name, concat('*', source, '* ', plain) AS content_md FROM (SELECT *, {_PLAIN.format(', ' + chr(39) + 'g' + chr(39))} AS plain FROM texts) WHERE length(trim(text)) > 20", "texts")
def narrative_blocks(t):
    html = F.concat(F.lit("<p><i>"), "source", F.lit("</i> "), F.expr(_PLAIN.format("")), F.lit("</p>"))
    kept = t.select("doc_id", "lang", F.when(F.length(F.trim("text")) > 20, html).otherwise("short").alias("html"))
    return M.narrative_blocks(kept, "lang", "html").select("doc_id", "section_name", "content_md")


# ---- tables that change ---------------------------------------------------------------------------------------------

_LAST = "SELECT symbol, date, arg_max(rate, load_timestamp) AS rate FROM fx_load GROUP BY symbol, date"


@query(f"SELECT symbol, date, {s4('rate')} AS rate FROM ({_LAST})", "fx_load")
def compact_current(fx):
    """The last load of each day, as the version that a compaction has committed."""
    spark, root = fx.sparkSession, f"{new_folder(fx.sparkSession)}/t"
    V.publish(fx, root)
    V.compact_current(spark, root, ["symbol", "date"], ["load_timestamp"])
    return rounded(V.read_current(spark, root).select("symbol", "date", "rate"), "rate")


def _days(fx):
    return fx.groupBy("symbol", "date").agg(F.max_by("rate", "load_timestamp").alias("rate"))


@query(f"+t AS ({_LAST}) SELECT symbol, date, {s4('CASE WHEN symbol IN (' + chr(39) + 'JPY' + chr(39) + ', ' + chr(39) + 'GBP' + chr(39) + ') AND extract(DAY FROM date) > 20 THEN rate + 1 ELSE rate END')} AS rate FROM t UNION ALL SELECT 'CHF', date, {s4('rate')} FROM t WHERE symbol = 'JPY'", "fx_load")
def upsert_partitions(fx):
    """A batch that changes days of two symbols and brings a new one; the folders of the others stay as they are."""
    path = f"{new_folder(fx.sparkSession)}/t"
    days = _days(fx)
    V.upsert_partitions(days, path, ["symbol", "date"], ["symbol"])
    late = days.where("symbol in ('JPY', 'GBP') and day(date) > 20").withColumn("rate", F.col("rate") + 1)
    batch = late.unionByName(days.where("symbol = 'JPY'").withColumn("symbol", F.lit("CHF")))
    V.upsert_partitions(batch.select(days.columns), path, ["symbol", "date"], ["symbol"])
    return rounded(fx.sparkSession.read.schema(days.schema).parquet(path).select("symbol", "date", "rate"), "rate")


@query(f"+t AS ({_LAST}) SELECT symbol, date, {s4('rate')} AS rate FROM t WHERE NOT (symbol = 'EUR' AND extract(DAY FROM date) < 10) UNION ALL SELECT symbol, date, {s4('rate * 2')} FROM t, (VALUES (1), (2)) AS v(k) WHERE symbol = 'EUR' AND extract(DAY FROM date) < 10", "fx_load")
def replace_day_partitions(fx):
    """Days of one symbol replaced by two rows each."""
    path = f"{new_folder(fx.sparkSession)}/t"
    days = _days(fx)
    V.replace_day_partitions(days, path, ["symbol", "date"], ["symbol"])
    new = days.where("symbol = 'EUR' and day(date) < 10").withColumn("rate", F.col("rate") * 2)
    V.replace_day_partitions(new.unionByName(new), path, ["symbol", "date"], ["symbol"])
    return rounded(fx.sparkSession.read.schema(days.schema).parquet(path).select("symbol", "date", "rate"), "rate")


@query(f"SELECT symbol, date, {s4('rate')} AS rate, load_timestamp FROM fx_load WHERE symbol = 'AUD' OR symbol = 'GBP' AND date >= DATE '2024-01-20' OR symbol NOT IN ('AUD', 'GBP') AND date >= DATE '2024-01-28'", "fx_load")
def read_since(fx):
    """What a lake has from each symbol's mark on; one symbol has none."""
    path = f"{new_folder(fx.sparkSession)}/lake"
    L.append_months(fx, path)
    have = fx.where("symbol = 'GBP' and date <= date'2024-01-20' or symbol not in ('AUD', 'GBP') and date <= date'2024-01-28'")
    schema = StructType([*fx.schema.fields, StructField("month", StringType())])
    return rounded(L.read_since(fx.sparkSession, path, have, schema).select("symbol", "date", "rate", "load_timestamp"), "rate")


# ---- streams --------------------------------------------------------------------------------------------------------


def _streamed(df, order: str, run, loads: int = 3) -> None:
    """``df`` as a stream of a few loads, each a micro-batch: ``run(stream)`` starts anew for each and goes on from its checkpoint.
    ``order``: the column that deals the rows to loads. A load has as many files as tasks wrote it."""
    spark, path = df.sparkSession, f"{new_folder(df.sparkSession)}/in"
    for k in range(loads):
        df.where(F.pmod(F.xxhash64(order), F.lit(loads)) == k).write.mode("append").parquet(path)
        run(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


@query(f"SELECT symbol, date, {s4('rate')} AS rate FROM ({_LAST})", "fx_load")
def stream_upsert(fx):
    """The last write of each key over all micro-batches. Loads of a day come in order, in batches of their own or one."""
    spark, root = fx.sparkSession, new_folder(fx.sparkSession)
    _streamed(fx, "date", lambda stream: I.stream_upsert(stream, f"{root}/t", ["symbol", "date"], ["load_timestamp"], f"{root}/cp"))
    return rounded(I.read_upserted(spark, f"{root}/t", ["symbol", "date"]).select("symbol", "date", "rate"), "rate")


_STATUS = "CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'SUCCESS' WHEN count(*) FILTER (ok) = 0 THEN 'FAILED' ELSE 'PARTIAL_FAIL' END"


@query(f"SELECT code, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_rejected, {_STATUS} AS status FROM (SELECT code, l_quantity >= 10 AND l_discount < 0.08 AS ok FROM facts_wide) GROUP BY code", "facts_wide")
def stream_outcomes(w):
    """One final outcome for each order, whose positions come in several micro-batches."""
    root = new_folder(w.sparkSession)
    rules = {"quantity": "l_quantity >= 10", "discount": "l_discount < 0.08"}
    _streamed(w, "l_extendedprice", lambda stream: I.stream_outcomes(stream, root, rules, "code", f"{root}/cp"))
    return I.read_outcomes(w.sparkSession, root, "code").select("code", "n_ok", "n_rejected", "status")


@query("SELECT code, count(*) AS n_accepted FROM facts_wide WHERE l_quantity >= 10 GROUP BY code", "facts_wide")
def stream_ingest(w):
    """Accepted rows of each order; the rejects are kept apart."""
    root = new_folder(w.sparkSession)
    _streamed(w, "code", lambda stream: I.stream_ingest(stream, root, {"quantity": "l_quantity >= 10"}, "code", f"{root}/cp"))
    return w.sparkSession.read.parquet(f"{root}/accepted").groupBy("code").agg(F.count("*").alias("n_accepted"))


@query("+d AS (SELECT CAST(unnest(range(DATE '2001-07-12', DATE '2001-08-02', INTERVAL 1 DAY)) AS DATE) AS date) SELECT d.date, 'COMPLETED' AS status, count(r.doc_id) AS doc_count FROM d LEFT JOIN registry r ON CAST(r.submit_datetime AS DATE) = d.date GROUP BY d.date", "registry")
def load_due(r):
    """The ledger after three weeks were loaded in chunks; the first call fails in the middle and the second mends it."""
    spark, root = r.sparkSession, new_folder(r.sparkSession)
    days = r.withColumn("date", F.to_date("submit_datetime"))
    tried = []

    def load(chunk):
        tried.append(chunk)
        if len(tried) == 2:
            raise ConnectionError("not there today")
        return days.where(F.col("date").isin(chunk))

    for _ in range(2):
        I.load_due(spark, root, load, "2001-08-01", days=21, size=7)
    return I.read_ledger(spark, root)
