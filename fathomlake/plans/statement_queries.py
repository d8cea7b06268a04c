"""More queries over the driver's tables: statements, synchronisation, change logs, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filings as D
from ..operators import markup as M
from ..operators import series as S
from ..operators import statements as T
from ..operators import synchronisation as Y
from ..sources.lake import lake_audit as audit
from .bindings import TABLES
from .queries import QUERIES, ORACLE, query, rounded, s4

_TAGS = " ".join(f"WHEN element IN ({', '.join(repr(t) for t in tags)}) THEN '{c}'" for c, tags in T.CONCEPTS.items())
STANDARD = f"""named AS (SELECT doc_id, CASE WHEN context LIKE '%NonConsolidated%' THEN 'non_cons' ELSE 'cons' END AS scope, CASE {_TAGS} END AS concept, value, ordinal
    FROM statement_facts WHERE context LIKE '%CurrentYear%'), std AS (SELECT doc_id, scope, concept, arg_max(value, struct_pack(a := ordinal, b := value)) AS value FROM named WHERE concept IS NOT NULL GROUP BY ALL)"""


@query(f"+{STANDARD} SELECT doc_id, scope, concept, {s4('value')} AS value FROM std", "statement_facts")
def standardize_facts(facts):
    return rounded(T.standardize_facts(facts), "value")


@query(f"+{STANDARD}, p AS (SELECT doc_id, max(CASE WHEN concept = 'net_sales' THEN value END) AS s, max(CASE WHEN concept = 'total_assets' THEN value END) AS a, max(CASE WHEN concept = 'total_liabilities' THEN value END) AS l, max(CASE WHEN concept = 'net_assets' THEN value END) AS n FROM std GROUP BY doc_id, scope), "
       "q AS (SELECT doc_id, bool_or(s IS NOT NULL AND a IS NOT NULL) AS ok, count(*) FILTER (WHERE abs(a - (l + n)) > 1000) AS off, count(*) FILTER (WHERE s < 0) + count(*) FILTER (WHERE a < 0) AS neg FROM p GROUP BY doc_id) "
       "SELECT doc_id, greatest(0, 100 - CASE WHEN ok THEN 0 ELSE 30 END - 20 * off - 20 * neg) AS quality_score, ok AS is_valid, off = 0 AS balanced, neg = 0 AS no_negatives FROM q", "statement_facts")  # fmt: skip
def score_statements(facts):
    return T.score_statements(T.standardize_facts(facts)).select("doc_id", "quality_score", "is_valid", "balanced", "no_negatives")


@query("SELECT f.doc_id, f.edinet_code, f.form_code FROM filings f WHERE NOT EXISTS (SELECT 1 FROM filing_changes c WHERE c.doc_id = f.doc_id) UNION ALL SELECT doc_id, edinet_code, form_code FROM filing_changes WHERE op <> 'D'", "filings", "filing_changes")
def apply_changes(f, changes):
    return D.apply_changes(f.select("doc_id", "edinet_code", "form_code"), changes, "doc_id", ["seq"])


@query("+l AS (SELECT ticker, max(snapshot_at) AS last_sync_at, arg_max(CASE WHEN sector IN ('click', 'view') THEN 'SUCCESS' ELSE 'FAILED' END, struct_pack(a := snapshot_at, b := tiebreak)) AS last_status FROM profile_snapshots GROUP BY ticker) "
       "SELECT ticker FROM l WHERE NOT (last_status = 'SUCCESS' AND last_sync_at > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR) AND NOT (last_status = 'FAILED' AND last_sync_at > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 5 MINUTE)", "profile_snapshots")  # fmt: skip
def due_for_sync(snap):
    outcome = F.when(F.col("sector").isin("click", "view"), "SUCCESS").otherwise("FAILED")
    status = snap.withColumn("o", outcome).groupBy("ticker").agg(F.max("snapshot_at").alias("last_sync_at"), F.max_by("o", F.struct("snapshot_at", "tiebreak")).alias("last_status"))
    return Y.due_for_sync(snap.select("ticker").distinct(), status, "2024-01-30 00:00:00").select("ticker")


@query("SELECT f.doc_id, n.doc_id IS NULL AS full_sync, n.doc_id IS NOT NULL AND x.doc_id IS NULL AS facts_repair FROM filings f LEFT JOIN narratives_present n ON n.doc_id = f.doc_id LEFT JOIN facts_present x ON x.doc_id = f.doc_id", "filings", "narratives_present", "facts_present")
def sync_need(f, n, x):
    return Y.sync_need(f, n, x, "doc_id").select("doc_id", "full_sync", "facts_repair")


@query("SELECT f.doc_id, x.doc_id IS NOT NULL AS has_statements FROM filings f LEFT JOIN facts_present x ON x.doc_id = f.doc_id", "filings", "facts_present")
def has_statements(f, x):
    return Y.has_statements(f, x, "doc_id").select("doc_id", "has_statements")


_LATEST = "k AS (SELECT symbol, date, arg_max(value, struct_pack(a := load_timestamp, b := tiebreak)) AS value FROM macro_load GROUP BY ALL)"


@query(f"+{_LATEST} SELECT date, {s4('coalesce(a.value, b.value)')} AS value FROM (SELECT * FROM k WHERE symbol = 'DGS10') a FULL JOIN (SELECT * FROM k WHERE symbol = 'DFF') b USING (date)", "macro_load")
def coalesce_sections(m):
    once = S.latest_wins(m, ["symbol", "date"], ["load_timestamp", "tiebreak"])
    of = lambda s: once.where(F.col("symbol") == s).select("date", "value")
    return rounded(D.coalesce_sections(of("DGS10"), of("DFF"), ["date"], "value"), "value")


@query(f"+{_LATEST}, g AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY) t(d)), s AS (SELECT DISTINCT symbol FROM k) "
       f"SELECT symbol, date, {s4('last_value(value IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS value FROM s CROSS JOIN g LEFT JOIN k USING (symbol, date)", "macro_load")  # fmt: skip
def mixed_frequency(m):
    once = S.latest_wins(m, ["symbol", "date"], ["load_timestamp", "tiebreak"]).select("symbol", "date", "value")
    grid = m.sparkSession.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-03-31')) AS date")
    return rounded(S.mixed_frequency(once, "symbol", "date", "value", F.broadcast(grid)), "value")


def lake_audit(spark, sf_dir):
    return audit({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


def html_to_markdown(spark, sf_dir):
    """The Markdown of all pages; SQL has no parser of nested tags."""
    return M.html_to_markdown(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html").select("page_id", "markdown")


QUERIES["lake_audit"] = lake_audit
ORACLE["lake_audit"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES)
QUERIES["html_to_markdown"] = html_to_markdown
