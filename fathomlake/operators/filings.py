"""Filings and facts: completeness, matching, reshaping, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fact_key, parse_number, zero_pad


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def incomplete_filings(filings: DataFrame, narratives: DataFrame, facts: DataFrame, forms: list[str]) -> DataFrame:
    """Filings of the forms without narratives or without facts, once each, and which of the two is there."""
    n = narratives.select("doc_id").distinct().withColumn("has_narratives", F.lit(True))
    f = facts.select("doc_id").distinct().withColumn("has_facts", F.lit(True))
    full = filings.where(F.col("form_code").isin(forms)).join(n, "doc_id", "left").join(f, "doc_id", "left")
    return full.na.fill(False, ["has_narratives", "has_facts"]).where("not (has_narratives and has_facts)")


def pending_documents(candidates: DataFrame, filings: DataFrame, log: DataFrame) -> DataFrame:
    done = filings.select("doc_id").union(log.where("status = 'SUCCESS'").select("doc_id"))
    return candidates.join(done, "doc_id", "left_anti")


def companies_in_batch(df: DataFrame, codes: tuple[str, ...] = ("LocalCode", "Code")) -> DataFrame:
    """``code``: the companies of a batch, once each, from the first of the columns that it has."""
    column = next(c for c in codes if c in df.columns)
    return df.select(F.col(column).cast("string").alias("code")).where("code is not null").distinct()


def missing_dates(done: DataFrame, end: str, days: int, date: str = "date") -> DataFrame:
    """Days of the range that ends with ``end`` that aren't in ``done``, the newest first."""
    span = F.sequence(F.date_sub(F.lit(end).cast("date"), days - 1), F.lit(end).cast("date"))
    every = done.sparkSession.range(1).select(F.explode(span).alias(date))
    return every.join(done.select(date).distinct(), date, "left_anti").orderBy(F.desc(date))


def filing_stats(filings: DataFrame, key: str, date: str) -> DataFrame:
    """Count and latest date of each key, and of all (key null) in the same pass."""
    return filings.rollup(key).agg(F.count("*").alias("n"), F.max(date).alias("latest"), F.grouping(key).cast("int").alias("is_total"))


def attach_ticker(index: DataFrame, companies: DataFrame) -> DataFrame:
    """The last ticker of the zero-padded company id; rows without one, or with UNKNOWN, go."""
    names = companies.select(zero_pad(F.col("cik").cast("string")).alias("cik"), "ticker", "ordinal").groupBy("cik").agg(F.max_by("ticker", "ordinal").alias("ticker"))
    return index.withColumn("cik", zero_pad(F.col("cik").cast("string"))).join(names, "cik").where("ticker is not null and ticker <> 'UNKNOWN'")


def melt_facts(df: DataFrame, ids: list[str]) -> DataFrame:
    """Wide statements to facts: every other column a tag, values that aren't numbers dropped, keyed by md5."""
    values = [c for c in df.columns if c not in ids]
    wide = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in values])
    long = wide.unpivot(ids, values, "tag", "raw").withColumn("value", parse_number(F.col("raw"))).where("value is not null").drop("raw")
    return long.withColumn("fact_id", fact_key(*[F.col(c) for c in ids], F.col("tag")))


def stack_statements(df: DataFrame, item: str, period_type: str, keys: list[str]) -> DataFrame:
    """A matrix of items by dates (every other column is named by its date) to ``*keys, item, date, value, period_type``;
    days as ISO texts; cells without a number (null, NaN, or a text that is none) left out."""
    dates = [c for c in df.columns if c not in (*keys, item)]
    wide = df.select(*keys, F.col(item).alias("item"), *[F.nullif(F.col(f"`{c}`").try_cast("double"), F.lit(float("nan"))).alias(c) for c in dates])
    long = wide.unpivot([*keys, "item"], [F.col(f"`{c}`") for c in dates], "_date", "value").where("value is not null")
    return long.select(*keys, "item", F.date_format(F.to_date(F.substring("_date", 1, 10)), "yyyy-MM-dd").alias("date"), "value", F.lit(period_type).alias("period_type"))


#: Cells of the US facts that must be readable if they are there, and as what.
US_CELLS = {"numeric_value": "double", "fiscal_year": "int", "period_start": "date", "period_end": "date", "period_instant": "date"}


def us_fact_rejects(df: DataFrame) -> DataFrame:
    """Rows with a cell that can't be read as its type, and ``reasons``: the names of those cells."""
    return apply_contract(df, {c: f"`{c}` is null or try_cast(`{c}` as {t}) is not null" for c, t in US_CELLS.items()})[1]


def normalize_us_facts(df: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Facts in the stored layout, one for each key: the md5 of ticker, accession number, concept and the three period days
    that are there, as they came.

    Rows without a value (null or NaN) go, and so do those of ``us_fact_rejects``: a bad cell costs its row and not the batch. The
    key leaves out unit and dimension, so facts may share it; the last by ``order`` (columns of the stored layout) stays, of equals
    the greatest by value, unit, label, year, period and the three days.
    """
    from .series import latest_wins

    read = {c: F.col(c).try_cast(t) for c, t in US_CELLS.items()}
    good = df.where(" and ".join(f"(`{c}` is null or try_cast(`{c}` as {t}) is not null)" for c, t in US_CELLS.items()))
    key = fact_key(*[F.col(c) for c in ("ticker", "accession_number", "concept", "period_start", "period_end", "period_instant")])
    days = [read[c].alias(c) for c in ("period_start", "period_end", "period_instant")]
    facts = good.select(key.alias("fact_id"), "accession_number", "ticker", "concept", "label", F.nullif(read["numeric_value"], F.lit(float("nan"))).alias("value"), F.col("unit_ref").alias("unit"), read["fiscal_year"].alias("fiscal_year"), "fiscal_period", *days)
    ties = [c for c in ("value", "unit", "label", "fiscal_year", "fiscal_period", "period_start", "period_end", "period_instant") if c not in order]
    return latest_wins(facts.where("value is not null"), ["fact_id"], [*order, *ties])


def search_filings(df: DataFrame, code: str | None = None, name: str | None = None, form: str | None = None, n: int = 1000, since: str | None = None, until: str | None = None, at: str | None = None, filer: str | None = None) -> DataFrame:
    """The ``n`` newest filings by ``at`` that match all that is given; ``since`` and ``until`` are bounds of ``at``, included.

    ``code``: the filer's code; ``name`` and ``filer``: parts of its security code and of its name, in the letters given;
    ``at``: the time of submission where there is one, else ``doc_id``. Of filings of one time the greatest ``doc_id`` is first.
    """
    at = at or ("submit_datetime" if "submit_datetime" in df.columns else "doc_id")
    kind = dict(df.dtypes)[at]
    if since is not None:
        df = df.where(F.col(at) >= F.lit(since).cast(kind))
    if until is not None:
        df = df.where(F.col(at) <= F.lit(until).cast(kind))
    if code:
        df = df.where(F.col("edinet_code") == code)
    if name:
        df = df.where(F.col("sec_code").contains(name))
    if filer:
        df = df.where(F.col("filer_name").contains(filer))
    if form:
        df = df.where(F.col("form_code") == form)
    ties = [F.desc("doc_id") if at == "submit_datetime" else F.asc("doc_id")] if at != "doc_id" and "doc_id" in df.columns else []
    return df.orderBy(F.desc(at), *ties).limit(n)


def coalesce_sections(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str) -> DataFrame:
    other = secondary.select(*keys, F.col(value).alias("_s"))
    return primary.join(other, keys, "full").withColumn(value, F.coalesce(value, "_s")).drop("_s")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The last write of a key wins; ``batch`` has a key once."""
    return batch.unionByName(target.join(batch, keys, "left_anti"))


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The first write of a key stays."""
    return target.unionByName(batch.join(target, keys, "left_anti"))


def apply_changes(tx: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``changes``: rows of ``tx`` with ``op`` I, U or D; the last change of a key counts."""
    from .series import latest_wins

    last = latest_wins(changes, [key], order)
    return tx.join(last, key, "left_anti").unionByName(last.where("op <> 'D'").select(tx.columns))


def missing_changes(tx: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Updates and deletions of keys that ``tx`` hasn't."""
    return changes.where("op in ('U', 'D')").join(tx, key, "left_anti")


def ingestion_state(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Attempts but the first, and what the last one came to; with its error message where the log has one."""
    last = [F.max_by(c, F.struct(*order)).alias(c) for c in ("status", "error_message") if c in log.columns]
    return log.groupBy(key).agg((F.count("*") - 1).alias("retry_count"), *last)


def apply_contract(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules (SQL conditions by name), and the others with the names of those they fail."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    marked = df.withColumn("reasons", failed)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def replace_days(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch in place of all rows of its keys; keys may repeat on either side."""
    return target.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def backfill_targets(docs: DataFrame, wanted: DataFrame, code: str) -> DataFrame:
    """Documents that are wanted, each once, with the code of the wanted row (the smallest if there are several)."""
    codes = wanted.groupBy("doc_id").agg(F.min(code).alias(code))
    return docs.drop(code).dropDuplicates(["doc_id"]).join(codes, "doc_id")


def resolve_metadata(index: DataFrame, submissions: DataFrame) -> DataFrame:
    """Rows of ``index`` with the exact metadata of their accession number; ``submissions`` has arrays of equal length."""
    fields = ["accessionNumber", "filingDate", "form", "primaryDocument", "primaryDocDescription"]
    rows = submissions.select("cik", F.explode(F.arrays_zip(*fields)).alias("x")).select("cik", *[F.col(f"x.{f}").alias(f) for f in fields])
    plain = F.regexp_replace("accessionNumber", "-", "")
    return index.join(rows.withColumn("accession_number", plain).drop("form"), ["cik", "accession_number"], "left")


def _document(path: str = "path") -> Column:
    """The name of a file without its .zip; empty for other files."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.endswith(".zip"), F.substring(name, F.lit(1), F.length(name) - 4)).otherwise("")


def edinet_facts(rows: DataFrame) -> DataFrame:
    """Rows of ``read_filing_archives`` to facts; lines without a number go.

    Value: the ninth cell, or the last of narrower files. Name: the second cell. Unit: the eighth, else pure. Context:
    the third, else the file's name.
    """
    value = F.when(F.col("width") >= 9, F.col("c8"))
    for i in range(8):
        value = value.when(F.col("width") == i + 1, F.col(f"c{i}"))
    facts = rows.select(
        _document().alias("doc_id"), F.when(F.col("width") >= 2, F.col("c1")).otherwise(F.col("c0")).alias("item_name"), parse_number(value).alias("item_value"),
        F.when(F.col("width") >= 8, F.col("c7")).otherwise("pure").alias("unit"), F.when(F.col("width") >= 3, F.col("c2")).otherwise(F.col("file_name")).alias("context_id"), F.lit("FY").alias("fiscal_period"))
    return facts.where("item_value is not null")


def fiscal_year(rows: DataFrame, filings: DataFrame) -> DataFrame:
    """``doc_id, fiscal_year``: of the end date in the document's DEI file, else of ``submitted``."""
    dei = rows.where(F.lower("file_name").contains("jpdei") & F.col("c0").contains("CurrentFiscalYearEndDateDEI"))
    first = dei.groupBy(_document().alias("doc_id"), "file_name").agg(F.min_by("c8", "line").alias("end"))
    year = first.withColumn("y", F.year(F.col("end").try_cast("date"))).where("y is not null").groupBy("doc_id").agg(F.min_by("y", "file_name").alias("y"))
    return filings.join(year, "doc_id", "left").select("doc_id", F.coalesce("y", F.year("submitted")).alias("fiscal_year"))


def pack_sections(df: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """The sections of each document as one JSON object, by name; of a name that repeats the greatest text stays."""
    once = df.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.max(content).alias(content))
    return once.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, content))))).alias("sections"))


def evolve_transactions(df: DataFrame) -> DataFrame:
    """Old transactions in today's columns: date is timestamp, memo is there, currency is there and never null."""
    if "date" in df.columns and "timestamp" not in df.columns:
        df = df.withColumnRenamed("date", "timestamp")
    if "memo" not in df.columns:
        df = df.withColumn("memo", F.lit(None).cast("string"))
    return df.withColumn("currency", F.coalesce("currency", F.lit("USD")) if "currency" in df.columns else F.lit("USD"))


def migrate_facts(df: DataFrame) -> DataFrame:
    """Stored facts in the narrower layout: redundant columns gone, types fixed."""
    kinds = {"doc_id": "string", "item_name": "string", "item_value": "double", "unit": "string", "context_id": "string", "fiscal_year": "int", "fiscal_period": "string", "session_id": "string"}
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in kinds.items()])
