"""Column helpers: codes, symbols, numbers, dates, keys and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Display symbols.
CURRENCY_SYMBOLS = {"USD": "$", "JPY": "¥", "EUR": "€", "CNY": "¥"}

#: Tags of narrative sections that have names of their own.
SECTION_NAMES = {
    "BusinessRisksTextBlock": "business_risk",
    "ManagementPolicyBusinessEnvironmentIssuesToAddressTextBlock": "management_policy",
    "ResearchAndDevelopmentActivitiesTextBlock": "research_development",
    "AnalysisOfFinancialPositionOperatingResultsAndCashFlowsTextBlock": "mda",
}


def stable4(x: Column) -> Column:
    """``x`` to four places in a way that does not depend on an engine's rounding of ties; -0.0 becomes 0.0."""
    return F.floor(x * F.lit(1e4) + F.lit(0.501)) / F.lit(1e4) + F.lit(0.0)


def normalize_jp_code(c: Column, suffix: str = "") -> Column:
    """Of five characters with a final 0 the first four, white space around it aside; with an exchange's ``suffix`` (.T)."""
    bare = F.trim(c)
    code = F.when((F.length(bare) == 5) & bare.endswith("0"), F.substring(bare, 1, 4)).otherwise(bare)
    return F.concat(code, F.lit(suffix)) if suffix else code


def standardize_ticker(c: Column) -> Column:
    """Upper case without white space and a -USD ending; null unless letters, digits, - . _ only."""
    up = F.regexp_replace(F.upper(F.trim(c)), "-USD$", "")
    return F.when(up.rlike(r"^[A-Z0-9\-._]+$"), up)


def route_source(ticker: Column, asset_type: Column) -> Column:
    return F.when(ticker.startswith("^"), "index").when(asset_type == "CRYPTO", "crypto").otherwise("stock")


def parse_number(c: Column) -> Column:
    """A number written with thousands separators; null for anything else."""
    bare = F.trim(F.replace(c, F.lit(","), F.lit("")))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def fact_key(*cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def profile_hash(*fields: str) -> Column:
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}:"), F.col(f).cast("string"), F.lit("|"))).otherwise("") for f in fields]
    return F.md5(F.concat(*parts))


def normalize_section(c: Column) -> Column:
    """The section that a tag names: its fixed name, or the tag in snake case without its TextBlock ending."""
    bare = F.regexp_replace(c, "TextBlock$", "")
    # The two patterns that part words.
    plain = F.lower(F.regexp_replace(F.regexp_replace(bare, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))
    return F.coalesce(*[F.when(c == tag, name) for tag, name in SECTION_NAMES.items()], plain)


def clean_text(c: Column) -> Column:
    """Every line stripped, at most one empty line in a row, nothing around."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?m)^[ \t]+|[ \t]+$", ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def to_day(c: Column) -> Column:
    """The day of a date, a time or an ISO text; a text's zone is dropped, not applied, and what is no date is null."""
    return F.to_date(F.substring(c.cast("string"), 1, 10).try_cast("date"))


def accession(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.substring_index(c, "/", -1), r"\.txt$", ""), "-", "")


def zero_pad(c: Column, n: int = 10) -> Column:
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def currency_symbol(c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in CURRENCY_SYMBOLS.items() for x in kv])
    return F.coalesce(F.get(F.map_values(F.map_filter(pairs, lambda k, v: k == c)), F.lit(0)), c)


def clean_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become null."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def empty_to_null(df: DataFrame) -> DataFrame:
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in texts else F.col(c) for c in df.columns])


def strip_nonprintable(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{C}&&[^\t\n\r]]", "")


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def pick_column(df: DataFrame, candidates: list[str]) -> Column:
    """The first candidate column that is there and not null."""
    have = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None)
