"""Standard concepts from raw facts, and a quality score of each document's statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tags of each standard concept.
CONCEPTS = {
    "net_sales": ["NetSales", "NetSalesSummaryOfBusinessResults", "OperatingRevenue", "OperatingRevenueFND"],
    "operating_income": ["OperatingIncome"],
    "ordinary_income": ["OrdinaryIncome"],
    "net_income": ["ProfitLoss"],
    "total_assets": ["Assets", "TotalAssetsSummaryOfBusinessResults"],
    "total_liabilities": ["Liabilities"],
    "net_assets": ["NetAssets", "NetAssetsSummaryOfBusinessResults"],
    "interest_expense": ["InterestExpense", "InterestExpenses", "InterestExpensesNOE"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesSummaryOfBusinessResults"],
    "current_assets": ["CurrentAssets"],
    "cash_and_deposits": ["CashAndDeposits"],
    "current_liabilities": ["CurrentLiabilities"],
}


def standardize_facts(facts: DataFrame) -> DataFrame:
    """``doc_id, scope, concept, value`` from ``facts(doc_id, element, context, value, ordinal)`` of the current year.

    ``scope``: cons or non_cons. Of several facts of a concept the one with the largest ordinal counts, then the largest.
    """
    concept = F.coalesce(*[F.when(F.col("element").isin(tags), F.lit(c)) for c, tags in CONCEPTS.items()])
    scope = F.when(F.col("context").contains("NonConsolidated"), "non_cons").otherwise("cons")
    now = facts.where(F.col("context").contains("CurrentYear") & F.col("value").isNotNull())
    named = now.select("doc_id", scope.alias("scope"), concept.alias("concept"), "value", "ordinal").where("concept is not null")
    return named.groupBy("doc_id", "scope", "concept").agg(F.max_by("value", F.struct("ordinal", "value")).alias("value"))


def score_statements(standard: DataFrame, tolerance: float = 1000.0) -> DataFrame:
    """A score of 0 to 100 for each document of ``standard(doc_id, scope, concept, value)``, and what lowers it.

    30 off, and invalid, if no scope has both sales and assets; 20 off for each scope whose assets differ from liabilities
    and net assets by more than ``tolerance``; 20 off for each negative sales or assets value. ``missing_fields`` names what
    the scopes lack, the consolidated first, and nothing once that one is complete.
    """
    of = lambda c: F.max(F.when(F.col("concept") == c, F.col("value")))
    scopes = standard.groupBy("doc_id", "scope").agg(of("net_sales").alias("s"), of("total_assets").alias("a"), of("total_liabilities").alias("l"), of("net_assets").alias("n"))
    lacks = F.array_compact(F.array(F.when(F.col("s").isNull(), F.concat(F.lit("net_sales_"), "scope")), F.when(F.col("a").isNull(), F.concat(F.lit("total_assets_"), "scope"))))
    one = lambda c: F.when(c, 1).otherwise(0)
    off = one(F.abs(F.col("a") - (F.col("l") + F.col("n"))) > tolerance)
    known = one(F.col("a").isNotNull()) + one(F.col("l").isNotNull()) + one(F.col("n").isNotNull())
    each = scopes.select("doc_id", "scope", lacks.alias("lacks"), off.alias("off"), (one(F.col("s") < 0) + one(F.col("a") < 0)).alias("neg"), one(known.between(1, 2)).alias("open"))
    cons = F.flatten(F.collect_list(F.when(F.col("scope") == "cons", F.col("lacks"))))
    rest = F.flatten(F.collect_list(F.when(F.col("scope") == "non_cons", F.col("lacks"))))
    docs = each.groupBy("doc_id").agg(
        F.bool_or(F.size("lacks") == 0).alias("valid"), F.bool_or((F.col("scope") == "cons") & (F.size("lacks") == 0)).alias("cons_whole"),
        F.bool_and(F.size("lacks") == 0).alias("all_whole"), F.sum("off").alias("off"), F.sum("neg").alias("neg"), F.sum("open").alias("open"), cons.alias("cons"), rest.alias("rest"),
    )
    score = F.greatest(F.lit(0).cast("long"), 100 - F.when(F.col("valid"), 0).otherwise(30) - 20 * F.col("off") - 20 * F.col("neg"))
    warnings = F.array_compact(F.array(
        F.when(~F.col("valid"), "critical fields missing"), F.when(F.col("valid") & ~F.col("all_whole"), "a scope lacks critical fields"),
        F.when(F.col("off") > 0, "assets differ from liabilities and net assets"), F.when(F.col("open") > 0, "balance can't be verified"), F.when(F.col("neg") > 0, "negative sales or assets"),
    ))
    missing = F.when(F.col("cons_whole"), F.array().cast("array<string>")).otherwise(F.concat("cons", "rest"))
    return docs.select("doc_id", score.alias("quality_score"), F.col("valid").alias("is_valid"), (F.col("off") == 0).alias("balanced"), (F.col("neg") == 0).alias("no_negatives"), missing.alias("missing_fields"), warnings.alias("warnings"))
