"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A rule rejects a text whose signal is over the rule's cutoff; a text is rejected if any rule rejects it. The cutoffs are
tightened along a path that is fixed beforehand: rule after rule one step, from the loosest to the strictest. For each stratum
(language) the steps are tried in this order on labelled documents: with ``n`` good ones of which ``k`` would be rejected by any
rule at its cutoff so far, a step is accepted if a binomial variable with false-rejection rate ``ALPHA`` would be ``k`` or less
with a probability of at most ``DELTA`` over the number of strata (Bonferroni); the first that fails ends the path, which needs
no more correction. So with probability 1 - ``DELTA`` the rules together reject no more than ``ALPHA`` of the good texts of any
stratum. A stratum without enough labels gets no cutoff, and its texts are kept unless a base rule fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, documents, written

ALPHA, DELTA = 0.01, 0.05
#: Cutoffs of each signal, the loosest first.
GRID = {
    "symbol_rate": [1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "bang_rate": [1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05],
    "capital_rate": [0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeat_rate": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "dup_line_rate": [0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "word_length": [30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0],
}
#: The white space between words, and the symbols that count.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
CAPITALS = "".join(map(chr, range(65, 91)))


def let(value: Column, body) -> Column:
    """``body`` of ``value`` computed once (in a lambda an expression would be computed again for each element)."""
    return F.transform(F.array(value), body)[0]


def _without(chars: str) -> Column:
    return F.length(F.translate("t", chars, ""))


def _repeat_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more."""

    def covered(keys: Column) -> Column:
        order = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def of(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, j: ((j > 0) & (F.get(s, j - 1)["k"] == x["k"])) | ((j < n - 1) & (F.get(s, j + 1)["k"] == x["k"]))
            at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
            gaps = lambda a: F.aggregate(F.transform(a, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(a, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda t, x: t + x)
            return let(at, gaps)

        return let(order, of)

    def from_words(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(from_words(words))


def signals(docs: DataFrame) -> DataFrame:
    """``doc_id, lang``, the base counts and ``base_failed``, and the six signals, of every row. A null text has no words."""
    t = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    words = F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    rows = t.select("doc_id", "lang", _without(SPACE).cast("long").alias("word_chars"), (F.length("t") - _without(SYMBOLS)).cast("long").alias("n_symbols"),
                    (F.length("t") - _without("!")).alias("bangs"), (F.length("t") - _without(CAPITALS)).alias("capitals"),
                    let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
                    let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"))
    rows = rows.select("doc_id", "lang", "w.n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "w.n_repeat_words", "bangs", "capitals", F.col("lines.n").alias("n_lines"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "n_words").alias("symbol_rate"), rate("bangs", "n_words").alias("bang_rate"), rate("capitals", "word_chars").alias("capital_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("word_chars", "n_words").alias("word_length"),
    )


def tail(n: str, k: str, rate: float) -> Column:
    """P(X <= k) of a binomial variable, exactly summed; in logarithms, so that large ``n`` doesn't underflow."""
    odds = f"ln({rate!r}) - ln(1 - {rate!r})"
    step = f"s.p + ln(({n} - j + 1) / j) + {odds}"
    add = f"greatest(s.t, {step}) + ln(1 + exp(-abs(s.t - ({step}))))"
    first = f"{n} * ln(1 - {rate!r})"
    return F.expr(f"CASE WHEN {k} > {n} * {rate!r} THEN 1D ELSE exp(aggregate(CASE WHEN {k} >= 1 THEN sequence(1L, {k}) ELSE array() END, "
                  f"named_struct('p', CAST({first} AS DOUBLE), 't', CAST({first} AS DOUBLE)), "
                  f"(s, j) -> named_struct('p', CAST({step} AS DOUBLE), 't', CAST({add} AS DOUBLE)), s -> s.t)) END")  # fmt: skip


#: The path: the rule and the cutoff that each step tightens.
STEPS = [(r, cs[i]) for i in range(max(map(len, GRID.values()))) for r, cs in GRID.items() if i < len(cs)]


def first_step() -> Column:
    """The first step of the path that rejects a text, from its signals; one past the last if none does."""
    by_rule = []
    for r in GRID:
        at = F.lit(len(STEPS))
        for k in reversed([k for k, (name, _) in enumerate(STEPS) if name == r]):
            at = F.when(F.col(r) > STEPS[k][1], F.lit(k)).otherwise(at)
        by_rule.append(at)
    return F.least(*by_rule)


def accepted_steps(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``lang`` (null: '') and ``step``, the last accepted one, of the strata that have any, from the good of all labelled
    documents.

    Documents that fail a base rule are no evidence: no cutoff decides on them. A document with labels that differ is good
    only if all say so.
    """
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = scored.where("not base_failed").join(good, "doc_id", "left_semi").select(F.coalesce("lang", F.lit("")).alias("lang"), first_step().alias("first"))
    # A row for each stratum and step at most.
    counts = held.groupBy("lang", "first").agg(F.count("*").alias("c")).groupBy("lang").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("first", "c"))).alias("at"))
    strata = counts.agg(F.count("*").alias("strata"))
    tried = counts.crossJoin(F.broadcast(strata)).select("lang", "n", "strata", "at", F.explode(F.sequence(F.lit(0), F.lit(len(STEPS) - 1))).alias("step"))
    rejected = F.aggregate(F.sequence(F.lit(0), F.col("step")), F.lit(0).cast("long"), lambda t, i: t + F.coalesce(F.try_element_at("at", i), F.lit(0)))
    passed = tried.withColumn("k", rejected).withColumn("ok", tail("n", "k", alpha) <= F.lit(delta) / F.col("strata"))
    until = F.min("ok").over(W.partitionBy("lang").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return passed.withColumn("ok", until).where("ok").groupBy("lang").agg(F.max("step").alias("step"))


def cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``lang`` (null: '') and the accepted cutoff of each rule (null: none)."""
    limits = [F.lit(None).cast("double")] * len(GRID)
    for k, (r, c) in enumerate(STEPS):
        j = list(GRID).index(r)
        limits[j] = F.when(F.col("step") >= k, F.lit(c)).otherwise(limits[j])
    return accepted_steps(scored, labels, alpha, delta).select("lang", *[x.alias(f"max_{r}") for r, x in zip(GRID, limits, strict=True)])


@written
def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every row of ``docs(doc_id, text, lang)``; ``labels(doc_id, quality)``.

    A null doc_id stays null, a null language is a stratum of its own, repeated rows are judged alike, no rows give none.
    """
    scored = cut(signals(docs), "signals")
    limits = F.broadcast(accepted_steps(scored, labels).withColumnRenamed("lang", "stratum"))
    judged = scored.join(limits, F.coalesce("lang", F.lit("")) == F.col("stratum"), "left")
    over = F.coalesce(first_step() <= F.col("step"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"), *GRID)


def op7_quality_rules(spark, sf_dir):
    return apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
