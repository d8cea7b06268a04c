"""Toxicity by weak supervision.

1. Words and word beginnings are mined that toxic documents have far more often, from all labelled documents: counted by label
   with partial sums and chosen by statistical tests alone. The terms are dealt out to lexicon
   voters (whole words) and pattern voters (beginnings of 4 to 9 letters), and two more voters look for several of them and for
   none.
2. All documents vote. A generative label model is fitted to the counts of all vote patterns by EM, without labels: a prior,
   each voter's rates on toxic and clean documents, and, from what its posterior leaves unexplained, the correlations between
   voters, by which correlated votes count for less. EM begins with voters that are rarely wrong, so the class that they speak
   for is the toxic one.
3. A linear classifier over the mined terms is trained on the posterior labels of all documents, grouped by the terms they
   have, and scores every document. The score from which on a text counts as toxic is set on all labelled documents.

Labels choose terms and set that one number; neither the label model nor the classifier sees one.
Labels are taken only from rows whose held-out remainder isn't 0, and labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, scratch, small, written

LEXICONS = 5
SHORT, LONG = 4, 9
#: Log odds that a mined term has at least, two standard errors down; share of its documents that are toxic, at least; toxic
#: documents that it is in, at least.
LEAST_ODDS, PRECISION, SUPPORT = 1.0, 0.8, 4
#: Bits of the sieve of term hashes; words, and terms, that a task remembers.
SIEVE, MEMO, TERMS = 20, 200_000, 200_000
_word = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    """The word, and its proper beginnings of 4 to 9 letters, marked by a final hyphen."""
    return [word, *(f"{word[:k]}-" for k in range(SHORT, min(LONG, len(word) - 1) + 1))]


class Matcher:
    """Finds which terms a text has; what is found for a word is remembered."""

    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = found = tuple(self.index[t] for t in terms_of(word) if t in self.index)
        return found

    def __call__(self, text: str | None) -> list[int]:
        get, out = self.memo.get, set()
        for w in set(_word.findall((text or "").lower())):
            found = get(w)
            out.update(self.of(w) if found is None else found)
        return sorted(out)


def _counted(sieve: np.ndarray | None):
    """Texts to counts of documents by term, of the terms that the sieve lets through; a term may come more than once."""

    def run(batches):
        counts: Counter = Counter()
        memo: dict[str, tuple[str, ...]] = {}

        def of(word: str) -> tuple[str, ...]:
            if len(memo) >= MEMO:
                memo.clear()
            terms = terms_of(word)
            memo[word] = out = tuple(terms if sieve is None else [t for t in terms if sieve[zlib.crc32(t.encode()) >> 32 - SIEVE]])
            return out

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                have = set()
                for w in set(_word.findall((text or "").lower())):
                    terms = memo.get(w)
                    have.update(of(w) if terms is None else terms)
                counts.update(have)
                if len(counts) > TERMS:
                    yield out()
                    counts.clear()
        yield out()

    return run


def mined(labelled: DataFrame) -> list[str]:
    """The terms that pass the tests, the most telling first: by the lower end of their log odds.

    Toxic documents are counted first. Of the clean ones only terms count that a toxic one has often enough: a sieve of a fixed
    size, bits of the hashes of those terms, goes to the tasks.
    """
    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return []
    count = lambda kind, sieve, name: labelled.where(f"toxic = {kind}").select("text").mapInArrow(_counted(sieve), "term string, n long").groupBy("term").agg(F.sum("n").alias(name))
    toxic = cut(count(1, None, "a").where(F.col("a") >= SUPPORT), "toxic")
    sieve = np.zeros(1 << SIEVE, bool)
    # At most 2 ** SIEVE numbers, whatever the input.
    sieve[[r[0] for r in toxic.select(F.shiftright(F.crc32("term"), 32 - SIEVE).cast("int")).distinct().collect()]] = True
    counts = toxic.join(count(0, sieve, "b"), "term", "left").select("term", "a", F.coalesce("b", F.lit(0)).alias("b"))
    a, b = F.col("a"), F.col("b")
    low = F.log((a + 0.5) / (pos + 1)) - F.log((b + 0.5) / (neg + 1)) - 2 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    passed = counts.where((a >= PRECISION * (a + b)) & (low > LEAST_ODDS)).select("term", "a", "b", low.alias("low")).collect()
    ranked, have = [], {}
    for name, x, y, least in sorted(passed, key=lambda r: (len(r[0]), r[0])):
        term = name.rstrip("-")
        shorter = f"{term[:-1]}-" if name.endswith("-") else f"{term[: min(LONG, len(term) - 1)]}-"
        have[name] = (x, y)
        if have.get(shorter) != (x, y):  # else found wherever a shorter beginning is
            ranked.append((-least * np.sqrt(x), name))
    return [t for _, t in sorted(ranked)]


def voters(terms: list[str]) -> np.ndarray:
    """For each term the voter that it belongs to: the lexicons first, then the patterns; dealt in order of strength."""
    out, dealt = np.zeros(len(terms), np.int64), [0, 0]
    for i, t in enumerate(terms):
        kind = t.endswith("-")
        out[i] = LEXICONS * kind + dealt[kind] % LEXICONS
        dealt[kind] += 1
    return out


def votes(found: list[int], owner: np.ndarray) -> int:
    """The votes as bits: a bit for each lexicon and pattern voter, then 'three terms or more' and 'no term'."""
    out = reduce(lambda a, i: a | 1 << int(owner[i]), found, 0)
    return out | (len(found) >= 3) << 2 * LEXICONS | (not found) << 2 * LEXICONS + 1


VOTERS = 2 * LEXICONS + 2


class LabelModel:
    """Prior, rates of each voter by label, and discounts for correlated voters, by EM over counted vote patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60):
        w = counts / max(1, counts.sum())
        v = (patterns[:, None] >> np.arange(VOTERS)) & 1
        self.prior = 0.1
        # Voters but the last ('no term') speak for toxic: where EM starts.
        self.rate = np.stack([np.r_[np.full(VOTERS - 1, 0.02), 0.9], np.r_[np.full(VOTERS - 1, 0.5), 0.05]])
        self.weight = np.ones(VOTERS)
        self.correlation = np.eye(VOTERS)
        for step in range(rounds):
            q = self.posterior(patterns)
            self.prior = float(np.clip((w * q).sum(), 0.001, 0.5))
            for kind, part in enumerate((w * (1 - q), w * q)):
                self.rate[kind] = (part @ v + 1e-4) / (part.sum() + 2e-4)
            if step >= rounds // 3:
                mean = self.rate[0] + q[:, None] * (self.rate[1] - self.rate[0])
                rest = v - mean
                cov = (w[:, None] * rest).T @ rest + 1e-9 * np.eye(VOTERS)
                self.correlation = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
                self.weight = 1 / np.maximum(1, np.abs(self.correlation).sum(axis=0))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = (patterns[:, None] >> np.arange(VOTERS)) & 1
        like = [np.where(v, np.log(r), np.log(1 - r)) for r in self.rate]
        z = np.log(self.prior / (1 - self.prior)) + ((like[1] - like[0]) * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Scorer:
    """A linear classifier over mined terms."""

    def __init__(self, terms: list[str], weights: np.ndarray, bias: float):
        self.find, self.weights, self.bias = Matcher(terms), weights, bias

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        return np.clip(np.array([self.bias + self.weights[self.find(t)].sum() for t in texts], float), -30, 30)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(texts)))


#: Tenths of log odds, from -30 to 30.
BINS = 600


def threshold(labelled: DataFrame, scorer: Scorer) -> float:
    """The log odds from which on a text counts as toxic so that the fewest of ``labelled(text, toxic)`` are wrong."""

    def binned(batches):
        counts = np.zeros((2, BINS + 1), np.int64)
        for batch in batches:
            place = np.round((scorer.log_odds(batch.column(0).to_pylist()) + 30) * 10).astype(int)
            np.add.at(counts, (batch.column(1).to_numpy(), place), 1)
        kind, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(place), pa.array(counts[kind, place])], ["toxic", "place", "n"])

    counts = np.zeros((2, BINS + 1), np.int64)
    for kind, place, n in labelled.select("text", "toxic").mapInArrow(binned, "toxic long, place long, n long").groupBy("toxic", "place").agg(F.sum("n")).collect():
        counts[kind, place] = n
    wrong = np.concatenate(([0], np.cumsum(counts[1]))) + np.concatenate((np.cumsum(counts[0][::-1])[::-1], [0]))
    best = np.flatnonzero(wrong == wrong.min())
    return (float(best[len(best) // 2]) - 0.5) / 10 - 30


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Mine terms from all ``labels(doc_id, toxic)`` that aren't held out, and fit on the votes of all ``docs``.

    Without labels of both kinds the classifier gives every text the share of toxic labels, or 0.
    """
    with scratch(docs.sparkSession):
        return _train(docs, labels)


def _train(docs: DataFrame, labels: DataFrame) -> Scorer:
    ids = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    labelled = cut(named.join(small(cut(ids, "ids")), "doc_id").select("text", "toxic"), "labelled")
    terms = mined(labelled)
    if not terms:
        share = labelled.agg(F.avg("toxic")).first()[0] or 0.0
        return Scorer([], np.zeros(0), float(np.log((share + 1e-4) / (1 - share + 1e-4))))
    owner, find = voters(terms), Matcher(terms)

    def voted(batches):
        counts: Counter = Counter()

        def out():
            found = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([[terms[i] for i in f] for f in found], pa.list_(pa.string())), pa.array([votes(f, owner) for f in found], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["found", "pattern", "n"])

        for batch in batches:
            counts.update(tuple(find(t)) for t in batch.column(0).to_pylist())
            if len(counts) > TERMS:
                yield out()
                counts.clear()
        yield out()

    # Documents with the same terms are one row of that weight.
    seen = named.select("text").mapInArrow(voted, "found array<string>, pattern long, n long").groupBy("found", "pattern").agg(F.sum("n").alias("n"))
    seen = cut(seen, "votes")
    # There are at most 2 ** VOTERS patterns.
    patterns = seen.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    model = LabelModel(np.array([r[0] for r in patterns], np.int64), np.array([r[1] for r in patterns], float))
    q = model.posterior(np.array([r[0] for r in patterns], np.int64))
    posterior = docs.sparkSession.createDataFrame([(r[0], float(x)) for r, x in zip(patterns, q, strict=True)], "pattern long, q double")
    soft = seen.join(F.broadcast(posterior), "pattern")
    soft = soft.select("found", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("q") * F.col("n")).alias("weight")), F.struct(F.lit(0.0).alias("label"), ((1 - F.col("q")) * F.col("n")).alias("weight")))).alias("x")).select("found", "x.*")
    features = CountVectorizerModel.from_vocabulary(terms, "found", "features").setBinary(True).transform(soft)
    fitted = LogisticRegression(weightCol="weight", regParam=0.0001, maxIter=60, standardization=False).fit(features)
    scorer = Scorer(terms, fitted.coefficients.toArray(), float(fitted.intercept))
    scorer.bias -= threshold(labelled, scorer)
    return scorer


@written
def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``. A null text is empty and has no term;
    a null doc_id stays null and isn't held out."""

    def run(batches):
        for batch in batches:
            p = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@written
def keep_clean(docs: DataFrame, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores under ``least``."""

    def run(batches):
        for batch in batches:
            p = scorer(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(p < least))

    return docs.mapInArrow(run, docs.schema)
