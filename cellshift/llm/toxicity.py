"""Toxicity scores by the votes of the nearest labelled examples.

Learning looks at no more than ``LEARNING_ROWS`` labelled rows (a hash sample beyond that;
equal texts once).  Terms are lower-case words and word beginnings of four to six letters;
kept are those that occur significantly and several times more often in toxic rows.  A
text is the TF-IDF vector of its kept terms, of length one.  Rows with equal vectors are
one example with its counts.  Examples lie in blocks of an inverted index that knows every
term's largest weight per block: a query opens blocks in the order of the score they could
reach and stops where that is below its k-th best, so the nearest examples are exact.
Close examples vote more than far ones; the share is mapped to a probability by an
isotonic fit on the learning rows, each scored without its own vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import bounded_batches, text_of
from cellshift.session import written

LEARNING_ROWS = 40_000
PREFIXES = (4, 5, 6)
# Chi-squared a term must reach (a chance of one in twenty million), times the usual odds
# of label 1, rows it must occur in, terms kept.
LEAST_CHI2, LEAST_ODDS, LEAST_ROWS, MOST_TERMS = 30.0, 3.0, 5, 2_000
NEIGHBOURS, BLOCK = 16, 64
THRESHOLD = 0.3
FLUSH_TERMS, CACHE_WORDS, CACHE_VECTORS = 200_000, 400_000, 50_000
WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> tuple[str, ...]:
    """The word, and its beginnings marked by a star."""
    return (word, *[word[:n] + "*" for n in PREFIXES if len(word) > n])


def _batch(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (term, rows, toxic rows), flushed before the table grows large."""
    rows: Counter = Counter()
    toxic: Counter = Counter()

    def table() -> pa.RecordBatch:
        counts = [pa.array(list(rows.values()), pa.int64()), pa.array([toxic[t] for t in rows], pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *counts], ["term", "n", "toxic"])

    for batch in batches:
        for text, label in zip(*_batch(batch, "text", "label"), strict=True):
            terms = {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}
            rows.update(terms)
            if label:
                toxic.update(terms)
            if len(rows) > FLUSH_TERMS:
                yield table()
                rows.clear(), toxic.clear()
    yield table()


def learning_rows(docs: DataFrame, labels: DataFrame, most: int = LEARNING_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most about ``most`` labelled documents, equal texts once.

    Of contradicting labels of an id, or of equal texts, the toxic one counts; missing
    labels and ids do not.  The sampled ids are few by construction, so they are
    broadcast and texts stay where they are.
    """
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    known = written(known, "known-labels")
    n = known.count()
    kept = known if n <= most else known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(kept), "doc_id")
    once = rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("doc_id", "text")).alias("row"), F.max("label").alias("label"))
    return once.select("row.*", "label")


def telling_terms(rows: DataFrame, least: float = LEAST_CHI2, most: int = MOST_TERMS) -> list[tuple[str, float]]:
    """(term, inverse document frequency) of the terms of (text, label) that speak for label 1, in term order."""
    bounded_batches(rows.sparkSession)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    n_all, t_all = float(total.n), float(total.toxic)
    counts = rows.select("text", "label").mapInArrow(_row_counts, "term string, n bigint, toxic bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    n, toxic = F.col("n").cast("double"), F.col("toxic").cast("double")
    # Two by two table with Yates' correction.
    apart = F.abs(toxic * F.lit(n_all) - n * F.lit(t_all)) - F.lit(n_all / 2)
    scale = n * (F.lit(n_all) - n) * F.lit(t_all) * F.lit(n_all - t_all)
    chi2 = F.when((scale > 0) & (apart > 0), F.lit(n_all) * apart * apart / scale).otherwise(0.0)
    often = (toxic + 0.5) * F.lit(n_all - t_all) >= LEAST_ODDS * (n - toxic + 0.5) * F.lit(t_all)
    best = counts.filter((F.col("n") >= LEAST_ROWS) & often).withColumn("chi2", chi2).filter(F.col("chi2") >= least).orderBy(F.desc("chi2"), "term").limit(most)
    return sorted((r.term, math.log((n_all + 1) / (r.n + 1)) + 1) for r in best.collect())


class Vectors:
    """Texts to unit vectors over kept terms."""

    def __init__(self, terms: list[tuple[str, float]]) -> None:
        self.place = {term: i for i, (term, _) in enumerate(terms)}
        self.idf = [idf for _, idf in terms]
        self._known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str) -> tuple[tuple[int, int], ...]:
        """(place, count) of the kept terms of a text, in order."""
        if len(self._known) > CACHE_WORDS:
            self._known.clear()
        known, place = self._known, self.place
        out: Counter = Counter()
        for word, n in Counter(WORD.findall(text.lower())).items():
            at = known.get(word)
            if at is None:
                at = known[word] = tuple(place[t] for t in terms_of(word) if t in place)
            for i in at:
                out[i] += n
        return tuple(sorted(out.items()))

    def unit(self, counts: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of length one."""
        weights = np.array([(1 + math.log(n)) * self.idf[i] for i, n in counts])
        return np.array([i for i, _ in counts], np.int64), weights / math.sqrt(float(weights @ weights))


class BlockMaxIndex:
    """Inverted lists over unit vectors, cut into blocks of examples, with each term's largest weight per block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> None:
        self.block, self.n_terms, self.n_blocks = block, n_terms, -(-len(vectors) // block)
        empty = (np.empty(0, np.int64), np.empty(0))
        terms, weights = (np.concatenate([x[i] for x in [*vectors, empty]]) for i in (0, 1))
        owners = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors]) if vectors else empty[0]
        order = np.lexsort((owners, terms, owners // block))
        self.terms, self.owners, self.weights = terms[order], owners[order], weights[order]
        self.starts = np.searchsorted(self.owners // block, np.arange(self.n_blocks + 1))
        self.largest = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.largest, (self.terms, self.owners // block), self.weights)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k largest (cosine, example) over 0, ties to the smaller example; blocks that cannot reach them stay closed."""
        query = np.zeros(self.n_terms)
        query[terms] = weights
        bounds = weights @ self.largest[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            least = -best[-1][0] - 1e-9 if len(best) == k else 0.0
            if bounds[b] <= 0 or bounds[b] < least:
                break
            own = slice(self.starts[b], self.starts[b + 1])
            scores = np.bincount(self.owners[own] - b * self.block, self.weights[own] * query[self.terms[own]], self.block)
            at = np.flatnonzero(scores > least)
            if len(at):
                best = sorted([*best, *zip((-scores[at]).tolist(), (at + b * self.block).tolist(), strict=True)])[:k]
        return [(-s, i) for s, i in best]


BINS = 25


def isotonic(bins: list[tuple[float, float, float]], prior: float) -> tuple[list[float], list[float]]:
    """Points of a rising line through the label shares of bins (rows, sum of x, toxic rows) in order of x, each smoothed by one row of the prior."""
    blocks: list[list[float]] = []
    share = lambda z: (z[2] + prior) / (z[0] + 1)
    for part in bins:
        blocks.append(list(part))
        while len(blocks) > 1 and share(blocks[-2]) >= share(blocks[-1]):
            last = blocks.pop()
            blocks[-1] = [a + c for a, c in zip(blocks[-1], last, strict=True)]
    return [z[1] / z[0] for z in blocks], [share(z) for z in blocks]


@dataclass
class Judge:
    """Examples with their index, and the map from votes to probabilities."""

    terms: list[tuple[str, float]]
    keys: list[tuple] = field(default_factory=list)  # (place, count) tuples, one per example
    tallies: list[tuple[int, int, int]] = field(default_factory=list)  # rows, toxic rows, smallest id
    prior: float = 0.0
    without: float = 0.0  # toxic share of rows with no kept term
    points: tuple[list[float], list[float]] = ((), ())

    def prepare(self) -> Judge:
        self.vectors = Vectors(self.terms)
        self.index = BlockMaxIndex([self.vectors.unit(k) for k in self.keys], len(self.terms))
        self._seen: dict[tuple, tuple[float, list]] = {}
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("vectors", "index", "_seen")}

    def votes(self, counts: tuple, own: int | None = None) -> tuple[float, list[tuple[int, float, float]]]:
        """Toxic share of the nearest examples' votes, and (doc_id, cosine, toxic share) of each.

        ``own`` takes one row of that label away from the example that equals the query.
        """
        total, toxic, evidence = 1.0, self.prior, []
        for cosine, at in self.index.nearest(*self.vectors.unit(counts), NEIGHBOURS):
            rows, bad, doc = self.tallies[at]
            if own is not None and self.keys[at] == counts:
                rows, bad = rows - 1, bad - own
                if not rows:
                    continue
            weight = (1 + math.log(rows)) * cosine / (1.1 - min(cosine, 1.0))
            total, toxic = total + weight, toxic + weight * bad / rows
            evidence.append((doc, cosine, bad / rows))
        return toxic / total, evidence

    def score(self, text: str) -> tuple[float, list[tuple[int, float, float]]]:
        """Probability of label 1 and its evidence; no evidence where no kept term occurs."""
        counts = self.vectors.counts(text)
        if not counts:
            return self.without, []
        if len(self._seen) > CACHE_VECTORS:
            self._seen.clear()
        if counts not in self._seen:
            share, evidence = self.votes(counts)
            self._seen[counts] = float(np.interp(share, *self.points)) if self.points[0] else share, evidence
        return self._seen[counts]


def _to_counts(terms: list[tuple[str, float]]):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(terms)
        for batch in batches:
            ids, texts, labels = _batch(batch, "doc_id", "text", "label")
            counts = [[x for pair in vectors.counts(t) for x in pair] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.list_(pa.int32())), pa.array(labels, pa.int32())], ["doc_id", "counts", "label"])

    return convert


def _paired(flat: list[int]) -> tuple[tuple[int, int], ...]:
    return tuple(zip(flat[::2], flat[1::2], strict=True))


def _unbiased(shared):
    """Bins of the vote shares of examples, each without one row of its own."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, sums = shared.value.prepare(), np.zeros((BINS, 3))
        for batch in batches:
            for flat, rows, toxic in zip(*_batch(batch, "counts", "rows", "toxic"), strict=True):
                for label, n in ((1, toxic), (0, rows - toxic)):
                    if n:
                        share = judge.votes(_paired(flat), label)[0]
                        sums[min(int(share * BINS), BINS - 1)] += n, n * share, n * label
        some = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(sums[some, i]) for i in range(3)]], ["bin", "n", "share", "toxic"])

    return vote


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARNING_ROWS) -> Judge:
    """Fit on (doc_id, text) and (doc_id, label); only the bounded sample's counts reach the driver.

    Without labelled rows, or with one label only, every text gets that label's share (0
    without rows).
    """
    spark = docs.sparkSession
    rows = written(learning_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels, most), "learning-rows")
    terms = telling_terms(rows)
    listed = rows.mapInArrow(_to_counts(terms), "doc_id bigint, counts array<int>, label int").groupBy("counts").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("toxic"), F.min("doc_id").alias("doc_id")
    )
    examples = written(listed, "examples")
    judge, vectors = Judge(terms), Vectors(terms)
    # Examples with the same heaviest term are neighbours, so that few blocks hold a term's large weights.
    found = []
    n_all = toxic_all = 0
    for row in examples.collect():
        n_all, toxic_all = n_all + row.rows, toxic_all + row.toxic
        key = _paired(row.counts)
        if key:
            places, weights = vectors.unit(key)
            found.append((int(places[weights.argmax()]), key, (row.rows, row.toxic, row.doc_id)))
        else:
            judge.without = row.toxic / row.rows
    found.sort()
    judge.keys, judge.tallies = [key for _, key, _ in found], [tally for _, _, tally in found]
    judge.prior = toxic_all / n_all if n_all else 0.0
    if found:
        dealt = examples.filter(F.size("counts") > 0).repartition(spark.sparkContext.defaultParallelism)
        bins = dealt.mapInArrow(_unbiased(spark.sparkContext.broadcast(judge)), "bin int, n double, share double, toxic double")
        sums = bins.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "share", "toxic")]).orderBy("bin").collect()
        judge.points = isotonic([(r.n, r.share, r.toxic) for r in sums], judge.prior)
    return judge


_READY: dict[int, Judge] = {}

FIELDS = "doc_id bigint, score double, evidence array<struct<doc_id: bigint, cosine: double, toxic_share: double>>"


def _judging(shared):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not _READY.get(0):
            _READY[0] = shared.value.prepare()
        judge = _READY[0]
        for batch in batches:
            ids, texts = _batch(batch, "doc_id", "text")
            found = [judge.score(t) for t in texts]
            listed = [[{"doc_id": d, "cosine": c, "toxic_share": s} for d, c, s in evidence] for _, evidence in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s for s, _ in found], pa.float64()), pa.array(listed, kind)], ["doc_id", "score", "evidence"])

    return score


def scores(docs: DataFrame, judge: Judge) -> DataFrame:
    """(doc_id, score, evidence) of every row of (doc_id, text); null texts are empty, other columns are not looked at.

    Texts without a kept term, empty ones among them, get the toxic share of such
    learning rows and no evidence.  Repeated rows are scored one by one.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(_judging(shared), FIELDS)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept for testing: one in four ids by digest; a missing id counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
