"""Toxicity (operator 9) by maximum-scoring segments of token log-odds.

Tokens are the words of ``decontam.words``, known by a 64-bit hash. From the labelled training
documents every token gets its log-odds between toxic and clean text under a
Dirichlet prior of ``PRIOR`` pseudo-counts, split between the classes as their words are, so that
one never seen has 0. Its score is that less ``COST``, which every token pays, so that a segment
ends where toxic words end. The ``OWN`` tokens with the most
evidence (count times absolute log-odds) score by their own counts; the others share ``1 << SHARED_BITS``
entries by hash, which score by the counts of all tokens in them. Both are documented
sizes of the classifier; every word of every labelled document is counted and every word of
every text scores.

A linear scan finds all maximal-scoring segments of a text. A segment of score
S in a text of n tokens has the extreme-value chance 1 - exp(-K n exp(-L S));
L solves sum p exp(L s) = 1 on clean text and K is fitted to the clean training
documents. A text's evidence is the sum of -ln(chance) over its significant
segments (chance below ``SIGNIFICANT``); a logistic curve fitted on counts per
evidence bin turns log1p(evidence) into the score. K and the curve are fitted on segments that
each training text has under the counts of all the others.

Labels grow with the corpus, so they are never broadcast: texts meet them in a merge join at every size.
Before its shuffle a Bloom filter of fixed size (``FILTER_BITS``) takes out texts without a label; it
passes every text with one. Only sums and bounded tables (tokens, filter, bins) reach the driver.

Defined cases: null or wordless text has no segment and gets the score of no evidence;
documents without a label are scored only; several labels of one id count as
the largest; a null label or id is not learned from; with no labelled toxic or
clean document the score is the share of toxic labels (0 without labels);
repeated rows are judged each for itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, crc_mod, materialize
from .decontam import words

PRIOR = 1.0  # pseudo-counts of every token
COST = 1.0  # taken from every token's log-odds
OWN = 1 << 18  # tokens with an entry of their own
SHARED_BITS = 18
FILTER_BITS = 26
SIGNIFICANT = 0.05
FOLDS, HELD_OUT = 5, 0
BIN = 0.01


class LabelFilter:
    """Bloom filter of the labelled ids: two bits an id among ``1 << FILTER_BITS``."""

    def __init__(self, known: DataFrame):
        at = F.explode(F.array(*self._positions(id_hash("doc_id")))).alias("at")
        got = (known.select(at).groupBy(F.shiftright("at", 6).alias("word"))
               .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow())
        self.words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        self.words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)

    @staticmethod
    def _positions(h: Column) -> list[Column]:
        low = F.lit((1 << FILTER_BITS) - 1)
        return [h.bitwiseAND(low), F.shiftrightunsigned(h, FILTER_BITS).bitwiseAND(low)]

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        h = h.view(np.uint64)
        low, ok = np.uint64((1 << FILTER_BITS) - 1), np.ones(len(h), bool)
        for at in (h & low, (h >> np.uint64(FILTER_BITS)) & low):
            ok &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok


def id_hash(col: str) -> Column:
    return F.xxhash64(F.col(col).cast("string"))


def _labelled(labelled: LabelFilter):
    """Passes the rows whose id may have a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(labelled.may_hold(batch.column("_hash").to_numpy())))
            yield some.select(["doc_id", "text"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for batch in batches:
        by: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            by[toxic].append(hashes.ids(words(text.as_py())))
        for toxic, codes in enumerate(by):
            code, n = np.unique(np.concatenate([np.empty(0, np.uint64), *codes]), return_counts=True)
            zero, n = np.zeros(len(n), np.int64), n.astype(np.int64)
            pair = (zero, n) if toxic else (n, zero)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code.view(np.int64)), pa.array(pair[0]), pa.array(pair[1])], names=["code", "clean", "toxic"])


class LogOdds:
    """Counts of all words by class: sorted codes with their own, and behind them the shared entries of the others."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, shared_bits: int, totals: tuple[float, float], prior: float, cost: float):
        self.codes, self.counts, self.mask, self.cost = codes, counts, np.uint64((1 << shared_bits) - 1), cost
        self.learned = min(totals) > 0
        if self.learned:
            self.totals = np.array(totals)
            self.more = prior * self.totals / self.totals.sum()
        self.scores = self._score(counts)
        p = counts[0] + self.more[0] if self.learned else np.ones(counts.shape[1])
        self.decay = _decay(p / p.sum(), self.scores)

    def _score(self, counts: np.ndarray) -> np.ndarray:
        if not self.learned:
            return np.full(counts.shape[1], -self.cost)
        share = (counts + self.more[:, None]) / self.totals[:, None]
        return np.log(share[1] / share[0]) - self.cost

    def entries(self, codes: np.ndarray) -> np.ndarray:
        out = len(self.codes) + (codes & self.mask).astype(np.int64)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = self.codes[at] == codes
            out[hit] = at[hit]
        return out

    def of(self, codes: np.ndarray) -> np.ndarray:
        return self.scores[self.entries(codes)]

    def without(self, codes: np.ndarray, toxic: int) -> np.ndarray:
        """Scores of a training text's words under the counts of all other texts."""
        entry, place, n = np.unique(self.entries(codes), return_inverse=True, return_counts=True)
        counts = self.counts[:, entry].copy()
        counts[toxic] -= n
        return self._score(counts)[place]


def log_odds(counts: DataFrame, prior: float, cost: float, own: int, shared_bits: int) -> LogOdds:
    """The scores from the counts (code, clean, toxic) of all labelled words."""
    totals = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    n_c, n_t = float(totals[0] or 0), float(totals[1] or 0)
    if not n_c or not n_t:
        return LogOdds(np.empty(0, np.uint64), np.zeros((2, 1 << shared_bits)), shared_bits, (n_c, n_t), prior, cost)
    y_c, y_t = (F.col(c) + F.lit(prior * n / (n_c + n_t)) for c, n in (("clean", n_c), ("toxic", n_t)))
    odds = F.log(y_t / n_t) - F.log(y_c / n_c)
    top = materialize(counts.orderBy(F.desc(F.abs(odds) * (F.col("clean") + F.col("toxic"))), "code").limit(own))
    rest = counts.join(top.select("code").hint("merge"), "code", "left_anti")
    place = F.col("code").bitwiseAND((1 << shared_bits) - 1).alias("place")
    rest = rest.groupBy(place).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    top = top.toArrow()
    codes = top.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    table = np.zeros((2, len(codes) + (1 << shared_bits)))
    for row, name in enumerate(("clean", "toxic")):
        table[row, : len(codes)] = top.column(name).to_numpy()[order]
        table[row, len(codes) + rest.column("place").to_numpy()] = rest.column(name).to_numpy()
    return LogOdds(codes[order], table, shared_bits, (n_c, n_t), prior, cost)


def _decay(p: np.ndarray, s: np.ndarray) -> float:
    """L > 0 with sum p exp(L s) = 1, by bisection (1 if no score is positive)."""
    if not (s > 0).any():
        return 1.0
    lo, hi = 0.0, 1.0
    total = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum())
    while total(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 1 else (lo, mid)
    return max(hi, 1e-3)


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of token scores as (start, end, score), in one linear pass.

    Neighbouring positive tokens always belong together, so they enter as one. Open segments are
    kept on a stack with the running sum before and after each; a new one is joined with the
    nearest open one that starts lower as long as that raises the joined score.
    """
    edge = np.flatnonzero(np.diff(np.concatenate(([False], s > 0, [False]))))
    total = np.concatenate(([0.0], np.cumsum(s)))
    sums = total[edge].tolist()
    edge = edge.tolist()
    open_: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, index of the nearest lower one
    for start, end, before, after in zip(edge[::2], edge[1::2], sums[::2], sums[1::2], strict=True):
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= before:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= after:
                open_.append((start, end, before, after, j))
                break
            start, before = open_[j][0], open_[j][2]
            del open_[j:]
    return [(a, b, after - before) for a, b, before, after, _ in open_]


_FOUND = "segments array<struct<start:bigint,end:bigint,score:double,chance:double>>, evidence double"
_SEGMENT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())])


def _others(odds: LogOdds):
    """Words and segment scores of each training text under the counts of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            n, found = [], []
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                w = words(text.as_py())
                n.append(len(w))
                found.append([x for _, _, x in segments(odds.without(hashes.ids(w), toxic))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "n_words", "scores"])

    return run


def _scan(odds: LogOdds, rate: float):
    """Every text's significant segments and its evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            n, found, evidence = [], [], []
            for text in batch.column("_text"):
                w = words(text.as_py())
                seg = segments(odds.of(hashes.ids(w)))
                x = np.array([v for _, _, v in seg])
                chance = np.maximum(-np.expm1(-rate * len(w) * np.exp(-odds.decay * x)), 1e-300)
                some = np.flatnonzero(chance < SIGNIFICANT)
                n.append(len(w))
                evidence.append(float(-np.log(chance[some]).sum()))
                found.append([{"start": seg[i][0], "end": seg[i][1], "score": seg[i][2], "chance": float(chance[i])} for i in some])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n, pa.int64()), pa.array(found, pa.list_(_SEGMENT)), pa.array(evidence, pa.float64())],
                names=["row", "n_words", "segments", "evidence"])

    return run


def logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope for ``y`` positives among ``n`` rows at each ``x``."""
    a = np.column_stack((np.ones_like(x), x))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - n * p) - ridge * w
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, prior: float = PRIOR, cost: float = COST,
                   own: int = OWN, shared_bits: int = SHARED_BITS) -> DataFrame:
    """``row`` (the input row, or its ``carry`` columns with doc_id among them), n_words,
    segments (the significant ones: start, end, score, chance), evidence, score.

    ``labels``: doc_id and toxic (0 or 1) of the documents to learn from.
    """
    known = materialize(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
                        .agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    labelled = LabelFilter(known)
    texts = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"), id_hash("doc_id").alias("_hash"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    learn = materialize(texts.mapInArrow(_labelled(labelled), f"doc_id {id_type}, text binary").join(known.hint("merge"), "doc_id").select("text", "toxic"))
    counts = learn.mapInArrow(_count, "code long, clean long, toxic long").groupBy("code").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = log_odds(materialize(counts), prior, cost, own, shared_bits)

    seen = materialize(learn.mapInArrow(_others(odds), "toxic int, n_words long, scores array<double>"))
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    k = seen.where("toxic = 0 and n_words > 0").agg(F.count("*"), F.sum(F.col("n_words") * F.exp(-odds.decay * top))).first()
    rate = float(k[0]) / float(k[1]) if k[0] and k[1] else 1.0

    def surprise(s: Column) -> Column:
        c = F.greatest(-F.expm1(-rate * F.col("n_words") * F.exp(-odds.decay * s)), F.lit(1e-300))
        return F.when(c < SIGNIFICANT, -F.log(c)).otherwise(0.0)

    x = F.log1p(F.aggregate("scores", F.lit(0.0), lambda a, s: a + surprise(s)))
    bins = (seen.groupBy(F.round(x / BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("toxic").alias("y"))
            .orderBy("bin").collect())
    n, y = np.array([r["n"] for r in bins], float), np.array([r["y"] for r in bins], float)
    if len(bins) and 0 < y.sum() < n.sum():
        a, b = logistic(np.array([r["bin"] * BIN for r in bins]), n, y)
        score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("evidence"))))
    else:
        score = F.lit(float(y.sum() / n.sum()) if len(bins) else 0.0)

    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row")
    src = docs.select(F.col("text").cast("binary").alias("_text"), row)
    schema = f"row {src.schema['row'].dataType.simpleString()}, n_words long, {_FOUND}"
    found = materialize(src.mapInArrow(_scan(odds, rate), schema))
    return found.select("row", "n_words", "segments", "evidence", score.alias("score"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = score_toxicity(docs, labels.where(crc_mod("doc_id", FOLDS) != HELD_OUT), carry=["doc_id"])
    return got.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(crc_mod("row.doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
