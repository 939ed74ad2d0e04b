"""Quality classifier (operator 8): a weak-label model of overlapping heuristic
labellers, and a hashed linear scorer trained on its posterior labels.

Texts are parsed once, into a written table of votes and hashed features; all later
steps read that. Each labeller votes good, bad or abstains on a whole text (``LABELLERS``).
Spark counts the documents of each pattern of votes; there are at most
3 ** len(LABELLERS) patterns, so this table is bounded at any size.
Expectation-maximisation on it estimates the share of good texts and each
labeller's chance of each vote on good and on bad texts, and gives every
pattern its posterior. The scorer is a logistic model over ``1 << FEATURE_BITS``
hashed counts (words, and word shapes such as ``Aa.``), trained on the
posteriors of all documents: every partition starts from the same weights,
takes one pass of small steps, and Spark averages the weights by documents.
No label of any table is read.

Defined cases: null or wordless text: every labeller but ``length`` abstains, no
features, so its score is the scorer's intercept; an empty table gives no rows;
repeated rows count and are scored each for itself; extra columns are ignored
(or carried in ``row``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

GOOD, BAD, NONE = "1", "0", "-"
FEATURE_BITS = 14  # feature numbers are written as 16-bit integers
MASK = (1 << FEATURE_BITS) - 1
STEPS, BATCH, RATE = 2, 32, 0.5
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-?!()")
_ENDS = b".!?\"')"


def _share(bad_from: float, good_to: float, x: float) -> str:
    return BAD if x >= bad_from else GOOD if x <= good_to else NONE


def votes(text: bytes | None, words: list[bytes] | None = None) -> str:
    """One character per labeller, in the order of ``LABELLERS``."""
    raw = text or b""
    w = raw.split() if words is None else words
    n = len(w)
    if not n:
        return NONE * (len(LABELLERS) - 1) + BAD
    upper = sum(map(raw.count, _UPPER))
    letters = upper + len(raw) - len(raw.translate(None, _LOWER))
    lines = [x for x in raw.split(b"\n") if x]
    seen = Counter(w)
    kinds = math.log(len(seen)) / math.log(n) if n > 1 and len(seen) > 1 else 0.0
    return "".join((
        _share(0.05, 0.01, 1 - len(raw.translate(None, _SYMBOLS)) / len(raw)),
        _share(0.10, 0.0, seen[b"|"] / n),
        _share(0.30, 0.10, upper / letters) if letters else BAD,
        NONE if n < 10 else _share(-0.88, -0.92, -kinds),
        NONE if n < 20 else _share(0.20, 0.12, max(seen.values()) / n),
        GOOD if raw.rstrip()[-1:] in {_ENDS[i : i + 1] for i in range(len(_ENDS))} else BAD,
        NONE if len(lines) < 4 else _share(0.30, 0.05, 1 - len(set(lines)) / len(lines)),
        BAD if n < 4 else NONE,
    ))


LABELLERS = ("symbols", "bars", "capitals", "kinds of words", "commonest word", "ending", "repeated lines", "length")
_UPPER = [bytes([b]) for b in range(65, 91)]
_LOWER = bytes(range(97, 123))
_REPEATS = re.compile(rb"(.)\1+", re.DOTALL)
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


class Features(dict):
    """word -> its own feature number and, ``FEATURE_BITS`` higher, its shape's."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit
        self.shapes: dict[bytes, int] = {}

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = self[w] = (xxhash.xxh3_64_intdigest(w) & MASK) | self.shape(w.translate(_SHAPE)) << FEATURE_BITS
        return out

    def shape(self, s: bytes) -> int:
        """Feature of a word's kinds of characters, repeats counted once."""
        got = self.shapes.get(s)
        if got is None:
            if len(self.shapes) >= self.limit:
                self.shapes.clear()
            got = self.shapes[s] = xxhash.xxh3_64_intdigest(b" " + _REPEATS.sub(rb"\1", s)) & MASK
        return got

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted features of a text's words, with their counts."""
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.unique(np.concatenate((both & MASK, both >> FEATURE_BITS)), return_counts=True)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        vote, ids, n = [], [], []
        for text in batch.column("_text"):
            raw = text.as_py() or b""
            w = raw.split()
            vote.append(votes(raw, w))
            i, k = features.of(w)
            ids.append(i.astype(np.int16))
            n.append(k.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(vote, pa.string()), pa.array(ids, pa.list_(pa.int16())), pa.array(n, pa.list_(pa.int32()))],
            names=["row", "votes", "ids", "n"])


def parsed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input row, or its ``carry`` columns), votes, ids and n (features and their counts), written once."""
    src = docs.select(F.col("text").cast("binary").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"))
    row = src.schema["row"].dataType.simpleString()
    return materialize(src.mapInArrow(_parse, f"row {row}, votes string, ids array<smallint>, n array<int>"))


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and values (counts by the square root of the sum of squares) of all texts of a
    batch one after another, and where each text starts."""
    ids = batch.column("ids").flatten().to_numpy().astype(np.int64)
    n = batch.column("n").flatten().to_numpy().astype(np.float64)
    size = batch.column("n").value_lengths().to_numpy()
    doc = np.repeat(np.arange(len(size)), size)
    norm = np.sqrt(np.bincount(doc, n * n, len(size)))
    return ids, n / norm[doc], np.concatenate(([0], np.cumsum(size)))


def weak_labels(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], float, np.ndarray]:
    """Posterior of each pattern, share of good texts, and chances [class, labeller, vote].

    Starts from the majority of the votes; each count has one pseudo-count.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, 0.5, np.empty((2, 0, 3))
    n = np.array([patterns[k] for k in keys], np.float64)
    v = np.array([["01-".index(c) for c in k] for k in keys])
    good, bad = (v == 1).sum(axis=1), (v == 0).sum(axis=1)
    p = (good + 1) / (good + bad + 2)
    for _ in range(rounds):
        share = float((n * p).sum() + 1) / float(n.sum() + 2)
        chance = np.empty((2, v.shape[1], 3))
        for y, w in ((1, n * p), (0, n * (1 - p))):
            for vote in range(3):
                chance[y, :, vote] = ((v == vote) * w[:, None]).sum(axis=0) + 1
        chance /= chance.sum(axis=2, keepdims=True)
        logs = np.log(chance)
        each = np.arange(v.shape[1])
        odds = math.log(share / (1 - share)) + (logs[1][each, v] - logs[0][each, v]).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return dict(zip(keys, p.tolist(), strict=True)), share, chance


def _train(posterior: dict[str, float], weights: np.ndarray, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, squares, seen = weights.copy(), np.full(len(weights), 1e-2), 0
        for batch in batches:
            ids, values, at = _vectors(batch)
            wanted = np.array([posterior[v] for v in batch.column("votes").to_pylist()])
            for i in range(0, len(wanted), BATCH):
                y = wanted[i : i + BATCH]
                lo, hi = at[i], at[i + len(y)]
                f, x = ids[lo:hi], values[lo:hi]
                doc = np.repeat(np.arange(len(y)), np.diff(at[i : i + len(y) + 1]))
                s = np.bincount(doc, w[f] * x, len(y)) + w[-1]
                err = y - 1 / (1 + np.exp(-np.clip(s, -30, 30)))
                g = np.bincount(f, err[doc] * x, len(w))
                g[-1] = err.sum()
                squares += g * g
                w += rate * g / np.sqrt(squares)
            seen += len(wanted)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w * seen), pa.array(np.full(len(w), float(seen)))], names=["i", "v", "n"])

    return run


def _score(posterior: dict[str, float], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, at = _vectors(batch)
            n = batch.num_rows
            s = np.bincount(np.repeat(np.arange(n), np.diff(at)), weights[ids] * values, n) + weights[-1]
            weak = [posterior[v] for v in batch.column("votes").to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("votes"), pa.array(weak, pa.float64()), pa.array(score)],
                names=["row", "votes", "weak_label", "score"])

    return run


def fit_quality(train: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Posteriors of the vote patterns, and the scorer's weights (the last: the intercept), of ``parsed`` texts."""
    counted = train.groupBy("votes").agg(F.count("*").alias("n")).collect()
    posterior, _, _ = weak_labels({r["votes"]: r["n"] for r in counted})
    weights = np.zeros((1 << FEATURE_BITS) + 1)
    for k in range(STEPS):
        mean = train.select("votes", "ids", "n").mapInArrow(_train(posterior, weights, RATE / (1 + k)), "i int, v double, n double").groupBy("i").agg(
            (F.sum("v") / F.sum("n")).alias("v")).collect()
        for r in mean:
            weights[r["i"]] = r["v"]
    return posterior, weights


def score_quality(docs: DataFrame, train: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input row, or its ``carry`` columns), votes, weak_label, score (0 to 1, higher: better)."""
    texts = parsed(docs, carry)
    posterior, weights = fit_quality(texts if train is None else parsed(train.select("text", F.lit(0).alias("_one")), ["_one"]))
    if train is not None:  # patterns that the training rows lack
        posterior = _Default(posterior)
    schema = f"row {texts.schema['row'].dataType.simpleString()}, votes string, weak_label double, score double"
    return texts.mapInArrow(_score(posterior, weights), schema)


class _Default(dict):
    """Posterior of a pattern never seen in training: the share of good votes, smoothed."""

    def __missing__(self, key: str) -> float:
        return (key.count(GOOD) + 1) / (key.count(GOOD) + key.count(BAD) + 2)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document with its votes, posterior label, score and verdict (kept: score >= 0.5)."""
    got = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), carry=["doc_id"])
    return got.select(F.col("row.doc_id").alias("doc_id"), "votes", "weak_label", "score", (F.col("score") >= 0.5).alias("kept"))
