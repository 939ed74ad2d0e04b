"""LM scoring (operator 5) by a log-bilinear neural model trained with
noise-contrastive estimation.

Tokens are words (A-Z lower-cased) and one end per text. A token's unit is
itself for the ``HEAD`` most frequent words and the end; all other words share
``BUCKETS`` units by their last two bytes. The model predicts the next unit
from the ``CONTEXT`` units before it: context vectors, each through the matrix
of its position, are summed and multiplied with all unit vectors at once, and
one softmax over all units normalises the row. A word that shares a unit takes
its part of the unit's probability by add-one smoothed counts, one part being
left for unseen words. So the probabilities of all words sum to one.

Counts cover every token of the training documents and stay in Spark; only the
``FREQUENT`` most frequent tokens (a fixed number), the bucket sums and the
model (a fixed size) are shipped to the tasks. Rarer tokens of a text meet
their counts in a join. Training is local SGD: every partition of the training
documents starts from the same model, learns from every position of each of its
texts, and Spark averages the models by the positions seen, ``ROUNDS`` times.
Its work grows with the corpus.

Defined cases: a null or wordless text is one end; an untrained model (no
training rows) scores by the same formulas with no counts; a null id is never
learned from; repeated rows count and are scored each for itself; extra columns
are ignored (or carried in ``row``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize, with_row

HEAD, BUCKETS = 191, 64
CONTEXT, DIM = 3, 24
FREQUENT = 1 << 17
ROUNDS, BATCH, NOISE = 2, 256, 32
RATE = 0.1
LEARN_TOKENS = 1 << 18  # tokens held at a time while training
FOLDS, HELD_OUT = 7, 2
UNITS = HEAD + 1 + BUCKETS
END_UNIT = HEAD


def code(word: bytes) -> int:
    """58 bits of hash and the bucket of the word in the lowest 6."""
    return (xxhash.xxh3_64_intdigest(word) & ~(BUCKETS - 1)) | (zlib.crc32(word[-2:]) & (BUCKETS - 1))


END = code(b" end")  # no word holds a space


class Codes(dict):
    """word -> code; at most ``limit`` words are remembered."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        c = self[w] = code(w)
        return c

    def of(self, text: bytes | None) -> np.ndarray:
        w = text.lower().split() if text else []
        out = np.empty(len(w) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, w), np.uint64, len(w))
        out[-1] = END
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = Codes()
    for batch in batches:
        parts = [codes.of(t.as_py()) for t in batch.column("text")]
        if parts:
            c, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])


class Vocabulary:
    """The frequent tokens with counts, the units and what is left of each bucket."""

    def __init__(self, frequent: list[tuple[int, int]], bucket_sums: dict[int, int], tokens: int, types: int):
        by = sorted(frequent)
        self.codes = np.array([c for c, _ in by], np.int64).view(np.uint64)
        order = np.argsort(self.codes)
        self.codes, self.counts = self.codes[order], np.array([n for _, n in by], np.int64)[order]
        self.tokens, self.types = tokens, types
        head = [(c, n) for c, n in sorted(frequent, key=lambda x: (-x[1], x[0])) if c % (1 << 64) != END][:HEAD]
        self.units = np.full(len(self.codes), -1, np.int64)
        unit_n = np.zeros(UNITS)
        left = np.zeros(BUCKETS)
        for b, s in bucket_sums.items():
            left[b] = s
        unit_n[END_UNIT] = self.count_of(np.array([END], np.uint64))[0][0]
        left[END % BUCKETS] -= unit_n[END_UNIT] + (unit_n[END_UNIT] > 0)
        if unit_n[END_UNIT]:
            self.units[np.searchsorted(self.codes, np.uint64(END))] = END_UNIT
        for u, (c, n) in enumerate(head):
            c = c % (1 << 64)
            self.units[np.searchsorted(self.codes, np.uint64(c))] = u
            unit_n[u] = n
            left[c % BUCKETS] -= n + 1
        self.left = left + 1  # one part for unseen words
        unit_n[HEAD + 1 :] = np.maximum(left, 0)
        self.unigram = (unit_n + 1) / (unit_n.sum() + UNITS)

    def count_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the frequent tokens (0 else) and their places in the table (-1 else)."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        return np.where(hit, self.counts[at], 0), np.where(hit, at, -1)

    def unit_of(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, self.units[at], -1) if len(self.units) else np.full(len(codes), -1)
        unit = np.where(own >= 0, own, HEAD + 1 + (codes % np.uint64(BUCKETS)).astype(np.int64))
        return np.where(codes == np.uint64(END), END_UNIT, unit)


class Words(dict):
    """word -> its row in ``code``, ``count``, ``at`` and ``unit``, looked up in the vocabulary once;
    about ``limit`` words are remembered."""

    def __init__(self, vocab: Vocabulary, limit: int = 400_000):
        super().__init__()
        self.vocab, self.limit = vocab, limit
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[int] = []
        self.code = np.empty(1 << 10, np.uint64)
        self.count, self.at, self.unit = (np.empty(1 << 10, np.int64) for _ in range(3))
        self[b" end"]  # row 0; no word holds a space

    def __missing__(self, w: bytes) -> int:
        at = self[w] = len(self)
        self.new.append(code(w))
        return at

    def of(self, text: bytes | None) -> np.ndarray:
        """Rows of the text's words and the end; they hold until the next call."""
        if len(self) > self.limit:
            self.forget()
        w = text.lower().split() if text else []
        out = np.zeros(len(w) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, w), np.int64, len(w))
        if self.new:
            while len(self.code) < len(self):
                self.code, self.count, self.at, self.unit = (np.concatenate((a, a)) for a in (self.code, self.count, self.at, self.unit))
            rows, codes = slice(len(self) - len(self.new), len(self)), np.array(self.new, np.uint64)
            n, at = self.vocab.count_of(codes)
            self.code[rows], self.count[rows], self.at[rows], self.unit[rows] = codes, n, at, self.vocab.unit_of(codes, at)
            self.new = []
        return out


class Model:
    """Context vectors, a matrix per context place, unit vectors and biases."""

    def __init__(self, unigram: np.ndarray, flat: np.ndarray | None = None):
        rng = np.random.default_rng(7)
        self.shapes = [(UNITS, DIM), (CONTEXT, DIM, DIM), (UNITS, DIM), (UNITS,)]
        if flat is None:
            self.parts = [rng.normal(0, 0.1, (UNITS, DIM)), np.stack([np.eye(DIM) / (1 + i) for i in range(CONTEXT)]),
                          rng.normal(0, 0.1, (UNITS, DIM)) * 0.1, np.log(unigram)]
        else:
            cut = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
            self.parts = [p.reshape(s) for p, s in zip(np.split(flat, cut), self.shapes, strict=True)]
        self.parts = [p.astype(np.float32) for p in self.parts]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def log_probs(self, context: np.ndarray, target: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Natural-log probability of each target unit, normalised over all units."""
        r, c, t, b = self.parts
        table = np.stack([r @ c[i] for i in range(CONTEXT)])
        up, ones = np.ascontiguousarray(np.concatenate((t, b[:, None]), axis=1).T), np.ones(UNITS, np.float32)
        # no score is larger than this: up to 80, exp() and its sums stay in range without a shift
        bound = sum(np.sqrt((table[j] ** 2).sum(axis=1)).max() for j in range(CONTEXT)) * np.sqrt((t**2).sum(axis=1)).max() + np.abs(b).max()
        out = np.empty(len(target), np.float64)
        q = np.ones((rows, DIM + 1), np.float32)
        for i in range(0, len(target), rows):
            ctx, y = context[i : i + rows], target[i : i + rows]
            q[: len(y), :DIM] = table[0].take(ctx[:, 0], axis=0)
            for j in range(1, CONTEXT):
                q[: len(y), :DIM] += table[j].take(ctx[:, j], axis=0)
            s = q[: len(y)] @ up
            if not bound < 80:
                s -= s.max(axis=1, keepdims=True)  # each row's sum is at least 1
            picked = s[np.arange(len(y)), y]
            np.exp(s, out=s)
            out[i : i + rows] = picked - np.log(s @ ones)
        return out


class Trainer:
    """Noise-contrastive estimation with per-parameter step sizes."""

    def __init__(self, model: Model, unigram: np.ndarray, rate: float, seed: int):
        self.model, self.noise, self.rate = model, unigram, rate
        self.log_noise = np.log(unigram * NOISE).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.cdf = np.cumsum(unigram)
        # parameters, gradients and squares lie in one array each, so that a step updates all at once
        self.values, model.parts = _joined(model.parts)
        self.grad, self.slopes = _joined([np.zeros_like(p) for p in model.parts])
        self.squares = np.full_like(self.values, 0.1)
        self.cells = np.arange(UNITS * CONTEXT * DIM).reshape(-1, DIM)  # of sums by unit, context place and dimension

    def step(self, ctx: np.ndarray, y: np.ndarray) -> None:
        r, c, t, b = self.model.parts
        dr, dc, dt, db = self.slopes
        n = len(y)
        side = c.transpose(1, 0, 2).reshape(DIM, CONTEXT * DIM)  # the matrices beside each other
        place = ctx * CONTEXT + np.arange(CONTEXT)
        moved = (r @ side).reshape(-1, DIM)
        q = moved.take(place[:, 0], axis=0)
        for j in range(1, CONTEXT):
            q += moved.take(place[:, j], axis=0)
        z = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), UNITS - 1)
        own, other = t.take(y, axis=0), t.take(z, axis=0)
        bias = b - self.log_noise
        true = 1 / (n * (1 + np.exp(np.clip(np.einsum("ij,ij->i", q, own) + bias[y], -30, 30))))  # 1 - sigmoid
        fake = q @ other.T
        fake += bias[z]
        np.minimum(np.maximum(fake, -30, out=fake), 30, out=fake)
        np.exp(np.negative(fake, out=fake), out=fake)
        fake += 1
        np.divide(np.float32(-1 / n), fake, out=fake)
        own *= true[:, None]
        own += fake @ other  # the slopes of the rows' contexts
        each = np.repeat(own, CONTEXT, axis=0)
        sums = np.bincount(self.cells.take(place.ravel(), axis=0).ravel(), each.ravel(), UNITS * CONTEXT * DIM)
        sums = sums.astype(np.float32).reshape(UNITS, CONTEXT * DIM)
        dc[...] = (r.T @ sums).reshape(DIM, CONTEXT, DIM).transpose(1, 0, 2)
        np.matmul(sums, side.T, out=dr)
        # of the targets and the noise
        both = np.concatenate((y, z))
        up = np.concatenate((q * true[:, None], fake.T @ q))
        dt.ravel()[...] = np.bincount(self.cells.take(both, axis=0).ravel(), up.ravel(), UNITS * DIM)
        db[...] = np.bincount(both, np.concatenate((true, fake.sum(axis=0))), UNITS)
        g = self.grad
        g *= np.float32(n)
        self.squares += g * g / np.float32(n)
        g /= np.sqrt(self.squares * np.float32(n))
        g *= np.float32(self.rate)
        self.values += g


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All ``parts`` in one array, and each as a view of it."""
    whole = np.concatenate([p.ravel() for p in parts])
    cut = np.cumsum([p.size for p in parts])[:-1]
    return whole, [v.reshape(p.shape) for v, p in zip(np.split(whole, cut), parts, strict=True)]


def windows(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (nearest first; the end unit before a text's start) and targets of all texts, one after another."""
    pad = np.full(CONTEXT, END_UNIT, np.int64)
    ctx = [np.lib.stride_tricks.sliding_window_view(np.concatenate((pad, u[:-1])), CONTEXT)[:, ::-1] for u in units]
    return np.concatenate(ctx), np.concatenate(units)


def _train(vocab: Vocabulary, flat: np.ndarray, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, trainer = Words(vocab), 0, None
        units, size = [], 0

        def learn() -> int:
            ctx, y = windows(units)
            at = trainer.rng.permutation(len(y))
            for i in range(0, len(at), BATCH):
                trainer.step(ctx[at[i : i + BATCH]], y[at[i : i + BATCH]])
            return len(at)

        for batch in batches:
            for text in batch.column("text"):
                w = words.of(text.as_py())
                if trainer is None:  # noise as the first text of the partition says: same rows, same model
                    trainer = Trainer(Model(vocab.unigram, flat), vocab.unigram, rate, int(words.code[w[0]] % np.uint64(1 << 32)))
                units.append(words.unit[w])
                size += len(w)
                if size >= LEARN_TOKENS:
                    seen += learn()
                    units, size = [], 0
        if units:
            seen += learn()
        if seen:
            v = trainer.model.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v * seen), pa.array(np.full(len(v), float(seen)))],
                names=["i", "v", "w"])

    return run


def _score(vocab: Vocabulary, flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(vocab), Model(vocab.unigram, flat)
        log_left = np.log10(vocab.left)
        for batch in batches:
            rows, size, out = 0, 0, []

            def flush(docs):
                ctx, y = windows([d[2] for d in docs])
                lp = model.log_probs(ctx, y) / np.log(10)
                ends = np.cumsum([len(d[0]) for d in docs])
                for (c, at, u, n), b in zip(docs, ends.tolist(), strict=True):
                    shares = u > END_UNIT  # words that share a unit
                    rare = c[at < 0]
                    known = at >= 0
                    by, tf = np.unique(rare[rare != np.uint64(END)], return_counts=True)
                    logs = np.log10(n[known] + 1.0)
                    part = lp[b - len(c) : b].sum() + logs[shares[known]].sum() - log_left[(u - HEAD - 1)[shares]].sum()
                    out.append((len(c), int(known.sum()), float(logs.sum()), float(part), by.view(np.int64), tf))

            docs = []
            for text in batch.column("_text"):
                w = words.of(text.as_py())
                docs.append((words.code[w], words.at[w], words.unit[w], words.count[w]))
                rows, size = rows + 1, size + len(w)
                if size > 1 << 20:
                    flush(docs)
                    docs, size = [], 0
            if docs:
                flush(docs)
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                 pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int64()))],
                names=["row", "n_tokens", "n_frequent", "logs", "model", "rare", "times"])

    return run


def fit(train: DataFrame, frequent: int = FREQUENT) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """Counts of all tokens (a table), the vocabulary and the trained model."""
    texts = train.select(F.col("text").cast("binary").alias("text"))
    counts = materialize(texts.mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n"), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "code").limit(frequent).collect()
    end = np.uint64(END).astype(np.int64).item()
    if all(r["code"] != end for r in top):  # every text has one: it is counted from the shipped counts
        top += counts.where(F.col("code") == F.lit(end)).collect()
    sums = counts.groupBy(F.col("code").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).agg(F.sum(F.col("n") + 1).alias("s")).collect()
    vocab = Vocabulary([(r["code"], r["n"]) for r in top], {r["b"]: r["s"] for r in sums}, int(total[0] or 0), int(total[1]))
    flat = Model(vocab.unigram).flat()
    for k in range(ROUNDS):
        means = texts.mapInArrow(_train(vocab, flat, RATE / (1 + k)), "i int, v double, w double").groupBy("i").agg(
            (F.sum("v") / F.sum("w")).alias("v")).collect()
        if means:
            flat = np.array([r["v"] for r in sorted(means, key=lambda r: r["i"])])
    return counts, vocab, flat


def score_texts(docs: DataFrame, train: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``row`` (the input row), n_tokens, n_known, train_tokens, base_score, score (log10)."""
    counts, vocab, flat = fit(train, frequent)
    src = with_row(docs, F.col("text").cast("binary").alias("_text"))
    schema = (f"row {src.schema['row'].dataType.simpleString()}, n_tokens long, n_frequent long, logs double, model double, "
              "rare array<bigint>, times array<bigint>")  # fmt: skip
    scored = materialize(src.mapInArrow(_score(vocab, flat), schema).withColumn("id", F.monotonically_increasing_id()))
    rare = scored.select("id", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("id", F.col("t.rare").alias("code"), F.col("t.times").alias("times"))
    met = (rare.join(counts, "code").groupBy("id")
           .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs")))
    known = F.col("n_frequent") + F.coalesce("more_known", F.lit(0))
    more = F.coalesce("more_logs", F.lit(0.0))
    base = F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(vocab.tokens + vocab.types + 1)))
    return scored.join(met, "id", "left").select(
        "row", "n_tokens", known.cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("model") + more).alias("score"))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(crc_mod("row.doc_id", FOLDS) == HELD_OUT, F.lit(False))
    got = score_texts(docs, docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT))
    return got.select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
