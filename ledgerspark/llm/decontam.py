"""Benchmark decontamination (operator 10) by an FM-index per training shard.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A
phrase is a run of ``window`` consecutive words of one benchmark item; an item
with fewer words, but not none, is one phrase. The documents of a partition
are read in shards of bounded size. Of a shard only runs of words that occur
in the benchmark are indexed: no phrase can cover any other word. The run text
gets a suffix array, its Burrows-Wheeler transform a wavelet matrix, and all
phrases are searched backwards together; matches are located by walking to
the next sampled suffix position. Found places become word spans per document.

No shuffle and no state across documents: a lost task is simply run again.
Each pass ships one part of the benchmark of about ``PART_BYTES`` of text to
the tasks; a larger benchmark makes more parts, one pass each.

Defined cases: null or wordless texts have n_words 0 and are never
contaminated; null benchmark texts are no items; an empty benchmark hits
nothing; repeated rows are judged each for itself; items with null id get the
name ``null``; extra columns are ignored (or carried in ``row``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replace_text, with_row

WINDOW = 13
SHARD_WORDS = 1 << 19
PART_BYTES = 4 << 20
SAMPLE = 8
CONTAMINATED = 20  # contaminated when CONTAMINATED * n_hit >= n_words

_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


def phrases(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Each distinct phrase with the ids of its items."""
    out: dict[tuple[bytes, ...], list[str]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            ids = out.setdefault(tuple(w[i : i + window]), [])
            if item not in ids:
                ids.append(item)
    return out


class FMIndex:
    """Backward search and location over one sequence of words ids >= 1, 0 between runs."""

    def __init__(self, seq: np.ndarray, symbols: int):
        n = len(seq)
        gaps = seq == 0
        # gaps are told apart for sorting only, so that no common prefix crosses one
        order = np.where(gaps, np.cumsum(gaps) - 1, seq.astype(np.int64) + int(gaps.sum()))
        self.sa = _suffix_array(order)
        bwt = seq[self.sa - 1]
        counts = np.bincount(seq, minlength=symbols + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))[: symbols + 1].astype(np.int64)
        self.bwt = bwt
        self.levels: list[tuple[int, np.ndarray, int]] = []
        cur = bwt
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            b = (cur >> bit) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            zeros = n - int(ones[-1])
            self.levels.append((bit, ones, zeros))
            cur = np.concatenate((cur[b == 0], cur[b == 1]))
        # sampled suffixes: every SAMPLE-th place, and each run's first word
        starts = np.zeros(n, bool)
        starts[1:] = gaps[:-1]
        starts[0] = True
        mark = (self.sa % SAMPLE == 0) | starts[self.sa]
        self.mark_rank = np.zeros(n + 1, np.int32)
        np.cumsum(mark, out=self.mark_rank[1:])
        self.samples = self.sa[mark]
        self.mark = mark
        del self.sa

    def rank(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place of the transform."""
        lo, hi = np.zeros_like(i), i.copy()
        for bit, ones, zeros in self.levels:
            one = (sym >> bit) & 1 == 1
            r_lo, r_hi = ones[lo], ones[hi]
            lo = np.where(one, zeros + r_lo, lo - r_lo)
            hi = np.where(one, zeros + r_hi, hi - r_hi)
        return hi - lo

    def search(self, pats: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) rows of the suffixes that start with each phrase (rows of
        ``pats`` are right-aligned)."""
        k, width = pats.shape
        lo, hi = np.zeros(k, np.int64), np.full(k, len(self.bwt), np.int64)
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero((width - j <= lens) & (lo < hi))
            if not len(live):
                continue
            c = pats[live, j]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        at, step, open_ = rows.astype(np.int64), 0, np.arange(len(rows))
        while len(open_):
            hit = self.mark[at]
            out[open_[hit]] = self.samples[self.mark_rank[at[hit]]] + step
            open_, at = open_[~hit], at[~hit]
            c = self.bwt[at].astype(np.int64)
            at = self.first[c] + self.rank(c, at)
            step += 1
        return out


def _suffix_array(order: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks of 1, 2, 4, ... words until all differ."""
    n = len(order)
    rank = np.unique(order, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        sa = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 0
        s = key[sa]
        step[1:] = np.cumsum(s[1:] != s[:-1])
        rank = np.empty(n, np.int64)
        rank[sa] = step
        if step[-1] == n - 1:
            return sa
        k *= 2


class _Vocabulary(dict):
    """word -> id; 0 for any word that the benchmark lacks."""

    def __missing__(self, word: bytes) -> int:
        return 0


class _Finder:
    """Phrases of one part of the benchmark, ready to be searched in shards."""

    def __init__(self, found: dict[tuple[bytes, ...], list[str]]):
        self.vocab = _Vocabulary()
        rows = list(found)
        self.lens = np.array([len(r) for r in rows], np.int64)
        self.width = int(self.lens.max()) if rows else 0
        self.least = int(self.lens.min()) if rows else 1 << 62
        self.pats = np.zeros((len(rows), self.width), np.int64)
        for i, r in enumerate(rows):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in r]
            self.pats[i, self.width - len(ids) :] = ids
        self.items = [found[r] for r in rows]

    def shard(self, docs: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Spans of hit words and item ids of each document (arrays of word ids, 0: unknown word)."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
        seqs, owner, offset = [], [], []
        for d, ids in enumerate(docs):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= self.least:
                    seqs += [ids[a:b], np.zeros(1, ids.dtype)]
                    owner.append(np.full(b - a + 1, d))
                    offset.append(np.arange(a, b + 1))
        if not seqs:
            return out
        seq = np.concatenate(seqs)
        doc, at = np.concatenate(owner), np.concatenate(offset)
        index = FMIndex(seq, len(self.vocab))
        lo, hi = index.search(self.pats, self.lens)
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        place = index.locate(rows)
        d, a = doc[place], at[place]
        b = a + self.lens[which]
        by = np.lexsort((b, a, d))
        for i, s, e, p in zip(d[by].tolist(), a[by].tolist(), b[by].tolist(), which[by].tolist(), strict=True):
            spans, items = out[i]
            items.update(self.items[p])
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((s, e))
        return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FOUND = "n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _merged(spans: list[dict], more: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted([(s["start"], s["end"]) for s in spans] + more):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _hits(items_of_part: list[tuple[str, bytes]], window: int, shard_words: int):
    """One pass over the documents against one part of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(phrases(items_of_part, window))
        get = finder.vocab.__getitem__
        for batch in batches:
            n_words, found, shard, size = [], [], [], 0
            for t in batch.column("_text"):
                w = words(t.as_py())
                n_words.append(len(w))
                shard.append(np.fromiter(map(get, w), np.int32, len(w)))
                size += len(w)
                if size >= shard_words:
                    found += finder.shard(shard)
                    shard, size = [], 0
            found += finder.shard(shard)
            spans = [_merged(s, f[0]) for s, f in zip(batch.column("spans").to_pylist(), found, strict=True)]
            items = [sorted({*i, *f[1]}) for i, f in zip(batch.column("items").to_pylist(), found, strict=True)]
            cols = [batch.column("_text"), batch.column("row"), pa.array(n_words, pa.int64()),
                    pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["_text", "row", "n_words", "spans", "items"])

    return run


def _parts(benchmark: DataFrame, part_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The benchmark in parts of about ``part_bytes`` of text; one part unless it is large."""
    b = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")
    ).where("text is not null")
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // part_bytes))
    for i in range(n):
        yield [(r["item"], bytes(r["text"])) for r in b.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
                       part_bytes: int = PART_BYTES) -> DataFrame:
    """``row`` (the input row), n_words, n_hit, spans of hit words, items, contaminated."""
    out = with_row(docs, F.col("text").cast("binary").alias("_text")).selectExpr(
        "_text", "row", "0L as n_words", "cast(array() as array<struct<start:bigint,end:bigint>>) as spans",
        "cast(array() as array<string>) as items")
    schema = f"_text binary, row {out.schema['row'].dataType.simpleString()}, {_FOUND}"
    for part in _parts(benchmark, part_bytes):
        out = out.mapInArrow(_hits(part, window, shard_words), schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "row", "n_words", n_hit.alias("n_hit"), "spans", "items",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (CONTAMINATED * F.col("n_hit") >= F.col("n_words")))


def cut_spans(text: str, spans) -> str:
    """``text`` without the words of each span (and what lies between them)."""
    raw = text.encode()
    soft = np.frombuffer(raw.translate(_KEEP), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], soft.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for s in spans:
        a, b = (s["start"], s["end"])
        out.append(raw[at : max(at, starts[a])])
        at = max(at, int(ends[b - 1]))
    out.append(raw[at:])
    return b"".join(out).decode()


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without the contaminated ones; hit passages of the others are
    cut out (``n_chars``, if there, follows). A text that is not hit stays as
    it is, byte for byte.
    """
    hit = find_contamination(docs, benchmark).where(~F.col("contaminated"))
    cut = F.udf(lambda t, s: None if t is None else cut_spans(t, s), "string", useArrow=True)
    hit = hit.withColumn("cut", cut(F.when(F.size("spans") > 0, F.col("row.text")), F.col("spans")))
    return replace_text(hit, docs.columns, F.col("cut"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hits = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def brute_force(docs, items, window: int = WINDOW) -> dict:
    """Direct search, for tests: doc_id -> (n_words, n_hit, n_items, sha256, contaminated)."""
    pats = phrases([(str(i), t.encode()) for i, t in items if t is not None], window)
    out = {}
    for doc_id, text in docs:
        w = words(text.encode() if text else None)
        hit, ids = set(), set()
        for p, own in pats.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a : a + len(p)]) == p:
                    hit.update(range(a, a + len(p)))
                    ids.update(own)
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out[doc_id] = (len(w), len(hit), len(ids), sha, bool(hit) and CONTAMINATED * len(hit) >= len(w))
    return out
