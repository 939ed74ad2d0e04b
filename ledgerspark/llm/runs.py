"""Periodic runs of words (operator 12) by grammar compression.

A run is a stretch with smallest period q (words q apart are identical) and at least
``max(MIN_WORDS, 2 q)`` words that cannot be extended. Texts are handled in chunks
inside an Arrow pass, each text with a grammar of its own:

* Re-Pair: adjacent pairs are counted per text, and repeated ones replaced by a new
  symbol, frequent pairs first. One round replaces, all over the chunk, every pair that no
  more frequent pair overlaps, until no pair of a text repeats. What is left of a text
  is paired up to a balanced tree, so every symbol but the words is a pair.
* Every run is crossed by the boundary of the lowest symbol that holds all of it.
  So for every symbol, once, at its first place, the runs across its boundary are
  computed: the words on either side of the boundary recur one period away, which
  names the periods to try, and common extensions to both sides (prefix hashes and
  bisection) give the stretch.
* The stretches are translated to all places of the symbol in the derivation.
  Those that can be extended there are part of a run that a higher symbol found;
  the maximal ones are merged, equal stretches under their smallest period.

Every run is confirmed word by word; if a hash collision ever made one wrong, the
chunk is computed again with other hashes. Memory is in proportion to a chunk
(``CHUNK`` words, or one text that is longer).

Defined cases: null and empty texts have no words and no run; a null doc_id leaves
its text unchanged; rows that share a doc_id are judged each for itself; other
columns are ignored, or carried in ``row`` by ``periodic_runs``; an empty table gives
no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_row

MIN_WORDS = 12
CHUNK, CHUNK_TEXTS = 1 << 19, 1 << 14
ANCHOR = 3  # words beside a boundary whose other places name the periods
EXPAND = 1 << 21  # candidate periods tried at a time


def factorize(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key in order of appearance, how often each number occurs)."""
    codes = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)
    return codes, np.bincount(codes)


class Grammar:
    """Pairs of a chunk. Symbols below ``words`` are words, symbol ``words + i`` is pair i:
    ``left``, ``right``, its words, those of its left part and its first place."""

    def __init__(self, w: np.ndarray, doc: np.ndarray, words: int):
        self.words = words
        self.n = words  # symbols so far
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.levels: list[tuple[int, int]] = []  # pairs of one round: none is part of another
        sym, pos, ln = w.astype(np.int64), np.arange(len(w)), np.ones(len(w), np.int64)
        sym, pos, ln, doc = self._repair(sym, pos, ln, doc.astype(np.int64))
        order = np.argsort(pos)
        self._balance(sym[order], pos[order], ln[order], doc[order])
        self.left, self.right, self.first, self.left_words, self.size = (
            np.concatenate([p[i] for p in self.parts]) if self.parts else np.empty(0, np.int64) for i in range(5))

    def _add(self, sym, pos, ln, at) -> np.ndarray:
        """New symbols for the pairs that begin at ``at``."""
        new = self.n + np.arange(len(at))
        self.parts.append((sym[at], sym[at + 1], pos[at], ln[at], ln[at] + ln[at + 1]))
        self.levels.append((self.n - self.words, self.n - self.words + len(at)))
        self.n += len(at)
        return new

    def _repair(self, sym, pos, ln, doc):
        done = []
        rng = np.random.default_rng(0)
        live = np.append(doc[:-1] == doc[1:], False)  # the pair that begins here may be one of several
        while True:
            i = np.flatnonzero(live)
            base = np.uint64(self.n)
            key = (doc[i].astype(np.uint64) * base + sym[i].astype(np.uint64)) * base + sym[i + 1].astype(np.uint64)
            code, count = factorize(key)
            several = count[code] >= 2
            live[i[~several]] = False
            i, code = i[several], code[several]
            if not len(i):
                break
            rank = count[code] * len(count) + rng.permutation(len(count))[code]  # frequent pairs first
            around = np.full(len(sym) + 2, -1, np.int64)
            around[i + 1] = rank
            best = (rank >= around[i]) & (rank >= around[i + 2])
            i, code = i[best], code[best]  # neighbours among these are the same pair: every other one
            begins = np.diff(i, prepend=-2) != 1
            odd = (np.arange(len(i)) - np.maximum.accumulate(np.where(begins, np.arange(len(i)), 0))) & 1
            i, code = i[odd == 0], code[odd == 0]
            at = np.full(len(count), -1, np.int64)
            at[code[::-1]] = i[::-1]  # first place of each pair
            used = np.flatnonzero(at >= 0)
            number = np.empty(len(count), np.int64)
            number[used] = self._add(sym, pos, ln, at[used])
            ln[i] += ln[i + 1]
            sym[i] = number[code]
            live[i] = True
            live[np.maximum(i - 1, 0)] = True
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            sym, pos, ln, doc, live = sym[keep], pos[keep], ln[keep], doc[keep], live[keep]
            live &= np.append(doc[:-1] == doc[1:], False)
            busy = np.zeros(int(doc[-1]) + 1, bool)
            busy[doc[live]] = True
            busy = busy[doc]
            if not busy.all():  # these texts have no repeated pair left
                done.append((sym[~busy], pos[~busy], ln[~busy], doc[~busy]))
                sym, pos, ln, doc, live = sym[busy], pos[busy], ln[busy], doc[busy], live[busy]
                if not len(sym):
                    break
        done.append((sym, pos, ln, doc))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def _balance(self, sym, pos, ln, doc) -> None:
        while True:
            begins = np.append(True, doc[1:] != doc[:-1])
            place = np.arange(len(sym))
            place -= np.maximum.accumulate(np.where(begins, place, 0))
            at = np.flatnonzero((place[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
            if not len(at):
                self.roots, self.root_pos = sym, pos
                return
            sym[at] = self._add(sym, pos, ln, at)
            ln[at] += ln[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, pos, ln, doc = sym[keep], pos[keep], ln[keep], doc[keep]


class Extension:
    """Common extensions of two places of the text, by prefix hashes."""

    def __init__(self, w: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        base = np.full(len(w) + 1, int(rng.integers(1 << 62)) * 2 + 1, np.uint64)
        base[0] = 1
        self.power = np.multiply.accumulate(base)
        value = rng.integers(0, 1 << 63, int(w.max()) + 1).astype(np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[w] * self.power[:-1], dtype=np.uint64)))

    def equal(self, x: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Are the n words from x those from x + q?"""
        h = self.sums
        return (h[x + n] - h[x]) * self.power[q] == h[x + q + n] - h[x + q]

    def longest(self, x: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The most words, up to ``most``, that agree from x on (or, ``back``, before x) with those q later."""
        low, high = np.zeros(len(x), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.equal(x - mid if back else x, mid, q)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def crossing(g: Grammar, w: np.ndarray, doc: np.ndarray, ext: Extension) -> tuple[np.ndarray, ...]:
    """(pair, start in it, end in it, period) of the stretches across every pair's boundary."""
    empty = np.empty(0, np.int64)
    node = np.flatnonzero(g.size >= MIN_WORDS)
    if not len(node):
        return empty, empty, empty, empty
    # places of the word triples that repeat within a text, sorted by (triple, place)
    span = len(w) - ANCHOR + 1
    pair, _ = factorize(w[: span].astype(np.uint64) * np.uint64(g.words) + w[1 : span + 1].astype(np.uint64))
    triple, _ = factorize(pair.astype(np.uint64) * np.uint64(g.words) + w[2 : span + 2].astype(np.uint64))
    triple, count = factorize(triple.astype(np.uint64) * np.uint64(int(doc[-1]) + 1) + doc[:span].astype(np.uint64))
    spots = np.flatnonzero((count[triple] >= 2) & (doc[:span] == doc[ANCHOR - 1 :]))
    spots = spots[np.argsort(triple[spots], kind="stable")]
    sorted_key = triple[spots] * len(w) + spots
    repeated = np.zeros(len(w), bool)
    repeated[spots] = True
    found = []
    for shift in (0, -ANCHOR):
        p, z = g.first[node], g.first[node] + g.size[node]
        a = p + g.left_words[node] + shift
        ok = (a >= p) & (a + ANCHOR <= z)
        ok[ok] = repeated[a[ok]]
        n, p, z, a = node[ok], p[ok], z[ok], a[ok]
        reach = (z - p) // 2  # a period is at most half of the stretch
        lo = np.searchsorted(sorted_key, triple[a] * len(w) + np.maximum(p, a - reach))
        hi = np.searchsorted(sorted_key, triple[a] * len(w) + np.minimum(z - ANCHOR, a + reach), "right")
        many = hi - lo
        some = many > 1  # its own place is one of them
        n, p, z, a, lo, many = n[some], p[some], z[some], a[some], lo[some], many[some]
        part = np.cumsum(many) // EXPAND
        for k in np.unique(part):
            of = np.flatnonzero(part == k)
            r = np.repeat(of, many[of])
            b = spots[np.arange(len(r)) - np.repeat(np.cumsum(many[of]) - many[of], many[of]) + lo[r]]
            r, b = r[b != a[r]], b[b != a[r]]
            found.append(_stretch(n[r], p[r], z[r], p[r] + g.left_words[n[r]], np.minimum(a[r], b), np.abs(a[r] - b), ext))
    n, s, e, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty,) * 4
    order = np.lexsort((q, e, s, n))  # a stretch under its smallest period
    n, s, e, q = n[order], s[order], e[order], q[order]
    new = (np.diff(n, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0) | (np.diff(e, prepend=-1) != 0)
    n, s, e, q = n[new], s[new], e[new], q[new]
    return n, s - g.first[n], e - g.first[n], q


def _stretch(n, p, z, m, x, q, ext: Extension):
    """Stretches [s, e) of period q around x, inside [p, z), long enough and across m."""
    ahead = ext.longest(x, q, z - x - q, False)
    need = np.maximum(q, MIN_WORDS - q) - ahead  # words that must agree before x, too
    ok = need <= x - p
    ok[ok] = ext.equal(x[ok] - np.maximum(need[ok], 0), np.maximum(need[ok], 0), q[ok])
    n, p, m, x, q, ahead = n[ok], p[ok], m[ok], x[ok], q[ok], ahead[ok]
    s = x - ext.longest(x, q, x - p, True)
    e = x + q + ahead
    ok = (s < m) & (m < e)
    return n[ok], s[ok], e[ok], q[ok]


def find_runs(w: np.ndarray, doc: np.ndarray, words: int, seed: int = 1) -> np.ndarray:
    """All runs of a chunk as rows (text, start in the chunk, length, period), sorted.

    ``w``: word numbers below ``words``; ``doc``: number of the text of each word, ascending."""
    none = np.empty((0, 4), np.int64)
    if len(w) < MIN_WORDS:
        return none
    g = Grammar(w, doc, words)
    n, s, e, q = crossing(g, w, doc, Extension(w, seed))
    if not len(n):
        return none
    has = np.zeros(g.n, bool)  # symbols with a stretch in them
    has[g.words + n] = True
    for a, z in g.levels:
        has[g.words + a : g.words + z] |= has[g.left[a:z]] | has[g.right[a:z]]
    begin = np.searchsorted(n, np.arange(len(g.size) + 1))
    sym, pos, out = g.roots, g.root_pos, []
    while True:  # down the derivation
        go = has[sym]
        sym, pos = sym[go] - g.words, pos[go]
        if not len(sym):
            break
        many = begin[sym + 1] - begin[sym]
        r = np.repeat(np.arange(len(sym)), many)
        k = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + begin[sym[r]]
        a, z, p = pos[r] + s[k], pos[r] + e[k], q[k]
        last = len(w) - 1
        ok = ~((a > 0) & (doc[a - 1] == doc[a]) & (w[a - 1] == w[a - 1 + p]))
        ok &= ~((z <= last) & (doc[np.minimum(z, last)] == doc[a]) & (w[np.minimum(z, last)] == w[z - p]))
        out.append(np.stack((doc[a], a, z - a, p), axis=1)[ok])
        sym, pos = np.concatenate((g.left[sym], g.right[sym])), np.concatenate((pos, pos + g.left_words[sym]))
    runs = np.concatenate(out)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 3], runs[:, 1]))]
    new = (np.diff(runs[:, 1], prepend=-1) != 0) | (np.diff(runs[:, 2], prepend=-1) != 0) | (np.diff(runs[:, 3], prepend=-1) != 0)
    runs = runs[new]
    for _, a, length, p in runs.tolist():
        if not np.array_equal(w[a : a + length - p], w[a + p : a + length]):
            return find_runs(w, doc, words, seed + 1)
    return runs


# ------------------------------------------------------------------ texts -----


def stretched(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words that are judged: one text in ten ends in a repetition, by its id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _chunks(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for words in texts:
        if held and (size + len(words) > CHUNK or len(held) == CHUNK_TEXTS):
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Rows (start, length, period) of each text, by start and period."""
    n = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    if len(doc):
        coded = pa.array([x for t in texts for x in t], pa.binary()).dictionary_encode()
        runs = find_runs(coded.indices.to_numpy().astype(np.int64), doc, len(coded.dictionary))
    else:
        runs = np.empty((0, 4), np.int64)
    cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    return [runs[a:z, 1:] - np.array([f, 0, 0]) for f, a, z in zip(first, cut[:-1], cut[1:], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])


def _run(change):
    schema = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def texts(batch) -> Iterator[list[bytes]]:
        for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            yield change(words, doc_id) if change else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _chunks(texts(batch)):
                runs = runs_of_texts(part)
                found = [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in runs]
                kept = [collapsed(t, r).decode() for t, r in zip(part, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(part)), pa.array(found, schema), pa.array(kept, pa.string())],
                                                 names=["row", "runs", "collapsed"])
                at += len(part)

    return run


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """``row`` (the input row), runs array<struct<start, length, period>> by start and period,
    collapsed (the words outside of repetitions). ``change(words, doc_id)`` may replace
    the words before they are judged."""
    src = with_row(docs, F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    row = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(_run(change), f"row {row}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document; runs of the words that ``stretched`` gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    src = docs.select(F.struct("doc_id").alias("row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    got = src.mapInArrow(_run(stretched), "row struct<doc_id:long>, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    order = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.try_element_at(order, F.lit(1))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.concat_ws("\n", line), F.lit("\n"))).otherwise(F.lit(""))
    return got.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        (-best["l"]).alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(-1000) * best["l"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
