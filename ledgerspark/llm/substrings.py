"""Substring dedup (operator 3) by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document; each window equal to
one that starts earlier (smaller doc_id, then smaller row key, then earlier
start) has its words removed. Every input row is a document of its own, told
apart by a row key that is written beside the row before anything is counted.

1. Every window names one phrase of ``PHRASE`` words in it: the one with the
   smallest hash, the first of several. Equal windows name equal phrases, so
   only phrases named at two places or more can belong to a repeated window;
   Spark counts them and so confirms the recurring ones.
2. Documents are dealt by row key to shards of bounded size. A shard gets each
   recurring phrase found in it once, compiles an Aho-Corasick automaton over
   the words, and streams its documents through it to locate every
   occurrence of every phrase.
3. Consecutive windows that name one occurrence of a phrase make a block, keyed by a
   64-bit hash. Equal blocks hold equal windows at equal offsets, so of each key
   all blocks but the first are later windows throughout, and the first place of
   every window lies in a first block. Only first blocks are expanded into
   windows, again keyed by a hash, of which all but the first place are later ones.
   Firsts are partial minima, so no hot key; the later places become removed words,
   applied in one last join by row key.

Whole texts are read each time; no phrase, window or partner is capped.
Defined cases: null text has no words; texts of fewer than ``WINDOW`` words
lose nothing; rows that share a doc_id are told apart and ordered by row key, so
later copies among them lose their words; null doc_ids sort last, in the order
of their row keys; extra columns are ignored (or carried in ``row``).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M64, MIX, WordHash, materialize, mix64, replace_text, shards_for, shingle_hashes, with_row

WINDOW = 20
PHRASE = 6
SHARD_BYTES = 4 << 20
CHUNK_WORDS = 1 << 17  # words of several texts hashed at a time
_LAST = (1 << 63) - 1
_HIGH = np.uint64(((1 << 40) - 1) << 24)  # texts have less than 2 ** 24 words


def named(hashes: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """For each window the place of the phrase it names."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    g = shingle_hashes(hashes, phrase)
    # 40 bits of hash and the place itself: the minimum is the first of the smallest
    low = (g & _HIGH) | np.arange(len(g), dtype=np.uint64)
    span, want = 1, window - phrase + 1
    while span < want:  # minima of spans of 1, 2, 4, ... and at last ``want`` places
        step = min(span, want - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return (low & ~_HIGH).astype(np.int64)


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of ``k`` numbers, from those of 1, 2, 4, ... of them."""
    n = max(len(ids) - k + 1, 0)
    out, have, part, span, power = np.zeros(n, np.uint64), 0, ids, 1, MIX
    while n:
        if k & span:
            out = out * power + part[have : have + n]
            have += span
        if 2 * span > k:
            break
        part = part[:-span] * power + part[span:]
        span, power = 2 * span, np.uint64(int(power) ** 2 & M64)
    return out


def chunks(words: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(names, numbers of words, joined words) of some texts at a time."""
    names, parts, size = [], [], 0
    for name, w in words:
        if parts and size + len(w) > CHUNK_WORDS:
            yield names, np.array([len(x) for x in parts]), np.concatenate(parts)
            names, parts, size = [], [], 0
        names.append(name)
        parts.append(w)
        size += len(w)
    if parts:
        yield names, np.array([len(x) for x in parts]), np.concatenate(parts)


def windows_within(lengths: np.ndarray, window: int) -> np.ndarray:
    """Which windows of joined texts, none shorter than a window, lie within one of them."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    return text[: len(text) - window + 1] == text[window - 1 :]


def _anchors(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            split = ((k, (t.as_py() or b"").split()) for k, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True))
            for keys, lengths, ids in chunks((k, hashes.ids(w)) for k, w in split if len(w) >= window):
                at = named(ids, window, phrase)[windows_within(lengths, window)]
                at = at[np.diff(at, prepend=-1) > 0]  # places only grow
                begins = np.cumsum(lengths) - lengths
                text = np.searchsorted(begins, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle_hashes(ids, phrase)[at].view(np.int64)), pa.array(np.array(keys, np.int64)[text]),
                     pa.array((at - begins[text]).astype(np.int32))], names=["phrase", "key", "pos"])

    return run


class Numbers(dict):
    """word -> its number; ``hashes`` in their order."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(w))
        return n


def letters(numbers: np.ndarray) -> str:
    """Three letters for each word number, each from an alphabet of its own.

    The automaton looks through a node's children one by one, so a node must not
    have as many as there are words; and no match can start within a word.
    """
    n = numbers.astype("<u4")
    return np.stack((0x1000 + n % 64, 0x2000 + (n >> 6) % 64, 0x10000 + (n >> 12)), axis=1).astype("<u4").tobytes().decode("utf-32-le")


def compile_automaton(phrases):
    """Aho-Corasick automaton over strings of ``letters``."""
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        auto.add_word(p)
    auto.make_automaton()
    return auto


def _locate(window: int, phrase: int):
    """Blocks of a shard's documents: consecutive windows that name one occurrence of a recurring phrase."""

    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
        if len(phrases) and len(docs):
            number = Numbers()
            doc = dict(zip(docs.column("key").to_pylist(), docs.column("doc").to_pylist(), strict=True))
            split = ((k, (t.as_py() or b"").split()) for k, t in zip(docs.column("key").to_pylist(), docs.column("text"), strict=True))
            texts = list(chunks((k, np.fromiter(map(number.__getitem__, w), np.int64, len(w))) for k, w in split if len(w) >= window))
            spelled = [letters(ids) for _, _, ids in texts]
            begin = {k: (i, b) for i, (keys, lengths, _) in enumerate(texts)
                     for k, b in zip(keys, (np.cumsum(lengths) - lengths).tolist(), strict=True)}
            places = ((begin[k], p) for k, p in zip(phrases.column("key").to_pylist(), phrases.column("pos").to_pylist(), strict=True))
            auto = compile_automaton({spelled[i][3 * (b + p) : 3 * (b + p + phrase)] for (i, b), p in places})
            hashes = np.array(number.hashes, np.uint64)
            for (keys, lengths, ids), t in zip(texts, spelled, strict=True):
                ends = np.fromiter((e for e, _ in auto.iter(t)), np.int64)
                located = np.zeros(len(ids), bool)
                located[(ends + 1) // 3 - phrase] = True  # one that spans two texts is named by no window
                ids = hashes[ids]
                names = named(ids, window, phrase)
                at = np.flatnonzero(located[names] & windows_within(lengths, window))
                if not len(at):
                    continue
                h = rolling(ids, window)[at]
                first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(names[at], prepend=-1) != 0))
                n = np.diff(first, append=len(at))
                begins = np.cumsum(lengths) - lengths
                text = np.searchsorted(begins, at[first], "right") - 1
                key = np.array(keys, np.int64)[text]
                block = mix64(mix64(h[first]) * MIX + h[first + n - 1] + n.astype(np.uint64))  # shorter than a window: all its words
                got = (block.view(np.int64), np.fromiter(map(doc.__getitem__, key.tolist()), np.int64, len(key)), key,
                       (at[first] - begins[text]).astype(np.int32), n.astype(np.int32), h.view(np.int64))
                for c, x in zip(cols, got, strict=True):
                    c.append(x)
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int64)
        block, docid, key, start, n, h = (np.concatenate([np.empty(0, k), *c]) for c, k in zip(cols, kinds, strict=True))
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        return pa.table({"block": block, "doc": docid, "key": key, "start": start, "n": n, "windows": pa.ListArray.from_arrays(offsets, h)})

    return run


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, starts in zip(batch.column("_text"), batch.column("starts"), strict=True):
                w = (text.as_py() or b"").split()
                n.append(len(w))
                if starts.is_valid and len(starts):
                    s, m = (starts.values.field(c).to_numpy() for c in ("start", "n"))
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + (m + window - 1), -1)
                    keep = np.cumsum(edge)[: len(w)] == 0
                    w = [x for x, k in zip(w, keep.tolist(), strict=True) if k]
                gone.append(n[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["row", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``row`` (the input row), n_words, n_removed, kept (the words left, joined by a space)."""
    spark = docs.sparkSession
    rows = materialize(with_row(docs, F.monotonically_increasing_id().alias("key")))
    doc, text = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_LAST)), F.col("row.text").cast("binary")
    texts = rows.where("row.text is not null").select("key", doc.alias("doc"), text.alias("text"))
    anchors = materialize(texts.select("key", "text").mapInArrow(_anchors(window, phrase), "phrase long, key long, pos int"))
    recurring = materialize(anchors.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase"))
    shards = shards_for(spark, texts, "text", shard_bytes)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    found = (anchors.join(recurring, "phrase").groupBy(shard.alias("shard"), "phrase")
             .agg(F.min(F.struct("key", "pos")).alias("at")).select("shard", "at.key", "at.pos"))
    blocks = materialize(
        texts.select(shard.alias("shard"), "key", "doc", "text").groupBy("shard").cogroup(materialize(found).groupBy("shard"))
        .applyInArrow(_locate(window, phrase), "block long, doc long, key long, start int, n int, windows array<long>"))
    firsts = materialize(blocks.groupBy("block").agg(F.min(F.struct("doc", "key", "start", "windows")).alias("first"), F.count("*").alias("count"))
                         .select("block", "count", "first.*"))
    other = (F.col("key") != F.col("key1")) | (F.col("start") != F.col("start1"))
    shared = firsts.where("count > 1").select("block", F.col("key").alias("key1"), F.col("start").alias("start1"))
    copies = blocks.select("block", "key", "start", "n").join(shared, "block").where(other).select("key", "start", "n")
    windows = firsts.select("doc", "key", "start", F.posexplode("windows").alias("i", "window")).select(
        "window", "doc", "key", (F.col("start") + F.col("i")).alias("start"))
    first = materialize(windows.groupBy("window").agg(F.min(F.struct("doc", "key", "start")).alias("first"), F.count("*").alias("count"))
                        .where("count > 1").select("window", F.col("first.key").alias("key1"), F.col("first.start").alias("start1")))
    later = windows.join(first, "window").where(other).select("key", "start", F.lit(1).alias("n"))
    starts = materialize(copies.unionByName(later).groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "n")).alias("starts")))
    src = rows.join(starts, F.col("key") == F.col("_key"), "left").select(text.alias("_text"), "starts", "row")
    schema = f"row {src.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return src.mapInArrow(_apply(window), schema)


def trimmed_documents(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages; ``n_chars`` follows.

    Untouched texts stay as they are, byte for byte; texts of which nothing is left are dropped.
    """
    got = remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    return replace_text(got, docs.columns, F.when(F.col("n_removed") > 0, F.col("kept")))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document."""
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs, window: int = WINDOW) -> dict:
    """Direct form for tests: doc_id -> (n_words, n_removed, kept words)."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out[doc_id] = (len(w), len(w) - len(left), b" ".join(left).decode())
    return out
