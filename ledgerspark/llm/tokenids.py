"""Token ids as binary files (operator 11): tokenize, code canonically, read back.

``encode_documents`` range-partitions the documents by (doc_id, input place), so
that shard after shard holds them in ascending order, and turns each text into
ids in one Arrow pass. Words repeat, so a text is cut where the vocabulary's
pre-tokenizer always cuts (see ``cut_points``), and the library encodes each
distinct piece once per worker; texts that hold an added token's string go to
the library whole. The result is the same as encoding whole texts (tested).

``write_files`` counts all ids, makes a canonical Huffman code of at most
``MAX_BITS`` bits from the counts (package-merge, so the code is optimal under that
limit) and writes a folder of Parquet tables:

* ``code``: one row, the code lengths of the ids (a canonical code needs no more);
* ``blocks``: one row per block of at most ``BLOCK`` consecutive ids of a shard,
  with the documents in it and ``data``: a header, the bit offset of every
  ``SPACING``-th id, and the bits;
* ``shards``: ids in each shard and before it.

A block is decoded on its own. Its checkpoints are starting points too, so all of
them advance together, one table lookup per id. A text longer than a block lies in
several; ``read_digests`` gives each piece's share of the document's crc32 (the
remainder shifted by the bytes that follow), and shares are combined by xor, so no
task holds more than a block.

Defined cases: null text is empty and gives the end id alone; null doc_ids come
first; rows that share a doc_id follow each other in input order, each with its own
row; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import MIX, materialize, mix64, shards_for

END_ID = 2
SHARD_BYTES = 32 << 20
MAX_BITS = 18
BLOCK, SPACING = 1 << 18, 256
CHUNK_BYTES = 4 << 20  # text that is cut and encoded at a time
ROWS = 1024  # texts held at a time
MAX_PIECES, MAX_PIECE_BYTES = 400_000, 32 << 20  # remembered pieces are forgotten beyond this
MAGIC = b"HIDS"
HEADER, HEADER_BYTES = "<4sIII", 16  # magic, ids, spacing, checkpoints

ENCODED = "shard int, doc_id long, start long, n long, ids binary"
BLOCKS = "shard int, start long, n_ids int, docs array<struct<doc_id:long,start:long,n:long>>, data binary"

# ------------------------------------------------------------- tokenizing -----

_GAP = b"\xff"  # between texts; no byte of UTF-8
_LETTER, _DIGIT, _MARK, _SPACE, _BLANK, _WIDE, _OTHER = range(7)


def _classes() -> np.ndarray:
    c = np.full(256, _OTHER, np.uint8)
    c[0x21:0x7F] = _MARK
    c[0x30:0x3A] = _DIGIT
    c[0x41:0x5B] = c[0x61:0x7B] = _LETTER
    c[0x20], c[0x09:0x0E] = _SPACE, _BLANK
    c[0xC3:0xE0] = _WIDE  # lead bytes of U+00C0 to U+07FF, where no character is white space
    return c


def cut_points(b: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Places at which byte-level pre-tokenizing always cuts UTF-8 bytes ``b``:
    before a space followed by a character that is none; between ASCII letters,
    digits and marks (but not after an apostrophe, which may begin an ending), and
    between one of them and white space; after a line feed alone between two of them."""
    if len(b) < 2:
        return np.empty(0, np.int64)
    c = classes[b]
    left, right = c[:-1], c[1:]
    cut = (left != right) & (left <= _MARK) & (right <= _MARK) & (b[:-1] != 0x27)
    cut |= (left <= _MARK) & ((right == _SPACE) | (right == _BLANK))
    begins = (c[:-1] == _SPACE) & ((right <= _MARK) | (right == _WIDE))
    cut[:-1] |= begins[1:]
    if len(b) > 2:
        cut[1:] |= (b[1:-1] == 0x0A) & (c[:-2] <= _MARK) & (c[2:] <= _MARK)
    return np.flatnonzero(cut) + 1


#: perhaps a space, then letters (from U+00C0 to U+04BF, if not ASCII) or ASCII digits
_RUN = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|(?:[A-Za-z]|[\xc3-\xd1][\x80-\xbf]|\xd2[\x80-\xbf])+)")


def _spelled() -> dict[int, int]:
    """The code point by which byte-level vocabularies spell each byte, where it is another."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in same)}


_SPELLED = _spelled()


class Encoder(dict):
    """piece -> its place in the table of encoded pieces; ``encode`` gives ids of texts."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        # the cuts hold for this pre-tokenizer alone
        spec = json.loads(vocabulary)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                     and not spec.get("normalizer") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]))
        self.classes = _classes()
        self.ids, self.count, self.seen, self.waiting, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32), [], 0

    def forget(self) -> None:
        """Only pieces that came back in a later chunk are kept, if they are no more than half the limits."""
        again = self.seen > 1
        pieces = [p for p, keep in zip(self, again.tolist(), strict=True) if keep]  # in the order of their places
        size = sum(map(len, pieces))
        if 2 * len(pieces) > MAX_PIECES or 2 * size > MAX_PIECE_BYTES:
            again, pieces, size = np.zeros(len(again), bool), [], 0
        self.clear()
        self.update(zip(pieces, range(len(pieces)), strict=True))
        self.size = size
        self.ids = self.ids[np.repeat(again, self.count)]
        self.count, self.seen, self.waiting = self.count[again], np.zeros(len(pieces), np.int32), []

    def __missing__(self, piece: bytes) -> int:
        self.waiting.append(piece)
        self.size += len(piece)
        at = self[piece] = len(self)
        return at

    def _learn(self) -> None:
        """Ids of the pieces met for the first time; a run needs no pre-tokenizing."""
        new: list[list[int] | None] = [None] * len(self.waiting)
        tokenize, run, rest = self.tokenizer.model.tokenize, _RUN.fullmatch, []
        for i, p in enumerate(self.waiting):
            if not run(p):
                rest.append(i)
            elif p.isascii():
                new[i] = [t.id for t in tokenize(p.decode().replace(" ", "Ġ"))]
            elif p.decode().lstrip(" ").isalpha():
                new[i] = [t.id for t in tokenize(p.decode("latin-1").translate(_SPELLED))]
            else:
                rest.append(i)
        got = self.tokenizer.encode_batch_fast([self.waiting[i].decode() for i in rest], add_special_tokens=False)
        for i, e in zip(rest, got, strict=True):
            new[i] = e.ids
        n = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.uint32, int(n.sum()))
        self.ids, self.count = np.concatenate((self.ids, flat)), np.concatenate((self.count, n))
        self.seen = np.concatenate((self.seen, np.zeros(len(n), np.int32)))
        self.waiting = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        chunk: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            if not self.cuts or any(a in t for a in self.added):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            chunk.append((i, t.encode()))
            size += len(chunk[-1][1])
            if size >= CHUNK_BYTES:
                self._encode(chunk, out)
                chunk, size = [], 0
        self._encode(chunk, out)
        return out

    def _encode(self, chunk: list[tuple[int, bytes]], out: list) -> None:
        if len(self) > MAX_PIECES or self.size > MAX_PIECE_BYTES:
            self.forget()
        joined = b"".join(b + _GAP for _, b in chunk)
        if not joined:
            return
        b = np.frombuffer(joined, np.uint8)
        gaps = np.cumsum([len(x) + 1 for _, x in chunk]) - 1
        start = np.sort(np.concatenate(([0], cut_points(b, self.classes), gaps, gaps[:-1] + 1)))
        start = start[np.diff(start, prepend=-1) > 0]
        end = np.append(start[1:], len(b))
        keep = b[start] != _GAP[0]
        start, end = start[keep], end[keep]
        one, which = distinct_pieces(joined, start, end)
        place = np.fromiter((self[joined[i:j]] for i, j in zip(start[one].tolist(), end[one].tolist(), strict=True)), np.int64, len(one))
        if self.waiting:
            self._learn()
        self.seen[place] += 1
        place = place[which]
        n = self.count[place]
        first = (np.cumsum(self.count) - self.count)[place]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.arange(upto[-1]) + np.repeat(first - upto[:-1], n)]
        cuts = upto[np.searchsorted(start, gaps)]
        for (i, _), a, z in zip(chunk, np.concatenate(([0], cuts[:-1])), cuts, strict=True):
            out[i] = ids[a:z]


def distinct_pieces(joined: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of distinct pieces, which of them each piece is). Pieces of up to 16
    bytes are compared as two numbers, found by a hash and confirmed; longer ones,
    and all if the hash ever fails, stand for themselves."""
    n = end - start
    words = np.ndarray(len(joined) + 9, "<u8", joined + bytes(24), strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = words[start] & mask[np.minimum(n, 8)]
    high = words[start + np.minimum(n, 8)] & mask[np.clip(n - 8, 0, 8)]
    key = mix64(low * MIX + mix64(high + n.astype(np.uint64)))
    long = np.flatnonzero(n > 16)
    key[long] = mix64(long.astype(np.uint64))
    which = pa.array(key).dictionary_encode().indices.to_numpy()
    one = np.empty(int(which.max()) + 1 if len(which) else 0, np.int64)
    one[which] = np.arange(len(which))
    same = one[which]
    right = np.where(n > 16, same == np.arange(len(n)), (low[same] == low) & (high[same] == high) & (n[same] == n))
    return (one, which) if right.all() else (np.arange(len(n)), np.arange(len(n)))


def worker_encoder(vocabulary: str) -> Encoder:
    """The encoder of this Python worker, kept between its tasks."""
    state = sys.modules.setdefault("_ledgerspark_encoders", types.ModuleType("_ledgerspark_encoders"))
    key = f"v{zlib.crc32(vocabulary.encode())}_{len(vocabulary)}"
    if not hasattr(state, key):
        setattr(state, key, Encoder(vocabulary))
    return getattr(state, key)


def vocabulary_size(vocabulary: str) -> int:
    spec = json.loads(vocabulary)
    known = spec["model"]["vocab"]
    top = max(known.values() if isinstance(known, dict) else range(len(known)), default=0)
    return 1 + max([top, *[a["id"] for a in spec.get("added_tokens", [])]])


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """The ids of every document, written in ascending doc_id order: (table, numpy type of its ids).

    ``start`` counts the ids of the shard before the document."""
    width = "<u2" if max(vocabulary_size(vocabulary) - 1, end_id) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        start = 0
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            data = [np.append(ids, end_id).astype(width) for ids in encoder.encode(texts)]
            n = np.array([len(x) for x in data], np.int64)
            before = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("doc_id"), pa.array(before), pa.array(n),
                 pa.array([x.tobytes() for x in data], pa.binary())], names=["shard", "doc_id", "start", "n", "ids"])

    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.monotonically_increasing_id().alias("place"))
    n = shards_for(spark, src, "text", shard_bytes)
    src = src.repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    return materialize(src.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(run, ENCODED)), width


# ------------------------------------------------------------------- code -----


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code word (0: does not occur), the shortest total under
    the limit. Package-merge: lists of leaves and of pairs of the list before."""
    bits = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        bits[used] = 1
        return bits
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit code words of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    made, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = made[: len(made) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        order = np.argsort(both, kind="stable")
        made = both[order]
        is_leaf.append(order < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        bits[used[:n]] += 1
        take = 2 * (take - n)
    return bits


def code_words(bits: np.ndarray) -> np.ndarray:
    """Canonical code words: numbered upwards by (length, symbol)."""
    words = np.zeros(len(bits), np.uint64)
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    code = last = 0
    for n in np.unique(bits[order]).tolist():
        same = order[bits[order] == n]
        code <<= n - last
        words[same] = code + np.arange(len(same), dtype=np.uint64)
        code, last = code + len(same), n
    return words


def decoding_table(bits: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, width): the next ``width`` bits give symbol << 8 | length of its code word."""
    width = max(int(bits.max(initial=0)), 1)
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    out = np.zeros(1 << width, np.uint64)
    filled = np.repeat((order.astype(np.uint64) << np.uint64(8)) | bits[order].astype(np.uint64), 1 << (width - bits[order].astype(np.int64)))
    out[: len(filled)] = filled
    return out, width


def pack(ids: np.ndarray, bits: np.ndarray, words: np.ndarray, spacing: int = SPACING) -> bytes:
    """One block: header, checkpoints, code words from the highest bit down."""
    n = bits[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    word, over = at >> 6, (at & 63) + n - 64
    code = words[ids]
    first = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
    out = np.zeros((int(end[-1]) + 63 >> 6) if len(ids) else 0, np.uint64)
    if len(ids):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[starts]] = np.add.reduceat(first, starts)  # bits of a word do not overlap
        split = over > 0
        out[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    marks = at[::spacing].astype("<u4")
    return struct.pack(HEADER, MAGIC, len(ids), spacing, len(marks)) + marks.tobytes() + out.astype(">u8").tobytes()


def unpack(data: bytes, table: np.ndarray, width: int) -> np.ndarray:
    """The ids of one block: every checkpoint's stretch advances at once."""
    magic, n, spacing, lanes = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    at = np.frombuffer(data, "<u4", lanes, HEADER_BYTES).astype(np.int64)
    body = data[HEADER_BYTES + 4 * lanes :] + bytes(spacing * width // 8 + 8)  # the last stretch may run on
    window = np.ndarray(len(body) - 3, ">u4", body, strides=(1,))
    out = np.empty((spacing, lanes), np.uint32)
    low = np.uint64((1 << width) - 1)
    for i in range(min(spacing, n)):
        w = window[at >> 3].astype(np.uint64)
        got = table[(w >> (32 - width - (at & 7)).astype(np.uint64)) & low]
        out[i] = got >> np.uint64(8)
        at += (got & np.uint64(255)).astype(np.int64)
    return out.T.reshape(-1)[:n]


# ------------------------------------------------------------------ files -----


def count_ids(encoded: DataFrame, width: str) -> np.ndarray:
    """How often each id occurs in all documents; one row an id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), width)
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["id", "n"])

    got = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r["id"] for r in got), default=0), np.int64)
    for r in got:
        out[r["id"]] = r["n"]
    return out


def _block_rows(bits: np.ndarray, width: str, block: int):
    words = code_words(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, held, docs, parts = None, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            row = {"shard": shard, "start": start, "n_ids": held, "docs": docs, "data": pack(np.concatenate(parts), bits, words)}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_BLOCKS)

        for batch in batches:
            for s, doc_id, at, n, ids in zip(*(batch.column(c) for c in ("shard", "doc_id", "start", "n", "ids")), strict=True):
                s, at, n = s.as_py(), at.as_py(), n.as_py()
                if held and (s != shard or at != start + held):
                    yield flush()
                    held = 0
                ids = np.frombuffer(ids.as_buffer(), width)
                doc = {"doc_id": doc_id.as_py(), "start": at, "n": n}
                done = 0
                while done < n:
                    if not held:
                        shard, start, docs, parts = s, at + done, [], []
                    part = ids[done : done + block - held]
                    docs.append(doc)
                    parts.append(part)
                    held += len(part)
                    done += len(part)
                    if held == block:
                        yield flush()
                        held = 0
        if held:
            yield flush()

    return run


_ARROW_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int32()),
    ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))), ("data", pa.binary()),
])


def write_files(encoded: DataFrame, width: str, path: str, max_bits: int = MAX_BITS, block: int = BLOCK) -> None:
    """The files of the module's docstring under ``path``."""
    spark = encoded.sparkSession
    bits = code_lengths(count_ids(encoded, width), max_bits)
    spark.createDataFrame([(int(max_bits), bytearray(bits.tobytes()))], "max_bits int, lengths binary").write.parquet(f"{path}/code")
    rows = encoded.select("shard", "doc_id", "start", "n", "ids").mapInArrow(_block_rows(bits, width, block), BLOCKS)
    rows.write.option("compression", "none").parquet(f"{path}/blocks")  # coded already
    # one row a shard: a bounded window
    total = encoded.groupBy("shard").agg(F.sum("n").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total.withColumn("before", before).write.parquet(f"{path}/shards")


def _tables(spark: SparkSession, path: str) -> tuple[np.ndarray, DataFrame, DataFrame]:
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()["lengths"]), np.uint8)
    return lengths, spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/shards")


def _pieces(batches: Iterator[pa.RecordBatch], bits: np.ndarray):
    """(shard, document, ids of it in the block, ids of it after the block) from blocks."""
    table, width = decoding_table(bits)
    for batch in batches:
        for shard, start, docs, data in zip(*(batch.column(c) for c in ("shard", "start", "docs", "data")), strict=True):
            ids, start = unpack(data.as_py(), table, width), start.as_py()
            for d in docs.as_py():
                a, z = max(d["start"] - start, 0), min(d["start"] + d["n"] - start, len(ids))
                yield shard.as_py(), d, ids[a:z], d["start"] + d["n"] - start - z


def crc_shift(crc: int, n_bytes: int) -> int:
    """What ``crc`` of a part adds to the crc32 of the whole when ``n_bytes`` follow it:
    its product with x^(8 n) over GF(2), modulo the polynomial (bit-reflected)."""

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if b >> i & 1:
                out ^= a
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        return out

    power, n = 1 << 23, n_bytes  # x^8
    while n:
        if n & 1:
            crc = times(crc, power)
        power = times(power, power)
        n >>= 1
    return crc


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    bits, blocks, shards = _tables(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for shard, d, ids, after in _pieces(batches, bits):
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            rows.append((shard, d["start"], d["doc_id"], len(ids), crc_shift(crc, 4 * after) if after else crc))
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types_ = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types_, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "at", "doc_id", "n", "crc"])

    parts = blocks.mapInArrow(run, "shard int, at long, doc_id long, n long, crc long")
    whole = parts.groupBy("shard", "at", "doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return whole.join(shards.select("shard", "before"), "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, piece, ids: the ids back, a document of several blocks as several rows."""
    bits, blocks, shards = _tables(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, d, ids, after in _pieces(batches, bits):
            yield pa.RecordBatch.from_pylist([{"shard": shard, "at": d["start"], "doc_id": d["doc_id"],
                                               "piece_start": d["n"] - after - len(ids), "ids": ids.astype(np.int64)}],
                                             schema=_ARROW_IDS)

    got = blocks.mapInArrow(run, "shard int, at long, doc_id long, piece_start long, ids array<long>")
    return got.join(shards.select("shard", "before"), "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "piece_start", "ids")


_ARROW_IDS = pa.schema([("shard", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("piece_start", pa.int64()),
                        ("ids", pa.list_(pa.int64()))])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_ids(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """Contract query: one row per document, from files written and read back."""
    with open(vocabulary_path or default_vocabulary(), encoding="utf-8") as f:  # the driver's file; its text goes to the tasks
        vocabulary = f.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded, width = encode_documents(docs, vocabulary)
    path = f"{checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_files(encoded, width, path)
    return read_digests(spark, path)
