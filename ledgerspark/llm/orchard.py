"""Vector codes (operator 13): product quantisation with Orchard's search.

Vectors become whole numbers (``floor(SCALE * x)``) and are cut into ``PARTS`` equal
parts; each part position has a codebook, at first that part of the ``ENTRIES``
vectors with the smallest ids. A round assigns every part of every vector to its nearest
entry and replaces each entry by the floored mean of its parts. All sums are whole
numbers, so results do not depend on the order of rows.

The nearest entry is found by Orchard's search: every entry has a list of the others,
nearest first. A search stands at an entry and walks its list; a listed entry that is nearer
to the vector becomes the one to stand at, and its list is walked from the start.
Entries met before are marked and not measured again. By the triangle inequality the walk
may stop at an entry further than twice the current distance. Many searches advance
together, one step of their list at a time.

Spark partitions the vectors; a task keeps its sums and sends one row per entry
component. The driver holds the codebooks only (``PARTS * ENTRIES`` entries).

Defined cases: vectors that are null, empty or hold null or non-finite components are
dropped, and so are vectors of another length than that of the smallest kept vec_id;
null vec_ids come last among the smallest ids, rows with the same id by their vector;
fewer vectors than ``ENTRIES`` give as many entries; a length that is no multiple of
``PARTS`` is filled with zeros; whole numbers beyond ``LARGEST`` count as that, so
that squares fit in 64 bits; repeated rows count as often as they occur; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_back
from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 26
BLOCK = 2048  # vectors searched together


def whole_numbers(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(vectors, parts, length of a part) whole numbers."""
    x = np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    fill = -x.shape[1] % parts
    return np.pad(x, ((0, 0), (0, fill))).reshape(len(x), parts, -1)


class Lists:
    """Codebooks (parts, entries, length) with each entry's neighbours, nearest first."""

    def __init__(self, books: np.ndarray):
        self.books = books
        gap = books[:, :, None, :] - books[:, None, :, :]
        far = (gap * gap).sum(axis=-1)  # squared distances between entries
        own = np.arange(books.shape[1])
        far[:, own, own] = -1  # itself first, to be left out
        self.near = np.argsort(far, axis=-1, kind="stable")[:, :, 1:]
        self.far = np.take_along_axis(far, self.near, axis=-1)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of every part of ``x`` (vectors, parts, length);
        ties go to the lower entry."""
        n, parts, _ = x.shape
        entries = self.books.shape[1]
        part = np.tile(np.arange(parts), n)
        x = x.reshape(n * parts, -1)

        def distance(i: np.ndarray, entry: np.ndarray) -> np.ndarray:
            d = x[i] - self.books[part[i], entry]
            return (d * d).sum(axis=1)

        at = np.zeros(n * parts, np.int64)
        best = distance(np.arange(n * parts), at)
        step = np.zeros(n * parts, np.int64)
        met = np.zeros((n * parts, entries), bool)
        met[:, 0] = True
        going = np.arange(n * parts if entries > 1 else 0)
        while len(going):
            p, a, k = part[going], at[going], step[going]
            # all further ones in the list are more than twice as far from here as x is
            on = self.far[p, a, k] <= 4 * best[going]
            going, k = going[on], k[on]
            entry = self.near[p[on], a[on], k]
            new = ~met[going, entry]
            step[going] += 1
            i, e = going[new], entry[new]
            met[i, e] = True
            d = distance(i, e)
            nearer = (d < best[i]) | ((d == best[i]) & (e < at[i]))
            i = i[nearer]
            at[i], best[i], step[i] = e[nearer], d[nearer], 0
            going = going[step[going] < entries - 1]
        return at.reshape(n, parts), best.reshape(n, parts)


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, ``_v`` array<double> of the rows that take part, of whatever length."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(F.col("_v"), lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return rows.select("vec_id", "label", v.alias("_v")).where((F.size("_v") > 0) & finite)


def first_books(kept: DataFrame, parts: int, entries: int) -> tuple[DataFrame, np.ndarray | None, int]:
    """(rows of the table's length, codebooks of the smallest ids, that length)."""
    order = [F.asc_nulls_last("vec_id"), F.col("_v").asc()]
    head = kept.orderBy(*order).select("_v").first()
    if head is None:
        return kept, None, 0
    length = len(head["_v"])
    kept = kept.where(F.size("_v") == length)
    first = np.array([r["_v"] for r in kept.orderBy(*order).select("_v").limit(entries).collect()])
    return kept, whole_numbers(first, parts).transpose(1, 0, 2).copy(), length


def improved_books(kept: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """The codebooks after one round over all rows."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(books)
        total, count = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            v = _vectors(batch.column("_v"), length)
            for i in range(0, len(v), BLOCK):
                x = whole_numbers(v[i : i + BLOCK], parts)
                slot = (lists.search(x)[0] + np.arange(parts) * entries).reshape(-1)
                np.add.at(total, slot, x.reshape(-1, size))
                count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        slot = (used[:, None] * size + np.arange(size)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[used].reshape(-1)), pa.array(np.repeat(count[used], size))],
                                         names=["slot", "total", "n"])

    got = kept.select("_v").mapInArrow(run, "slot long, total long, n long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.reshape(-1).copy()
    for r in got.collect():  # at most one row per entry component
        out[r["slot"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def fit_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None, int]:
    kept, books, length = first_books(kept, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = improved_books(kept, books, length)
    return kept, books, length


def encode(kept: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed)."""
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(books)
        for batch in batches:
            v = _vectors(batch.column("_v"), length)
            codes, errors = [], []
            for i in range(0, len(v), BLOCK):
                at, far = lists.search(whole_numbers(v[i : i + BLOCK], parts))
                codes += [c.tobytes().hex() for c in at.astype(np.uint8)]
                errors.append(far.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()),
                 pa.array(np.concatenate(errors) if errors else [], pa.int64())], names=["vec_id", "label", "code", "error"])

    of = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.mapInArrow(run, f"vec_id {of['vec_id']}, label {of['label']}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """label_error beside every row: errors summed over rows with an equal label, nulls
    together. Labels with very many rows are salted when the sums are joined back."""
    keyed = coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0).cast(coded.schema["label"].dataType)),
                               "_row": F.monotonically_increasing_id()})
    sums = keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    return join_back(keyed, sums, ["_none", "_label"], "_rows")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per kept vector of ``embeddings``."""
    kept, books, length = fit_books(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                           F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    coded = with_label_errors(materialize(encode(kept, books, length)))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
