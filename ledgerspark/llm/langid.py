"""Language ID (operator 7) by rank-order profiles of character n-grams.

Texts are lower-cased, everything but letters becomes one space, and n-grams
of 1 to 3 characters are counted (a space only as part of a longer one). An
n-gram is known by a 20-bit hash of its characters. A language's profile is
the list of its ``PROFILE`` most frequent n-grams over all training documents;
a document is ranked the same way and compared by the out-of-place distance:
the sum over its n-grams of the difference in rank, ``PROFILE`` for one that
the profile lacks. The language with the smallest distance wins (ties: the
language first in order), and score is 1 - distance / largest distance.

Counting is a narrow pass with one row per n-gram, language and part of a batch, summed
by Spark; only the profiles (``PROFILE`` rows a language) reach the driver.

Defined cases: null text, text without a letter or no training row: ``und``,
score 0; null lang: not learned from; repeated rows are counted and judged
each for itself; extra columns are ignored (or carried in ``row``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, with_row

PROFILE = 400
GRAM_BITS = 20
FOLDS, HELD_OUT = 4, 2
MIN_SCORE = 0.1
COUNT_CHARS = 1 << 20  # characters of one language counted at a time
_TOP = 0x40000  # planes 0 to 3 hold all letters; code points from here on are none


def letters_table() -> np.ndarray:
    """code point -> itself if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(_TOP)], np.uint32)


def characters(text: str | None, table: np.ndarray) -> np.ndarray:
    """Letters of the lower-cased text, runs of anything else as one space, a space at each end."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    cp = table[np.minimum(cp, _TOP - 1)]
    cp = np.concatenate(([32], cp, [32])).astype(np.uint32)
    gap = cp == 32
    return cp[~(gap & np.concatenate(([False], gap[:-1])))]


def grams(cp: np.ndarray) -> np.ndarray:
    """Hashes of the 1- to 3-grams, without the lone spaces."""
    a = cp.astype(np.uint64)
    out = [a[a != 32]]
    for n in (2, 3):
        if len(a) >= n:
            key = a[: len(a) - n + 1]
            for j in range(1, n):
                key = (key << np.uint64(20)) | a[j : len(a) - n + 1 + j]
            out.append(key)
    key = np.concatenate(out) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - GRAM_BITS)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = letters_table()

    def counted(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        n = np.bincount(grams(np.concatenate(parts)), minlength=1 << GRAM_BITS)
        seen = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen], pa.int64())],
            names=["lang", "gram", "n"])

    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            cp = characters(text.as_py(), table)
            by.setdefault(lang, []).append(cp)
            size[lang] = size.get(lang, 0) + len(cp)
            if size[lang] >= COUNT_CHARS:
                yield counted(lang, by.pop(lang))
                size[lang] = 0
        for lang, parts in by.items():
            yield counted(lang, parts)


def fit_profiles(train: DataFrame, profile: int = PROFILE) -> dict[str, list[int]]:
    """language -> its n-grams, most frequent first (ties: smaller hash)."""
    counts = (train.where("text is not null and lang is not null").select("lang", "text")
              .mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def rank_table(profiles: dict[str, list[int]], profile: int) -> tuple[list[str], np.ndarray]:
    langs = sorted(profiles)
    ranks = np.full((len(langs), 1 << GRAM_BITS), profile, np.int16)
    for i, lang in enumerate(langs):
        ranks[i, profiles[lang]] = np.arange(len(profiles[lang]))
    return langs, ranks


def classify(text: str | None, table, langs, ranks, profile: int) -> tuple[str, float]:
    cp = characters(text, table)
    if len(cp) < 2 or not langs:  # only spaces
        return "und", 0.0
    g, n = np.unique(grams(cp), return_counts=True)
    key = (n.astype(np.int64) << GRAM_BITS) | ((1 << GRAM_BITS) - 1 - g)
    if len(key) > profile:
        key = np.partition(key, len(key) - profile)[-profile:]
    g = (1 << GRAM_BITS) - 1 - (np.sort(key)[::-1] & ((1 << GRAM_BITS) - 1))
    theirs = ranks[:, g].astype(np.int64)
    far = np.where(theirs == profile, profile, np.abs(theirs - np.arange(len(g)))).sum(axis=1)
    best = int(np.argmin(far))
    return langs[best], 1.0 - float(far[best]) / (profile * len(g))


def _predict(profiles: dict[str, list[int]], profile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters_table()
        langs, ranks = rank_table(profiles, profile)
        for batch in batches:
            got = [classify(t.as_py(), table, langs, ranks, profile) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                names=["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, train: DataFrame, profile: int = PROFILE) -> DataFrame:
    """``row`` (the input row), lang_pred, score; ``train`` gives text and lang to learn from."""
    src = with_row(docs, F.col("text").alias("_text"))
    schema = f"row {src.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return src.mapInArrow(_predict(fit_profiles(train, profile), profile), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """All folds but the held-out one; a null id is never learned from."""
    return docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT)


def identified_documents(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents with a recognised language: neither ``und`` nor further from
    every profile than ``min_score`` allows (junk without words of any language)."""
    got = identify(docs, training_rows(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return got.select("row.*")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify(docs.select("doc_id", "text"), training_rows(docs))
    return got.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(crc_mod("row.doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
