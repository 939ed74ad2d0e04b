"""Helpers shared by the operators: written tables, words, hashes, file sizes."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MIX = np.uint64(0x9E3779B97F4A7C15)
M64 = (1 << 64) - 1


def table(sf_dir: str, name: str):
    """``spark -> DataFrame`` reader of one input table."""
    return lambda spark: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the tasks of the next step only.
    The shuffle files of the written plan are removed when the write ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(n))


def with_row(docs: DataFrame, *cols: Column) -> DataFrame:
    """``cols`` and the whole input row as one struct, so that no extra column
    can clash with a result column."""
    return docs.select(*cols, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def replace_text(df: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The input rows back from ``row``, with another ``text`` (and ``n_chars``)
    where ``text`` is not null."""

    def col(c: str) -> Column:
        old = F.col(f"row.`{c}`")
        if c == "text":
            return F.coalesce(text, old).alias(c)
        if c == "n_chars":
            new = F.length(text).cast(df.schema["row"].dataType[c].dataType)
            return F.when(text.isNotNull(), new).otherwise(old).alias(c)
        return old.alias(c)

    return df.select(*[col(c) for c in columns])


class WordHash(dict):
    """word bytes -> 64-bit hash; at most ``limit`` words are remembered."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (fewer words: none)."""
    m = len(ids) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h *= MIX
        h += ids[j : j + m]
    return mix64(h)


def shards_for(spark: SparkSession, df: DataFrame, column: str, bytes_per_shard: int) -> int:
    """How many shards of about ``bytes_per_shard`` the texts of ``df`` make."""
    total = df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(1, -(-int(total) // bytes_per_shard))
