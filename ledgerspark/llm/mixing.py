"""Mixing sources to target weights (operator 1) by iterative proportional fitting.

Documents are counted into cells of source, language and topic. The cells'
token weights are raked: each round scales them to the source, then the
language, then the topic targets, until the largest error is below
``TOLERANCE``; targets that contradict each other stop the rounds when the error
no longer falls, with a warning. A cell's rate is its raked tokens over its
tokens, scaled to the budget: the expected copies of each of its documents. A
document is taken as often as the whole part of the rate says, and once more if
a fixed hash of its id, as a number in [0, 1), lies below the rest: the same
sample on every run and after every lost task. So the expected tokens meet the
budget and the targets, rare cells by repeated documents. ``mix`` without
``repeats`` takes no document twice: rates are cut at 1 and the tokens that lacks
are spread over the other cells, which meets the budget but not the targets.

Topic is the column ``topic`` if there is one, else the form of the text:
``list`` (many ``|``), ``symbols`` (little of it letters), ``short`` or ``prose``.
Default targets flatten what is there: each share to the power ``POWER``.

Cells and margins are written tables of sums; the row-level join on the cell is
a plain equi-join that AQE may split. Only one-row sums reach the driver.
Defined cases: null source, lang or topic is a value of its own; null or empty
text has 0 tokens and shares its cell's probability; a target without cells is
dropped and the rest scaled up; a null id is hashed as ``null``; repeated rows
count each and share their fate; extra columns are ignored or kept.
"""

from __future__ import annotations

import logging
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

POWER = 0.7
BUDGET = 0.5  # of all tokens
TOLERANCE = 1e-6
PATIENCE = 10  # rounds in which the error has to fall by a tenth
SHORT = 50
DIMS = ("source", "lang", "topic")


# bytes that are a character's second to fourth, ASCII, and ASCII that is neither letter nor white space
_FURTHER = bytes(range(0x80, 0xC0))
_ASCII = bytes(range(0x80))
_SIGNS = bytes(b for b in range(0x80) if not chr(b).isalpha() and chr(b) not in "\t\n\x0b\x0c\r ")


def measure(raw: bytes | None) -> tuple[int, str]:
    """Number of words (runs of anything but ASCII white space) and the form of a text."""
    if not raw or not (n := len(raw.split())):
        return 0, "short"
    if raw.count(b"|") * 8 >= n:
        return n, "list"
    length = len(raw.translate(None, _FURTHER))
    signs = len(raw) - len(raw.translate(None, _SIGNS))
    others = raw.translate(None, _ASCII).decode("utf-8", "replace")
    if others:
        signs += sum(times for c, times in Counter(others).items() if not c.isalpha())
    return n, "symbols" if (length - signs) * 10 < length * 8 else "short" if n < SHORT else "prose"


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]))
def measured(text: pa.Array) -> pa.Array:
    both = [measure(t.as_py()) for t in text]
    return pa.StructArray.from_arrays([pa.array([n for n, _ in both], pa.int64()), pa.array([f for _, f in both], pa.string())], names=["n", "form"])


def cells_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (and ``more``); nulls as the text ``(none)``."""
    measures = measured(F.col("text").cast("binary"))
    own = F.col("topic") if "topic" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", "source", "lang", own.cast("string").alias("_topic"), measures.alias("_m"), *more)
    topic = "_topic" if "topic" in docs.columns else "_m.form"
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    kept = [c for c in rows.columns if c not in ("doc_id", "source", "lang", "_topic", "_m")]
    return rows.select("doc_id", named("source").alias("source"), named("lang").alias("lang"), named(topic).alias("topic"),
                       F.col("_m.n").alias("n_tokens"), *kept)


def default_targets(cells: DataFrame, dim: str, power: float = POWER) -> DataFrame:
    share = cells.groupBy(dim).agg(F.sum("n_tokens").alias("n")).where("n > 0")
    return share.select(dim, F.pow(F.col("n").cast("double"), F.lit(power)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, n_tokens) with ``weight``: shares of the raked mixture.

    Without ``rounds`` it goes on until the largest error is below ``tolerance`` or no longer falls.
    """
    cells = cells.where("n_tokens > 0")
    total = float(cells.agg(F.sum("n_tokens")).first()[0] or 1)
    now = materialize(cells.withColumn("weight", F.col("n_tokens") / total))
    goals = {}
    for dim in DIMS:
        there = targets[dim].join(now.select(dim).distinct(), dim).where("target > 0")
        scale = there.agg(F.sum("target")).first()[0] or 1.0
        goals[dim] = materialize(there.select(dim, (F.col("target") / float(scale)).alias("goal")))
    errors: list[float] = []
    while rounds is None or len(errors) < rounds:
        off = F.lit(0.0)
        step = now
        for dim in DIMS:
            have = step.groupBy(dim).agg(F.sum("weight").alias("have")).join(goals[dim], dim, "left")
            factor = have.select(dim, F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("have")).otherwise(1.0).alias("f"))
            step = step.join(factor, dim).withColumn("weight", F.col("weight") * F.col("f")).withColumn(f"off_{dim}", F.abs(F.col("f") - 1)).drop("f")
            off = F.greatest(off, F.max(f"off_{dim}"))
        step = materialize(step)
        now = step.select(*DIMS, "n_tokens", "weight")
        errors.append(step.agg(off).first()[0] or 0.0)
        if errors[-1] < tolerance:
            return now
        if rounds is None and len(errors) > PATIENCE and min(errors[-PATIENCE:]) > 0.9 * min(errors[:-PATIENCE]):
            break
    logging.getLogger(__name__).warning("targets not met after %d rounds of raking: largest relative error %g", len(errors), errors[-1] if errors else 1.0)
    return now


def inclusion(raked: DataFrame, budget: float) -> DataFrame:
    """``raked`` with ``prob``: min(1, c * weight / n_tokens), the expected tokens being ``budget`` (if it can be met)."""
    ratio = F.col("weight") / F.col("n_tokens")
    c = budget
    for _ in range(64):
        r = raked.agg(
            F.sum(F.when(c * ratio >= 1, F.col("n_tokens")).otherwise(0)), F.sum(F.when(c * ratio < 1, F.col("weight")).otherwise(0.0))
        ).first()
        full, rest = float(r[0] or 0), float(r[1] or 0)
        new = (budget - full) / rest if rest > 0 and budget > full else c
        if abs(new - c) <= 1e-12 * abs(c):
            break
        c = new
    return raked.withColumn("prob", F.least(F.lit(1.0), F.lit(c) * ratio))


def rates(raked: DataFrame, budget: float) -> DataFrame:
    """``raked`` with ``prob``: the expected copies of a document, the expected tokens being ``budget`` in the raked shares."""
    scale = budget / float(raked.agg(F.sum("weight")).first()[0] or 1)
    return raked.withColumn("prob", F.lit(scale) * F.col("weight") / F.col("n_tokens"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the md5 of the id: its first 12 hex digits."""
    digest = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(doc_id: Column, rate: Column) -> Column:
    """How often a document is taken; on average ``rate`` times."""
    return (F.floor(rate) + (draw(doc_id) < rate - F.floor(rate)).cast("long")).cast("int")


def probabilities(rows: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, repeats: bool = False) -> DataFrame:
    """source, lang, topic, prob of each cell of ``rows`` (from ``cells_of``) that has tokens.

    ``targets``: per dimension a table (dimension, target), any positive scale.
    With ``repeats`` prob is the expected number of copies and may be above 1.
    """
    cells = materialize(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("n_tokens")))
    goals = targets or {d: default_targets(cells, d) for d in DIMS}
    total = float(cells.agg(F.sum("n_tokens")).first()[0] or 0)
    scaled = rates if repeats else inclusion
    return materialize(scaled(rake(cells, goals), budget * total).select(*DIMS, "prob"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, repeats: bool = False) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, prob, sampled for each row of ``docs``; with ``repeats`` also rate and copies."""
    rows = materialize(cells_of(docs))
    out = rows.join(probabilities(rows, targets, budget, repeats), list(DIMS), "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    rate, prob = F.col("prob"), F.least(F.lit(1.0), F.col("prob"))
    more = [rate.alias("rate"), copies(F.col("doc_id"), rate).alias("copies")] if repeats else []
    return out.select("doc_id", *DIMS, "n_tokens", prob.alias("prob"), (draw(F.col("doc_id")) < prob).alias("sampled"), *more)


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its cell, calibrated probability and expected copies (12 places each) and fate."""
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeats=True)
    return got.withColumn("prob", F.round("prob", 12)).withColumn("rate", F.round("rate", 12))


def sampled_documents(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of ``docs``, each as often as it is taken, with ``sample_prob``, the expected number of its copies."""
    probs = probabilities(cells_of(docs), targets, budget, repeats=True)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "sample_prob"]).alias("row")
    rows = cells_of(docs, whole).join(probs, list(DIMS))
    times = F.array_repeat(F.lit(0), copies(F.col("doc_id"), F.col("prob")))
    return rows.select("row", "prob", F.explode(times)).select("row.*", F.col("prob").alias("sample_prob"))
