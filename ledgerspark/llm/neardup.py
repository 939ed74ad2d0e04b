"""Near-duplicates (operator 2) by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles (A-Z
lower-cased). Instead of ``LEFT * RIGHT`` bands with their own minhashes there
are two small collections of half keys, ``LEFT`` and ``RIGHT`` of them, each of
``ROWS`` minhashes; every pair (one of each) is a table key. 60 minhashes so
give 100 tables of 6 rows. Two sets of Jaccard similarity s share a key with
chance (1 - (1 - s^3)^10)^2: 0.998 at 0.8, 0.9999 at 0.85.

Equal sets are collapsed first. In ``HUB_ROUNDS`` first rounds every document
is checked on the full sets against one other of its keys, the same for most of
a group, which joins large groups at one check a document. The documents of table keys
that still hold different classes mostly share a common passage and too little
else, which no few minhashes tell apart. They go on under keys that do: the
``n - ceil(percent * n / 100) + 1`` rarest shingles of a set of n, of which two
linked sets share one at least in any order that is the same for all sets
(``rare_keys``), so no link is lost. Then, round by
round, each key that still holds sets of different classes gets leaders
(its 1, 4, 16, ... smallest ids); every other member of another class is
checked against them, confirmed links are merged into classes, and leaders, now
compared with all, leave the key. The rounds end when no key holds two classes,
so every candidate pair was compared, already in one class or without a shared
rare shingle, that is no link; a group of g
copies costs a few g checks, never its g * g pairs. Hot keys are only ever grouped by minima and limited
windows (partial before the shuffle) and joined as plain tables, which AQE
splits; a leader's checks are dealt to buckets of ``BUCKET`` members.

Defined cases: null or wordless text has an empty set and is linked with
nothing; fewer words than a shingle: the whole sequence is the one shingle;
rows that share an id are one document, linked by the sets of all of its rows; a
null id is linked with nothing and kept, component null; empty tables give empty results; extra columns are ignored.
``deduplicated_documents`` links rows, not ids: repeated and null ids take part
like any others, and one row of each class stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_back
from .common import MIX, WordHash, is_empty, materialize, mix64, shingle_hashes, with_row
from .graph import connected_components

LEFT, RIGHT, ROWS = 10, 10, 3
BUCKET = 500
HUB_ROUNDS = 3
#: Bits of a shingle hash that name its counter. Counters only order the shingles; those that share one cost checks, not links.
SLOT_BITS = 18
SEED = 0x5EED


def shingle_set(words: list[bytes], k: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.empty(0, np.uint64)
    ids = hashes.ids(words)
    if len(ids) < k:
        return shingle_hashes(ids + np.uint64(len(ids)), len(ids))
    return np.unique(shingle_hashes(ids, k))


def half_keys(s: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One hash per half key: ``ROWS`` minima of multiply-add hashes each."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):  # very long texts in slices
        np.minimum(low, (s[i : i + 2048, None] * mult + add).min(axis=0), out=low)
    key = np.zeros(len(mult) // ROWS, np.uint64)
    for r in range(ROWS):
        key = mix64(key * MIX + low[r::ROWS])
    return key


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = (LEFT + RIGHT) * ROWS
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        mult, add = _coefficients()
        for batch in batches:
            n, same, left, right = [], [], [], []
            for text in batch.column("text"):
                raw = text.as_py()
                s = shingle_set(raw.lower().split() if raw else [], k, hashes)
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                key = half_keys(s, mult, add).view(np.int64) if len(s) else np.empty(0, np.int64)
                left.append(key[:LEFT])
                right.append(key[LEFT:])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(left, longs), pa.array(right, longs)],
                names=["doc_id", "n_shingles", "same", "a", "b"])

    return run


def _confirm(k: int, percent: int):
    """Links of each bucket's members with its leader, whose text comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        at, leader = None, None
        for batch in batches:
            a, b, ok = [], [], []
            cols = (batch.column(c) for c in ("leader", "part", "member", "text"))
            for lead, part, member, text in zip(*cols, strict=True):
                lead, part, member = lead.as_py(), part.as_py(), member.as_py()
                s = shingle_set((text.as_py() or b"").lower().split(), k, hashes)
                if lead == member:
                    at, leader = (lead, part), s
                    continue
                assert at == (lead, part), "the leader of a bucket comes first"
                common = len(np.intersect1d(leader, s, assume_unique=True))
                a.append(lead)
                b.append(member)
                ok.append(100 * common >= percent * (len(leader) + len(s) - common))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


def confirm_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Which (leader, member) pairs are links; each text is sent once per pair it is in.

    A leader's members are dealt to buckets of about ``BUCKET``, each of which gets the leader's text too.
    """
    size = pairs.groupBy("leader").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts"))
    dealt = pairs.join(size, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), "parts").cast("int").alias("part"))
    leaders = size.select("leader", F.col("leader").alias("member"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = dealt.unionByName(leaders).join(texts, "member").withColumn("first", F.col("member") == F.col("leader"))
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "leader", "part").sortWithinPartitions("leader", "part", F.desc("first"), "member")
    return rows.select("leader", "part", "member", "text").mapInArrow(_confirm(k, percent), "a long, b long, linked boolean")


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _shingle_counts(k: int):
    """Sets that hold a shingle of each counter, summed over the task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        seen = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                seen += 0 if not (raw := text.as_py()) else np.bincount(_slots(shingle_set(raw.lower().split(), k, hashes)), minlength=len(seen))
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(seen[slots])], names=["slot", "n"])

    return run


def _rare(k: int, percent: int, seen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            keys, rests, sizes, takes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], []
            for text in batch.column("text"):
                s = shingle_set((text.as_py() or b"").lower().split(), k, hashes)
                n = len(s)
                sizes.append(n)
                takes.append(n + -percent * n // 100 + 1 if n else 0)
                keys.append(s[np.lexsort((s, seen[_slots(s)]))[: takes[-1]]].view(np.int64))
                rests.append(n - np.arange(takes[-1]))
            docs = np.repeat(batch.column("member").to_numpy(zero_copy_only=False), takes)
            cols = (np.concatenate(keys), docs, np.concatenate(rests), np.repeat(np.array(sizes, np.int64), takes))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "doc", "rest", "size"])

    return run


def rare_keys(bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """key, doc, rest, size: the rarest shingles of each of ``bodies`` (member, text), of which two that are linked share one.

    Linked sets share ``ceil(percent * n / 100)`` shingles at least, n the size of the larger one. So in one order
    of all shingles the first they share stands among the first ``n - ceil(percent * n / 100) + 1`` of both. ``rest``
    counts the set's shingles from this one on: under the first one that two sets share, both have ``common_needed``
    left. Keys under which a set has too few left for the smallest set of the key are left out.
    """
    bodies = materialize(bodies)
    few = bodies.coalesce(bodies.sparkSession.sparkContext.defaultParallelism)  # a row a counter and task
    total = few.mapInArrow(_shingle_counts(k), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(1 << SLOT_BITS, np.int32)
    seen[total["slot"].to_numpy(np.int64)] = np.minimum(total["n"].to_numpy(np.int64), np.iinfo(np.int32).max)
    rare = materialize(bodies.mapInArrow(_rare(k, percent, seen), "key long, doc long, rest long, size long"))
    low = rare.groupBy("key").agg(F.min("size").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rare.join(low, "key").where(common_needed("rest", "size", "low", percent)).drop("low")


def common_needed(rest, size, other, percent: int) -> Column:
    """Whether ``rest`` common shingles link sets of these sizes: 100 * rest >= percent * (size + other - rest)."""
    return (100 + percent) * F.col(rest) >= percent * (F.col(size) + F.col(other))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Linked: 100 * common shingles >= ``percent`` * all shingles of both. Where rows share an
    id, the rows are linked under written keys, and classes that share an id are joined.
    """
    shared = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if is_empty(shared):
        return linked_rows(docs, shingle, percent)
    key = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = materialize(docs.select("doc_id", "text", key.alias("_key")))
    got = materialize(linked_rows(rows.select(F.col("_key").alias("doc_id"), "text"), shingle, percent).withColumnRenamed("doc_id", "_key"))
    known = materialize(got.select("_key", "n_shingles", F.col("component_id").alias("class")).join(rows.select("_key", "doc_id"), "_key"))
    one = known.groupBy("doc_id").agg(F.min("class").alias("a"), F.count("*").alias("n")).where("n > 1")
    names = connected_components(known.join(one, "doc_id").where("class <> a").select("a", F.col("class").alias("b")).distinct())
    classes = known.select("class").distinct().join(names, F.col("class") == F.col("node"), "left").select(
        "class", F.coalesce("component", "class").alias("component"))
    sizes = known.groupBy("class").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).join(classes, "class")
    smallest = sizes.groupBy("component").agg(F.min("low").alias("component_id"))
    out = join_back(known, materialize(sizes.join(smallest, "component").select("class", "n", "component_id")), ["class"], "n")
    nameless = got.where("_key is null").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles",
                                                F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept")).unionByName(nameless)


def of_several_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` with their classes, of the keys that hold documents of two classes or more."""
    now = members.join(classes, members["doc"] == classes["node"], "left").select(*members.columns, F.coalesce("component", "doc").alias("class"))
    mixed = now.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
    return materialize(now.join(mixed, "key"))


def linked_rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` of rows whose ids, where they are not null, differ."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    sig = materialize(texts.mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, same binary, a array<long>, b array<long>"))
    known = sig.where("doc_id is not null and same is not null")
    # one document for each distinct set
    alike = materialize(known.groupBy("same").agg(F.min("doc_id").alias("one"), F.count("*").alias("n"), F.min(F.struct("doc_id", "a", "b")).alias("s")))
    keys = (alike.select(F.col("one").alias("doc"), F.posexplode("s.a").alias("i", "x"), "s.b")
            .select("doc", "i", "x", F.posexplode("b").alias("j", "y"))
            .select(F.xxhash64("i", "x", "j", "y").alias("key"), "doc"))
    shared = materialize(keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key"))
    members = materialize(keys.join(shared, "key"))
    same_set = known.join(alike.where("n > 1").select("same", "one"), "same").where("doc_id <> one").select(F.col("one").alias("a"), F.col("doc_id").alias("b"))

    wanted = members.select(F.col("doc").alias("member")).distinct()
    bodies = materialize(wanted.join(texts.select(F.col("doc_id").alias("member"), "text"), "member").dropDuplicates(["member"]))
    links = classes = None
    rounds, leaders_per_key = 0, 1
    while True:
        now = members.withColumn("class", F.col("doc"))
        if classes is not None:
            now = of_several_classes(members, classes)
            if rounds == HUB_ROUNDS and not is_empty(now):
                left = now.select(F.col("doc").alias("member")).distinct()
                now = of_several_classes(materialize(rare_keys(bodies.join(left, "member"), shingle, percent)), classes)
            if is_empty(now):
                break
        if rounds < HUB_ROUNDS:
            # each member meets one hub: of its keys' first members in an order drawn anew, the first
            order = F.struct(F.xxhash64("doc", F.lit(rounds)).alias("o"), "doc", "class")
            first = now.groupBy("key").agg(F.min(order).alias("hub"))
            met = now.join(materialize(first), "key").where("hub.class <> class")
            one = met.groupBy("doc").agg(F.min("hub").alias("hub"))
            pairs = one.select(F.col("hub.doc").alias("leader"), F.col("doc").alias("member"))
        else:
            rank = F.row_number().over(Window.partitionBy("key").orderBy("doc"))
            lead = materialize(now.withColumn("rank", rank).where(F.col("rank") <= leaders_per_key).select(
                "key", F.col("doc").alias("leader"), F.col("class").alias("leads"), F.col("rest").alias("left"), F.col("size").alias("leader_size")))
            enough = common_needed("rest", "size", "leader_size", percent) & common_needed("left", "size", "leader_size", percent)
            pairs = now.join(lead, "key").where(F.expr("leader < doc and leads <> class") & enough).select("leader", F.col("doc").alias("member")).distinct()
            leaders_per_key *= 4
        found = materialize(confirm_pairs(materialize(pairs), bodies, shingle, percent).where("linked").select("a", "b"))
        links = found if links is None else links.unionByName(found)
        classes = materialize(connected_components(links))
        if rounds >= HUB_ROUNDS:
            members = now.drop("class").join(lead.select("key", F.col("leader").alias("doc")), ["key", "doc"], "left_anti")
            members = materialize(members)
        else:
            members = now.select("key", "doc")
        rounds += 1
    # links are few rows a document; the classes of all copies in one last pass
    classes = connected_components(links.unionByName(same_set))
    out = sig.select("doc_id", "n_shingles").join(classes, sig["doc_id"] == classes["node"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each near-duplicate group (five-word shingles, 0.8).

    Of a group the row with the smallest doc_id stays (null ids last), of several such the one with the smallest row key.
    """
    rows = materialize(with_row(docs, F.monotonically_increasing_id().alias("_key")))
    classes = linked_rows(rows.select(F.col("_key").alias("doc_id"), F.col("row.text").alias("text")), 5, 80)
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), F.col("_key").alias("key"))
    seen = materialize(rows.select("_key", order.alias("order")).join(
        classes.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("class")), "_key"))
    several = seen.groupBy("class").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(several.select("class", F.col("first.key").alias("stays")))
    drop = materialize(seen.join(first, "class").where("_key <> stays").select("_key"))
    return rows.join(drop, "_key", "left_anti").select("row.*")


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: 2-word shingles, 0.8; one row per document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
