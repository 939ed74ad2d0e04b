"""Token ids, periodic runs and vector codes against direct versions and round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import orchard, runs, tokenids
from ledgerspark.llm.queries import llm_queries

# ---------------------------------------------------------------- op 11 ----

PIECES = ["a", "b", "Z", "é", "ß", "'", "s", "'ll", " ", "  ", "\n", "\t", "\r\n", "1", "23", ".", "!", "\x01", "\x1c", "\x85", "\xa0",
          "　", "日本", "<|endoftext|>", "<|", "́", "-", "é ", "x ", "�", "\U0001f600"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(tokenids.default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def _plain(vocabulary, texts):
    t = Tokenizer.from_str(vocabulary)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_encode_like_whole_texts(vocabulary):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    e = tokenids.Encoder(vocabulary)
    assert e.cuts
    for _ in range(2):  # met for the first time, and known
        assert [x.tolist() for x in e.encode(texts)] == _plain(vocabulary, texts)


def test_forgotten_pieces_and_small_chunks(vocabulary, monkeypatch):
    monkeypatch.setattr(tokenids, "MAX_PIECES", 20)
    monkeypatch.setattr(tokenids, "CHUNK_BYTES", 50)
    texts = [f"word{i} and other-words, {i}\nMore" * (i % 4) for i in range(60)] + ["x" * 5000, "", "tail"]
    assert [x.tolist() for x in tokenids.Encoder(vocabulary).encode(texts)] == _plain(vocabulary, texts)


def test_runs_of_letters_beyond_ascii(vocabulary):
    texts = [f"a {chr(c)}b{chr(c)} x{chr(c)}, {chr(c)} {chr(c)}'s 1{chr(c)}" for c in range(0xA0, 0x580)]
    texts += ["× ÷ a×b", "naïve été Straße", "привет, мир", "e\u0301te", "҃ а҃б", "γειά σου"]
    assert [x.tolist() for x in tokenids.Encoder(vocabulary).encode(texts)] == _plain(vocabulary, texts)


def test_pieces_that_came_back_are_kept(vocabulary, monkeypatch):
    monkeypatch.setattr(tokenids, "MAX_PIECES", 20)
    e = tokenids.Encoder(vocabulary)
    learned = []
    learn = e._learn
    e._learn = lambda: (learned.extend(e.waiting), learn())
    for i in range(12):
        text = " often été" + "".join(f" rare{chr(97 + j)}{chr(97 + i)}" for j in range(6))
        assert [x.tolist() for x in e.encode([text])] == _plain(vocabulary, [text])
    assert learned.count(b" often") == learned.count(" été".encode()) == 1
    assert len(e) <= 40 and len(learned) == 74


def _optimum(counts, limit):
    """Least total of bits under the limit: package-merge over explicit sets."""
    leaves = sorted((c, (i,)) for i, c in enumerate(counts) if c)
    made = leaves
    for _ in range(limit - 1):
        pairs = [(made[i][0] + made[i + 1][0], made[i][1] + made[i + 1][1]) for i in range(0, len(made) - 1, 2)]
        made = sorted(leaves + pairs)
    return sum(counts[i] for c, s in made[: 2 * len(leaves) - 2] for i in s)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=40), st.integers(6, 12))
def test_code_lengths_are_optimal(counts, limit):
    counts = np.array(counts)
    bits = tokenids.code_lengths(counts, limit)
    used = bits[counts > 0].astype(int)
    assert (bits[counts == 0] == 0).all() and (used > 0).all() and used.max(initial=0) <= limit
    if len(used) > 1:
        assert sum(2.0**-b for b in used) == 1.0
        assert (bits.astype(np.int64) * counts).sum() == _optimum(counts.tolist(), limit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.integers(1, 40))
def test_blocks_round_trip(ids, spacing):
    ids = np.array(ids, np.uint32)
    bits = tokenids.code_lengths(np.bincount(ids, minlength=1), 10)
    table, width = tokenids.decoding_table(bits)
    data = tokenids.pack(ids, bits, tokenids.code_words(bits), spacing)
    assert tokenids.unpack(data, table, width).tolist() == ids.tolist()


def test_too_many_symbols_for_the_limit():
    with pytest.raises(ValueError):
        tokenids.code_lengths(np.ones(9), 3)


def test_crc_shift():
    a, b = b"some words", b"x" * 1001
    assert tokenids.crc_shift(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def _digests(vocabulary, rows):
    out, start = [], 0
    for i, text in rows:
        ids = [*_plain(vocabulary, [text or ""])[0], 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, table_dir, rows, vocabulary):
    got = sorted(tuple(r) for r in llm_queries()["op11_token_ids"](spark, table_dir).collect())
    assert got == _digests(vocabulary, [r[:2] for r in rows])


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_token_files_of_odd_rows(spark, tmp_path, vocabulary, block):
    long = " ".join(f"long{i * 7919}" for i in range(30_000))
    rows = [(None, "null id"), (None, "null id"), (None, None), (3, long), (-2, "first"), (3, "again"), (3, "again"), (9, ""), (4, "<|endoftext|>x")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start int, ids string").coalesce(1)
    encoded, width = tokenids.encode_documents(df, vocabulary, shard_bytes=50_000)
    assert encoded.agg(F.count_distinct("shard")).first()[0] > 1 and width == "<u2"
    tokenids.write_files(encoded, width, str(tmp_path / "f"), block=block)
    order = [rows[i] for i in (0, 1, 2, 4, 3, 5, 6, 8, 7)]
    direct = _digests(vocabulary, order)
    got = tokenids.read_digests(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [tuple(r) for r in got] == direct
    parts = defaultdict(list)
    for r in tokenids.read_ids(spark, str(tmp_path / "f")).orderBy("start", "piece_start").collect():
        assert r["piece_start"] == len(parts[r["start"]])
        parts[r["start"]] += r["ids"]
    assert parts == {s: [*_plain(vocabulary, [t or ""])[0], 2] for (_, t), (_, s, _, _) in zip(order, direct, strict=True)}


def test_token_files_of_no_rows(spark, empty, tmp_path, vocabulary):
    encoded, width = tokenids.encode_documents(empty, vocabulary)
    tokenids.write_files(encoded, width, str(tmp_path / "f"))
    assert tokenids.read_digests(spark, str(tmp_path / "f")).count() == 0 == tokenids.read_ids(spark, str(tmp_path / "f")).count()


# ---------------------------------------------------------------- op 12 ----


def _runs(w):
    """Every stretch whose words recur one period later, under its smallest period."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def _fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_texts():
    rng = random.Random(3)
    texts = [_fibonacci(300), [b"x"] * 500, [*_fibonacci(500), b"z", *_fibonacci(200)], [], [b"one"], [b"a", b"b"] * 6, [b"a", b"b"] * 5 + [b"a"],
             [bytes([97 + bin(i).count("1") % 2]) for i in range(400)]]
    for _ in range(600):
        letters = [b"%d" % x for x in range(rng.choice([1, 2, 3, 5, 40]))]
        w = [rng.choice(letters) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            if w:
                a = rng.randrange(len(w))
                w[a:a] = w[a : a + rng.randint(1, 12)] * rng.randint(1, 6)
        texts.append(w)
    got = runs.runs_of_texts(texts)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [_runs(w) for w in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=6))
def test_runs_of_any_texts(texts):
    assert [[tuple(r) for r in g.tolist()] for g in runs.runs_of_texts(texts)] == [_runs(w) for w in texts]


def test_few_candidates_at_a_time_and_wrong_hashes(monkeypatch):
    texts = [_fibonacci(200), [b"x", b"y"] * 40]
    want = [_runs(w) for w in texts]
    monkeypatch.setattr(runs, "EXPAND", 5)
    tries = []
    real = runs.Extension

    class Colliding(real):
        def __init__(self, w, seed):
            super().__init__(w, seed)
            tries.append(seed)
            if seed == 1:  # every comparison says equal
                self.equal = lambda x, n, q: np.ones(len(x), bool)

    monkeypatch.setattr(runs, "Extension", Colliding)
    assert [[tuple(r) for r in g.tolist()] for g in runs.runs_of_texts(texts)] == want
    assert tries == [1, 2]


def test_a_long_text_and_chunks(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 1000)
    rng = random.Random(8)
    base = [b"w%d" % rng.randrange(3000) for _ in range(9000)]
    texts = [base[:700], base + base[100:4100] + base[100:4100], [b"a"] * 50, base[:400]]
    got = [g for part in runs._chunks(iter(texts)) for g in runs.runs_of_texts(part)]
    assert [[tuple(r) for r in g.tolist()] for g in got[2:]] == [[(0, 50, 1)], []]
    assert max(got[1].tolist(), key=lambda r: r[1])[1:] == [8000, 4000]


def _changed(i, words):
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
    return words


def _periodic(i, text):
    words = (text or "").encode().split()
    words = _changed(i, words) if i is not None else words
    found = _runs(words)
    gone = {j for s, n, q in found for j in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for j, w in enumerate(words) if j not in gone)))


def test_periodic_run_query(spark, table_dir, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in llm_queries()["op12_periodic_runs"](spark, table_dir).collect()}
    assert got == {r[0]: _periodic(*r[:2]) for r in rows}
    assert any(v[0] for v in got.values())


def test_periodic_runs_of_odd_rows(spark, docs, empty):
    df = spark.createDataFrame([(None, "a b " * 10), (None, None), (1, "x " * 20), (1, "x " * 20), (2, "")], "doc_id long, text string")
    got = sorted((r["row"]["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df).collect())
    assert got == [(0, [], ""), (0, [(0, 20, 2)], "a b"), (1, [(0, 20, 1)], "x"), (1, [(0, 20, 1)], "x"), (2, [], "")]
    assert runs.periodic_runs(docs).select("row.*").columns == docs.columns and runs.periodic_runs(empty).count() == 0


# ---------------------------------------------------------------- op 13 ----


def _codes(rows, parts=16, entries=64, rounds=2):
    """Plain product quantisation of (vec_id, vector, label) rows: all distances measured."""
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int), x) for i, v, x in rows]
    kept.sort(key=lambda r: (r[0], r[1].tolist()))
    size = len(kept[0][1]) // parts
    books = [[r[1][p * size : (p + 1) * size] for r in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((int(((v - e) ** 2).sum()), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in kept:
                v = v[p * size : (p + 1) * size]
                of[nearest(v, p)[1]].append(v)
            books[p] = [np.floor_divide(sum(of[k]), len(of[k])) if of[k] else e for k, e in enumerate(books[p])]
    out, by = [], defaultdict(int)
    for i, v, x in kept:
        got = [nearest(v[p * size : (p + 1) * size], p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), x))
        by[x] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e.tolist()).encode()).hexdigest()
    return sorted((i, code, err, by[x], digest) for i, code, err, x in out)


SCHEMA = "vec_id long, embedding array<float>, label int, error long, _v string, code int"


def _table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = llm_queries()["op13_vector_codes"](spark, str(tmp_path)).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 5), st.sampled_from([1, 3, 200]))
def test_orchard_finds_the_nearest(seed, entries, length, spread):
    rng = np.random.default_rng(seed)
    books = rng.integers(-spread, spread + 1, (2, entries, length))
    x = rng.integers(-spread - 1, spread + 2, (30, 2, length))
    far = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=-1)
    at, best = orchard.Lists(books).search(x)
    assert (at == far.argmin(axis=-1)).all() and (best == far.min(axis=-1)).all()


def test_vector_codes(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i * 3 % 200, rng.normal(size=32).round(2 if i % 4 else 0).tolist(), None if i % 5 == 0 else i % 3) for i in range(200)]
    odd = [(500, None, 1), (501, [], 1), (-9, [1.0] * 31 + [None], 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] * 32, None)]
    rows += [(7, rows[9][1], 2), rows[0]]  # a shared id and a repeated row
    assert _table(spark, tmp_path, rows + odd) == _codes(rows)


def test_few_vectors_of_an_odd_length(spark, tmp_path):
    got = _table(spark, tmp_path, [(2, [0.5] * 17, None), (1, [1e30] + [0.0] * 16, 4), (None, [0.25] * 17, None), (3, [1.0] * 5, 4)])
    assert [(r[0], r[2]) for r in got] == [(1, 0), (2, 0), (None, 0)]


def test_hot_label_is_split(spark, tmp_path):
    rows = [(i, [float(i % 7)] * 16, 1 if i % 3 else i) for i in range(120)]
    old = spark.conf.get("spark.ledgerspark.hotGroupRows", None)
    spark.conf.set("spark.ledgerspark.hotGroupRows", "10")
    try:
        assert _table(spark, tmp_path, rows) == _codes(rows)
    finally:
        spark.conf.set("spark.ledgerspark.hotGroupRows", old) if old else spark.conf.unset("spark.ledgerspark.hotGroupRows")


def test_no_vectors(spark, tmp_path):
    assert _table(spark, tmp_path, [(1, None, 1)]) == []


# ------------------------------------------------ earlier operators, mended ----


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (1, 0, 2, 4, 3)])
def test_near_duplicates_of_an_id_with_two_texts(spark, order):
    from ledgerspark.llm import neardup

    a = " ".join(f"w{i}" for i in range(40))
    x = " ".join(f"x{i}" for i in range(40))
    rows = [(1, a), (1, x), (2, a + " more"), (3, x), (None, a)]
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 2).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_the_end_of_a_text_is_always_counted(spark):
    from ledgerspark.llm import lm

    df = spark.createDataFrame([(1, "a a a a a b b b b")], "doc_id long, text string")
    r = lm.score_texts(df, df, frequent=2).first()
    base = sum(n * np.log10((n + 1) / (10 + 4)) for n in (5, 4, 1))
    assert (r["n_tokens"], r["n_known"]) == (10, 10) and r["base_score"] == pytest.approx(base)
