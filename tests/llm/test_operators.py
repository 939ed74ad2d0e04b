"""Each operator against a direct version, on rows with nulls, empty and very
long texts, ties, repeated rows, clashing columns, and on empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import ann, decontam, graph, langid, lm, mixing, neardup, quality, substrings, toxicity, urlfilter
from ledgerspark.llm.queries import llm_queries

CONTRACT = {
    "op2_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op3_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_quality_classifier": ["doc_id", "votes", "weak_label", "score", "kept"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_gives_one_row_per_document(spark, table_dir, rows, name):
    df = llm_queries()[name](spark, table_dir)
    assert df.columns == CONTRACT[name]
    assert sorted(r["doc_id"] for r in df.collect()) == [r[0] for r in rows]


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in llm_queries()) == list(range(1, 14))


# ---------------------------------------------------------------- op 2 ----

def _sets(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def _classes(sets):
    best = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and best[a] != best[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    best[a] = best[b] = min(best[a], best[b])
                    changed = True
    return best


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, k):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, k).collect()}
    sets = _sets([r[:2] for r in rows], k)
    assert {i: r["component_id"] for i, r in got.items()} == _classes(sets)
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_of_repeated_and_null_ids(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t), (3, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 2).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_one_row_of_each_near_duplicate_group_stays(spark):
    t, u = "a b c d e f g", "one two three four five six seven eight"
    rows = [(None, t), (2, t), (1, u), (1, t), (1, t), (None, u + " u"), (None, "x"), (3, "x"), (None, "y"), (None, "y"), (4, None), (4, None), (None, None)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, n long")
    got = neardup.deduplicated_documents(df)
    assert got.columns == df.columns
    assert sorted(r["n"] for r in got.collect()) == [2, 3, 7, 8, 10, 11, 12]  # rows 2 and 5: 4 of 5 shingles
    assert neardup.deduplicated_documents(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}


# ---------------------------------------------------------------- op 3 ----

def test_substrings(docs, rows):
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == substrings.brute_force([r[:2] for r in rows])


def test_substrings_of_null_and_shared_ids(spark):
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    shared, long = prose(30), prose(600)
    rows = [(None, long + " " + shared), (None, prose(10)), (None, None), (None, long + " " + shared), (7, shared + " " + prose(40)),
            (7, prose(5)), (7, prose(500) + " " + shared), (7, shared + " " + prose(40)), (None, prose(50)), (2, shared)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, n long")
    got = {r["row"]["n"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(df, shard_bytes=2000).collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    direct = substrings.brute_force([(at, rows[i][1]) for at, i in enumerate(order)])
    assert got == {i: direct[at] for at, i in enumerate(order)}
    assert got[3] == (630, 630, "") and got[9][1] == 0 and got[7][1] == 30


def test_substring_digest(spark, table_dir, rows):
    direct = substrings.brute_force([r[:2] for r in rows])
    for r in llm_queries()["op3_substring_dedup"](spark, table_dir).collect():
        assert r["kept_sha256"] == hashlib.sha256(direct[r["doc_id"]][2].encode()).hexdigest()


def test_named_phrase_is_the_first_of_the_smallest():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 4, 200).astype(np.uint64) * np.uint64(0x123456789ABCDEF)
    g = substrings.shingle_hashes(h, 6) >> np.uint64(24)
    direct = [i + int(np.argmin(g[i : i + 15])) for i in range(181)]
    assert substrings.named(h, 20, 6).tolist() == direct


def test_rolling_hash():
    ids = np.random.default_rng(4).integers(0, 1 << 63, 60).astype(np.uint64)
    for k in (1, 6, 20, 32, 60):
        direct = [np.uint64(0)] * (61 - k)
        for i in range(61 - k):
            for x in ids[i : i + k]:
                direct[i] = np.uint64((int(direct[i]) * int(substrings.MIX) + int(x)) % 2**64)
        assert substrings.rolling(ids, k).tolist() == [int(x) for x in direct]
    assert not len(substrings.rolling(ids, 61))


def _shard(texts, chunk, monkeypatch):
    """Blocks of one shard in which every named phrase recurs."""
    monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
    keys = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([keys, pa.array([t.encode() for t in texts])], names=["key", "text"])
    named = pa.Table.from_batches(substrings._anchors(20, 6)([batch]))
    docs = pa.table({"key": keys, "doc": keys, "text": batch.column("text")})
    return sorted(named.to_pylist(), key=str), substrings._locate(20, 6)(docs, named).to_pylist()


def test_windows_travel_in_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, n)) for n in (300, 19, 90, 20, 700)]
    texts.append(texts[0])
    anchors, blocks = _shard(texts, 1 << 17, monkeypatch)
    assert (anchors, blocks) == _shard(texts, 50, monkeypatch)  # however many texts are hashed at a time
    for k, t in enumerate(texts):  # every window once, in its place
        starts = sorted(b["start"] + i for b in blocks if b["key"] == k for i in range(b["n"]))
        assert starts == list(range(len(t.split()) - 19))
        assert all(len(b["windows"]) == b["n"] for b in blocks)
    assert len(blocks) * 5 < sum(b["n"] for b in blocks)
    same = [[(b["block"], b["start"]) for b in blocks if b["key"] == k] for k in (0, 5)]
    assert same[0] == same[1]  # a copy repeats the blocks, so none of its windows is expanded


# ---------------------------------------------------------------- op 4 ----

def test_nearest_with_equal_odd_and_null_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 16))
    v[500:560] = v[7]  # one very common vector
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [1.0, None] + [0.0] * 14), (1003, [math.nan] * 16), (1004, [math.inf] * 16),
             (1100, [1.0, 2.0]), (None, [1.0] * 16), (3, rows[3][1])]
    vec = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.nearest(vec, vec.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector"), shard=256).collect()
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(m[2] - d[m[1]]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & set(want))
        if q == 500:
            assert [m[1] for m in mine] == want  # ties go to the smaller id
    assert hits >= 0.9 * 90
    assert not [r for r in got if r["query_id"] == 1100]  # nothing of its length
    assert ann.nearest(vec.limit(0), vec.limit(0).select(F.col("vec_id").alias("query_id"), "vector")).count() == 0


def test_blocks_of_queries_stream_past_shards(spark, monkeypatch):
    """All pairs of blocks and shards are never held at once, nor a graph carried beside each of its blocks."""
    monkeypatch.setattr(ann, "BLOCK", 4)
    rng = np.random.default_rng(5)
    many = [(i, rng.normal(size=6 if i % 7 else 4).tolist()) for i in range(300)]
    vec = spark.createDataFrame(many, "vec_id long, vector array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in many if i % 10 == 0] + [(1000, [1.0] * 5)], "query_id long, vector array<double>")
    found = ann.nearest(vec, asked, k=3, shard=64)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[plan.index("MapInArrow") :]  # below the search
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, v in ((i, v) for i, v in many if i % 10 == 0):
        by = sorted((float(np.linalg.norm(np.array(v) - w)), i) for i, w in many if len(w) == len(v) and i != q)
        assert sorted(got[q]) == [(n + 1, i) for n, (_, i) in enumerate(by[:3])]
    assert 1000 not in got  # of a length that no shard has


# ---------------------------------------------------------------- op 5 ----

def test_language_model(spark, table_dir, rows):
    got = {r["doc_id"]: r for r in llm_queries()["op5_lm_scoring"](spark, table_dir).collect()}
    toks = {i: (t or "").encode().lower().split() + [b" end"] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert got[i]["score"] < 0


def test_rare_tokens_meet_their_counts_in_the_join(docs):
    a = {r["row"]["doc_id"]: r for r in lm.score_texts(docs, docs, frequent=8).collect()}
    b = {r["row"]["doc_id"]: r for r in lm.score_texts(docs, docs).collect()}
    assert all(a[i]["n_known"] == b[i]["n_known"] and a[i]["base_score"] == pytest.approx(b[i]["base_score"], rel=1e-9) for i in b)


def test_unit_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    u = rng.random(lm.UNITS)
    m = lm.Model(u / u.sum())
    m.parts[2] *= 50  # large scores
    ctx = np.repeat(rng.integers(0, lm.UNITS, (1, lm.CONTEXT)), lm.UNITS, axis=0)
    assert np.exp(m.log_probs(ctx, np.arange(lm.UNITS))).sum() == pytest.approx(1, abs=1e-4)


def test_training_learns_from_every_position():
    texts = ["a b c", "d e", "", None, "a b c d e f g " * 9]
    tokens = np.concatenate([lm.Codes().of(t and t.encode()) for t in texts])
    codes, n = np.unique(tokens, return_counts=True)
    vocab = lm.Vocabulary(list(zip(codes.view(np.int64).tolist(), n.tolist(), strict=True)), {}, len(tokens), len(codes))
    batch = pa.RecordBatch.from_arrays([pa.array([t and t.encode() for t in texts], pa.binary())], names=["text"])
    (out,) = lm._train(vocab, lm.Model(vocab.unigram).flat(), 0.1)(iter([batch]))
    assert out.column("w")[0].as_py() == len(tokens)


def test_scores_stay_finite_in_a_strongly_trained_model():
    m = lm.Model(np.full(lm.UNITS, 1 / lm.UNITS))
    m.parts[2][5] = 400  # one unit far above the others in some contexts, far below in others
    ctx = np.random.default_rng(1).integers(0, lm.UNITS, (500, lm.CONTEXT))
    assert np.isfinite(m.log_probs(ctx, np.zeros(500, int))).all()


# ---------------------------------------------------------------- op 6 ----

def test_urls(spark):
    pages = [(1, "http://a.example.org/es/1", '<a href="http://bad.com/de/x">'), (2, "https://WWW.Example.org/en/17?q#f", None), (3, "//nohost", ""),
             (4, None, None), (5, "http://bad.com/de/1", '<a href=//ok.net/>'), (6, "http://ok.net", ""), (7, "x://only.com#/de/", ""),
             (8, "http://friend.net/a", "<a href='HTTP://bad.com/'>" * 3), (5, "http://bad.com/de/1", None), (9, "http://notorg/", ""), (10, "http://q.org", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df).collect()}
    assert got == urlfilter.brute_force(pages)
    assert got[1][2:] == ("example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[8][3] == "block" and got[3] == got[4] == ("", "", None, "allow") and got[10][2] is None
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def test_trust_and_distrust_settle_on_a_long_chain(spark):
    n, last = 14, "http://bad.com/de/"  # each host links to the next, the last to the blocked one; one allowed host links to the third
    hosts = [f"h{i}.net" for i in range(n)]
    pages = [(i, f"http://{h}/", f"<a href='{'http://' + hosts[i + 1] + '/' if i + 1 < n else last}'>") for i, h in enumerate(hosts)]
    pages += [(n, last, ""), (n + 1, "http://ok.org/", f"<a href='http://{hosts[2]}/'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df).collect()}
    assert {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()} == urlfilter.brute_force(pages)
    names = [*hosts, "bad.com", "ok.org"]
    links = np.zeros((n + 2, n + 2))
    for i in range(n):
        links[i, i + 1] = 1
    links[n + 1, 2] = 1
    trust = np.linalg.solve(np.eye(n + 2) - 0.85 * (links / np.maximum(links.sum(1, keepdims=True), 1)).T, 0.15 * np.eye(n + 2)[n + 1])
    distrust = np.linalg.solve(np.eye(n + 2) - 0.85 * (links / np.maximum(links.sum(0, keepdims=True), 1)), 0.15 * np.eye(n + 2)[n])
    for i in range(n + 2):
        assert got[i]["host"] == names[i]
        assert (got[i]["trust"], got[i]["distrust"]) == pytest.approx((trust[i], distrust[i]), abs=1e-5)
    assert got[0]["verdict"] == got[1]["verdict"] == "block" and got[2]["verdict"] == "allow"


# ---------------------------------------------------------------- op 7 ----

def test_language_id(docs, empty):
    got = {r["row"]["doc_id"]: r for r in langid.identify(docs, docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (80, 81, 82, 85))
    assert got[87]["lang_pred"] == "fr" and all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.identify(docs, empty).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and langid.identify(empty, empty).count() == 0


def test_out_of_place_distance():
    table = langid.letters_table()
    g = langid.grams(langid.characters("aab", table)).tolist()  # a a b, _a aa ab b_, _aa aab ab_
    order = [x for x, _ in sorted(Counter(g).items(), key=lambda x: (-x[1], x[0]))]
    langs, ranks = langid.rank_table({"x": order, "y": order[::-1]}, 50)
    far = sum(abs(i - (len(order) - 1 - i)) for i in range(len(order)))
    assert langid.classify("AAB", table, langs, ranks, 50) == ("x", 1.0)
    langs, ranks = langid.rank_table({"y": order[::-1]}, 50)
    assert langid.classify("a-a-b".replace("-", ""), table, langs, ranks, 50) == ("y", 1 - far / (50 * len(order)))


def test_every_letter_of_unicode_is_one():
    table = langid.letters_table()
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    assert max(letters) < langid._TOP and all(table[c] == c for c in letters)
    langs, ranks = langid.rank_table({"x": [1, 2, 3]}, 50)
    assert langid.classify(chr(0x30000) * 5, table, langs, ranks, 50)[0] == "x"
    assert langid.classify(chr(0x10FFFD) * 5, table, langs, ranks, 50) == ("und", 0.0)


# ---------------------------------------------------------------- op 8 ----

def test_quality(docs, empty):
    got = {r["row"]["doc_id"]: r for r in quality.score_quality(docs).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[80]["votes"] == got[81]["votes"] == "-" * 7 + "0"
    assert quality.score_quality(empty).count() == 0


def test_quality_features_and_scores_directly(spark, docs, rows):
    """Written votes, features and counts of every text; scores from them by hand; training rows of their own."""
    import re
    from collections import Counter as Count

    import xxhash

    mask = (1 << quality.FEATURE_BITS) - 1
    texts = quality.parsed(docs, ["doc_id"])
    assert texts.columns == ["row", "votes", "ids", "n"] and texts.schema["row"].dataType.names == ["doc_id"]
    posterior, weights = quality.fit_quality(texts)
    got = {r["row"]["doc_id"]: r for r in texts.collect()}
    scored = {r["row"]["doc_id"]: r for r in quality.score_quality(docs, carry=["doc_id"]).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        want = Count()
        for w in raw.split():
            shape = re.sub(rb"(.)\1+", rb"\1", w.translate(quality._SHAPE))
            want.update([xxhash.xxh3_64_intdigest(w) & mask, xxhash.xxh3_64_intdigest(b" " + shape) & mask])
        assert dict(zip(got[i]["ids"], got[i]["n"], strict=True)) == want and got[i]["votes"] == quality.votes(raw)
        norm = sum(x * x for x in want.values()) ** 0.5
        s = sum(weights[f] * x / norm for f, x in want.items()) + weights[-1]
        assert abs(scored[i]["score"] - 1 / (1 + np.exp(-s))) < 1e-9 and scored[i]["weak_label"] == posterior[scored[i]["votes"]]
    other = quality.score_quality(docs, docs.where("doc_id < 3"))
    assert other.count() == len(rows) and 0 <= other.agg(F.min("score")).first()[0]


def test_weak_labels_find_the_accurate_labellers():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.7
    accuracy = [0.95, 0.9, 0.8, 0.55]
    v = ["".join("-" if rng.random() < 0.2 else str(int(t == (rng.random() < a))) for a in accuracy) for t in y]
    posterior, share, chance = quality.weak_labels(Counter(v))
    assert abs(share - 0.7) < 0.05 and chance[1, 0, 1] > chance[1, 3, 1]
    assert np.mean([(posterior[k] > 0.5) == t for k, t in zip(v, y, strict=True)]) > 0.92


# ---------------------------------------------------------------- op 9 ----

def test_toxicity(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        w = [f"w{x}" for x in rng.integers(0, 300, 60)]
        toxic = i % 4 == 0
        if toxic:
            w[20:22] = ["Scum,", "idiot!"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(400, None), (401, ""), (402, "idiot scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(9))
    lab = spark.createDataFrame(labels[:300] + [(0, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    got = {r["row"]["doc_id"]: r for r in toxicity.score_toxicity(docs, lab).collect()}
    assert all((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert got[400]["score"] == got[401]["score"] < 0.5 < got[402]["score"]
    assert [(s["start"], s["end"]) for s in got[304]["segments"] if s["chance"] < 0.05] == [(20, 22)]
    none = toxicity.score_toxicity(docs, lab.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.0] and toxicity.score_toxicity(docs.limit(0), lab).count() == 0


def test_log_odds_of_every_word(spark):
    """Own and shared entries hold all counts; a text's own words are taken out of its calibration scores."""
    rng = np.random.default_rng(8)
    n = [(int(c), int(x), int(y)) for c, x, y in zip(rng.integers(-(1 << 62), 1 << 62, 200), rng.integers(0, 9, 200), rng.integers(0, 9, 200), strict=True)]
    counts = spark.createDataFrame(n, "code long, clean long, toxic long")
    code, clean, toxic = (np.array(x) for x in zip(*n, strict=True))
    for own in (0, 50, 1000):
        odds = toxicity.log_odds(counts, 1.0, 0.5, own, 4)
        assert odds.counts.sum(axis=1).tolist() == [clean.sum(), toxic.sum()]
    total = np.array([clean.sum(), toxic.sum()])
    more = total / total.sum()
    want = np.log((toxic + more[1]) / total[1]) - np.log((clean + more[0]) / total[0]) - 0.5
    np.testing.assert_allclose(odds.of(code.view(np.uint64)), want)
    twice = odds.without(np.repeat(code.view(np.uint64), 2)[:2], 0) if clean[0] >= 2 else None
    if twice is not None:
        np.testing.assert_allclose(twice, np.log((toxic[0] + more[1]) / total[1]) - np.log((clean[0] - 2 + more[0]) / total[0]) - 0.5)
    np.testing.assert_allclose(odds.of(np.array([12345], np.uint64)), [-0.5])  # never seen


def test_label_filter_passes_every_label(spark):
    known = spark.range(0, 5000, 7).withColumnRenamed("id", "doc_id")
    held = toxicity.LabelFilter(known)
    h = spark.range(5000).select(toxicity.id_hash("id").alias("h")).toArrow().column("h").to_numpy()
    ok = held.may_hold(h)
    assert ok[::7].all() and ok.mean() < 0.2
    assert not toxicity.LabelFilter(known.limit(0)).may_hold(h).any()


def test_maximal_segments():
    rng = np.random.default_rng(6)
    scores, rest = {b"a": 1.37, b"b": 2.71}, -0.61

    def direct(lo, hi, s):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                t = sum(s[i:j])
                if t > 0 and (best is None or t > best[2] + 1e-9):
                    best = (i, j, t)
        return [] if best is None else direct(lo, best[0], s) + [best[:2]] + direct(best[1], hi, s)

    for _ in range(100):
        s = [[scores[b"a"], scores[b"b"], rest, rest, -0.03, -2.3][k] for k in rng.integers(0, 6, rng.integers(0, 20))]
        assert sorted((a, b) for a, b, _ in toxicity.segments(np.array(s))) == direct(0, len(s), s)


# --------------------------------------------------------------- op 10 ----

def test_decontamination(spark, docs, rows, table_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in llm_queries()["op10_decontaminate"](spark, table_dir).collect()}
    bench = spark.read.parquet(f"{table_dir}/benchmark.parquet")
    items = [("null" if r["item_id"] is None else r["item_id"], r["text"]) for r in bench.collect()]
    want = decontam.brute_force([r[:2] for r in rows], items)
    assert got == want and sum(x[4] for x in want.values()) >= 6
    parts = decontam.find_contamination(docs, bench, shard_words=50, part_bytes=40).collect()  # many shards, many passes
    assert {r["row"]["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in parts} == {i: x[:3] for i, x in want.items()}
    assert decontam.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_fm_index_against_search():
    rng = np.random.default_rng(8)
    seq = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(20)]).astype(np.int32)
    index = decontam.FMIndex(seq, 5)
    for _ in range(60):
        p = rng.integers(1, 6, rng.integers(1, 5))
        lo, hi = index.search(p[None, :], np.array([len(p)]))
        found = sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0]))).tolist())
        assert found == [i for i in range(len(seq) - len(p) + 1) if (seq[i : i + len(p)] == p).all()]


# ---------------------------------------------------------------- op 1 ----

def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["prob"] <= 1 for r in got)
    total, kept = sum(r["n_tokens"] for r in got), sum(r["n_tokens"] * r["prob"] for r in got)
    assert kept == pytest.approx(mixing.BUDGET * total, rel=1e-6)
    direct = {r["doc_id"]: int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:12], 16) / 2**48 < r["prob"] for r in got}
    assert {r["doc_id"]: r["sampled"] for r in got} == direct
    assert mixing.mix(empty).count() == 0 and mixing.sampled_documents(empty).count() == 0


def test_raking_meets_every_margin(spark):
    cells = [(s, g, t, 10 + 7 * i) for i, (s, g, t) in enumerate((s, g, t) for s in "abc" for g in "xy" for t in "pq")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, n_tokens long")
    goals = {"source": [("a", 5.0), ("b", 3.0), ("c", 2.0), ("none", 1.0)], "lang": [("x", 1.0), ("y", 3.0)], "topic": [("p", 0.5), ("q", 0.5)]}
    tables = {d: spark.createDataFrame(v, f"{d} string, target double") for d, v in goals.items()}
    got = mixing.rake(df, tables, rounds=40).collect()
    for d, v in goals.items():
        v = [x for x in v if x[0] != "none"]
        for name, goal in v:
            assert sum(r["weight"] for r in got if r[d] == name) == pytest.approx(goal / sum(x[1] for x in v), rel=1e-5)


def test_sample_meets_targets_that_need_repeats(spark):
    rows = [(i, "word " * (20 + i % 7), "rare" if i % 30 == 0 else "big", "xy"[i // 30 % 2], "pq"[i % 7 > 4]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    goals = {"source": {"rare": 0.5, "big": 0.5}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"p": 0.8, "q": 0.2}}
    tables = {d: spark.createDataFrame(list(v.items()), f"{d} string, target double") for d, v in goals.items()}
    got = mixing.mix(df, tables, repeats=True).collect()
    total = sum(r["n_tokens"] for r in got)
    for d, v in goals.items():
        for name, goal in v.items():
            assert sum(r["n_tokens"] * r["rate"] for r in got if r[d] == name) == pytest.approx(goal * mixing.BUDGET * total, rel=1e-5)
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 and r["sampled"] == (r["copies"] > 0) for r in got)
    taken = Counter(r["doc_id"] for r in mixing.sampled_documents(df, tables).collect())
    assert taken == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]}) and max(taken.values()) > 1
    tokens = sum(r["n_tokens"] * r["copies"] for r in got if r["source"] == "rare")
    assert tokens == pytest.approx(0.25 * total, rel=0.1)


def test_raking_reports_targets_that_contradict(spark, caplog):
    df = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], "source string, lang string, topic string, n_tokens long")
    goals = {"source": [("a", 0.5), ("b", 0.5)], "lang": [("x", 0.9), ("y", 0.1)], "topic": [("p", 1.0)]}
    mixing.rake(df, {d: spark.createDataFrame(v, f"{d} string, target double") for d, v in goals.items()})
    assert "targets not met" in caplog.text


def test_text_measures():
    assert mixing.measure(None) == mixing.measure(b"") == mixing.measure(b" \t\n") == (0, "short")
    assert mixing.measure(("wort " * 60).encode()) == (60, "prose")
    assert mixing.measure("größe straße".encode()) == (2, "short")  # letters beyond ASCII are letters
    assert mixing.measure(b"a | b | c |") == (6, "list")
    assert mixing.measure("§§ €€ 12 a".encode()) == (4, "symbols")
    assert mixing.measure(b"\xff\xfe word") == (2, "symbols")  # broken bytes are no letters
