"""Checks per document where many texts share a passage and too little else."""

import numpy as np

from ledgerspark.llm import neardup as N
from ledgerspark.llm.common import WordHash


def _family(n: int = 120, variants: int = 20) -> list[tuple[int, str]]:
    common = [f"c{i}" for i in range(30)]
    texts = [common + [f"d{i}w{j}" for j in range(12)] for i in range(n)]
    texts += [t[:-1] + [f"v{i}"] for i, t in enumerate(texts[:variants])]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def _components(rows, k=2, percent=80):
    hashes = WordHash()
    sets = [set(N.shingle_set(t.encode().split(), k, hashes).tolist()) for _, t in rows]
    own = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((own[a], own[b]))
                own = [low if x == high else x for x in own]
    return own


def test_texts_with_a_common_passage_are_checked_a_few_times_each(spark, monkeypatch):
    checked = []

    def confirm(pairs, *rest, kept=N.confirm_pairs):
        checked.append(pairs.count())
        return kept(pairs, *rest)

    monkeypatch.setattr(N, "confirm_pairs", confirm)
    rows = _family()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, 2).collect()}
    assert [got[i] for i, _ in rows] == _components(rows)
    # before: 13,686 checks in all
    assert sum(checked) <= 5 * len(rows)


def test_linked_sets_share_a_rare_key_with_enough_left(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(40):  # edits at random places: similarities on both sides of 0.8
        words = list(base[: int(rng.integers(50, 61))])
        for at in rng.choice(len(words), int(rng.integers(0, 7)), replace=False):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    hashes = WordHash()
    sets = [set(N.shingle_set(t.encode().split(), 2, hashes).tolist()) for _, t in rows]
    bodies = spark.createDataFrame([(i, t.encode()) for i, t in rows], "member long, text binary")
    under: dict = {}
    for r in N.rare_keys(bodies, 2, 80).collect():
        under.setdefault(r.doc, {})[r.key] = r.rest
    linked = 0
    for a in range(40):
        for b in range(a + 1, 40):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                linked += 1
                shared = under.get(a, {}).keys() & under.get(b, {}).keys()
                assert any(180 * min(under[a][s], under[b][s]) >= 80 * (len(sets[a]) + len(sets[b])) for s in shared), (a, b)
    assert 20 < linked < 700
