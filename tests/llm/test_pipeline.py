"""Each stage of the pipeline: its columns, and its decisions against a direct version."""

import corpus_pipeline as P
from ledgerspark.llm import decontam, substrings


def test_stages(spark, docs, table_dir, rows):
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "decontaminate", "mix_sources"]
    at, seen = docs, {}
    for name, stage in P.STAGES:
        at = P.materialize(stage(spark, at, table_dir))
        seen[name] = {r["doc_id"]: r for r in at.collect()}
        assert at.columns == docs.columns + (["sample_prob"] if name == "mix_sources" else [])
    text = {r[0]: r[1] for r in rows}
    assert set(text) - set(seen["language_id"]) == {80, 81, 82, 85}
    left = seen["near_dedup"]
    assert {66, 67, 68, 69, 70, 71, 84}.isdisjoint(left) and {6, 7, 8, 9, 10, 11, 83, 61} <= set(left)
    direct = substrings.brute_force([(i, r["text"]) for i, r in left.items()])
    for i, (n, gone, kept) in direct.items():
        if gone < n or not gone:
            r = seen["substring_dedup"][i]
            assert r["text"] == (kept if gone else text[i]) and r["n_chars"] == len(r["text"])
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{table_dir}/benchmark.parquet").collect()]
    hits = decontam.brute_force([(i, r["text"]) for i, r in seen["substring_dedup"].items()], bench)
    assert set(seen["decontaminate"]) == {i for i, h in hits.items() if not h[4]}
    assert all(seen["decontaminate"][i]["text"] == seen["substring_dedup"][i]["text"] for i in seen["decontaminate"] if not hits[i][1])
    assert set(seen["mix_sources"]) <= set(seen["decontaminate"])
    assert {r["doc_id"] for r in P.run(spark, table_dir).collect()} == set(seen["mix_sources"])


def test_empty_documents(spark, docs, table_dir):
    at = docs.limit(0)
    for _, stage in P.STAGES:
        at = stage(spark, at, table_dir)
    assert at.count() == 0


def test_cutting_keeps_the_rest_of_the_text():
    assert decontam.cut_spans("One, two (three) four.\nfive", [{"start": 1, "end": 3}]) == "One, ) four.\nfive"
