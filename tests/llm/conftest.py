import random

import pytest

WORDS = "the of and a to in is that for it as was on by with at from this be are or an have not but what all were when".split()


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): random prose, copies, near copies, shared passages and odd rows."""
    rng = random.Random(5)
    words = WORDS + ["w%d" % i for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, prose(rng.randint(3, 160)), "en", f"s{i % 3}") for i in range(60)]
    shared = prose(55)
    for i in range(60, 66):  # a passage of over 50 words in several texts
        out.append((i, prose(30) + " " + shared + "\n" + prose(20), "en", "s0"))
    for i in range(66, 72):  # exact and near copies
        out.append((i, out[i - 60][1], "de", "s1"))
    for i in range(72, 80):
        w = out[61][1].split()
        w[(i - 72) * 3] = "changed"
        out.append((i, " ".join(w), None, None))
    out += [(80, None, None, None), (81, "", "en", "s0"), (82, " \t\n ", "en", "s0"), (83, "One", "en", "s0"), (84, "One", "en", "s0"),
            (85, "12 34 !!", "en", "s2"), (86, " ".join(["again and"] * 3000), "en", "s2"), (87, "été À la Ça", "fr", "s2")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names are those of results."""
    extra = [(*r, len(r[1] or ""), 7, "x", 0.5, True) for r in rows]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string, score double, kept boolean")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def table_dir(spark, docs, rows, tmp_path_factory):
    """A folder of tables for the registered queries."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    bench = [(1, " ".join(rows[61][1].split()[32:60])), (2, "No such words anywhere here"), (3, None), (4, "one"), (None, "été à")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, i % 2, int(i % 5 == 1)) for i in range(0, 70)] + [(3, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d
