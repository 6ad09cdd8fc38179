import random

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import components
from warmstart.llm import near_dedup
from warmstart.llm.components import components as connected


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]  # shared by unrelated documents
    out = {}
    for g in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            if g % 5 == 0:
                w += passage
            out[len(out)] = " \n".join(x.upper() if rng.random() < 0.2 else x for x in w)
    return out


EDGE = {900: None, 901: "", 902: " \n\t", 903: "one two", 904: "One  TWO", 905: "one", 906: "é É é", 907: "é É é",
        908: "x" * 50_000, 909: "x " * 30_000, 910: "X " * 30_001}


@pytest.fixture(scope="module")
def data():
    return texts() | EDGE


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equals_brute_force(spark, data):
    got = near_dedup.near_duplicates(frame(spark, list(data.items()))).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(data)


def test_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"v{i}"
        rows[i] = " ".join(w)
    got = near_dedup.near_duplicates(frame(spark, list(rows.items()))).collect()
    assert {r["component_id"] for r in got} == {0}


def test_large_star_group(spark):
    """Copies that are each like the original, but not like each other: all of them are in its component."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = {0: " ".join(base)}
    for i in range(1, 1001):
        w = list(base)
        for j in rng.sample(range(3, 147), 3):
            w[j] = f"v{i}x{j}"
        rows[i] = " ".join(w)
    want = components({i: rows[i] for i in range(60)})  # brute force on a part; each further copy has 15 of 146 shingles changed
    assert {c for _, c in want.values()} == {0}
    got = near_dedup.near_duplicates(frame(spark, list(rows.items()))).collect()
    assert len(got) == 1001 and {r["component_id"] for r in got} == {0}


def test_crowded_range_without_links_equals_brute_force(spark, monkeypatch):
    """Many classes of one range that are not linked, and a few linked pairs among them; small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = {}
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(100), 4):
            w[j] = f"v{i}x{j}"
        rows[i] = " ".join(w)
    got = near_dedup.near_duplicates(frame(spark, list(rows.items()))).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows)


def test_repeated_rows_null_ids_and_extra_columns(spark):
    same = "a b c d e f g h i j"
    rows = [(1, same, "x"), (1, same, "x"), (None, same, "y"), (2, same + " k", "z"), (3, "q r s t u v", "w"),
            (3, "other words altogether in here now", "w"), (None, None, "n"), (None, "lonely words of a null id row", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("sig", F.lit(1))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["node"]) for r in kept.collect()) == [(0, "m"), (0, "n"), (1, "x"), (3, "w"), (3, "w")]


def test_drop_keeps_one_of_each_component(spark, data):
    want = components(data)
    kept = near_dedup.drop_near_duplicates(frame(spark, list(data.items()))).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, (n, c) in want.items() if c == i or n == 0)


def test_empty(spark):
    docs = frame(spark, [])
    assert near_dedup.near_duplicates(docs).count() == 0
    assert near_dedup.drop_near_duplicates(docs).columns == ["doc_id", "text"]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_cut_ranges_and_blocks(spark, monkeypatch):
    """Ranges in tiny blocks lose nothing; ranges cut by further values keep at least 0.9 of the linked documents' groups."""
    data = texts(9)
    want = components(data)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    got = near_dedup.near_duplicates(frame(spark, list(data.items()))).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    monkeypatch.setattr(near_dedup, "CROWDED", 4)
    got = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, list(data.items()))).collect()}
    linked = [i for i, (_, c) in want.items() if c != i]
    assert all(want[c][1] == want[i][1] for i, c in got.items())  # no false link
    assert sum(got[i] == want[i][1] for i in linked) >= 0.9 * len(linked)
