import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import brute
from warmstart.llm import conversations, periodic, queries, simhash
from warmstart.llm.words import word_lists


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


EDGE = {900: None, 901: "", 902: " \n\t", 903: "one two", 904: "One  TWO", 905: "é É é ß", 906: "x" * 50_000, 907: "x " * 30_000,
        908: "a b c d", 909: "A\tB\x0bC\x0cD\r"}


# ---------------------------------------------------------------- SimHash
def near_texts(seed=5):
    rng, out = random.Random(seed), {}
    for _ in range(40):
        base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "new"
            out[len(out)] = "\n ".join(w)
    return out


def test_simhash_equals_brute_force(spark):
    data = near_texts() | EDGE
    prints = {i: brute.simhash(t) for i, t in data.items()}
    got = simhash.near_duplicates(frame(spark, list(data.items()))).collect()
    assert {r["id"]: r["print"] % 2**64 for r in got} == prints
    assert {r["id"]: r["component_id"] for r in got} == brute.near_prints(prints)


def test_simhash_of_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "word_lists", lambda data: word_lists(data, 50))
    assert simhash.fingerprint(text.encode()) == whole == brute.simhash(text)
    assert [w for part in word_lists(b" a bb  ccc\nd", 2) for w in part] == [b"a", b"bb", b"ccc", b"d"]


@pytest.mark.parametrize("crowded", [2, 8, 1024])
def test_crowded_postings_lose_no_link(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng, prints = random.Random(crowded), set()
    for base in [rng.getrandbits(64) for _ in range(4)] + [0]:
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {x & 0xFFFFFFFF for x in list(prints)[:40]} | {2**63 + i for i in range(40)}
    rows = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "print long")
    from warmstart.llm.components import components

    got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(rows)).collect()}
    want = brute.near_prints({x: x for x in prints})
    groups = lambda of: {frozenset(k for k in prints if of(k) == v) for v in {of(k) for k in prints}}
    assert groups(lambda x: got.get(x, x)) == groups(want.get)


def test_position_sets_reach_every_pair():
    from itertools import combinations

    sets = [p for g in simhash._GROUPS for p in combinations(g, 2)]
    for four in combinations(range(8), 4):
        level = [p for p in sets if set(p) <= set(four)]
        assert level
        for _ in range(2):  # whichever of them is crowded, a deeper one reaches the pair
            assert all(any(set(q) <= set(four) for q in simhash._deeper(p)) for p in level)
            level = [q for p in level for q in simhash._deeper(p) if set(q) <= set(four)]


def test_simhash_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    got = simhash.near_duplicates(frame(spark, [(None, "a b"), (7, "a b"), (7, "a b"), (3, None), (None, None)])).collect()
    assert sorted((r["id"] or 0, r["component_id"]) for r in got) == [(0, 3), (0, 7), (3, 3), (7, 7), (7, 7)]
    extra = frame(spark, [(1, "a b")]).withColumn("id", F.lit(5)).withColumn("print", F.lit("x")).withColumn("node", F.lit(1))
    assert [r["id"] for r in simhash.near_duplicates(extra).collect()] == [1]


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COPIES", 5)
    got = simhash.near_duplicates(frame(spark, [(i, "one two three four five") for i in range(50)] + [(99, "six")])).collect()
    assert {r["id"]: r["component_id"] for r in got} == {i: 0 for i in range(50)} | {99: 99}


# ---------------------------------------------------------------- periodic runs
def word_lists_with_runs(seed):
    rng, out = random.Random(seed), []
    for _ in range(400):
        w = []
        for _ in range(rng.randint(0, 4)):
            unit = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.3:
                unit = unit * 2 + unit[:1]
            w += unit * rng.randint(1, 8) + unit[:rng.randint(0, len(unit))]
        out.append(w)
    return out


def test_runs_equal_brute_force():
    for w in word_lists_with_runs(1):
        assert periodic.runs(np.array([ord(c) for c in w], dtype=np.int64)) == brute.periodic_runs(w), w


def test_long_runs():
    w = np.zeros(300_000, dtype=np.int64)
    assert periodic.runs(w) == [(0, 300_000, 1)]
    unit = np.random.default_rng(3).integers(0, 50, 70_000)
    assert periodic.runs(np.concatenate([[7, 8], np.tile(unit, 4), unit[:5], [51]])) == [(2, 280_005, 70_000)]


def test_find_runs(spark):
    data = {i: " \n".join(w) for i, w in enumerate(word_lists_with_runs(2)[:150])} | EDGE
    got = {r["id"]: r for r in periodic.find_runs(frame(spark, list(data.items()))).collect()}
    assert len(got) == len(data)
    for i, t in data.items():
        w = brute.WORD.findall(t or "")
        want = brute.periodic_runs(w) if len(w) < 20_000 else [(0, len(w), 1)]
        r = got[i]
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == want
        gone = {j for s, n, q in want for j in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(x for j, x in enumerate(w) if j not in gone)
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (tuple(r["strongest"]) if r["strongest"] else None) == best


def test_find_runs_edges(spark):
    assert periodic.find_runs(frame(spark, [])).count() == 0
    extra = frame(spark, [(None, "a " * 30), (1, "a " * 30), (1, "a " * 30)]).withColumn("runs", F.lit(1)).withColumn("id", F.lit(2))
    assert sorted((r["id"] or 0, len(r["runs"])) for r in periodic.find_runs(extra).collect()) == [(0, 1), (1, 1), (1, 1)]


def test_query_of_periodic_runs(spark):
    """All columns of the query from plain Python, on whole texts of the smallest table."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op13_periodic_runs(spark, SF).collect():
        w = brute.WORD.findall(texts[r["doc_id"]] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = brute.periodic_runs(w) if n < 3000 else periodic.runs(periodic._ranks(" ".join(w).encode())[0])
        gone = {j for s, m, q in want for j in range(s + q, s + m)}
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)


# ---------------------------------------------------------------- conversations
TEXTS = ["Hello there.", "What now?", "no end", "", " \n", "Fine!", "also no end ", None]


def made_conversations(seed, n=150, longest=12):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(TEXTS) if rng.random() < 0.6 else f"Text {c} {t}."
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


def ordered(rows):
    """Rows by conversation in the order of the operator."""
    out = defaultdict(list)
    blank = lambda x: " " if x is None else x
    for c, t, role, text in rows:
        out[c].append((t, role, text))
    for c in out:
        out[c].sort(key=lambda r: (r[0] is not None, r[0] or 0, blank(r[1]), hashlib.md5(blank(r[2]).encode()).hexdigest()))
    return out


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_conversations_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = made_conversations(chunk)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (None, 2, "assistant", "Yes.")]
    rows += [(5000, t // 2, ("user", "user", "assistant")[t % 3], f"t{t % 40}") for t in range(300)]
    got = conversations.summaries(talk(spark, rows), spark.createDataFrame([(9999,), (1,), (None,)], "conv_id long")).collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in got}
    want = {c: brute.summary(r) for c, r in ordered(rows).items()}
    want[9999] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want


def test_repaired_rows(spark):
    rows = made_conversations(11, 60)
    got = defaultdict(list)
    for r in conversations.repaired(talk(spark, rows)).orderBy("conv_id", "seq").collect():
        assert r["seq"] == len(got[r["conv_id"]])
        got[r["conv_id"]].append((r["role"], r["text"]))
        assert (r["edit"] == "I") <= (r["turn"] is None)
    sums = {r["conv_id"]: r for r in conversations.summaries(talk(spark, rows)).collect()}
    for c, s in sums.items():
        assert s["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in got[c]).encode()).hexdigest()


def test_rules_change_no_result(spark, monkeypatch):
    rows = talk(spark, made_conversations(4, 80))
    with_rules = {tuple(r) for r in conversations.summaries(rows).collect()}
    monkeypatch.setattr(conversations, "ROUNDS", 0)
    assert {tuple(r) for r in conversations.summaries(rows).collect()} == with_rules


def test_grammar_spells_the_strings(spark):
    seqs = ["FJFJFJFJ", "BFJFJ", "FJFJF", "FFFFF", "J"]
    strings = spark.createDataFrame([(i % 3, 0, i, s) for i, s in enumerate(seqs * 4)], "conv long, part int, ord long, seq string")
    rules, packed = conversations.grammar(strings)
    assert rules

    def spell(s):
        return "".join(spell(rules[c]) if c in rules else c for c in s)

    for r in packed.collect():
        assert spell(r["packed"]) == r["seq"]
    matrices = conversations.rule_matrices(rules)
    for c in rules:
        plain = conversations.evaluate(spell(c), matrices)
        assert [(x, conversations.flat(r)) for x, r in plain] == [(x, conversations.flat(r)) for x, r in matrices[c]]


def test_conversation_edges(spark):
    none = talk(spark, [])
    assert conversations.summaries(none).count() == 0 and conversations.repaired(none).count() == 0
    extra = talk(spark, [(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")])
    for c in ("conv", "k", "seq", "tag", "n", "piece"):
        extra = extra.withColumn(c, F.lit("x"))
    assert [r["audit"] for r in conversations.summaries(extra).collect()] == ["KK"]
    long = talk(spark, [(1, 1, "user", "a " * 200_000 + "."), (1, 2, "assistant", "b" * 300_000 + "!")])
    assert [r["cost"] for r in conversations.summaries(long).collect()] == [0]


def test_query_of_conversations(spark):
    """The whole query against plain Python on the smallest table."""
    rows, ids = [], set()
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        ids.add(r["conv_id"])
        h = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if h == 1 else r["text"].translate({ord(c): None for c in ".!?"}) if h == 2 else r["text"]
        rows += [(r["conv_id"], r["turn"], "user" if h == 4 else r["role"], text)] * (0 if h == 0 else 2 if h == 3 else 1)
    want = {c: brute.summary(r) for c, r in ordered(rows).items()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversations(spark, SF).collect()}
    assert got == {c: want.get(c, empty) for c in ids}
