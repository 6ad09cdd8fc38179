"""URL filter, decontamination, licences, mixing."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.llm.brute import WORD, licences
from warmstart.llm import decontaminate, licenses, mixing, url_filter
from warmstart.llm.common import n_words, table
from warmstart.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://A.Example.COM/en/1?x=1", "https://www.example.com/en/2#top", "http://example.com", "http://xnet/es/",
        "http://x.net/es/9", "http://x.net?q=/es/", "http://x.net/ES/", "a://b://c.com/d", "http://é.net/fr/ü", "://com/", "x\ny://q.net/fr/"]


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]


def plain_rule(host, path):
    best = None
    for verdict, rule in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def test_hosts_paths_and_listed_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = url_filter.mine_rules(spark.createDataFrame([], "url string, label string"))
    got = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES, rules).collect()}
    for i, u in enumerate(URLS):
        h, p = plain_host_path(u)
        rule = plain_rule(h, p)
        j = got[i]["judged"]
        assert (j["host"], j["path"], j["rule"], j["verdict"]) == (h, p, rule and rule[1], rule[0] if rule else "allow")
        assert got[i]["host"] == "clash"
    assert url_filter.judge(pages.limit(0), URL_RULES, rules).count() == 0


def labelled_urls():
    rng = random.Random(2)
    out = []
    for i in range(400):
        host, sec = rng.choice(["a.org", "b.org", "spam.org"]), rng.choice(["en", "fr"])
        bad = host == "spam.org" and sec == "fr" or rng.random() < 0.05
        out.append((f"http://{host}/{sec}/{i}" + rng.choice(["", "?ref=1"]), "block" if bad else "allow"))
    return out + [(None, "block"), ("http://a.org/x", "other"), ("http://a.org/x", None)]


def test_marks_inside_tokens_keep_rules_apart(spark):
    """``/a/b`` and ``/a&path=b`` are different rules; both are found."""
    rows = [("http://x.org/a/b", "block")] * 20 + [("http://x.org/a&path=b", "block")] * 20 + [("http://x.org/c=d&e", "allow")] * 60
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "url string, label string"), 0.05, 0.6, 1.1)
    pages = spark.createDataFrame([(0, "http://q.org/a/b"), (1, "http://q.org/a&path=b"), (2, "http://q.org/a")], "page_id long, url string")
    got = {r["page_id"]: r["judged"] for r in url_filter.judge(pages, [], rules).collect()}
    assert got[0]["verdict"] == got[1]["verdict"] == "block" and got[0]["confidence"] == got[1]["confidence"] == 1.0
    assert got[0]["mined_rule"] != got[1]["mined_rule"]


def test_mined_rules_equal_brute_force(spark):
    rows = labelled_urls()
    frame = spark.createDataFrame(rows, "url string, label string")
    tok = {r["url"]: frozenset(r["t"]) for r in frame.select("url", url_filter.url_tokens(F.col("url")).alias("t")).collect() if r["url"]}
    known = [(tok[u], label) for u, label in rows if u and label in ("allow", "block")]
    want = {}
    for size in range(1, 7):
        for combo in itertools.combinations(sorted({t for s, _ in known for t in s}), size):
            c = set(combo)
            hit = [label for s, label in known if c <= s]
            for label in ("allow", "block"):
                n, base = hit.count(label), sum(x == label for _, x in known) / len(known)
                if n and n >= math.ceil(0.05 * len(known)) and n / len(hit) >= 0.6 and n / len(hit) / base >= 1.1:
                    want[(label, combo)] = n / len(hit)
    rules = url_filter.mine_rules(frame, 0.05, 0.6, 1.1)
    got = {(r["verdict"], tuple(r["tokens"])): r["confidence"] for r in rules.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any(v == "block" for v, _ in want)
    # matching: the best rule among all that fit
    probe = [("http://spam.org/fr/9",), ("http://spam.org/fr/9",), ("http://a.org/en/1",), ("http://new.org/de/",), (None,)]
    best = {r["url"]: (r["mined_verdict"], r["mined_rule"]) for r in url_filter.match_rules(spark.createDataFrame(probe, "url string"), rules).collect()}
    support = {(r["verdict"], tuple(r["tokens"])): r["support"] for r in rules.collect()}
    for (u,) in probe:
        fit = [(-got[k], -support[k], "&".join(k[1]), k[0]) for k in got
               if u and set(k[1]) <= set(spark.range(1).select(url_filter.url_tokens(F.lit(u))).first()[0])]
        assert best.get(u) == ((min(fit)[3], min(fit)[2]) if fit else None)


ITEM = "If Anna drives 12 km in 3 hours and then 12 km back, how far did Anna go before the long rest at noon?"


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(0)).withColumn("text_hash", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["id"], r["item_id"]): r for r in decontaminate.leaks(d, b).collect()}


def test_verbatim_and_reparameterised_items(spark):
    docs = [(0, "Some words first. " + ITEM + " And more."), (1, ITEM.upper()), (2, ITEM.replace("12", "40").replace("3 hours", "9 hours")),
            (3, ITEM.replace("12 km back", "13 km back").replace("12 km in", "40 km in")),  # one value stands for two
            (4, "nothing of this kind is in here at all, not even a window"), (5, None), (6, ""), (7, "  \n"),
            (8, " ".join(ITEM.split()[:9])), (None, ITEM), (0, "Some words first. " + ITEM + " And more.")]
    got = leaks(spark, docs, [(7, ITEM), (8, ITEM), (9, None), (10, "")])
    assert {d for d, i in got} >= {0, 2, None} and {d for d, i in got}.isdisjoint({3, 4, 5, 6, 7, 8})
    assert {i for d, i in got} == {7, 8}
    assert got[0, 7]["exact"] and got[0, 7]["coverage"] > 0.8 and not got[2, 7]["exact"]


def test_short_items_many_copies_and_empty_tables(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join([f"x{i}"] * i + words)) for i in range(50)] + [(99, "w1 w2 w3"), (98, " ".join(words) + " " + " ".join(words))]
    got = leaks(spark, docs, [(1, " ".join(words)), (2, "w5 w6, w7")])
    assert {d for d, i in got if i == 1} == {*range(50), 98} and {d for d, i in got if i == 2} == {*range(50), 98}
    assert leaks(spark, docs, []) == {} and leaks(spark, [], [(1, "a b c d e f g h i")]) == {}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("__id", F.lit("clash"))
    left = decontaminate.drop_leaks(d, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert left.columns == d.columns and [r["doc_id"] for r in left.collect()] == [99]


def test_items_of_mostly_slots(spark):
    item = "Compute 12 * 45 - 7 * 9 + 3"
    got = leaks(spark, [(0, "First: " + item + " please."), (1, "Compute 12 * 45 - 7 * 9 + 4")], [(1, item)])
    assert set(got) == {(0, 1)} and got[0, 1]["exact"] and got[0, 1]["coverage"] == 1


def test_conflicting_slots_cost_their_windows_only(spark):
    words = [f"w{i}x" for i in range(60)]
    words[10] = words[40] = "5"
    def copy(a, b):
        return " ".join([*words[:10], a, *words[11:40], b, *words[41:]])
    got = leaks(spark, [(0, copy("5", "6")), (1, copy("3", "4")), (2, copy("8", "8"))], [(1, copy("5", "5"))])
    assert {d for d, _ in got} == {0, 1, 2} and not any(r["exact"] for r in got.values())
    assert got[2, 1]["coverage"] == 1 and got[1, 1]["coverage"] < got[0, 1]["coverage"] < 1


def test_names_in_any_case_and_after_any_blanks(spark):
    item = "Yesterday Anna met Berta and Carla near Dresden while Erika and Frieda saw Greta in Hamburg with Ida"
    got = leaks(spark, [(0, item.lower()), (1, item.upper()), (2, item.replace(" ", "    ")), (3, item)], [(1, item)])
    assert {d for d, _ in got} == {0, 1, 2, 3} and all(r["coverage"] == 1 for r in got.values())


def test_leaks_of_plain_items_equal_brute_force(spark):
    bench = [(r["item_id"], r["text"]) for r in table(spark, SF01, "benchmark").collect()]
    docs = table(spark, SF01, "documents").select("doc_id", "text")
    flat = lambda t: " ".join(w.strip(".,;:!?\"'()#*$%&|<>") for w in WORD.findall((t or "").lower()))
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in bench if f" {flat(t)} " in f" {flat(r['text'])} "}
    got = {(r["id"], r["item_id"]) for r in decontaminate.leaks(docs, table(spark, SF01, "benchmark")).collect()}
    assert want and got == want


def test_all_windows_beyond_the_anchor_bound(spark, monkeypatch):
    docs, bench = table(spark, SF01, "documents"), table(spark, SF01, "benchmark")
    want = decontaminate.leaks(docs, bench).select("id", "item_id", "coverage").collect()
    monkeypatch.setattr(decontaminate, "MAX_ANCHORS", 1)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 1)
    assert sorted(decontaminate.leaks(docs, bench).select("id", "item_id", "coverage").collect()) == sorted(want)


LICENCES = [None, "", "...", "CC BY", "cc-by cc by-nc", "all rights  RESERVED. All Rights Reserved", "general public licence", "café cc\nby é",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "This work is licensed under the GNU General Public License, version 3.", "licensed " * 5000, "cc by " * 3000,
            "Licensed under the Apache License, Version 1.1"]


def test_licence_places_equal_brute_force(spark):
    d = spark.createDataFrame(list(enumerate(LICENCES)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["scan"] for r in licenses.scan(d).collect()}
    for i, t in enumerate(LICENCES):
        s = got[i]
        assert (s["n_words"], s["n_base"], s["first_word"], s["last_word"], s["base_labels"]) == licences(t)
        assert set(filter(None, s["base_labels"].split(","))) <= set(s["labels"].split(",")) and 0 <= s["score"] <= 1
    assert got[8]["labels"] == "mit" and got[9]["labels"] == "gpl,gpl-3.0" and got[12]["labels"] == ""
    assert got[4]["labels"] == "cc-by" and licenses.scan(d.limit(0)).count() == 0


def test_licence_needs_its_key_phrase_and_most_words(spark):
    mit = LICENCES[8].split()
    rows = [" ".join(mit[:3] + ["not"] + mit[4:]), " ".join(w if i != 15 else "the" for i, w in enumerate(mit)), " ".join(reversed(mit))]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["scan"]["labels"] for r in licenses.scan(d).collect()}
    assert got == {0: "", 1: "mit", 2: ""}


def test_licence_notices_and_headers(spark):
    head = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as "
            "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
    rows = {"Text. Released under the MIT License. More.": "mit", "Licensed under the MIT license": "mit", head.format("", 3): "gpl,gpl-3.0",
            head.format("", 2): "gpl,gpl-2.0", head.format("Lesser ", 3): "gpl,lgpl-3.0", head.format("Lesser ", "2.1"): "gpl,lgpl-2.1",
            head.format("Affero ", 3): "agpl-3.0,gpl", "Released under the MIT name": ""}
    got = {r["text"]: r["scan"]["labels"] for r in licenses.scan(spark.createDataFrame([(t,) for t in rows], "text string")).collect()}
    assert got == rows


def test_every_licence_notice_of_the_documents_gets_its_label(spark):
    got = licenses.scan(table(spark, SF01, "documents")).select(F.lower("text").alias("t"), F.split("scan.labels", ",").alias("l"))
    for notice, label in (("released under the mit license", "mit"), ("gnu general public license, version 3", "gpl-3.0"),
                          ("licensed under cc by-nc 4.0", "cc-by-nc-4.0"), ("licensed under the apache license, version 2.0", "apache-2.0"),
                          ("all rights reserved", "reserved")):
        rows = got.filter(F.col("t").contains(notice))
        assert rows.filter(~F.array_contains("l", label)).count() == 0 < rows.count(), notice


def test_rare_index_takes_the_rarest():
    t = licenses.Template("t", "the rare the word again rare", ())
    index = licenses.rare_index([t], {"the": 90, "rare": 1, "word": 5, "again": 5})
    assert index["t"] == [("the", 0), ("rare", 1), ("the", 2), ("word", 3), ("again", 4), ("rare", 5)]


def mixed(spark, rows, **kw):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    return [r.asDict() for r in mixing.mix(d, n_words(F.col("text")), **kw).collect()]


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest, live = {}, budget * sum(sizes.values()), set(names)
    while live:
        share = rest / sum(w[s] for s in live)
        full = {s for s in live if cap * sizes[s] <= share * w[s]}
        if not full:
            return out | {s: share * w[s] for s in live}
        out |= {s: cap * sizes[s] for s in full}
        rest -= sum(cap * sizes[s] for s in full)
        live -= full
    return out


def test_mixing_targets_and_taken_words(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["b", "a", "hot", "hot", "hot", None, "é"])) for i in range(900)]
    rows += [(None, "a b c", "a"), (None, "a b c", "a"), (5000, None, "b"), (5001, None, "empty")]
    got = mixed(spark, rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["source"] if "source" in r else r["source_size"], []).append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    for s, n in sizes.items():
        part = [r for r in got if r["source_size"] == n]
        assert abs(part[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in part) - want[s]) <= 40
    key = lambda r: tuple((k, str(v)) for k, v in sorted(r.items()))
    assert sorted(map(key, got)) == sorted(map(key, mixed(spark, rows[::-1])))
    assert sorted(map(key, got)) != sorted(map(key, mixed(spark, rows, seed=18)))


def test_mixing_inclusion_follows_the_sizes(spark):
    """Longer documents are drawn more often, each size as often as its inclusion probability says."""
    rows = [(i, "w " * (2 if i % 2 else 18), "s") for i in range(4000)] + [(9000 + i, "w " * 80000, "t") for i in range(1)]
    got = [r for r in mixed(spark, rows, weights=(1, 2), budget=0.5, cap=2.0) if r["source_size"] == 40000]
    f = got[0]["target"] / 40000 % 1
    h = {s: s / (s + 10) for s in (2, 18)}
    centre = sum(2000 * s * h[s] for s in h) / 40000
    rates = []
    for size in (2, 18):
        part = [r["copies"] - got[0]["target"] // 40000 for r in got if r["size"] == size]
        p = f + min(f, 1 - f) * (h[size] - centre)
        rates.append(sum(part) / len(part))
        assert abs(rates[-1] - p) < 4 * math.sqrt(p * (1 - p) / len(part)) + 0.02
    assert rates[1] > rates[0] + 0.1


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "one", "a")]])
def test_mixing_without_words(spark, rows):
    assert all(r["taken"] in (0, 1, 2) for r in mixed(spark, rows))
