"""Plain Python versions of what the operators compute."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def shingles(text):
    w = WORD.findall(low(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(texts):
    """{id: (n_shingles, smallest id reachable)} of {id: text}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if at[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def licences(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        got = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += got
        labels |= {label} if got else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def simhash(text):
    """Unsigned fingerprint of a text."""
    import xxhash

    w = WORD.findall(low(text))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_prints(prints):
    """{id: smallest id reachable} of {id: fingerprint}, links at 4 or fewer differing bits."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def periodic_runs(w):
    """All runs (start, length, period) of a word list, by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q) and all(
                    any(w[x] != w[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repair(rows):
    """(cost, audit, repaired (role, text) rows) of one conversation's rows (role, text, fault); faults: ok, blank, duplicate,
    truncated. All edit sequences are compared from the end, as whole audits."""
    step = {("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("s", 0): 1}
    best = {}  # state: (cost, audit, rows) from row i on

    def close(later):
        """Rows inserted before what is in ``later``."""
        out = dict(later)
        for _ in range(3):
            for p in range(4):
                q, name = (3, "assistant") if p == 2 else (2, "user")
                if q in out:
                    c = (out[q][0] + 3, "I" + out[q][1], ((name, ""),) + out[q][2])
                    out[p] = min(out.get(p, c), c)
        return out

    best = close({0: (0, "", ()), 3: (0, "", ())})
    for role, text, fault in reversed(rows):
        now = {}
        for p in range(4):
            options = [(best[p][0] + 4, "D" + best[p][1], best[p][2])] if p in best else []
            if fault in ("ok", "truncated"):
                more = 3 if fault == "truncated" else 0
                q = step.get((role[:1], p))
                if q in best:
                    options.append((best[q][0] + more, "K" + best[q][1], ((role, text),) + best[q][2]))
                q, name = (3, "assistant") if p == 2 else (2, "user")
                if q in best:
                    options.append((best[q][0] + more + 3, "R" + best[q][1], ((name, text),) + best[q][2]))
            if options:
                now[p] = min(options)
        best = close(now)
    return best[0]


def summary(rows):
    """The row of ``summaries`` (without conv_id) of one conversation's (turn, role, text) rows, in order."""
    import hashlib

    seen, faults, marked = set(), Counter(), []
    for _, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        chars = WORD.findall(text)
        fault = ("blank" if not chars else "duplicate" if (role, text) in seen else
                 "truncated" if chars[-1][-1] not in ".!?" else "ok")
        seen.add((role, text))
        faults[fault] += 1
        marked.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit, left = repair(marked)
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
