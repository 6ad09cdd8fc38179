"""Plain Python versions of the string similarities."""

import math
from collections import Counter

import regex


def cosine(a, b):
    x, y = (Counter(regex.findall(r"[\p{L}\p{N}_]+", s)) for s in (a, b))
    den = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(x[k] * y[k] for k in x) / den if den else 0.0


def levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        p, d[0] = d[:], i
        for j, cb in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (ca != cb))
    return d[len(b)]


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for ca in a:
        p = d[:]
        for j, cb in enumerate(b, 1):
            d[j] = p[j - 1] + 1 if ca == cb else max(p[j], d[j - 1])
    return d[-1]


def levenshtein_similarity(a, b):
    return max(len(a), len(b)) - levenshtein(a, b)


def jaro(a, b):
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(mine, [b[j] for j in range(len(b)) if taken[j]])) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3.0


def jaro_winkler(a, b):
    s, p = jaro(a, b), 0
    while s > 0.7 and p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return s + p * 0.1 * (1.0 - s)
