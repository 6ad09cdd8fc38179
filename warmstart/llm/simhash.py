"""Near-duplicate documents by SimHash, found through a byte-position inverted index.

A text's words (ASCII letters lower-cased, split at ASCII white space) become four-word shingles, repeats included; a
shingle is hashed by XXH64 (UTF-8, seed 42) and a bit of the fingerprint is 1 if it is set in more than half of the
hashes. Fingerprints are linked when at most ``MAX_BITS`` bits differ; the result is the connected components.

1. Equal fingerprints are one node from here on, so copies cost one row.
2. Index: at most four differing bits leave at least ``MIN_BYTES`` = 4 of the 8 byte positions equal. Postings hold the
   nodes that agree on two byte positions; of any four positions two lie in one of three fixed groups, so seven
   position pairs reach every link. A posting of more than ``CROWDED`` nodes is not compared: its nodes are
   posted again under one more position (and once more under a fourth), enough positions that no link is lost. A posting
   still crowded under four positions is cut into blocks, dealt as pairs of blocks.
3. Count filter: inside a posting the equal byte positions of each pair are tallied; pairs with fewer than
   ``MIN_BYTES`` go, the others are verified by the number of differing bits.
4. Pairs stay in the task: it joins linked nodes to groups and returns one row per node and group, so a dense posting gives
   rows in proportion to its nodes. Components by star contraction (``components``).

Nothing is approximate. Defined results: a null, empty or white-space text has fingerprint zero and is linked like
any other; fewer than four words are one shingle; null ids are carried through, the smallest non-null id names
the component (null if there is none); repeated rows get the same result; an empty table gives an empty table; long
texts are hashed in pieces of ``words.PIECE`` bytes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmstart.llm.common import few, store
from warmstart.llm.components import components
from warmstart.llm.words import texts, word_lists

SHINGLE, SEED, MAX_BITS = 4, 42, 4
POSITIONS = 8
#: Byte positions that two linked fingerprints share at least.
MIN_BYTES = POSITIONS - MAX_BITS
#: Nodes of a posting that are compared directly.
CROWDED = 1024
#: Copies of one fingerprint from which its documents take their component by a broadcast join.
COPIES = 1000
#: Rows that are compared at once (a posting is never cut).
ROWS = 1 << 16

_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def fingerprint(data: bytes) -> int:
    """Unsigned SimHash of a text in UTF-8; 0 without words."""
    counts, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in word_lists(data.lower()):
        words = tail + words
        if len(words) >= SHINGLE:
            h = _hashes(words, SHINGLE)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        tail = words[-(SHINGLE - 1):]
    if not total and tail:
        h, total = _hashes(tail, len(tail)), 1
        counts += np.unpackbits(h.view(np.uint8), bitorder="little")
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word window, joined by spaces."""
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:len(words) - k + 1].tolist()
    one = xxhash.xxh64_intdigest
    return np.array([one(line[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())], dtype="<u8")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in texts(b.column(1))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])


def _mask(positions) -> int:
    """The bytes at ``positions`` as a signed 64-bit mask."""
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _deeper(positions: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Position sets with one more position, one of which any link that agrees on ``positions`` agrees on: of the other
    positions, all but one fewer than still have to agree."""
    other = [p for p in range(POSITIONS) if p not in positions]
    spare = MIN_BYTES - len(positions) - 1
    return [tuple(sorted((*positions, p))) for p in other[:len(other) - spare]]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least row of each row's group so far) after rows a and b are linked."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, one, two, print), postings side by side: (u, v) ties every node to one of its group."""
    def links(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        n = len(prints)
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        label, at, step = np.arange(n), np.arange(n), 1
        while len(at := at[at + step < end[at]]):
            differ = prints[at] ^ prints[at + step]
            shared = (differ.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)  # the tally of a pair
            near = at[(shared >= MIN_BYTES) & (np.bitwise_count(differ) <= MAX_BITS)]
            label = _joined(label, near, near + step)
            step += 1
        i = np.flatnonzero(label != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(prints[i].view(np.int64)), pa.array(prints[label[i]].view(np.int64))],
                                          names=["u", "v"])

    keys, prints, held = [], [], 0
    for b in batches:
        if len(b):
            keys.append(np.stack([b.column(i).to_numpy() for i in range(4)], axis=1))
            prints.append(b.column(4).to_numpy().view(np.uint64))
            held += len(b)
        if held >= ROWS:
            key, fp = np.concatenate(keys), np.concatenate(prints)
            same = (key == key[-1]).all(axis=1)
            cut = len(key) - int(same[::-1].argmin()) if not same.all() else 0  # the last posting may go on
            if cut:
                yield links(key[:cut], fp[:cut])
            keys, prints, held = [key[cut:]], [fp[cut:]], len(key) - cut
    if held:
        yield links(np.concatenate(keys), np.concatenate(prints))


def _posted(nodes: DataFrame, masks: list[int]) -> DataFrame:
    return (nodes.select("print", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
            .select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("value"), "print"))


def _in_blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Postings (with their counts) dealt as pairs of blocks: a node meets every node of its posting in one pair at least."""
    key = ["mask", "value"]
    blocks = F.ceil(F.col("n") / CROWDED).cast("long")
    return (rows.join(few(counts), key).withColumn("m", F.pmod(F.xxhash64("print"), blocks))
            .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .select(*key, F.least("m", "o").alias("one"), F.greatest("m", "o").alias("two"), "print"))


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): fingerprints tied to one of their group; its components are those of all links of at most MAX_BITS bits.

    ``nodes``: distinct fingerprints, column ``print`` (signed)."""
    key, full = ["mask", "value"], ["mask", "value", "one", "two"]
    zero = F.lit(0).cast("long")
    sets = [p for g in _GROUPS for p in combinations(g, 2)]
    rows, parts = store(_posted(nodes, [_mask(p) for p in sets]), "postings"), []
    while True:
        crowded = store(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED), "crowded")
        hot = few(crowded)
        parts.append(rows.join(hot, key, "left_anti").select(*key, zero.alias("one"), zero.alias("two"), "print"))
        if crowded.isEmpty():
            break
        if len(sets[0]) == MIN_BYTES:
            parts.append(_in_blocks(rows, crowded))
            break
        below = {_mask(p): [_mask(q) for q in _deeper(p)] for p in sets}
        children = F.create_map(*(x for m, c in below.items() for x in (F.lit(m).cast("long"), F.array(*(F.lit(q).cast("long") for q in c)))))
        rows = (rows.join(hot, key, "left_semi").withColumn("mask", F.explode(children[F.col("mask")]))
                .select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("value"), "print").distinct())
        rows, sets = store(rows, "postings"), sorted({q for p in sets for q in _deeper(p)})
    found = [p.repartition(*full).sortWithinPartitions(*full).mapInArrow(_compare, "u long, v long") for p in parts]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, component_id), a row for every row of ``docs``; ``print`` is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = store(rows.mapInArrow(_sign, T.StructType([T.StructField("id", kind), T.StructField("print", T.LongType())])), "prints")
    nodes = store(signed.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    member = components(links(nodes.select("print"))).join(nodes.select(F.col("print").alias("node"), "least"), "node")
    named = member.join(member.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "first")
    by_print = store(nodes.join(named, nodes["print"] == named["node"], "left")
                     .select("print", "n", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("first"))
                             .alias("component_id")), "components")
    # many copies of one fingerprint: its rows stay where they are
    copied = by_print.filter(F.col("n") > COPIES).drop("n")
    hot = few(copied.select("print"))
    rare = signed.join(hot, "print", "left_anti").join(by_print.drop("n"), "print")
    return rare.unionByName(signed.join(few(copied), "print")).select("id", "print", "component_id")
