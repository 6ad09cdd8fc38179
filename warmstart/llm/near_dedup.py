"""Near-duplicate documents by a MinHash LSH forest, confirmed on full shingle sets.

Texts become sets of five-word shingles (ASCII letters lower-cased, words split at ASCII white space);
two documents are linked when ``100 * |A and B| >= 75 * |A or B|``; the result is the connected
components of these links.

1. One scan gives every row its set size, a 128-bit key of its set and a MinHash signature. Equal sets
   are one class from here on, so thousands of copies cost one row.
2. Forest: the signature is cut into ``TREES`` labels of ``DEPTH`` values. All (tree, label) rows are
   range-partitioned and sorted; in each order a class is paired with the classes among its next
   places that share at least ``MIN_DEPTH`` leading values. A thin region is paired
   at the minimum depth; in a crowded region the places go to the longest common prefixes, so the depth
   adapts to the region. Range partitions cut through crowded regions (the class is the last sort
   key); the rows at partition ends are stored aside and paired in a second, small pass.
3. A pair goes on if the whole signatures agree on at least ``AGREE`` of their values and the set sizes
   allow the similarity; then both texts meet and the sets themselves decide.
4. Components by star contraction (``components``).

The places of step 2 do not reach all of a range of many classes (classes that share ``MIN_DEPTH`` values in a tree). After step 4
all pairs of different components in such a range are compared. The depth adapts: a range of more than ``CROWDED`` classes is
cut by further values, down to ``DEPTH``; what is still large is dealt as pairs of blocks. In a range, signatures first
tell which classes have any candidate; only their sets go on, once per range, and a task ties them together: it
returns a row for every class that it joins to another component, never the pairs. Then step 4 again.

A pair at similarity 0.75 shares two leading values in none of 16 trees with probability
(1 - 0.75**2) ** 16 = 2e-6, and agrees on too few values with 7e-6. In a range cut down to six values it still meets with
probability 1 - (1 - 0.75**6) ** 16 = 0.957 (0.99999 at similarity 0.9), besides its chance as neighbours in step 2; no other pair is lost.

Defined results: a null, empty or white-space text has no shingle (``n_shingles`` 0) and is linked with
nothing; null ids are compared like others, the smallest non-null id names the component; repeated
rows get the same result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmstart.llm import arrowtext as A
from warmstart.llm.common import arrow_batches, few, fresh, store
from warmstart.llm.components import components

AWAY = "__llm_away"
SHINGLE, PERCENT = 5, 75
TREES, DEPTH, MIN_DEPTH, NEAREST = 16, 6, 2, 2
#: Bytes of text in one slice of rows and in one batch of rows (a longer text is one of its own): bound a worker's memory.
SLICE_BYTES, BATCH_BYTES = 1 << 18, 4 << 20
#: Classes of a range beyond which it is cut by a further value.
CROWDED = 4096
#: Classes, and shingles of all of them, in one block of a range; two blocks meet in one task. Shared shingles looked at at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 19, 4096
#: Share of equal signature values below which a pair is not looked at again: 4.5 standard deviations
#: under 0.75 for 96 values.
AGREE = 0.55

_RANGE = ["tree", "prefix", "one", "two"]
_SEEDS = np.random.default_rng(7).integers(0, 2**64, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)


def _sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """The sorted shingle sets of each slice of rows."""
    for i, j, buf, offs in A.slices(texts, SLICE_BYTES):
        buf = A.lower_ascii(buf)
        starts, ends, row = A.words(buf, offs)
        h, r = A.windows(A.hashes(buf, starts, ends), row, j - i, SHINGLE)
        cut = np.searchsorted(r, np.arange(j - i + 1))
        yield [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit key of every set."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    one = np.array([np.sum(s, dtype=np.uint64) for s in sets], dtype=np.uint64)
    two = np.array([np.sum(A.mix(s + np.uint64(99)), dtype=np.uint64) for s in sets], dtype=np.uint64)
    return n, A.mix(one).view(np.int64), A.mix(two).view(np.int64)


def _signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for every set, big-endian (so bytes sort as numbers); zeros if empty."""
    out = np.zeros((len(sets), TREES * DEPTH), dtype=">u4")
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        cut = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k, seed in enumerate(_SEEDS):
            x = flat * seed
            out[full, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), cut)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, one, two, sig = [], [], [], []
        for sets in _sets(b.column(1)):
            for to, x in zip((n, one, two), _keys(sets)):
                to.append(x)
            sig += [x.tobytes() for x in _signature(sets)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.concatenate(x)) for x in (n, one, two)), pa.array(sig, pa.binary())],
                names=["id", "n_shingles", "k1", "k2", "sig"])


def _with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts: the key of their set and the set."""
    for b in batches:
        for sets in _sets(b.column(0)):
            keys = [pa.array(x) for x in _keys(sets)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([x.tobytes() for x in sets], pa.binary())],
                                             names=["n_shingles", "k1", "k2", "shingles"])


_ROW = [("tree", pa.int32()), ("label", pa.binary()), ("node", pa.int64()), ("root", pa.int64())]
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), *_ROW])
_PAIR_DDL = "a long, b long, tree int, label binary, node long, root long"


def _neighbours(first: int, last: int):
    """Arrow function over rows (tree, label, node, root), which come sorted: pairs of rows of different roots, ``first``
    to ``last`` places apart, with a long enough common prefix. The rows at both ends come out as well."""
    def ends(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *rows.columns], schema=_PAIR)

    def pairs(rows: pa.RecordBatch, old: int) -> Iterator[pa.RecordBatch]:
        tree, node, root = (rows.column(i).to_numpy() for i in (0, 2, 3))
        label = np.frombuffer(b"".join(rows.column(1).to_pylist()), dtype=">u4").reshape(len(rows), DEPTH)
        for s in range(first, min(last, len(rows) - 1) + 1):
            near = (tree[s:] == tree[:-s]) & (root[s:] != root[:-s])
            near &= (label[s:, :MIN_DEPTH] == label[:-s, :MIN_DEPTH]).all(axis=1)
            near &= np.arange(s, len(rows)) >= old  # pairs inside the tail are out already
            i = np.flatnonzero(near)
            if len(i):
                p = np.sort(np.stack([node[i], node[i + s]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), *(pa.nulls(len(i), t) for _, t in _ROW)],
                                                 schema=_PAIR)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tail = 0, None
        for b in batches:
            if not len(b):
                continue
            b = pa.RecordBatch.from_arrays([c.cast(t) for c, (_, t) in zip(b.columns, _ROW)], schema=pa.schema(_ROW))
            if head < last:
                yield ends(b.slice(0, last - head))
                head += min(len(b), last - head)
            old = 0 if tail is None else len(tail)
            rows = b if tail is None else pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0]
            yield from pairs(rows, old)
            tail = rows.slice(max(0, len(rows) - last))
        if tail is not None:
            yield ends(tail)

    return scan


def _candidates(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of neighbours in one of the sorted orders, from (node, sig, root)."""
    width, order = 4 * DEPTH, ["tree", "label", "node"]
    rows = (nodes.select("node", "sig", "root", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
            .select("tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("label"), "node", "root"))
    scan = _neighbours(first, last)
    out = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, _PAIR_DDL), "forest")
    # 2 * last rows of every partition at most: grows with the partitions, not with the documents; rows that were not
    # next to each other before are compared too, which does no harm, and all distances count here
    ends = (out.filter("label is not null").select(*order, "root").distinct()
            .coalesce(1).sortWithinPartitions(*order).mapInArrow(_neighbours(1, last), _PAIR_DDL))
    pairs = out.select("a", "b", "label").union(ends.select("a", "b", "label"))
    return pairs.filter("label is null and a < b").select("a", "b").distinct()


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole signatures agree on enough values."""
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint32).reshape(len(b), -1)
                    for i in (2, 3))
            ok = (x == y).mean(axis=1) >= AGREE
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, set of a, set of b) whose full sets are similar enough."""
    for b in batches:
        ok = []
        for p, q in zip(b.column(2), b.column(3)):
            p, q = (np.frombuffer(x.as_py(), dtype=np.uint64) for x in (p, q))
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _near_places(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that are neighbours in the forest and whose signatures agree."""
    side = nodes.select("node", "n_shingles", "sig")
    return (_candidates(nodes.select("node", "sig", F.col("node").alias("root")), 1, NEAREST)
            .join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
            .filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
            .select("a", "b", "sa", "sb").mapInArrow(_agree, "a long, b long"))


def _flag(t: pa.Table) -> pa.Table:
    """The rows of a range (or of two of its blocks) that have a candidate: a row of another component whose size fits and whose
    signature agrees. Every pair is looked at in one range only, the first whole one that holds both or, failing that, the cut ones."""
    tree, deep = t.column("tree")[0].as_py(), t.column("deep")[0].as_py()
    root, n, block, cut = (t.column(c).to_numpy() for c in ("root", "n_shingles", "m", "cut"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint32).reshape(len(t), TREES * DEPTH)
    bits, flagged = 1 << np.arange(TREES), np.zeros(len(t), dtype=bool)
    two = t.column("one")[0].as_py() != t.column("two")[0].as_py()
    for i in range(len(t) - 1):
        ok = (root[i + 1:] != root[i]) & (100 * np.minimum(n[i + 1:], n[i]) >= PERCENT * np.maximum(n[i + 1:], n[i]))
        if two:
            ok &= block[i + 1:] != block[i]
        j = i + 1 + np.flatnonzero(ok)
        if len(j):
            same = sig[j] == sig[i]
            whole = (same.reshape(len(j), TREES, DEPTH)[:, :, :MIN_DEPTH].all(axis=2)) & ((cut[i] & bits) == 0)
            here = ~whole.any(axis=1) if deep else whole.any(axis=1) & (whole.argmax(axis=1) == tree)
            j = j[here & (same.mean(axis=1) >= AGREE)]
            flagged[j] = True
            flagged[i] |= len(j) > 0
    return t.select([*_RANGE, "node", "root", "m"]).filter(pa.array(flagged))


def _tie(t: pa.Table) -> pa.Table:
    """The links between the rows (node, root, m, shingles) of a range, or of two of its blocks, as (u, v): every node joined to
    another component, with one it is linked to. All pairs are decided on their full sets: shared shingles
    are columns of a bit matrix, so a node meets all others at once; pairs that are connected already are skipped."""
    node, block = t.column("node").to_numpy(), t.column("m").to_numpy()
    two = t.column("one")[0].as_py() != t.column("two")[0].as_py()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    label = np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = (np.cumsum(shared) - 1)[column]
    keep = shared[column]
    row, place = row[keep], place[keep]
    common = np.zeros((len(sets), len(sets)), dtype=np.int32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        here = (place >= lo) & (place < lo + COLUMNS)
        dense = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        dense[row[here], place[here] - lo] = 1
        common += np.rint(dense @ dense.T).astype(np.int32)
    linked = 100 * common >= PERCENT * (size[:, None] + size[None, :] - common)
    if two:
        linked &= block[:, None] != block[None, :]
    u, v = [], []
    for i in range(len(sets)):
        for j in i + 1 + np.flatnonzero(linked[i, i + 1:]):
            if label[i] != label[j]:
                u.append(node[i])
                v.append(node[j])
                label[label == label[j]] = label[i]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _ranges(nodes: DataFrame) -> DataFrame | None:
    """The rows (tree, prefix, one, two, m, deep, node, root, n_shingles, sig, cut) of the ranges that the places do not cover, from
    (node, root, n_shingles, sig); None if there are none.

    A range of more than ``CROWDED`` classes is cut by one more value, down to ``DEPTH``; ``cut`` has a bit for every tree in
    which that happened to a class. What is still large is cut into blocks, dealt as pairs of blocks (one, two)."""
    at, width = ["tree", "prefix"], 4 * DEPTH
    piece = lambda d: F.expr(f"substring(sig, tree * {width} + 1, {4 * d})").alias("prefix")
    kept = ["node", "root", "n_shingles", "sig"]
    rows = nodes.select(*kept, F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows, parts, cut = rows.select("tree", piece(MIN_DEPTH), *kept), [], None
    for depth in range(MIN_DEPTH, DEPTH + 1):
        stats = store(rows.groupBy(*at).agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .filter((F.col("n") > (NEAREST + 1 if depth == MIN_DEPTH else 1)) & (F.col("lo") < F.col("hi"))).drop("lo", "hi"), "ranges")
        crowded = stats.filter(F.col("n") > CROWDED)
        last = depth == DEPTH or crowded.isEmpty()
        whole = stats if last else stats.filter(F.col("n") <= CROWDED)
        parts.append(rows.join(few(whole), at).withColumn("deep", F.lit(depth > MIN_DEPTH)))
        if last:
            break
        rows = store(rows.join(few(crowded.select(*at)), at, "left_semi"), "crowded")
        if cut is None:
            cut = rows.groupBy("node").agg(F.sum(F.expr("shiftleft(1, tree)")).cast("int").alias("cut"))
        rows = rows.select("tree", piece(depth + 1), *kept)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.join(cut, "node", "left") if cut is not None else out.withColumn("cut", F.lit(0))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("long")
    return (out.withColumn("cut", F.coalesce("cut", F.lit(0))).withColumn("m", F.pmod(F.xxhash64("node"), blocks))
            .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .withColumn("one", F.least("m", "o")).withColumn("two", F.greatest("m", "o")).drop("n", "size", "o"))


def _in_ranges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): links between different components inside the crowded ranges, from (node, rep, n_shingles, k1, k2, sig, root)."""
    kinds = {"tree": "int", "prefix": "binary", "one": "long", "two": "long", "node": "long", "root": "long", "m": "long"}
    ranges = _ranges(nodes.select("node", "root", "n_shingles", "sig"))
    some = store(ranges.groupBy(*_RANGE).applyInArrow(_flag, ", ".join(f"{c} {t}" for c, t in kinds.items())), "flagged")
    sets = _node_sets(rows, nodes.join(some.select("node").distinct(), "node", "left_semi"))
    return some.join(sets, "node").groupBy(*_RANGE).applyInArrow(_tie, "u long, v long")


def _node_sets(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(node, shingles): the full sets of some nodes (node, rep, n_shingles, k1, k2), as bytes, each worked out once."""
    key = ["n_shingles", "k1", "k2"]
    near = store(near.select("node", "rep", *key), "near")
    # by id, then by set, as an id may come with several texts
    wanted = few(near.select(F.col("rep").alias("w")).distinct())
    shape = T.StructType([*(T.StructField(k, T.LongType()) for k in key), T.StructField("shingles", T.BinaryType())])
    return store(rows.join(wanted, F.col("id").eqNullSafe(F.col("w")), "left_semi").select("text").mapInArrow(_with_set, shape)
                 .join(near.select("node", *key), key).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _links(rows: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links (u, v) among ``pairs`` (a, b) of nodes: those whose full sets are similar enough."""
    pairs = store(pairs, "pairs")
    sets = _node_sets(rows, nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi"))
    return store(pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
                 .select("a", "b", "sa", "sb").mapInArrow(_confirm, "u long, v long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, k1, k2, component_id, component), a row for every row of ``docs``.

    k1 and k2 identify its set, ``component`` (null without shingles) its component."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _near_duplicates(docs, id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    head = T.StructType([T.StructField("id", kind), T.StructField("n_shingles", T.LongType()),
                         T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])
    key = ["n_shingles", "k1", "k2"]
    signed = store(rows.mapInArrow(_sign, T.StructType([*head, T.StructField("sig", T.BinaryType())])), "signed")
    # one node for every distinct set, named by the smallest id that has it
    nodes = store(signed.filter("n_shingles > 0").groupBy(*key)
                  .agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
                  .withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = _links(rows, nodes, _near_places(nodes))
    roots = components(links)
    joined = store(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "joined")
    more = store(_in_ranges(rows, joined), "more")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    member = roots.join(nodes.select("node", "rep"), "node")
    named = (member.join(member.groupBy("root").agg(F.min("rep").alias("least")), "root")
             .select("node", "root", "least"))
    by_set = (nodes.join(named, "node", "left")
              .select(*key, F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"),
                      F.coalesce("root", "node").alias("component")))
    full = signed.filter("n_shingles > 0").drop("sig").join(by_set, key)
    none = (signed.filter("n_shingles = 0").drop("sig").withColumn("component_id", F.col("id"))
            .withColumn("component", F.lit(None).cast("long")))
    return full.unionByName(none).select("id", *key, "component_id", "component")


def _append_keys(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the text to look at; that column makes way for the keys of its set."""
    for b in batches:
        got = [_keys(sets) for sets in _sets(b.column(b.num_columns - 1))]
        if got:
            keys = [pa.array(np.concatenate(x)) for x in zip(*got)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *keys], names=[*b.schema.names[:-1], *names])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay.

    Rows without shingles all stay. Where a component's smallest id comes with several texts or
    repeated rows, one of these rows stays."""
    found = near_duplicates(docs, id_col, text_col)
    found = store(found, "found")
    again = found.filter("component is not null").groupBy("id").count().filter("count > 1").select("id")
    lost = found.filter(~F.col("component_id").eqNullSafe(F.col("id"))).select("id")
    away = few(store(lost.union(again).distinct(), "away").withColumnRenamed("id", AWAY))
    once = docs.join(away, docs[id_col].eqNullSafe(F.col(AWAY)), "left_anti")
    # ids that occur more than once: judged by row, through the keys of its set
    c, more = fresh(docs, "__text", "__n", "__k1", "__k2", "__i", "__s"), again.withColumnRenamed("id", AWAY)
    shape = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in c[1:4])])
    keyed = (docs.join(more, docs[id_col].eqNullSafe(F.col(AWAY)), "left_semi")
             .withColumn(c[0], F.col(text_col).cast("string")).mapInArrow(lambda batches: _append_keys(batches, c[1:4]), shape))
    stay = (found.join(more, F.col("id").eqNullSafe(F.col(AWAY)), "left_semi")
            .filter(F.col("component").isNull() | F.col("component_id").eqNullSafe(F.col("id"))))
    one = (stay.filter("component is not null").groupBy("component", "id")
           .agg(F.min(F.struct("n_shingles", "k1", "k2")).alias("s")).select(F.col("id").alias(c[4]), F.col("s").alias(c[5])))
    same = keyed[id_col].eqNullSafe(F.col(c[4]))
    for x, y in zip(c[1:4], ("n_shingles", "k1", "k2")):
        same &= keyed[x] == F.col(f"{c[5]}.{y}")
    texts = keyed.join(one, same, "left_semi").dropDuplicates([id_col, *c[1:4]])
    empty = keyed.filter(F.col(c[1]) == 0)
    return once.unionByName(texts.unionByName(empty).select(*docs.columns)).select(*docs.columns)
