"""Tables of blocks: rows hashed into B blocks, a block per row, kept in B buckets from one step of a job to the next.

``Strata`` runs updates of two sides of factors (users and items, or inputs and outputs) entry by entry in parallel: an
epoch is B strata, and in stratum s block b of the first side meets block (b + s) mod B of the second, so the B pairs of
blocks share no row. The first side stays in its buckets; the blocks of the second are the only exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmstart.functions.seeded import hash_int
from warmstart.session import delete_path, fixed_plans, scratch_path


def block_of(col: str, n: int, seed: int) -> Column:
    return F.pmod(hash_int(seed, F.col(col)), F.lit(n)).cast("int")


def block_keys(spark, b: int) -> list[int]:
    """A key for every block, chosen so that the keys fall into ``b`` different hash partitions."""
    found = (spark.range(64 * b + 1024).select("id", F.pmod(F.hash("id"), F.lit(b)).alias("p"))
             .groupBy("p").agg(F.min("id").alias("slot")).collect())  # b rows
    if len(found) < b:
        raise RuntimeError(f"no key for {b - len(found)} of {b} partitions")
    return [r["slot"] for r in sorted(found, key=lambda r: r["p"])]


class Buckets:
    """Tables in ``b`` buckets by ``slot``, in the scratch folder; ``close`` takes their names from the catalog."""

    def __init__(self, spark, b: int):
        self.spark, self.b, self.tables = spark, b, {}

    def write(self, key: str, df: DataFrame, by: list[str] | None = None, path: str | None = None) -> None:
        """Write the table ``key``; the one it replaces goes after. Files at a given ``path`` are the caller's and stay."""
        old, name = self.tables.get(key), f"warmstart_{key}_{uuid.uuid4().hex}"
        if path:
            delete_path(self.spark, path)  # what a run that broke off may have left
        at = path or scratch_path(self.spark, f"blocks-{key}")
        out = df.write.option("path", at).bucketBy(self.b, "slot")
        (out.partitionBy(*by) if by else out).saveAsTable(name)
        self.tables[key] = (name, None if path else at, at)
        if old:
            self._drop(*old)

    def read(self, key: str) -> DataFrame:
        return self.spark.table(self.tables[key][0])

    def _drop(self, name: str, own: str | None, at: str) -> None:
        self.spark.sql(f"drop table if exists {name}")  # the files were given a path: they stay
        if own:
            delete_path(self.spark, own)

    def close(self, keep: str) -> DataFrame:
        """All names and files go but the files of ``keep``, which are returned as a table."""
        name, _, at = self.tables.pop(keep)
        kept = self.spark.read.schema(self.spark.table(name).schema).parquet(at)
        self._drop(name, None, at)
        self.abandon()
        return kept

    def abandon(self) -> None:
        for t in self.tables.values():
            self._drop(*t)
        self.tables = {}


@dataclass
class Side:
    """A block of one side: sorted ids, a factor row and a bias for each."""

    ids: np.ndarray
    vec: np.ndarray
    bias: np.ndarray


def _packed(side: DataFrame, b: int, seed: int, names: str) -> DataFrame:
    """Blocks of a factor table (id, vec, bias): one row (block, ids, vec, bias) each, the last three as bytes.

    Every block from 0 to b - 1 has a row, if only an empty one."""
    block, *parts = names.split()

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        columns = (pdf["id"].to_numpy(dtype=np.int64), np.stack(pdf["vec"].to_numpy()).astype(np.float64), pdf["bias"].to_numpy(dtype=np.float64))
        return pd.DataFrame({block: [key[0]], **{n: [x.tobytes()] for n, x in zip(parts, columns)}})

    rows = (side.select(block_of("id", b, seed).alias("_b"), F.col("id").cast("long").alias("id"), "vec", "bias")
            .groupBy("_b").applyInPandas(pack, f"{block} int, " + ", ".join(f"{n} binary" for n in parts)))
    every = side.sparkSession.range(b).select(F.col("id").cast("int").alias(block))
    return every.join(rows, block, "left").select(block, *(F.coalesce(n, F.lit(b"")).alias(n) for n in parts))


def _side(ids: bytes, vec: bytes, bias: bytes) -> Side:
    n = len(ids) // 8
    return Side(np.frombuffer(ids, dtype=np.int64), np.frombuffer(vec, dtype=np.float64).reshape(n, -1).copy() if n else np.zeros((0, 1)),
                np.frombuffer(bias, dtype=np.float64).copy())


def _unpacked(state: DataFrame, names: str) -> DataFrame:
    """(id, vec, bias) rows of packed blocks."""
    def rows(batches):
        for pdf in batches:
            for ids, vec, bias in zip(*(pdf[c] for c in pdf.columns)):
                s = _side(ids, vec, bias)
                for k in range(0, len(s.ids), 10_000):
                    yield pd.DataFrame({"id": s.ids[k:k + 10_000], "vec": list(s.vec[k:k + 10_000]), "bias": s.bias[k:k + 10_000]})

    return state.select(*names.split()).mapInPandas(rows, "id long, vec array<double>, bias double")


def _packed_entries(entries: DataFrame, b: int, slots: list[int]) -> DataFrame:
    """Entries (u, i, r, ub, ib) packed by block pair: (stratum, slot, ru, ri, rr), by u and i inside."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "i"], kind="mergesort")
        return pd.DataFrame({"stratum": [key[0]], "slot": [slots[key[1]]], "ru": [pdf["u"].to_numpy(dtype=np.int64).tobytes()],
                             "ri": [pdf["i"].to_numpy(dtype=np.int64).tobytes()], "rr": [pdf["r"].to_numpy(dtype=np.float64).tobytes()]})

    return (entries.withColumn("stratum", F.pmod(F.col("ib") - F.col("ub"), F.lit(b))).groupBy("stratum", "ub")
            .applyInPandas(pack, "stratum int, slot long, ru binary, ri binary, rr binary"))  # a block pair is a file wherever it was packed


#: Entries that ``Strata.measure`` works on at once.
MEASURED = 1 << 16


def places(u: np.ndarray, i: np.ndarray, one: Side, two: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, place of u, place of i) for every pair of rows of the sides with an entry's ids."""
    lu, li = np.searchsorted(one.ids, u), np.searchsorted(two.ids, i)
    nu, ni = np.searchsorted(one.ids, u, "right") - lu, np.searchsorted(two.ids, i, "right") - li
    n = nu * ni
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, lu[at] + k // np.maximum(ni[at], 1), li[at] + k % np.maximum(ni[at], 1)


_FIRST, _SECOND = "uid pu bu", "iid qi bi"


class Strata:
    """The state of two sides in ``b`` blocks each, and the entries (u, i, r) between them."""

    def __init__(self, spark, b: int, seed: int):
        self.spark, self.b, self.seed = spark, b, seed
        self.slots, self.tables = block_keys(spark, b), Buckets(spark, b)
        self.slot_of = F.lit(self.slots).cast("array<long>")

    def begin(self, first: DataFrame, second: DataFrame, entries: DataFrame | None, more: dict[str, DataFrame] | None = None) -> None:
        """Factor tables (id, vec, bias) of both sides; entries with long ids and a double, and ``more`` of them to be measured only."""
        b, seed = self.b, self.seed
        state = (_packed(first, b, seed, "ub uid pu bu")
                 .join(_packed(second, b, seed + 1, "ib iid qi bi"), F.col("ub") == F.col("ib"))
                 .withColumn("slot", self.slot_of[F.col("ub")]).repartition(b, "slot"))
        self.tables.write("state", state)
        for name, rows in ({"entries": entries} | (more or {}) if entries is not None else {}).items():
            rows = rows.withColumn("ub", block_of("u", b, seed)).withColumn("ib", block_of("i", b, seed + 1))
            self.tables.write(name, _packed_entries(rows, b, self.slots), ["stratum"])

    def run(self, s: int, change: Callable[[np.ndarray, np.ndarray, np.ndarray, Side, Side], None], path: str | None = None) -> None:
        """Stratum s: ``change(u, i, r, first, second)`` updates a pair of blocks in place for its entries, by u and i.

        With ``path`` the blocks are written there as they are updated, and stay (``saved`` reads them)."""
        @F.pandas_udf("pu binary, bu binary, qi binary, bi binary")
        def update(uid: pd.Series, pu: pd.Series, bu: pd.Series, iid: pd.Series, qi: pd.Series, bi: pd.Series, ru: pd.Series,
                   ri: pd.Series, rr: pd.Series) -> pd.DataFrame:
            out = []
            for k in range(len(uid)):
                one, two = _side(uid[k], pu[k], bu[k]), _side(iid[k], qi[k], bi[k])
                if rr[k] is not None:
                    change(np.frombuffer(ru[k], dtype=np.int64), np.frombuffer(ri[k], dtype=np.int64),
                           np.frombuffer(rr[k], dtype=np.float64), one, two)
                out.append([x.tobytes() for x in (one.vec, one.bias, two.vec, two.bias)])
            return pd.DataFrame(out, columns=["pu", "bu", "qi", "bi"])

        with fixed_plans(self.spark, self.b):
            pair = (self._met(s).join(self._entries("entries", s), "slot", "left")
                    .withColumn("new", update("uid", "pu", "bu", "iid", "qi", "bi", "ru", "ri", "rr")))
            self.tables.write("state", pair.select("slot", "ub", "uid", F.col("new.pu").alias("pu"), F.col("new.bu").alias("bu"),
                                                   "ib", "iid", F.col("new.qi").alias("qi"), F.col("new.bi").alias("bi")), path=path)

    def _met(self, s: int) -> DataFrame:
        """The pairs of blocks of stratum s: the first side lies where it is, the blocks of the second move."""
        state = self.tables.read("state")
        moved = state.select(self.slot_of[F.pmod(F.col("ib") - F.lit(s), F.lit(self.b))].alias("slot"), "ib", *_SECOND.split())
        return state.select("slot", "ub", *_FIRST.split()).join(moved.hint("merge"), "slot")

    def _entries(self, name: str, s: int) -> DataFrame:
        return self.tables.read(name).filter(F.col("stratum") == s).select("slot", "ru", "ri", "rr")

    def measure(self, names: list[str], value: Callable[[np.ndarray, np.ndarray, np.ndarray, Side, Side], float]) -> dict[str, tuple[float, int]]:
        """(sum of ``value``, number of entries) of the tables of entries ``names`` with the blocks as they are now.

        ``value(places of the first side, of the second, r, first, second)``. The entries stay where they are packed; only the blocks of
        the second side move, once a stratum, all strata in one job. An entry counts once for every pair of rows with its ids, as in
        a join, and not at all without a value."""
        @F.pandas_udf("total double, n long")
        def of(uid: pd.Series, pu: pd.Series, bu: pd.Series, iid: pd.Series, qi: pd.Series, bi: pd.Series, ru: pd.Series,
               ri: pd.Series, rr: pd.Series) -> pd.DataFrame:
            out = []
            for k in range(len(uid)):
                total, n = 0.0, 0
                if rr[k] is not None:
                    one, two = _side(uid[k], pu[k], bu[k]), _side(iid[k], qi[k], bi[k])
                    u, i, r = (np.frombuffer(x, dtype=t) for x, t in ((ru[k], np.int64), (ri[k], np.int64), (rr[k], np.float64)))
                    for lo in range(0, len(r), MEASURED):
                        some = slice(lo, lo + MEASURED)
                        at, pu_at, pi_at = places(u[some], i[some], one, two)
                        at = r[some][at]
                        here = ~np.isnan(at)
                        total += value(pu_at[here], pi_at[here], at[here], one, two) if here.any() else 0.0
                        n += int(here.sum())
                out.append((total, n))
            return pd.DataFrame(out, columns=["total", "n"])

        with fixed_plans(self.spark, self.b):
            parts = []
            for s in range(self.b):
                met = self._met(s)
                for k, name in enumerate(names):
                    mine = self._entries(name, s).withColumn("_k", F.lit(k))
                    parts.append(met.join(mine, "slot").select("_k", of("uid", "pu", "bu", "iid", "qi", "bi", "ru", "ri", "rr").alias("m")))
            sums = reduce(DataFrame.unionByName, parts).groupBy("_k").agg(F.sum("m.total").alias("total"), F.sum("m.n").alias("n"))
            found = {r["_k"]: (r["total"], r["n"]) for r in sums.collect()}  # a row a name
        return {name: found.get(k, (0.0, 0)) for k, name in enumerate(names)}

    def copy(self, path: str) -> None:
        """Write the blocks as they are now to ``path``."""
        self.tables.read("state").write.mode("overwrite").parquet(path)

    def users(self) -> DataFrame:
        """(id, vec, bias) of the first side."""
        return _unpacked(self.tables.read("state"), _FIRST)

    def items(self) -> DataFrame:
        """(id, vec, bias) of the second side."""
        return _unpacked(self.tables.read("state"), _SECOND)

    def close(self) -> tuple[DataFrame, DataFrame]:
        """Both sides as they are at the end; everything else goes."""
        state = self.tables.close("state")
        return _unpacked(state, _FIRST), _unpacked(state, _SECOND)

    def abandon(self) -> None:
        self.tables.abandon()


def saved(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Both sides (id, vec, bias) of blocks that ``Strata`` wrote to ``path``."""
    state = spark.read.parquet(path)
    return _unpacked(state, _FIRST), _unpacked(state, _SECOND)
