"""Repair of conversation structure: the cheapest edits that make roles alternate, by grammar-compressed dynamic programming.

Rows (conversation, turn, role, text) are taken by turn (nulls first; equal turns by role, then by the MD5 of the text). A
row's first fault counts: blank (no word), duplicate (role and text seen earlier in the conversation), truncated (the
last character that is no white space is not one of ``.!?``). Edits: Keep 0, Rerole to user or assistant 3, Delete 4
(required for blank and duplicate rows), Insert an empty user or assistant row anywhere 3; a truncated row that stays
costs 3 more. The role initials left must read ``(s?(ua)+)?``. The cheapest edits are wanted; of several, the ones whose
initials (the audit) come first in ASCII order.

1. A row is one of 16 symbols (role initial s, u, a or other, by fault). Rows are sorted over all conversations by range, and runs
   of a conversation in a partition become strings of at most ``CHUNK`` symbols: a conversation of any length is many rows.
2. Equal strings are one row from here on, with a count. Re-Pair: in ``ROUNDS`` rounds the most frequent adjacent pairs over
   all strings (counts weighted by the conversations that have them) get a symbol of their own and are replaced. Only the pairs of
   a round come to the driver. What has no rule stays as it is; rules only save work.
3. The automaton of the pattern has four states, so a string is a 4 x 4 matrix: entry (p, q) is the least cost from p to q and
   the audit of it, a rope of two ropes. Matrices multiply by (min, +). The state after an audit is given by the state before it, so two
   audits of one entry with equal cost differ at some place and neither begins the other: the least of each entry are
   enough for the least whole. Rules are evaluated once, bottom-up, and shared by all strings; then every distinct string once.
4. A conversation folds its strings' costs from the last to the first, then picks audits from the first to the last.

``repaired`` returns the rows left, ``summaries`` a row per conversation. Defined results: a null role or text is one
space (so a null text is blank, and a null role can only be reroled or deleted); null conversation ids are one conversation;
repeated rows are duplicates; a conversation without rows (see ``ids``) has zeros, an empty audit and the hash of the empty string;
empty tables give empty tables; other columns are ignored. The audit, and the hash of a conversation's text, are one value per
conversation: its rows pass through one task for them, streamed in order, never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmstart.llm.common import WORD, store

#: Symbols of one string; rounds of Re-Pair and pairs replaced in each.
CHUNK, ROUNDS, PAIRS = 1024, 6, 16
#: Bytes of evaluated strings up to which they are broadcast; they are summed first.
MAX_BROADCAST = 16 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

OK, BLANK, DUPLICATE, CUT = range(4)
_FIRST, _RULE = ord("A"), 0xE000  # symbols of rows; symbols of rules (private-use characters)
_FAR = 1 << 60
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. 0 and 3 may end.
_USER, _ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}
_TAIL = ["", "II", "I", ""]  # rows inserted after the last one

Rope = str | tuple
Matrix = list[tuple[int, Rope]]


# ---------------------------------------------------------------- (min, +) matrices with audits
def flat(rope: Rope) -> str:
    """The audit that a rope spells."""
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += [r[1], r[0]]
    return "".join(out)


def _less(x: tuple[int, Rope], y: tuple[int, Rope]) -> bool:
    return x[0] < y[0] or (x[0] == y[0] < _FAR and flat(x[1]) < flat(y[1]))


def times(x: Matrix, y: Matrix) -> Matrix:
    """The product of two 4 x 4 matrices (row by row)."""
    out = []
    for p in range(4):
        for q in range(4):
            best = (_FAR, "")
            for m in range(4):
                a, b = x[4 * p + m], y[4 * m + q]
                if a[0] < _FAR and b[0] < _FAR:
                    c = (a[0] + b[0], (a[1], b[1]) if a[1] and b[1] else a[1] or b[1])
                    if _less(c, best):
                        best = c
            out.append(best)
    return out


def _inserts() -> Matrix:
    out: Matrix = [(_FAR, "")] * 16
    for p in range(4):
        out[5 * p] = (0, "")
        q, n = p, 0
        for _ in range(2):  # user, assistant; more rows only cost more
            q, n = (3 if q == 2 else 2), n + 1
            if INSERT * n < out[4 * p + q][0]:
                out[4 * p + q] = (INSERT * n, "I" * n)
    return out


def symbol_matrix(symbol: int) -> Matrix:
    """Any inserted rows, then the edit of one row."""
    initial, fault = divmod(symbol, 4)
    edit: Matrix = [(_FAR, "")] * 16
    for p in range(4):
        edit[5 * p] = (DELETE, "D")
        if fault in (OK, CUT):
            more = TRUNCATED if fault == CUT else 0
            q = _USER.get(p) or _ASSISTANT[p]
            edit[4 * p + q] = (REROLE + more, "R")
            keep = [{0: 1}, _USER, _ASSISTANT, {}][initial].get(p)
            if keep is not None:
                edit[4 * p + keep] = (KEEP + more, "K")
    return times(_inserts(), edit)


def evaluate(seq: str, matrices: dict[str, Matrix]) -> Matrix:
    out = matrices[seq[0]]
    for c in seq[1:]:
        out = times(out, matrices[c])
    return out


# ---------------------------------------------------------------- strings of symbols
def _class(role, text):
    """A row's symbol, duplicates aside: 4 * initial + fault."""
    r, last = F.substring(role, 1, 1), F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.when(r == "s", 0).when(r == "u", 1).when(r == "a", 2).otherwise(3)
    fault = F.when(~F.regexp_like(text, F.lit(WORD)), BLANK).when(last.isin(".", "!", "?"), OK).otherwise(CUT)
    return (4 * initial + fault).cast("int")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, n, symbol, again): strings of consecutive rows of a conversation, in order (part, ord)."""
    part, ord_, schema = TaskContext.get().partitionId(), 0, None
    now, seq, out = None, [], []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], schema), *(pa.array(c, t) for c, t in zip(
            cols[1:], (pa.int32(), pa.int64(), pa.string())))], names=["conv", "part", "ord", "seq"])

    for b in batches:
        schema = b.schema.field(0).type
        for conv, n, symbol, again in zip(*(c.to_pylist() for c in b.columns)):
            if seq and conv != now:
                out.append((now, part, ord_, "".join(seq)))
                ord_, seq = ord_ + 1, []
            now, initial, fault = conv, *divmod(symbol, 4)
            copy = chr(_FIRST + 4 * initial + (BLANK if fault == BLANK else DUPLICATE))
            seq.append(copy if again else chr(_FIRST + symbol))
            left = n - 1
            while left or len(seq) >= CHUNK:
                seq += [copy] * (more := min(left, CHUNK - len(seq)))
                left -= more
                if len(seq) >= CHUNK:
                    out.append((now, part, ord_, "".join(seq)))
                    ord_, seq = ord_ + 1, []
                if len(out) >= 4096:
                    yield batch()
        if out:
            yield batch()
    if seq:
        out.append((now, part, ord_, "".join(seq)))
        yield batch()


def _strings(rows: DataFrame) -> DataFrame:
    """(conv, part, ord, seq) from (conv, turn, role, text)."""
    key = ["conv", "role", "k"]
    each = (rows.select("conv", "turn", "role", F.md5("text").alias("k"), _class(F.col("role"), F.col("text")).alias("symbol"))
            .groupBy("conv", "turn", "role", "k").agg(F.count(F.lit(1)).alias("n"), F.first("symbol").alias("symbol")))
    each = store(each, "turns")
    first = (each.groupBy(*key).agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
             .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("k").alias("h"), "first"))
    marked = each.join(first, F.expr("conv <=> c and role = r and k = h"), "left").select(
        "conv", "turn", "role", "k", "n", "symbol", F.expr("first is not null and not (first.turn <=> turn)").alias("again"))
    order = ["conv", "turn", "role", "k"]
    shape = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), T.StructField("part", T.IntegerType()),
                          T.StructField("ord", T.LongType()), T.StructField("seq", T.StringType())])
    return store(store(marked, "marked").repartitionByRange(*order).sortWithinPartitions(*order)
                 .select("conv", "n", "symbol", "again").mapInArrow(_chunks, shape), "strings")


# ---------------------------------------------------------------- Re-Pair
def grammar(strings: DataFrame) -> tuple[dict[str, str], DataFrame]:
    """Rules {symbol: pair} in the order they were made, and (seq, packed) of every distinct string."""
    packed, rules = strings.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).withColumn("packed", F.col("seq")), {}
    packed = store(packed, "distinct")
    for _ in range(ROUNDS):
        at = F.transform(F.sequence(F.lit(1), F.length("packed") - 1), lambda i: F.substring(F.col("packed"), i, F.lit(2)))
        pairs = (packed.filter(F.length("packed") > 1).select("n", F.explode(at).alias("pair"))
                 .groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(4 * PAIRS))
        chosen, used = [], set()
        for r in pairs.collect():  # at most 4 * PAIRS
            if len(chosen) < PAIRS and not used & set(r["pair"]):
                chosen.append(r["pair"])
                used |= set(r["pair"])
        if not chosen:
            break
        column = F.col("packed")
        for pair in chosen:
            rules[chr(_RULE + len(rules))] = pair
            column = F.replace(column, F.lit(pair), F.lit(chr(_RULE + len(rules) - 1)))
        packed = store(packed.withColumn("packed", column), "packed")
    return rules, packed.select("seq", "packed")


def rule_matrices(rules: dict[str, str]) -> dict[str, Matrix]:
    """The matrix of every symbol: rows first, then rules bottom-up."""
    out = {chr(_FIRST + s): symbol_matrix(s) for s in range(16)}
    for symbol, pair in rules.items():
        out[symbol] = times(out[pair[0]], out[pair[1]])
    return out


def _evaluated(packed: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(seq, costs, ranks, audits) of every distinct string; ranks order the audits of one start state."""
    known = rule_matrices(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs, ranks, audits = [], [], []
            for seq in b.column(1).to_pylist():
                m = evaluate(seq, known)
                text = [flat(r) for _, r in m]
                costs.append([c for c, _ in m])
                ranks.append([sum(text[4 * p + o] < text[4 * p + q] for o in range(4)) for p in range(4) for q in range(4)])
                audits.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32())),
                                              pa.array(audits, pa.list_(pa.string()))], names=["seq", "costs", "ranks", "audits"])

    return store(packed.repartition("seq").mapInArrow(
        work, "seq string, costs array<long>, ranks array<int>, audits array<string>"), "evaluated")


# ---------------------------------------------------------------- conversations
_PICK = "conv_part int, conv_ord long, seq string, entry int, tail string, cost long, illegal long"


def _pick(chunks: list[tuple]) -> list[tuple]:
    """For the strings (part, ord, seq, costs, ranks) of one conversation: (part, ord, seq, entry, tail, cost, illegal)."""
    togo = [[0, 2 * INSERT, INSERT, 0]]
    for _, _, _, costs, _ in reversed(chunks):
        togo.append([min(costs[4 * p + q] + togo[-1][q] for q in range(4)) for p in range(4)])
    togo.reverse()
    out, p, before = [], 0, None
    for i, (part, ord_, seq, costs, ranks) in enumerate(chunks):
        after = togo[i + 1]
        q = min(range(4), key=lambda s: (costs[4 * p + s] + after[s], ranks[4 * p + s]))
        initials = [(ord(c) - _FIRST) // 4 for c in seq]
        pairs = zip(([before] if before is not None else []) + initials, initials if before is not None else initials[1:])
        illegal = sum(x not in ((0, 1), (1, 2), (2, 1)) for x in pairs)
        last = i == len(chunks) - 1
        out.append((part, ord_, seq, 4 * p + q, _TAIL[q] if last else "", costs[4 * p + q] + (togo[-1][q] if last else 0), illegal))
        p, before = q, initials[-1]
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, part, ord, seq, costs, ranks), conversations side by side."""
    now, chunks, types = None, [], None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          names=["conv", "part", "ord", "seq", "entry", "tail", "cost", "illegal"])

    out: list[tuple] = []
    for b in batches:
        types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        for conv, *chunk in zip(*(c.to_pylist() for c in b.columns)):
            if chunks and conv != now:
                out += [(now, *r) for r in _pick(chunks)]
                chunks = []
            now = conv
            chunks.append(tuple(chunk))
        if out:
            yield batch(out)
            out = []
    if chunks:
        yield batch([(now, *r) for r in _pick(chunks)])


def audits(rows: DataFrame) -> DataFrame:
    """(conv, part, ord, seq, piece, cost, illegal): the audit of every conversation in pieces, in the order (part, ord)."""
    strings = _strings(rows)
    rules, packed = grammar(strings)
    known = _evaluated(packed, rules)
    size = known.agg(F.sum(F.octet_length("seq") + F.octet_length(F.array_join("audits", "")) + 256)).first()[0] or 0
    known = F.broadcast(known) if size <= MAX_BROADCAST else known
    kind = strings.schema["conv"].dataType
    shape = T.StructType([T.StructField("conv", kind), T.StructField("part", T.IntegerType()), T.StructField("ord", T.LongType()),
                          T.StructField("seq", T.StringType()), T.StructField("entry", T.IntegerType()), T.StructField("tail", T.StringType()),
                          T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType())])
    picked = (strings.join(known.drop("audits"), "seq").select("conv", "part", "ord", "seq", "costs", "ranks")
              .repartition("conv").sortWithinPartitions("conv", "part", "ord").mapInArrow(_fold, shape))
    return store(picked.join(known.select("seq", "audits"), "seq").select(
        "conv", "part", "ord", "seq", F.concat(F.col("audits")[F.col("entry")], "tail").alias("piece"), "cost", "illegal"), "audits")


def _streamed(rows: DataFrame, pieces: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Per conversation its mark (if in ``ids``), audit pieces and rows, in this order, in one partition."""
    kinds = {f.name: f.dataType for f in rows.schema}
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    head = pieces.select("conv", F.lit(1).alias("tag"), "part", "ord", none("turn", kinds["turn"]), none("role", "string"),
                         none("k", "string"), none("text", "string"), "seq", "piece", "cost", "illegal")
    body = rows.select("conv", F.lit(2).alias("tag"), none("part", "int"), none("ord", "long"), "turn", "role", F.md5("text").alias("k"),
                       "text", none("seq", "string"), none("piece", "string"), none("cost", "long"), none("illegal", "long"))
    both = head.union(body)
    if ids is not None:
        both = both.union(ids.select(F.col("conv").cast(kinds["conv"]), F.lit(0), *(F.lit(None).cast(f.dataType) for f in both.schema.fields[2:])))
    return (both.repartition("conv").sortWithinPartitions("conv", "tag", "part", "ord", "turn", "role", "k")
            .select("conv", "tag", "turn", "role", "text", "seq", "piece", "cost", "illegal"))


class _Walk:
    """One conversation as it streams by: audit pieces first, then its rows."""

    def __init__(self, conv):
        self.conv, self.pieces, self.at, self.state, self.rows = conv, [], 0, 0, 0
        self.cost = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.least = self.most = self.before = None
        self.turns = 0
        self.hash = hashlib.sha256()

    def piece(self, seq: str, piece: str, cost: int, illegal: int) -> None:
        self.pieces.append(piece)
        self.cost += cost
        self.illegal += illegal
        for c in seq:
            self.faults[(ord(c) - _FIRST) % 4] += 1

    def edits(self) -> Iterator[str]:
        for p in self.pieces:
            yield from p

    def put(self, role: str, text: str) -> tuple[str, str]:
        self.hash.update((b"\n" if self.rows else b"") + f"{role}:{text}".encode())
        self.rows += 1
        return role, text

    def turn(self, turn) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn

    def insert(self) -> tuple[str, str]:
        role = "assistant" if self.state == 2 else "user"
        self.state = 3 if self.state == 2 else 2
        return self.put(role, "")

    def edit(self, op: str, role: str, text: str) -> tuple[str, str] | None:
        """A row's edit; the row that is left of it."""
        if op == "D":
            return None
        if op == "K" and role[:1] == "s":
            self.state = 1
            return self.put(role, text)
        then = "assistant" if self.state == 2 else "user"
        self.state = 3 if self.state == 2 else 2
        return self.put(role if op == "K" else then, text)

    def summary(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, self.cost,
                "".join(self.pieces), self.hash.hexdigest())


def _stream(names: list[str], types: list, want_rows: bool):
    """Arrow function over ``_streamed`` rows: the rows left of each conversation, or a summary of it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, ops, out, kinds = None, None, [], None

        def end() -> None:
            if walk is None:
                return
            for _ in (ops if ops is not None else walk.edits()):  # what is left of the audit are rows inserted at the end
                left = walk.insert()
                if want_rows:
                    out.append((walk.conv, walk.rows - 1, None, "I", *left))
            if not want_rows:
                out.append(walk.summary())

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        for b in batches:
            kinds = [b.schema.field(0).type, *types]
            if want_rows:
                kinds[2] = b.schema.field("turn").type
            for conv, tag, turn, role, text, seq, piece, cost, illegal in zip(*(c.to_pylist() for c in b.columns)):
                if walk is None or conv != walk.conv:
                    end()
                    walk, ops = _Walk(conv), None
                if tag == 1:
                    walk.piece(seq, piece, cost, illegal)
                elif tag == 2:
                    ops = walk.edits() if ops is None else ops
                    walk.turn(turn)
                    op = next(ops)
                    while op == "I":
                        left = walk.insert()
                        if want_rows:
                            out.append((conv, walk.rows - 1, None, "I", *left))
                        op = next(ops)
                    left = walk.edit(op, role, text)
                    if left and want_rows:
                        out.append((conv, walk.rows - 1, turn, op, *left))
            if out:
                yield batch()
        end()
        if out:
            yield batch()

    return work


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, seq, turn, edit, role, text): the rows of the repaired conversations, ``seq`` from 0; inserted rows have no turn."""
    plain = store(_plain(rows, conv, turn, role, text), "rows")
    kinds = {f.name: f.dataType for f in plain.schema}
    shape = T.StructType([T.StructField("conv_id", kinds["conv"]), T.StructField("seq", T.LongType()), T.StructField("turn", kinds["turn"]),
                          *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
    types = [pa.int64(), None, pa.string(), pa.string(), pa.string()]
    return _streamed(plain, audits(plain), None).mapInArrow(_stream(shape.names, types, True), shape)


def summaries(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation.

    ``ids`` (a column named as ``conv``) names conversations that are wanted even without rows. ``gaps`` are the turn numbers
    missing between the least and the greatest, ``illegal`` the adjacent rows whose role initials are not su, ua or au,
    ``repaired_sha256`` hashes the repaired ``role:text``, joined by line feeds."""
    plain = store(_plain(rows, conv, turn, role, text), "rows")
    wanted = None if ids is None else ids.select(F.col(conv).alias("conv")).distinct()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    shape = T.StructType([T.StructField("conv_id", plain.schema["conv"].dataType), *(T.StructField(c, T.LongType()) for c in names[1:7]),
                          *(T.StructField(c, T.StringType()) for c in names[7:])])
    types = [pa.int64()] * 6 + [pa.string()] * 2
    return _streamed(plain, audits(plain), wanted).mapInArrow(_stream(names, types, False), shape)
