"""Token counts without token ids: pieces per distinct pre-token, joined to document frequencies.

A pre-token is a line feed, or a run of spaces with the characters after it up to the next space or line feed. No
piece of the vocabulary crosses such a border (``check_vocabulary`` makes sure), so a text has as many tokens as
its pre-tokens have.

1. Every task counts the pre-tokens of its texts; Spark adds the counts up: one row per distinct pre-token.
2. Each distinct pre-token is encoded once.
3. The most frequent ones (``FREQUENT`` at most, about 90 % of all words here) are broadcast: they are summed
   up within the document's row. What is left goes to the pre-token table by a shuffled join, as (document,
   pre-token, frequency) rows, so no pre-token that many documents share is ever a join key.

A row is known by a number that is given once and stored, so repeated ids do no harm.

Defined results: null texts count as empty (0 bytes, 0 tokens); control strings inside texts are ordinary text; repeated
rows get equal counts; a very long text is a slice of its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmstart.llm.common import store

FREQUENT = 1 << 17
MAX_FREQUENT_BYTES = 64 << 20
_HELD = 400_000  # distinct pre-tokens that a task holds before it emits them
_SPACE = "▁"
_PRETOKEN = re.compile("\n| *[^ \n]+| +")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, spaces as they are after the library's leading one."""
    return _PRETOKEN.findall(" " + text.replace(_SPACE, " ")) if text else []


def check_vocabulary(pieces: list[str]) -> None:
    """Raise if a piece crosses a pre-token border."""
    for p in pieces:
        if re.search(f"[^{_SPACE}]{_SPACE}", p) or "\n" in p or " " in p:
            raise ValueError(f"piece {p!r} crosses a pre-token border")


_models: dict[str, object] = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def piece_count(model, pretoken: str) -> int:
    # after a line feed there is no leading space to add; it and the library's own space are two pieces
    return 1 if pretoken == "\n" else len(model.encode("\n" + pretoken)) - 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())],
                                          names=["pretoken", "n"])

    held: Counter = Counter()
    for b in batches:
        for text in b.column(0):
            held.update(pretokens(text.as_py() or ""))
            if len(held) > _HELD:
                yield out(held)
                held = Counter()
    yield out(held)


def pretoken_pieces(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(pretoken, n, pieces): frequency and number of pieces of every distinct pre-token of ``docs``."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for b in batches:
            pieces = [piece_count(model, x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.int64())], names=["pretoken", "n", "pieces"])

    counts = (docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
              .mapInArrow(_count, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n")))
    return counts.mapInArrow(encode, "pretoken string, n long, pieces long")


def _most_frequent(table: DataFrame, limit: int) -> DataFrame:
    """The rows of the highest frequency classes (sixteenths of a power of two) that are ``limit`` rows at most.

    Only the sizes of the classes reach the driver, about a thousand rows for any table."""
    grade = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for r in table.groupBy(grade.alias("g")).count().orderBy(F.desc("g")).collect():
        total += r["count"]
        if total > limit:
            break
        least = r["g"]
    return table.filter(grade >= least) if least is not None else table.limit(0)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 frequent: int = FREQUENT) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of ``docs``."""
    spark = docs.sparkSession
    model = _model(model_path)
    check_vocabulary([model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)])
    table = store(pretoken_pieces(docs, model_path, text_col), "pretokens")
    got = _most_frequent(table.filter("length(pretoken) <= 64"), frequent).select("pretoken", "pieces").toPandas()
    known = dict(zip(got["pretoken"], got["pieces"].tolist()))
    if sum(len(k.encode()) + 64 for k in known) > MAX_FREQUENT_BYTES:
        raise ValueError("the frequent pre-tokens pass MAX_FREQUENT_BYTES")
    shared = spark.sparkContext.broadcast(known)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes, the tokens of frequent pre-tokens, and the other pre-tokens with their frequencies."""
        get = shared.value.get
        for b in batches:
            size, tokens, rest, times, cut = [], [], [], [], [0]
            for t in b.column(1):
                text = t.as_py() or ""
                total = 0
                for word, n in Counter(pretokens(text)).items():
                    pieces = get(word)
                    if pieces is None:
                        rest.append(word)
                        times.append(n)
                    else:
                        total += n * pieces
                size.append(len(text.encode()))
                tokens.append(total)
                cut.append(len(rest))
            words = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(times, pa.int64())], names=["w", "n"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cut, pa.int32()), words)], names=["id", "n_bytes", "known", "rest"])

    word = T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.LongType())])
    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                          T.StructField("known", T.LongType()), T.StructField("rest", T.ArrayType(word))])
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(split, shape)
            .withColumn("row", F.monotonically_increasing_id()))
    rows = store(rows, "rest")
    # the join needs only what is not broadcast
    other = (rows.select("row", F.explode("rest").alias("r")).select("row", "r.w", "r.n")
             .join(table.select(F.col("pretoken").alias("w"), "pieces"), "w")
             .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more")))
    return (rows.select("row", "id", "n_bytes", "known").join(other, "row", "left")
            .select("id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")))
