import gzip
import hashlib
import io

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.conftest import SF01
from warmstart.llm import token_counts, warc
from warmstart.llm.common import table
from warmstart.llm.queries import QUERIES, TOKENIZER

BIG = "é" * 600


def archive(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    return warc.read_archives(spark, warc.write_archives(pages, warc.archive_folder(spark)))


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (3, None, BIG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
            (None, "n", BIG), (8, "u", "WARC/1.1\r\n\r\n\r\n" * 100), (9, "u", "x" * 3_000_000), (3, None, BIG), (10, "u", "x" * 999), (11, "u", "x" * 999),
            (12, "u", "y" * 1000), (13, "u", "y" * 1000), (None, None, None)]
    got = archive(spark, rows).collect()
    want = []
    for i, u, h in rows:
        h = h or ""
        raw = h.encode()
        same = [j for j, _, x in rows if (x or "") == h and j is not None]
        to = max(same) if len(raw) >= 1000 and len(same) > 0 and i != max(same) else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to, raw if to is None else None,
                     u and u.replace("\r", "%0D").replace("\n", "%0A")))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"]), r["url"]) for r in got), key=key) == sorted(want, key=key)


def test_whole_pages_table(spark):
    pages = table(spark, SF01, "pages")
    got = {r["page_id"]: r for r in QUERIES["op5_warc"](spark, SF01).collect()}
    for r in pages.collect():
        raw = (r["html"] or "").encode()
        assert (got[r["page_id"]]["payload_bytes"], got[r["page_id"]]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())


def test_empty_table(spark):
    assert archive(spark, []).count() == 0


def records(*payloads):
    return [warc.record_bytes("response", p, i, f"http://x/{i}") for i, p in enumerate(payloads)]


def test_one_gzip_member_per_record_and_incremental_reading():
    raw = records(b"a" * 10, b"", b"b" * 500_000)

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))  # members end inside and between reads

    got = list(warc.read_records(Slow(b"".join(raw))))
    assert [r.payload for r in got] == [b"a" * 10, b"", b"b" * 500_000]
    assert all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in raw)


@pytest.mark.parametrize("harm", ["cut", "digest", "length", "payload", "garbage"])
def test_damage_is_found(harm):
    plain = gzip.decompress(records(b"some payload here")[0])
    if harm == "cut":
        raw = records(b"some payload here")[0][:-9]
    elif harm == "digest":
        raw = gzip.compress(plain.replace(b"payload here", b"payload hers"))
    elif harm == "length":
        raw = gzip.compress(plain + b"x")
    elif harm == "payload":
        raw = gzip.compress(plain.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:AA"))
    else:
        raw = records(b"x")[0] + b"not gzip"
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(raw)))


TEXTS = [None, "", " ", "   ", "a", " a ", "a  b", "a\nb", "\n", "\n\n a \n", "a\tb\r\nc", "<s> </s> <unk> <0x0A>", "▁a▁ b▁▁c", "日本語 テキスト", "😀😀 é é", "x" * 30_000,
         "word " * 20_000, "a\u00a0b", "a\0b", "123 4567.89", "The quick brown fox", "ﬁ ligature", "▁", "\n▁\n", "  \n  x"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(TOKENIZER))


@pytest.mark.parametrize("frequent", [0, 5, 1 << 17])
def test_token_counts_equal_the_library(spark, model, frequent):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[20]), (None, TEXTS[20])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("w", F.lit(1))
    got = token_counts.token_counts(d, public_tokenizers.path(TOKENIZER), frequent=frequent).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows]
    assert sorted(((r["id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(d.limit(0), public_tokenizers.path(TOKENIZER)).count() == 0


def test_token_counts_of_the_documents(spark, model):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF01, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op9_token_counts"](spark, SF01).collect()}
    ids = list(docs)
    assert [got[i] for i in ids] == [len(x) for x in model.encode([docs[i] or "" for i in ids], num_threads=1)]


def test_piece_across_a_border_is_refused():
    with pytest.raises(ValueError):
        token_counts.check_vocabulary(["▁a", "b▁c"])
