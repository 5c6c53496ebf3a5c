import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinforge.llm import packing, pretokens, queries, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TRICKY = [" a  b", "", "it's he'll 'S x''s", "ABC,def!!--x 12²3½ ÀÉŸ ŉ ſs ª1", "x\n\n y\t z ", "İstanbul", "a b c", "日本 <|endoftext|> q", "é" * 300, "'", "''re's", "  ", "é", "\x00\x1c\x85"]


def test_caches_agree_with_the_library():
    rng = np.random.default_rng(1)
    alphabet = list("aZé'.,!-_ \n\t12²'sS\"ſÿŸ ")
    texts = TRICKY + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(1500)]
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    ids = pretokens.Ids(WORDS)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == want
    want = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    lengths = pretokens.Lengths(BYTES, {" a": 1})
    for _ in range(2):
        assert lengths.counts(texts) == want


def test_counts(odd, none, docs):
    library = Tokenizer.from_file(BYTES)
    for df in (odd, docs):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, BYTES).collect()))
        want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert got == want
    assert token_counts.count_tokens(none, BYTES).count() == 0


def check_packing(df, capacity=2048, open_bins=packing.OPEN):
    library = Tokenizer.from_file(WORDS)
    want = sorted(((r.doc_id is None, r.doc_id or 0), library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in df.collect())
    rows = packing.pack_documents(df, WORDS, capacity, open_bins=open_bins).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id is None, r.doc_id or 0)].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= capacity
    for spans in by_bin.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    told = sorted((k, x) for k, rs in by_doc.items() for x in joined(rs, capacity))
    assert told == want
    return sum(r.length for r in rows), len(by_bin)


def joined(rows, capacity):
    """The documents of rows that share an id: repeated documents have repeated pieces."""
    rows = sorted(rows, key=lambda r: (r.piece, r.sequence_id, r.offset))
    firsts = [r for r in rows if r.piece == 0]
    if len(firsts) > 1:
        assert all(r.piece == 0 for r in rows)
        return [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
    assert [r.start for r in rows] == [capacity * i for i in range(len(rows))] and all(r.length == capacity for r in rows[:-1])
    return [np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist()]


def test_packing(odd, none, docs):
    check_packing(odd)
    check_packing(odd, capacity=64, open_bins=2)
    total, bins = check_packing(docs.coalesce(1))
    assert bins <= 1.05 * total / 2048 + 1
    assert packing.pack_documents(none, WORDS).count() == 0


def test_many_small_partitions_fill_sequences_too(docs):
    total, bins = check_packing(docs.repartition(50))
    assert bins <= 1.05 * total / 2048 + 1


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert fit.place(3) == (1, 7)
    assert fit.place(9) == (2, 0)
    assert fit.place(8) == (3, 0)  # bin 2 was the fullest and has closed
    assert fit.place(1) == (3, 8)
    assert fit.place(4) == (0, 6)


def test_query_one(spark, data):
    rows = queries.op1_packing(spark, data).collect()
    one = next(r for r in rows if r.doc_id == 1)
    text = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id = 1").first().text
    ids = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids + [0]
    assert one.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and one.length == len(ids)
    assert queries.op6_token_counts(spark, data).filter(F.col("over_limit") != (F.col("n_tokens") > 512)).count() == 0
