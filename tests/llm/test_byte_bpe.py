"""Byte-level BPE against the tiktoken library, over texts, edits and every code point."""

import hashlib
import random
import unicodedata
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from paddock.llm import byte_bpe
from paddock.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"
RANKS, PATTERN = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "It's we've I'LL  two"), (5, "ab" * 4000), (6, "é你😀\x1c\x85\xa0 " * 50), (7, "<|endoftext|> x"), (8, "w " * 5000), (8, "w " * 5000), (None, "no id"), (9, "a" * 3000 + " " * 3000)]


def library(ranks=RANKS, pattern=PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    clash = {"ids": F.lit("x"), "n_tokens": F.lit(1)}
    edge = spark.createDataFrame(EDGE, "doc_id long, text string").withColumns(clash)
    return edge.union(spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text").withColumns(clash))


def test_ids_and_decoded_text_equal_the_library(docs):
    lib, sha = library(), lambda b: hashlib.sha256(b).hexdigest()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = Counter()
    for i, t in rows:
        ids = lib.encode_ordinary(t)
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(lib.decode_bytes(ids))] += 1
    assert Counter(map(tuple, byte_bpe.encode(docs, RANKS, PATTERN).collect())) == want
    encoded = byte_bpe.token_ids(docs, RANKS, PATTERN).persist()
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(lib.encode_ordinary(t))) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.data)) for r in byte_bpe.decode(encoded, RANKS).collect()) == Counter((i, t.encode()) for i, t in rows)
    none = docs.where("false")
    assert byte_bpe.encode(none, RANKS, PATTERN).count() == byte_bpe.token_ids(none, RANKS, PATTERN).count() == 0


def test_the_query_reads_all_documents(spark):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op12_byte_bpe"](spark, DATA).collect()}
    lib = library()
    assert got == {r.doc_id: len(lib.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_every_code_point_is_split_as_the_library_does(name):
    path = tokenizer_path(name)
    encoder, lib = byte_bpe.Encoder(path, PATTERN), library(path)
    # Of letters newer than Python's tables the two libraries think differently; only the second vocabulary has tokens that show it.
    known = "50k" in name and "multi" not in name
    chars = [chr(c) for c in range(0, 0x30000, 5) if not 0xD800 <= c < 0xE000 and (known or unicodedata.category(chr(c)) != "Cn")]
    lines = ["".join(f"a{c}1{c}!{c} {c}" for c in chars[k : k + 64]) for k in range(0, len(chars), 64)]
    assert [list(x) for x in encoder.ids(lines)] == lib.encode_ordinary_batch(lines, num_threads=2)


def test_a_forgetful_encoder_gives_the_same(docs):
    small, lib = byte_bpe.Encoder(RANKS, PATTERN, kept=5), library()
    for r in docs.limit(60).collect():
        assert list(small.ids([r.text or ""])[0]) == lib.encode_ordinary(r.text or "")


def test_appends_and_edits_equal_encoding_anew():
    rng, lib = random.Random(5), library()
    bpe, split = byte_bpe.PrefixBpe(byte_bpe.read_ranks(RANKS)), byte_bpe.Splitter(PATTERN)
    letters = "abtheing '  \n\t1é你😀\x85\xa0\x1c.!s're"
    some = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    for _ in range(300):
        state = byte_bpe.EncodedText(bpe, split, some(80))
        for _ in range(6):
            if rng.random() < 0.4:
                state.append(some(9))
            else:
                start = rng.randrange(len(state.text) + 1)
                state.replace(start, min(len(state.text), start + rng.randrange(8)), some(7))
            assert state.ids() == lib.encode_ordinary(state.text)


def test_an_edit_works_out_only_pieces_near_it():
    bpe, split = byte_bpe.PrefixBpe(byte_bpe.read_ranks(RANKS)), byte_bpe.Splitter(PATTERN)
    state = byte_bpe.EncodedText(bpe, split, "some words and more of them, " * 1000)
    assert state.replace(14_000, 14_003, "xyz") <= 6 and state.append("end") <= 3
    assert state.ids() == library().encode_ordinary(state.text)


def test_edits_of_a_table(spark):
    rows = [(1, "some text", [(0, 4, "More"), (99, 200, "!")]), (2, None, [(0, 0, "new")]), (3, "as it was", None), (4, "cut here", [(3, 8, None)]), (None, "", [])]
    d = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start int, stop int, new string>>").withColumn("ids", F.lit(0))
    got = {r.doc_id: r.ids for r in byte_bpe.apply_edits(d, RANKS, PATTERN).collect()}
    lib = library()
    assert got == {1: lib.encode_ordinary("More text!"), 2: lib.encode_ordinary("new"), 3: lib.encode_ordinary("as it was"), 4: lib.encode_ordinary("cut"), None: []}


def test_a_token_that_no_merge_makes_is_only_a_whole_piece():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"cd": 300}
    lib = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks={k: i for i, k in enumerate(sorted(ranks, key=ranks.get))}, special_tokens={})
    bpe = byte_bpe.PrefixBpe({k: i for i, k in enumerate(sorted(ranks, key=ranks.get))})
    for text in ("abc", "abcd", "xabc", "bcbc", "aabcc"):
        assert byte_bpe.Prefixes(bpe, text.encode()).ids() == lib.encode_ordinary(text)
