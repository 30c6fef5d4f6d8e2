"""Runs of periodic words against a plain account of them."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paddock.llm import period_runs
from paddock.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=6, power=4):
    """Every longest stretch of each period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // power + 1):
        at = 0
        while at < len(w) - q:
            end = at
            while end < len(w) - q and w[end] == w[end + q]:
                end += 1
            if end - at + q >= max(least, power * q) and end > at:
                found.setdefault((at, end + q), q)
            at = end + 1
    # A stretch whose smallest period is a divisor is the same stretch there.
    return sorted((s, e - s, q) for (s, e), q in found.items())


def found_runs(w, least=6, power=4):
    split = [[b"%d" % x for x in w]]
    return period_runs.runs_of_texts(period_runs.Words(), split, least, power).get(0, [])


def all_windows(w, least=6, power=4):
    return period_runs.runs_of(np.array(w, np.int64), [(0, len(w))], least, power)


@pytest.mark.parametrize("least,power", [(6, 4), (2, 2), (6, 2), (9, 3), (1, 5)])
def test_runs_of_random_words(least, power):
    rng = random.Random(least * 10 + power)
    for _ in range(400):
        w = []
        while len(w) < rng.randrange(1, 70):
            part = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 7))]
            w += part * rng.randrange(1, 7)
        want = plain_runs(w, least, power)
        assert found_runs(w, least, power) == want and all_windows(w, least, power) == want, w


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_any_words(w):
    assert found_runs(w) == plain_runs(w)


def test_long_and_deep_words():
    """Equal words, Fibonacci words and long periods, where the tree is deep."""
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    rng = random.Random(3)
    once = [rng.randrange(50) for _ in range(400)]
    for w in ([7] * 5000, b, once * 6 + [99] + once * 5, [*range(300)] * 4 + [1] * 6):
        assert found_runs(w) == plain_runs(w)


def test_colours_are_last_ends():
    """Each segment's longest string ended last where the automaton says."""
    rng = random.Random(8)
    for _ in range(60):
        w, ends = [rng.randrange(3) for _ in range(40)], period_runs.LastEnds()
        for i, x in enumerate(w):
            segments = ends.append(x)
            lengths = dict(segments)
            for length, before in segments:
                string = w[i + 1 - length : i + 1]
                assert max(e for e in range(length - 1, i) if w[e + 1 - length : e + 1] == string) == before
            longest = max((n for n in range(1, i + 1) if any(w[e + 1 - n : e + 1] == w[i + 1 - n : i + 1] for e in range(n - 1, i))), default=0)
            assert max(lengths, default=0) == longest


def account(i, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(w)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_documents_and_awkward_rows(spark):
    edge = [(1, None), (2, ""), (3, " \n\t"), (4, "x " * 40), (5, "a b a b a b a b c\x0bc c c c c"), (5, "a b a b a b a b c\x0bc c c c c"), (None, "no no no no no no no"), (10, "é\xa0é " * 9), (39, "one two three four five six seven eight"), (40, "word " * 3000 + "end")]
    clash = {"runs": F.lit("x"), "collapsed": F.lit(1), "start": F.lit(2)}
    d = spark.createDataFrame(edge, "doc_id long, text string").withColumns(clash)
    real = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("n", F.length("text")).where("n < 6000").select((F.col("doc_id") + 1000).alias("doc_id"), "text").withColumns(clash)
    both = d.union(real)
    got = period_runs.digests(period_runs.find_runs(both, rewrite=period_runs.repeat_tails))
    assert Counter(map(tuple, got.collect())) == Counter(account(r.doc_id, r.text) for r in both.collect())
    assert period_runs.digests(period_runs.find_runs(both.where("false"))).count() == 0
    plain = {r.doc_id: r.collapsed for r in period_runs.find_runs(d).collect()}
    assert plain[4] == "x" and plain[5] == "a b c" and plain[None] == "no" and plain[1] == ""


def test_the_query_reads_all_documents(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_period_runs"](spark, DATA).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for i in [i for i in docs if len(docs[i] or "") < 12_000]:
        assert got[i] == account(i, docs[i])
