"""Spelling variants against a comparison of all pairs of words."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paddock.llm import spelling
from paddock.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """True if one edit apart, by cutting the common start and end."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def account(words):
    by_size, forms, rows = {}, {}, {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w, n in words.items():
        close = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        rows[w] = len(close)
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, rows[w], words[forms[w]] if forms[w] is not None else None))
    return out


def counted(rows, slips):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_variants_of_few_words(spark):
    words = {"": 3, "a": 900, "b": 20, "aa": 100, "ab": 7, "ba": 7, "aaa": 2, "letters": 100, "leters": 9, "lettters": 1, "letterss": 2, "latters": 100, "latter": 500, "latte": 2500, "étage": 10, "etage": 50, "÷tage": 1}
    d = spark.createDataFrame([*words.items(), (None, 4)], "word string, n int").withColumns({"form": F.lit(1), "entry": F.lit("x")})
    rows = [tuple(r) for r in spelling.group_variants(d).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == account(words)
    pairs = [(r.word, r.near) for r in spelling.neighbours(d.where("word IS NOT NULL").select("word", "n")).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if near(a, b)}
    assert spelling.group_variants(d.where("false")).count() == 0


@pytest.mark.parametrize("slips", [False, True])
def test_variants_of_documents_and_awkward_rows(spark, slips):
    edge = [(1, None), (2, ""), (3, "12 !? \n"), (4, "Spelling spelling SPELLING " * 20), (4, "speling " * 5), (5, "x" * 5000 + " end"), (None, "Été naïveté naïvetés×naïveté " * 8), (6, "ÀÉ÷ß " * 3)]
    d = spark.createDataFrame(edge, "doc_id long, text string").withColumns({"word": F.lit(1), "run": F.lit("y"), "n": F.lit(0)})
    real = spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(1), F.lit("y"), F.lit(0)).toDF("doc_id", "text", "word", "run", "n")
    both = d.union(real)
    words = counted([(r.doc_id, r.text) for r in both.collect()], slips)
    rows = [tuple(r) for r in spelling.variants(both, slips).collect()]
    assert len(rows) == len(words) and set(rows) == account(words)
    assert spelling.variants(both.where("false"), slips).count() == 0


def test_the_query_reads_all_documents(spark):
    words = counted([(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()], True)
    assert {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()} == account(words)
