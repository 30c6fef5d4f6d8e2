"""Each operator against a plain account of the same thing, on edge cases and on the smallest documents."""

import hashlib
import os
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import bpe, classifier, components, exact_dedup, license_scan, minhash, packing, quality_rules, secrets, suffix_dedup, url_filter
from paddock.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Null, empty, blank and long texts, equal ones, a repeated row, and a null id.
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "x"), (7, "ab" * 300), (8, "z" * 250), (9, "É été <|endoftext|>\x1f你好 " * 40), (10, "w " * 5000), (11, "same same text here " * 30), (11, "same same text here " * 30), (None, "one two")]


def lower(s):
    return (s or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.fixture(scope="module")
def docs(spark):
    edge = spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"score": F.lit("clash"), "rule": F.lit(1), "key": F.lit(2)})
    real = spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text").withColumns({"score": F.lit("clash"), "rule": F.lit(1), "key": F.lit(2)})
    return edge.union(real)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_exact_duplicates(docs, rows, empty):
    got = Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect()))
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()] += 1
    assert got == want and exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_duplicates_when_chunk_keys_collide(docs):
    """A key that many chunks share must not merge different texts."""
    weak = lambda c: F.struct((F.length(c) % 2).alias("h"))
    plain = {tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs, key=weak).collect()} == plain


def test_quality_counts(docs, rows, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs).collect())
    want = Counter()
    for i, t in rows:
        t = t or ""  # noqa: PLW2901
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        times, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if times[x] > 1:
                covered.update(range(k, k + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert got == want and quality_rules.judge(empty).count() == 0


def test_cascade_order_never_changes_the_verdict(docs):
    counted = quality_rules.counts(docs)
    one = counted.select("doc_id", quality_rules.cascade(quality_rules.RULES).isNull().alias("ok"))
    two = counted.select("doc_id", quality_rules.cascade(quality_rules.RULES[::-1]).isNull().alias("ok"))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect()))


def tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_bpe_equals_the_library(docs, rows, empty):
    tok, sha = tokenizer(), lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = Counter(map(tuple, bpe.encode(docs, tokenizer_path()).collect()))
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert got == want and bpe.encode(empty, tokenizer_path()).count() == 0


def test_bpe_of_many_special_tokens_and_very_long_words(spark):
    tok, sha = tokenizer(), lambda s: hashlib.sha256(s.encode()).hexdigest()
    long = ["<|endoftext|> a " * 5000, "<|startoftext|>" * 5000, "ab" * 50_000, "é你" * 5_000, "Some words, and more. " * 50_000]
    d = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode(d, tokenizer_path()).collect()}
    n_ids = {r.doc_id: r.doc_tokens for r in packing.pack(d, tokenizer_path()).collect()}
    for i, t in enumerate(long):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))) and n_ids[i] == len(ids) + 1


def test_packing_holds_every_id_once(docs, rows, empty):
    pieces = packing.pack(docs, tokenizer_path()).toPandas()
    assert packing.pack(empty, tokenizer_path()).count() == 0
    tok, single = tokenizer(), Counter(i for i, _ in rows)
    for i, t in rows:
        if i is None or single[i] > 1:
            continue
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for p in pieces[pieces.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]]
        n = s.length.sum()
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding < 0.03 * pieces.length.sum() + 2048


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1023, 1024, 1500, 2047, 2048, 2049, 9999])
def test_cut_gives_all_of_a_document(n):
    parts = packing.cut(n)
    assert sum(p for p, _ in parts) == n and all(k == 2048 // p or 2048 // k == p for p, k in parts)


def test_classifier_on_held_out_rows(spark, empty):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = classifier.fit(d, labels)
    got = classifier.score(d, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    assert classifier.score(empty, model).count() == 0
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    nothing = classifier.fit(d, labels.where("false"))
    assert {r.score for r in classifier.score(d, nothing).collect()} == {0.5}
    assert classifier.keep_good(d, model).columns == d.columns


def test_classifier_on_awkward_rows(spark):
    """Null, empty and blank texts get one prior; equal rows equal scores; an id with several texts or labels is learned once and alike."""
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9004, "one"), (None, "two"), (9005, "long " * 50_000)], "doc_id long, text string")
    clash = {n: F.lit("x") for n in ("label", "score", "of", "id", "weight", "held_out", "predicted")}
    both = d.union(odd).union(d.limit(20).withColumn("text", F.concat("text", F.lit(" more")))).withColumns(clash)
    twice = labels.union(labels.limit(10)).withColumns({"text": F.lit("x"), "score": F.lit(1)})
    models = [classifier.fit(both.repartition(n), twice) for n in (1, 5)]
    assert models[0].bias == models[1].bias and np.array_equal(models[0].weight, models[1].weight)
    got = [(r.doc_id, r.held_out, r.score, r.predicted) for r in classifier.score(both, models[0]).collect()]
    assert len(got) == both.count() and all(0 <= s <= 1 and p == (s >= 0.5) for _, _, s, p in got)
    by = defaultdict(set)
    for i, _, s, _ in got:
        by[i].add(s)
    assert by[9001] == by[9002] == by[9003] and len(by[9001]) == len(by[9004]) == len(by[9005]) == 1


def sets(text, n):
    w = re.findall(rb"[^\x20\x09-\x0d]+", lower(text).encode())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n):
    ids = sorted({i for i, _ in rows if i is not None})
    shingles, parent = {i: sets(t, n) for i, t in rows}, {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and shingles[a] and shingles[b]:
                common = len(shingles[a] & shingles[b])
                if 100 * common >= 80 * (len(shingles[a]) + len(shingles[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(shingles[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, rows, empty, n):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()
    crowd = [(5000 + i, " ".join(w if (i * 7 + j) % 23 else f"u{i}" for j, w in enumerate(base * 3))) for i in range(40)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(crowd, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(both, size=n).collect() if r.doc_id is not None}
    assert got == brute_components(rows + crowd, n)
    assert minhash.near_duplicates(empty, size=n).count() == 0


def test_common_counts_in_blocks():
    draw = np.random.default_rng(1)
    left, right = ([np.unique(draw.integers(0, 400, 50)).astype(np.uint64) for _ in range(k)] for k in (7, 9))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert minhash.common_counts(left, right, width=16).tolist() == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, 200: 200}


def test_repeated_strings(docs, rows, empty):
    data = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[p : p + 200] for _, b in data for p in range(len(b) - 199))
    want = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if times[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    assert Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeated_strings_of_hot_anchors(spark, docs):
    """Passages of 60 to 320 bytes between different texts, sorted and counted by windows: the same rows."""
    draw = np.random.default_rng(4)
    word = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    passages = [word(n) for n in (60, 150, 199, 200, 320)]
    rows = [(i, " ".join(word(150) + p + word(80) for p in passages)) for i in range(30)] + [(None, passages[4] * 2)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = Counter(map(tuple, suffix_dedup.remove_repeats(both).collect()))
    assert Counter(map(tuple, suffix_dedup.remove_repeats(both, hot=1).collect())) == plain
    assert all(r[2] >= 200 + 320 for r in plain if r[0] is not None and r[0] < 30 and r[1] == len(rows[0][1]))


def test_deep_shallow_order():
    draw = np.random.default_rng(2)
    strings = np.concatenate([np.repeat(draw.integers(97, 99, (6, 120), np.uint8), 4, 0), draw.integers(97, 100, (40, 120), np.uint8)])
    strings[::3, 90:] = draw.integers(97, 100, strings[::3, 90:].shape)
    group = draw.integers(0, 3, len(strings))
    order, prefix = suffix_dedup.deep_shallow(group, strings)
    keyed = [(int(group[i]), strings[i].tobytes()) for i in order]
    assert keyed == sorted(keyed)
    for (g, a), (h, b), n in zip(keyed, keyed[1:], prefix[1:]):
        assert n == (-1 if g != h else next((k for k in range(120) if a[k] != b[k]), 120))


def test_secrets(spark, empty):
    def text(i):
        value = hashlib.sha1(str(i).encode()).hexdigest()
        return f'some plain words here token = "{value}" and /usr/local/share/doc/files or 1234567890123456 nordlichtunverständlich thesuperlongwordwithoutend more {i}'

    d = spark.createDataFrame([(i, text(i)) for i in range(40)] + [(90, None), (91, "")], "doc_id long, text string")
    found = secrets.scan_secrets(d)
    got = found.where("is_secret").collect()
    assert sorted((r.doc_id, r.candidate) for r in got) == [(i, hashlib.sha1(str(i).encode()).hexdigest()) for i in range(40)]
    clean = secrets.redact(d, found)
    assert clean.columns == d.columns and clean.count() == 42 and clean.where(F.col("text").rlike("[0-9a-f]{40}")).count() == 0
    assert secrets.scan_secrets(empty).count() == 0


def test_every_secret_of_a_word_and_of_rows_without_id(spark):
    import corpus_pipeline

    h = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    plain = 'some plain words here token = "{}" and /usr/local/share/doc/files or 1234567890123456 nordlichtunverständlich thesuperlongwordwithoutend more'
    several = [
        f'{{"id":"{h(1)}","token":"{h(2)}","url":"https://a.org/x"}}', f"https://a.org/some/very/long/path/here?api_key={h(3)}&token={h(4)}",
        f"user1234567890abc:{h(5)}", f"{h(6)}.{h(7)}.{h(8)}", f"没有空白的文字token={h(9)}，password：{h(10)}。", f"MY_SERVICE_SECRET_KEY={h(11)}",
    ]
    rows = [(i, plain.format(h(1000 + i))) for i in range(40)] + [(100 + i, t) for i, t in enumerate(several)] + [(None, f'token="{h(12)}" x'), (None, f'api_key={{"a":"{h(13)}","key":"{h(14)}"}}')]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.scan_secrets(d)
    assert {h(i) for i in range(1, 15)} <= {r.candidate for r in found.where("is_secret").collect()}
    for clean in (secrets.redact(d, found), corpus_pipeline.without_secrets(spark, d, DATA)):
        assert clean.columns == d.columns and clean.count() == len(rows) and clean.where(F.col("text").rlike("[0-9a-f]{40}")).count() == 0


def test_url_aliases_take_blocks_and_allows_stand(spark):
    page = lambda i, url, html="": (i, url, html)
    rows = [
        page(1, "https://a.example.net/es/x"),
        page(2, "https://free.org/one?q=1", '<link href="https://a.example.net/es/x" rel="canonical">'),
        page(3, "http://free.org/two#f", '<meta http-equiv="refresh" content="0; url=https://free.org/one">'),
        page(4, "http://shop.com/", '<link rel=canonical href="http://free.org/two">'),
        page(5, "https://www.example.com/en/7"), page(6, "https://EXAMPLE.com/en/7"), page(7, None, "x"), page(8, "no scheme"), page(9, "https://alone.org"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.example.net", "/es/x", "net/es/", "block"), 2: ("free.org", "/one", None, "block"), 3: ("free.org", "/two", None, "block"), 4: ("shop.com", "/", "com/", "allow"),
        5: ("www.example.com", "/en/7", "www.example.com/en/", "allow"), 6: ("example.com", "/en/7", "example.com/en/", "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("alone.org", "", None, "allow"),
    }


def test_all_links_of_a_page_are_resolved(spark):
    at, link = "https://a.org/d/e/page?x=1#y", lambda href, rel='"canonical"': f"<link rel={rel} href='{href}'>"
    refresh = lambda to: f'<META HTTP-EQUIV="refresh" CONTENT="0; URL={to}">'
    cases = [
        (at, link("p.html"), {"https://a.org/d/e/p.html"}), (at, link("./b"), {"https://a.org/d/e/b"}), (at, link("../a"), {"https://a.org/d/a"}), (at, link("../../../a/.."), {"https://a.org/"}),
        (at, link("?q=2"), {"https://a.org/d/e/page?q=2"}), (at, link("/r"), {"https://a.org/r"}), (at, link("//b.net/es/z"), {"https://b.net/es/z"}), ("https://a.org", link("p"), {"https://a.org/p"}),
        (at, '<base href="https://c.net/es/">' + link("p") + refresh("q?z"), {"https://c.net/es/p", "https://c.net/es/q?z"}), (at, '<base href="/f/">' + link("p"), {"https://a.org/f/p"}),
        (at, link("one") + refresh("two") + link("three") + refresh("https://x.net/es/4"), {"https://a.org/d/e/one", "https://a.org/d/e/two", "https://a.org/d/e/three", "https://x.net/es/4"}),
        (at, link("p", '"alternate canonical"') + link("n", '"canonical-not"'), {"https://a.org/d/e/p"}), (at, link("mailto:x@y"), set()), ("no scheme", link("p"), set()),
    ]
    pages = spark.createDataFrame([(i, url, html) for i, (url, html, _) in enumerate(cases)], "page_id long, url string, html string")
    got = defaultdict(set)
    for r in url_filter.alias_links(pages).collect():
        got[r.url].add(r.target)
    for url in {c[0] for c in cases}:
        assert got[url] == set().union(*[c[2] for c in cases if c[0] == url])
    alias = [(1, "https://free.org/x/y", link("../up", '"shortlink canonical"')), (2, "https://free.org/up", refresh("https://ok.org/") + refresh("//bad.net/es/1")), (3, "https://bad.net/es/1", "")]
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(alias, "page_id long, url string, html string")).collect()} == {1: "block", 2: "block", 3: "block"}


def plain_form(text):
    """The canonical form by the standard library's expressions."""
    form = lower(re.sub(license_scan.COPYRIGHT_LINE, "", text))
    form = re.sub(r"(?:[^\w]|_)+", " ", form).strip()
    for pattern, to in license_scan.EQUIVALENT:
        form = re.sub(pattern, to.replace("$1", r"\1"), form)
    return form.strip()


def test_licenses(spark, empty):
    mit, isc = (license_scan.KNOWN[i][1] for i in (4, 6))
    wrapped = "/* Copyright (c) 2020 Jane Doe\n" + "\n".join(f" * {line}" for line in textwrap.wrap(mit, 60))
    rows = [
        (1, "Copyright 2020 Someone\nreleased UNDER the mit licence"), (2, "words\nLicensed under the Apache License; version 2.0!\nmore"), (3, None), (4, "MIT"), (4, "Licensed under CC BY-NC 4.0."), (5, ""), (6, " \n\t"),
        (7, "some code\n\n" + wrapped + " */\nint main() {}\n" + isc.upper() + " and more. Licensed under Creative Commons BY-NC 4.0"), (8, mit.replace("sublicense", "sub-licence")), (9, "Copyright 2024 A. Released under the MIT License."),
        (10, "sand orange licencedx and/or"), (11, "word " * 20_000 + "Released under\nthe MIT licence. " + "word " * 20_000), (None, "Released under the MIT License. Released under the MIT License."), (12, "Released under the MIT License"), (12, "Released under the MIT License"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit(1), "digest": F.lit(2), "w": F.lit(3), "at": F.lit(4)})
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan_licenses(d).collect()}
    known: dict = {}
    for name, body in license_scan.KNOWN:
        known.setdefault(plain_form(body), name)
    want = {}
    for i, t in set(rows):
        whole, places, names = want.get(i, (None, 0, set()))
        form = plain_form(t or "")
        w = form.split()
        for at in range(len(w)):
            here = {n for f, n in known.items() if w[at : at + f.count(" ") + 1] == f.split()}
            places, names = places + bool(here), names | here
        want[i] = (known.get(form, whole), places, names)
    assert got == {i: (whole, places, ",".join(sorted(names))) for i, (whole, places, names) in want.items()}
    assert got[7] == (None, 3, "CC-BY-NC-4.0,ISC,MIT") and got[8][0] == got[9][0] == "MIT" and got[10] == (None, 0, "") and got[None][1] == 2
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_files(spark):
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence files here")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    rows = [(f, open(f"{folder}/{f}").read()) for f in names if os.path.exists(f"{folder}/{f}")]
    longer = [(f"in {f}", f"before\n{t}\nafter") for f, t in rows]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows + longer, "doc_id string, text string")).collect()}
    assert all(got[f].whole_license == names[f] and got[f"in {f}"].whole_license is None and names[f] in got[f"in {f}"].licenses for f, _ in rows)


def test_candidates_and_features_equal_a_plain_account(spark, docs):
    """Candidates of every word, and the features that don't depend on the dictionary, by loops over the texts."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(7000, 'a "k1":"abcdefghijklmnop12","k2":"QRSTuvwx/0123456789" end'), (7001, "x " * 50_000 + "token=ABCDEFGHIJ0123456789"), (7001, "sha1 " + "0a" * 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"candidate": F.lit(1), "at": F.lit(2), "word": F.lit("x")})
    found = secrets.featured(secrets.candidates(d), [])
    got = Counter((r.doc_id, r["at"], r.candidate, r.length, round(r.changes, 9), round(r.digits, 9), round(r.upper, 9), r.letters_only, r.hex_only, round(r.distinct, 9), r.announced) for r in found.collect())
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        for at, word in enumerate(w):
            runs = re.findall("[A-Za-z0-9+/_-]{16,}", word)
            leads = re.split("[A-Za-z0-9+/_-]{16,}", word)
            for k, c in enumerate(runs):
                before2, before = ((w[at - 2] if at > 1 else ""), (w[at - 1] if at else "")) if k == 0 else ("", runs[k - 1])
                beside = " ".join([before2, before, leads[k]]).lower()
                changes = (len(re.findall("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", c)) - 1) / len(c)
                share = lambda p, c=c: len(re.findall(p, c)) / len(c)
                want[i, at, c, float(len(c)), round(changes, 9), round(share("[0-9]"), 9), round(share("[A-Z]"), 9), float(bool(re.fullmatch("[A-Za-z]+", c))), float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", c))), round(len(set(c)) / len(c), 9), float(bool(re.search(secrets.ANNOUNCES, beside)))] += 1
    assert got == want and len(want) > 3


def test_forest_on_held_out_findings(spark, docs):
    r = secrets.held_out_report(secrets.candidates(docs)).first()
    assert r.tp + r.fn > 20 and r.fp + r.tn > 20 and r.precision > 0.95 and r.recall > 0.95


def test_repeated_ids_lose_no_link(spark):
    """An id with several texts is one document that reaches what any of them reaches."""
    long = lambda n, x="": " ".join(f"w{n}x{i}" for i in range(40)) + x
    rows = [(5, long(1)), (3, long(1)), (5, long(2)), (7, long(2, " more")), (9, long(3)), (9, ""), (11, long(3, " z")), (None, long(4)), (12, long(4, " y")), (None, long(6)), (13, "one"), (13, "one")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "component": F.lit(2), "n": F.lit(3), "print": F.lit(4)})
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect())
    assert got == Counter([(5, 3, False), (3, 3, True), (5, 3, False), (7, 3, False), (9, 9, True), (9, 9, True), (11, 9, False), (None, 12, False), (12, 12, True), (None, None, True), (13, 13, True), (13, 13, True)])


def test_redirects_and_edge_cases_of_the_url_filter(spark):
    """Chains of redirects given as a table against a plain walk over links; null, empty, repeated and clashing rows."""
    urls = [f"https://h{i}.org/p{i % 3}" for i in range(40)] + ["https://bad.net/es/1", "https://x.com/ok", "https://bad.net/fr/2"]
    draw = np.random.default_rng(3)
    links = [(urls[a], urls[b]) for a, b in draw.integers(0, len(urls), (34, 2))] + [(None, urls[0]), (urls[1], None), (urls[2], "no scheme")]
    pages = [(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], ""), (90, None, None), (91, "", "")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"node": F.lit(1), "own": F.lit(2), "target": F.lit(3), "component": F.lit(4)})
    r = spark.createDataFrame(links, "url string, target string")
    near = defaultdict(set)
    for a, b in links:
        if a and b and "://" in b:
            near[a].add(b), near[b].add(a)
    got = Counter((x.page_id, x.verdict) for x in url_filter.judge_urls(d, redirects=r).collect())
    want = Counter()
    for i, u, _ in pages:
        seen, todo = set(), [u] if u else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        want[i, "allow" if u and ".com/" in u else "block" if any("bad.net" in x for x in seen) else "allow"] += 1
    assert got == want and 5 < sum(n for (_, v), n in want.items() if v == "block") < 43
    none = d.where("false")
    assert url_filter.judge_urls(none, redirects=r).count() == 0


def test_pipeline_keeps_only_what_each_stage_keeps(spark):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).persist()
        assert docs.columns == before.columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    texts = [lower(t) for t in kept[1].values()]
    assert len(set(texts)) == len(texts) == len({lower(t) for t in kept[0].values()})
    parts = brute_components(list(kept[1].items()), 5)
    assert set(kept[2]) == {i for i, (_, c) in parts.items() if i == c}
    assert set(kept[3]) == set(kept[2]) and not any(re.search("[0-9a-f]{40}", t) for t in kept[3].values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == set(kept[3])


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, repeated ids and rows, and clashing columns in every stage; empty tables go through all of them."""
    import corpus_pipeline

    base = " ".join(f"word{i} and" for i in range(60))
    rows = [(5, "Dup text"), (9, "dup TEXT"), (5, "other text of the same id"), (9, "dup TEXT"), (None, "lonely text without an id"), (None, None), (20, ""), (21, base), (22, base + " end"), (21, "a second text of id 21"), (None, f'token = "{hashlib.sha1(b"x").hexdigest()}" here'), (23, f'secret: "{hashlib.sha1(b"y").hexdigest()}"')]
    names = ("__id", "__key", "__own", "print", "key", "kept", "score", "node")
    d = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(n) for n in names if not n.startswith("__")})
    one = Counter((r.doc_id, r.text) for r in corpus_pipeline.without_copies(spark, d, DATA).collect())
    assert one == Counter([(9, "dup TEXT"), *((i, t) for i, t in rows if lower(t) != "dup text" and (i, t) != (None, None))]) and one[5, "Dup text"] == 0
    two = Counter((r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, d, DATA).collect())
    assert two[22, base + " end"] == 0 and two[21, base] == 1 and two[21, "a second text of id 21"] == 1 and two[None, None] == 1
    three = corpus_pipeline.without_secrets(spark, d, DATA)
    assert three.columns == d.columns and three.count() == len(rows) and three.where(F.col("text").rlike("[0-9a-f]{40}")).count() == 0
    kept = corpus_pipeline.good_quality(spark, d, DATA)
    assert kept.columns == d.columns
    packed = corpus_pipeline.packed(spark, d, DATA)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    none = d.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_secrets_of_small_tables_are_found(spark):
    """Each of 24 tables of one row finds its secret, whatever the words beside it."""
    from hashlib import sha1

    for i in range(0, 24, 3):
        secret = sha1(str(i).encode()).hexdigest()
        d = spark.createDataFrame([(1, f"item {i} password: {secret} tail{i} here")], "doc_id long, text string")
        found = secrets.scan_secrets(d).collect()
        assert [r.candidate for r in found if r.is_secret] == [secret], (i, found)


def test_labelled_findings_of_one_kind_are_an_error(spark):
    d = spark.createDataFrame([(1, "password: " + "0a1b" * 10)], "doc_id long, text string")
    one = secrets.featured(secrets.candidates(d), []).withColumn("label", F.lit(1.0))
    for labelled in (one, one.where("false")):
        with pytest.raises(ValueError, match="both labels"):
            secrets.scan_secrets(d, labelled=labelled)


def test_a_secret_inside_a_longer_string_stays(spark):
    secret = "a1b2c3d4e5f6a7b8c9d0"
    d = spark.createDataFrame([(1, f"token={secret} see /data/{secret}/x and {secret}{secret} '{secret}'"), (2, secret), (None, secret)], "doc_id long, text string")
    findings = spark.createDataFrame([(1, secret, True), (2, secret, False), (None, secret, True)], "doc_id long, candidate string, is_secret boolean")
    got = {r.doc_id: r.text for r in secrets.redact(d, findings).collect()}
    assert got == {1: f"token=<secret> see /data/{secret}/x and {secret}{secret} '<secret>'", 2: secret, None: "<secret>"}
