"""The classifier's features, its descent and its scores against a plain account."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from paddock.llm import classifier as c

LIMIT = 1 << 64
ROWS = [("good words make good text", 1), ("spam spam spam spam", 0), ("naïve café text, good", 1), ("x", 0), ("", 1), ("buy now now buy \U0001f600", 0)]


def bucket(value):
    value = (value ^ (value >> 29)) * int(c.MIX) % LIMIT
    return (value ^ (value >> 32)) % c.BUCKETS


def plain_features(word):
    """The word's own bucket, then those of its character n-grams, borders marked."""
    points = [ord(x) for x in f"<{word}>"]
    out = [bucket((sum(p * pow(int(c.PRIME), i + 1, LIMIT) for i, p in enumerate(points)) + 1) % LIMIT)]
    for n in c.GRAMS:
        for at in range(len(points) - n + 1):
            value = 0
            for p in points[at : at + n]:
                value = (value * int(c.PRIME) + p) % LIMIT
            out.append(bucket((value + (n << 40)) % LIMIT))
    return out


def document(text):
    """Buckets of all words, and the repeat bucket for each word that equals the one before."""
    words = re.findall(r"[^ \t-\r]+", text)
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [i for w in words for i in plain_features(w)] + [c.REPEAT] * (c.REPEAT_WEIGHT * again)


def plain_train(rows, seed=7):
    """Softmax over the average of a document's vectors, one step for each document in turn."""
    draw = np.random.default_rng(seed)
    docs = [(document(t), y) for t, y in rows if document(t)]
    start = draw.uniform(-1 / c.DIM, 1 / c.DIM, (c.BUCKETS, c.DIM)).astype(np.float32)
    vectors = {i: [float(x) for x in start[i]] for ids, _ in docs for i in ids}
    ones = sum(y for _, y in rows)
    layer, bias = [[0.0, 0.0] for _ in range(c.DIM)], [math.log((len(rows) - ones + 1) / (len(rows) + 2)), math.log((ones + 1) / (len(rows) + 2))]
    step, steps = 0, c.EPOCHS * len(docs)
    for _ in range(c.EPOCHS):
        for at in draw.permutation(len(docs)):
            ids, y = docs[at]
            rate = c.RATE * (1 - step / steps)
            step += 1
            hidden = [sum(vectors[i][k] for i in ids) / len(ids) for k in range(c.DIM)]
            logits = [sum(h * w[j] for h, w in zip(hidden, layer)) + bias[j] for j in (0, 1)]
            total = sum(math.exp(x) for x in logits)
            gap = [math.exp(x) / total - (j == y) for j, x in enumerate(logits)]
            back = [w[0] * gap[0] + w[1] * gap[1] for w in layer]
            for k in range(c.DIM):
                layer[k] = [layer[k][j] - rate * hidden[k] * gap[j] for j in (0, 1)]
            bias = [b - 0.1 * rate * g for b, g in zip(bias, gap)]
            used = sorted(set(ids))
            for i in used:
                share = ids.count(i) / len(ids)
                vectors[i] = [v - rate * len(used) ** 0.5 * share * b for v, b in zip(vectors[i], back)]
    return {i: sum(v[k] * (layer[k][1] - layer[k][0]) for k in range(c.DIM)) for i, v in vectors.items()}, bias[1] - bias[0]


def test_features_are_words_and_their_grams():
    words = ["good", "a", "naïve", "\U0001f600x", "<>", "word" * 50]
    ids, first = c.features(words)
    found = [sorted(x.tolist()) for x in np.split(ids, first[1:])]
    assert found == [sorted(plain_features(w)) for w in words]


def test_descent_equals_plain_steps():
    model = c.train(ROWS)
    weights, bias = plain_train(ROWS)
    assert abs(model.bias - bias) < 1e-4
    assert max(abs(float(model.weight[i]) - w) for i, w in weights.items()) < 1e-3


def test_scores_equal_a_plain_sum(spark):
    model = c.train(ROWS)
    texts = [t for t, _ in ROWS] + [None, "new words and and so on", " \n"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("x"))
    for r in c.score(d, model).collect():
        ids = document(texts[r.doc_id] or "")
        odds = model.bias + (sum(float(model.weight[i]) for i in ids) / len(ids) if ids else 0.0)
        assert abs(r.score - 1 / (1 + math.exp(-odds))) < 1e-6 and r.predicted == (r.score >= 0.5)


def test_one_class_and_no_rows():
    assert c.Scorer(c.train([])).scores(["x", ""]) == [0.5, 0.5]
    assert all(s > 0.5 for s in c.Scorer(c.train([("a b", 1)] * 3)).scores(["", "zzz"]))
