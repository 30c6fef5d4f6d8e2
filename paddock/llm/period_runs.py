"""Runs of periodic words, by a suffix automaton with link-cut access.

Words are appended one by one to a suffix automaton. In the tree of its suffix links, the
path from the newest state to the root holds all ends of what has been read; it falls into
segments whose strings last ended at one and the same place. Each append walks up that path
and gives it the new end as colour, segment by segment. A segment that last ended d words
ago and whose longest string has at least d words shows a square of period d; one of enough
words shows a run, which is then extended both ways in the text. Paths are splay trees, so
that an append takes amortised logarithmic time, however deep the tree is.

A run's word quadruples come again one period later, so that only stretches of words whose
quadruples soon come again, for the whole length of the stretch, can hold one. Texts are
cut to these stretches first, by sorting; nearly all plain prose ends there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import slices, texts

#: Words that a task remembers; more are held only while one slice of texts needs them.
KEPT_WORDS = 400_000
#: Words of the strings by which stretches are found, at most.
GRAM = 4
NEVER = np.iinfo(np.int64).max
Rewrite = Callable[[object, list[bytes]], list[bytes]]


class LastEnds:
    """A suffix automaton whose link tree is kept as preferred paths, each coloured with the place where its strings last ended."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        # Splay trees of the paths: children towards the root and away from it, parent in the tree or, of a top, the path's parent node.
        self.low, self.high, self.up, self.colour = [-1], [-1], [-1], [-1]
        self.last = 0
        self.size = 0

    def _add(self, after: dict[int, int], length: int) -> int:
        self.next.append(after), self.length.append(length), self.link.append(-1)
        self.low.append(-1), self.high.append(-1), self.up.append(-1), self.colour.append(-1)
        return len(self.length) - 1

    def append(self, word: int) -> list[tuple[int, int]]:
        """Adds a word; gives (longest length, place of the end before) for each segment of the new state's path, places from 0."""
        after, length, link = self.next, self.length, self.link
        here = self.size
        self.size += 1
        new = self._add({}, here + 1)
        p = self.last
        self.last = new
        while p >= 0 and word not in after[p]:
            after[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = after[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = self._add(after[q].copy(), length[p] + 1)
                link[clone] = link[q]
                self._splay(q)
                self._above(clone, q)
                link[q] = link[new] = clone
                while p >= 0 and after[p].get(word) == q:
                    after[p][word] = clone
                    p = link[p]
        self.up[new] = link[new]
        return self._access(new, here)

    def _above(self, clone: int, q: int) -> None:
        """Puts ``clone`` just above ``q``, the top of its splay tree, in the path: what ended with q ended with it, so it gets q's colour."""
        below = self.low[q]
        self.low[clone], self.low[q], self.up[clone] = below, clone, q
        if below >= 0:
            self.up[below] = clone

    def _access(self, new: int, place: int) -> list[tuple[int, int]]:
        high, up, colour, length = self.high, self.up, self.colour, self.length
        segments, x = [], new
        y = up[x]
        while y >= 0:
            self._splay(y)
            if y:  # the root's string is empty
                segments.append((length[y], colour[y]))
            cut = high[y]
            if cut >= 0:  # from here down this is a path of its own, coloured as before
                colour[cut] = colour[y]
            high[y] = x
            x = y
            y = up[x]
        colour[x] = place
        return segments

    def _splay(self, x: int) -> None:
        """Makes ``x`` the top of its path's splay tree."""
        low, high, up = self.low, self.high, self.up
        p = up[x]
        if p < 0 or low[p] != x and high[p] != x:
            return
        top = p
        while (g := up[top]) >= 0 and (low[g] == top or high[g] == top):
            top = g
        self.colour[x] = self.colour[top]
        while (p := up[x]) >= 0 and (low[p] == x or high[p] == x):
            g = up[p]
            if g >= 0 and (low[g] == p or high[g] == p):
                self._rotate(p if (low[g] == p) == (low[p] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        low, high, up = self.low, self.high, self.up
        p = up[x]
        g = up[p]
        if g >= 0:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x
        if low[p] == x:
            b = low[p] = high[x]
            high[x] = p
        else:
            b = high[p] = low[x]
            low[x] = p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g


def same_from(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from places ``a`` < ``b`` on, both moving by ``step`` (1 or -1)."""
    most, n, size = (len(words) - b if step > 0 else a + 1), 0, 32
    while n < most:
        size = min(2 * size, most - n)
        if step > 0:
            unlike = words[a + n : a + n + size] != words[b + n : b + n + size]
        else:
            unlike = (words[a - n - size + 1 : a - n + 1] != words[b - n - size + 1 : b - n + 1])[::-1]
        at = int(unlike.argmax())
        if unlike[at]:
            return n + at
        n += size
    return n


def runs_of(words: np.ndarray, windows: list[tuple[int, int]], least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that lie in the windows (from, to), by start and period."""
    found: dict[tuple[int, int], int] = {}
    for first, stop in windows:
        ends, until = LastEnds(), {}
        for i, word in enumerate(words[first:stop].tolist()):
            for length, before in ends.append(word):
                d = i - before
                if length >= (power - 1) * d and length + d >= least and until.get(d, -1) < i:
                    at = first + i
                    end = at + 1 + same_from(words, at + 1 - d, at + 1, 1)
                    start = at - d - same_from(words, at - d, at, -1) + 1
                    until[d] = end - 1 - first
                    found[start, end] = min(d, found.get((start, end), d))
    return sorted((start, end - start, d) for (start, end), d in found.items())


def gram_size(least: int, power: int) -> int:
    """Words of a string that every run holds at least twice, one period apart."""
    return max(1, min(GRAM, *(max(least, power * q) - q for q in range(1, least + 1))))


def stretches(words: np.ndarray, starts: np.ndarray, least: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (from, to) outside of which no run lies. ``words``: several texts in a row, the last place is past all of them.

    A run of period q has at least (power - 1) * q - k + 1 places in a row at which the same
    k words come again within q. So of a stretch of g places, those go whose k words come
    again only after (g + k - 1) / (power - 1), which may split it, until none goes.
    """
    k, n = gram_size(least, power), len(words)
    key = words.astype(np.uint64)
    for j in range(1, k):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        key[: max(0, n - j)] += words[j:].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ahead = np.full(n, NEVER)
    same = key[order[1:]] == key[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    text = np.searchsorted(starts, np.arange(n), "right") - 1
    end = starts[1:][text]
    places = np.flatnonzero((ahead != NEVER) & (np.arange(n) + k + np.minimum(ahead, n) <= end))
    while True:
        # A stretch is a run of neighbouring places of one text.
        breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(text[places]) != 0)) + 1 if len(places) else np.zeros(0, np.int64)
        first = np.concatenate([[0], breaks]) if len(places) else breaks
        size = np.diff(np.concatenate([first, [len(places)]])) if len(places) else breaks
        reach = (size + k - 1) // (power - 1)
        good = ahead[places] <= np.repeat(reach, size)
        if good.all():
            break
        places = places[good]
    begin = places[first] if len(places) else places
    return begin, np.minimum(begin + size + reach + k - 1, end[begin]) if len(places) else begin


class Words:
    """Texts to arrays of numbers, equal for equal words."""

    def __init__(self):
        self.place: dict[bytes, int] = {}

    def numbers(self, split: list[list[bytes]]) -> np.ndarray:
        if len(self.place) > KEPT_WORDS:
            self.place.clear()
        new = set().union(*split) - self.place.keys()
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        at = self.place.__getitem__
        return np.concatenate([np.fromiter(map(at, ws), np.int64, len(ws)) for ws in split])


def runs_of_texts(words: Words, split: list[list[bytes]], least: int, power: int) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each text that has some, by the text's number."""
    number = words.numbers(split)
    starts = np.cumsum([0, *map(len, split)])
    if not len(number):
        return {}
    windows: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(*(x.tolist() for x in stretches(number, starts, least, power))):
        windows.setdefault(int(np.searchsorted(starts, a, "right")) - 1, []).append((a, b))
    out = {}
    for t, own in windows.items():
        first = int(starts[t])
        found = runs_of(number[first : starts[t + 1]], [(a - first, b - first) for a, b in own], least, power)
        if found:
            out[t] = found
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by a blank, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])


def find_runs(docs: DataFrame, least: int = 6, power: int = 4, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed string), one row per row of ``docs``.

    Words are the runs without ASCII white space of the whole text, numbered from 0. A run is
    a longest stretch of words with a smallest period q, of at least max(least, power * q)
    words; runs come by start, then period. ``collapsed`` is the words, joined by one blank,
    but those that some run holds after its first q words. ``rewrite`` may change a text's
    words first, given the doc_id and them. Null, empty and blank texts have no runs and
    collapse to ''. Repeated rows and ids are judged each; other columns don't matter; an
    empty table gives an empty result. A task holds a few MB of texts at a time, and one text
    at least; no text is split.
    """
    if power < 2:
        raise ValueError("power is at least 2")
    doc = texts(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in slices(batch):
                split = [t.encode().split() for t in part["text"].to_pylist()]
                if rewrite:
                    split = [rewrite(i, ws) for i, ws in zip(part["doc_id"].to_pylist(), split)]
                found = runs_of_texts(words, split, least, power)
                runs = [[dict(zip(("start", "length", "period"), r)) for r in found.get(t, ())] for t in range(len(split))]
                left = [collapsed(ws, found.get(t, [])).decode() for t, ws in enumerate(split)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(runs, kind), pa.array(left, pa.string())], names=["doc_id", "runs", "collapsed"])

    return doc.mapInArrow(run, f"doc_id {doc.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """Of sorted runs the one of the greatest length by period, the first of equals; null without runs."""
    larger = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.get(runs, F.lit(-1)), lambda best, r: F.when(larger(best, r), r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``find_runs`` rows: the strongest run, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    found = found.withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", line), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def repeat_tails(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Makes the tail of about every tenth text periodic: with h the CRC-32 of the decimal id and g = h // 10, the words from
    g % n on repeat the first 1 + (rest // (3 + g % 8)) of them, where h % 10 is 0. A text without an id stays."""
    from zlib import crc32

    if doc_id is None or not words:
        return words
    g, rest = divmod(crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + p]
    return words[:a] + (once * ((n - a) // p + 1))[: n - a]
