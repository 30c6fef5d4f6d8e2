"""Removal of long repeated byte strings, by sorting suffixes.

A window of 200 bytes has an anchor, the least of its 24-byte strings by hash; equal windows
have equal anchors at the same place. Neighbouring windows with one anchor are one segment.
Segments whose anchors occur once hold no repeat. Segments that are equal as a whole are
merged by a 128-bit fingerprint: all their windows repeat. The distinct segments of an
anchor that is left are sorted: what follows the anchor as suffixes, what precedes it,
reversed, likewise. The sort is deep-shallow: multikey quicksort by words of 8 bytes to a
shallow depth, then strings that still agree, which share long prefixes, are put in order by a
blind trie. From
both orders and their common prefix lengths follows, for every place of a window about its
anchor, which segments have the same window there. An anchor that so many distinct segments
share that one task couldn't hold them has its windows counted instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import pack_texts, printed, slices, stored

WINDOW, SEED = 200, 24
#: Windows are looked at in stretches of so many bytes; a stretch's positions fit the low bits of a number.
STRETCH, BITS = 1 << 20, 22
#: Bytes up to which suffixes are sorted word by word.
SHALLOW = 64
PRIME, PRIME2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, for hashes of any substring from prefix sums."""

    def __init__(self, prime: int):
        with np.errstate(over="ignore"):
            self.up = np.full(STRETCH + 2 * WINDOW, prime, np.uint64).cumprod()
            self.down = np.full(STRETCH + 2 * WINDOW, pow(prime, -1, 1 << 64), np.uint64).cumprod()

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (sums[end] - sums[start]) * self.down[start]
        value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return value ^ (value >> np.uint64(31))


def segments(data: bytes, first: Powers, second: Powers | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, shape, anchor hash, fingerprint) of one text's segments, a stretch at a time; without ``second`` the anchors only.

    ``shape`` is 256 times the number of windows and the number of bytes that precede the anchor.
    """
    for base in range(0, max(len(data) - WINDOW + 1, 0), STRETCH):
        part = np.frombuffer(data, np.uint8)[base : base + STRETCH + WINDOW - 1]
        sums = first.sums(part)
        at = np.arange(len(part) - SEED + 1)
        seed = first.hashes(sums, at, at + SEED)
        least = (seed >> np.uint64(BITS) << np.uint64(BITS)) | at.astype(np.uint64)
        reach, width = 1, WINDOW - SEED + 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        anchor = (least & np.uint64((1 << BITS) - 1)).astype(np.int64)
        start = np.flatnonzero(np.diff(anchor, prepend=-1))
        found = seed[anchor[start]].view(np.int64)
        if second is None:
            yield (found,)
            continue
        windows = np.diff(start, append=len(anchor))
        shape = windows * 256 + anchor[start] - start
        print_ = second.hashes(second.sums(part), start, start + windows - 1 + WINDOW) ^ shape.astype(np.uint64)
        yield start + base, shape, found, print_.view(np.int64)


def anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, n): how many segments of a slice of texts have it."""
    first = Powers(PRIME)
    for batch in batches:
        for part in slices(batch):
            found = [a for text in part["text"].to_pylist() for (a,) in segments(text.encode(), first, None)]
            if found:
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])


def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, second = Powers(PRIME), Powers(PRIME2)
    for batch in batches:
        for part in slices(batch):
            rows: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i, text in enumerate(part["text"].to_pylist()):
                for found in segments(text.encode(), first, second):
                    for column, values in zip(rows, (np.full(len(found[0]), i), *found)):
                        column.append(values)
            if rows[0]:
                owner, *columns = (np.concatenate(c) for c in rows)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(take), part["print"].take(take), *map(pa.array, columns)], names=["doc_id", "print", "start", "shape", "anchor", "segment"])


def wanted_segments(part: pa.RecordBatch, hot: bool) -> Iterator[tuple[int, dict, bytes]]:
    """(row, segment, its bytes) for each wanted segment that is hot, or isn't, of packed texts."""
    press = zstandard.ZstdDecompressor()
    for i, wanted in enumerate(part["wanted"].to_pylist()):
        if any(w["hot"] == hot for w in wanted or ()):
            data = press.decompress(part["packed"][i].as_py())
            for w in wanted:
                if w["hot"] == hot:
                    yield i, w, data[w["start"] : w["start"] + w["shape"] // 256 - 1 + WINDOW]


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (anchor, lead, windows, body, start, single, doc_id, print) for each wanted segment that isn't hot."""
    for batch in batches:
        for part in slices(batch, "packed"):
            rows = [(w["anchor"], w["shape"] % 256, w["shape"] // 256, body, w["start"], w["single"], i) for i, w, body in wanted_segments(part, False)]
            if rows:
                *columns, owner = zip(*rows)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), part["doc_id"].take(take), part["print"].take(take)], names=["anchor", "lead", "windows", "body", "start", "single", "doc_id", "print"])


def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (anchor, lead, one, two, start, single, doc_id, print) for each window of the hot segments; one and two are its hashes."""
    first, second = Powers(PRIME), Powers(PRIME2)
    for batch in batches:
        for part in slices(batch, "packed"):
            rows: list[list[np.ndarray]] = [[] for _ in range(7)]
            for i, w, body in wanted_segments(part, True):
                data, at = np.frombuffer(body, np.uint8), np.arange(w["shape"] // 256)
                hashes = [p.hashes(p.sums(data), at, at + WINDOW).view(np.int64) for p in (first, second)]
                same = lambda v: np.full(len(at), v)  # noqa: E731, B023
                for column, values in zip(rows, (same(i), same(w["anchor"]), w["shape"] % 256 - at, *hashes, w["start"] + at, same(w["single"]))):
                    column.append(values)
            if rows[0]:
                owner, *columns = (np.concatenate(c) for c in rows)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), part["doc_id"].take(take), part["print"].take(take)], names=["anchor", "lead", "one", "two", "start", "single", "doc_id", "print"])


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The strings' order, by a trie whose nodes hold only the depth at which their strings part."""
    root: list = [len(strings[0]), {}, [0]]  # depth, children by byte, strings that end here equal
    for i in range(1, len(strings)):
        new = strings[i]
        node = root
        while node[1] and node[0] < len(new) and new[node[0]] in node[1]:
            node = node[1][new[node[0]]]
        while node[1]:
            node = next(iter(node[1].values()))
        other = strings[node[2][0]]
        depth = differ(new, other)
        node, above = root, None
        while node[1] and node[0] < depth:
            above, node = node, node[1][new[node[0]]]
        if depth == len(new) and not node[1]:
            node[2].append(i)
        elif node[1] and node[0] == depth:
            node[1][new[depth]] = [len(new), {}, [i]]
        else:
            fork = [depth, {other[depth]: node, new[depth]: [len(new), {}, [i]]}, None]
            if above is None:
                root = fork
            else:
                above[1][other[above[0]]] = fork
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[1]:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            order += node[2]
    return order


def differ(a: bytes, b: bytes) -> int:
    """Where two strings of one length part; their length if they are equal."""
    if a == b:
        return len(a)
    lo, hi = 0, len(a)
    while hi - lo > 1:  # a[:lo] agrees, a[:hi] doesn't
        middle = (lo + hi) // 2
        lo, hi = (middle, hi) if a[lo:middle] == b[lo:middle] else (lo, middle)
    return lo


def multikey_quicksort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` within their groups, and for each place the number of its run; rows of a run agree in all words.

    All runs are split at once, each by its own pivot into less, equal and greater; the
    equal part goes on with the next word, the others with the same one.
    """
    order = np.argsort(group, kind="stable")
    run = np.cumsum(np.diff(group[order], prepend=group[order[:1]]) != 0)
    depth = np.zeros(len(order), np.int64)
    while True:
        at = np.flatnonzero((np.bincount(run)[run] > 1) & (depth < words.shape[1]))
        if not len(at):
            return order, run
        own = run[at]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(begin, append=len(at))
        word = words[order[at], depth[at]]
        middle = np.sort([word[begin], word[begin + size // 2], word[begin + size - 1]], axis=0)[1]
        pivot = np.repeat(middle, size)
        part = 3 * own + 1 + (word > pivot) - (word < pivot)
        again = np.argsort(part, kind="stable")
        part = part[again]
        order[at] = order[at[again]]
        depth[at] += part % 3 == 1
        borders = np.diff(run, prepend=-1) != 0
        borders[at[1:]] |= part[1:] != part[:-1]
        run = np.cumsum(borders) - 1


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, group by group, and each one's common prefix with the one before (-1 across groups)."""
    n, width = strings.shape
    words = np.ascontiguousarray(np.pad(strings, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order, run = multikey_quicksort(group, words[:, : SHALLOW // 8])
    begin = np.flatnonzero(np.diff(run, prepend=-1))
    for lo, hi in zip(begin.tolist(), np.append(begin[1:], n).tolist()):
        if hi - lo > 1:
            rows = order[lo:hi]
            order[lo:hi] = rows[blind_trie_order([strings[r].tobytes() for r in rows])]
    same = np.zeros((n, width), bool)
    same[1:] = strings[order[1:]] == strings[order[:-1]]
    prefix = np.where(same.all(1), width, (~same).argmax(1)) if width else np.zeros(n, np.int64)
    prefix[np.flatnonzero(np.diff(group[order], prepend=group[order[:1]] - 1))] = -1
    return order, prefix


def repeated_windows(group: np.ndarray, lead: np.ndarray, windows: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """(segments, widest lead + 1): whether the window that starts d bytes before the anchor has an equal one in another segment of the group."""
    n, most = len(bodies), int(lead.max())
    after, before = np.zeros((n, WINDOW), np.uint8), np.zeros((n, most), np.uint8)
    for i, body in enumerate(bodies):
        data, at = np.frombuffer(body, np.uint8), int(lead[i])
        after[i, : len(data) - at] = data[at : at + WINDOW]
        before[i, :at] = data[:at][::-1]
    ranks = []
    for side in (after, before):
        order, prefix = deep_shallow(group, side)
        ranks.append((order, prefix))
    out = np.zeros((n, most + 1), bool)
    least = lead - windows + 1
    for d in range(most + 1):
        has = (d <= lead) & (d >= least)
        if has.sum() < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, prefix), depth in zip(ranks, (WINDOW - d, d)):
            kind = np.empty(n, np.int64)
            kind[order] = np.cumsum(prefix < depth)
            key = key * (n + 1) + kind
        rows = np.flatnonzero(has)
        rows = rows[np.argsort(key[rows], kind="stable")]
        equal = key[rows[1:]] == key[rows[:-1]]
        out[rows[1:][equal], d] = True
        out[rows[:-1][equal], d] = True
    return out


#: Segments that are sorted together, about; a group is never divided, so it has this many distinct segments at most.
TOGETHER = 20_000
#: Anchors with more distinct segments than this aren't sorted: their windows are counted one by one.
HOT = 5_000


def sort_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows in single segments; rows come ordered by anchor."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < TOGETHER:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchors = table["anchor"].to_numpy()
        cut = int(np.searchsorted(anchors, anchors[-1], "left"))  # the last group may go on
        if cut:
            yield from spans_of(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield from spans_of(pa.Table.from_batches(held).combine_chunks())


def spans_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    lead, windows = table["lead"].to_numpy(), table["windows"].to_numpy()
    _, group = np.unique(table["anchor"].to_numpy(), return_inverse=True)
    repeated = repeated_windows(group, lead, windows, table["body"].to_pylist())
    single = table["single"].to_numpy(zero_copy_only=False)
    edge = np.diff(np.pad(repeated & single[:, None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    anchor_at = table["start"].to_numpy() + lead
    take = pa.array(row)
    begin, end = anchor_at[row] - (high - 1), anchor_at[row] - low + WINDOW
    columns = [table[c].combine_chunks().take(take) for c in ("doc_id", "print")]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(begin), pa.array(end)], names=["doc_id", "print", "begin", "end"])


def remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in slices(batch, "packed"):
            rows = []
            for packed, begins, ends in zip(part["packed"].to_pylist(), part["begins"].to_pylist(), part["ends"].to_pylist()):
                data, kept, at, removed, spans = press.decompress(packed), [], 0, 0, 0
                if begins:
                    low, high = np.array(begins), np.array(ends)
                    by = np.argsort(low, kind="stable")
                    low, reach = low[by], np.maximum.accumulate(high[by])
                    first = np.concatenate([[True], low[1:] > reach[:-1]])
                    last = np.append(np.flatnonzero(first)[1:] - 1, len(low) - 1)
                    for b, e in zip(low[first].tolist(), reach[last].tolist()):
                        kept.append(data[at:b])
                        at, removed, spans = e, removed + e - b, spans + 1
                kept.append(data[at:])
                rows.append((len(data), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            n, removed, spans, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``.

    A byte goes if a 200-byte string that covers it also starts anywhere else, in the same
    text or another; texts are judged as they came. Null and short texts lose nothing.
    Rows that repeat an id and a text are copies of each other like any two rows. An empty
    table gives an empty result.
    """
    doc = printed(docs, id_col, text_col)
    kind = doc.schema["doc_id"].dataType.simpleString()
    row = f"doc_id {kind}, print long"
    long = doc.where(F.octet_length("text") >= WINDOW)
    # Anchors seen once are the bulk and end here; texts are scanned again instead of keeping all their segments.
    often = long.mapInArrow(anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    seg = stored(long.mapInArrow(segment_rows, f"{row}, start long, shape long, anchor long, segment long").join(often, "anchor", "left_semi"))
    same = seg.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("of"))
    # Stored, so that the joins with it meet plain tables, of which Spark can split a part that one anchor fills.
    kinds = stored(same.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    use = stored(seg.join(same, ["anchor", "segment"]).join(kinds, "anchor", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1))))
    whole = use.where("copies > 1").select("doc_id", "print", F.col("start").alias("begin"), (F.col("start") + F.floor(F.col("shape") / 256) - 1 + WINDOW).alias("end"))
    w = F.struct("anchor", "start", "shape", (F.col("copies") == 1).alias("single"), (F.col("kinds") > hot).alias("hot"))
    wanted = use.where("kinds > 1 AND (copies = 1 OR doc_id <=> of)").groupBy("doc_id", "print").agg(F.collect_set(w).alias("wanted"))

    # Both joins deal the texts alike and keep all of them, so Spark shuffles them once and reads that shuffle twice.
    packed = pack_texts(doc)
    of_row = lambda df: df.withColumnsRenamed({"doc_id": "id", "print": "p"})
    with_texts = lambda df: packed.join(of_row(df), packed.doc_id.eqNullSafe(F.col("id")) & (packed.print == F.col("p")), "left")
    asked = with_texts(wanted).select("doc_id", "print", "packed", "wanted")
    body = asked.mapInArrow(cut_segments, f"anchor long, lead long, windows long, body binary, start long, single boolean, {row}")
    spans = whole.unionByName(body.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort_segments, f"{row}, begin long, end long"))
    if not use.where(F.col("kinds") > hot).isEmpty():
        spans = spans.unionByName(hot_spans(asked.mapInArrow(cut_windows, f"anchor long, lead long, one long, two long, start long, single boolean, {row}")))
    spans = spans.groupBy("doc_id", "print").agg(F.collect_list(F.struct("begin", "end")).alias("s"))
    judged = with_texts(spans.select("doc_id", "print", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends")))
    return judged.select("doc_id", "packed", "begins", "ends").mapInArrow(remover, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def hot_spans(windows: DataFrame) -> DataFrame:
    """(doc_id, print, begin, end) of the repeated windows of single segments whose anchor has too many segments for one task to sort.

    Windows of one anchor, place and pair of hashes are equal; they are counted before the shuffle and no task needs an anchor's whole group.
    """
    key = ["anchor", "lead", "one", "two"]
    again = windows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    found = windows.where("single").join(again, key, "left_semi")
    return found.select("doc_id", "print", F.col("start").alias("begin"), (F.col("start") + WINDOW).alias("end"))
