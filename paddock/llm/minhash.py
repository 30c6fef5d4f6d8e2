"""Near duplicates by circulant MinHash.

Every document is the set of its word shingles. One permutation of the 32-bit universe
scatters the shingles, a second one is shifted circularly by k to give coordinate k of the
signature, so two permutations make all coordinates. Bands of coordinates are bucket keys.
Documents with equal sets are one class, and only classes go on. In a bucket, one member
is compared with all others, not all with all; what is found links classes. Only buckets
whose members aren't all linked by then need more: members of small ones are compared pair
by pair across components. Large ones that share members are one crowd; there, blocks of
the members outside the crowd's main component meet blocks of all its members whose sets are of
about the same size, and only links leave a block. Each comparison is exact, on full sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import durable, in_tasks, pack_texts, printed, slices, stored, unpack
from paddock.llm.components import components

#: A pair of similarity 0.8 shares no band with a chance of 3e-6.
BANDS, ROWS = 32, 5
#: Most members of a small bucket; shingles of a crowd's blocks, about; pairs with one text that a task compares.
SMALL = 12
OUTER_BLOCK, INNER_BLOCK = 100_000, 400_000
FAN = 1_000
KEPT_WORDS = 200_000
BLOCK = 1 << 15
PACKED_BYTES = 1_000_000
WORD = re.compile(rb"[^ \t-\r]+")


class Shingler:
    """Texts to sorted arrays of their distinct shingles' 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.place: dict[bytes, int] = {}
        self.hashes = np.zeros(1024, np.uint64)

    def sets(self, batch: list[bytes]) -> list[np.ndarray]:
        split = [WORD.findall(t.lower()) for t in batch]  # bytes.lower() folds A to Z alone
        if len(self.place) > KEPT_WORDS:
            self.place.clear()
        new = list(set().union(*split) - self.place.keys())
        first = len(self.place)
        self.place.update(zip(new, range(first, first + len(new))))
        if len(self.place) > len(self.hashes):
            self.hashes = np.resize(self.hashes, 2 * len(self.place))
        self.hashes[first : first + len(new)] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        return [self._set(self.hashes[np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))]) for ws in split]

    def _set(self, words: np.ndarray) -> np.ndarray:
        n = min(self.size, len(words))
        if not n:
            return words
        value = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
        return np.unique((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit numbers."""
    x = x * np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(15)
    return x * np.uint32(0x297A2D39)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of circulant MinHash coordinates for each non-empty set."""
    first = np.cumsum([0, *map(len, sets[:-1])])
    start = scatter((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32))
    out = np.full((coordinates, len(sets)), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(start), BLOCK):  # blocks stay in the processor's cache
        block = start[at : at + BLOCK]
        lo, hi = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, at + len(block), "left")
        cuts = np.maximum(first[lo:hi] - at, 0)
        x, y = np.empty_like(block), np.empty_like(block)
        for k in range(coordinates):
            np.subtract(block, np.uint32(k), out=x)  # the shift, around the ends of the universe
            np.right_shift(x, 16, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x85EBCA6B), out=x)
            np.right_shift(x, 13, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0xC2B2AE35), out=x)
            np.right_shift(x, 16, out=y)
            np.bitwise_xor(x, y, out=x)
            np.minimum(out[k, lo:hi], np.minimum.reduceat(x, cuts), out=out[k, lo:hi])
    return out.T


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit keys; the band's number is part of its key."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    coordinates = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for j in range(rows):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + coordinates[:, :, j] * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def sketcher(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for part in slices(batch):
                sets = shingler.sets([t.encode() for t in part["text"].to_pylist()])
                full = [s for s in sets if len(s)]
                keys = band_keys(signatures(full, bands * rows), bands, rows) if full else np.zeros((0, bands), np.int64)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["print"], pa.array(sizes), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(ends, keys.ravel())], names=["doc_id", "print", "n", "digest", "bands"])

    return run


def comparer(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, own = Shingler(size), None, None
        for batch in batches:
            for part in slices(batch, "text_b", PACKED_BYTES):
                similar = []
                others = shingler.sets(unpack(part["text_b"].to_pylist()))
                for a, text, b in zip(part["a"].to_pylist(), part["text_a"], others):
                    if a != held:
                        held, own = a, shingler.sets(unpack([text.as_py()]))[0]
                    common = len(own) + len(b) - len(np.union1d(own, b))
                    similar.append(100 * common >= percent * (len(own) + len(b) - common))
                yield part.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right ones, by products of 0/1 matrices of ``width`` columns."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    cells = []
    for values, sets in ((a, left), (b, right)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(both, values)
        known = both[np.minimum(column, len(both) - 1)] == values if len(both) else np.zeros(len(values), bool)
        cells.append((row[known], column[known]))
    for at in range(0, len(both), width):
        sides = []
        for (row, column), sets in zip(cells, (left, right)):
            inside = (column >= at) & (column < at + width)
            side = np.zeros((len(sets), min(width, len(both) - at)), np.float32)
            side[row[inside], column[inside] - at] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def block_links(size: int, percent: int):
    def run(block: pa.Table) -> pa.Table:
        shingler = Shingler(size)
        outer, inner = (block.filter(pc.equal(block["outer"], x)) for x in (True, False))
        if not len(outer) or not len(inner):
            return block.select(["node", "node"]).slice(0, 0).rename_columns(["a", "b"])
        left, right = (shingler.sets(unpack(side["packed"].to_pylist())) for side in (outer, inner))
        common = common_counts(left, right)
        union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right]) - common
        x, y = np.nonzero(100 * common >= percent * union)
        a, b = outer["node"].take(pa.array(x)), inner["node"].take(pa.array(y))
        links = pa.table({"a": pc.min_element_wise(a, b), "b": pc.max_element_wise(a, b)})
        return links.filter(pc.not_equal(links["a"], links["b"]))

    return run


def similar_sizes(a: str, b: str, percent: int) -> Column:
    """False for sets that are too unlike in size to be linked."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def crowd_links(body: DataFrame, live: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members of large buckets; live: key, node, n, component. Every pair of a bucket in two components that can be linked is compared.

    Blocks hold members of one size class; only equal and neighbouring classes can be linked, so only these meet.
    """
    low = live.groupBy("key").agg(F.min("node").alias("low"))
    crowd = components(live.join(low, "key").select(F.col("low").alias("a"), F.col("node").alias("b"))).withColumnsRenamed({"node": "member", "component": "crowd"})
    step = math.log(max(100 / percent, 1.01) * 1.0001)
    member = live.select("node", "n", "component").distinct().join(crowd, F.col("node") == F.col("member"))
    member = durable(member.select("crowd", "node", "n", "component", F.floor(F.log("n") / step).alias("c")))
    main = member.groupBy("crowd", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("crowd").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    member = member.join(main, "crowd").withColumn("outer", F.col("component") != F.col("main"))
    weight = F.sum(F.when(F.col("outer"), F.col("n")).otherwise(0))
    sized = durable(member.groupBy("crowd", "c").agg(F.ceil(F.sum("n") / INNER_BLOCK).alias("inners"), F.ceil(weight / OUTER_BLOCK).alias("outers")))
    own = member.join(sized, ["crowd", "c"]).withColumn("spot", F.abs(F.xxhash64("node") % (1 << 30)))
    meets = own.withColumn("met", F.explode(F.array(*[F.col("c") + d for d in (-1, 0, 1)])))
    other = sized.select("crowd", F.col("c").alias("met"), F.col("inners").alias("other_inners"), F.col("outers").alias("other_outers"))
    meets = meets.join(other, ["crowd", "met"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    inner = meets.where("other_outers > 0").select("crowd", F.col("met").alias("co"), F.col("c").alias("ci"), each("other_outers").alias("o"), (F.col("spot") % F.col("inners")).alias("i"), F.lit(False).alias("outer"), "node")
    outer = meets.where("outer").select("crowd", F.col("c").alias("co"), F.col("met").alias("ci"), (F.col("spot") % F.col("outers")).alias("o"), each("other_inners").alias("i"), F.lit(True).alias("outer"), "node")
    block = inner.union(outer).join(body, "node")
    return block.groupBy("crowd", "co", "ci", "o", "i").applyInArrow(block_links(size, percent), "a long, b long").distinct()


def linked(body: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough; body: node, packed. A node in very many pairs as ``a`` is dealt to several tasks."""
    fan = durable(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("fan")))
    spread = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), "fan").alias("part"))
    second = spread.join(body.select(F.col("node").alias("b"), F.col("packed").alias("text_b")), "b")
    first = body.select(F.col("node").alias("a"), F.col("packed").alias("text_a")).join(fan, "a")
    first = first.select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias("part"))
    both = second.join(first, ["a", "part"])
    return in_tasks(both.select("a", "b", "text_a", "text_b"), comparer(size, percent), "a long, b long").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, tie: bool = True) -> DataFrame:
    """(doc_id, print, n_shingles, component_id, kept, stays), one row per row of ``docs``; see ``near_duplicates``.

    ``print`` is the hash of the text as it came; ``stays`` marks one of the rows of each
    component, that of the least doc_id. With ``tie``, rows of one doc_id are one document,
    and tie what each of them is linked with; else only texts link rows. Inside, a row is named by a number that the first
    stored table gives it, and a node is the least such number of the rows with equal sets.
    """
    doc = printed(docs, id_col, text_col)
    kind = doc.schema["doc_id"].dataType.simpleString()
    sketch = in_tasks(doc, sketcher(size, bands, rows), f"doc_id {kind}, print long, n long, digest binary, bands array<long>")
    sketch = stored(sketch.withColumn("rid", F.monotonically_increasing_id()))
    shared = sketch.where("n > 0").groupBy("digest").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("digest").alias("d"), "first")
    at_class = lambda df: df.join(shared, F.col("digest") == F.col("d"), "left").withColumn("node", F.coalesce("first", "rid")).drop("digest", "d", "first")
    member = stored(at_class(sketch.drop("bands")))
    # One row of each class; the others' bands aren't needed.
    at = at_class(sketch.where("n > 0")).where("rid = node").select("node", "n", F.explode("bands").alias("key"))
    bucket = at.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top"), F.min_by("n", "node").alias("pivot_n")).where("pivot <> top").drop("top")
    held = stored(at.join(bucket, "key"))
    tried = stored(held.where(F.col("node") != F.col("pivot")).where(similar_sizes("n", "pivot_n", percent)).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    # Only texts of classes that share a bucket travel, packed, and only once as part of all texts.
    some = member.join(held.select("node").distinct(), "node", "left_semi").where("rid = node").select(F.col("doc_id").alias("id"), F.col("print").alias("p"), "node")
    whole = pack_texts(doc)
    body = stored(whole.join(some, whole.doc_id.eqNullSafe(F.col("id")) & (whole.print == F.col("p"))).select("node", "packed"))
    edges = linked(body, tried, size, percent)
    if tie:
        edges = edges.unionByName(tied_by_id(member))
    edges = durable(edges)
    label = durable(components(edges))
    live = with_component(held.select("key", "node", "n"), label)
    state = live.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"))
    state = state.where("lo <> hi").select("key", "members")
    live = stored(live.join(state, "key").select("key", "node", "n", "component", "members"))
    small = live.where(F.col("members") <= SMALL).select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    other = small.withColumnsRenamed({"a": "b", "na": "nb", "ca": "cb"})
    met = small.join(other, "key").where("a < b AND ca <> cb").where(similar_sizes("na", "nb", percent)).select("a", "b").distinct()
    met = stored(met.join(tried, ["a", "b"], "left_anti"))
    more = linked(body, met, size, percent)
    crowded = crowd_links(body, live.where(F.col("members") > SMALL).select("key", "node", "n", "component"), size, percent)
    # Only what the second look found is contracted again, with the first components as nodes.
    late = more.union(crowded)
    named = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    late = durable(late.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    joined = components(late).select(F.col("node").alias("was"), F.col("component").alias("now"))
    out = with_component(member, label)
    out = stored(out.join(joined, out.component == joined.was, "left").select("doc_id", "print", "rid", "n", F.coalesce("now", "component").alias("component")))
    least = out.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least"))
    out = out.join(least, "component")
    component_id = F.col("least.doc_id")
    return out.select("doc_id", "print", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"), (F.col("rid") == F.col("least.rid")).alias("stays"))


def tied_by_id(member: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of the texts of one doc_id."""
    ids = member.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "node")
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select(F.col("doc_id").alias("id"), "a")
    return ids.join(several, F.col("doc_id") == F.col("id")).select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are runs without ASCII white space, A to Z folded; a text of fewer than ``size``
    words is one shingle, a text without words has none and no link. Documents are linked
    if 100 * |intersection| >= percent * |union|; component_id is the least doc_id reachable.
    Rows that repeat a doc_id are one node, whatever their texts, and reach what any of them
    reaches. Rows without a doc_id are linked like others; component_id is null, and they are
    kept, only where no row reachable has an id. An empty table gives an empty result.
    """
    return near_classes(docs, id_col, text_col, size, percent, bands, rows).drop("print", "stays")


def with_component(df: DataFrame, label: DataFrame) -> DataFrame:
    """Adds component: that of the row's node, or the node itself where nothing is linked to it."""
    known = label.select(F.col("node").alias("of"), "component")
    return df.join(known, df.node == F.col("of"), "left").withColumn("component", F.coalesce("component", "node")).drop("of")
