"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is just one token that its encoding can end with.
That token is stored for each prefix. It ends at the prefix's end, and no merge crosses
the border between it and the token stored for the prefix before it; so the next byte's
state follows from the stored ones alone. Text can then be appended exactly, and after
an edit only the pieces near it are worked out again, from the prefix that stayed.

Ranks are bytes to numbers, as in rank files: two neighbours merge when their joint bytes
have a rank, the lowest first, the leftmost of equals first. A token is made of tokens of
lower rank, as in every learned list of merges; one that merging can't make so is used
only where it is a whole piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paddock.llm.common import slices, texts

#: Pieces that a task remembers; more are held only while one slice of texts needs them.
KEPT_PIECES = 500_000
#: Bytes by which the tokens that may end a prefix are looked up, at most.
KNOWN_END = 5
#: Characters after a piece that the pattern may look at before it ends the piece.
LOOKS_AHEAD = 3
#: The classes of the public pattern for Latin-1 text, for the faster splitter of the standard library.
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾", r"\s": "\\t-\\r \\x85\\xa0", r"\S": None}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def latin_pattern(pattern: str) -> str:
    """The same pattern for Latin-1 text, without Unicode classes: inside brackets a class is its characters, outside a bracket of them."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        name = next((c for c in LATIN if pattern.startswith(c, at)), None)
        if name:
            own = LATIN[name]
            out += f"[^{LATIN[chr(92) + 's']}]" if own is None else own if inside else f"[{own}]"
            at += len(name)
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out, at = out + pattern[at], at + 1
    return out


class Splitter:
    """Texts to pieces by a pattern: one for Latin-1 text, and the Unicode one."""

    def __init__(self, pattern: str):
        import regex

        self.latin, self.any = re.compile(latin_pattern(pattern)), regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return (self.latin if text.isascii() or max(text) <= "\xff" else self.any).findall(text)

    def spans(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """Borders of the pieces from a border on."""
        return (m.span() for m in self.any.finditer(text, at))


class PrefixBpe:
    """What the ranks say about tokens: how each is made, which may end a prefix, and which pairs stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.halved: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        #: The last token that was found after a prefix's last token and a further byte: the one to try first.
        self.guess: dict[tuple[bytes, int], bytes] = {}
        self.spines: tuple[dict[bytes, list[tuple[bytes, float]]], ...] = ({}, {})
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            for n in range(2, min(len(token), KNOWN_END) + 1):
                lengths.setdefault(token[-n:], set()).add(len(token))
        # Of an end, also the lengths of the tokens that are shorter ends of it; single bytes last.
        self.lengths = {end: [*sorted(own | {n for n in range(2, len(end)) if end[-n:] in ranks}, reverse=True), 1] for end, own in lengths.items()}

    def merged(self, data: bytes, below: float = float("inf")) -> list[bytes]:
        """Plain merging of a short string with the ranks under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None where merging never makes it."""
        if token not in self.halved:
            parts = self.merged(token, self.ranks[token])
            self.halved[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halved[token]

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The parts at one edge of ``token`` while it is made, each with the rank at which it is used up."""
        known = self.spines[side].get(token)
        if known is None:
            known, part, gone = [], token, float("inf")
            while True:
                known.append((part, gone))
                if len(part) == 1:
                    break
                gone, part = self.ranks[part], self.halves(part)[side]
            self.spines[side][token] = known
        return known

    def stands(self, left: bytes, right: bytes) -> bool:
        """True if no merge crosses the border of the two tokens before both are made."""
        known = self.beside.get((left, right))
        if known is None:
            known = len(right) == 1 or self.halves(right) is not None
            if known:
                rank_of, starts = self.ranks.get, self.spine(right, 0)
                for a, gone_a in self.spine(left, 1):
                    for b, gone_b in starts:
                        rank = rank_of(a + b)
                        if rank is not None and rank < gone_a and rank <= gone_b:
                            known = False
            self.beside[left, right] = known
        return known


class Prefixes:
    """One piece's bytes with the last token of each prefix; ``last[i]`` is that of the first i + 1 bytes."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def become(self, data: bytes) -> None:
        """The same for other bytes; states of the common prefix stay."""
        size = 0
        for x, y in zip(self.data, data):
            if x != y:
                break
            size += 1
        del self.last[size:]
        self.data = self.data[:size]
        self.append(data[size:])

    def append(self, more: bytes) -> None:
        first, last, bpe = len(self.data), self.last, self.bpe
        data = self.data = self.data + more
        beside, guess = bpe.beside, bpe.guess
        before = last[-1] if last else b""
        for size in range(first, len(data)):
            key = before, data[size]
            token = guess.get(key)
            if token is not None:
                at = size + 1 - len(token)
                if at > 0 and data[at : size + 1] == token and beside.get((last[at - 1], token)):
                    last.append(token)
                    before = token
                    continue
            before = guess[key] = self.found(size + 1)
            last.append(before)

    def found(self, size: int) -> bytes:
        """The one token that the encoding of the first ``size`` bytes ends with; the states before are known."""
        data, last, bpe = self.data, self.last, self.bpe
        ranks, lengths, beside = bpe.ranks, bpe.lengths, bpe.beside
        n = min(size, KNOWN_END)
        while n > 1 and data[size - n : size] not in lengths:
            n -= 1
        for n in lengths[data[size - n : size]] if n > 1 else (1,):
            at = size - n
            if at < 0:
                continue
            token = data[at:size]
            if token not in ranks:
                continue
            if at:
                pair = last[at - 1], token
                known = beside.get(pair)
                if bpe.stands(*pair) if known is None else known:
                    return token
            elif n == 1 or bpe.halves(token) is not None:
                return token
        raise ValueError(f"no token for byte {data[size - 1 : size]!r}")

    def ids(self) -> list[int]:
        ranks = self.bpe.ranks
        if self.data in ranks:  # as the library does: a piece that is a token is that token, however it would be made
            return [ranks[self.data]]
        at, out = len(self.data), []
        while at:
            token = self.last[at - 1]
            out.append(ranks[token])
            at -= len(token)
        return out[::-1]


class EncodedText:
    """A text that can be appended to and edited; its ids are always those of the whole text."""

    def __init__(self, bpe: PrefixBpe, split: Splitter, text: str = ""):
        self.bpe, self.split, self.text = bpe, split, ""
        self.starts: list[int] = []
        self.pieces: list[Prefixes] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` in place of the characters from ``start`` to ``end``; returns how many pieces were worked out again.

        Pieces that end so far before the edit that the pattern can't have seen it stay. From
        there pieces are split anew until one starts, behind the edit, where an old one did.
        """
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        ends = [*self.starts[1:], len(self.text)] if self.starts else []
        first = bisect_right(ends, start - LOOKS_AHEAD)
        at = self.starts[first] if first < len(self.starts) else len(self.text)
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        starts, pieces, stop = [], [], len(self.starts)
        for a, b in self.split.spans(text, min(at, start)):
            if a in old:
                stop = old[a]
                break
            spare = first + len(pieces)
            piece = self.pieces[spare] if spare < len(self.pieces) and spare not in old.values() else Prefixes(self.bpe)
            piece.become(text[a:b].encode())
            starts.append(a), pieces.append(piece)
        self.starts[first:] = starts + [s + shift for s in self.starts[stop:]]
        self.pieces[first:] = pieces + self.pieces[stop:]
        self.text = text
        return len(pieces)

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in p.ids()]


class Encoder:
    """Ids of many texts; each distinct piece is worked out once, in order, each from the prefix that it shares with the one before."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT_PIECES):
        self.bpe, self.split, self.kept = PrefixBpe(read_ranks(path)), Splitter(pattern), kept
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])

    def ids(self, batch: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids for each text."""
        split = [self.split(t) if t else [] for t in batch]
        found = set().union(*split)
        new = found - self.place.keys()
        if len(self.place) + len(new) > self.kept:
            self.forget()
            new = found
        walk = Prefixes(self.bpe)
        for piece in sorted(new):
            walk.become(piece.encode())
            self.place[piece] = len(self.starts) - 1
            self.flat.extend(walk.ids())
            self.starts.append(len(self.flat))
        flat, starts = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.starts, np.int64)
        laid = flat, starts[:-1], np.diff(starts)
        return [joined(laid, np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))) for pieces in split]


class Decoder:
    """Ids to bytes: each token's bytes, and its decimal id and a blank, stand in one array of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        token, decimal = ([b""] * (max(ranks.values(), default=-1) + 1) for _ in range(2))
        for own, i in ranks.items():
            token[i], decimal[i] = own, b"%d " % i
        self.token, self.decimal = self.laid(token), self.laid(decimal)

    @staticmethod
    def laid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), size.cumsum() - size, size

    def bytes(self, ids: np.ndarray) -> bytes:
        return joined(self.token, ids).tobytes()

    def listed(self, ids: np.ndarray) -> bytes:
        """The decimal ids, joined by one blank."""
        return joined(self.decimal, ids)[:-1].tobytes()


def joined(laid: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The runs that stand at the places ``at``, one after the other; laid: values, first and size of each run."""
    flat, first, size = laid
    size = size[at]
    ends = size.cumsum()
    return flat[np.repeat(first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def token_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per row of ``docs``; null and empty texts have no ids. See ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = encoder.ids(part["text"].to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])

    doc = texts(docs, id_col, text_col)
    return doc.mapInArrow(run, f"doc_id {doc.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, data binary) of ``token_ids`` rows: the bytes that the ids stand for. Null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(ranks_path))
        for batch in batches:
            data = [decoder.bytes(np.array(ids, np.int64)) for ids in (own or [] for own in batch["ids"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def apply_edits(edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, redone long) of rows (doc_id, text, edits array<struct<start int, stop int, new string>>).

    The edits of a row are made one after the other, each on the text that the one before
    left; ``redone`` counts the pieces that edits had worked out again. Null text is the
    empty one, null edits are none, a null ``new`` deletes; places past the end are the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split = PrefixBpe(read_ranks(ranks_path)), Splitter(pattern)
        for batch in batches:
            for part in slices(batch):
                ids, redone = [], []
                for text, own in zip(part["text"].to_pylist(), part["edits"].to_pylist()):
                    state, n = EncodedText(bpe, split, text or ""), 0
                    for e in own or ():
                        start = min(max(e["start"] or 0, 0), len(state.text))
                        n += state.replace(start, min(max(e["stop"] or 0, start), len(state.text)), e["new"] or "")
                    ids.append(state.ids()), redone.append(n)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array(redone, pa.int64())], names=["doc_id", "ids", "redone"])

    kind = edits.schema["doc_id"].dataType.simpleString()
    return edits.select("doc_id", "text", "edits").mapInArrow(run, f"doc_id {kind}, ids array<int>, redone long")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs``.

    The ids are those of each match of ``pattern`` on its own, without special tokens, and
    the decoded bytes come from the ids. A null or empty text has no token and the digests
    of ''. Repeated rows and ids are encoded each; other columns don't matter; an empty table
    gives an empty result. A task holds a few MB of texts at a time, and one text at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        decoder = Decoder(encoder.bpe.ranks)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for part in slices(batch):
                n, ids, decoded = [], [], []
                for found in encoder.ids(part["text"].to_pylist()):
                    n.append(len(found)), ids.append(sha(decoder.listed(found))), decoded.append(sha(decoder.bytes(found)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    doc = texts(docs, id_col, text_col)
    return doc.mapInArrow(run, f"doc_id {doc.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
