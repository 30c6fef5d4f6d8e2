"""BPE encoding of whole texts by a trie over their distinct words.

Under BPE the encoding of a prefix is the encoding of a shorter prefix plus one last token,
and that token is the only one that ends there and stands beside the token before it. So a
trie node needs only its last token and where that token starts. Distinct words are put in
a trie and one depth-first walk hands these states from prefix to longer prefix; a prefix
that many words share is worked out once. The trie holds the new words of one slice of texts,
and states of one path only.

Spark deals out the documents; each task keeps a bounded memory of words it has encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paddock.llm.common import slices, texts

#: Pieces that a task remembers; more are held only while one slice of texts needs them.
KEPT_PIECES = 400_000
END = "</w>"
ONE = [1]
#: Characters by which the tokens that may end a path are looked up, at most.
KNOWN_END = 5
#: Marks a piece in the library's form; no text holds this half of a surrogate pair.
GIVEN = "\ud800"
#: The library's pre-tokenizer for text that has Latin-1 characters only, where its normal form is lower case.
LETTER, NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
LATIN_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^ \t-\r\x85\xa0{LETTER}{NUMBER}]+")


class TrieBpe:
    """Encodes many words at once with a vocabulary and ranked merges that mark word ends with ``</w>``."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.vocab = vocab
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.born: dict[str, int] = {}
        for place, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault((left, right), place)
            if left + right not in self.parts:
                self.parts[left + right] = (left, right)
                self.born[left + right] = place
        # For an end of a path, the tokens that may end there, given as lengths, the longest first: those of a merge, and single characters.
        self.beside: dict[tuple[str, str], bool] = {}
        self.spines: tuple[dict[str, list[tuple[str, float]]], ...] = ({}, {})
        made = vocab.keys() & self.parts.keys()
        self.made, self.sizes = made, {"": {}, END: {}}
        for token in made:
            plain, end = token.removesuffix(END), END if token.endswith(END) else ""
            for n in range(2, min(len(plain), KNOWN_END) + 1):
                self.sizes[end].setdefault(plain[-n:], set()).add(len(plain))
        for end, own in self.sizes.items():
            exact = {k: [n for n in range(len(k) - 1, 1, -1) if k[-n:] + end in made] for k in own}
            self.sizes[end] = {k: [*sorted(n, reverse=True), *exact[k], 1] for k, n in own.items()}

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The pieces that lie at one edge of ``token`` while it is built, each with the rank at which it is used up."""
        known = self.spines[side].get(token)
        if known is None:
            out, gone, piece = [], float("inf"), token
            while piece in self.parts:
                out.append((piece, gone))
                gone = self.born[piece]
                piece = self.parts[piece][side]
            known = self.spines[side][token] = [*out, (piece, gone)]
        return known

    def stands(self, left: str, right: str) -> bool:
        """True if merging the text of both tokens yields just these two: no merge crosses their border in time."""
        known = self.beside.get((left, right))
        if known is None:
            rank, known = self.rank, True
            for a, gone_a in self.spine(left, 1):
                for b, gone_b in self.spine(right, 0):
                    place = rank.get((a, b))
                    if place is not None and place < gone_a and place <= gone_b:
                        known = False
            self.beside[left, right] = known
        return known

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of every word. A word is a non-empty string of the vocabulary's single characters.

        The trie is laid out depth first: its words in order, each of which leaves the path of
        the one before at the end of the prefix that both share. Up to there the states stand.
        """
        made, beside = self.made, self.beside
        out: dict[str, list[str]] = {}
        last, start = [], []  # for each prefix of the path: its last token and where that starts
        before = ""
        for word in sorted(words):
            whole = len(word)
            size = 0
            for x, y in zip(before, word[:-1]):
                if x != y:
                    break
                size += 1
            size = min(size, len(last))
            del last[size:], start[size:]
            before = word
            while size < whole:
                size += 1
                end = END if size == whole else ""
                sizes, n = self.sizes[end], min(size, KNOWN_END)
                while n > 1 and word[size - n : size] not in sizes:
                    n -= 1
                for n in sizes[word[size - n : size]] if n > 1 else ONE:
                    at = size - n
                    token = word[at:size] + end if at >= 0 else None
                    if n == 1 or token in made:
                        if at:
                            pair = last[at - 1], token
                            known = beside.get(pair)
                            if not (self.stands(*pair) if known is None else known):
                                continue
                        last.append(token), start.append(at)
                        break
                else:
                    raise ValueError(f"no token for the end of {word[:size][-20:]!r}")
            at, tokens = size, []
            while at:
                tokens.append(last[at - 1])
                at = start[at - 1]
            out[word] = tokens[::-1]
            last.pop(), start.pop()  # the state at a word's end is no other word's
        return out


class PieceIds:
    """Token ids of whole texts. Each distinct piece (pre-token) is encoded once; pieces are remembered up to a bound."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.stored = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.added = {t["content"]: t["id"] for t in self.stored["added_tokens"]}
        self.any_added = re.compile("(" + ("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)") + ")")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as the character of that number
        self.visible = {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}

        self.kept = kept
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])

    def pieces(self, text: str) -> list[str]:
        """The text's pieces: as they stand in it, lower-cased, if it is Latin-1, else in the vocabulary's form, after ``GIVEN``."""
        out: list[str] = []
        for i, part in enumerate(self.any_added.split(text)):  # texts and special tokens by turns
            if i % 2:
                out.append(GIVEN + part)
                continue
            try:
                part.encode("latin-1")
                out += LATIN_PIECE.findall(part.lower())
            except UnicodeEncodeError:
                out += [GIVEN + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def shown(self, piece: str) -> str:
        if piece[0] == GIVEN:
            return piece[1:]
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.visible)

    def encoded(self, words: list[str]) -> Iterable[list[int]]:
        """Ids of each word, by the library's own model."""
        return ([t.id for t in self.library.model.tokenize(w)] for w in words)

    def ids(self, batch: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids for each text."""
        split = [self.pieces(t) for t in batch]
        new = [p for p in set().union(*split) if p not in self.place]
        if len(self.place) + len(new) > self.kept:
            self.forget()
            new = list(set().union(*split))
        words = [self.shown(p) for p in new]
        plain = iter(self.encoded([w for w in words if w not in self.added]))
        for piece, word in zip(new, words):
            self.place[piece] = len(self.starts) - 1
            self.flat.extend([self.added[word]] if word in self.added else next(plain))
            self.starts.append(len(self.flat))
        flat, starts = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.starts, np.int64)
        out = []
        for ps in split:
            at = np.fromiter(map(self.place.__getitem__, ps), np.int64, len(ps))
            first, size = starts[at], starts[at + 1] - starts[at]
            ends = size.cumsum()
            out.append(flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)])
        return out


class TrieIds(PieceIds):
    """The same ids by the trie, and what the ids decode to."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        super().__init__(path, kept)
        model = self.stored["model"]
        self.number = {**model["vocab"], **self.added}
        self.bpe = TrieBpe(model["vocab"], model["merges"])
        #: By id: the token's decimal id and its text, a blank after each.
        self.decimal, self.text = ([b""] * (max(self.number.values()) + 1) for _ in range(2))
        for token, i in self.number.items():
            self.decimal[i], self.text[i] = b"%d " % i, token.encode() + b" "

    def encoded(self, words: list[str]) -> Iterable[list[int]]:
        tokens, number = self.bpe.encode(set(words)), self.number
        return ([number[t] for t in tokens[w]] for w in words)


def encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TrieIds(path)
        sha = lambda table, ids: hashlib.sha256(b"".join(map(table.__getitem__, ids))[:-1]).hexdigest()
        for batch in batches:
            for part in slices(batch):
                n, ids, decoded = [], [], []
                for found in codec.ids(part["text"].to_pylist()):
                    listed = found.tolist()
                    n.append(len(listed)), ids.append(sha(codec.decimal, listed)), decoded.append(sha(codec.text, listed))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs``.

    Equal to the library's encode without special tokens added, and to its decode with
    special tokens kept. A null or empty text has no token and the digests of ''. Repeated
    rows are encoded each; an empty table gives an empty result. A very long text, or one with
    very many special tokens, takes memory in proportion to its length.
    """
    doc = texts(docs, id_col, text_col)
    kind = doc.schema["doc_id"].dataType.simpleString()
    return doc.mapInArrow(encoder(tokenizer_path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
