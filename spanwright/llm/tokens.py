"""Token ids of whole texts by a public tokenizer file, with a cache of words for each worker.

The pieces between spaces have ids of their own in both tokenizers used here: no token of
theirs reaches over a space that follows a word. So a text's ids are its pieces' ids joined;
a text with runs of white space that a piece would cut, or with a token that the file adds to
its vocabulary ("<|endoftext|>"), goes to the tokenizer whole.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps; others are encoded again whenever they come.
KEPT = 500_000
#: Pieces that go to the tokenizer in one string.
RUN = 200
_workers: dict = {}


def _byte_letters() -> dict[int, str]:
    """The visible stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, the others for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Pieces:
    """``spaced``: a piece's ids depend on the space before it (byte-level vocabularies)."""

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.letters = _byte_letters()
        self.known: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """Ids of letters only: one pre-token, so the model can take it without a search."""
        if self.spaced:
            word = " " + word
        else:
            if "Σ" in word or "İ" in word or not unicodedata.is_normalized("NFC", word):
                return self.whole(word)
            word = word.lower()
            if not word.isalpha():
                return self.whole(word)
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(mapped)])

    def _piece(self, piece: str) -> bytes | None:
        if self.spaced and (not piece or piece.isspace()):
            return None
        if not piece:
            return b""
        if piece.isalpha():
            return self._word(piece)
        if piece[-1] in ".," and piece[:-1].isalpha():  # the mark is a pre-token of its own
            base = self.known.get(piece[:-1])
            return (self._word(piece[:-1]) if base is None else base) + self._mark(piece[-1])
        return self.whole((" " if self.spaced else "") + piece)

    def _mark(self, mark: str) -> bytes:
        key = "\x00" + mark
        if key not in self.known:
            self.known[key] = self.whole(mark)
        return self.known[key]

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(t in text for t in self.added):
            return self.whole(text)
        pieces = text.split(" ")
        head = b""
        if self.spaced:
            head = self.whole(pieces[0])
            pieces = pieces[1:]
        known = self.known
        got = list(map(known.get, pieces))
        if None in got:
            for at, held in enumerate(got):
                if held is None:
                    piece = pieces[at]
                    held = known.get(piece)  # it may have come earlier in this text
                    if held is None:
                        held = self._piece(piece)
                        if held is None:  # white space that reaches over a piece
                            return self.whole(text)
                        if len(known) < KEPT:
                            known[piece] = held
                    got[at] = held
        return head + b"".join(got)

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after the other, and how many each has; for ``spaced`` only. Each
        different piece of them is looked up once, and those that aren't kept are encoded
        together."""
        heads: list[bytes | None] = [self.whole(t) if any(a in t for a in self.added) else None for t in texts]
        parts = pc.split_pattern(pa.array([t if h is None else "" for t, h in zip(texts, heads, strict=True)], pa.string()), " ")
        bounds = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype(np.int64)
        known = self.known
        got = list(map(known.get, words))
        loose = [at for at, held in enumerate(got) if held is None]
        for at, held in zip(loose, self._together([words[i] for i in loose]), strict=True):
            got[at] = held
            if held is not None and len(known) < KEPT:
                known[words[at]] = held
        first, owner = bounds[:-1], np.repeat(np.arange(len(texts)), np.diff(bounds))
        white = np.array([held is None for held in got], dtype=bool)[codes]
        white[first] = False
        whole = set(np.unique(owner[white]).tolist())  # white space reaches over a piece
        for i, text in enumerate(texts):
            if heads[i] is None:
                heads[i] = self.whole(text if i in whole else words[codes[first[i]]])
        if whole:
            codes[np.isin(owner, list(whole))] = len(got)
        codes[first] = len(got) + 1 + np.arange(len(texts))
        entries = [held or b"" for held in got] + [b""] + heads
        lengths = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // 4
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[codes]
        before = np.cumsum(sizes) - sizes
        place = np.repeat(starts[codes] - before, sizes)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(entries), dtype="<u4")[place], np.add.reduceat(sizes, first) if len(texts) else sizes

    def _together(self, pieces: list[str]) -> list[bytes | None]:
        """As ``_piece`` of each: pieces that don't begin with white space go to the tokenizer in long
        runs, in which those tokens that begin with a space begin a piece."""
        out: list[bytes | None] = [None] * len(pieces)
        plain = [at for at, p in enumerate(pieces) if p and not p[0].isspace()]
        taken = set(plain)
        for at, p in enumerate(pieces):
            if at not in taken:
                out[at] = self._piece(p)
        runs = [plain[i : i + RUN] for i in range(0, len(plain), RUN)]
        joined = ["".join([" " + pieces[at] for at in run]) for run in runs]
        for run, coded in zip(runs, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype="<u4")
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) != len(run) or begins[0]:
                for at in run:
                    out[at] = self.whole(" " + pieces[at])
                continue
            data, ends = ids.tobytes(), [*begins[1:].tolist(), len(ids)]
            for at, b, e in zip(run, begins.tolist(), ends, strict=True):
                out[at] = data[4 * b : 4 * e]
        return out

    @functools.cached_property
    def opens(self) -> np.ndarray:
        """Which ids' tokens begin with a space."""
        out = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=bool)
        out[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(self.letters[32])]] = True
        return out


# Fixed value: how byte-level vocabularies of this family part a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankedPieces(Pieces):
    """A spaced vocabulary whose ids ascend in the order of its merges, so that an id is its
    rank. Pieces that aren't kept are merged by ranks at once, a quarter of the time."""

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__(path, spaced=True)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids don't ascend with merges")
        back = {letter: byte for byte, letter in self.letters.items()}
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        self.merge = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self.whole(text)
        first, *pieces = text.split(" ")
        known = self.known
        got = list(map(known.get, pieces))
        for at, held in enumerate(got):
            if held is None:
                piece = pieces[at]
                if not piece or piece.isspace():  # white space that reaches over a piece
                    return self.merged(text)
                got[at] = held = self.merged(" " + piece)
                if len(known) < KEPT:
                    known[piece] = held
        return self.merged(first) + b"".join(got)

    def merged(self, text: str) -> bytes:
        return _packed(self.merge(text))


def pieces_of(path: str, spaced: bool, ranked: bool = False) -> Pieces:
    """The worker's own, kept between tasks."""
    key = (path, spaced, ranked)
    if key not in _workers:
        _workers[key] = RankedPieces(path) if ranked else Pieces(path, spaced)
    return _workers[key]


def forget() -> None:
    """Lets go of the worker's tokenizers and pieces, for tasks that need the memory themselves;
    a task that encodes loads them again."""
    _workers.clear()
