"""Token ids of texts, made once per distinct word.

The vocabulary's rules never join characters across white space, nor across a
border between an ASCII letter and one of ``.,!?;:%$&*#"()``, so a text's ids are
those of its pieces in order. Each Python worker keeps the ids of the pieces it
has met and hands only new ones to the tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from quarry.llm import arrays as A

#: Pieces a worker remembers before it starts anew: about 40 MB.
REMEMBERED_PIECES = 200_000
#: Pieces handed to the tokenizer in one call, whose result takes over a kilobyte for each.
PIECES_A_CALL = 500
_CUT_MARKS = np.zeros(256, dtype=bool)
_CUT_MARKS[list(b'.,!?;:%$&*#"()')] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = True
_LETTERS[97:123] = True

_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PLAIN_LETTERS = [chr(i) for i in range(256) if _PLAIN.fullmatch(chr(i))]

_encoders: dict[str, "PieceEncoder"] = {}
A.CACHES.append(_encoders)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        t = self.tokenizer
        # what the normalizer and pre-tokenizer make of a letter: runs of these letters
        # are one pre-token, so the model can be asked directly
        self.letters = {ord(c): "".join(x for x, _ in t.pre_tokenizer.pre_tokenize_str(
            t.normalizer.normalize_str(c))) for c in _PLAIN_LETTERS}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 15, dtype=np.int64)
        self.count = np.zeros(1 << 15, dtype=np.int64)

    def _encode_pieces(self, texts: list[str]) -> list[list[int]]:
        model, letters, plain = self.tokenizer.model, self.letters, _PLAIN.fullmatch
        lists = [[x.id for x in model.tokenize(s.translate(letters))] if plain(s) else None
                 for s in texts]
        other = [i for i, x in enumerate(lists) if x is None]
        for k in range(0, len(other), PIECES_A_CALL):
            some = other[k:k + PIECES_A_CALL]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([texts[i] for i in some],
                                                                   add_special_tokens=False)):
                lists[i] = e.ids
        return lists

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        lists = self._encode_pieces(texts)
        n, k = len(lists), len(self.place)
        lengths = np.fromiter(map(len, lists), np.int64, n)
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(lengths.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        if k + n > len(self.first):
            more = np.zeros(max(len(self.first), n), np.int64)
            self.first, self.count = np.concatenate([self.first, more]), np.concatenate([self.count, more])
        self.ids[self.used:self.used + len(flat)] = flat
        self.first[k:k + n] = self.used + np.cumsum(lengths) - lengths
        self.count[k:k + n] = lengths
        self.used += len(flat)
        self.place.update(zip(hashes.tolist(), range(k, k + n)))

    def encode(self, chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's rows in order, and the row limits in them."""
        data = chunk.data
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(chunk.rows + 1, np.int64)
        cuts = np.zeros(len(data), dtype=bool)
        left, right = data[:-1], data[1:]
        cuts[1:] = (_LETTERS[left] & _CUT_MARKS[right]) | (_CUT_MARKS[left] & _LETTERS[right])
        pieces = A.split_words(chunk, cuts)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(chunk.rows + 1, np.int64)
        hashes, at, back = np.unique(A.span_hashes(data, pieces.start, pieces.end),
                                     return_index=True, return_inverse=True)
        if len(self.place) > REMEMBERED_PIECES:
            self._forget()
        known = np.fromiter((self.place.get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(known < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(hashes[new], [raw[s:e].decode("utf-8") for s, e in
                                      zip(pieces.start[at[new]].tolist(), pieces.end[at[new]].tolist())])
            known[new] = np.arange(len(self.place) - len(new), len(self.place))
        entry = known[back]
        counts = self.count[entry]
        ends = np.cumsum(counts)
        source = np.repeat(self.first[entry] - (ends - counts), counts) + np.arange(ends[-1])
        limits = np.concatenate([[0], ends])[pieces.row_first]
        return self.ids[source], limits


def encoders() -> dict:
    """The worker's encoders, whose pieces are bounded."""
    return _encoders


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encoded_rows(path: str, col, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, row limits) for each chunk of a string column."""
    enc = encoder(path)
    for chunk in A.chunks(col, max_bytes):
        ids, limits = enc.encode(chunk)
        yield chunk.first_row, ids, limits
