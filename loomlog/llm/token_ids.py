"""Token ids of texts inside a task, by the tokenizers library with a cache of pieces.

The supported tokenizers drop white space and merge neither across it nor across the
border of letters, digits and other characters, so the ids of a text are those of its
pieces, one after the other, and each distinct piece has to be encoded once only. Words in which
more than one piece may depend on its neighbours (apostrophes, marks, other scripts)
stay whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from loomlog.llm.common import LONG_TEXT, at_spaces, lower_ascii

#: Pieces that a worker remembers, at most about 100 MB.
CACHE_PIECES = 500_000

_ALONE = r"(?![^\x00-\x26\x28-\x7f])"  # before an ASCII character other than the apostrophe, or at the end
# the same for runs of punctuation, which go on through the control characters that are no white space
_ENDED = r"(?![^\x09-\x0d\x20-\x26\x28-\x7e])"
LETTERS = re.compile("[a-zÀ-ÖØ-öø-įı-ſ]+|[!-&(-/:-@\\[-`{-~]+")
PIECE = re.compile(
    rf"[a-zÀ-ÖØ-öø-įı-ſ]++{_ALONE}|[!-&(-/:-@\[-`{{-~]++{_ENDED}|[0-9]{_ALONE}|[^\x09-\x0d\x20]+"
)


class PieceTokenizer:
    """Ids of whole texts as uint32 arrays. Needs a tokenizer that ignores case and white space and marks word ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.last = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.last[i] = token.endswith("</w>")
        if b"".join(self._words(["a.1 The"])) != b"".join(self._words(["the", "A", ".", "1"])[i] for i in (1, 2, 3, 0)):
            raise ValueError("the tokenizer keeps case or white space")
        # strings that the library looks for before it lower-cases
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, dtype="<u4").tobytes()
            for e in self.library.encode_batch_fast(words, add_special_tokens=False)
        ]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that each end with a word end: encoded together and cut there."""
        ids = np.array(self.library.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(pieces):
            return self._words(pieces)
        data, out, start = ids.tobytes(), [], 0
        for end in ends.tolist():
            out.append(data[start:end])
            start = end
        return out

    def ids(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with ``end_id`` after them."""
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        if all(len(t) <= LONG_TEXT for t in texts):
            data = self._data(texts)
        else:
            data = [b"".join(self._data([p])[0] for p in at_spaces(t)) for t in texts]
        return [np.frombuffer(d + end, dtype="<u4") for d in data]

    def _data(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        split = [self._split(t) for t in texts]
        new = set().union(*split).difference(known)
        plain = [p for p in new if p.isascii() and p.isalpha() or LETTERS.fullmatch(p)]
        whole = list(new.difference(plain))
        for encode, items in ((self._pieces, plain), (self._words, whole)):
            for i in range(0, len(items), 2000):
                known.update(zip(items[i : i + 2000], encode(items[i : i + 2000])))
        get = known.__getitem__
        return [b"".join(map(get, ps)) for ps in split]

    def _split(self, text: str) -> list[str]:
        low = text.lower() if text.isascii() else lower_ascii(text).decode()
        if any(s in low for s in self.special):
            return [w.decode() for w in text.encode().split()]  # their case counts
        return PIECE.findall(low)


_loaded: dict[str, PieceTokenizer] = {}


def piece_tokenizer(path: str) -> PieceTokenizer:
    """The worker's tokenizer for a file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]
