"""Token counts from a tokenizer compiled into a deterministic transducer (operator 9).

A byte-level BPE vocabulary is run as a finite-state machine over the bytes of the
pieces of a text. Whether a token may follow another is a property of the two alone
(no merge that crosses their border comes first), so the last token and the number of
tokens of every prefix follow from those of shorter prefixes. A state holds, for each
start that a longer token could still have, its place in the vocabulary's trie, the
token before it and its count relative to the current one. States and transitions
are compiled when they are first met; each transition carries the number of tokens it
adds (negative when a longer token replaces several), and the end of a piece leads back to the start.

Texts are cut into equal chunks that advance together, one symbol at a time. A chunk's
state map is "always q" once an end of a piece lies in it, else the chunk itself; maps
compose from left to right in a scan that gives every chunk its entry state, with
which the symbols before its first end are run.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlog.llm.common import SLICE_CHARS, at_spaces, id_and_text, slices

#: Chunks that advance together, and the shortest length of a chunk.
LANES, SHORTEST = 4096, 64
#: Compiled states above which a worker starts anew with an empty table.
MAX_STATES = 200_000
START, UNKNOWN = 0, 1
END = 0

# The piece pattern of the supported tokenizer and the endings it splits off.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are
    themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as a trie, and which of them may follow which."""

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if (
            model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("ignore_merges")
            or steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]
            or cuts[0]["pattern"].get("Regex") != PIECES
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError("only byte-level BPE with word ends and the pieces of PIECES can be compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix, vocab, char = model["end_of_word_suffix"], model["vocab"], _byte_of_char()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            if made in self.parts:
                raise ValueError("a token is made by two merges")
            self.rank[vocab[a], vocab[b]] = r
            self.parts[made] = (vocab[a], vocab[b], r)
        self.kids: list[dict[int, int]] = [{}]
        self.inner, self.final = [-1], [-1]  # the token that ends here inside a piece, at its end
        for token, i in vocab.items():
            last = token.endswith(suffix) and token != suffix
            node = 0
            for c in token[: -len(suffix)] if last else token:
                if (child := self.kids[node].get(char[c])) is None:
                    child = self.kids[node][char[c]] = len(self.kids)
                    self.kids.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                node = child
            (self.final if last else self.inner)[node] = i
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}

    def _spine(self, token: int, side: int, known: dict) -> list[tuple[int, float]]:
        """The token and its outermost parts on one side, each with the rank of the merge that consumes it."""
        if (out := known.get(token)) is None:
            out, at, used = [], token, float("inf")
            while True:
                out.append((at, used))
                if at not in self.parts:
                    break
                used = self.parts[at][2]
                at = self.parts[at][side]
            known[token] = out
        return out

    def follows(self, a: int, b: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` is due before both are whole."""
        if (out := self._follows.get((a, b))) is None:
            if len(self._follows) > 2_000_000:
                self._follows.clear()
            out = True
            for x, used_x in self._spine(a, 1, self._right):
                for y, used_y in self._spine(b, 0, self._left):
                    r = self.rank.get((x, y))
                    if r is not None and r < used_x and r <= used_y:
                        out = False
            self._follows[a, b] = out
        return out

    def whole(self, token: int) -> bool:
        """Whether the merges make this token out of its own characters."""
        if (out := self._whole.get(token)) is None:
            out = token not in self.parts or (
                self.whole(self.parts[token][0]) and self.whole(self.parts[token][1]) and self._merges(token)
            )
            self._whole[token] = out
        return out

    def _merges(self, token: int) -> bool:
        """As ``follows``, for the two parts of a token: nothing else crosses their border first."""
        a, b, rank = self.parts[token]
        for x, used_x in self._spine(a, 1, self._right):
            for y, used_y in self._spine(b, 0, self._left):
                r = self.rank.get((x, y))
                if r is not None and r < used_x and r <= used_y and (x, y) != (a, b):
                    return False
        return True


class Transducer:
    """The compiled table; column 0 is the end of a piece, the others bytes as they are met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.vocab = Vocabulary(json.load(f))
        self.column = np.zeros(256, dtype=np.uint8)
        self.byte = [-1]  # of each column
        self._clear()
        self.lower, self.kind = _character_tables()
        _newer_characters(path, self.lower, self.kind)

    def _clear(self) -> None:
        self.width = max(64, -(-len(self.byte) // 16) * 16)
        self.next = np.full((8192, self.width), -1, dtype=np.int32)
        self.adds = np.zeros((8192, self.width), dtype=np.int8)
        self.entries: list[tuple] = [((0, -1, 0),), ()]
        self.number = {self.entries[0]: START}
        self.next[UNKNOWN], self.next[UNKNOWN, END], self.next[START, END] = UNKNOWN, START, START

    def _columns(self, used: np.ndarray) -> None:
        """Give each byte that occurs a column."""
        for b in np.flatnonzero(used):
            if not self.column[b]:
                self.column[b] = len(self.byte)
                self.byte.append(int(b))
        if len(self.byte) > self.width:
            self._clear()

    def _state(self, entries: tuple) -> int:
        if (s := self.number.get(entries)) is None:
            s = self.number[entries] = len(self.entries)
            self.entries.append(entries)
            if s >= len(self.next):
                more = (len(self.next) // 2, self.width)
                self.next = np.concatenate([self.next, np.full(more, -1, dtype=np.int32)])
                self.adds = np.concatenate([self.adds, np.zeros(more, dtype=np.int8)])
        return s

    def _compile(self, state: int, column: int) -> None:
        v, entries = self.vocab, self.entries[state]
        if column == END:
            ends = [
                c + 1 for node, before, c in entries
                if (t := v.final[node]) >= 0 and v.whole(t) and (before < 0 or v.follows(before, t))
            ]
            self.next[state, END], self.adds[state, END] = START, ends[0]
            return
        b, ongoing, last, gain = self.byte[column], [], -1, 0
        for node, before, c in entries:
            if (child := v.kids[node].get(b)) is None:
                continue
            if v.kids[child] or v.final[child] >= 0:
                ongoing.append((child, before, c))
            if (t := v.inner[child]) >= 0 and v.whole(t) and (before < 0 or v.follows(before, t)):
                last, gain = t, c + 1
        new = (*((node, before, c - gain) for node, before, c in ongoing), (0, last, 0))
        s = self._state(new)
        self.next[state, column], self.adds[state, column] = s, gain

    def _advance(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = state * self.width + symbol
        new = self.next.ravel().take(at)
        if new.min() < 0:
            for i in np.unique(at[new < 0]):
                self._compile(int(i) // self.width, int(i) % self.width)
            new = self.next.ravel().take(at)
        return new, self.adds.ravel().take(at)

    def _run(self, symbols: np.ndarray) -> np.ndarray:
        """What each symbol of a stream that ends with END adds to the count."""
        n = len(symbols)
        lanes = max(1, min(LANES, n // SHORTEST))
        length = -(-n // lanes)
        x = np.zeros(lanes * length, dtype=np.uint8)
        x[:n] = symbols
        x = x.reshape(lanes, length)
        by_step = np.ascontiguousarray(x.T)
        added = np.empty((length, lanes), dtype=np.int8)
        state = np.full(lanes, UNKNOWN, dtype=np.int64)
        state[0] = START
        for t in range(length):
            state, added[t] = self._advance(state, by_step[t])
        # the scan: a chunk with an END leaves in a known state, any other as its predecessor's state leads it
        leaves = np.asarray(state)
        first = np.where((x == END).any(1), (x == END).argmax(1) + 1, length)
        todo = np.arange(1, lanes)
        while len(todo):
            entry = leaves[todo - 1]
            now = entry != UNKNOWN
            lane, state = todo[now], entry[now].astype(np.int64)
            order = np.argsort(-first[lane], kind="stable")
            lane, state, left = lane[order], state[order], first[lane[order]]
            for t in range(int(left[0])):
                active = int(np.searchsorted(-left, -t, side="left"))
                state[:active], added[t, lane[:active]] = self._advance(state[:active], by_step[t, lane[:active]])
            through = leaves[lane] == UNKNOWN
            leaves[lane[through]] = state[through]
            todo = todo[~now]
        return added.T.reshape(-1)[:n]

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The stream of all texts, and where each text's last END is."""
        texts = [t if t.isascii() else unicodedata.normalize("NFC", t).replace("İ", "i̇") for t in texts]
        s = "\n".join(texts) + "\n"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        code = self.lower[np.frombuffer(s.encode("utf-32-le"), dtype="<u4")]
        kind = self.kind[code]
        code[kind == 0] = 32
        border = np.zeros(len(code), dtype=bool)
        border[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        quote = np.flatnonzero(code[:-1] == 39)
        quote = quote[(quote == 0) | (kind[quote - 1] != 3)]
        if len(quote):
            padded = np.concatenate([code, np.zeros(2, dtype=code.dtype)])
            for ending in ENDINGS:
                hit = quote.copy()
                for k, c in enumerate(ending, 1):
                    hit = hit[padded[hit + k] == ord(c)]
                border[hit + 1] = False
                after = hit + 1 + len(ending)
                border[after[after < len(border)]] = True
        border[1:] &= (kind[1:] != 0) & (kind[:-1] != 0)
        border[0] = False
        if s.isascii():
            data, starts = code.astype(np.uint8), None
        else:
            starts = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
            data = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
            ends = starts[ends]
        cut = np.flatnonzero(border) if starts is None else starts[:-1][border]
        used = np.bincount(data, minlength=256)
        used[32] = 0
        self._columns(used)
        columns = self.column[data]  # the blank has none: it is an END
        moved = np.zeros(len(data), dtype=np.int32)
        moved[cut] = 1
        moved = np.cumsum(moved, dtype=np.int64)
        stream = np.zeros(len(data) + len(cut), dtype=np.uint8)
        stream[np.arange(len(data)) + moved] = columns
        return stream, ends + moved[ends]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        parts, owner, special = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if "<" in text:
                for token in self.vocab.special:
                    special[i] += text.count(token)
                    text = text.replace(token, " ")
            for part in at_spaces(text):
                parts.append(part)
                owner.append(i)
        totals, at = np.zeros(len(parts), dtype=np.int64), 0
        while at < len(parts):
            end, held = at + 1, len(parts[at])
            while end < len(parts) and held + len(parts[end]) <= SLICE_CHARS:
                held += len(parts[end])
                end += 1
            stream, ends = self._symbols(parts[at:end])
            starts = np.concatenate([[0], ends[:-1] + 1])
            totals[at:end] = np.add.reduceat(self._run(stream), starts, dtype=np.int64)
            if len(self.entries) > MAX_STATES:
                self._clear()
            at = end
        np.add.at(special, np.array(owner, dtype=np.int64), totals)
        return special


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and kind (0 space, 1 letter, 2 number, 3 other) of every code point."""
    n = 0x110000
    lower, kind = np.arange(n, dtype=np.uint32), np.full(n, 3, dtype=np.uint8)
    for c in range(n):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        group = unicodedata.category(ch)[0]
        if group == "L":
            kind[c] = 1
        elif group == "N":
            kind[c] = 2
        low = ch.lower()
        if low != ch and len(low) == 1:
            lower[c] = ord(low)
    # The white space of Unicode
    for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        kind[c] = 0
    return lower, kind


def _newer_characters(path: str, lower: np.ndarray, kind: np.ndarray) -> None:
    """Lower case and kind of the code points that Python's tables do not know, as the tokenizer's own library
    has them; its tables may be newer. Planes without any character in them are left out."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    new = [chr(c) for c in [*range(0x40000), *range(0xE0000, 0xF0000)] if unicodedata.category(chr(c)) == "Cn"]
    for c, low in zip(new, library.normalizer.normalize_str("a" + "a".join(new) + "a").split("a")[1:-1]):
        if len(low) == 1:
            lower[ord(c)] = ord(low)
    # a letter joins its neighbour letters, any other character but a number or a space its neighbour marks
    joined = []
    for mark in "a!":
        pieces = library.pre_tokenizer.pre_tokenize_str(" ".join(mark + c + mark for c in new))
        joined.append({start // 4 for _, (start, end) in pieces if end - start == 3})
        spaced = {start // 4 for _, (start, end) in pieces if start % 4 == 1}
    for i, c in enumerate(new):
        if kind[ord(c)]:
            kind[ord(c)] = 1 if i in joined[0] else 3 if i in joined[1] else 2 if i in spaced else 0


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The worker's transducer for a tokenizer file."""
    if path not in _compiled:
        _compiled.clear()
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is the path of a tokenizers JSON file, found under that path on every
    machine. One row per input row, in no order and without a shuffle. A null text counts as empty (0 tokens);
    null ids and repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for batch in batches:
            for rows, texts in slices(batch):
                n = machine.counts(texts)
                size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
