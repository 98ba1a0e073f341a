"""BPE encoding by guess and check, and decoding (operator 12).

The tokens of a piece are guessed as the longest match at each step. A sequence of tokens is what
the merges make of a piece exactly if each token is made of its own characters alone and no merge
across the border of two neighbours comes before both are whole. All neighbours of all
new pieces are checked at once with arrays; only pieces with a pair that fails are
merged step by step.

Texts are cut at white space, and between letters, digits and punctuation where that is plain to see; a cut always
has the same ids, so each distinct one is encoded once per worker. ASCII and Latin letters are cut by patterns, all
else by the normalizer and the pre-tokenizer of the tokenizer file itself, whose character tables then apply.
"""

from __future__ import annotations

import bisect
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomlog.llm.common import id_and_text, lower_ascii, release_memory, slices, small_batches
from loomlog.llm.token_ids import LETTERS, PIECE

#: Cuts of texts and pairs of tokens that a worker remembers.
KNOWN_CUTS, KNOWN_PAIRS = 500_000, 2_000_000
#: A rank after all merges.
NEVER = 1 << 30
#: Symbols of a piece above which it is merged on its own, with a heap of the merges that are due.
LONG_PIECE = 100
#: Words that go through the normalizer at once.
NORMALIZED_WORDS = 256

# The pieces of the supported tokenizer, and the same for lower-case ASCII without white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = re.compile(r"\s")
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def stand_ins() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    for b in range(256):
        if chr(b) not in out:
            out[chr(256 + len(out) - len(printable))] = b
    return out


class Merges:
    """The merge rules as arrays over token ids."""

    def __init__(self, vocab: dict[str, int], merges: list, size: int):
        pairs = [p if isinstance(p, list) else p.split(" ") for p in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        if len(np.unique(made)) < len(made):
            raise ValueError("a token is made by two merges")
        self.size = size
        keys = left * size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.rules = dict(zip(keys.tolist(), range(len(keys))))
        self.made = made
        self.parts = np.full((size, 2), -1, dtype=np.int64)
        self.parts[made, 0], self.parts[made, 1] = left, right
        self.made_by = np.full(size, NEVER, dtype=np.int64)
        self.made_by[made] = np.arange(len(made))
        # a token, its outermost part on one side, the outermost part of that, ...
        self.ends_with, self.begins_with = self._outermost(1), self._outermost(0)
        self.pairs, self.fits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.whole = self._whole(made)

    def _outermost(self, side: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """By depth: the part of each token (-1: none) and the rank of the merge that uses it up."""
        at, used, out = np.arange(self.size), np.full(self.size, NEVER, dtype=np.int64), []
        while (at >= 0).any():
            out.append((at, used))
            used = np.where(at >= 0, self.made_by[at], NEVER)
            at = np.where(at >= 0, self.parts[at, side], -1)
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)

    def _crossed(self, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether a merge across the border of ``a`` and ``b``, other than the one of rank ``own`` of both as a whole,
        comes before its two sides are used up; of equal ranks the left one comes first."""
        out = np.zeros(len(a), dtype=bool)
        for i, (last, last_used) in enumerate(self.ends_with):
            rows = np.flatnonzero(last[a] >= 0)
            if not len(rows):
                break
            for j, (first, first_used) in enumerate(self.begins_with):
                rows = rows[first[b[rows]] >= 0]
                if not len(rows):
                    break
                r = self.rank(last[a[rows]], first[b[rows]])
                if i == j == 0:
                    r = np.where(r == own[rows], NEVER, r)
                out[rows] |= (r < np.minimum(last_used[a[rows]], own[rows])) & (r <= np.minimum(first_used[b[rows]], own[rows]))
        return out

    def _whole(self, made: np.ndarray) -> np.ndarray:
        """Whether the merges make each token out of its own characters."""
        out = np.ones(self.size, dtype=bool)
        a, b = self.parts[made].T
        out[made] = ~self._crossed(a, b, self.made_by[made])
        while True:  # a token with a part that is not whole is not whole either
            worse = out[made] & ~(out[a] & out[b])
            if not worse.any():
                return out
            out[made[worse]] = False

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens ``a`` and ``b`` stay as they are next to each other."""
        wanted, place = np.unique(a * self.size + b, return_inverse=True)
        new = np.setdiff1d(wanted, self.pairs, assume_unique=True)
        if len(new):
            if len(self.pairs) > KNOWN_PAIRS:
                self.pairs, self.fits, new = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), wanted
            fits = ~self._crossed(*np.divmod(new, self.size), np.full(len(new), NEVER, dtype=np.int64))
            pairs = np.concatenate([self.pairs, new])
            order = np.argsort(pairs)
            self.pairs, self.fits = pairs[order], np.concatenate([self.fits, fits])[order]
        return self.fits[np.searchsorted(self.pairs, wanted)][place]

    def merge(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of pieces (one after the other, of the given sizes) in the order of their ranks, the leftmost
        first: the tokens, and how many each piece has. Every step makes one merge in each piece that has one left;
        pieces with more than LONG_PIECE symbols are merged one by one."""
        out = [np.zeros(0, dtype=np.int64)] * len(size)
        owner = np.repeat(np.arange(len(size)), size)
        for i in np.flatnonzero(size > LONG_PIECE).tolist():
            out[i] = np.array(self._merge_long(symbols[owner == i].tolist()), dtype=np.int64)
        short = size[owner] <= LONG_PIECE
        symbols, owner = symbols[short], owner[short]
        rank = np.full(len(symbols), NEVER, dtype=np.int64)  # of a symbol and the next
        self._rerank(np.arange(len(symbols)), symbols, owner, rank)
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(owner))))
            over = best == NEVER
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            at = np.flatnonzero(~over & (rank == best))
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])] if len(at) else at
            symbols[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            place = np.cumsum(keep)[at] - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            self._rerank(np.concatenate([place, place[place > 0] - 1]), symbols, owner, rank)
        symbols, owner = np.concatenate([symbols, *done_symbols]), np.concatenate([owner, *done_owner])
        order = np.argsort(owner, kind="stable")
        count = np.bincount(owner, minlength=len(size))
        if short.all():
            return symbols[order], count
        parts = np.split(symbols[order], np.cumsum(count)[:-1])
        parts = [long if len(long) else short for long, short in zip(out, parts)]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def _rerank(self, at: np.ndarray, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> None:
        """Set the rank of the symbols at these places with the next one of the same piece."""
        rank[at] = NEVER
        at = at[at + 1 < len(symbols)]
        at = at[owner[at] == owner[at + 1]]
        rank[at] = self.rank(symbols[at], symbols[at + 1])

    def _merge_long(self, symbols: list[int]) -> list[int]:
        n, out, made = len(symbols), list(symbols), self.made.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rules.get(out[i] * self.size + out[j])) is not None:
                heapq.heappush(due, (r, i, j))

        for i in range(n - 1):
            offer(i)
        while due:
            r, i, j = heapq.heappop(due)
            if out[i] < 0 or after[i] != j or self.rules.get(out[i] * self.size + out[j]) != r:
                continue
            out[i], out[j], after[i] = made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in out if s >= 0]


class SpeculativeBPE:
    """Ids of words and texts, and texts of ids, for one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (
            model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("ignore_merges") or spec["decoder"]
            or steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]
            or cuts[0]["pattern"].get("Regex") != PIECES
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        ):
            raise ValueError("only byte-level BPE with word ends and the pieces of PIECES is supported")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in added}
        self.any_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.byte = stand_ins()
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[str | None] = [None] * size
        for t, i in [*vocab.items(), *((t["content"], t["id"]) for t in added)]:
            self.token[i] = t
        self.merges = Merges(vocab, model["merges"], size)
        self._trie(vocab)
        self.known: dict[str, bytes] = {}
        self.guessed = self.failed = 0  # pieces

    def _trie(self, vocab: dict[str, int]) -> None:
        """Whole tokens by their bytes: a sorted edge list, and the token of each node inside a piece and at its end."""
        edges: dict[int, int] = {}
        inner, final = {}, {}
        self.symbol = np.full((2, 256), -1, dtype=np.int64)  # single bytes inside a piece and at its end
        for t, i in vocab.items():
            last = t.endswith(self.suffix) and t != self.suffix
            data = [self.byte[c] for c in (t[: -len(self.suffix)] if last else t)] if self.merges.whole[i] else []
            node = 0
            for b in data:
                node = edges.setdefault(node * 256 + b, len(edges) + 1)
            if data:
                (final if last else inner)[node] = i
            if len(data) == 1:
                self.symbol[int(last), data[0]] = i
        if (self.symbol < 0).any():
            raise ValueError("a byte is no token")
        self.edge = np.array(sorted(edges), dtype=np.int64)
        self.child = np.array([edges[e] for e in self.edge.tolist()], dtype=np.int64)
        self.inner = np.array([inner.get(n, -1) for n in range(len(edges) + 1)], dtype=np.int64)
        self.final = np.array([final.get(n, -1) for n in range(len(edges) + 1)], dtype=np.int64)

    def _longest(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token from each place on, ``left`` bytes before the end of its piece, and its length."""
        token, length = np.full(len(data), -1, dtype=np.int64), np.zeros(len(data), dtype=np.int64)
        at, node, depth = np.arange(len(data)), np.zeros(len(data), dtype=np.int64), 0
        while len(at):
            key = node * 256 + data[at + depth]
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[edge] == key
            at, node, depth = at[on], self.child[edge[on]], depth + 1
            found = np.where(left[at] == depth, self.final[node], self.inner[node])
            hit = found >= 0
            token[at[hit]], length[at[hit]] = found[hit], depth
            on = left[at] > depth
            at, node = at[on], node[on]
        return token, length

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are not empty, one after the other, and how many each has."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        token, length = self._longest(data, np.repeat(ends, size) - np.arange(len(data)))
        step, path, at = (np.arange(len(data)) + length).tolist(), [], 0
        while at < len(step):  # the end of a piece is the start of the next
            path.append(at)
            at = step[at]
        path = np.array(path, dtype=np.int64)
        ids = token[path]
        owner = np.searchsorted(ends, path, side="right")
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        fits = self.merges.compatible(ids[inside], ids[inside + 1])
        failing = np.unique(owner[inside[~fits]])
        self.guessed, self.failed = self.guessed + len(pieces), self.failed + len(failing)
        count = np.bincount(owner, minlength=len(pieces))
        if not len(failing):
            return ids, count
        symbol = self.symbol[0][data]
        symbol[ends - 1] = self.symbol[1][data[ends - 1]]
        keep = np.ones(len(pieces), dtype=bool)
        keep[failing] = False
        merged, count[failing] = self.merges.merge(symbol[~np.repeat(keep, size)], size[failing])
        out = np.empty(count.sum(), dtype=np.int64)
        kept = np.repeat(keep, count)
        out[kept], out[~kept] = ids[keep[owner]], merged
        return out, count

    def _library_pieces(self, words: list[str]) -> Iterator[list[bytes]]:
        """Pieces of words, cut by the parts of the tokenizer file; many words at once as long as none has white space in it."""
        for at in range(0, len(words), NORMALIZED_WORDS):
            part = words[at : at + NORMALIZED_WORDS]
            text = " ".join(part)
            if len(part) > 1 and len(WHITE.findall(text)) != len(part) - 1:
                for word in part:
                    yield from self._library_pieces([word])
                continue
            text = self.normalizer.normalize_str(text)
            if len(part) == 1:
                yield [self._bytes(p) for p, _ in self.pre_tokenizer.pre_tokenize_str(text)]
                continue
            blanks = [i for i, c in enumerate(text) if c == " "]
            own: list[list[bytes]] = [[] for _ in part]
            for p, (start, _) in self.pre_tokenizer.pre_tokenize_str(text):
                own[bisect.bisect(blanks, start)].append(self._bytes(p))
            yield from own

    def _bytes(self, piece: str) -> bytes:
        return bytes(map(self.byte.__getitem__, piece))

    def _learn(self, cuts: list[str]) -> None:
        """Remember the ids of cuts; one that begins with a blank is a word with a special token and keeps its case."""
        plain = [c for c in cuts if c.isascii() or LETTERS.fullmatch(c)]
        foreign = [c for c in cuts if not c.startswith(" ") and not (c.isascii() or LETTERS.fullmatch(c))]
        plain = [c for c in plain if not c.startswith(" ")]
        data = [c.lower().encode() for c in plain]
        pieces_of = [ASCII_PIECES.findall(d) if d.isascii() and not d.isalpha() else [d] for d in data]
        pieces_of += self._library_pieces(foreign)
        new = list(set().union(*pieces_of))
        ids, count = self.encode_pieces(new) if new else (np.zeros(0, dtype=np.int64),) * 2
        data, ends = ids.astype("<i4").tobytes(), (np.cumsum([0, *count]) * 4).tolist()
        made = dict(zip(new, [data[a:b] for a, b in zip(ends, ends[1:])]))
        self.known.update(zip(plain + foreign, [b"".join(map(made.__getitem__, own)) for own in pieces_of]))
        for word in (c for c in cuts if c.startswith(" ")):
            parts = [p for p in self.any_special.split(word[1:]) if p]
            self._learn([lower_ascii(p).decode() for p in parts if p not in self.special])
            self.known[word] = b"".join(
                np.array([self.special[p]], dtype="<i4").tobytes() if p in self.special else self.known[lower_ascii(p).decode()]
                for p in parts
            )

    def _cut(self, text: str) -> list[str]:
        low = text.lower() if text.isascii() else lower_ascii(text).decode()
        if not self.any_special.search(low):
            return PIECE.findall(low)
        words = [w.decode() for w in text.encode().split()]
        return [" " + w if self.any_special.search(w) else lower_ascii(w).decode() for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > KNOWN_CUTS:
            self.known.clear()
        cuts = [self._cut(t) for t in texts]
        if new := set().union(*cuts).difference(self.known):
            self._learn(list(new))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), dtype="<i4") for c in cuts]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ids, joined by one blank; ids without a token are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.token))]
        return " ".join([t for t in map(self.token.__getitem__, ids.tolist()) if t is not None])


_loaded: dict[str, SpeculativeBPE] = {}


def speculative_bpe(path: str) -> SpeculativeBPE:
    """The worker's encoder for a file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = SpeculativeBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the array ``ids`` of every whole text, without a shuffle.

    ``tokenizer`` is the path of a tokenizers JSON file that exists on every machine. A null or empty text has no ids; null
    doc_ids and repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = speculative_bpe(tokenizer)
        for batch in batches:
            for rows, texts in slices(batch):
                ids = encoder.encode(texts)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], ["doc_id", "ids"])
        release_memory()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(df: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of the array column ``ids`` as ``into``, which replaces a column of that name.

    Tokens are joined by one blank, as the library does for a file without a decoder; special tokens stay. Null ids
    give a null text, null elements and ids outside the vocabulary are left out.
    """
    rest = [c for c in df.columns if c.lower() != into.lower()]
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = speculative_bpe(tokenizer)
        for batch in batches:
            column = batch.column(rest.index(ids))
            texts = [
                decoder.decode(column[i].values.drop_null().to_numpy(zero_copy_only=False)) if column[i].is_valid else None
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, into])

    schema = T.StructType([*df.select(rest).schema.fields, T.StructField(into, T.StringType())])
    return df.select(rest).mapInArrow(run, schema)
