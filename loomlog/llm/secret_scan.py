"""Secret scans by sliding-window entropy per character class (operator 4).

Fixed patterns name assignments, access keys and long hexadecimal runs. Besides, every
long run of token characters is a candidate: windows slide over it, the Shannon entropy of
each is kept up to date from the counts of the character that enters and the one that leaves, and windows
above the limit of their character class are joined to spans. A name or path glued to a secret does not
raise its limit: that of the window's own class and of the run of letters and digits around it hold as well. An
allow-list drops what looks random but is known to be harmless.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from loomlog.llm.common import id_and_text, slices

# The base patterns; letters of the first may be in either case
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")
_WORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters of a window.
WINDOW = 20
#: What a name, path or sign glued to it leaves of a candidate.
RUN = re.compile(rf"[A-Za-z0-9]{{{WINDOW},}}")
#: Bits a character above which a window of a class is suspicious; classes from narrow to wide.
LIMITS = (
    ("digit", re.compile(r"[0-9]+"), 3.0),
    ("hex", re.compile(r"[0-9A-Fa-f]+"), 3.1),
    ("letter", re.compile(r"[A-Za-z]+"), 4.0),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9),
)
#: Candidates that are no secrets: words in one case, joined words, paths of words,
#: UUIDs (they name things). A run in them that is above its own limit is reported all the same.
ALLOWED = (
    re.compile(r"[A-Z]?[a-z]+|[A-Z]+"),
    re.compile(r"[A-Za-z]+([_/=-]+[A-Za-z]*)+"),
    re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
)


def character_class(s: str) -> tuple[str, float]:
    """The narrowest class that holds all characters, and its limit."""
    for name, pattern, limit in LIMITS:
        if pattern.fullmatch(s):
            return name, limit
    return LIMITS[-1][0], LIMITS[-1][2]


# What the characters of a window are, one bit each: the class of a window follows from the kinds that it holds
_KINDS_OF = {c: 1 if c.isdigit() else 2 if c in "ABCDEFabcdef" else 4 if c.isalpha() else 8 for c in map(chr, range(128))}
_LIMIT_OF_KINDS = [
    character_class("".join(c for bit, c in ((1, "0"), (2, "a"), (4, "z"), (8, "=")) if kinds & bit))[1] for kinds in range(16)
]


def hot_windows(s: str, limit: float, window: int = WINDOW, narrow: bool = False) -> Iterator[tuple[int, int]]:
    """Joined spans of all windows whose entropy is at least ``limit`` bits a character, or with ``narrow``
    at least the limit of the window's own class where that is lower.

    With counts c of a window of w characters the entropy is log2(w) - sum(c log2 c) / w, so a step changes two
    terms of the sum.
    """
    if len(s) < window:
        return
    part = [c * log2(c) if c else 0.0 for c in range(window + 2)]
    most = [(log2(window) - (min(limit, own) if narrow else limit)) * window + 1e-9 for own in _LIMIT_OF_KINDS]
    counts: dict[str, int] = {}
    last = {1: -1, 2: -1, 4: -1, 8: -1}  # where each kind was seen last
    total, start, end = 0.0, -1, -1
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += part[n + 1] - part[n]
        counts[c] = n + 1
        last[_KINDS_OF[c]] = i
        if i >= window:
            old = s[i - window]
            n = counts[old]
            total += part[n - 1] - part[n]
            counts[old] = n - 1
        if i >= window - 1:
            first = i - window + 1
            if total > most[sum(kind for kind, at in last.items() if at >= first)]:
                continue
            if first > end:
                if start >= 0:
                    yield start, end
                start = first
            end = i + 1
    if start >= 0:
        yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, each kind leftmost and without overlaps."""
    found = []
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def entropy_spans(text: str, allowed: Sequence[re.Pattern] = ALLOWED) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        limit, hot = character_class(s)[1], []
        harmless = any(p.fullmatch(s) for p in allowed)
        if not harmless:
            hot += hot_windows(s, limit, narrow=True)
        for r in RUN.finditer(s):
            own = character_class(r.group())[1]
            if harmless or own < limit:
                hot += [(r.start() + a, r.start() + b) for a, b in hot_windows(r.group(), own, narrow=True)]
        found += [(m.start() + a, 3, m.start() + b) for a, b in _union(hot)]
    return found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id``, the spans of the fixed patterns (``base``) and of all kinds
    (``spans``) as ``kind:start:end`` joined by commas, in code points with the end
    exclusive, by start and then kind; and the number of each kind. A null text is empty and has
    none; null ids and repeated rows stay. Nothing is shuffled."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                counts: list[list[int]] = [[] for _ in KINDS]
                base, every = [], []
                for text in texts:
                    fixed = base_spans(text)
                    spans = fixed + entropy_spans(text)
                    for k, column in enumerate(counts):
                        column.append(sum(s[1] == k for s in spans))
                    base.append(_joined(fixed))
                    every.append(_joined(spans))
                columns = [rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array(every)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
