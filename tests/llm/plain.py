"""The rules of the operators in plain Python, as slow and as simple as can be."""

import hashlib
import re
import zlib

WS = "[\x20\x09-\x0d]"


def shingle_set(text, width=5):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(docs, link):
    """component by doc_id, all pairs compared."""
    sets = {d: shingle_set(t) for d, t in docs}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= link * len(x | y):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def dedup_lines(docs, shortest=10):
    key = lambda ln: re.sub("[A-Z]", lambda m: m.group().lower(), ln.strip(" \t\n\r\x0b\x0c"))
    first, holders = {}, {}
    for d, t in docs:
        for ln in (t or "").split("\n"):
            if len(key(ln)) >= shortest:
                holders.setdefault(key(ln), set()).add(d)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [ln for ln in lines if first.get(key(ln), d) >= d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def base_spans(text):
    text = text or ""
    found = []
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    api = "[aA][pP][iI]_?[kK][eE][yY]"
    pattern = f"({names}|{api})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def lz_phrases(text):
    seen, i = [], 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in seen:
            n += 1
        if i + n > len(text):
            break
        seen.append(text[i : i + n])
        i += n
    return set(seen)


def water_fill(budget, children):
    """Share of each (weight, capacity): shortages go to siblings by weight, step by step."""
    own = [0] * len(children)
    open_ = {i for i, (w, _) in enumerate(children) if w}
    while open_:
        rest = budget - sum(own[i] for i in range(len(children)) if i not in open_)
        total = sum(children[i][0] for i in open_)
        full = {i for i in open_ if children[i][1] * total <= rest * children[i][0]}
        if not full:
            for i in open_:
                own[i] = rest * children[i][0] // total
            break
        for i in full:
            own[i] = children[i][1]
        open_ -= full
    return own
