"""Plain Python statements of the rules, used to check the Spark results."""

from collections import Counter


def _nonsense(w):
    n = len(w.encode())
    if n > 20 or n < 3:
        return True
    if sum(c in "0123456789" for c in w) > n // 2:
        return True
    if n > 8 and all(c in "0123456789abcdefABCDEF" for c in w):
        return True
    if sum(c.isascii() and c.isalpha() for c in w) < -(-n // 2):
        return True
    return n >= 12 and len(set(w)) * 20 > n * 17


def normalize(line, word_filter=True):
    words, run = [], ""
    for c in line + "\0":
        if c.isalpha():
            run += c.lower() if c.isascii() else c
        else:
            if len(run.encode()) >= 3 and not (word_filter and _nonsense(run)):
                words.append(run)
            run = ""
    return " ".join(words)


def bigrams(t):
    if len(t.encode()) < 2:
        return [t]
    return [t[i : i + 2] for i in range(len(t) - 1)]


def dice_bigrams(a, b):
    x, y = bigrams(a), bigrams(b)
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    return 2.0 * len(set(x) & set(y)) / (len(x) + len(y))


def dice_chars(a, b):
    if not a and not b:
        return 1.0
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def similarity(a, b, t):
    """As the definition reads, without the character check, which never decides."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    n, m = sorted((len(a.encode()), len(b.encode())))
    return 0.0 if n / m < t / (2.0 - t) else dice_bigrams(a, b)


def pair_score(metric, t):
    return (lambda a, b: similarity(a, b, t)) if metric == "dice_bigrams" else dice_chars


def leaders(ranked, t, metric="dice_bigrams", mode="first"):
    """Leader text of every text of ``ranked``, which is in rank order."""
    score, heads, out = pair_score(metric, t), [], {}
    for text in ranked:
        found = [(score(text, h), h) for h in heads]
        hits = [(s, h) for s, h in found if s >= t]
        if not hits:
            heads.append(text)
            out[text] = text
        elif mode == "first":
            out[text] = hits[0][1]
        else:
            out[text] = max(hits, key=lambda x: x[0])[1]
    return out
