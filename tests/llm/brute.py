"""Plain versions of the operators' results, row by row."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bytespans(rows, length):
    texts = [(i, (x or "").encode()) for i, x in rows]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def wordspans(rows, window):
    texts = [(i, WORD.findall(x or "")) for i, x in rows]
    order = lambda i: -(1 << 70) if i is None else i
    least = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < order(i):
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept.encode())))
    return sorted(out, key=repr)


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits=4):
    """Least index that each fingerprint reaches."""
    fp = np.array(prints, np.uint64)
    label = np.arange(len(fp))
    changed = True
    while changed:
        changed = False
        for i in range(len(fp)):
            least = label[np.bitwise_count(fp ^ fp[i]) <= bits].min()
            if least < label[i]:
                label[i], changed = least, True
    return label


def contained(text, item, least=0.8):
    """Shared and all shingles of an item that a text holds, else None."""
    words = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")
    a, b = (words.findall((x or "").translate(LOWER)) for x in (item, text))
    k = min(5, len(a))
    if not k:
        return None
    q, d = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return (len(q & d), len(q)) if len(q & d) >= least * len(q) else None


def base_spans(text):
    def card(s):
        d = [int(c) for c in s if c.isdigit()]
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", card),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= sum(c.isdigit() for c in s) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, good in kinds for m in re.finditer(p, text or "") if good(m.group())]
