"""Plain Python versions that the operators are held against."""

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def secret_matches(text):
    text = text or ""
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return out


def listed(spans, kinds):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2])))


def entropy(window):
    n = len(window)
    return -sum(c / n * math.log2(c / n) for c in Counter(window).values())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """{position: set of positions} by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def quality_counts(text):
    text = text or ""
    ws = words(text)
    wins = Counter(zip(ws, ws[1:], ws[2:]))
    hit = set()
    for i in range(len(ws) - 2):
        if wins[tuple(ws[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    n = len(ws)
    return (n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dups, len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def water_fill(sizes, weights, total, most=2):
    """Targets by refilling until no source is above its cap."""
    caps = [most * s for s in sizes]
    out, open_ = [None] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > caps[i]]
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = float(caps[i])
            left -= caps[i]
            open_.discard(i)
    return out
