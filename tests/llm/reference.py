"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(rows):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id)] in order."""
    sets = []
    for _, text in rows:
        w = SPACED.findall(lowered(text))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders: dict = {}
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders.get(x, ()))
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for x in s:
            holders.setdefault(x, []).append(i)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def contamination(rows, items):
    windows: dict = {}
    for item, text in items:
        w = ALNUM.findall(lowered(text))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in rows:
        w = ALNUM.findall(lowered(text))
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[k]
        found = sorted({str(x) for x in found if x is not None})
        listed = hashlib.sha256(",".join(found).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), listed, bool(hit)))
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """{source: words} -> {source: target}: shares by weight, capped sources' excess reshared."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict = {}
    while len(out) < len(names):
        rest = sum(sizes.values()) - sum(out.values())
        free = [s for s in names if s not in out]
        total = sum(w[s] for s in free)
        full = [s for s in free if rest * w[s] > most * sizes[s] * total]
        out |= {s: most * sizes[s] for s in full} if full else {s: rest * w[s] / total for s in free}
    return out
