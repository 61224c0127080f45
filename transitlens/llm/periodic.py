"""Runs (periodic stretches) of words, by a suffix automaton with link-cut access.

The words of a stretch are appended one by one to a suffix automaton. Its suffix links form a
tree whose root paths are kept, by colour, as splay trees: a colour is the place where the
substrings of a path last ended. Appending word i accesses the path from the new state to the
root and recolours it to i. Each piece of the path that had one colour e is met once: its
longest substring, of L words, ends at e and at i, and no substring of L words ends in between.
Where the distance d = i - e is at most L, the last L + d words have smallest period d: a square,
which later words extend to a run. Recolouring joins pieces, so the number of pieces met is
logarithmic a word on average.

A filter comes first, since most words can't lie in a run: all short shingles of a run come up
again at the distance of its period, which is a fourth of its length at most. Stretches of
shingles that come up again that near (by hashes, so never too few) go through the automaton,
and they hold every run whole. Memory is about 100 bytes for each word of the longest stretch.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from transitlens.llm import kernels as K
from transitlens.llm.tables import reach

LEAST_WORDS = 6
LEAST_PERIODS = 4
_ROUNDS = 8  # of the filter; fewer rounds only leave more stretches in
_FAR = np.int64(1) << np.int64(60)

RUNS = "array<struct<start:long,length:long,period:long>>"


class Forest:
    """The root paths of a growing tree as splay trees, one colour each: the nodes of one tree
    were last accessed by the same word. Shallow nodes are on the left. Node 0 is none."""

    def __init__(self) -> None:
        self.left, self.right, self.up, self.colour = (array("i", [0]) for _ in range(4))

    def add(self, parent: int) -> int:
        """A new leaf below ``parent``, a path of its own."""
        self.left.append(0)
        self.right.append(0)
        self.up.append(parent)
        self.colour.append(-1)
        return len(self.up) - 1

    def splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if z and left[z] == y:
            left[z] = x
        elif z and right[z] == y:
            right[z] = x
        else:  # y was the top of its tree, which holds the colour
            self.colour[x] = self.colour[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y], up[x] = x, z

    def insert_above(self, node: int) -> int:
        """A new node between ``node`` and its parent, on the path of ``node``."""
        self.splay(node)
        new = self.add(node)
        above = self.left[node]
        self.left[new], self.left[node] = above, new
        if above:
            self.up[above] = new
        return new

    def access(self, leaf: int, colour: int) -> list[tuple[int, int]]:
        """Recolours the path from ``leaf``, new and alone, to the root; (old colour, deepest
        node) of each piece met, deepest piece first."""
        left, right, up, colours = self.left, self.right, self.up, self.colour
        met = []
        below, u = leaf, up[leaf]
        while u:
            y = up[u]
            if y and (left[y] == u or right[y] == u):
                self.splay(u)
            old = colours[u]
            met.append((old, u))
            if right[u]:  # deeper nodes of the path keep their colour
                colours[right[u]] = old
            right[u] = below
            below, u = u, up[u]
        colours[below] = colour
        self.splay(leaf)
        return met


def runs(words: list, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words`` (any hashable values), by start, then
    period: a stretch with this smallest period, of at least ``least_words`` words and
    ``least_periods`` (2 or more) periods, that no neighbour extends."""
    number: dict = {}
    forest = Forest()
    size, link, word, to = (array("i", [0]) for _ in range(4))  # word and to: a state's first edge
    more: dict[int, dict[int, int]] = {}  # its other edges
    link.append(0), size.append(0), word.append(-1), to.append(0)
    last = forest.add(0)  # the root
    ends: dict[tuple[int, int], int] = {}
    times = least_periods - 1
    for i, value in enumerate(words):
        w = number.setdefault(value, len(number))
        p = last
        n = size[last] + 1
        size.append(n), link.append(0), word.append(-1), to.append(0)
        new = len(size) - 1
        q = 0
        while p:
            if word[p] == w:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = w, new
            else:
                edges = more.get(p)
                if edges is None:
                    more[p] = {w: new}
                elif w in edges:
                    q = edges[w]
                    break
                else:
                    edges[w] = new
            p = link[p]
        if not q:
            link[new] = 1
        elif size[q] == size[p] + 1:
            link[new] = q
        # the leaf takes its place in the forest before a split may need the next number
        forest.add(0)
        if q and size[q] != size[p] + 1:
            split = forest.insert_above(q)
            size.append(size[p] + 1), link.append(link[q]), word.append(word[q]), to.append(to[q])
            if q in more:
                more[split] = dict(more[q])
            link[q] = link[new] = split
            while p:
                if word[p] == w:
                    if to[p] != q:
                        break
                    to[p] = split
                else:
                    edges = more.get(p)
                    if edges is None or edges.get(w) != q:
                        break
                    edges[w] = split
                p = link[p]
        forest.up[new] = link[new]
        for e, u in forest.access(new, i):
            d, n = i - e, size[u]
            if n >= times * d and n and n + d >= least_words:
                ends[i - n - d + 1, d] = i
        last = new
    return sorted((start, end - start + 1, d) for (start, d), end in ends.items())


def stretches(
    h: np.ndarray, text: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind last) word of the stretches that may hold runs; ``h`` and ``text`` as
    :func:`kernels.words` gives them. Every run lies in one stretch as a whole."""
    # a run of length l and period p holds each of its shingles twice if l - p >= width
    width = max(1, min(3, max(least_words, least_periods) - 1, max(least_words, 2 * least_periods) - 2))
    s, at = K.shingles(h, text, width)
    none = np.zeros(0, np.int64)
    if len(at) < 2:
        return none, none
    bits = np.uint64(int(len(at)).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = K.mix(s ^ K.mix(text[at].astype(np.uint64) + np.uint64(1)))
    key = (key & ~mask) | np.arange(len(at), dtype=np.uint64)
    key.sort()
    same = (key[1:] ^ key[:-1]) >> bits == 0
    key &= mask
    a, b = key[:-1][same].astype(np.int64), key[1:][same].astype(np.int64)
    gap = np.full(len(at), _FAR)
    gap[b] = at[b] - at[a]
    gap[a] = np.minimum(gap[a], at[b] - at[a])
    live = np.flatnonzero(gap < _FAR)
    for _ in range(_ROUNDS):
        if not len(live):
            return none, none
        first = np.flatnonzero(np.r_[True, np.diff(at[live]) != 1])
        count = np.diff(np.r_[first, len(live)])
        words = np.repeat(count + width - 1, count)
        near = (gap[live] * least_periods <= words) & (words >= least_words)
        if near.all():
            break
        live = live[near]
    if not len(live):
        return none, none
    first = np.flatnonzero(np.r_[True, np.diff(at[live]) != 1])
    count = np.diff(np.r_[first, len(live)])
    lo = at[live[first]]
    wide = count + width - 1 >= least_words
    return lo[wide], (lo + count + width - 1)[wide]


def _search(least_words: int, least_periods: int):
    def run(batches):
        for piece in K.slices(batches):
            data, offsets = K.buffers(piece.column("text"))
            h, text, begin, end = K.words(data, offsets)
            raw = data.tobytes()
            first, _ = K.first_words(text, piece.num_rows)
            found: dict[int, list] = {}
            for lo, hi in zip(*(x.tolist() for x in stretches(h, text, least_words, least_periods))):
                words = [raw[a:b] for a, b in zip(begin[lo:hi].tolist(), end[lo:hi].tolist())]
                t = int(text[lo])
                shift = lo - int(first[t])
                found.setdefault(t, []).extend((s + shift, n, p) for s, n, p in runs(words, least_words, least_periods))
            edge = offsets.tolist()
            spans, kept = [], []
            for t in range(piece.num_rows):
                words = raw[edge[t] : edge[t + 1]].split()
                some = sorted(found.get(t, ()))
                if some:
                    keep = np.ones(len(words), dtype=bool)
                    for s, n, p in some:
                        keep[s + p : s + n] = False
                    words = [words[j] for j in np.flatnonzero(keep).tolist()]
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in some])
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(spans, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "runs", "collapsed"],
            )

    return run


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, runs, collapsed of every row of ``docs`` (doc_id, text).

    Words are what ASCII white space separates, numbered from 0; letters count as they are.
    ``runs``: start, length, period of every run (see :func:`runs`), by start, then period.
    ``collapsed``: the words joined by one space, without those that any run holds after its
    first period. Null, empty and blank texts have no runs and collapse to ''. Rows that share
    a doc_id or a text each get a row, a null doc_id is kept; other columns are ignored; an
    empty table gives no rows. Stateless: no shuffle, a text is parsed in one task.
    """
    if least_periods < 2 or least_words < 1:
        raise ValueError("a run has two periods and a word at least")
    reach(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _search(least_words, least_periods), f"doc_id long, runs {RUNS}, collapsed string"
    )


def highest_power(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties go to the first of the
    array. Null where there is none."""
    more = lambda x, y: F.when(y.isNull() | (x["length"] * y["period"] > y["length"] * x["period"]), x).otherwise(y)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda y, x: more(x, y))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of highest power (start, length, period, exponent_milli; nulls
    without a run) and digests of the runs and of the collapsed text, from :func:`find_runs`."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = found.withColumn("best", highest_power(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the texts of one in ten ids (CRC-32 of the id's digits) repeat a
    part of themselves from some word to their end: word i >= a becomes word a + (i - a) % p.
    A null doc_id or text changes nothing."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.floor(h / 10).alias("g"),
        F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"),
    )
    n = F.size("w")
    split = split.withColumn("a", F.when(n > 0, F.col("g") % n))
    split = split.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    i = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    repeated = F.transform(
        i, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    )
    return split.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
