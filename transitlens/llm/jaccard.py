"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Two documents link when their sets are
at least ``num / den`` similar. The symmetric difference of a linked pair is at most a known
bound ``d`` of its sizes, and three steps use that bound:

1. *Pigeonhole join.* For each size band the shingle space is cut into ``k > d`` blocks, and
   the sketch of a block is the XOR of the hashes of the set's shingles in it. A shingle of
   the symmetric difference changes one block at most, so a linked pair agrees on all but
   ``d`` blocks: it shares one of each side's first ``d + 1`` non-empty blocks (fullest
   first). A set with no more than ``d`` non-empty blocks also emits its first ``d + 1``
   single shingles, so that no pair is lost. Bands double, and a set near a band's end also
   emits for the next one.
2. *Parity bits.* Each set keeps a bit sketch in which every shingle flips one bit. The
   Hamming distance of two sketches is a lower bound of the symmetric difference, so a
   candidate beyond the bound is dropped.
3. *Verification* on the whole sets.

Shingles that many documents share (at least one in 200, counted over all texts) carry no
evidence and are left out of the block sketches, which keeps a passage that a third of all
documents repeat from making one large bucket. This never loses a pair: the bound holds for
any fixed subset of the shingles, and sets left with too few fall back to single shingles.

Equal sets are one node. A bucket's nodes are first held against its smallest node only. Where a
bucket's nodes are then still in several components, all pairs between components are held
against the parity bits, a tile of the bucket at a time, and only those that pass are listed.
Where more than FEW pass in a strip of a tile, as in a large group of near copies, the nearest
pairs go first: one for each node, and of these one for each two components. The bucket is then
looked at again with the components they made, LOOKS times before all that is left is listed.
Nothing is listed pair by pair in a group of copies, and no link between different sets that
could join two components is missed.

Shingles and nodes are 64-bit hashes: n distinct ones (shingles of a text, sets of the table)
collide with probability below n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from transitlens.llm import kernels as K
from transitlens.llm.tables import bitmap, reach, saved

WIDTH = 5
NUM, DEN = 75, 100
#: a shingle in at least one of this many distinct documents is common
COMMON = 200
TILE = 4096  # nodes of a bucket that are compared at once
SMALL = 32  # nodes of a bucket that is compared together with others
FEW = 1024  # pairs of a strip that are all listed at once
LOOKS = 2  # times that the nearest pairs of a crowded bucket go first
_SEEN = 1 << 18  # nodes a task remembers, to leave out repeats


def _sets(piece: pa.RecordBatch, width: int):
    """(row of each shingle, distinct shingles of each row in order, first index, size, node) of
    a slice."""
    data, offsets = K.buffers(piece.column("text"))
    h, text, _, _ = K.words(data, offsets)
    rows = piece.num_rows
    first, count = K.first_words(text, rows)
    s, at = K.shingles(h, text, width)
    row = text[at]
    short = np.flatnonzero((count > 0) & (count < width))
    for n in np.unique(count[short]):
        few = short[count[short] == n]
        own, begin = K.shingles(h, text, int(n))
        keep = np.isin(begin, first[few])
        s, row = np.concatenate([s, own[keep]]), np.concatenate([row, text[begin[keep]]])
    # one sort of whole words: the row, then as many leading bits of the shingle as fit
    bits = np.uint64(max(1, int(rows - 1).bit_length()))
    tagged = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (s >> bits)
    order = np.argsort(tagged)
    tagged, own = tagged[order], s[order]
    if ((tagged[1:] == tagged[:-1]) & (own[1:] != own[:-1])).any():  # told apart by later bits
        order = np.lexsort((s, row))
        own = s[order]
    row, s = row[order], own
    if len(s):
        new = np.r_[True, (row[1:] != row[:-1]) | (s[1:] != s[:-1])]
        row, s = row[new], s[new]
    first, size = K.first_words(row, rows)
    node = np.zeros(rows, dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        node[full] = K.mix(np.add.reduceat(K.mix(s), first[full]) + size[full].astype(np.uint64))
    return row, s, first, size, node.view(np.int64)


def _sketches(row: np.ndarray, s: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parity bits of each set: a power of two of them, at least four times its size and 512."""
    bits = np.maximum(512, 4 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    at = (ends - bits)[row] + (s & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    flips = np.bincount(at, minlength=int(ends[-1])) if len(bits) else np.zeros(0, np.int64)
    packed = np.packbits((flips & 1).astype(np.uint8), bitorder="little")
    offsets = np.r_[0, ends // 8].astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(bits), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
    )


def _scan(width: int):
    """Per document: set size, node and parity bits; with the first document of each slice,
    the shingles that many of the slice's distinct sets share, and how many do."""

    def run(batches):
        for piece in K.slices(batches):
            row, s, first, size, node = _sets(piece, width)
            _, one = np.unique(node, return_index=True)
            distinct = np.zeros(len(node), dtype=bool)
            distinct[one] = True
            common, times = np.unique(s[distinct[row]], return_counts=True)
            often = times >= max(3, len(one) // COMMON)
            common, times = common[often], times[often]
            head = np.zeros(len(node), dtype=np.int64)
            head[0] = len(common)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("text_hash"),
                    pa.array(size, pa.int64()),
                    pa.array(node, pa.int64(), mask=size == 0),
                    _sketches(row, s, size),
                    K.lists(common.astype(np.int64), head, pa.int64()),
                    K.lists(times.astype(np.int64), head, pa.int64()),
                ],
                ["doc_id", "text_hash", "n", "node", "sketch", "common", "times"],
            )

    return run


def _unseen(node: np.ndarray, size: np.ndarray, seen: set) -> np.ndarray:
    """Rows whose node comes up for the first time in this task (as far as it remembers)."""
    _, one = np.unique(node, return_index=True)
    fresh = [i for i in one if size[i] and int(node[i]) not in seen]
    if len(seen) > _SEEN:
        seen.clear()
    seen.update(int(node[i]) for i in fresh)
    return np.asarray(sorted(fresh), dtype=np.int64)


def _blocks(row, s, rare, take, k, seed):
    """Non-empty blocks of some rows: (row, shingles in it, sketch), fullest first in a row.
    ``k`` is the number of blocks of each row."""
    sel = rare & take[row]
    row, s = row[sel], s[sel]
    base = np.cumsum(np.where(take, k, 0)) - np.where(take, k, 0)
    with np.errstate(over="ignore"):
        spread = K.mix(s + np.uint64(seed))
    cell = base[row] + ((spread >> np.uint64(32)) % k[row].astype(np.uint64)).astype(np.int64)
    low = np.uint64(36)
    both = np.sort((cell.astype(np.uint64) << low) | (spread & np.uint64((1 << 36) - 1)))
    cell = (both >> low).astype(np.int64)
    if not len(cell):
        return cell, cell, both
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    parity = np.bitwise_xor.reduceat(K.mix(both & np.uint64((1 << 36) - 1)), starts)
    held = np.diff(np.r_[starts, len(cell)])
    cell = cell[starts]
    rows = np.flatnonzero(take)
    row = rows[np.searchsorted(base[rows], cell, side="right") - 1]
    with np.errstate(over="ignore"):
        key = K.mix(parity ^ K.mix((cell - base[row]).astype(np.uint64) + np.uint64(seed)))
    order = np.argsort(
        (row.astype(np.uint64) << np.uint64(48))
        | ((255 - np.minimum(held, 255)).astype(np.uint64) << np.uint64(40))
        | (key >> np.uint64(24))
    )
    return row[order], held[order], key[order]


def _prefix(row: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Mask of the first ``limit[row]`` entries of each row; entries are grouped by row."""
    first = np.searchsorted(row, row, side="left")
    return np.arange(len(row)) - first < limit[row]


def _items(width: int, num: int, den: int, common: np.ndarray):
    """(key, node): what a set emits for the pigeonhole join."""

    def run(batches):
        seen: set = set()
        for piece in K.slices(batches):
            row, s, first, size, node = _sets(piece, width)
            fresh = np.zeros(len(node), dtype=bool)
            fresh[_unseen(node, size, seen)] = True
            keep = fresh[row]
            row, s = row[keep], s[keep]
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                rare = common[at] != s
            else:
                rare = np.ones(len(s), dtype=bool)
            level = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
            top = 1 << level
            apart = size * (den - num) // num
            out = []
            for up in (0, 1):
                band = level + up
                take = fresh if not up else fresh & (size * den > top * num)
                # in the own band no partner is larger than the band's end
                d = apart if up else np.minimum(apart, (size + top) * (den - num) // (den + num))
                for b in np.unique(band[take]):
                    rows = take & (band == b)
                    k = np.full(len(node), 1 + (12 * (den - num) * (1 << int(b))) // (10 * num))
                    r, _, key = _blocks(row, s, rare, rows, k, 2 * int(b) + 1)
                    blocks = np.bincount(r, minlength=len(node))
                    mask = _prefix(r, d + 1)
                    out.append((key[mask], node[r[mask]]))
                    thin = rows & (blocks <= d)
                    if thin.any():
                        sel = thin[row]
                        r1, s1, rare1 = row[sel], s[sel], rare[sel]
                        with np.errstate(over="ignore"):
                            key1 = K.mix(K.mix(s1) + np.uint64(2 * int(b)))
                        order = np.lexsort((key1, ~rare1, r1))
                        r1, key1 = r1[order], key1[order]
                        mask = _prefix(r1, d + 1)
                        out.append((key1[mask], node[r1[mask]]))
            if out:
                key, node_ = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(node_)], ["key", "node"]
                )

    return run


def _stars(batches):
    """From rows sorted by key and node: every node of a key that holds several, with the
    key's smallest node. Holds one batch at a time, whatever the size of a key."""
    open_key = center = last = None
    told = False
    for batch in batches:
        key = batch.column(0).to_numpy()
        node = batch.column(1).to_numpy()
        if not len(key):
            continue
        fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        if open_key is not None and key[0] == open_key and node[0] == last:
            fresh[0] = False
        last_key, last = key[-1], node[-1]
        key, node = key[fresh], node[fresh]
        if len(key):
            begins = np.r_[key[0] != open_key if open_key is not None else True, key[1:] != key[:-1]]
            begins = begins.astype(bool)
            group = np.cumsum(begins) - 1  # -1: the open key of the batch before
            starts = np.flatnonzero(begins)
            centers = node[starts]
            sizes = np.bincount(group + 1, minlength=len(starts) + 1)
            cont = sizes[0]
            c = np.where(group >= 0, centers[np.maximum(group, 0)] if len(centers) else 0, center or 0)
            several = (group < 0) | (sizes[group + 1] > 1)
            k, c, v = key[several], c[several], node[several]
            if cont and not told:
                k, c, v = np.r_[open_key, k], np.r_[center, c], np.r_[center, v]
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (k, c, v)], ["key", "center", "node"]
                )
            if len(starts):
                center, told = centers[-1], bool(sizes[-1] > 1)
            else:
                told = told or bool(cont)
        open_key = last_key


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bits in fewer bits: halves are laid over each other. Bits lie along the last axis."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class _Bits:
    """The parity bits of a binary column, in 64-bit words."""

    def __init__(self, column: pa.Array) -> None:
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, ends, data = column.buffers()
        at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.first = (at[:-1] - at[0]) // 8
        self.size = np.diff(at) // 8
        self.words = np.frombuffer(whole[at[0] : at[-1]].tobytes(), np.uint64)

    def take(self, rows: np.ndarray, size: int) -> np.ndarray:
        """The bits of some rows that have ``size`` words each."""
        return self.words[self.first[rows][:, None] + np.arange(size)]


def _distances(x: _Bits, y: _Bits, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of row a[i] of ``x`` and row b[i] of ``y``, the longer one folded."""
    out = np.zeros(len(a), dtype=np.int64)
    wide, other = x.size[a], y.size[b]
    for m, n in {*zip(wide.tolist(), other.tolist())}:
        some = np.flatnonzero((wide == m) & (other == n))
        step = max(1, (1 << 17) // max(m, n))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            u, v = _fold(x.take(a[part], m), min(m, n)), _fold(y.take(b[part], n), min(m, n))
            out[part] = np.bitwise_count(u ^ v).sum(axis=1)
    return out


def _hamming(num: int, den: int):
    """Keeps candidate pairs whose parity bits don't rule them out."""

    def run(batches):
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            every = np.arange(len(a))
            apart = _distances(_Bits(batch.column(4)), _Bits(batch.column(5)), every, every)
            ok = apart <= (n + m) * (den - num) // (den + num)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64())], ["a", "b"]
            )

    return run


def _nearest(far: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """The row of least ``far`` (the first of them) of each combination of names."""
    order = np.lexsort((far, *names))
    new = np.arange(len(far)) == 0
    for x in names:
        new[1:] |= x[order][1:] != x[order][:-1]
    return np.sort(order[new])


def _apart(num: int, den: int, few: int | None):
    """From rows sorted by bucket and pair of tiles: the pairs of nodes of different components
    whose sizes and parity bits allow a link. A pair that shares a smaller bucket is left to
    that one where the 64 most frequent smaller buckets of the tiles show it. Holds the rows of
    two tiles, and compares a strip of them at a time.

    A strip with more than ``few`` pairs (None: never) gives the nearest ones only. Such a bucket
    is named in a row of its own, with a key and no pair."""

    def found(a, b):
        a, b = pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), a, b], ["key", "a", "b"])

    def pairs(key, center, lo, hi, rows):
        node, root, n, tile = (np.concatenate([r[i] for r in rows]) for i in range(4))
        sketches = [x for r in rows for x in r[4]]
        size = min(len(x) for x in sketches)
        bits = np.stack([_fold(np.frombuffer(x, np.uint8), size) for x in sketches]).view(np.uint64)
        lists = [x for r in rows for x in r[5]]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        others = np.concatenate(lists)
        owner, others = owner[others < key], others[others < key]
        names, back, times = np.unique(others, return_inverse=True, return_counts=True)
        place = np.full(len(names), 64)
        top = np.argsort(-times, kind="stable")[:64]
        place[top] = np.arange(len(top))
        crowded = False
        seen = np.zeros(len(node), np.uint64)
        told = place[back] < 64
        np.bitwise_or.at(seen, owner[told], np.uint64(1) << place[back][told].astype(np.uint64))
        for i in range(0, len(node), 256):
            strip = slice(i, i + 256)
            far = np.zeros((len(node[strip]), len(node)), np.int64)
            for w in range(bits.shape[1]):
                far += np.bitwise_count(bits[strip, w][:, None] ^ bits[None, :, w])
            both = n[strip][:, None] + n[None, :]
            least = np.minimum(n[strip][:, None], n[None, :])
            ok = far <= both * (den - num) // (den + num)
            ok &= least * den >= (both - least) * num
            ok &= root[strip][:, None] != root[None, :]
            ok &= (seen[strip][:, None] & seen[None, :]) == 0
            ok &= node[strip][:, None] < node[None, :] if lo == hi else (tile[strip] == lo)[:, None] & (tile == hi)[None, :]
            ok &= (node[strip] != center)[:, None] & (node != center)[None, :]
            a, b = np.nonzero(ok)
            if few is not None and len(a) > few:
                near = _nearest(far[a, b], b)
                x, y = root[strip][a[near]], root[b[near]]
                near = near[_nearest(far[a[near], b[near]], np.minimum(x, y), np.maximum(x, y))]
                crowded |= len(near) < len(a)
                a, b = a[near], b[near]
            yield found(node[strip][a], node[b])
        if crowded:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), none, none], ["key", "a", "b"])

    def small(batch, starts, count):
        """The pairs of whole buckets of a few rows each (one tile), all of them at once."""
        row = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        later = np.repeat(starts + count, count) - row - 1  # rows of the bucket that follow
        a = np.repeat(row, later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        center, node, root, n = (batch.column(i).to_numpy() for i in (1, 4, 5, 6))
        least, both = np.minimum(n[a], n[b]), n[a] + n[b]
        ok = (root[a] != root[b]) & (node[a] != node[b]) & (least * den >= (both - least) * num)
        ok &= (node[a] != center[a]) & (node[b] != center[b])
        a, b, both = a[ok], b[ok], both[ok]
        bits = _Bits(batch.column(8))
        ok = _distances(bits, bits, a, b) <= both * (den - num) // (den + num)
        return found(node[a[ok]], node[b[ok]])

    def run(batches):
        held, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, center, lo, hi = (batch.column(i).to_numpy() for i in range(4))
            new = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            starts = np.r_[np.flatnonzero(new), len(key)]
            # buckets of one tile that begin and end inside this batch
            count = np.diff(starts)
            few = (count <= SMALL) & (batch.column(9).is_null().to_numpy(zero_copy_only=False)[starts[:-1]])
            few[[0, -1]] = False
            if few.any():
                yield small(batch, starts[:-1][few], count[few])
            for x, y in zip(starts[:-1][~few], starts[1:][~few]):
                name = (key[x], center[x], lo[x], hi[x])
                if held is not None and name != held:
                    yield from pairs(*held, rows)
                    rows = []
                held = name
                part = batch.slice(x, y - x)
                rows.append(
                    [part.column(i).to_numpy() for i in range(4, 8)]
                    + [part.column(8).to_pylist(), [np.asarray(v or [], np.int64) for v in part.column(9).to_pylist()]]
                )
        if held is not None:
            yield from pairs(*held, rows)

    return run


def _whole(width: int, wanted: K.Bitmap):
    """(node, set) of the sets whose node may be wanted."""

    def run(batches):
        seen: set = set()
        for piece in K.slices(batches):
            row, s, first, size, node = _sets(piece, width)
            size = np.where(wanted.has(node.view(np.uint64)), size, 0)
            rows = _unseen(node, size, seen)
            if len(rows):
                values = np.concatenate([s[first[i] : first[i] + size[i]] for i in rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[rows]), K.lists(values.astype(np.int64), size[rows], pa.int64())],
                    ["node", "members"],
                )

    return run


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = [batch.column(i) for i in (2, 3)]
            sizes = [np.diff(x.offsets.to_numpy()) for x in lists]
            values = np.concatenate([x.flatten().to_numpy() for x in lists])
            pair = np.concatenate([np.repeat(np.arange(len(a)), n) for n in sizes])
            order = np.lexsort((values, pair))
            values, pair = values[order], pair[order]
            same = (values[1:] == values[:-1]) & (pair[1:] == pair[:-1])
            shared = np.bincount(pair[1:][same], minlength=len(a))
            ok = den * shared >= num * (sizes[0] + sizes[1] - shared)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64())], ["a", "b"]
            )

    return run


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of undirected links
    (a, b). Alternates large-star and small-star steps, each a grouped minimum and a join, so
    no component is gathered anywhere; rounds grow with the logarithm of the longest path."""

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        moved = both.join(least, F.col("a") == F.col("u"))
        if large:
            moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return moved.where("a <> b").distinct()

    edges = saved(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while (now := mark(edges)) != before:
        before = now
        half = saved(star(edges, large=True), "links")  # read twice by the next step
        edges = saved(star(half, large=False), "links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def link_components(
    docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN
) -> DataFrame:
    """doc_id, n_shingles (set size), component_id (smallest doc_id reachable by links), and
    for joins back to the rows text_hash (xxhash64 of the text) and component (a hash that
    names the component; null for a text without words).

    ``docs`` needs doc_id (integer) and text; other columns are ignored. Null, empty and
    blank texts have no shingles and link with nothing: their component_id is their own
    doc_id. A text of fewer than ``width`` words is one shingle, the whole sequence. Rows with
    equal texts, or with one doc_id, each get a row; a null doc_id stays null and is never the
    smallest, unless a component has no other. An empty table gives no rows.
    """
    reach(docs.sparkSession)
    texts = docs.select("text")
    scan = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
            _scan(width),
            "doc_id long, text_hash long, n long, node long, sketch binary, common array<long>, times array<long>",
        ),
        "sets",
    )
    nodes = saved(
        scan.where("n > 0").groupBy("node").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least")
        ),
        "nodes",
    )
    total = nodes.count()
    # at least total / COMMON sets hold each: no more than COMMON times the mean set size
    common = (
        scan.select(F.explode(F.arrays_zip("common", "times")).alias("x"))
        .groupBy(F.col("x.common").alias("s"))
        .agg(F.sum("x.times").alias("t"))
        .where(F.col("t") * COMMON >= max(total, 3 * COMMON))
        .select("s")
    )
    known = np.sort(np.array([r[0] for r in common.collect()], dtype=np.int64).view(np.uint64))
    items = texts.mapInArrow(_items(width, num, den, known), "key long, node long")
    stars = saved(
        items.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
            _stars, "key long, center long, node long"
        ),
        "stars",
    )

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and parity bits allow a link."""
        side = nodes.select("node", "n", "sketch")
        return (
            pairs.join(side.toDF("a", "n", "sa"), "a")
            .join(side.toDF("b", "m", "sb"), "b")
            .where((F.least("n", "m") * den) >= (F.greatest("n", "m") * num))
            .select("a", "b", "n", "m", "sa", "sb")
            .mapInArrow(_hamming(num, den), "a long, b long")
        )

    def linked(near: DataFrame) -> DataFrame:
        """The pairs (a, b) of a saved table whose whole sets are similar enough."""
        wanted = bitmap(near.select(F.explode(F.array("a", "b")).alias("x")).distinct(), F.col("x"))
        sets = texts.mapInArrow(_whole(width, wanted), "node long, members array<long>")
        sets = saved(sets.groupBy("node").agg(F.first("members").alias("members")), "members")
        return saved(
            near.join(sets.toDF("a", "x"), "a")
            .join(sets.toDF("b", "y"), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(_verify(num, den), "a long, b long"),
            "verified",
        )

    first = stars.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    of = saved(connected(linked(saved(alike(first), "near"))), "roots")

    # buckets whose nodes are still in several components: all such pairs, tile by tile
    for look in range(LOOKS + 1):
        placed = stars.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = (
            placed.groupBy("key", "center")
            .agg(F.count("*").alias("rows"), F.min("root").alias("r0"), F.max("root").alias("r1"))
            .where("r0 <> r1 AND rows > 2")
            .select("key", "rows", F.ceil(F.col("rows") / TILE).cast("int").alias("tiles"))
        )
        open_ = saved(placed.join(several, "key"), "open")
        if open_.isEmpty():
            break
        listed = open_.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # its own buckets
        detail = nodes.select("node", "n", "sketch").join(listed.select("node", F.slice("keys", 1, 64).alias("keys")), "node")
        tiled = open_.withColumn("tile", F.pmod("node", F.col("tiles")).cast("int")).select(
            "*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        )
        tiled = tiled.join(detail, "node").select(
            "key", "center", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
            "node", "root", "n", "tile", "sketch", F.when(F.col("rows") > SMALL, F.col("keys")).alias("keys"),
        )
        cross = saved(
            tiled.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(_apart(num, den, FEW if look < LOOKS else None), "key long, a long, b long")
            .distinct(),
            "cross",
        )
        verified = linked(cross.where("a IS NOT NULL").select("a", "b"))
        of = saved(connected(of.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified)), "roots")
        again = cross.where("key IS NOT NULL").select("key")
        if again.isEmpty():
            break
        stars = saved(stars.join(again, "key", "left_semi"), "stars")

    smallest = nodes.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = smallest.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = smallest.join(least, "root").select("node", "component_id", F.col("root").alias("component"))
    return (
        scan.select("doc_id", F.col("n").alias("n_shingles"), "node", "text_hash")
        .join(owner, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "text_hash",
            "component",
        )
    )


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one of the smallest
    doc_id (null last), then of the smallest text hash. Texts without words all stay. A row
    that repeats whole in doc_id and text stays once."""
    rows = saved(
        link_components(docs, **settings).where(F.col("component").isNotNull()).select("doc_id", "text_hash", "component"),
        "components",
    )
    # a null doc_id sorts last: (is null, id, hash)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = rows.groupBy("component").agg(F.min(rank).alias("best"), F.count("*").alias("rows"))
    # a table of its own, so that the join may split the rows of a large component
    several = rows.join(saved(best.where("rows > 1"), "largest"), "component")
    gone = several.where(~(rank.eqNullSafe(F.col("best")))).select("doc_id", "text_hash").distinct()
    repeats = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    tagged = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h")
    )
    same = lambda x: F.col("i").eqNullSafe(x["doc_id"]) & (F.col("h") == x["text_hash"])
    kept = tagged.join(gone, same(gone), "left_anti")
    if repeats.isEmpty():
        return kept.select("row.*")
    once = kept.join(repeats, same(repeats), "left_semi").dropDuplicates(["i", "h"])
    return kept.join(repeats, same(repeats), "left_anti").union(once).select("row.*")
