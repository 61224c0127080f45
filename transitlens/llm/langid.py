"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a sample of its labelled text.
A text is parsed against it: the longest match from here is a phrase, and the next one starts
behind it. Text of the same language needs few, long phrases; the language that needs the
fewest phrases, times the logarithm of its sample's length, wins.

Texts are parsed as bytes, A-Z as a-z, words with single gaps; phrases run over gaps. The automata
become one table of transitions, in which a byte that ends a phrase leads on from the root, and
many texts advance by a byte at once. A text of more than CHUNK bytes is parsed in chunks, so that
all lanes are short. A match from a later place never ends earlier, so the phrases of two parses
that start at different places lie between each other, and a cut adds one phrase at most.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from transitlens.llm import kernels as K
from transitlens.llm.tables import reach

UNKNOWN = "und"
#: bound of the labelled sample of a language: rows, and characters held by its automaton
SAMPLE_ROWS = 64
SAMPLE_CHARS = 40_000
#: bound of all samples together: with more than 16 languages each holds an equal part of it, and
#: the table of transitions stays below some 400 MB
TOTAL_CHARS = 640_000
CHUNK = 1024
_GAP = 0x20


class SuffixAutomaton:
    """Recognises every substring of a text."""

    def __init__(self, text: str | bytes) -> None:
        step: list[dict] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.step = step

    def phrases(self, text: str | bytes) -> int:
        """Number of longest-match phrases the text is parsed into. A character that never
        occurs is a phrase of its own."""
        step = self.step
        root = step[0]
        n, at = 0, root
        for c in text:
            to = at.get(c)
            if to is None:
                n += at is not root
                to = root.get(c)
                if to is None:
                    n += 1
                    at = root
                    continue
            at = step[to]
        return n + (at is not root)


_SPOKEN = np.where(K.ALNUM, np.arange(256), _GAP).astype(np.uint8)
_SPOKEN[0x41:0x5B] += 0x20


def spoken(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts as they are parsed: words in lower case with single gaps before,
    between and behind them."""
    rows = len(offsets) - 1
    if not rows:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    byte = np.insert(_SPOKEN[data], np.repeat(offsets, np.r_[1, np.full(rows - 1, 2, np.int64), 1]), np.uint8(_GAP))
    starts = offsets + 2 * np.arange(rows + 1)
    gap = byte == _GAP
    keep = np.ones(len(byte), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[starts[:-1]] = True
    return byte[keep], np.r_[0, np.cumsum(keep)][starts]


def _tokenised(texts: list[str]) -> str:
    """The texts as they are parsed, in one string."""
    byte, _ = spoken(*K.buffers(pa.array(texts, pa.string())))
    return byte.tobytes().decode("utf-8", "replace").strip(" ")


class Parser:
    """The automata of several languages as one table of transitions. An entry holds four times
    the place of the next state's row, and how many phrases end (0 to 2)."""

    def __init__(self, samples: list[bytes]) -> None:
        used = sorted(set(b"".join(samples)) | {_GAP})
        self.code = np.full(256, len(used), np.int64)  # the last code: a byte no sample holds
        self.code[used] = np.arange(len(used))
        width = len(used) + 1
        # an automaton has fewer than two states a byte; the rows that stay empty take no memory
        table = np.empty((sum(2 * len(sample) + 1 for sample in samples), width), np.int32)
        self.roots, rows = [], 0
        for sample in samples:
            step = SuffixAutomaton(sample).step
            degree = [len(out) for out in step]
            edges = sum(degree)
            p = np.repeat(np.arange(len(step)), degree)
            c = self.code[np.fromiter((c for out in step for c in out), np.int64, edges)]
            q = np.fromiter((q for out in step for q in out.values()), np.int64, edges)
            again = np.zeros(width, np.int64)  # from the root; 0 where no match begins
            again[c[p == 0]] = q[p == 0]
            part = table[rows : rows + len(step)]
            part[:] = (again + rows) * width * 4 + 1 + (again == 0)
            part[0] = rows * width * 4 + 1
            part[p, c] = (q + rows) * width * 4
            self.roots.append(rows * width)
            rows += len(step)
            del step, degree, p, c, q
            K.release()
        self.table = table[:rows].ravel()

    def phrases(self, byte: np.ndarray, offsets: np.ndarray, chunk: int) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns), parsed in chunks."""
        size = np.diff(offsets)
        parts = -(-size // chunk)
        text = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = offsets[text] + nth * chunk
        long = np.minimum(offsets[text + 1] - first, chunk)
        order = np.argsort(-long, kind="stable")  # lanes that are still open come first
        text, first, long = text[order], first[order], long[order]
        roots = np.array(self.roots, np.int64)[:, None]
        place = np.repeat(roots, len(text), axis=1)
        n = np.zeros(place.shape, np.int64)
        code = self.code[byte]
        open_ = np.searchsorted(-long, -np.arange(chunk), side="left")  # lanes longer than a step
        for step in range(int(long[0]) if len(long) else 0):
            some = slice(0, int(open_[step]))
            found = self.table[place[:, some] + code[first[some] + step]]
            n[:, some] += found & 3
            place[:, some] = found >> 2
        n += place != roots
        return np.stack([np.bincount(text, row, minlength=len(size)) for row in n], axis=1).astype(np.int64)


@lru_cache(maxsize=1)
def _parser(samples: tuple[bytes, ...]) -> Parser:
    """Built once a worker."""
    return Parser(list(samples))


def _share(parts: list[str], chars: int) -> str:
    """The parts joined, each cut to an equal share of the characters (whole words where a
    share holds one); what short parts leave goes to the others."""
    parts = [p for p in parts if p]
    left, lengths = chars, sorted(len(p) + 1 for p in parts)
    for i, n in enumerate(lengths):
        if n * (len(lengths) - i) > left:
            most = max(left // (len(lengths) - i) - 1, 1)
            parts = [p if len(p) <= most else (p[: most + 1].rpartition(" ")[0] or p[:most]) for p in parts]
            break
        left -= n
    return " ".join(parts)[:chars]


def _smallest(pairs: DataFrame, rows: int) -> DataFrame:
    """Of (lang, doc_id, h) the ``rows`` of the smallest h for each language, and their rank r.

    Pairs are first counted by how far h lies from the least long, in powers of two: 64 counts
    a language, whatever the input. Only the powers that it takes to have enough pairs are
    ranked, about twice as many pairs as wanted."""
    power = F.when(F.col("h") >= 0, 64).otherwise(F.length(F.bin(F.col("h").bitwiseAND((1 << 63) - 1))))
    pairs = pairs.withColumn("power", power)
    counts = pairs.groupBy("lang", "power").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("power")) - F.col("n")
    needed = counts.withColumn("below", below).where(F.col("below") < rows)
    most = needed.groupBy("lang").agg(F.max("power").alias("most"))
    near = pairs.join(F.broadcast(most), "lang").where(F.col("power") <= F.col("most"))  # a row per language
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    return near.select("lang", "doc_id", F.row_number().over(w).alias("r")).where(F.col("r") <= rows)


def learn(docs: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Sample text per language: of the rows that may be learnt from and have a language and
    a text, the ``rows`` with the smallest hash of their doc_id for each language, each with
    an equal share of ``chars`` characters (fewer where the languages together would pass
    TOTAL_CHARS). Only (id, language) pairs are ranked; texts are read for the chosen ids, and
    cut to four shares each before they reach the driver."""
    able = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = _smallest(able.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct(), rows)
    chosen = chosen.withColumn("of", F.count("*").over(Window.partitionBy("lang")))
    share = F.ceil(F.lit(4 * chars) / F.col("of")).cast("int")
    cut = (
        able.join(F.broadcast(chosen.select("lang", "doc_id", "r", "of")), ["lang", "doc_id"])  # rows per language
        .select("lang", "r", F.substring(F.col("text"), F.lit(1), F.least(share, F.lit(chars))).alias("text"))
        .groupBy("lang", "r").agg(F.max("text").alias("text"))
    )
    texts: dict[str, list[str]] = {}
    for lang, _, text in cut.orderBy("lang", "r").collect():
        texts.setdefault(lang, []).append(text)
    chars = min(chars, TOTAL_CHARS // max(1, len(texts)))
    return {lang: f" {_share([_tokenised([t]) for t in parts], chars)} " for lang, parts in sorted(texts.items())}


def _parse(sample: dict[str, str], carried: tuple[str, ...]):
    langs = list(sample)
    # the longest match in n characters grows as log n (Ziv and Merhav), so phrases count by it:
    # no language is favoured by more labelled text
    cost = np.log2([max(len(t), 2) for t in sample.values()])

    samples = tuple(t.encode() for t in sample.values())

    def run(batches):
        names = np.array([*langs, UNKNOWN], dtype=object)
        for piece in K.slices(batches):
            byte, offsets = spoken(*K.buffers(piece.column("text")))
            rows = piece.num_rows
            n = _parser(samples).phrases(byte, offsets, CHUNK)
            size = np.add.reduceat(byte != _GAP, offsets[:-1], dtype=np.int64)
            fine = piece.column("lettered").to_numpy(zero_copy_only=False) & (size > 0)
            spent = n * cost
            best = spent.argmin(axis=1)  # ties: the first language by code point
            weight = 1.0 / np.maximum(spent, cost.min())
            score = weight[np.arange(rows), best] / weight.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *[piece.column(c) for c in carried],
                    pa.array(names[np.where(fine, best, len(langs))], pa.string()),
                    pa.array(np.where(fine, score, 0.0)),
                    pa.array(np.where(fine, n[np.arange(rows), best] / np.maximum(size, 1), 0.0)),
                ],
                [*carried, "lang_pred", "score", "phrases_per_byte"],
            )

    def none(batches):
        for piece in K.slices(batches):
            rows = piece.num_rows
            zero = pa.array(np.zeros(rows))
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(c) for c in carried], pa.array([UNKNOWN] * rows), zero, zero],
                [*carried, "lang_pred", "score", "phrases_per_byte"],
            )

    return run if langs else none


def held_out_rows() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1: the winner's share of inverse phrase
    counts, each times the logarithm of the sample's length) and phrases_per_byte (the cross-parsing entropy estimate).

    Learns from the rows that aren't held out, have a doc_id, a language and a text with a
    letter. A null text, and one without a letter, gets ``und`` and score 0; so does every
    text where no row can be learnt from. Ties go to the first language by code point. Rows
    that share a doc_id or a text each get a row; other columns are ignored; an empty table
    gives no rows.
    """
    return _identify(docs, held_out, ["doc_id", "held_out"])


def known_language(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't ``und``."""
    found = _identify(docs, held_out, ["row"])
    return found.where(F.col("lang_pred") != UNKNOWN).select("row.*")


def _identify(docs: DataFrame, held_out: Column | None, carried: list[str]) -> DataFrame:
    reach(docs.sparkSession)
    held = held_out_rows() if held_out is None else held_out
    sample = learn(docs, ~held & F.col("doc_id").isNotNull())
    ready = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        held.alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        "text",
    ).select(*carried, "lettered", "text")
    kinds = ", ".join(f"{c} {kind}" for c, kind in ready.dtypes if c in carried)
    return ready.mapInArrow(
        _parse(sample, tuple(carried)), f"{kinds}, lang_pred string, score double, phrases_per_byte double"
    )
