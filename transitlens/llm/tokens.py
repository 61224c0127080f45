"""Token counts with a whole-token shortcut.

The tokenizer drops white space before it merges, so a text's tokens are the tokens of its
white-space separated words. Offline, every vocabulary string that ends a word is encoded
alone; those that come out as one token are the proven ones. A word's pre-tokens that are
proven count one each; only the remaining distinct pre-tokens are merged, by the library.
Each distinct word is counted once a task.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from transitlens.llm import kernels as K
from transitlens.llm.tables import reach
from transitlens.llm.wordcache import WordCache, per_text

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
_END = "</w>"
#: the tokenizer's own pre-token pattern, for words of plain ASCII (fixed value of the file)
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def proven_words(path: str) -> frozenset[str]:
    """The printable ASCII vocabulary strings that encode alone as one token."""
    tokenizer = _library(path)
    words = [
        w[: -len(_END)] for w in tokenizer.get_vocab() if w.endswith(_END) and w[: -len(_END)].isascii()
    ]
    alone = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, alone) if len(e.ids) == 1)


@lru_cache(maxsize=2)
def _counter(path: str):
    """Counts of a list of distinct words."""
    import re

    tokenizer, proven = _library(path), proven_words(path)
    pattern = re.compile(_PATTERN)
    odd = re.compile(r"[^\x21-\x7e]|<\|")

    def work(words: list[bytes]) -> np.ndarray:
        counts = np.zeros((len(words), 1), np.int32)
        rest: dict[str, list[int]] = {}
        for i, raw in enumerate(words):
            word = raw.decode("utf-8", "replace")
            if odd.search(word):  # characters to normalise, or a special string
                rest.setdefault(word, []).append(i)
                continue
            for part in pattern.findall(word.lower()):
                if part in proven:
                    counts[i, 0] += 1
                else:
                    rest.setdefault(part, []).append(i)
        strings = list(rest)
        for lo in range(0, len(strings), 4096):
            some = strings[lo : lo + 4096]
            for s, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                for i in rest[s]:
                    counts[i, 0] += len(e.ids)
        return counts

    return work


def _count(path: str):
    def run(batches):
        cache = WordCache(_counter(path), 1)
        for piece in K.slices(batches):
            data, offsets = K.buffers(piece.column("text"))
            h, text, begin, end = K.words(data, offsets)
            # word hashes don't see case, special strings do: a word with "<|" stands for itself
            special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) > 1 else []
            if len(special):
                at = np.unique(np.searchsorted(begin, special, side="right") - 1)
                raw = data.tobytes()
                h[at] = [hash(raw[begin[i] : end[i]]) & (2**64 - 1) for i in at]
            n = per_text(cache.look_up(h, data, begin, end), text, piece.num_rows)[:, 0]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n)],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text,
    without begin, end or added special tokens; special strings inside a text are handled as
    the library does by default. Null texts count as empty (0, 0). Rows that share a doc_id
    or a text each get a row; other columns are ignored; an empty table gives no rows.
    ``path`` is the tokenizers file (default: word_bpe_49k.json of the public tokenizers), at
    the same place on every worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    reach(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _count(str(path)), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
