"""Per-word results inside a task: each distinct word is worked on once, then counted."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ENTRIES = 1 << 20  # words a task remembers; beyond it, it starts over


class WordCache:
    """Maps words to rows of small integers. ``work`` gets a list of distinct words (bytes)
    and returns an array with a row for each."""

    def __init__(self, work: Callable[[list[bytes]], np.ndarray], width: int) -> None:
        self.work, self.width = work, width
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, self.width), np.int32)

    def look_up(self, h: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A row of results for each word."""
        if not len(h):
            return np.zeros((0, self.width), np.int32)
        keys, one, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty((len(keys), self.width), np.int32)
        if known.any():
            out[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            spans = zip(begin[one[new]].tolist(), end[one[new]].tolist())
            out[new] = self.work([raw[a:b] for a, b in spans])
            if len(self.keys) + len(new) > ENTRIES:
                self._forget()
            keys_, rows = np.r_[self.keys, keys[new]], np.r_[self.rows, out[new]]
            order = np.argsort(keys_, kind="stable")
            self.keys, self.rows = keys_[order], rows[order]
        return out[back]


def per_text(values: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Column sums of word rows for each text."""
    return np.stack(
        [np.bincount(text, values[:, j], minlength=n_texts) for j in range(values.shape[1])], axis=1
    ).astype(np.int64)
