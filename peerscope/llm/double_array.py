"""Double-array tries on numpy arrays: many sequences of dense codes packed and walked together."""

from __future__ import annotations

import numpy as np

FREE = -1


class DoubleArray:
    """BASE and CHECK: the child of state s by code c is base[s] + c, if check holds s there. State 0 is the top.

    A trie is packed depth by depth. States with several children look for the first place where all of
    them fit; the children of all other states then fill the holes, whatever their codes (so a base may
    be negative).
    """

    WINDOW = 256

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
        self.width = int(codes.max()) + 1 if len(codes) else 1
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, FREE, np.int64)
        self.check[0] = 0
        self.low = self.end = 1  # the first place that may be free, and the one from which all are
        state = np.zeros(len(lengths), np.int64)
        for depth in range(int(lengths.max()) if len(lengths) else 0):
            here = np.flatnonzero(lengths > depth)
            key, back = np.unique(state[here] * self.width + codes[offsets[here] + depth], return_inverse=True)
            state[here] = self._add(key // self.width, key % self.width)[back]

    def _room(self, places: int) -> None:
        if places > len(self.check):
            more = max(places, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, FREE, np.int64)]

    def _add(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Place the children (sorted by state, then code); their places."""
        first = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
        count = np.diff(np.r_[first, len(states)])
        for a, n in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            self._place(int(states[a]), codes[a:a + n])
        single = first[count == 1]
        if single.size:
            self._room(self.end + single.size)
            at = self.low + np.flatnonzero(self.check[self.low:self.end + single.size] == FREE)[:single.size]
            self.base[states[single]] = at - codes[single]
            self.check[at] = states[single]
            self.end = max(self.end, int(at[-1]) + 1)
            self.low = int(at[-1]) + 1
        return self.base[states] + codes

    def _place(self, state: int, codes: np.ndarray) -> None:
        gap = codes - codes[0]
        start, window = self.low, max(1, min(self.WINDOW, (1 << 18) // len(codes)))
        while True:
            stop = min(start + window, self.end + 1)
            self._room(stop + int(gap[-1]) + 1)
            at = start + np.flatnonzero(self.check[start:stop] == FREE)
            fits = np.flatnonzero((self.check[at[:, None] + gap] == FREE).all(1)) if at.size else at
            if fits.size:
                place = int(at[fits[0]])
                break
            start = stop
        self.base[state] = place - codes[0]
        self.check[place + gap] = state
        self.end = max(self.end, place + int(gap[-1]) + 1)

    def walk(self, codes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The place reached with each code of each sequence, -1 from the first step that the trie doesn't have."""
        out = np.full(len(codes), -1, np.int64)
        state = np.zeros(len(lengths), np.int64)
        for depth in range(int(lengths.max()) if len(lengths) else 0):
            here = np.flatnonzero((lengths > depth) & (state >= 0))
            at = offsets[here] + depth
            to = self.base[state[here]] + codes[at]
            inside = (to > 0) & (to < len(self.check))
            to = np.where(inside & (self.check[np.where(inside, to, 0)] == state[here]), to, -1)
            out[at] = state[here] = to
        return out
