"""A trie of integer sequences as a double array, walked from all positions of a text at once."""

from __future__ import annotations

import numpy as np

DIGIT_BITS = 6


class DoubleArray:
    """Phrases of one length over numbers from 1 up.

    A number is a fixed row of 6-bit digits.  The child of a state by a digit is
    the slot ``base[state] + digit`` if ``check`` there names the state.  The
    children of a branching state lie in a block of at most 64 slots of their
    own; only children fill the holes between them.  There are fewer branching
    states than phrases, so ``n`` phrases of ``m`` numbers of ``d`` digits take at most
    ``n * (64 + m * d)`` slots of eight bytes.
    """

    def __init__(self, phrases: np.ndarray):
        """``phrases``: distinct rows in ascending order; a phrase's number is its row."""
        n, self.length = phrases.shape
        most = int(phrases.max()) if n else 1
        self.shifts = list(range((max(1, most.bit_length() - 1) // DIGIT_BITS) * DIGIT_BITS, -1, -DIGIT_BITS))
        mask = (1 << DIGIT_BITS) - 1
        digits = np.stack([(phrases[:, w] >> s) & mask for w in range(self.length) for s in self.shifts], 1) if n else np.zeros((0, 1), np.int64)
        end = 1 << DIGIT_BITS  # slot 0 is the root; a base is never negative
        holes = np.zeros(0, np.int64)
        bases, checks = [(np.zeros(1, np.int64), np.array([end]))], []
        state, node = np.zeros(1, np.int64), np.zeros(n, np.int64)  # the slots of this depth's states; each phrase's state
        for depth in range(digits.shape[1] if n else 0):
            digit = digits[:, depth]
            new = np.append(True, (np.diff(node) != 0) | (np.diff(digit) != 0))
            child, parent, symbol = np.cumsum(new) - 1, node[new], digit[new]
            first = np.append(True, np.diff(parent) != 0)
            group = np.cumsum(first) - 1
            begin = np.flatnonzero(first)
            last = np.append(begin[1:], len(parent)) - 1
            many = last > begin
            span = np.where(many, symbol[last] - symbol[begin] + 1, 0)
            base = end + np.cumsum(span) - span - symbol[begin]
            slot = base[group] + symbol
            taken = np.zeros(int(span.sum()), bool)
            taken[slot[many[group]] - end] = True
            holes = np.append(holes, end + np.flatnonzero(~taken))
            end += len(taken)
            alone = np.flatnonzero(~many)
            use = holes[:len(alone)]
            holes = holes[len(use):]
            use = np.append(use, end + np.arange(len(alone) - len(use)))
            end = max(end, int(use.max()) + 1 if len(use) else end)
            slot[begin[alone]] = use
            base[alone] = use - symbol[begin[alone]]
            owner = state[parent]
            bases.append((owner[begin], base))
            checks.append((slot, owner))
            state, node = slot, child
        size = end + (1 << DIGIT_BITS)
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for at, value in bases:
            self.base[at] = value
        for at, value in checks:
            self.check[at] = value
        if n:
            self.base[state[node]] = np.arange(n)  # an accepting state holds its phrase's number

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.check.nbytes

    def walk(self, numbers: np.ndarray) -> np.ndarray:
        """The number of the phrase that starts at each position, or -1.  All positions'
        states advance together, digit by digit; those without a child drop out."""
        padded = np.append(numbers, np.zeros(self.length, numbers.dtype))
        at = np.flatnonzero(numbers > 0)
        state = np.zeros(len(at), np.int32)
        top = 1 << (self.shifts[0] + DIGIT_BITS)
        for w in range(self.length):
            number = padded[at + w]
            live = (number > 0) & (number < top)
            at, state, number = at[live], state[live], number[live]
            for s in self.shifts:
                to = self.base[state] + ((number >> s) & ((1 << DIGIT_BITS) - 1))
                live = self.check[to] == state
                at, state, number = at[live], to[live], number[live]
        out = np.full(len(numbers), -1, np.int64)
        out[at] = self.base[state]
        return out
