"""A tree as balanced parentheses, with blocks of excess minima to find closing ones."""

from __future__ import annotations

import numpy as np

BLOCK = 64
NEVER = np.iinfo(np.int32).max


class Parens:
    """``bits`` is True for "(" and False for ")"; nodes count from 0 in depth-first order.

    Kept are the excess (opened minus closed) after each place, its minimum per block of
    64 places, and the minima of pairs of blocks above, level by level; besides, how many
    places before each hold the leaf pattern "()".
    """

    def __init__(self, bits: np.ndarray):
        self.opens = np.flatnonzero(bits)
        excess = np.full(-(-len(bits) // BLOCK) * BLOCK, NEVER, np.int32)
        excess[: len(bits)] = np.cumsum(np.where(bits, 1, -1))
        self.excess = excess.reshape(-1, BLOCK)
        self.levels = [self.excess.min(axis=1)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            if len(below) % 2:
                below = self.levels[-1] = np.append(below, NEVER)
            self.levels.append(np.minimum(below[::2], below[1::2]))
        self.leaf_rank = np.concatenate(([0], np.cumsum(np.append(bits[:-1] & ~bits[1:], False))))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """For each "(" at a place: the place of its ")", the first one after it with one less excess."""
        goal = self.excess.ravel()[at] - 1
        out = self._in_block(at // BLOCK, at % BLOCK, goal)
        far = np.flatnonzero(out < 0)
        block = self._later_block(at[far] // BLOCK, goal[far])
        out[far] = self._in_block(block, np.full(len(far), -1), goal[far])
        return out

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and leaves in the subtree of every node, its top included."""
        close = self.find_close(self.opens)
        return (close - self.opens + 1) // 2, self.leaf_rank[close] - self.leaf_rank[self.opens]

    def _in_block(self, block, after, goal, each: int = 1 << 14):
        out = np.full(len(block), -1, np.int64)
        for a in range(0, len(block), each):
            part = slice(a, a + each)
            hit = (self.excess[block[part]] == goal[part, None]) & (np.arange(BLOCK) > after[part, None])
            first = hit.argmax(axis=1)
            out[part] = np.where(hit[np.arange(len(first)), first], block[part] * BLOCK + first, -1)
        return out

    def _later_block(self, block, goal):
        """The first block after each with a minimum not above the goal: up past left siblings, then down."""
        node, which, turned = block.copy(), np.arange(len(block)), []
        for low in self.levels:
            right = np.minimum(node[which] + 1, len(low) - 1)
            hit = (node[which] % 2 == 0) & (node[which] + 1 < len(low)) & (low[right] <= goal[which])
            turned.append(which[hit])
            node[which[hit]] += 1
            which = which[~hit]
            node[which] //= 2
        down = np.zeros(0, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if len(down):
                left = node[down] * 2
                node[down] = left + (self.levels[level][left] > goal[down])
            down = np.concatenate((down, turned[level]))
        return node
