"""Self-join of 64-bit fingerprints on a binary trie, for the groups of one task.

The trie is not built: in the sorted fingerprints of a group every trie node is a range. Pairs of
nodes go down together, bit by bit; a pair carries the number of bits in which its two prefixes
differ and is dropped as soon as that exceeds the budget. Pairs of a whole level are handled as one
numpy step, and at most `WIDTH` at a time, the rest waiting on a stack, so memory stays bounded.
"""

from collections.abc import Iterator

import numpy as np

WIDTH = 1 << 17
#: Node pairs with so few pairs of leaves are compared leaf by leaf.
LEAVES = 16


def pairs_within(
    prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of fingerprints in one group that differ in at most `budget` bits.

    `prints` (uint64) is sorted and free of repeats within each group [starts, ends).
    """
    ones = [None] * 64
    stack = [(63, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    while stack:
        bit, la, ha, lb, hb, diff = stack.pop()
        same = la == lb
        alive = (ha > la) & (hb > lb) & (diff <= budget) & ~(same & (ha - la < 2))
        if not alive.all():
            la, ha, lb, hb, diff, same = (x[alive] for x in (la, ha, lb, hb, diff, same))
        if not len(la):
            continue
        few = (ha - la) * (hb - lb) <= LEAVES
        if bit < 0:
            few[:] = True
        if few.any():
            i, j = _leaves(la[few], ha[few], lb[few], hb[few])
            near = (i < j) & (np.bitwise_count(prints[i] ^ prints[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            more = ~few
            la, ha, lb, hb, diff, same = (x[more] for x in (la, ha, lb, hb, diff, same))
            if not len(la):
                continue
        if len(la) > WIDTH:
            half = len(la) // 2
            stack.append((bit, la[:half], ha[:half], lb[:half], hb[:half], diff[:half]))
            stack.append((bit, la[half:], ha[half:], lb[half:], hb[half:], diff[half:]))
            continue
        if ones[bit] is None:
            set_bits = ((prints >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
            ones[bit] = np.concatenate(([0], np.cumsum(set_bits)))
        count = ones[bit]
        ma, mb = ha - (count[ha] - count[la]), hb - (count[hb] - count[lb])
        cross = ~same  # of a node with itself, (0, 1) and (1, 0) are the same pairs
        stack.append(
            (
                bit - 1,
                np.concatenate((la, ma, la, ma[cross])),
                np.concatenate((ma, ha, ma, ha[cross])),
                np.concatenate((lb, mb, mb, lb[cross])),
                np.concatenate((mb, hb, hb, mb[cross])),
                np.concatenate((diff, diff, diff + 1, diff[cross] + 1)),
            )
        )


def _leaves(la, ha, lb, hb) -> tuple[np.ndarray, np.ndarray]:
    wide, tall = hb - lb, ha - la
    sizes = wide * tall
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(first)) - first
    wide = np.repeat(wide, sizes)
    return np.repeat(la, sizes) + at // wide, np.repeat(lb, sizes) + at % wide


class Forest:
    """Union-find over positions that takes whole arrays of links."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up
