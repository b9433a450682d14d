"""Deep-shallow ordering of byte strings (Manzini and Ferragina, 2004).

Multikey quicksort splits all groups by eight-byte symbols to a shallow depth, every group's next step
at once. Groups that are still together at that depth, and so have long common prefixes, are ordered
by a blind trie: a Patricia trie that holds branching places only, so that an insertion compares one stored string.
"""

from __future__ import annotations

import numpy as np

#: Symbols of eight bytes that multikey quicksort looks at.
SHALLOW = 12
#: Groups of at most this size go to a blind trie at once: none but single strings.
SMALL = 1


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix of two strings of equal length."""
    if a == b:
        return len(a)
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "next", "sample")

    def __init__(self, depth: int, sample: int):
        self.depth, self.next, self.sample = depth, {}, sample


def blind_order(strings: list[bytes]) -> list[int]:
    """Order of the strings (all of one length; equal ones by place) by a blind trie."""
    if len(strings) == 2:
        return [0, 1] if strings[0] <= strings[1] else [1, 0]
    leaves: dict[int, list[int]] = {0: [0]}  # of equal strings, by the first of them
    root: _Node | int = 0
    for i in range(1, len(strings)):
        s = strings[i]
        at = root
        while type(at) is _Node:  # blind descent: only the branching bytes are looked at
            at = at.next.get(s[at.depth], at.sample)
        shared = common_prefix(s, strings[at])
        if shared == len(s):
            leaves[at].append(i)
            continue
        leaves[i] = [i]
        above, at = None, root
        while type(at) is _Node and at.depth < shared:
            above, at = at, at.next[s[at.depth]]
        if type(at) is _Node and at.depth == shared:
            at.next[s[shared]] = i
            continue
        sample = at.sample if type(at) is _Node else at
        node = _Node(shared, sample)
        node.next = {strings[sample][shared]: at, s[shared]: i}
        if above is None:
            root = node
        else:
            above.next[s[above.depth]] = node
    out: list[int] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if type(at) is _Node:
            stack.extend(at.next[c] for c in sorted(at.next, reverse=True))
        else:
            out.extend(leaves[at])
    return out


def _multikey(words: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Sorts the segments of ``order`` in place by their rows of symbols as far as the shallow depth; the segments still together there.

    One round parts every open segment in three by the median of its first, middle and last symbol; the middle part goes on
    to the next symbol.
    """
    limit, depth = min(SHALLOW, words.shape[1]), np.zeros(len(start), np.int64)
    deep: list[tuple[int, int]] = []
    while True:
        done = (depth >= limit) | (size <= SMALL)
        deep += [(a, a + k) for a, k in zip(start[done].tolist(), size[done].tolist(), strict=True) if k > 1]
        start, size, depth = start[~done], size[~done], depth[~done]
        if not len(start):
            return sorted(deep)
        of = np.repeat(np.arange(len(start)), size)
        first = np.cumsum(size) - size
        place = np.arange(len(of)) + (start - first)[of]
        row = order[place]
        symbol = words[row, depth[of]]
        pivot = np.sort(np.stack([symbol[first], symbol[first + size // 2], symbol[first + size - 1]]), axis=0)[1][of]
        side = 3 * of + (symbol >= pivot) + (symbol > pivot)
        turn = np.argsort(side, kind="stable")
        order[place] = row[turn]
        side = side[turn]
        cut = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        start, size, depth = place[cut], np.diff(np.concatenate([cut, [len(side)]])), depth[of[turn][cut]] + (side[cut] % 3 == 1)


def deep_shallow(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (uint8, all of one width divisible by 8) by (group, bytes), and common prefixes.

    The second array holds, for each place, the prefix shared with the place before; -1 where the group begins.
    """
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = rows.view(">u8")
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    deep = _multikey(words, order, start, np.diff(np.concatenate([start, [n]])))
    for a, b in deep:
        part = order[a:b]
        order[a:b] = part[blind_order([r.tobytes() for r in rows[part]])]
    shared = np.full(n, -1, np.int64)
    for k in range(1, n, 4096):
        x, y = rows[order[k : k + 4096]], rows[order[k - 1 : k - 1 + len(order[k : k + 4096])]]
        differs = x != y
        shared[k : k + 4096] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    shared[group[order] != np.concatenate([group[order][:1], group[order][:-1]])] = -1
    return order, shared
