"""Sorting fixed-length prefixes of suffixes by the deep-shallow scheme.

Shallow: multikey quicksort on eight bytes at a time, all groups at once, for SHALLOW bytes. Deep: a group that still
agrees is ordered by a blind trie, whose nodes keep only the depth at which their suffixes part and the byte there, so
a suffix is compared with one other suffix only, however long the common prefix.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


class BlindTrie:
    """Strings in order; equal strings share a leaf. Strings must have one length."""

    def __init__(self) -> None:
        self.root: list | None = None  # a leaf is [string, ids]; a node is [depth, {byte: child}]

    def add(self, string: bytes, ident: int) -> None:
        if self.root is None:
            self.root = [string, [ident]]
            return
        node, path = self.root, []
        while isinstance(node[0], int):
            path.append(node)
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == string:
            node[1].append(ident)
            return
        depth = next(i for i, (a, b) in enumerate(zip(other, string)) if a != b)
        above = [n for n in path if n[0] < depth]
        at = path[len(above)] if len(above) < len(path) else node
        leaf = [string, [ident]]
        if isinstance(at[0], int) and at[0] == depth:
            at[1][string[depth]] = leaf
            return
        fresh = [depth, {other[depth]: at, string[depth]: leaf}]
        if above:
            above[-1][1][other[above[-1][0]]] = fresh
        else:
            self.root = fresh

    def leaves(self) -> list[list]:
        """[string, ids] in order of the strings."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node[0], int):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffix numbers in order of their first `length` bytes, and for each place a number equal for equal strings.

    Every suffix must have `length` bytes.
    """
    n = len(starts)
    order, rank = np.arange(n), np.zeros(n, np.int64)  # rank by place: where the group of the place begins
    active = np.arange(n)
    depth = 0
    step = np.arange(8, dtype=np.int64)
    while depth < min(shallow, length) and len(active):
        width = min(8, length - depth)
        word = np.zeros(len(active), np.uint64)
        at = starts[order[active]] + depth
        for k in step[:width]:
            word = (word << np.uint64(8)) | data[at + k]
        by = np.lexsort((word, rank[active]))
        order[active], word, ranks = order[active][by], word[by], rank[active][by]
        fresh = np.ones(len(active), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (ranks[1:] != ranks[:-1])
        heads = np.flatnonzero(fresh)
        rank[active] = active[heads][np.cumsum(fresh) - 1]
        alone = np.diff(np.append(heads, len(active))) == 1
        active = active[~alone[np.cumsum(fresh) - 1]]
        depth += width
    if depth < length and len(active):
        raw, ranks = data.tobytes(), rank[active]
        heads = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
        places, suffix = active.tolist(), (starts[order[active]] + depth).tolist()
        rest, numbers = length - depth, order[active].tolist()
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(places)]):
            tails: dict[bytes, list[int]] = {}
            for j in range(lo, hi):
                tails.setdefault(raw[suffix[j] : suffix[j] + rest], []).append(numbers[j])
            if len(tails) == 1:
                continue
            trie = BlindTrie()
            for tail in tails:
                trie.add(tail, 0)
            at = lo
            for tail, _ in trie.leaves():
                for number in tails[tail]:
                    order[places[at]], rank[places[at]] = number, places[at] if number == tails[tail][0] else rank[places[at - 1]]
                    at += 1
    return order, rank
