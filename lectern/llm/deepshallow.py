"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries for the groups left."""

from __future__ import annotations

SYMBOL = 8


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    differing = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return n - (differing.bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie that keeps branching depths and characters only.

    A string descends by the characters at branching depths, blind to what lies between; one comparison with the leaf it
    reaches gives the depth at which it leaves the trie. -1 stands for the end of a string and sorts first.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, branches = node
            node = branches.get(self._at(s, depth)) or next(iter(branches.values()))
        other = self.strings[node[0]]
        depth = lcp(s, other)
        if depth == len(s) == len(other):
            node.append(k)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = (node[1], self._at(s, node[0])), node[1][self._at(s, node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._at(s, depth)] = [k]
            return
        new = (depth, {self._at(s, depth): [k], self._at(other, depth): node})
        if above:
            above[0][above[1]] = new
        else:
            self.root = new

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow_order(strings: list[bytes], shallow: int = 16, start: int = 0) -> list[int]:
    """Indices in sorted order; equal strings keep their order. All strings share their first `start` bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), start)]
    while stack:
        own, depth = stack.pop()
        if len(own) < 2:
            out += own
            continue
        if depth >= start + shallow:
            trie = BlindTrie(strings)
            for k in own:
                trie.add(k)
            out += trie.order()
            continue
        # three-way split of multikey quicksort, with eight bytes as one symbol
        symbol = [strings[k][depth : depth + SYMBOL] for k in own]
        pivot = symbol[len(own) // 2]
        less = [k for k, x in zip(own, symbol) if x < pivot]
        same = [k for k, x in zip(own, symbol) if x == pivot]
        more = [k for k, x in zip(own, symbol) if x > pivot]
        stack.append((more, depth))
        if len(pivot) < SYMBOL:
            stack += [([k], depth) for k in reversed(same)]
        else:
            stack.append((same, depth + SYMBOL))
        stack.append((less, depth))
    return out


def neighbour_lcps(strings: list[bytes], order: list[int]) -> list[int]:
    """For each place in the order the common prefix with the place before; 0 for the first."""
    return [0, *(lcp(strings[a], strings[b]) for a, b in zip(order, order[1:]))] if order else []
