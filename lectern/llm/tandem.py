"""Periodic runs of words by the linear method of Gusfield and Stoye for tandem repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least max(min_words,
min_exponent * q) long, that no neighbouring word extends keeping period q. The texts of a slice of an Arrow batch are
searched together:

1. Words are numbered. A run has two occurrences of some window of W words (W = 16 for the default rules) q apart, and such
   windows cover it; so only stretches covered by windows that occur twice in their text are searched. The windows are
   compared by hashes, which can add stretches but lose none. The stretches, with a separator of its own behind each, make
   one string S.
2. The names of the blocks of 1, 2, 4, ... words give the suffix array of S and answer longest common extensions in both
   directions (`Extensions`).
3. Lempel-Ziv blocks of S: for each block, extensions at its borders yield a leftmost covering set of squares (two equal
   halves): every square's leftmost occurrence is reached from one of them by moving right.
4. The places of these squares in the suffix tree (intervals of common prefixes) start walks: a suffix link drops the first
   word, and a square moved by one exists if the tree goes on with that word. A walk ends where an earlier one passed. The
   visited places are the complete vocabulary of squares with a primitive root.
5. The leaves below a place are all occurrences of its square. Consecutive starts with one period merge into a run.

Every step is linear in the covered words but for logarithms of block names and of tree heights; memory likewise. Each text
is judged within its row: one scan, one projection, no shuffle, whatever the skew.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; repeated rows give repeated results;
an empty table an empty result; a text is handled whole, in a slice of its own if it is long; columns other than id and
text don't matter. Words are compared by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import coded_words, slices_of

#: Texts of about so many bytes are searched together.
SLICE_BYTES = 4 << 20
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


@dataclass(frozen=True)
class RunRules:
    """A run has min_words words and min_exponent periods at least. min_exponent must be 2 or more."""

    min_words: int = 24
    min_exponent: int = 3

    @property
    def window(self) -> int:
        """A run of length n and period q repeats each of its first n - q words q later, so many at least."""
        return max(1, self.min_words - self.min_words // self.min_exponent)


def _window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of so many words: a polynomial over mixed codes, put together from windows of powers of two."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    block, size, base = x ^ (x >> np.uint64(32)), 1, 0x9FB21C651E98DF25
    out, done = np.zeros(len(codes) - width + 1, np.uint64), 0
    while True:
        if width & size:
            out += np.uint64(pow(base, done, 1 << 64)) * block[done : done + len(out)]
            done += size
        if done == width:
            return out
        block = block[:-size] + np.uint64(pow(base, size, 1 << 64)) * block[size:]
        size *= 2


def repeated_stretches(codes: np.ndarray, at: np.ndarray, rules: RunRules) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches covered by windows that occur twice or more in their text, long enough for a run."""
    none, width = np.zeros(0, np.int64), rules.window
    if len(codes) < width:
        return none, none
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(doc[: len(codes) - width + 1] == doc[width - 1 :])
    keys = _window_hashes(codes, width)[start] ^ (doc[start].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return none, none
    # most windows occur once: a bit table leaves few to be looked up
    low, mask = np.zeros(1 << 20, bool), np.uint64((1 << 20) - 1)
    low[(twice & mask).astype(np.int64)] = True
    near = np.flatnonzero(low[(keys & mask).astype(np.int64)])
    place = np.minimum(np.searchsorted(twice, keys[near]), len(twice) - 1)
    start = start[near[twice[place] == keys[near]]]
    change = np.zeros(len(codes) + 1, np.int64)
    change[start] += 1
    change[start + width] -= 1
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    first = np.concatenate([[True], doc[1:] != doc[:-1], [True]])
    begins = np.flatnonzero(covered[1:] & (~covered[:-1] | first))
    ends = np.flatnonzero(covered[:-1] & (~covered[1:] | first))
    long = ends - begins >= rules.min_words
    return begins[long], ends[long]


class Extensions:
    """Longest common extensions in a string of numbers whose last one is unique, and its suffix array.

    names[l][i] is the rank of the block of 2**l numbers that starts at i, counted from 1 (0: behind the end).
    """

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        ranks = np.unique(s, return_inverse=True)[1] + 1
        self.names: list[np.ndarray] = []
        size = 1
        while ranks.max() < n:
            self.names.append(ranks.astype(np.int32))
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - size)] = ranks[size:]
            ranks = np.unique(ranks * np.int64(n + 1) + behind, return_inverse=True)[1] + 1
            size *= 2
        self.rank = (ranks - 1).astype(np.int64)
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[self.rank] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, i and j different."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            step = (self.names[level][a] == self.names[level][b]).astype(np.int64) << level
            a, b = a + step, b + step
        return a - i

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of the prefixes that end at i and j (inclusive; -1: the empty one)."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            back = (1 << level) - 1
            p, q = a - back, b - back
            fits = (p >= 0) & (q >= 0)
            same = fits & (self.names[level][np.maximum(p, 0)] == self.names[level][np.maximum(q, 0)])
            step = same.astype(np.int64) << level
            a, b = a - step, b - step
        return i - a

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each is the longest prefix of the rest that also starts earlier, or one number."""
        n, order = self.n, self.suffixes.tolist()
        before, after, stack = [-1] * n, [-1] * n, []
        for x in order:
            while stack and stack[-1] > x:
                after[stack.pop()] = x
            before[x] = stack[-1] if stack else -1
            stack.append(x)
        here, longest = np.arange(n), np.zeros(n, np.int64)
        for other in (np.array(before), np.array(after)):
            known = np.flatnonzero(other >= 0)
            longest[known] = np.maximum(longest[known], self.forward(here[known], other[known]))
        starts, at, sizes = [], 0, np.maximum(1, longest).tolist()
        while at < n:
            starts.append(at)
            at += sizes[at]
        return np.array(starts, np.int64)


def _counted_up(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: each element's group and its number in it, from 0."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def covering_squares(ext: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of squares from which moves to the right reach the leftmost occurrence of every square."""
    edges = np.append(ext.blocks(), ext.n)
    first, nxt = edges[:-1], edges[1:]
    after = np.append(edges[2:], ext.n)
    # squares that start in a block and end behind it
    block, k = _counted_up(nxt - first)
    k = k + 1
    border = nxt[block]
    inside = border < ext.n
    k, border = k[inside], border[inside]
    q = border - k
    right, left = ext.forward(border, q), ext.backward(border - 1, q - 1)
    good = (right + left >= k) & (right > 0)
    found = [(np.maximum(q - left, q - k + 1)[good], k[good])]
    # squares that start before a block and have their centre in it
    block, k = _counted_up(after - first)
    k = k + 1
    begin, end = first[block], nxt[block]
    inside = begin + k < ext.n
    k, begin, end = k[inside], begin[inside], end[inside]
    right, left = ext.forward(begin, begin + k), ext.backward(begin - 1, begin + k - 1)
    start = np.maximum(begin - left, begin - k + 1)
    good = (right + left >= k) & (right > 0) & (left > 0) & (start + k <= end)
    found.append((start[good], k[good]))
    pairs = np.unique(np.concatenate([s * (ext.n + 1) + k for s, k in found]))
    return pairs // (ext.n + 1), pairs % (ext.n + 1)


def _least_factors(n: int) -> np.ndarray:
    least = np.zeros(n + 1, np.int64)
    for p in range(2, int(n**0.5) + 1):
        if not least[p]:
            own = least[p * p :: p]
            own[own == 0] = p
    return np.where(least == 0, np.arange(n + 1), least)


def primitive(ext: Extensions, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the first half of each square isn't a power of a shorter string: no prime divides it into equal parts."""
    good = np.ones(len(start), bool)
    if not len(start):
        return good
    least, rest = _least_factors(int(half.max())), half.copy()
    while (open_ := np.flatnonzero(rest > 1)).size:
        p = least[rest[open_]]
        part = half[open_] // p
        good[open_] &= ext.forward(start[open_], start[open_] + part) < half[open_] - part
        while (more := rest[open_] % p == 0).any():
            rest[open_[more]] //= p[more]
    return good


class SuffixTree:
    """The suffix tree as intervals of the suffix array. Inner nodes are numbered from 0 (the root), leaf of rank r: inner + r."""

    def __init__(self, s: np.ndarray, ext: Extensions):
        self.s, self.ext, n = s, ext, ext.n
        common = ext.forward(ext.suffixes[:-1], ext.suffixes[1:]).tolist() if n > 1 else []
        depth, left, right, parent, of_leaf, stack = [0], [0], [n - 1], [0], [0] * n, [0]
        for r, x in enumerate(common):
            top = stack[-1]
            if x > depth[top]:
                node = len(depth)
                depth.append(x), left.append(r), right.append(0), parent.append(top)
                stack.append(node)
                of_leaf[r] = node
                continue
            of_leaf[r] = top
            while depth[top] > x:
                stack.pop()
                right[top], below = r, stack[-1]
                if depth[below] < x:
                    node = len(depth)
                    depth.append(x), left.append(left[top]), right.append(0), parent.append(below)
                    stack.append(node)
                    parent[top], top = node, node
                else:
                    parent[top], top = below, below
        of_leaf[n - 1] = stack[-1]
        for node in stack:
            right[node] = n - 1
        ranks = np.arange(n)
        self.inner = len(depth)
        self.depth = np.concatenate([np.array(depth, np.int64), n - ext.suffixes])
        self.left = np.concatenate([np.array(left, np.int64), ranks])
        self.right = np.concatenate([np.array(right, np.int64), ranks])
        self.parent = np.concatenate([np.array(parent, np.int64), np.array(of_leaf, np.int64)])
        self.above = [self.parent.astype(np.int32)]
        while self.above[-1].any():
            self.above.append(self.above[-1][self.above[-1]])

    def place(self, node: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The highest node on the way from node to the root whose string has this length at least."""
        for up in reversed(self.above):
            over = up[node]
            node = np.where(self.depth[over] >= length, over, node)
        return node

    def walks(self, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and lengths of all squares that suffix links reach from the given ones."""
        ext, n, inner = self.ext, self.ext.n, self.inner
        begin = self.place(inner + ext.rank[start], 2 * half)
        keys = np.unique(begin * np.int64(2 * n) + 2 * half)
        nodes = np.arange(1, inner)
        drop = ext.suffixes[self.left[nodes]] + 1
        links = [0, *self.place(inner + ext.rank[np.minimum(drop, n - 1)], self.depth[nodes] - 1).tolist()]
        # a walk asks for a node's children only at depths one below its length
        child = np.flatnonzero(np.isin(self.depth[self.parent], np.unique(2 * half - 1)))
        child = child[child != 0]
        own = self.parent[child]
        char = self.s[ext.suffixes[self.left[child]] + self.depth[own]]
        children = dict(zip(zip(own.tolist(), char.tolist()), child.tolist()))
        s, rank, depth, parent, rep = self.s.tolist(), ext.rank.tolist(), self.depth.tolist(), self.parent.tolist(), ext.suffixes[self.left].tolist()
        seen: set[int] = set()
        for key in keys.tolist():
            node, length = divmod(key, 2 * n)
            short = length - 1
            while key not in seen:
                seen.add(key)
                at = rep[node]
                a = s[at]
                to = links[node] if node < inner else inner + rank[at + 1]
                while depth[parent[to]] >= short:
                    to = parent[to]
                if depth[to] == short:
                    to = children.get((to, a))
                    if to is None:
                        break
                elif s[rep[to] + short] != a:
                    break
                node, key = to, to * 2 * n + length
        found = np.fromiter(seen, np.int64, len(seen))
        return found // (2 * n), found % (2 * n)


def runs_of(s: np.ndarray, rules: RunRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of a string of numbers whose last one is unique."""
    none = np.zeros(0, np.int64)
    ext = Extensions(s)
    start, half = covering_squares(ext)
    kept = primitive(ext, start, half)
    start, half = start[kept], half[kept]
    if not len(start):
        return none, none, none
    tree = SuffixTree(s, ext)
    node, length = tree.walks(start, half)
    square, k = _counted_up(tree.right[node] - tree.left[node] + 1)
    # every occurrence of every square: period, then start
    located = np.sort(length[square] // 2 * (ext.n + 1) + ext.suffixes[tree.left[node][square] + k])
    cut = np.flatnonzero(np.diff(located) != 1) + 1
    begins, ends = np.append(0, cut), np.append(cut, len(located))
    period, first = located[begins] // (ext.n + 1), located[begins] % (ext.n + 1)
    size = ends - begins - 1 + 2 * period
    good = (size >= rules.min_words) & (size >= rules.min_exponent * period)
    return first[good], size[good], period[good]


def runs_in_texts(codes: np.ndarray, at: np.ndarray, rules: RunRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (among all words), length and period of the runs of texts with these offsets, by start, then period."""
    begins, ends = repeated_stretches(codes, at, rules)
    if not len(begins):
        return begins, begins, begins
    # a stretch and its separator; numbers above the codes are the separators
    sizes = ends - begins + 1
    stretch, k = _counted_up(sizes)
    separator = k == sizes[stretch] - 1
    source = np.where(separator, 0, begins[stretch] + k)
    s = np.where(separator, codes.max() + 1 + stretch, codes[source])
    first, length, period = runs_of(s, rules)
    first = source[first]
    order = np.lexsort((period, first))
    return first[order], length[order], period[order]


def _searched(rules: RunRules):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices_of(batch, 1, SLICE_BYTES):
                split, at, codes, _ = coded_words(own.column(1).cast(pa.binary()).to_pylist())
                first, length, period = runs_in_texts(codes, at, rules)
                text = np.searchsorted(at, first, side="right") - 1
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, first + period, 1)
                np.add.at(change, first + length, -1)
                dropped = np.cumsum(change) > 0
                edited = set(text.tolist())
                kept = [b" ".join(compress(words, (~dropped[at[k] : at[k + 1]]).tolist()) if k in edited else words) for k, words in enumerate(split)]
                rows = pa.StructArray.from_arrays([pa.array(first - at[text]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(at))), pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.diff(at)), lists, pa.array(kept, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, rules: RunRules = RunRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period; start is a word number) and collapsed.

    collapsed is the text's words joined by one space without the words that some run contains after its first period.
    """
    if rules.min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_searched(rules), RUNS)


def _best(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones the first by start, then period. Null without runs."""
    better = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda x, y: F.when(better(x, y), y).otherwise(x))


def run_digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs: number of runs, the run of greatest exponent, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = found.withColumn("best", _best(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
