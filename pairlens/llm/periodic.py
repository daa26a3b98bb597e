"""Periodic runs of words: suffix automaton with link-cut access.

A run is a stretch of words with smallest period q and at least max(min_words, min_periods * q) words that no
neighbour extends. In each stretch of a text that can hold one (see below) the runs are found so:

1. The suffix automaton of the stretch gives the tree of suffix links: the path from a prefix's state to the root
   holds all suffixes of that prefix, grouped by where they end.
2. Words are appended one by one. Access in a link-cut tree makes the path of the new prefix preferred; on the way
   it meets the preferred paths of before, each with one colour: the place where its suffixes ended last.
3. A path segment whose longest suffix has `length` words and ended last at `j` before `i` is a square if the
   distance d = i - j is at most `length`: the words from i - length - d + 1 to i have period d. It is extended to
   both sides as far as the words allow. d is the smallest period there, or a shorter distance would be newer.
4. The path takes the colour i.

Every run of two periods or more is found at the end of its first square; the colour changes of n words are
O(n log n). Words that cannot lie in a run are left out first: a run of at least 4 periods and 6 words has only
4-grams that occur again within a quarter of the stretch. So a text is cut where a 4-gram has no equal one that
near, and the parts are cut again until nothing changes. No run is lost, as no run holds a cut.

Memory: a task holds one batch of texts, and for one stretch of n words the automaton (about 1 KB a word).
Defined results: null, empty and blank texts have no words and no runs; texts of any length are read whole;
rows are independent, so ties, repeated rows and rows without doc_id are rows like others; an empty table gives an
empty table. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import textops as X
from pairlens.llm.common import map_batches

MIN_WORDS, MIN_PERIODS = 6, 4
GRAM = 4


def word_ids(words: list[bytes]) -> np.ndarray:
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))


def _gram_ranks(ids: np.ndarray) -> np.ndarray:
    """Equal numbers for equal runs of GRAM words."""
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    return np.unique(pairs[:-2] * (int(pairs.max()) + 1) + pairs[2:], return_inverse=True)[1]


def stretches(ids: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int]]:
    """Disjoint [start, end) that hold all runs, in order."""
    if len(ids) < min_words:
        return []
    ranks, out, todo = _gram_ranks(ids), [], [(0, len(ids))]
    while todo:
        start, end = todo.pop()
        n = end - start - GRAM + 1
        part = ranks[start : start + n]
        order = np.argsort(part, kind="stable")
        gap = np.diff(order)
        near = (part[order[1:]] == part[order[:-1]]) & (gap <= (end - start) // min_periods)
        again = np.zeros(n + 2, bool)
        again[1 + order[1:][near]] = again[1 + order[:-1][near]] = True
        edges = np.flatnonzero(again[1:] != again[:-1]).reshape(-1, 2)
        parts = [(start + int(a), start + int(b) + GRAM - 1) for a, b in edges if b - a + GRAM - 1 >= min_words]
        if parts == [(start, end)]:
            out.append((start, end))
        else:
            todo += parts
    return sorted(out)


class LinkTree:
    """Suffix links of the automaton of a word sequence: per state the longest suffix and the link; `ends` are the states of the prefixes."""

    def __init__(self, ids: list[int]):
        self.longest, self.link, self.ends = [0], [-1], []
        following: list[dict[int, int]] = [{}]
        longest, link, last = self.longest, self.link, 0
        for c in ids:
            new = len(longest)
            longest.append(longest[last] + 1)
            link.append(0)
            following.append({})
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                if longest[q] == longest[p] + 1:
                    link[new] = q
                else:
                    twin = len(longest)
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    following.append(following[q].copy())
                    link[q] = link[new] = twin
                    while p >= 0 and following[p].get(c) == q:
                        following[p][c] = twin
                        p = link[p]
            last = new
            self.ends.append(new)


class PathColours:
    """Link-cut tree over fixed links: access(v, colour) recolours the path from v to the root.

    Preferred paths are splay trees ordered by depth; the root of a splay tree holds the colour of its path.
    """

    def __init__(self, parent: list[int]):
        self.up = list(parent)  # splay parent, or the parent of the path's top for a splay root
        self.left, self.right, self.colour = [-1] * len(parent), [-1] * len(parent), [-1] * len(parent)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            moved = left[p] = right[x]
            right[x] = p
        else:
            moved = right[p] = left[x]
            left[x] = p
        if moved >= 0:
            up[moved] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
            else:
                self.colour[x] = self.colour[p]  # x is the new root of its splay tree
        else:
            self.colour[x] = self.colour[p]

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """(deepest state, colour before) of every coloured path segment between v and the root."""
        segments, below, x = [], -1, v
        up, right, colours = self.up, self.right, self.colour
        while x >= 0:
            self._splay(x)
            if colours[x] >= 0:
                segments.append((x, colours[x]))
            deeper = right[x]
            if deeper >= 0:
                colours[deeper] = colours[x]  # cut off, it keeps its colour
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return segments


def find_runs(ids: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period."""
    tree = LinkTree(ids)
    paths, longest, n = PathColours(tree.link), tree.longest, len(ids)
    reach: dict[int, int] = {}  # period -> end of the last stretch found with it
    runs = []
    for i, state in enumerate(tree.ends):
        for node, j in paths.access(state, i):
            d = i - j
            if longest[node] >= d and reach.get(d, 0) <= i:
                start, end = i - longest[node] - d + 1, i + 1
                while start > 0 and ids[start - 1] == ids[start - 1 + d]:
                    start -= 1
                while end < n and ids[end] == ids[end - d]:
                    end += 1
                reach[d] = end
                if end - start >= max(min_words, min_periods * d):
                    runs.append((start, end - start, d))
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def text_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    return [(start + s, length, period) for start, end in stretches(ids) for s, length, period in find_runs(ids[start:end].tolist())]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def repeat_tail(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words of a text, of which every tenth by the checksum of its doc_id gets a periodic tail."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length, period by start and period), collapsed (text of the kept words, joined by a space).

    planted: first give texts the tails of repeat_tail; rows without doc_id get none.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def build():
        def work(batch):
            rows = []
            data, offsets = X.text_buffer(batch.column(1))
            data, offsets = data.tobytes(), offsets.tolist()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                words = data[offsets[i] : offsets[i + 1]].split()
                if planted and doc_id is not None:
                    words = repeat_tail(words, doc_id)
                runs = text_runs(word_ids(words))
                rows.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(collapsed(words, runs))))
            n, runs, texts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, build, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_report(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run (ties: smallest start, then period) with its exponent, digests of runs and kept words."""
    rows = periodic_runs(docs, planted)
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
        F.expr("(1000 * b.length) DIV -b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
