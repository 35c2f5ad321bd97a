"""Periodic runs of words by maximal pairs, and their collapse.

A maximal pair is two equal stretches of words that neither the word before nor
the word behind extends. If its distance q is at most its length l, the words
from the first start to the second end are a stretch with period q that nothing
extends: a run. So the runs are read off the pairs; no candidate is extended.

The pairs come from the LCP-interval tree of the text's suffixes, bottom up:

* prefix doubling over word numbers sorts the suffixes; only places whose first
  four words occur again go on, as a run of ``MIN_LENGTH`` words or more needs
  a pair of ``MIN_LENGTH / 2`` words or more;
* every interval keeps its places in ascending order together with the heads of
  the stretches of equal left words, so from any place the next one with another
  left word is found without visiting those in between;
* a smaller child's places look for partners in the larger one at a distance of
  at most the interval's length, then move into it. All partners found are
  maximal (other left word, other child), so the work is O(n log n) searches
  plus the pairs, and those are at most the sum of the runs' exponents.

Of equal stretches the smallest distance is the run's period. A collapsed text
loses each run's words after its first period.

Rows are independent: the texts' words stay in the row's task, nothing is
shuffled, and a lost executor's rows are computed again with the same result.

Defined cases: null, empty and wordless texts have no run and collapse to the
empty text; equal rows give equal rows; an empty table gives an empty result;
ties of the longest run go to the smallest start, then period; a text of equal
words is one run of period 1; columns with names that the result takes are
kept, the result's get another name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.common import fresh, text_batches
from souk.session import ship_package

MIN_LENGTH = 12
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_CHUNK = 512


class Places:
    """A sorted set of integers in chunks of bounded length."""

    def __init__(self, values: list[int]):
        self.chunks = [values[i:i + _CHUNK] for i in range(0, len(values), _CHUNK)]
        self.last = [c[-1] for c in self.chunks]

    def __iter__(self):
        for c in self.chunks:
            yield from c

    def add(self, x: int) -> None:
        if not self.chunks:
            self.chunks, self.last = [[x]], [x]
            return
        k = min(bisect_left(self.last, x), len(self.last) - 1)
        chunk = self.chunks[k]
        insort(chunk, x)
        self.last[k] = chunk[-1]
        if len(chunk) > 2 * _CHUNK:
            self.chunks[k:k + 1] = [chunk[:_CHUNK], chunk[_CHUNK:]]
            self.last[k:k + 1] = [chunk[_CHUNK - 1], chunk[-1]]

    def remove(self, x: int) -> None:
        k = bisect_left(self.last, x)
        chunk = self.chunks[k]
        del chunk[bisect_left(chunk, x)]
        if chunk:
            self.last[k] = chunk[-1]
        else:
            del self.chunks[k], self.last[k]

    def after(self, x: int) -> int | None:
        """The smallest member above ``x``."""
        k = bisect_right(self.last, x)
        if k == len(self.last):
            return None
        chunk = self.chunks[k]
        return chunk[bisect_right(chunk, x)]

    def before(self, x: int) -> int | None:
        """The largest member below ``x``."""
        k = min(bisect_left(self.last, x), len(self.last) - 1)
        if k < 0:
            return None
        i = bisect_left(self.chunks[k], x)
        if i:
            return self.chunks[k][i - 1]
        return self.last[k - 1] if k else None


class Interval:
    """The places below one node of the tree, with the heads of the stretches of equal left words."""

    def __init__(self, place: int):
        self.size = 1
        self.places = Places([place])
        self.heads = Places([place])

    def add(self, x: int, left: list[int]) -> None:
        p, s = self.places.before(x), self.places.after(x)
        self.places.add(x)
        self.size += 1
        head = p is None or left[p] != left[x]
        if head:
            self.heads.add(x)
        if s is not None:
            was, now = p is None or left[p] != left[s], left[x] != left[s]
            if was and not now:
                self.heads.remove(s)
            elif now and not was:
                self.heads.add(s)

    def partners(self, x: int, reach: int, left: list[int]):
        """The places at most ``reach`` from ``x`` with another left word."""
        c, y = left[x], self.places.after(x)
        while y is not None and y <= x + reach:
            if left[y] == c:
                y = self.heads.after(y)
            else:
                yield y
                y = self.places.after(y)
        y = self.places.before(x)
        while y is not None and y >= x - reach:
            if left[y] == c:
                y = self.places.before(self.heads.before(y + 1))
            else:
                yield y
                y = self.places.before(y)


def _paired(rank: np.ndarray, step: int, at: np.ndarray) -> np.ndarray:
    """For the places ``at``: their rank and the rank ``step`` words on, as one number."""
    n = len(rank)
    behind = at + step
    second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
    return rank[at].astype(np.int64) * (n + 1) + second + 1


def repeated_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose first four words occur again, in the order of their suffixes, and the
    length of the prefix each shares with the one before it (0 for the first)."""
    n = len(words)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    rank, levels, at, step = words.astype(np.int64), [], np.arange(n), 1
    while len(at):
        levels.append(rank)
        key = _paired(rank, step, at)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank = rank.copy()
        if step == 1:
            rank[at[order]] = first
        else:           # a group's ranks start at its old one; its places lie together in the order
            group = rank[at[order]]
            begins = np.empty(len(at), bool)
            begins[0] = True
            np.not_equal(group[1:], group[:-1], out=begins[1:])
            rank[at[order]] = group + first - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        step *= 2
        single = new & np.append(new[1:], True)
        again = order[~single]
        if step == 4:
            if not len(again):
                return none
            kept = np.sort(at[again])
        at = np.sort(at[again])
        if step < 4 and not len(at):
            return none
    if step < 4:
        return none
    order = kept[np.argsort(rank[kept], kind="stable")]
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(len(order), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        a += step
        b += step
        shared[1:] += step
    return order, shared


def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ``words`` are word numbers;
    ``min_length`` is 7 at least, as pairs of fewer than four words aren't kept."""
    if min_length < 7:
        raise ValueError("runs of fewer than seven words aren't found")
    if len(words) < min_length:
        return []
    order, shared = repeated_suffixes(words)
    if not len(order):
        return []
    least = max(4, (min_length + 1) // 2)
    left = [-1, *words[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}

    def join(big: Interval, small: Interval, length: int) -> Interval:
        if big.size < small.size:
            big, small = small, big
        for x in small.places:
            for y in big.partners(x, length, left):
                q = abs(x - y)
                if length + q >= min_length:
                    run = min(x, y), length + q
                    if q < found.get(run, q + 1):
                        found[run] = q
        for x in small.places:
            big.add(x, left)
        return big

    # the open intervals, outermost first: (length of the shared prefix, places so far)
    places, lengths = order.tolist(), shared.tolist()
    ends = np.flatnonzero(shared < least).tolist() + [len(places)]
    for begin, end in zip(ends[:-1], ends[1:]):
        if end - begin < 2:
            continue
        stack: list[tuple[int, Interval]] = []
        last = Interval(places[begin])
        for i in range(begin + 1, end):
            length = lengths[i]
            while stack and stack[-1][0] > length:
                deeper, held = stack.pop()
                last = join(held, last, deeper)
            if stack and stack[-1][0] == length:
                stack[-1] = (length, join(stack[-1][1], last, length))
            else:
                stack.append((length, last))
            last = Interval(places[i])
        while stack:
            deeper, held = stack.pop()
            last = join(held, last, deeper)
    return sorted((start, length, q) for (start, length), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run contains behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def analyse(text: str | None, min_length: int = MIN_LENGTH) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The words of ``text`` and its runs."""
    words = _WORDS.findall(text or "")
    if len(words) < min_length:
        return words, []
    numbers: dict[str, int] = {}
    return words, runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), min_length)


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` plus every run (array of start, length, period) and the collapsed text; their names."""
    ship_package(docs.sparkSession)
    text_batches(docs.sparkSession, 200)
    schema = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    @F.pandas_udf(schema)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words, runs = analyse(t, min_length)
            if runs:
                words = [w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k]
            rows.append(([dict(zip(RUN.names, r)) for r in runs], " ".join(words)))
        return pd.DataFrame(rows, columns=schema.names)

    both, runs, collapsed = fresh(docs, "found", "runs", "collapsed")
    out = docs.withColumn(both, found("text"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{both}.runs").alias(runs),
                      F.col(f"{both}.collapsed").alias(collapsed)), (runs, collapsed)


def summaries(docs: DataFrame, min_length: int = MIN_LENGTH) -> tuple[DataFrame, str]:
    """``docs`` without its texts plus a struct of the runs' number, the longest run and the digests of
    all runs and of the collapsed text, and its name. Neither texts nor runs leave the task."""
    ship_package(docs.sparkSession)
    text_batches(docs.sparkSession, 200)
    names = ["n_runs", "start", "length", "period", "exponent_milli"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names]
                          + [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")])

    @F.pandas_udf(schema)
    def summary(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words, runs = analyse(t, min_length)
            best = [None] * 4
            if runs:
                start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
                best = [start, length, q, 1000 * length // q]
                words = [w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k]
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            rows.append([len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(),
                         hashlib.sha256(" ".join(words).encode()).hexdigest()])
        out = pd.DataFrame(rows, columns=schema.names)
        return out.astype({n: "Int64" for n in names})

    name, = fresh(docs, "summary")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], summary("text").alias(name)), name
