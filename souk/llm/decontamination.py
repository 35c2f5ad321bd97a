"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are dealt into shards of at most about
``shard_words`` words (by a hash of the text, in Spark tasks); each task
builds one automaton over its items' words. Documents stream through the
automata: after every word the automaton knows the longest suffix that occurs
in some item. From that length follow all windows ending at the word: a window
is ``window`` consecutive item words, or a whole shorter item.

What is broadcast is one automaton per shard: its size is bounded by
``shard_words``, and a benchmark of more words gives more shards, applied one
after the other to the same row (each in its own Python process), never one
larger object. The corpus itself is never shuffled.

Words: A-Z lower-cased, then runs of characters that aren't ASCII, or are
ASCII digits or letters. Working on UTF-8 bytes is the same thing, as every
byte of a non-ASCII character is above 0x7F.

Defined cases: null or wordless texts have no words and no hits; null or
wordless items have no window; items with equal texts are all reported; a null
item_id counts as no item; an empty benchmark hits nothing; repeated documents
are judged row by row.
"""

from __future__ import annotations

import itertools
import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.common import WORD_ANY_CASE, fresh, text_batches
from souk.session import ship_package

WINDOW = 10
SHARD_WORDS = 500_000

_TABLE = bytes((b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32)
               for b in range(256))
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton over several word sequences, with the windows they contain."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        coded = []
        for item_id, words in items:
            if words:
                coded.append((item_id, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        for ids in dict.fromkeys(tuple(ids) for _, ids in coded):
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.min_window = min([window, *(len(ids) for _, ids in coded)])
        # state that holds a window's words -> items; by state and length for short items
        self.full: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}
        for item_id, ids in coded:
            state = length = 0
            for c in ids:
                state, length = self.step(state, length, c)
                if length >= window:
                    self.full.setdefault(self.holder(state, window), set()).add(item_id)
            if len(ids) < window:
                short.setdefault(self.holder(state, len(ids)), {}).setdefault(len(ids), set()).add(item_id)
        self.short = short
        self._chains: dict[int, list] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        to = self.next[state].get(c)
        while to is None and state:
            state = self.link[state]
            length = self.len[state]
            to = self.next[state].get(c)
        return (0, 0) if to is None else (to, length + 1)

    def holder(self, state: int, k: int) -> int:
        """The state of the suffix of k words of what ``state`` holds."""
        while self.len[self.link[state]] >= k:
            state = self.link[state]
        return state

    def chain(self, state: int) -> list:
        """(length, items) of every window that is a suffix of what ``state`` holds, longest first."""
        if (out := self._chains.get(state)) is None:
            out, s = [], state
            while s > 0:
                if self.len[s] >= self.window > self.len[self.link[s]] and s in self.full:
                    out.append((self.window, self.full[s]))
                out += sorted(self.short.get(s, {}).items(), reverse=True)
                s = self.link[s]
            self._chains[state] = out
        return out

    def match(self, words: list[bytes], mask: bytearray, found: set) -> int:
        """Mark in ``mask`` the words inside windows, add the items to ``found``; the longest match."""
        n, least, longest = len(words), self.min_window, 0
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), np.int64, n)
        gaps = np.concatenate(([-1], np.flatnonzero(ids < 0), [n]))
        lengths = np.diff(gaps) - 1
        for k in np.flatnonzero(lengths >= least):        # stretches of known words only
            at = int(gaps[k]) + 1
            state = length = 0
            step, chain = self.step, self.chain
            for c in ids[at:at + lengths[k]].tolist():
                state, length = step(state, length, c)
                at += 1
                if length >= least:
                    longest = max(longest, length)
                    for size, items in chain(state):
                        if size <= length:
                            mask[at - size:at] = b"\1" * size
                            found |= items
        return longest


def build_shards(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> list[bytes]:
    """Pickled automata over ``items`` (item_id, text), one per shard of bounded size."""
    ship_package(items.sparkSession)
    text_batches(items.sparkSession)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null and item_id is not null")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORD_ANY_CASE)))).first()[0] or 0
    shards = max(1, -(-total // shard_words))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted((i, words_of(t.encode())) for i, t in zip(pdf.item_id, pdf.text))
        return pd.DataFrame({"automaton": [pickle.dumps(Automaton(pairs, window))]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)))
    return [bytes(r.automaton) for r in dealt.groupBy("shard").applyInPandas(build, "automaton binary").toLocalIterator()]


_LOADED: dict[int, Automaton] = {}     # one automaton per Python process and broadcast


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
            then=None) -> tuple[DataFrame, list[str]]:
    """``docs`` plus columns (hit mask, hits, items, longest match, words); returns the frame and their names.

    The mask has one byte per word, 1 inside a window's occurrence; null
    without a hit. ``then`` (text, mask -> text) changes the texts with hits
    once every shard has been applied.
    """
    spark = docs.sparkSession
    names = fresh(docs, "_hit_mask", "_hit_count", "_hit_items", "_hit_longest", "_hit_words")
    kinds = ("binary", "long", "array<string>", "long", "long")
    out = docs.select("*", *[F.lit(None).cast(k).alias(c) for c, k in zip(names, kinds)])
    shards = build_shards(items, window, shard_words) or [pickle.dumps(Automaton([], window))]
    for k, packed in enumerate(shards):
        shared = spark.sparkContext.broadcast(packed)
        out = out.mapInArrow(_matcher(shared, names, then if k == len(shards) - 1 else None), out.schema)
    return out, names


def _matcher(shared, names, then):
    def run(batches):
        key = id(shared)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = pickle.loads(shared.value)
        automaton = _LOADED[key]
        for batch in batches:
            before = [batch.column(c).to_pylist() for c in (names[0], names[2], names[3])]
            made, texts = [], []
            for text, mask, items, longest in zip(batch.column("text"), *before):
                raw = text.as_buffer()
                words = words_of(raw.to_pybytes()) if raw is not None else []
                mask, found = bytearray(mask or len(words)), set(items or ())
                longest = max(longest or 0, automaton.match(words, mask, found))
                hits = mask.count(1)
                made.append((bytes(mask) if hits else None, hits, sorted(found), longest, len(words)))
                if then:
                    texts.append(then(text.as_py(), mask) if hits else text.as_py())
            cols = dict(zip(names, zip(*made))) if made else {}
            if then:
                cols["text"] = texts
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[c], batch.schema.field(c).type) if c in cols else batch.column(c)
                 for c in batch.schema.names], names=batch.schema.names)

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted), longest_match."""
    out, (_, hits, found, longest, words) = matched(docs.select("doc_id", "text"), items, window, shard_words)
    return out.select("doc_id", F.col(words).alias("n_words"), F.col(hits).alias("n_hit"),
                      F.size(found).cast("long").alias("n_items"), F.col(found).alias("items"),
                      F.col(longest).alias("longest_match"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without contaminated spans, same columns.

    Every maximal run of hit words (they match at least a whole window) is cut
    out together with what stands between its words; a document of which more
    than ``max_coverage`` of the words are hit goes. ``n_chars``, if the table
    has it, follows the new text. Documents without a hit stay as they are.
    """
    out, (mask, *_) = matched(docs, items, window, shard_words, then=lambda t, m: _cut(t, m, max_coverage))
    out = out.filter(F.col(mask).isNull() | F.col("text").isNotNull())
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(mask).isNull(), F.col("n_chars")).otherwise(n))
    return out.select(*docs.columns)


def _cut(text: str, mask: bytes, max_coverage: float) -> str | None:
    if mask.count(1) > max_coverage * len(mask):
        return None
    raw, parts, at, open_from = text.encode(), [], 0, None
    spans = [m.span() for m in _WORD_BYTES.finditer(raw)]
    for k, (a, b) in enumerate(spans):
        if mask[k] and open_from is None:
            open_from = a
        if mask[k] and (k + 1 == len(spans) or not mask[k + 1]):
            parts.append(raw[at:open_from])
            at, open_from = b, None
    return b"".join([*parts, raw[at:]]).decode()
