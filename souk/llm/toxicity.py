"""Toxicity scores from the nearest labelled examples.

A bounded sample of labelled documents is the set of examples
(``MAX_TOXIC`` + ``MAX_CLEAN`` rows, chosen by a hash; the only sampled thing
here). All words of the examples are features. A word's weight is its inverse
document frequency, counted over all documents, times 1 + G2 / ``LABEL_G2``,
where G2 is the log-likelihood ratio of the word and the label among the examples
(0 for words that rather speak for clean): what says nothing about the label still
counts in the cosine, what does counts more. A word that no example has can't
tell one example from another and is left out of a text's norm.

The examples' unit vectors form an inverted index. The ``FREQUENT`` words of most
examples are full rows, scored for a batch by one matrix product; every other
word's list is cut into blocks of ``BLOCK`` examples with the largest weight in each.
For a text the exact part plus a block's maxima bounds every similarity there; a
block whose bound is below the k-th best part can't hold a neighbour and its
postings are skipped, so the k nearest by cosine are exact (equal similarities:
the earlier example).

The neighbours vote with their similarity as weight, examples of a class
weighted by how thinly it was sampled, plus a small vote of the share found
among examples without a word. The votes are calibrated by a monotone fit
to the leave-one-out votes of the examples. Evidence: the nearest examples.

The whole corpus is read twice (frequencies, scores) and never shuffled. What
is gathered on the driver and broadcast are the examples' words and counts, at most
``MAX_TOXIC + MAX_CLEAN`` texts (one for each labelled id), and one frequency for each of their words.

Defined cases: null and empty texts, and texts without a known word, get the
score of such examples; equal texts get equal scores; an id with several texts
gives one example (the one with the least md5); null labels are left
out, contradicting ones of an id count as toxic; without any usable example
every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.common import fresh, stored, text_batches
from souk.llm.decontamination import words_of
from souk.session import ship_package

MAX_TOXIC, MAX_CLEAN = 1000, 2000       # bound of the sample of labelled rows
LABEL_G2, PRIOR = 5.0, 0.05
NEAREST, EVIDENCE = 15, 3
FREQUENT, BLOCK = 512, 64
BATCH_ROWS, BATCH_BYTES = 250, 4 << 20


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the given ranges one after the other, and the range each is from."""
    n = end - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + (start - np.cumsum(n) + n)[owner], owner


def label_weights(word: np.ndarray, toxic: np.ndarray, n_words: int, labels: np.ndarray) -> np.ndarray:
    """1 + G2 / ``LABEL_G2`` of each word; ``toxic`` is the label of the example that each entry of ``word`` is in."""
    n, t = float(len(labels)), float(labels.sum())
    a = np.bincount(word[toxic == 1], minlength=n_words).astype(float)
    b = np.bincount(word, minlength=n_words) - a

    def part(seen, row, column):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen * n / (row * column)), 0.0)

    g2 = 2 * (part(a, a + b, t) + part(b, a + b, n - t) + part(t - a, n - a - b, t) + part(n - t - b, n - a - b, n - t))
    return 1 + np.where(a * (n - t) > b * t, np.round(np.maximum(g2, 0), 9), 0) / LABEL_G2


class Model:
    """Examples as unit vectors in a block-max inverted index; built from bounded rows.

    Example i (ids[i], labels[i]) has the words ``word[start[i]:start[i + 1]]``, numbers into ``words``, with their counts.
    """

    def __init__(self, words: list[bytes], idf: np.ndarray, ids: list[str], labels: np.ndarray, start: np.ndarray,
                 word: np.ndarray, count: np.ndarray, shares: tuple[float, float] = (1.0, 1.0), nearest: int = NEAREST):
        self.nearest, self.shares = nearest, shares
        self.place = {w: i for i, w in enumerate(words)}
        n, label = len(ids), np.asarray(labels, float)
        owner = np.repeat(np.arange(n), np.diff(start))
        self.weight = idf * label_weights(word, label[owner], len(words), label) if n else np.zeros(0)
        value = (1 + np.log(count)) * self.weight[word]
        value = value / np.sqrt(np.bincount(owner, value * value, n))[owner]
        share = np.where(label == 1, shares[1], shares[0])
        empty = np.diff(start) == 0
        w0 = share[empty]
        usual = (share @ label) / share.sum() if n else 0.0
        self.base = float((w0 @ label[empty] + usual) / (w0.sum() + 1))
        # like examples share blocks: by their heaviest word
        heaviest = np.full(n, -1)
        order = np.lexsort((-word, value, owner))
        heaviest[owner[order]] = word[order]
        kept = np.flatnonzero(~empty)
        kept = kept[np.lexsort((kept, heaviest[kept]))]
        own = [(word[start[i]:start[i + 1]], value[start[i]:start[i + 1]]) for i in kept]
        number = np.full(n, -1)
        number[kept] = np.arange(len(kept))
        self.id, self.y, self.w = [ids[i] for i in kept], label[kept], share[kept]
        self.blocks = -(-len(kept) // BLOCK)
        example = number[owner]
        # the rows of frequent words
        spread = np.bincount(word, minlength=len(words))
        often = np.sort(np.argsort(-spread, kind="stable")[:FREQUENT])
        self.row = np.full(len(words), -1)
        self.row[often] = np.arange(len(often))
        self.full = np.zeros((len(often), self.blocks * BLOCK))
        is_often = self.row[word] >= 0
        self.full[self.row[word[is_often]], example[is_often]] = value[is_often]
        # the lists of the others: by word, then example; a cut begins where the word or the block changes
        word, example, value = word[~is_often], example[~is_often], value[~is_often]
        order = np.lexsort((example, word))
        word, self.example, self.value = word[order], example[order].astype(np.int32), value[order]
        block = self.example // BLOCK
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(new)
        self.cut = np.append(begin, len(word))
        self.cut_block = block[begin]
        self.cut_most = np.maximum.reduceat(self.value, begin) if len(begin) else np.zeros(0)
        self.cuts_of = np.searchsorted(word[begin], np.arange(len(words) + 1))
        self.knots = None
        self._calibrate(own)

    def query(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """The known words of a text and their weights, of length 1."""
        get = self.place.get
        word = np.array([get(w, -1) for w in counts], np.int64)
        there = word >= 0
        word, n = word[there], np.array(list(counts.values()), np.float64)[there]
        value = (1 + np.log(n)) * self.weight[word]
        return word, value / np.sqrt((value * value).sum() or 1.0)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, example numbers) of the k nearest of each query; -1 where there is none."""
        n, width = len(self.y), self.blocks * BLOCK
        sims, nums = np.zeros((len(queries), k)), np.full((len(queries), k), -1)
        if not n:
            return sims, nums
        often = np.zeros((len(queries), len(self.full)))
        for i, (word, value) in enumerate(queries):
            rows = self.row[word]
            often[i, rows[rows >= 0]] = value[rows >= 0]
        part = often @ self.full
        for i, (word, value) in enumerate(queries):
            s, rare = part[i], self.row[word] < 0
            word, value = word[rare], value[rare]
            cut, owner = ranges(self.cuts_of[word], self.cuts_of[word + 1])
            if len(cut):
                bound = np.bincount(self.cut_block[cut], self.cut_most[cut] * value[owner], self.blocks)
                least = np.partition(s, width - k)[width - k] if width > k else 0.0
                # a block whose bound is below the k-th best part can't hold a neighbour
                alive = s.reshape(self.blocks, BLOCK).max(axis=1) + bound >= least - 1e-9
                use = alive[self.cut_block[cut]]
                at, of = ranges(self.cut[cut[use]], self.cut[cut[use] + 1])
                s = s + np.bincount(self.example[at], self.value[at] * value[owner[use]][of], width)
            s = np.round(s[:n], 9)
            least = np.partition(s, n - k)[n - k] if n > k else 0.0
            best = np.flatnonzero((s >= least) & (s > 0))
            best = best[np.argsort(-s[best], kind="stable")[:k]]        # earlier examples first among equals
            sims[i, :len(best)], nums[i, :len(best)] = s[best], best
        return sims, nums

    def _votes(self, sims: np.ndarray, nums: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(sims), self.base)
        s = np.where(nums >= 0, sims, 0) * self.w[nums]
        return ((s * self.y[nums]).sum(axis=1) + PRIOR * self.base) / (s.sum(axis=1) + PRIOR)

    def _calibrate(self, own: list) -> None:
        """Monotone fit (pool adjacent violators) of the labels to the leave-one-out votes."""
        if not len(self.y):
            return
        found = [self.search(own[a:a + BATCH_ROWS], self.nearest + 1) for a in range(0, len(own), BATCH_ROWS)]
        sims, nums = (np.concatenate(x) for x in zip(*found))
        self_ = nums == np.arange(len(nums))[:, None]
        sims, nums = np.where(self_, 0, sims), np.where(self_, -1, nums)
        raw = self._votes(sims, nums)
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []                   # weight, label sum, vote sum
        for x, group in groupby(order, key=lambda i: round(raw[i], 9)):
            group = list(group)
            w, y = self.w[group].sum(), (self.w[group] * self.y[group]).sum()
            pools.append([w, y, w * x])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], last)]
        at = [p[2] / p[0] for p in pools]
        value = [(p[1] + 2 * x) / (p[0] + 2) for p, x in zip(pools, at)]
        self.knots = (np.array(at), np.maximum.accumulate(value))

    def score(self, texts: list[dict[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores in [0, 1] of texts given by their words' counts; similarities and numbers of their nearest examples."""
        queries = [self.query(c) for c in texts]
        rows = [i for i, q in enumerate(queries) if len(q[0])]
        out = np.full(len(texts), self.base)
        sims, nums = np.zeros((len(texts), self.nearest)), np.full((len(texts), self.nearest), -1)
        if rows and len(self.y):
            sims[rows], nums[rows] = self.search([queries[i] for i in rows], self.nearest)
            out[rows] = np.interp(self._votes(sims[rows], nums[rows]), *self.knots)
        return np.clip(np.round(out, 9), 0, 1), sims, nums

    def evidence(self, sims: np.ndarray, nums: np.ndarray) -> pa.ListArray:
        """The first ``EVIDENCE`` neighbours of each row as (doc_id, toxic, similarity)."""
        sims, nums = sims[:, :EVIDENCE], nums[:, :EVIDENCE]
        there = nums >= 0
        flat = pa.StructArray.from_arrays(
            [pa.array([self.id[j] for j in nums[there]], pa.string()), pa.array(self.y[nums[there]].astype(np.int32) if len(self.y) else [], pa.int32()),
             pa.array(sims[there], pa.float64())], names=["doc_id", "toxic", "similarity"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(there.sum(axis=1)))), pa.int32()), flat)


def word_counts(text: pa.StringScalar) -> dict[bytes, int]:
    raw = text.as_buffer()
    return Counter(words_of(raw.to_pybytes())) if raw is not None else {}


def sample_of(labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[DataFrame, tuple[float, float]]:
    """At most ``max_toxic`` + ``max_clean`` labelled ids outside the held-out fifth, and the classes' weights."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id is not null and toxic in (0, 1)").filter(~is_held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}     # two rows
    order = [F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("doc_id")]
    picked = [usable.filter(F.col("toxic") == t).orderBy(*order).limit(most) for t, most in ((0, max_clean), (1, max_toxic))]
    thin = {t: max(1.0, there.get(t, 0) / most) for t, most in ((0, max_clean), (1, max_toxic))}
    low = min(thin.values())
    return stored(picked[0].unionByName(picked[1]), "toxic-sample"), (thin[0] / low, thin[1] / low)


def _count_words(batches):
    """Per text its distinct words and their counts, as flat arrays."""
    for batch in batches:
        words, counts, per = [], [], [0]
        for text in batch.column("text"):
            found = word_counts(text)
            words += found
            counts += found.values()
            per.append(len(words))
        per = pa.array(per, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(per, pa.array(words, pa.binary())),
             pa.ListArray.from_arrays(per, pa.array(counts, pa.int64()))], names=["doc_id", "toxic", "words", "counts"])


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, nearest: int = NEAREST) -> Model:
    """The model: examples from the sample, frequencies of their words from all documents.

    One text stands for an id, and equal texts are one example. The driver gets, per
    example, its words and their counts, and per word its frequency.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text_batches(spark, BATCH_ROWS, BATCH_BYTES)
    sample, shares = sample_of(labels, max_toxic, max_clean)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")      # at most max_toxic + max_clean ids
    texts = texts.select("doc_id", F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("key"), "toxic", "text").alias("t"))
    texts = texts.groupBy("doc_id").agg(F.min("t").alias("t")).select(F.col("doc_id").cast("string").alias("doc_id"), "t.*")
    texts = texts.groupBy("key").agg(F.min(F.struct("doc_id", "toxic", "text")).alias("t")).select("t.*")
    found = texts.mapInArrow(_count_words, "doc_id string, toxic int, words array<binary>, counts array<bigint>").toArrow()
    found = found.sort_by("doc_id").combine_chunks()
    coded = pa.array(found.column("words").combine_chunks().flatten()).dictionary_encode()
    order = sorted(range(len(coded.dictionary)), key=(named := coded.dictionary.to_pylist()).__getitem__)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words = [named[i] for i in order]
    total, frequency = document_frequencies(docs, words)
    idf = np.log(1 + total / np.maximum(1, [frequency.get(w, 0) for w in words]))
    start = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(found.column("words")).to_numpy())))
    return Model(words, idf, found.column("doc_id").to_pylist(), found.column("toxic").to_numpy(), start, place[coded.indices.to_numpy()],
                 found.column("counts").combine_chunks().flatten().to_numpy(), shares, nearest)


def document_frequencies(docs: DataFrame, words: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each word, over all of ``docs``."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(words))       # words of the bounded sample

    def run(batches):
        counts, n, known = Counter(), 0, wanted.value
        for batch in batches:
            for text in batch.column("text"):
                raw = text.as_buffer()
                n += 1
                if raw is not None and known:
                    counts.update(known.intersection(words_of(raw.to_pybytes())))
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.binary()), pa.array([n, *counts.values()], pa.int64())],
                                         names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = rows.toArrow()                                                     # at most the sample's words and one row
    wanted.destroy()
    found = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))
    return found.pop(None, 0), found


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, **limits) -> tuple[DataFrame, list[str]]:
    """``docs`` plus a score and its evidence; returns the frame and the two columns' names."""
    spark = docs.sparkSession
    text_batches(spark, BATCH_ROWS, BATCH_BYTES)
    shared = spark.sparkContext.broadcast(model or fit(docs, labels, **limits))
    names = fresh(docs, "score", "evidence")
    kind = T.ArrayType(T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("toxic", T.IntegerType()),
                                     T.StructField("similarity", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], kind)])

    def run(batches):
        model = shared.value
        for batch in batches:
            scores, sims, nums = model.score([word_counts(t) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), model.evidence(sims, nums)],
                                             names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema), names


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **limits) -> DataFrame:
    """``docs`` with a score below ``limit``, same columns."""
    scored, (score, _) = score_toxicity(docs, labels, **limits)
    return scored.filter(F.col(score) < limit).select(*docs.columns)
