"""SentencePiece (merge type) encoding by a prefix table, and decoding.

For a merge vocabulary the encoding of every prefix of a text ends in one
certain token, and a token ends the encoding of a prefix exactly if it is
compatible with the token that ends the encoding of what stands before it: the
two side by side are the encoding of their joint string. So an automaton over
the pieces reports all pieces that end at a place, longest first, the first
compatible one is stored as the prefix's last token, and the ids are read
backwards from the end of the table.

A text is cut where no piece can reach across (before a space mark that follows
another character; ``Vocabulary`` checks that no piece holds such a place), so
the table is built per chunk, and equal chunks of a task are encoded once (the
memo is bounded). One chunk may be the whole text: time and memory are linear in it.

The model file is read through Spark (so any shared store works) and broadcast;
its size is checked against ``MAX_MODEL``. Rows are independent: no shuffle, and
a lost executor's rows are encoded again with the same result.

Defined cases: null and empty texts have the begin and end ids only; piece
strings of control ids are ordinary text; characters without a piece become
their bytes' pieces; equal rows give equal rows; an empty table gives an empty
result; columns that the result replaces are dropped, others are kept; models
that aren't merge type, that normalise or that hold user-defined pieces raise.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.common import fresh, text_batches
from souk.session import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL = 64 << 20
MEMO_CHUNKS, MEMO_CHARS = 300_000, 48     # chunks remembered in each of two generations, and their longest
SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6      # piece types of the file format


class Vocabulary:
    """The pieces of a model with their automaton and the pair test."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2:
            raise ValueError("the prefix table needs a merge-type model")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("models that normalise texts aren't supported")
        if any(p.type == USER_DEFINED for p in spec.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.cuts = not any(a != SPACE and b == SPACE for p in self.pieces for a, b in zip(p, p[1:]))
        # a piece that isn't its own encoding never occurs
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            if self.merge(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}        # the chunks met lately, and those before them
        self.older: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The encoding of a short string by its merges: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[s], i) for i in range(len(parts) - 1) if (s := parts[i] + parts[i + 1]) in self.score]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def last_tokens(self, text: str) -> list[str]:
        """For every prefix of ``text`` (by its length less one) the last token of its encoding."""
        table = list(text)              # a character without a piece stands alone
        known, done = self.pairs, -1
        for at, piece in self.automaton.iter(text):     # by their end, longest first
            if at != done:
                before = at - len(piece)
                if before < 0:
                    table[at], done = piece, at
                else:
                    left = table[before]
                    fits = known.get((left, piece))
                    if fits is None:
                        fits = self.compatible(left, piece)
                    if fits:
                        table[at], done = piece, at
        return table

    def chunk_ids(self, chunk: str) -> list[int]:
        table, out, i = self.last_tokens(chunk), [], len(chunk) - 1
        while i >= 0:
            piece = table[i]
            i -= len(piece)
            known = self.pieces.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(piece.encode()))
            else:
                out.append(self.unknown)
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        text = self.prefix + text.replace(" ", SPACE)
        out, memo = [], self.memo
        for chunk in CHUNK.findall(text) if self.cuts else [text]:
            ids = memo.get(chunk)
            if ids is None:
                ids = self.older.get(chunk)
                if ids is None:
                    known = self.chunk_ids(chunk)
                    ids = struct.pack(f"<{len(known)}I", *known)
                if len(chunk) <= MEMO_CHARS:
                    if len(memo) >= MEMO_CHUNKS:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def frame(self, text: str | None) -> bytes:
        """``encode`` between the begin and the end id."""
        return np.array([self.begin], "<u4").tobytes() + self.encode(text or "") + np.array([self.end], "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_VOCABULARIES: dict = {}


def _vocabulary(key: str, model) -> Vocabulary:
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(model.value)
    return _VOCABULARIES[key]


def _broadcast(df: DataFrame, path: str):
    spark = df.sparkSession
    ship_package(spark)
    text_batches(spark, 200)
    size, content = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if size > MAX_MODEL:
        raise ValueError(f"{path} has {size} bytes; the broadcast allows {MAX_MODEL}")
    return spark.sparkContext.broadcast(bytes(content))


def encode(docs: DataFrame, model: str = MODEL, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (begin and end ids included) as packed integers in ``column``."""
    held = _broadcast(docs, model)

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        v = _vocabulary(model, held)
        return texts.map(v.frame)

    return docs.select(*[c for c in docs.columns if c.lower() != column.lower()], ids("text").alias(column))


def decode(coded: DataFrame, model: str = MODEL, ids: str = "ids", column: str = "text") -> DataFrame:
    """``coded`` with the text of its packed ``ids`` in ``column``; null ids are a null text."""
    held = _broadcast(coded, model)

    @F.pandas_udf("string")
    def text(packed: pd.Series) -> pd.Series:
        v = _vocabulary(model, held)
        return packed.map(lambda b: None if b is None else v.decode(b))

    return coded.select(*[c for c in coded.columns if c.lower() != column.lower()], text(ids).alias(column))


def digests(docs: DataFrame, model: str = MODEL) -> tuple[DataFrame, str]:
    """``docs`` without its texts plus a struct (n_tokens, ids_sha256, decoded_sha256), and its name.

    Encodes and decodes in one pass, so neither ids nor texts leave the task."""
    held = _broadcast(docs, model)
    name, = fresh(docs, "coded")
    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    @F.pandas_udf(schema)
    def coded(texts: pd.Series) -> pd.DataFrame:
        v = _vocabulary(model, held)
        rows = []
        for t in texts:
            ids = v.frame(t)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], coded("text").alias(name)), name
