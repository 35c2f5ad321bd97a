import hashlib
import random
import time

import numpy as np
import sentencepiece
from hypothesis import given, settings, strategies as st

from souk.llm import sentencepiece_codec as sc
from souk.llm.queries import QUERIES

MODEL = open(sc.MODEL, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
VOCABULARY = sc.Vocabulary(MODEL)
TEXTS = ["", None, " ", "   ", "a", " a", "a ", "Hello  world\n\n x\t\r y", "<s> </s> <unk> <0x41>", "▁▁ a ▁b", "\x00\x01", "é😀ß벨ゼ",
         "日本語のテキスト", "�​﻿", "aaaaaaaaaaaaaaaaaaaaaaaa", "the theatre" * 40, " " * 999, "x" * 4001, "a a", "a a"]


def ids_of(text):
    return np.frombuffer(VOCABULARY.frame(text), "<u4").tolist()


def expected(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def test_encoding_of_odd_texts():
    for t in TEXTS:
        assert ids_of(t) == expected(t), repr(t)
        assert VOCABULARY.decode(VOCABULARY.frame(t)) == LIBRARY.decode(expected(t))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabethrsn ▁  .é\n日1<>"), max_size=60) | st.text(max_size=40).filter(lambda t: t.isprintable() or t.isascii()))
def test_encoding_equals_the_library(text):
    assert ids_of(text) == expected(text)


def test_prefix_table_holds_the_last_token_of_every_prefix():
    text = sc.SPACE + "internationalisierungsstrategien"
    for n, last in enumerate(VOCABULARY.last_tokens(text), 1):
        assert VOCABULARY.merge(text[:n])[-1] == last


def test_long_chunks_are_linear():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    begin = time.time()
    ids = ids_of(text)
    assert time.time() - begin < 20
    assert ids == expected(text)


def test_query_equals_the_library(spark, sf_dir, documents):
    got = {r.doc_id: r for r in QUERIES["op11_sentencepiece"](spark, sf_dir).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = expected(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_round_trip_in_spark(docs_of, clash):
    docs = docs_of(list(enumerate(TEXTS)), clash | {"IDS": "x", "coded": "y"})
    back = sc.decode(sc.encode(docs), column="back").collect()
    assert len(back) == len(TEXTS)
    for r in back:
        assert r.back == LIBRARY.decode(expected(TEXTS[r.doc_id])) and r.ids == VOCABULARY.frame(TEXTS[r.doc_id])
    out, name = sc.digests(docs)
    assert name == "coded_" and {r.doc_id: r[name].n_tokens for r in out.collect()} == {i: len(expected(t)) for i, t in enumerate(TEXTS)}


def test_empty_table(docs_of):
    assert sc.encode(docs_of([])).collect() == [] and sc.digests(docs_of([]))[0].collect() == []
