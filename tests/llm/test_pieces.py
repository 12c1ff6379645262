import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD

from tidewater.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("the and of in  \n\t▁0129.,<>s/é字\0"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_as_the_library(text):
    ids = sentencepiece_of().encode(text)
    assert pieces.count_texts([text], PATH) == [len(ids)]
    assert np.frombuffer(pieces.encode_text(text, PATH), "<u4").tolist() == [1, *ids, 2]


def sentencepiece_of(_known={}):
    if not _known:
        _known["p"] = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return _known["p"]


def test_long_pretokens(library):
    for text in ("a" * 3000, "the" * 500, " " * 100 + "x", "▁" * 70, "abcab" * 400, "<s></s><unk><0x0A>", "\n" * 50):
        ids = library.encode(text)
        assert pieces.count_texts([text], PATH) == [len(ids)]
        assert np.frombuffer(pieces.encode_text(text, PATH), "<u4").tolist() == [1, *ids, 2]


def test_batches_mix_lengths(library):
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 30))) for _ in range(2000)]
    assert pieces.count_texts(words, PATH) == [len(library.encode(w)) for w in words]


def test_counts_of_odd_documents(make, library):
    got = sorted(map(tuple, pieces.token_counts(make(ODD), limit=10).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 10) for i, t, *_ in ODD]
    assert got == sorted(want, key=str)


def test_encoding_of_odd_documents(make, library):
    want = []
    for i, t, *_ in ODD:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.encoding_digests(make(ODD)).collect()), key=str) == sorted(want, key=str)
    full = pieces.encode_decode(make(ODD)).where("doc_id = 6").first()
    assert library.decode(np.frombuffer(full["ids"], "<u4").tolist()) == full["decoded"] == "lonely wörd 字 😀"


def test_empty(make):
    assert pieces.token_counts(make([])).count() == 0 and pieces.encoding_digests(make([])).count() == 0


def test_whole_table(spark, sf, library):
    from tidewater.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, sf).collect()} == {i: len(library.encode(t)) for i, t in texts.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in queries.op7_sentencepiece(spark, sf).collect()}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, t in texts.items() for x in [library.encode(t, add_bos=True, add_eos=True)]}


def test_words_that_come_again_are_encoded_once(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 20)
    monkeypatch.setattr(pieces, "_ids", {})
    encoded, f = [], pieces.Pieces.id_bytes
    monkeypatch.setattr(pieces.Pieces, "id_bytes", lambda self, p: encoded.append(p) or f(self, p))
    for i in range(100):
        text = f"always here and word{chr(97 + i % 26)}{chr(97 + i // 26)}ity"
        assert pieces.encode_text(text, PATH) == np.array([1, *library.encode(text), 2], "<u4").tobytes()
    assert encoded.count("always") + encoded.count(" always") == 1
