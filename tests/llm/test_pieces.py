"""SentencePiece encoding and decoding against the library."""

import random

import pytest
import sentencepiece
from brute import sha
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from peerscope.llm.piece_codec import LONG, PieceCodec, codec, encode
from peerscope.llm.queries import QUERIES

MODEL = path("piece_bpe_32k.model")
PIECES = [*"abcxyzABC 012!?'\n\t éßΣ日́ \x1c<|>\r▁\x00", "the", "ing", "<s>", "</s>", "<unk>", "<0x0A>", "  ", "    ", "\r\n", "😀", "aaaa", "͸"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def agree(c, library, texts):
    ids, n = c.encode(texts)
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        got, want = ids[at:at + k].tolist(), library.encode(t)
        at += k
        assert got == want, t[:100]
        assert c.decode(got) == library.decode(want)


def test_strange_texts(library):
    r = random.Random(5)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 60))) for _ in range(3000)]
    agree(codec(MODEL), library, texts + ["", " ", "x" * 4000, "ab " * 3000, " " * 70])


@pytest.mark.parametrize("letters", ["etaoinshrdlu", "({})[];:\r'\"/*=", "ab", "aA1 "])
def test_words_of_many_merges(library, letters):
    """Ranks at which only the leftmost pair may be merged, overlapping pairs and words up to the long ones."""
    r = random.Random(3)
    c = codec(MODEL)
    assert c.alone.any() and not c.alone.all()
    agree(c, library, ["".join(r.choices(letters, k=r.randint(1, LONG))) for _ in range(400)])


def test_long_stretches_take_the_heap(library):
    c, r = PieceCodec(MODEL), random.Random(1)
    agree(c, library, ["".join(r.choices("etaoinshrdlu", k=LONG + k)) + " end" for k in (0, 1, 900)])
    assert c.merged_alone == 3  # the mark before the text counts


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(PieceCodec, "BOUND", 50)
    monkeypatch.setattr("peerscope.llm.piece_codec.SLICE_BYTES", 40)  # texts beyond a slice come in batches of words
    monkeypatch.setattr("peerscope.llm.piece_codec.WORDS", 3)
    c = PieceCodec(MODEL)
    for i in range(20):
        agree(c, library, [f"word{i} and w{j} x{i * j} more of it" for j in range(4)])
    assert len(c.seen) <= 60


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    agree(codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), [text])


def test_rows(docs, odd, none, library):
    for df in (docs, odd):
        text = sorted((r["doc_id"] or -1, r["text"] or "") for r in df.select("doc_id", "text").collect())
        got = sorted((r["doc_id"] or -1, r["decoded"], r["ids"], r["n_tokens"]) for r in encode(df, MODEL).collect())
        want = sorted((d, library.decode(library.encode(t)), library.encode(t), len(library.encode(t))) for d, t in text)
        assert got == want
    assert encode(none, MODEL).count() == 0


def test_query(spark, library, docs):
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = QUERIES["op11_piece_codec"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
