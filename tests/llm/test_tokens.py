"""Encoding, decoding, counts and token files against the library, and exact round trips."""

import random
import zlib
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peerscope.llm.bpe_codec import Codec, codec, encode
from peerscope.llm.token_count import token_counts
from peerscope.llm.token_files import GROUP, Writer, documents, from_file, pack, to_file, token_ids, unpack

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = [*"abcxyzABC 012!?'\n\t éßΣ日́ \x1c<|>", "the", "ing", "<|endoftext|>", "<|startoftext|>", " ", " ", "  ", "́", "͸", "İ", "ΑΣ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


def strange():
    r = random.Random(5)
    return ["".join(r.choices(PIECES, k=r.randint(0, 40))) for _ in range(3000)] + ["x" * 4000, "ab " * 3000, " " * 70]


def test_documents(docs, library):
    word, byte = library
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in encode(docs, WORD).collect():
        want = word.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == word.decode(want, skip_special_tokens=False)
    for r in token_counts(docs, BYTE).collect():
        n = len(byte.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 512)


def test_strange_texts(library):
    word, byte = library
    from peerscope.llm.token_count import counter

    texts, c, k = strange(), codec(WORD), counter(BYTE)
    for t, ids, w, b in zip(texts, c.encode(texts), word.encode_batch(texts, add_special_tokens=False), byte.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids
        assert c.decode(ids) == word.decode(w.ids, skip_special_tokens=False)
        assert k.text(t) == len(b.ids)


def test_borders_decide_as_merging_does():
    """Proposals whose borders are compatible are what merging gives; the others differ from it."""
    c, r = codec(WORD), random.Random(2)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 14))) for _ in range(2000)]
    for w in words:
        ids = np.array(c.propose(w))
        fits = bool(c.compatible(ids[:-1], ids[1:]).all())
        assert fits == (ids.tolist() == c.exact(w))


def test_odd_rows(odd, none):
    got = encode(odd, WORD).collect()
    assert len(got) == odd.count() and all(r["n_tokens"] == 0 and r["decoded"] == "" for r in got if r["doc_id"] in (1, 2, 8))
    assert token_counts(odd, BYTE).count() == odd.count()
    assert encode(none, WORD).count() == token_counts(none, BYTE).count() == token_ids(none, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([16, 100, 2048]))
def test_simple8b_round_trip(ids, block):
    x = np.array(ids, np.uint64)
    words, first = pack(x, block)
    assert unpack(words, first, len(x), block).tolist() == ids
    assert from_file(to_file([None, -5], np.array([0, len(ids)]), x, block))[2].tolist() == ids


def test_zero_runs_are_small():
    words, _ = pack(np.zeros(2400, np.uint64), 2400)
    assert len(words) == 10


def test_files_longer_than_a_group():
    """Documents that come in parts, some empty, one longer than several groups of blocks."""
    r = np.random.default_rng(3)
    lengths = [0, 5, 3 * GROUP * 16 + 7, 0, 1, *r.integers(0, 900, 60).tolist(), 0]
    ids = [r.integers(0, 50_000, n).astype("<u4") for n in lengths]
    out = BytesIO()
    writer = Writer(out, 16)
    for a in range(0, len(ids), 7):
        writer.add([*range(a, min(a + 7, len(ids)))], np.array(lengths[a:a + 7]), np.concatenate(ids[a:a + 7]))
    writer.close()
    parts = [*documents(BytesIO(out.getvalue()))]
    names, sizes, flat = from_file(out.getvalue())
    assert len(parts) > 3 and names == [*range(len(ids))] and sizes.tolist() == lengths
    assert np.array_equal(flat, np.concatenate(ids))


def test_small_memory(library):
    """What a full memory forgets, stretches to be split by the library and special tokens among it, is encoded again."""
    small, texts = Codec(WORD), strange()
    small.BOUND = 500
    for a in range(0, len(texts), 100):
        part = texts[a:a + 100]
        want = [w.ids for w in library[0].encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(part)] == want
        assert len(small.seen) == len(small.starts) == len(small.counts) == len(small.uses)


def test_files_give_the_ids_back(spark, docs, odd, library, folder):
    word, _ = library
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    start = 0
    got = {r["doc_id"]: r for r in token_ids(docs.repartition(7), WORD, f"{folder}/ids").collect()}
    for d, t in rows:
        ids = np.array([*word.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], zlib.crc32(got[d]["ids"])) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    again = token_ids(odd, WORD).orderBy("start").collect()
    assert len(again) == odd.count() and [r["start"] for r in again] == [0, *np.cumsum([r["n_tokens"] for r in again]).tolist()[:-1]]
    assert [r["doc_id"] for r in again][:3] == [None, None, 1]
