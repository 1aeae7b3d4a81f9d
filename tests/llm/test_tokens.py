"""Token counts, byte BPE and token files, held against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetlake.llm import byte_bpe, dac_tokens, piece_counts
from fleetlake.llm import textkernel as K

PIECES, BYTES, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
sp, byte_level, word_level = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
TEXT = st.text(st.one_of(st.sampled_from("abcdeé ß\n\n \t'.,012日あ😀▁ΣσİǺ\x1c\x85\xa0"), st.characters(codec="utf-8")), max_size=80)


def ids_of(encoder, texts):
    for t in K.texts(pa.array(texts, pa.string())):
        ids, counts = encoder.encode(t)
        edges = np.concatenate([[0], np.cumsum(counts)])
        yield from (ids[a:b].tolist() for a, b in zip(edges, edges[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_piece_counts(texts):
    assert piece_counts.count_tokens(pa.array(texts), PIECES)[1].tolist() == [len(sp.encode(t)) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT, TEXT.map(lambda t: t + "<|endoftext|> " + t)), min_size=1, max_size=6))
def test_byte_bpe(texts):
    v = byte_bpe.vocabulary(BYTES)
    for text, got in zip(texts, ids_of(v, texts), strict=True):
        assert got == byte_level.encode(text, add_special_tokens=False).ids
        assert v.decode(np.array(got, np.uint32), np.array([len(got)]))[0].decode() == byte_level.decode(got, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT, TEXT.map(lambda t: t + "<|startoftext|>" + t)), min_size=1, max_size=6))
def test_word_encoder(texts):
    assert list(ids_of(dac_tokens.encoder(WORDS), texts)) == [word_level.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=5))
def test_dac_round_trip(documents):
    starts = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    ids = np.array([x for d in documents for x in d], np.uint32)
    reader = dac_tokens.Reader(dac_tokens.pack(ids, starts, b"labels"))
    assert [reader.document(k).tolist() for k in range(len(documents))] == documents and reader.labels == b"labels"
    assert [reader.token(k) for k in range(len(ids))] == ids.tolist()
    with pytest.raises(IndexError):
        reader.token(len(ids))


def test_whole_documents(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    some = sorted(texts)[::7]
    counts = {r.doc_id: r for r in piece_counts.with_token_counts(documents, PIECES).collect()}
    trips = {r.doc_id: r for r in byte_bpe.round_trips(documents, BYTES, ids="ids").collect()}
    for k in some:
        assert counts[k].n_tokens == len(sp.encode(texts[k])) and counts[k].n_bytes == len(texts[k].encode())
        ids = byte_level.encode(texts[k], add_special_tokens=False).ids
        assert trips[k].ids == ids and trips[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert trips[k].decoded_sha256 == hashlib.sha256(texts[k].encode()).hexdigest()


def test_token_files(spark, documents):
    files = dac_tokens.write(documents, WORDS, end_id=2)
    rows = sorted(dac_tokens.read(spark, files).collect())
    sums = {r.key: r for r in dac_tokens.read_checksums(spark, files).collect()}
    texts, start = {r.doc_id: r.text for r in documents.collect()}, 0
    assert [r.key for r in rows] == sorted(texts) and files.count() > 1
    for r in rows:
        assert (r.start, r.n_tokens) == (start, len(r.ids)) == (sums[r.key].start, sums[r.key].n_tokens)
        assert sums[r.key].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    for r in rows[::50]:
        assert r.ids == [*word_level.encode(texts[r.key], add_special_tokens=False).ids, 2]


def test_odd_and_empty(spark, odd, empty):
    for docs in (odd, empty):
        n = docs.count()
        assert piece_counts.with_token_counts(docs, PIECES).count() == n
        assert byte_bpe.decoded(byte_bpe.encoded(docs, BYTES), BYTES).count() == n
        assert dac_tokens.read(spark, dac_tokens.write(docs, WORDS, 2)).count() == n
    back = byte_bpe.decoded(byte_bpe.encoded(odd, BYTES), BYTES).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in back)
    text = {r.text: r.n_tokens for r in piece_counts.with_token_counts(odd, PIECES).collect()}
    assert text[None] == text[""] == 0
