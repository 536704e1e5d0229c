import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import byte_bpe, common, packing, queries, token_store
from skein.llm.elias_fano import EliasFano
from skein.llm.wordbpe import ChunkEncoder

WORD = P.path("word_bpe_49k.json")
BYTE = P.path("byte_bpe_multi_50k.tiktoken")


def plain_ids(texts):
    t = Tokenizer.from_file(WORD)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def word():
    return ChunkEncoder(WORD)


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(BYTE, P.PATTERN)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE), special_tokens={})


PIECES = st.text(st.sampled_from(list("abIİß's t'R9١.,!?&ȩ́́ \n\t\x1c　日🙂<|>/")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_chunks_encode_as_the_library_does(text):
    got = ChunkEncoder.encode(_shared_word(), [text.encode()])[0]
    assert np.frombuffer(got, "<u2").tolist() == plain_ids([text])[0]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> Big", "<|endoftext|", "e\u0301<|endoftext|>\u0301 f"])
def test_added_tokens_encode_as_the_library_does(text):
    got = ChunkEncoder.encode(_shared_word(), [text.encode(), b"other words"])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == plain_ids([text, "other words"])


_memo = {}


def _shared_word():
    return _memo.setdefault("w", ChunkEncoder(WORD))


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_byte_bpe_as_the_library_does(text):
    b = _memo.setdefault("b", byte_bpe.ByteBPE(BYTE, P.PATTERN))
    t = _memo.setdefault("t", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE), special_tokens={}))
    ids = b.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(text)
    assert b.decode(ids) == text.encode()


def test_perfect_hash_is_minimal(bpe):
    keys = list(bpe.ranks)
    assert sorted(bpe.hash.slots(keys).tolist()) == list(range(len(keys)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=300), st.integers(0, 3))
def test_elias_fano_gives_back_its_values(values, shift):
    v = np.sort(np.asarray(values, np.uint64) >> np.uint64(16 * shift))
    e, end = EliasFano.from_bytes(b"xy" + EliasFano.encode(v).to_bytes(), 2)
    assert end == 2 + len(EliasFano.encode(v).to_bytes())
    assert e.select(np.arange(len(v))).tolist() == v.tolist()


def test_elias_fano_space_and_errors():
    v = np.sort(np.random.default_rng(1).integers(0, 10**7, 50_000, dtype=np.uint64))
    assert len(EliasFano.encode(v).to_bytes()) * 8 / len(v) < 2 + np.log2(10**7 / 50_000) + 1
    with pytest.raises(ValueError):
        EliasFano.encode(np.asarray([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.encode(np.asarray([1, 2])).select(2)


def test_token_store_over_the_table(spark, sf):
    docs = common.table(spark, sf, "documents").orderBy("doc_id").collect()
    want, at = [], 0
    for d, ids in zip(docs, plain_ids([d.text or "" for d in docs])):
        ids = [*ids, 2]
        want.append((d.doc_id, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op3_token_store(spark, sf).collect())) == want


def test_token_store_in_many_shards(spark, sf):
    docs = common.table(spark, sf, "documents")
    folder = common.shared_dir(spark, "t")
    manifest = token_store.write(spark, docs, WORD, folder, 2, shard_bytes=20_000)
    assert len(manifest) > 3
    assert sorted(map(tuple, token_store.read(spark, manifest, folder).collect())) == sorted(map(tuple, queries.op3_token_store(spark, sf).collect()))
    shard = token_store.Shard(folder, manifest[1]["name"])
    key, at, ids = next(shard.read(2, 3))
    assert len(ids) // shard.width == int(shard.starts.select(3)[0] - shard.starts.select(2)[0])


def test_token_store_bears_odd_rows(spark, odd_documents, no_documents):
    rows = token_store.store_documents(spark, odd_documents, WORD).orderBy("start").collect()
    assert len(rows) == odd_documents.count()
    assert rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    by = {r.doc_id: r.n_tokens for r in rows}
    assert by[0] == by[1] == by[2] == 1
    assert token_store.store_documents(spark, no_documents, WORD).count() == 0


def test_byte_bpe_over_the_table(spark, sf, tik):
    docs = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    for r in queries.op9_byte_bpe(spark, sf).collect():
        ids = np.asarray(tik.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_byte_bpe_bears_odd_rows(spark, odd_documents, no_documents):
    rows = byte_bpe.encode_documents(spark, odd_documents, BYTE, P.PATTERN, keep_ids=True).collect()
    assert len(rows) == odd_documents.count() and all(r.n_tokens == len(r.ids) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    assert byte_bpe.encode_documents(spark, no_documents, BYTE, P.PATTERN).count() == 0


def check_pieces(rows, want):
    """rows of PIECES against {doc: ids}; returns the padding's share."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[d])
            assert r.ids_crc32 == zlib.crc32(np.asarray(want[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[d])
    full = padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        full, padded = full + at, padded + (at if at & (at - 1) == 0 else 4096)
    return 1 - full / padded


def test_packing_over_the_table(spark, sf):
    docs = common.table(spark, sf, "documents").collect()
    want = {d.doc_id: [*ids, 2] for d, ids in zip(docs, plain_ids([d.text or "" for d in docs]))}
    assert check_pieces(queries.op8_packing(spark, sf).collect(), want) < 0.01


def test_packing_bears_odd_rows(spark, odd_documents, no_documents):
    rows = packing.pack_documents(spark, odd_documents.where("doc_id is not null and doc_id <> 5"), WORD).collect()
    docs = {r.doc_id: r.text for r in odd_documents.where("doc_id is not null").collect()}
    check_pieces(rows, {k: [*plain_ids([t or ""])[0], 2] for k, t in docs.items() if k != 5})
    assert packing.pack_documents(spark, odd_documents, WORD).where("doc_id = 5").agg({"length": "sum"}).first()[0] == 2 * len([*plain_ids([docs[5]])[0], 2])
    assert packing.pack_documents(spark, no_documents, WORD).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=300))
def test_packing_keeps_every_id(lengths):
    pieces, n = packing.pack(np.asarray(lengths, np.int64))
    assert np.bincount(pieces[:, 0], pieces[:, 2], minlength=len(lengths)).tolist() == lengths if len(lengths) else len(pieces) == 0
    fill = np.bincount(pieces[:, 3], pieces[:, 2], minlength=n)
    assert n == 0 or 0 < fill.min() and fill.max() <= 4096


def test_nnls_meets_its_optimality_conditions():
    columns = packing.combinations(32)
    b = np.random.default_rng(5).integers(0, 40, 32).astype(float)
    x = packing.nnls(columns, b)
    a = np.zeros((32, len(columns)))
    for k, (i, m, j, n) in enumerate(columns):
        a[i - 1, k] += m
        a[j - 1, k] += n
    assert np.all(a.sum(axis=0) > 0) and np.all((np.arange(1, 33) @ a) == 32)
    w = a.T @ (b - a @ x)
    assert x.min() >= 0 and w.max() < 1e-3 and np.abs(w[x > 1e-6]).max() < 1e-3
