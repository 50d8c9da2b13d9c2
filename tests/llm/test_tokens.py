import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from nudgetrail.llm import packing, rans, token_counts
from nudgetrail.llm.tokens import Encoder
from tokenizers import Tokenizer

BYTE, WORD = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "b'll", " ", "  ", "\n", "\t", "12", "é", "İ", "Σ", "́", "\x1c",
         "中", "\U0001f44d", "<|endoftext|>", "'", "?,", "aaaa", ".", "Q, "]
some_texts = st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=8)


def of_library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tools():
    return {p: (Encoder(p), Tokenizer.from_file(p)) for p in (BYTE, WORD)}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_the_library(tools, path):
    encoder, tok = tools[path]

    @settings(max_examples=150, deadline=None)
    @given(some_texts)
    def check(texts):
        ids, at = encoder.encode(texts)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tok.encode(text, add_special_tokens=False).ids

    check()


def test_counts_are_those_of_the_library(tools):
    counter, tok = token_counts.Counter(BYTE), tools[BYTE][1]

    @settings(max_examples=150, deadline=None)
    @given(some_texts)
    def check(texts):
        want = [len(tok.encode(x, add_special_tokens=False).ids) for x in texts]
        assert counter.count(texts).tolist() == want

    check()


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("size", [512, 1024, 4096, 8192])
def test_chunks_of_a_regular_build_are_told_apart(path, size):
    """Words whose letters swap as in the Thue-Morse sequence, whose polynomial hashes agree."""
    bits = [0]
    while len(bits) < size:
        bits += [1 - b for b in bits]
    one, two = ("".join(letters[b] for b in bits) for letters in ("er", "re"))
    encoder, together = Encoder(path), Encoder(path)
    ids, at = together.encode([one, two])
    counter = token_counts.Counter(path) if path == BYTE else None
    for i, text in enumerate((one, two)):
        want = of_library(path, text)
        assert encoder.encode([text])[0].tolist() == want == ids[at[i] : at[i + 1]].tolist()
        assert counter is None or counter.count([text]).tolist() == [len(want)]
    assert counter is None or counter.count([two, one]).tolist() == np.diff(at)[::-1].tolist()


def test_count_tokens_of_every_row(docs, no_docs):
    got = sorted(map(tuple, token_counts.count_tokens(docs, BYTE).collect()))
    want = []
    for r in docs.collect():
        n = len(of_library(BYTE, r.text))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts.count_tokens(no_docs, BYTE).count() == 0


def test_packing_places_every_id_once(docs, no_docs):
    pieces = packing.pack(docs, BYTE, with_ids=True).orderBy("sequence_id", "offset").collect()
    place = 0
    whole = {}
    for p in pieces:
        assert p.sequence_id * 2048 + p.offset == place
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        whole.setdefault(p.doc_id, []).append((p.start, p.ids))
        place += p.length
    for r in docs.where("doc_id <> 11").collect():  # rows that repeat are cut in other places
        got = b"".join(x for _, x in sorted(set(whole[r.doc_id])))
        assert got == np.array([*of_library(BYTE, r.text), 1], dtype="<u4").tobytes()
    assert packing.pack(no_docs, BYTE).count() == 0


def test_shards_give_back_every_id(spark, docs, no_docs, tmp_path):
    rans.write_shards(docs, WORD, str(tmp_path / "s"))
    got = rans.read_documents(spark, str(tmp_path / "s"), with_ids=True).orderBy("start").collect()
    start = 0
    for r, d in zip(sorted(docs.collect(), key=lambda r: r.doc_id), got, strict=True):
        raw = np.array([*of_library(WORD, r.text), 2], dtype="<u4").tobytes()
        assert (d.doc_id, d.start, d.ids_crc32, d.ids) == (r.doc_id, start, zlib.crc32(raw), raw)
        start += d.n_tokens
    rans.write_shards(no_docs, WORD, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e" / "frequencies")).count() == 0


def test_a_damaged_block_is_refused():
    ids = np.arange(100_000) % 977
    table = rans.Table(np.arange(977), np.bincount(ids))
    (block,) = rans.block_bytes(table, [[(5, ids), (None, ids[:3])]])
    ((a, x), (b, y)) = rans.decode_blocks(table, [block])[0]
    assert (a, b) == (5, None) and (x == ids).all() and (y == ids[:3]).all()
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_blocks(table, [block[:400] + bytes([block[400] ^ 1]) + block[401:]])


def test_a_long_block_does_not_widen_the_others():
    rng = np.random.default_rng(2)
    sizes = [1, 0, 3_000_000, *[rans.BLOCK] * 12, 70, rans.BLOCK // 2]
    docs = [[(i, rng.integers(0, 50, n))] for i, n in enumerate(sizes)]
    table = rans.Table(np.arange(50), np.ones(50, dtype=np.int64))
    tracemalloc.start()
    blocks = rans.block_bytes(table, docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * sum(sizes)  # all padded to the longest it is some 450
    for ((name, ids),), ((got, back),) in zip(docs, rans.decode_blocks(table, blocks), strict=True):
        assert name == got and (ids == back).all()
