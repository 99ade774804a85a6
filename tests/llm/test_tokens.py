from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, tokens
from tessera.llm.common import new_path
from tessera.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


ENCODER = tokens.WordEncoder(tokenizer_path(), entries=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from([" ", "\n", "<|endoftext|>", "'s", "́", " ", "\x0b", "É", "ß.", "Word,", "İ", "ﬁ", "ª", "don't", "é", "..."]))).map("".join))
def test_pieces_encode_as_the_whole(text):
    from tokenizers import Tokenizer

    whole = test_pieces_encode_as_the_whole.__dict__.setdefault("t", Tokenizer.from_file(tokenizer_path()))
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_files_round_trip(spark, make, odd, reference):
    docs = make(odd, ids=[5, 3, 3, None, 0, 9, 8, 7, 6, 1, 2, -4])
    root = new_path(spark, "t")
    manifest = tokens.write_token_files(docs, root, tokenizer_path()).collect()
    shards = tokens.with_bases(manifest)
    got = tokens.read_token_files(spark, root, shards, tokenizer_path()).collect()
    want = sorted(zip([5, 3, 3, None, 0, 9, 8, 7, 6, 1, 2, -4], odd, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start, rows = 0, []
    for doc_id, text in want:
        ids = reference(text)
        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == rows
    first = tokens.Shard(root, shards[0][0], tokens.vocabulary_dtype(tokenizer_path()))
    assert isinstance(first.ids, np.memmap) and first.offsets.dtype == np.int64


def test_no_documents(spark, make):
    root = new_path(spark, "t")
    assert tokens.write_token_files(make(["a"]).limit(0), root, tokenizer_path()).count() == 0
    assert tokens.read_token_files(spark, root, [], tokenizer_path()).count() == 0
    assert packing.pack(make(["a"]).limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12345])
def test_cut_covers_all_in_powers_of_two(n):
    pieces = list(packing.cut(n))
    assert sum(x for _, x in pieces) == n and all(x & (x - 1) == 0 and x <= 4096 for _, x in pieces)
    assert all(a + x == b for (a, x), (b, _) in zip(pieces, pieces[1:], strict=False)) and pieces[0][0] == 0


def test_packing_holds_every_id_once(make, odd, reference):
    rows = packing.pack(make(odd), tokenizer_path()).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    for doc_id, text in enumerate(odd):
        ids, at = reference(text), 0
        for r in sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and 1 << r.bucket == r.length
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
