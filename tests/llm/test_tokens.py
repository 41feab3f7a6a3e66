import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm import bpe, token_files

from .conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BITS = ["a", "b", "the", " ", "  ", "\n", "é", "1", "'s", "!", "<|endoftext|>", "\u00a0", "\u3000", "ß", "aaa", "\t", "日", "\U0001f600", "\u0558", "\U000323b5"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=25).map("".join) | st.text(max_size=20))
def test_encoders_equal_the_library(text):
    want = ids(text)
    v = bpe.vocabulary(PATH)
    got = v.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == want
    assert np.frombuffer(next(token_files.library_encoder(PATH).encode([text])), "<u4").tolist() == want
    assert v.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


def test_runs_of_one_symbol_and_long_units():
    for text in ["a" * n for n in range(1, 40)] + ["ab" * 5000, "=" * 4097, "ha" * 777 + "h"]:
        assert np.frombuffer(bpe.vocabulary(PATH).encode([text])[0], "<u4").tolist() == ids(text)


def test_bytes_that_are_no_text_decode_like_the_library():
    r = random.Random(3)
    for _ in range(200):
        some = [r.randrange(50257) for _ in range(6)]
        assert bpe.vocabulary(PATH).decode(np.array(some, "<u4").tobytes()) == LIBRARY.decode(some, skip_special_tokens=False)


def test_bpe_query_columns(docs, none):
    got = Counter(tuple(r) for r in bpe.digests(bpe.encode_decode(docs)).collect())
    want = Counter()
    for k, text, *_ in ROWS:
        i = ids(text)
        back = LIBRARY.decode(i, skip_special_tokens=False)
        want[k, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digests(bpe.encode_decode(none)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 4, 5, 1000])
@pytest.mark.parametrize("most", [2, 300, 70_000, 2**32 - 1])
def test_packing_round_trip(n, most):
    some = np.random.default_rng(n).integers(0, most, n).astype(np.uint32)
    assert (token_files.unpack(n, *token_files.pack(some)) == some).all()


def test_frequent_ids_are_short():
    some = np.array([40_000] * 50 + list(range(300)), np.uint32)
    book, control, data = token_files.pack(some)
    assert np.frombuffer(book, "<u4")[0] == 40_000 and len(data) == 350 + 45 and len(control) == 88


def test_files_hold_every_document_in_order(docs, none, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 30)
    files = token_files.write(docs)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.index(files).collect())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for k, text, *_ in order:
        i = ids(text) + [token_files.END_ID]
        want.append((start, k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert got == want
    assert token_files.index(token_files.write(none)).count() == 0


def test_hot_and_null_keys_are_spread_and_stay_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 40)
    rows = [(None, f"none {k}") for k in range(40)] + [(7, f"hot {k}") for k in range(60)] + [(k, f"doc {k}") for k in [*range(-9, 60), 2**62, 2**62 + 1, -(2**63), 2**63 - 1]]
    files = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = token_files.read(files).join(token_files.starts(files), ["range", "segment"]).selectExpr("doc_id", "range", "n_tokens", "segment_start + place AS start", "ids").collect()
    docs.sort(key=lambda r: r.start)
    assert [r.start for r in docs] == np.cumsum([0] + [r.n_tokens for r in docs])[:-1].tolist()
    assert [r.doc_id for r in docs] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert Counter((r.doc_id, np.frombuffer(r.ids, "<u4").tobytes()) for r in docs) == Counter((k, np.array(ids(t) + [2], "<u4").tobytes()) for k, t in rows)
    assert all(len({r.range for r in docs if r.doc_id == k}) > 3 for k in (None, 7))
    assert [r.range for r in docs] == sorted(r.range for r in docs)
