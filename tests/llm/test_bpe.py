import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.bpe import bpe, decode_ids, encode_text, encoding, pieces

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENC = encoding(FILE, public_tokenizers.PATTERN)
SCHEMA = "doc_id long, text string, N_TOKENS string"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t 'sAz09.é漢🙂　-"), st.characters(blacklist_categories=("Cs",))), max_size=300))
def test_pieces_give_the_same_ids(text):
    assert "".join(pieces(text, 5)) == text
    ids = encode_text(ENC, text, 5)
    assert ids == ENC.encode_ordinary(text)
    assert decode_ids(ENC, ids) == text.encode()


def test_table(spark):
    rng = random.Random(0)
    long = " ".join("".join(rng.choice("abcé'1 \n") for _ in range(9)) for _ in range(30_000))
    rows = [(1, "Hello world's"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, long), (6, " \n\n  x"), (None, "z"), (1, "Hello world's")]
    got = bpe(spark.createDataFrame([(*r, "c") for r in rows], SCHEMA), FILE, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        assert list(r["token_ids"]) == ENC.encode_ordinary(t) and r["n_tokens"] == len(r["token_ids"]) and bytes(r["decoded"]) == t.encode()
    packed = bpe(spark.createDataFrame([(1, "Hello", "c")], SCHEMA), FILE, public_tokenizers.PATTERN, packed=True).first()
    assert bytes(packed["token_ids"]) == b"".join(i.to_bytes(4, "little") for i in ENC.encode_ordinary("Hello"))
    assert bpe(spark.createDataFrame([], SCHEMA), FILE, public_tokenizers.PATTERN).collect() == []


def test_any_ids_decode():
    assert decode_ids(ENC, [0, 255, 1]) == b"".join(ENC.decode_single_token_bytes(i) for i in (0, 255, 1))
    with pytest.raises(KeyError):
        decode_ids(ENC, [10**6])
