"""Byte-level BPE encoding and decoding with a local rank file.

The merges are the tiktoken library's.  A long text is cut, before its pattern is
applied, at boundaries that are safe: between an ASCII letter or digit and a space or
line feed that follows it.  No match of the pattern spans such a place (letters and
digits are never in one match with white space that follows), the pattern has no
look-behind, and its only look-ahead is inside a run of white space, which such a cut
never divides or ends.  So the pieces give exactly the ids of the whole text, while
memory follows the piece.  Decoding joins raw token bytes and never passes through
characters, so any id sequence decodes.

Defined results: null text is empty text (no ids, empty bytes).  Strings that look like
special tokens are ordinary text.  Rows are independent: repeated rows, ties and empty
tables need no rule.  Columns named like an output are replaced; others pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import drop_clashes
from quillon.llm.textkit import plain

OUTPUTS = ("n_tokens", "token_ids", "decoded")
#: Texts above this many characters are cut into pieces of about this many.
PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The encoder of a rank file; one a process."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts at the first safe boundary after every `size` characters; joined, the pieces are the text."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, size) for i in enc.encode_ordinary(p)]


def decode_ids(enc, ids: list[int]) -> bytes:
    return enc.decode_bytes(ids)


def bpe(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", packed: bool = False, decode: bool = True) -> DataFrame:
    """docs with n_tokens long, token_ids (array<int>, or binary of little-endian u32 if packed) and decoded binary."""
    docs = drop_clashes(docs, *OUTPUTS)
    kinds = {"n_tokens": pa.int64(), "token_ids": pa.binary() if packed else pa.list_(pa.int32())} | ({"decoded": pa.binary()} if decode else {})
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_tokens long", f"token_ids {'binary' if packed else 'array<int>'}"] + ["decoded binary"] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [encode_text(enc, t or "") for t in plain(part.column(text_col)).to_pylist()]
                out = {"n_tokens": list(map(len, ids)), "token_ids": [np.array(x, "<u4").tobytes() for x in ids] if packed else ids}
                if decode:
                    out["decoded"] = [decode_ids(enc, x) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[k], kinds[k]) for k in kinds)], names=[*part.schema.names, *kinds])

    return docs.mapInArrow(run, ddl)
