"""Byte-level BPE: texts to token ids with character offsets, and ids back to bytes.

Every match of the splitting pattern is encoded on its own by the BPE model of
the ``tokenizers`` library over characters that stand for bytes; decoding
reverses the byte table, so tokens that hold part of a character join to whole
characters again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import TEXTS, with_columns_from
from .words import byte_bpe


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                     offsets: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and, on
    request, ``char_start`` and ``char_end``: the characters of the text that
    each token covers (a token with part of a character covers all of it).

    Null and empty texts have no ids.  An input column named like an output
    column is replaced; repeated rows are encoded alike.
    """
    fields = "ids binary" + (", char_start array<int>, char_end array<int>" if offsets else "")

    def encode(texts: list) -> dict[str, list]:
        bpe = byte_bpe(ranks_path, pattern)
        out = {"ids": [bpe.encode(t or "") for t in texts]}
        if offsets:
            spans = [bpe.offsets(t or "", np.frombuffer(i, dtype="<u4")) for t, i in zip(texts, out["ids"])]
            out |= {"char_start": [s for s, _ in spans], "char_end": [e for _, e in spans]}
        return out

    return with_columns_from(docs, [text], encode, fields, drop, TEXTS)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids",
                     drop: tuple[str, ...] = ()) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the ids (null ids: no bytes)."""

    def decode(rows: list) -> dict[str, list]:
        bpe = byte_bpe(ranks_path, pattern)
        return {"decoded": [bpe.decode(np.frombuffer(i or b"", dtype="<u4").tolist()) for i in rows]}

    return with_columns_from(encoded, [ids], decode, "decoded binary", drop, TEXTS)
