"""Encoding of a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .bpe import EncodedText, Prefixes, from_bytes

TOKENIZER = os.path.join(os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def token_ids(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and the list of token ids of each text, row by row, without a shuffle.

    No special tokens are added and their strings are ordinary text. Empty and null texts give an empty
    list. Repeated rows give repeated rows. ``tokenizer`` is the path of a byte-level BPE vocabulary on the
    driver; its bytes (a few MB, whatever the corpus) are broadcast, so executors need no such file.
    """
    with open(tokenizer, "rb") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = from_bytes(source.value)
        for b in batches:
            packed = [bpe.encode_packed(t) if t else b"" for t in b.column(b.num_columns - 1).to_pylist()]
            ends = np.zeros(len(packed) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], [*b.schema.names[:-1], out])

    kept = spread(df.select(*keep, F.col(text).alias("__text")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(run, ", ".join([*fields, f"`{out}` array<int>"]))


def edit_check(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("lang",), tokenizer: str = TOKENIZER) -> DataFrame:
    """Whether appending and editing give the ids of encoding anew, for each text: ``appended``, ``edited``, ``table``.

    The second half of a text is appended to the first; then some characters in its middle are replaced; and the
    prefix table of its longest run of bytes without blanks is edited in the middle. Empty and null texts hold.
    """
    with open(tokenizer, "rb") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())

    def one(bpe, t: str) -> tuple[bool, bool, bool]:
        half, new = len(t) // 2, "zz é_9"
        made = EncodedText(bpe, t[:half])
        made.append(t[half:])
        appended = made.ids() == bpe.encode(t)
        at = half // 2
        made.edit(at, min(at + 3, len(t)), new)
        edited = made.ids() == bpe.encode(t[:at] + new + t[min(at + 3, len(t)):])
        run = max(t.split(), key=len, default="").encode()
        table, cut = Prefixes(bpe, run), len(run) // 3
        table.edit(cut, min(cut + 2, len(run)), b"q7")
        return appended, edited, table.ids() == Prefixes(bpe, run[:cut] + b"q7" + run[min(cut + 2, len(run)):]).ids()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = from_bytes(source.value)
        for b in batches:
            held = [one(bpe, t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            if held:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c) for c in zip(*held))], [*b.schema.names[:-1], "appended", "edited", "table"])

    kept = spread(df.select(*keep, F.col(text).alias("__text")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(run, ", ".join([*fields, "appended boolean", "edited boolean", "table boolean"]))
