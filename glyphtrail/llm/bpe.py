"""Encode a whole corpus with a byte-level BPE given by a local rank file.

One narrow pass: every task loads the ranks once and encodes Arrow batches with
tiktoken. A long text is first cut at safe boundaries, which are places where the
splitting pattern always begins a new piece: a blank right after a character that is
not blank. Cutting there never changes the ids.

Defined results: null, empty and zero-length texts give an empty list, never null. Blank
texts are encoded like any other. Strings of special tokens are ordinary text. A lone
surrogate is encoded as the replacement character. Decoding joins the raw bytes of all
ids before it reads them as UTF-8, so ids that end inside a character are no error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public splitting pattern of this family of vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are encoded in one call.
CHUNK = 20_000

_SAFE = regex.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoder of a rank file; loaded once per Python process."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of ``text`` of about ``size`` characters, cut only at safe boundaries.

    A run without any safe boundary stays whole, however long it is.
    """
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, rank_file: str) -> list[int]:
    if not text:
        return []
    bpe = encoder(rank_file)
    if len(text) <= CHUNK:
        return bpe.encode_ordinary(text)
    return [i for part in pieces(text) for i in bpe.encode_ordinary(part)]


def decode(ids: list[int] | None, rank_file: str) -> str:
    """Text of ``ids``; bytes that are no UTF-8 become the replacement character."""
    return encoder(rank_file).decode_bytes(ids or []).decode("utf-8", "replace")


def encode_corpus(docs: DataFrame, doc_id: str, text: str, rank_file: str) -> DataFrame:
    """Rows (doc id, ids array<int>), one for each row of ``docs``."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            short = [t if t and len(t) <= CHUNK else "" for t in texts]
            ids = bpe.encode_ordinary_batch(short, num_threads=1)
            for i, t in enumerate(texts):
                if t and len(t) > CHUNK:
                    ids[i] = encode(t, rank_file)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[doc_id, "ids"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, doc_id: str, rank_file: str) -> DataFrame:
    """Rows (doc id, text) of encoded documents."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(x, rank_file) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    return encoded.select(doc_id, "ids").mapInArrow(run, f"`{doc_id}` {kind}, text string")


def token_counts(encoded: DataFrame) -> Column:
    return F.size("ids")
