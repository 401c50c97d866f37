"""Byte-level BPE: encoding by a local rank file with the tiktoken library, and raw-byte decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import slices, texts

#: Texts longer than this many characters are encoded in parts.
PART = 1 << 14
#: Unicode's white space, which is the pattern's; Python's own class holds U+001C to U+001F as well.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A part may end where white space follows a character that is none.  No match of the pattern holds a white-space
#: character after another kind, and its only look-ahead applies after white space, so the matches on both sides
#: are those of the whole text.
SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """One encoder for each worker process and rank file."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """`text` cut at safe boundaries into parts of about `size` characters; one with no such boundary stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(coder, text: str, size: int = PART) -> list[int]:
    if len(text) <= size:
        return coder.encode_ordinary(text)
    return [i for part in parts(text, size) for i in coder.encode_ordinary(part)]


def encode_documents(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", output: str = "ids") -> DataFrame:
    """Token ids of each whole text.

    `output="ids"`: doc_id, ids array<int>.  `output="digests"`: doc_id, n_tokens, ids_sha256, decoded_sha256, where the
    last digests the bytes that the ids decode to.

    A null text counts as empty and has no ids.  Repeated rows are encoded each by itself.  An empty table gives an
    empty result.  The rank file must be at `path` on every executor; it is loaded once for each worker process.
    """
    id_type = df.select(f"`{id_col}`").schema[0].dataType.simpleString()
    schema = f"doc_id {id_type}, ids array<int>" if output == "ids" else f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        coder = encoding(path, pattern)
        spelled = [str(i) for i in range(coder.n_vocab)]
        for batch in slices(batches, "text", 4 << 20):
            rows = [encode(coder, x or "") for x in batch.column(1).to_pylist()]
            if output == "ids":
                columns = [batch.column(0), pa.array(rows, type=pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])
                continue
            digests = [hashlib.sha256(" ".join([spelled[i] for i in ids]).encode()).hexdigest() for ids in rows]
            decoded = [hashlib.sha256(coder.decode_bytes(ids)).hexdigest() for ids in rows]
            columns = [batch.column(0), pa.array(map(len, rows), type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(decoded, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(df, id_col, text_col).mapInArrow(run, schema)


def decode_documents(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and `data` binary: the bytes that each array of ids stands for.  Null or empty ids give no bytes;
    an id without a rank raises KeyError."""
    from pyspark.sql import functions as F

    id_type = df.select(f"`{id_col}`").schema[0].dataType.simpleString()

    def run(batches):
        coder = encoding(path, pattern)
        for batch in batches:
            data = [coder.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, type=pa.binary())], names=["doc_id", "data"])

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, f"doc_id {id_type}, data binary")
