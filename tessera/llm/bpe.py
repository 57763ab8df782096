"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts over ``LONG`` characters are cut before a single space that stands between two
characters that are no white space. Each match of the pattern begins there and none
crosses it, so the pieces' ids, put together, are the ids of the whole text.

The pattern matcher gives up within very long runs of white space. Such a run is cut out:
the pattern matches all of it but its last character as one (all of it at the end of a
text), so that much is merged without the matcher.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are encoded in one call.
LONG = 100_000
#: A safe boundary: one ASCII space between two characters that aren't white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: The characters with Unicode's White_Space property, which the pattern calls white space; and a run of them that is long.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUN = re.compile(f"[{WHITE}]{{10000,}}")

_encodings: dict = {}


def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file, loaded once a process."""
    if (rank_file, pattern) not in _encodings:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[rank_file, pattern]


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """text, cut at safe boundaries; a piece is longer than ``long`` only if it has no such boundary there."""
    start = 0
    while len(text) - start > long:
        cut = SAFE.search(text, start + long)  # beyond the boundary at start itself
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode(enc, text: str, long: int = LONG) -> list[int]:
    """Ids of a whole text, without special tokens; none for an empty one."""
    if len(text) <= long:
        return enc.encode_ordinary(text)
    ids, start = [], 0
    for run in RUN.finditer(text):
        for p in pieces(text[start : run.start()], long):
            ids += enc.encode_ordinary(p)
        start = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc._encode_single_piece(text[run.start() : start].encode())
    for p in pieces(text[start:], long):
        ids += enc.encode_ordinary(p)
    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", id_col: str = "doc_id", digests_only: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256) of every row's whole text.

    ids is an array of int and decoded the bytes that the ids stand for; with digests_only
    neither leaves the task. Null counts as empty: no ids, the digests of nothing. Repeated
    rows are encoded alike. rank_file is a path that is the same on every executor.
    """

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            all_ids = []
            n, raws, sha_ids, sha_raw = [], [], [], []
            for t in b.column("__text"):
                ids = encode(enc, t.as_py() or "")
                raw = enc.decode_bytes(ids)
                n.append(len(ids))
                sha_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                sha_raw.append(hashlib.sha256(raw).hexdigest())
                if not digests_only:
                    all_ids.append(ids)
                    raws.append(raw)
            long_ones = {} if digests_only else {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(raws, pa.binary())}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("__id"), "n_tokens": pa.array(n, pa.int64()), **long_ones, "ids_sha256": pa.array(sha_ids, pa.string()), "decoded_sha256": pa.array(sha_raw, pa.string())})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, " + ("" if digests_only else "ids array<int>, decoded binary, ") + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, schema)
