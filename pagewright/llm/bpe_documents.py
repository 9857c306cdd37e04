"""Byte-level BPE of document tables (`bpe.py` has the transducer)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_bpe
from .shingles import pieces

#: Ids that are decoded at a time.
BLOCK = 4096


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and the ids themselves if asked.

    Ids are hashed as decimal numbers joined by single spaces; the decoded text comes from a
    streaming decoder that gets the ids in blocks. Null text counts as empty, which has no
    ids; an empty table gives no rows; rows keep no order; other columns are ignored.
    ``path`` must be readable on executors.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        names = [str(i) for i in range(len(bpe.bytes_of))]
        for batch in batches:
            for at, to in pieces(batch.column(1)):
                b = batch.slice(at, to - at)
                rows = []
                for text in b.column(1).to_pylist():
                    found = bpe.encode(text or "")
                    decoded = hashlib.sha256()
                    for part in bpe.decode_stream(found[i : i + BLOCK] for i in range(0, len(found), BLOCK)):
                        decoded.update(part.encode())
                    rows.append((len(found), hashlib.sha256(" ".join(map(names.__getitem__, found)).encode()).hexdigest(), decoded.hexdigest(), found if ids else None))
                columns = [b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string())))]
                labels = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=labels)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
