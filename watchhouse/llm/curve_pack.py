"""Packing documents into fixed-length token sequences along a space-filling curve.

Each text becomes a vector of hashed byte 4-grams, projected to a few dimensions; its cell's Hilbert key is the sort key.
Documents are range-partitioned and sorted by (key, id, text hash): neighbours on the curve, which are alike, meet in a sequence.
A task encodes its range and cuts it into sequences of exactly ``length`` tokens; what is left at the end of a range is cut
into sequences of power-of-two lengths, so nothing is padded.  Texts, not ids, are shuffled, and each is encoded once.

A null text is empty and still has its closing id; equal texts share a key and are spread by id; repeated rows are packed
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from watchhouse.llm.common import partitions, worker_cache
from watchhouse.llm.hilbert import hilbert_keys

BUCKETS, DIMENSIONS, BITS = 512, 4, 12
LONG_TEXT = 1_000_000  # beyond this many characters the encoder made for very long words is used
STOP = "<|endoftext|>"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def document_vectors(texts: list[bytes]) -> np.ndarray:
    """Unit vectors of hashed 4-gram counts projected to DIMENSIONS axes; an empty text lies at the origin."""
    axes = np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
        gram = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        counts = np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
        out[row] = counts @ axes / np.sqrt(np.dot(counts, counts))
    return out


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert key of each text."""
    cells = np.clip((document_vectors(texts) + 4.0) / 8.0, 0, 1) * ((1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64), BITS)


def _key_series(texts: pd.Series) -> pd.Series:
    return pd.Series(curve_keys([t.encode() if t else b"" for t in texts]))


def _encoder(path: str):
    """Text -> ids of the byte-level vocabulary in the tokenizer file (its closing token, spelled out in a text, is one id)."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    # the printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stand for themselves, the rest follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocab.items() if token != STOP}
    slow = Tokenizer.from_file(path)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={STOP: slow.token_to_id(STOP)})

    def encode(text: str) -> list[int]:
        if len(text) > LONG_TEXT:
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


class _Packer:
    """Cuts a stream of documents into sequences; the open sequence holds fewer than ``length`` tokens."""

    def __init__(self, length: int, first_id: int):
        self.length, self.next_id, self.open, self.held, self.rows = length, first_id, [], 0, []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            take = min(total - at, self.length - self.held)
            self.open.append((doc_id, at, ids[at:at + take], total))
            self.held += take
            at += take
            if self.held == self.length:
                self._close(self.length)

    def _close(self, size: int) -> None:
        """Emit a sequence of ``size`` tokens from the front of the open pieces."""
        offset = 0
        while offset < size:
            doc_id, start, ids, total = self.open[0]
            part = ids[: size - offset]
            self.rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), total, self.next_id, offset, part))
            offset += len(part)
            if len(part) == len(ids):
                self.open.pop(0)
            else:
                self.open[0] = (doc_id, start + len(part), ids[len(part):], total)
        self.held -= size
        self.next_id += 1

    def finish(self) -> None:
        while self.held:
            self._close(1 << (self.held.bit_length() - 1))

    def batch(self, with_ids: bool) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 8
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array([p.tolist() for p in columns[7]], pa.list_(pa.int32())))
            names.append("ids")
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence; ``with_ids`` adds the piece's token ids."""
    def run(batches):
        encode = worker_cache(f"pack_{zlib.crc32(tokenizer.encode())}", lambda: _encoder(tokenizer))
        packer = _Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc_id, np.array([*encode(text.as_py()), 0], dtype="<u4"))
            yield packer.batch(with_ids)
        packer.finish()
        yield packer.batch(with_ids)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.pandas_udf(_key_series, LongType())
    along = rows.withColumn("_key", key("text")).withColumn("_tie", F.xxhash64("doc_id", "text"))
    ordered = along.repartitionByRange(partitions(docs), "_key", "_tie").sortWithinPartitions("_key", "_tie").select("doc_id", "text")
    return ordered.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
