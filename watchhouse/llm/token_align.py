"""Alignment of two tokenizers by sparse products of token-byte incidence matrices.

Each text is encoded twice (the byte-level vocabulary A by a second library with the same ids where a text is short and of common
letters).  A tokenization is a matrix in CSR form: one row per token, one column per byte, ones where the token
covers the byte.  Gustavson's row products A . B^T give for every token of A the tokens of B whose bytes overlap its own (the value
is the number of shared bytes): the overlap links.  Byte offsets where tokens of both end cut the tokens into groups; the product of
the two group incidences gives the shared-group links, of which only the row sizes are formed (the symbolic half of the product), as
a group of many tokens would have the square of their number.

How many documents hold an id pair linked is counted over the whole corpus.  Documents are dealt into chunks of bounded text; a chunk
lists its distinct pairs once, so counts are added up, and handed back, per chunk and pair instead of per document and pair.

Texts that are null or empty, or whose joined tokens are not the bytes of space + text for both tokenizers, have no tokens: zeros
and an empty digest.  Ties for the highest count all count as best.  Repeated rows are documents of their own and count as such; a
text larger than a chunk is a chunk of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchhouse.llm.common import stored, worker_cache

CHUNK_BYTES = 8 << 20  # text of a chunk, or one document
SLICE_BYTES = 1 << 20  # text encoded and multiplied at a time
ID_BITS = 20
LONG_TEXT = 1 << 17  # bytes; beyond them, and from U+0500 on, where tables of letters may differ, A's own library encodes


@dataclass
class Csr:
    """A sparse matrix: the entries of row i stand at start[i]:start[i + 1]."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    columns: int

    @classmethod
    def of_spans(cls, lengths: np.ndarray) -> Csr:
        """Row i covers the ``lengths[i]`` columns after those of the rows before it."""
        start = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return cls(start, np.arange(start[-1]), np.ones(start[-1], np.int64), int(start[-1]))

    @property
    def row(self) -> np.ndarray:
        """Row of every entry."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def transposed(self) -> Csr:
        order = np.argsort(self.column, kind="stable")
        counts = np.bincount(self.column, minlength=self.columns)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), self.row[order], self.value[order], len(self.start) - 1)

    def product_sizes(self, other: Csr) -> np.ndarray:
        """Terms of every row of ``self . other``: the symbolic half of the product."""
        terms = np.concatenate([[0], np.cumsum(np.diff(other.start)[self.column])])
        return np.diff(terms[self.start])

    def product(self, other: Csr) -> Csr:
        """``self . other`` by rows: every entry of a row brings the row of ``other`` it points to, and equal columns are added."""
        sizes = np.diff(other.start)[self.column]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) - np.repeat(ends - sizes - other.start[self.column], sizes)
        key = np.repeat(self.row, sizes) * max(1, other.columns) + other.column[source]
        value = np.repeat(self.value, sizes) * other.value[source]
        if total and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
        row, column = np.divmod(key[first], max(1, other.columns))
        counts = np.bincount(row, minlength=len(self.start) - 1)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), column, np.add.reduceat(value, first) if total else value, other.columns)


class Tokenizers:
    """Both encoders, and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor already use its cores
        self.a = Tokenizer.from_file(byte_bpe)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        with open(byte_bpe, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary, special = described["model"]["vocab"], {t["content"] for t in described.get("added_tokens") or []}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = sorted(set(range(256)) - set(plain))
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {self.a_bytes[i]: i for token, i in vocabulary.items() if token not in special}
        self.fast_a = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        # the digits of an id with what follows it in the written groups
        self.written = ([f"{i}," for i in range(len(self.a_bytes))] + [f"{i}|" for i in range(len(self.a_bytes))]
                        + [f"{i}," for i in range(len(self.b_bytes))] + [f"{i};" for i in range(len(self.b_bytes))])

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text by both, empty where there are no tokens by definition."""
        wholes = [(" " + t).encode() for t in texts]
        fast = [len(w) <= LONG_TEXT and int(np.frombuffer(w, np.uint8).max()) < 0xD4 for w in wholes]
        slow = [" " + t for t, f in zip(texts, fast) if not f]
        rest = iter(self.a.encode_batch_fast(slow, add_special_tokens=False) if slow else [])
        a = [self.fast_a.encode_ordinary(" " + t) if f else next(rest).ids for t, f in zip(texts, fast)]
        b = self.b.encode(texts, num_threads=1)
        out = []
        for text, whole, x, y in zip(texts, wholes, a, b):
            fits = text and b"".join(map(self.a_bytes.__getitem__, x)) == whole and b"".join(map(self.b_bytes.__getitem__, y)) == whole
            out.append((x, y) if fits else ([], []))
        return out


def aligned(coders: Tokenizers, texts: list[str]) -> tuple[list[dict], list[np.ndarray], list[np.ndarray]]:
    """Of each text its measures, its distinct linked id pairs (A id above ID_BITS bits of B id) and how often each is linked."""
    ids = coders.encode(texts)
    n_a, n_b = np.array([len(a) for a, _ in ids]), np.array([len(b) for _, b in ids])
    a = np.array([i for x, _ in ids for i in x], dtype=np.int64)
    b = np.array([i for _, x in ids for i in x], dtype=np.int64)
    of_a, of_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    # the texts of a slice stand one after another on the byte axis: a block-diagonal product
    tokens_a, tokens_b = Csr.of_spans(coders.a_length[a]), Csr.of_spans(coders.b_length[b])
    links = tokens_a.product(tokens_b.transposed())
    pair = (a[links.row] << ID_BITS) | b[links.column]

    common = np.intersect1d(tokens_a.start[1:], tokens_b.start[1:], assume_unique=True)
    group_a, group_b = np.searchsorted(common, tokens_a.start[1:]), np.searchsorted(common, tokens_b.start[1:])
    in_group_a = Csr(np.arange(len(a) + 1), group_a, np.ones(len(a), np.int64), len(common))
    in_group_b = Csr(np.arange(len(b) + 1), group_b, np.ones(len(b), np.int64), len(common))
    shared = in_group_a.product_sizes(in_group_b.transposed())
    # tokens of A and then of B, group by group
    written = np.empty(len(a) + len(b), dtype=np.int64)
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=len(common)))])
    before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=len(common)))])
    last_a, last_b = np.isin(tokens_a.start[1:], common), np.isin(tokens_b.start[1:], common)
    vocabulary_a, vocabulary_b = len(coders.a_bytes), len(coders.b_bytes)
    written[np.arange(len(a)) + before_b[group_a]] = a + last_a * vocabulary_a
    written[np.arange(len(b)) + before_a[group_b + 1]] = b + 2 * vocabulary_a + last_b * vocabulary_b

    rows = len(texts)
    group_of = np.bincount(of_a[last_a], minlength=rows)
    n_links = np.bincount(of_a[links.row], minlength=rows)
    n_shared = np.zeros(rows, np.int64)
    np.add.at(n_shared, of_a, shared)
    ends = np.cumsum(n_a + n_b)
    # of_a is sorted, so pairs sorted within documents stay sorted by document
    key, times = np.unique((of_a[links.row] << 2 * ID_BITS) | pair, return_counts=True)
    cut = np.searchsorted(key >> 2 * ID_BITS, np.arange(rows + 1))
    key &= (1 << 2 * ID_BITS) - 1
    measures = []
    for row in range(rows):
        codes = written[ends[row] - n_a[row] - n_b[row]:ends[row]].tolist()
        groups = "".join(map(coders.written.__getitem__, codes))[:-1]
        measures.append({
            "n_a": int(n_a[row]), "n_b": int(n_b[row]), "n_groups": int(group_of[row]), "n_links": int(n_links[row]), "n_shared": int(n_shared[row]),
            "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if codes else ""})
    return measures, [key[cut[i]:cut[i + 1]] for i in range(rows)], [times[cut[i]:cut[i + 1]] for i in range(rows)]


_MEASURES = "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string"


def align_documents(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """Per document its measures, n_best and count_sum; n_shared is the number of shared-group links."""
    kind = dict(docs.dtypes)["doc_id"]

    def encode(batches):
        coders = worker_cache(f"align_{zlib.crc32((byte_bpe + piece_bpe).encode())}", lambda: Tokenizers(byte_bpe, piece_bpe))
        part, chunk = TaskContext.get().partitionId(), 0
        held, size = [], 0  # document ids, measures, pairs, times

        def close():
            pairs = [p for _, _, p, _ in held]
            distinct, place, documents = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            cut = np.cumsum([0, *map(len, pairs)])
            place = place.astype(np.int32)
            number = (part << 32) + chunk
            n = len(held)
            columns = {"doc_id": pa.concat_arrays([*(i for i, *_ in held), pa.nulls(1, held[0][0].type)]), "chunk": pa.array([number] * (n + 1), pa.int64())}
            for name in held[0][1]:
                columns[name] = pa.array([m[name] for _, m, _, _ in held] + [None], pa.string() if name == "groups_sha256" else pa.int64())
            columns["place"] = pa.array([place[cut[i]:cut[i + 1]].tobytes() for i in range(n)] + [None], pa.binary())
            columns["times"] = pa.array([t.astype(np.int32).tobytes() for _, _, _, t in held] + [None], pa.binary())
            columns["a"] = pa.array([None] * n + [distinct >> ID_BITS], pa.list_(pa.int32()))
            columns["b"] = pa.array([None] * n + [distinct & ((1 << ID_BITS) - 1)], pa.list_(pa.int32()))
            columns["documents"] = pa.array([None] * n + [documents], pa.list_(pa.int64()))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            low = 0
            while low < len(batch):
                high, taken = low + 1, lengths[low]
                while high < len(batch) and taken + lengths[high] <= SLICE_BYTES:
                    taken += lengths[high]
                    high += 1
                if held and size + taken > CHUNK_BYTES:
                    yield close()
                    held, size, chunk = [], 0, chunk + 1
                some = [t.as_py() or "" for t in texts[low:high]]
                for n, (measure, pairs, times) in enumerate(zip(*aligned(coders, some))):
                    held.append((ids.slice(low + n, 1), measure, pairs, times))
                size += taken
                low = high
        if held:
            yield close()

    encoded = stored(docs.select("doc_id", "text").mapInArrow(
        encode, f"doc_id {kind}, chunk long, {_MEASURES}, place binary, times binary, a array<int>, b array<int>, documents array<long>"), "token-links")
    lists = encoded.where("a IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("a", "b", "documents")).alias("at", "p")).select("chunk", "at", "p.*")
    totals = lists.groupBy("a", "b").agg(F.sum("documents").alias("total"))
    highest = totals.groupBy("a").agg(F.max("total").alias("highest"))
    counted = totals.join(highest, "a").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best"))
    back = lists.join(counted, ["a", "b"]).select(F.col("chunk").alias("of_chunk"), "at", "total", "best")
    told = encoded.where("a IS NULL").drop("a", "b", "documents")
    names = ["doc_id", *[m.split()[0] for m in _MEASURES.split(", ")]]

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a chunk with the counts of its pairs."""
        order = right.column("at").to_numpy()
        total, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        total[order], best[order] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for place, times in zip(left.column("place"), left.column("times")):
            place, times = np.frombuffer(place.as_py(), np.int32), np.frombuffer(times.as_py(), np.int32).astype(np.int64)
            sums.append(int(total[place] @ times))
            bests.append(int(best[place] @ times))
        return left.select(names).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return told.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(add_up, f"doc_id {kind}, {_MEASURES}, n_best long, count_sum long")
