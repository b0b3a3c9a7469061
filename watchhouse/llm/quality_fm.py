"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: log counts of hashed words (unit length), structure statistics of the text cut into bins, and the
recorded length as metadata.  The score is the logistic of bias + linear terms + low-rank pairwise interactions; the interactions
are summed in linear time as half of (square of sums - sum of squares) per factor.  The model is fitted on a bounded sample
of labelled rows (``max_rows`` with the smallest id hash) and shipped to the tasks, which score every whole text.

A null or empty text has statistics of zero and gets a score like any other; a null n_chars has a bin of its own; repeated rows are
scored each (of a labelled id that stands in several rows one text is learned from, the one of the least hash, so equal scores cannot depend on
the order of rows); without both kinds of label every score is the share of label 1 (0.5 without labels); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.llm.common import worker_cache

WORD_BUCKETS = 4096
FACTORS = 8
BINS = 8
STATISTICS = 14
MAX_TRAINING_ROWS = 8000
EPOCHS = 12
BATCH, LEAST_STEPS = 128, 750  # a small sample is gone through more often
THRESHOLD = 0.3
KEPT_WORDS = 300_000
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20  # texts in memory as features at a time; a longer text stands alone


def slices(batch: pa.RecordBatch):
    """A batch in pieces of bounded text."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    low = 0
    while low < len(batch):
        high, taken = low + 1, lengths[low]
        while high < len(batch) and high - low < SLICE_ROWS and taken + lengths[high] <= SLICE_BYTES:
            taken += lengths[high]
            high += 1
        yield batch.slice(low, high - low)
        low = high


def is_held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def statistics(text: str, words: list[bytes]) -> list[float]:
    """Structure of a text; every entry is a size on a log scale or a share."""
    n, chars = len(words), max(1, len(text))
    count = text.count
    letters_up = len(text) - len(text.translate(_NO_UPPER)) if n else 0
    lines = text.split("\n")
    pairs = set(zip(words, words[1:]))
    return [
        math.log1p(n), len(text) / max(1, n), letters_up / chars,
        sum(map(count, "#*$%&<>@~^_=+")) / chars, count("|") / max(1, n), (count("!") + count("?")) / max(1, n),
        (count(".") + count(",")) / max(1, n), sum(map(count, "0123456789")) / chars, math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines), len(set(words)) / max(1, n), len(pairs) / max(1, n - 1),
        max(map(len, words), default=0), sum(map(count, ";:/\\{}[]()")) / chars,
    ]


_NO_UPPER = {c: None for c in range(65, 91)} | {c: None for c in (*range(0xC0, 0xD7), *range(0xD8, 0xDF))}


def features(texts: list[str], n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words as (row starts, buckets, values), and the dense statistics with the recorded length as last column."""
    cache = worker_cache("fm_words", dict)
    starts, buckets, values, dense = [0], [], [], np.zeros((len(texts), STATISTICS + 1))
    for row, (text, recorded) in enumerate(zip(texts, n_chars)):
        words = text.encode().lower().split()
        if len(cache) > KEPT_WORDS:
            cache.clear()
        ids = np.empty(len(words), dtype=np.int64)
        for at, word in enumerate(words):
            bucket = cache.get(word)
            if bucket is None:
                bucket = cache[word] = zlib.crc32(word) % WORD_BUCKETS
            ids[at] = bucket
        found, counts = np.unique(ids, return_counts=True)
        weight = np.log1p(counts)
        starts.append(starts[-1] + len(found))
        buckets.append(found)
        values.append(weight / max(1e-9, math.sqrt(float(weight @ weight))))
        dense[row, :-1] = statistics(text, words)
        dense[row, -1] = -1 if recorded is None else math.log1p(max(0, recorded))
    return np.array(starts), np.concatenate(buckets or [np.zeros(0, np.int64)]), np.concatenate(values or [np.zeros(0)]), dense


class FactorMachine:
    """Parameters: bias, one weight and FACTORS factors per feature; features are word buckets, then statistic bins."""

    def __init__(self, edges: np.ndarray, bias: float):
        self.edges, self.bias = edges, bias
        self.size = WORD_BUCKETS + len(edges) * (BINS + 1)
        self.weight = np.zeros(self.size)
        self.factor = np.random.default_rng(11).normal(0, 0.05, (self.size, FACTORS))

    def rows(self, feats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of a batch as (row starts, indices, values): each row has its words, then one bin per statistic."""
        starts, buckets, values, dense = feats
        n, stats = dense.shape
        bins = np.stack([np.searchsorted(self.edges[s], dense[:, s], side="right") for s in range(stats)], axis=1)
        bins += WORD_BUCKETS + np.arange(stats) * (BINS + 1)
        at = np.repeat(starts[1:], stats)
        index = np.insert(buckets, at, bins.ravel())
        value = np.insert(values, at, np.full(n * stats, 1 / math.sqrt(stats)))
        return starts + np.arange(n + 1) * stats, index, value

    def raw(self, starts, index, value) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the factor sums of each row."""
        part = self.factor[index] * value[:, None]
        sums = np.add.reduceat(part, starts[:-1], axis=0)
        squares = np.add.reduceat((part * part).sum(1), starts[:-1])
        linear = np.add.reduceat(self.weight[index] * value, starts[:-1])
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, feats) -> np.ndarray:
        if len(feats[3]) == 0:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(feats))[0], -30, 30)))

    def fit(self, feats, labels: np.ndarray, epochs: int, rate: float = 0.15, decay: float = 1e-4) -> None:
        """Adaptive stochastic gradient on the log loss, in a fixed order of batches."""
        starts, index, value = self.rows(feats)
        seen_w, seen_v = np.full(self.size, 1e-3), np.full(self.factor.shape, 1e-3)
        order, rng = np.arange(len(labels)), np.random.default_rng(5)
        for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(order)))):
            rng.shuffle(order)
            for low in range(0, len(order), BATCH):
                rows = order[low:low + BATCH]
                sizes = starts[rows + 1] - starts[rows]
                take = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
                at, i, x = np.concatenate([[0], np.cumsum(sizes)]), index[take], value[take]
                raw, sums = self.raw(at, i, x)
                error = np.repeat(1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows], sizes)
                self.bias -= 0.02 * float(error[at[:-1]].mean())
                step_w = np.bincount(i, error * x, self.size)
                touched = np.unique(i)
                own = self.factor[i] * x[:, None]
                step_v = np.zeros_like(self.factor)
                np.add.at(step_v, i, (error * x)[:, None] * (np.repeat(sums, sizes, axis=0) - own))
                gw = step_w[touched] / len(rows) + decay * self.weight[touched]
                gv = step_v[touched] / len(rows) + decay * self.factor[touched]
                seen_w[touched] += gw * gw
                seen_v[touched] += gv * gv
                self.weight[touched] -= rate * gw / np.sqrt(seen_w[touched])
                self.factor[touched] -= 0.5 * rate * gv / np.sqrt(seen_v[touched])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, epochs: int = EPOCHS) -> FactorMachine | float:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold; a constant where there is nothing to learn."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers; of the rows of one id the one with the least text hash is learned from
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text", "n_chars").alias("_h"), "text", "n_chars", "quality")).alias("r")).select(
        "doc_id", "r.text", "r.n_chars", "r.quality")

    def compact(batches):
        for batch in (piece for whole in batches for piece in slices(whole)):
            starts, buckets, values, dense = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
            spans = list(zip(starts[:-1], starts[1:]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "quality": batch.column("quality").cast(pa.int32()),
                "buckets": pa.array([buckets[a:b].astype(np.int16) for a, b in spans], pa.list_(pa.int16())),
                "values": pa.array([values[a:b].astype(np.float32) for a, b in spans], pa.list_(pa.float32())),
                "dense": pa.array(list(dense), pa.list_(pa.float64())),
            })

    kind = dict(docs.dtypes)["doc_id"]
    rows = texts.mapInArrow(compact, f"doc_id {kind}, quality int, buckets array<smallint>, values array<float>, dense array<double>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
    quality = rows.column("quality").to_numpy().astype(float)
    if len(quality) == 0 or quality.min() == quality.max():
        return float(quality.mean()) if len(quality) else 0.5
    flat = lambda name, kind: np.concatenate([np.asarray(v.values, dtype=kind) for v in rows.column(name)])
    sizes = [len(v) for v in rows.column("buckets")]
    feats = (np.concatenate([[0], np.cumsum(sizes)]), flat("buckets", np.int64), flat("values", float), flat("dense", float).reshape(len(quality), -1))
    edges = np.stack([np.quantile(feats[3][:, s], np.arange(1, BINS + 1) / (BINS + 1)) for s in range(feats[3].shape[1])])
    share = quality.mean()
    machine = FactorMachine(edges, math.log(share / (1 - share)))
    machine.fit(feats, quality, epochs)
    return machine


def score(docs: DataFrame, model: FactorMachine | float) -> DataFrame:
    """``docs`` with score and predicted; columns of these names are replaced, all others carried on."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*names)

    def run(batches):
        for batch in batches:
            found = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            at = 0
            for piece in slices(batch) if not isinstance(model, float) else ():
                texts = [t or "" for t in piece.column("text").to_pylist()]
                found[at:at + len(texts)] = model.score(features(texts, piece.column("n_chars").to_pylist()))
                at += len(texts)
            arrays = [*batch.columns, pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "score", "predicted"])

    return kept.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", score double, predicted int")
