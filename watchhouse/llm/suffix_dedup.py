"""Removal of repeated byte strings by a sparse, hash-compared suffix sort.

A byte goes when some string of ``width`` bytes that covers it also starts anywhere else.  Sorting the suffixes of all places of a
large corpus is out of reach, and needless: equal strings agree on their minimizer, the leftmost least hash among their 32-byte
grams.  So one suffix per minimizer (anchor) is sorted, together with the bytes to its left:

1. every text yields its anchors, each with the run of window starts it stands for; anchors are counted by gram over all
   texts, and those that stand alone are settled;
2. the others bring their context (the bytes that the run's windows cover).  Equal contexts become one row with a count;
3. the contexts of a gram are sorted by the suffix at the anchor: a mergesort whose comparisons find the common extension by binary
   search on prefix polynomial hashes.  For each extension to the left, neighbours in this order that agree on it share the
   longest possible string; where left and right extension reach ``width`` the window is repeated.  The bytes of every match are
   compared, so a hash collision removes nothing;
4. the repeated windows go back to the texts, where they are joined and cut out.

A gram in very many places (more than ``GROUP``) is dealt over several sorts by its context; what stays single in its part
is then matched with the windows of the other parts by two 64-bit hashes, in a plain aggregate.

A null text is empty; texts of any length are read in overlapping stretches; repeated rows count as different places, so their
strings are repeated (rows equal in id and text share their runs and ranges, so the work grows with their number only); windows of equal bytes are ties and both go; an empty table gives no rows; other columns are carried
on only by ``dedup_documents``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchhouse.llm.common import partitions, stored, worker_cache

WIDTH, GRAM = 200, 32
REACH = WIDTH - GRAM  # farthest place of an anchor within its window
STRETCH = 1 << 20
GROUP = 4096  # contexts sorted together
_PLACE_BITS = np.uint64(21)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte value, and the powers of an odd base and of its inverse modulo 2^64."""
    rng = np.random.default_rng(2024)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    power = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(STRETCH + 2 * WIDTH, b, dtype=np.uint64), dtype=np.uint64)])
    return values, power(np.uint64(base)), power(np.uint64(inverse))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of windows with one minimizer: gram hash, its place, first and last window start."""
    values, power, inverse = worker_cache("dedup_tables", _tables)
    out = [[], [], [], []]
    for base in range(0, len(data) - WIDTH + 1, STRETCH):
        raw = np.frombuffer(data[base:base + STRETCH + WIDTH - 1], dtype=np.uint8)
        starts = len(raw) - WIDTH + 1
        total = np.empty(len(raw) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(values[raw] * power[:len(raw)], out=total[1:])
        gram = (total[GRAM:] - total[:-GRAM]) * inverse[:len(raw) - GRAM + 1]
        mixed = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        # hash above, place below: the least entry is the leftmost of the least grams
        least = (mixed >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(mixed), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32, 64):
            least = np.minimum(least[:-step], least[step:])
        rest = REACH + 1 - 128
        place = (np.minimum(least[:starts], least[rest:rest + starts]) & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [starts - 1]])
        for column, found in zip(out, (mixed[place[first]].astype(np.int64), place[first] + base, first + base, last + base)):
            column.append(found)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def _find_anchors(batches):
    """key, owner and packed place of every anchor: place << 16 | bytes from the run's first start | starts after the first."""
    for batch in batches:
        keys, packed, sizes = [], [], []
        for text in batch.column("text"):
            key, place, first, last = anchors(text.as_py())
            keys.append(key)
            packed.append(place << 16 | (place - first) << 8 | last - first)
            sizes.append(len(key))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        yield pa.RecordBatch.from_pydict({
            "key": join(keys), "k": batch.column("k").take(pa.array(owner)), "h": batch.column("h").take(pa.array(owner)), "at": join(packed)})


def _context_id(key: int, left: int, context: bytes) -> bytes:
    return hashlib.blake2b(context, digest_size=16, salt=(key & (1 << 64) - 1).to_bytes(8, "little") + left.to_bytes(8, "little")).digest()


def _contexts(with_bytes: bool):
    """The contexts of a document's open runs; with_bytes chooses the sort's columns or the owner's."""
    def run(batches):
        for batch in batches:
            rows = []
            for k, h, text, runs in zip(*(batch.column(c) for c in ("k", "h", "text", "runs"))):
                data, k, h = text.as_py(), k.as_py(), h.as_py()
                for at in runs.as_py():
                    place, left, span = at["at"] >> 16, at["at"] >> 8 & 255, at["at"] & 255
                    context = data[place - left:place - left + span + WIDTH]
                    if with_bytes:
                        rows.append((at["key"], at["n"], left, context))
                    else:
                        rows.append((_context_id(at["key"], left, context), k, h, place - left))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()] if with_bytes else [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["key", "n", "left", "context"] if with_bytes else ["cid", "k", "h", "first"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
    return run


class SuffixSort:
    """Contexts of several grams, sorted by (gram, suffix at the anchor)."""

    def __init__(self, group: np.ndarray, lefts: list[int], contexts: list[bytes]):
        n = len(contexts)
        self.group, self.contexts = group, contexts
        self.left_len = np.array(lefts)
        self.right_len = np.array([min(len(c) - x, WIDTH) for c, x in zip(contexts, lefts)])
        self.right, self.left = np.zeros((n, WIDTH + 1), np.uint8), np.zeros((n, REACH + 1), np.uint8)
        for i, (context, x) in enumerate(zip(contexts, lefts)):
            raw = np.frombuffer(context, np.uint8)
            self.right[i, :self.right_len[i]] = raw[x:x + WIDTH]
            self.left[i, :x] = raw[:x][::-1]
        self.right_hash, self.left_hash = self._prefixes(self.right), self._prefixes(self.left)
        self.order = self._sort()

    @staticmethod
    def _prefixes(block: np.ndarray) -> np.ndarray:
        """Polynomial hash of every prefix of every row."""
        values, power, _ = worker_cache("dedup_tables", _tables)
        out = np.zeros((len(block), block.shape[1] + 1), np.uint64)
        np.cumsum(values[block] * power[:block.shape[1]], axis=1, out=out[:, 1:])
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension to the right, by binary search on the prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.right_len[i], self.right_len[j])
        for _ in range(WIDTH.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.right_hash[i, middle] == self.right_hash[j, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def _before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether entry i sorts before entry j: by group, suffix, then index."""
        shared = self.common(i, j)
        a, b = self.right[i, shared].astype(np.int16), self.right[j, shared].astype(np.int16)
        a, b = np.where(shared < self.right_len[i], a, -1), np.where(shared < self.right_len[j], b, -1)
        return np.where(self.group[i] != self.group[j], self.group[i] < self.group[j], np.where(a != b, a < b, i < j))

    def _sort(self) -> np.ndarray:
        """Bottom-up mergesort; every element finds its place in the sibling run by binary search, all at once."""
        n = len(self.group)
        order = np.argsort(self.group, kind="stable")
        size = 1
        while size < n:
            at = np.arange(n)
            run = at // size
            sibling = run ^ 1
            begin, stop = np.minimum(sibling * size, n), np.minimum((sibling + 1) * size, n)
            low, high = begin.copy(), stop.copy()
            for _ in range(size.bit_length()):
                open_ = low < high
                if not open_.any():
                    break
                who = np.flatnonzero(open_)
                middle = (low[who] + high[who]) >> 1
                less = self._before(order[middle], order[who])
                low[who] = np.where(less, middle + 1, low[who])
                high[who] = np.where(less, high[who], middle)
            target = np.minimum(run, sibling) * size + (at - run * size) + (low - begin)
            merged = np.empty_like(order)
            merged[target] = order
            order, size = merged, size * 2
        return order

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, left extension, class) of every window in the contexts; a class holds the equal windows of a group."""
        order, found = self.order, []
        offset = 0
        for left in range(REACH + 1):
            right = WIDTH - left
            have = order[(self.left_len[order] >= left) & (self.right_len[order] >= right)]
            if len(have) == 0:
                continue
            # stable: within equal left extensions the suffix order is kept
            have = have[np.lexsort((self.left_hash[have, left], self.group[have]))]
            a, b = have[:-1], have[1:]
            same = (self.group[a] == self.group[b]) & (self.left_hash[a, left] == self.left_hash[b, left]) & (self.right_hash[a, right] == self.right_hash[b, right])
            same[same] = self._verified(a[same], b[same], left)
            label = np.concatenate([[0], np.cumsum(~same)]) + offset
            offset = label[-1] + 1
            found.append((have, np.full(len(have), left), label))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def _verified(self, a: np.ndarray, b: np.ndarray, left: int) -> np.ndarray:
        """Compare the bytes themselves."""
        right = WIDTH - left
        out = np.empty(len(a), bool)
        for low in range(0, len(a), 65536):
            i, j = a[low:low + 65536], b[low:low + 65536]
            out[low:low + 65536] = (self.right[i, :right] == self.right[j, :right]).all(1) & (self.left[i, :left] == self.left[j, :left]).all(1)
        return out


def _spans(starts: np.ndarray) -> list[dict]:
    """Byte ranges covered by the windows at the given starts."""
    starts = np.sort(starts)
    cut = np.flatnonzero(np.diff(starts) > WIDTH) + 1
    return [{"from": int(p[0]), "to": int(p[-1]) + WIDTH} for p in np.split(starts, cut) if len(p)]


def _resolve(batches):
    """Sort the contexts of each (key, part) and report, per context, its repeated ranges; parts of a hot gram also report their windows."""
    held: list[tuple] = []

    def settle(rows):
        out = []
        keys, parts, lots = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        counts, lefts, contexts = np.array([r[3] for r in rows]), [r[4] for r in rows], [r[5] for r in rows]
        group = np.cumsum([0] + [x != y for x, y in zip(zip(keys[1:], parts[1:]), zip(keys, parts))])
        sort = SuffixSort(group, lefts, contexts)
        who, left, label = sort.repeated()
        size = np.bincount(label, weights=counts[who]) if len(label) else np.zeros(0)
        single = size[label] == 1 if len(label) else np.zeros(0, bool)
        first = np.zeros(len(label), bool)
        first[np.unique(label, return_index=True)[1]] = True
        ids = [_context_id(k, x, c) for k, x, c in zip(keys, lefts, contexts)]
        again = who[~single]
        by = np.argsort(again, kind="stable")
        starts = (np.array(lefts)[who] - left)[~single][by]
        for piece in np.split(np.arange(len(by)), np.flatnonzero(np.diff(again[by])) + 1) if len(by) else []:
            out.append((ids[again[by[piece[0]]]], _spans(starts[piece]), None, None, None, None, None))
        # one window of each class stands for its part
        for i in np.flatnonzero(first & (np.array(lots)[who] > 1)) if len(who) else []:
            w, x = who[i], int(left[i])
            out.append((ids[w], [{"from": lefts[w] - x, "to": lefts[w] - x + WIDTH}], keys[w], x, sort.left_hash[w, x].astype(np.int64).item(),
                        sort.right_hash[w, WIDTH - x].astype(np.int64).item(), bool(single[i])))
        return out

    def emit(rows):
        columns = list(zip(*rows)) or [()] * 7
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        kinds = [pa.binary(), span, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["cid", "spans", "key", "ext", "left_hash", "right_hash", "single"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "parts", "n", "left", "context"))):
            if len(held) >= GROUP and row[:2] != held[-1][:2]:
                yield emit(settle(held))
                held = []
            held.append(row)
    if held:
        yield emit(settle(held))


_RESOLVED = ("cid binary, spans array<struct<from: bigint, to: bigint>>, key bigint, ext bigint, left_hash bigint, right_hash bigint, single boolean")


def _repeated_ranges(docs: DataFrame, group: int) -> DataFrame:
    """(k, h, ranges) of the documents (k, h, text as binary) that have repeated strings."""
    n = partitions(docs)
    found = docs.mapInArrow(_find_anchors, "key bigint, k bigint, h bigint, at bigint")
    shared = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # sets, as rows equal in id and text share a name: each run is held once however many they are
    open_runs = found.join(shared, "key").groupBy("k", "h").agg(F.collect_set(F.struct("key", "n", "at")).alias("runs"))
    with_text = docs.join(open_runs, ["k", "h"])
    contexts = with_text.mapInArrow(_contexts(True), "key bigint, n bigint, left bigint, context binary")
    distinct = contexts.groupBy("key", "n", "left", "context").agg(F.count("*").alias("copies"))
    parts = F.ceil(F.col("n") / group).cast("long")
    dealt = distinct.select("key", F.pmod(F.xxhash64("context"), parts).alias("part"), parts.alias("parts"), F.col("copies").alias("n"), "left", "context")
    resolved = stored(
        dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part", "left", "context").mapInArrow(_resolve, _RESOLVED), "repeats")
    windows = resolved.where("key IS NOT NULL")
    same = ["key", "ext", "left_hash", "right_hash"]
    elsewhere = windows.groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    late = windows.where("single").join(elsewhere, same).select("cid", "spans")
    ranges = resolved.where("key IS NULL").select("cid", "spans").unionByName(late)
    owners = with_text.mapInArrow(_contexts(False), "cid binary, k bigint, h bigint, first bigint")
    moved = F.transform("spans", lambda s: F.struct((s["from"] + F.col("first")).alias("from"), (s["to"] + F.col("first")).alias("to")))
    return owners.join(ranges, "cid").select("k", "h", moved.alias("spans")).groupBy("k", "h").agg(F.flatten(F.collect_set("spans")).alias("ranges"))


def _merge(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes."""
    out: list[list[int]] = []
    for low, high in sorted((r["from"], r["to"]) for r in ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(r) for r in out]


def _marked(docs: DataFrame, names: list[str], group: int) -> DataFrame:
    """Documents with their text as binary, the columns ``names``, and the repeated ranges (null: none)."""
    # (k, h) names a row by its id and text; both are never null, so every join reads one and the same exchange of the texts
    keyed = docs.select(
        *names, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"),
        F.xxhash64("doc_id", "text").alias("h"))
    return keyed.join(_repeated_ranges(keyed.select("k", "h", "text"), group), ["k", "h"], "left")


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                data, cut = text.as_py(), _merge(ranges.as_py() or [])
                kept, at = [], 0
                for low, high in cut:
                    kept.append(data[at:low])
                    at = high
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((len(data), len(data) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    marked = _marked(docs.withColumn("_id", F.col("doc_id")), ["_id"], group)
    return marked.select("_id", "text", "ranges").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup_documents(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``docs`` with the repeated bytes cut from the text and n_chars counted anew; a character cut through goes as a whole."""
    names = [c for c in docs.columns if c not in ("text", "n_chars", "k", "h", "ranges")]
    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in names) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                data, kept, at = text.as_py(), [], 0
                for low, high in _merge(ranges.as_py() or []):
                    kept.append(data[at:low].decode("utf-8", "ignore"))
                    at = high
                kept.append(data[at:].decode("utf-8", "ignore"))
                texts.append("".join(kept))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*names, "text", "n_chars"])

    return _marked(docs, names, group).select(*names, "text", "ranges").mapInArrow(run, schema)
