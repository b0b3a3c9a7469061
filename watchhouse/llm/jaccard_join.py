"""N-gram Jaccard join with vertical partitioning.

A document is its set of distinct five-word shingles, as 64-bit hashes; the hash value is the global order.  Two documents link
when 100 * intersection >= 75 * union.

Candidates, in two steps.  Of any linking pair each has at least 75 % of its shingles in the other.  So the first E shingles of both in
the global order share at least a known number of shingles (see ``_common``); a set of which fewer are found in any other set links
with nothing and goes no further.  The others, mostly a small part, are indexed whole: put in the order of their frequency, the
rarest quarter of the shingles of both share at least one, and from the first common one on both must have as many shared shingles
left as the link needs.  Shingles that no other set has count against a set here, so most edited copies of one text that differ by
more than the threshold never meet.  Documents that share one of those rarest shingles form a block.  Pairs within a block are not
listed: one member is compared with all others, linked members become one component, and only pairs across components go on, with
GROWTH times as many members compared in the next round, until a round has compared every member (the last one all that are left, where these are few) or a block is one component.  No
block is cut short, so no link between components is lost.

Verification.  The global order is cut into FRAGMENTS equal ranges.  Every candidate pair counts its common shingles in each range
separately, and the counts are summed per pair.  Before that, parity bitmaps of SKETCH bits bound the overlap from above: bits that
differ are at most as many as the shingles that only one of the two has.  So no linking pair is lost, and the sets of most
others are never fetched.  Sets lie in a table bucketed by set id, so that pairs move to them.

Documents with equal sets are one class from the start and are compared once.  A document without words has an empty set and
links with nothing; a text of any length is read whole; repeated rows (also of one doc_id) fall into one class; a null doc_id takes part
but names no component; ties cannot arise, as all comparisons are between integers; an empty table gives no rows; other columns
are ignored by ``components`` and carried on by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchhouse.llm.common import partitions, stored, worker_cache
from watchhouse.llm.components import connect
from watchhouse.session import shared_dir

SHINGLE = 5
FRAGMENTS = 4
SKETCH = 1024  # bits; beyond some 1 700 shingles a bitmap is full and turns no pair away
WHOLE = 128  # sets of up to this size are indexed whole
COMMON = 64  # from this frequency on shingles count as equally common
GROWTH = 8
FEW = 64  # comparisons a member that are made in one round
KEPT_WORDS = 300_000
SLICE = 4 << 20  # shingles indexed at a time, or one set
_SIGN = np.uint64(1 << 63)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes (unsigned)."""
    words = text.lower().split()  # both of ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    cache = worker_cache("shingle_words", dict)
    if len(cache) > KEPT_WORDS:
        cache.clear()
    for word in set(words).difference(cache):
        cache[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    codes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, np.uint64)
    for step in range(width):
        total = (total + codes[step:step + count]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def _set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _indexed(n: int) -> int:
    """E: how many shingles of a set of n are indexed."""
    return min(n, max(WHOLE, -(-3 * n // 8)))


def _keys(batches):
    """doc_id, text hash, set size, set id (null for an empty set) and, once a set in each batch, its indexed shingles."""
    for batch in batches:
        sizes, ids, heads, seen = [], [], [], set()
        for text in batch.column("text").cast(pa.binary()):
            found = shingles(text.as_py())
            sizes.append(len(found))
            ids.append(_set_id(found) if len(found) else None)
            heads.append(None if ids[-1] is None or ids[-1] in seen else found[:_indexed(len(found))].view(np.int64))
            seen.add(ids[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(heads, pa.list_(pa.int64()))],
            ["doc_id", "th", "n_shingles", "sid", "head"])


def _index(batches):
    """Sets (sid, head) as rows of (deal, h, sid, df); deal tells where a row is to go.

    A shingle that is common within a slice of a batch already is settled at once (df = COMMON): its rows go by set, and one row
    without a set tells the others.  So the most frequent shingle sends one row per slice to its counting task.
    """
    for batch in batches:
        ids, heads = batch.column("sid").to_numpy(), batch.column("head")
        ends = np.cumsum(np.diff(heads.offsets.to_numpy()))
        low = 0
        while low < len(batch):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
            sets, first = np.unique(ids[low:high], return_index=True)
            some = heads.slice(low, high - low).take(pa.array(first))
            h, sid = some.flatten().to_numpy(), np.repeat(sets, np.diff(some.offsets.to_numpy()))
            low = high
            _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
            common = times[inverse] >= COMMON
            told = np.unique(h[common])
            yield pa.RecordBatch.from_pydict({
                "deal": np.concatenate([np.where(common, sid, h), told]), "h": np.concatenate([h, told]),
                "sid": pa.array(np.concatenate([sid, np.zeros(len(told), np.int64)]), mask=np.concatenate([np.zeros(len(sid), bool), np.ones(len(told), bool)])),
                "df": np.concatenate([np.where(common, COMMON, 0), np.full(len(told), COMMON)]).astype(np.int32)})


def _frequencies(batches):
    """(sid, h, df) of shingles that two sets or more have, from rows sorted by (settled, h, sid); df stops at COMMON.

    Only the last, unfinished run is carried from batch to batch, and no more than COMMON rows of it.
    """
    def counted(h, sid, told):
        """Rows of complete runs."""
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])])
        h, sid, told = h[fresh], sid[fresh], told[fresh]
        run = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        df = np.bincount(run, weights=np.where(told, COMMON, 1))[run].astype(np.int32)
        take = ~told & (df > 1)
        return h[take], sid[take], np.minimum(df[take], COMMON)

    def emit(h, sid, df):
        return pa.RecordBatch.from_pydict({"sid": sid, "h": h, "df": df.astype(np.int32)})

    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    held, flooded = empty, None
    for batch in batches:
        df = batch.column("df").to_numpy()
        valid = np.asarray(batch.column("sid").is_valid())
        h, sid = batch.column("h").to_numpy(), batch.column("sid").fill_null(0).to_numpy()
        settled = valid & (df > 0)
        if settled.any():
            yield emit(h[settled], sid[settled], df[settled])
        h, sid, told = h[~settled], sid[~settled], ~valid[~settled]
        if flooded is not None:  # the run known to be common goes on
            rest = h == flooded
            yield emit(h[rest & ~told], sid[rest & ~told], np.full(int((rest & ~told).sum()), COMMON))
            if not rest.all():
                flooded = None
            h, sid, told = h[~rest], sid[~rest], told[~rest]
        h, sid, told = (np.concatenate(p) for p in zip(held, (h, sid, told)))
        if len(h) == 0:
            held = empty
            continue
        last = int(np.searchsorted(-(h[::-1] == h[-1]).astype(int), 0)) if not (h == h[-1]).all() else len(h)
        cut = len(h) - last
        if cut:
            yield emit(*counted(h[:cut], sid[:cut], told[:cut]))
        h, sid, told = h[cut:], sid[cut:], told[cut:]
        if told.any() or len(np.unique(sid)) > COMMON:
            flooded = h[-1]
            yield emit(h[~told], sid[~told], np.full(int((~told).sum()), COMMON))
            held = empty
        else:
            keep = np.concatenate([[True], sid[1:] != sid[:-1]])
            held = h[keep], sid[keep], told[keep]
    if len(held[0]):
        yield emit(*counted(*held))


def _common():
    """SQL of a lower bound of the shingles that a set of n and any set it links with share among their indexed ones.

    A set of m keeps m - floor(m / 4) or more of its shingles in common with any partner; of the first E(m) at most
    floor(m / 4) are missing, so k(m) = E(m) - floor(m / 4) of the first common ones are indexed.  The pair has the lesser k.
    Partners have sizes from 3n/4 to 4n/3; k falls between WHOLE and 8/3 WHOLE only, so its least value is at an end of
    the range, at n, or at that valley.
    """
    k = lambda m: f"(least({m}, greatest({WHOLE}L, ({m} * 3 + 7) div 8)) - {m} div 4)"
    valley = WHOLE * 8 // 3
    low, high = "bigint(ceil(n * 0.75D))", "(n * 4 div 3)"
    ends = [k(low), k(high), k("n")]
    inner = [f"if({m} between {low} and {high}, {k(f'{m}L')}, {k('n')})" for m in (valley - 2, valley - 1, valley, valley + 1, valley + 2, valley + 3)]
    return f"greatest(1L, least({', '.join(ends + inner)}) - 1)"


# A linking pair has at least 75/175 of its joint size in common; from the first common shingle on both must have that many left.
_POSSIBLE = "least(rest, _rest) >= (75 * (n + _n) + 174) div 175"


def _shared(sets: DataFrame) -> DataFrame:
    """(sid, h, df) of the shingles of sets (sid, head) that two sets or more have, with sid's rows in one partition."""
    n = partitions(sets)
    found = sets.mapInArrow(_index, "deal long, h long, sid long, df int").repartition(n, "deal").sortWithinPartitions("h", "sid")
    return found.mapInArrow(_frequencies, "sid long, h long, df int").repartition(n, "sid").dropDuplicates(["sid", "h"])


def _likely(heads: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sid, n) of the sets of whose indexed shingles others have as many as a link needs."""
    counts = _shared(heads).groupBy("sid").agg(F.count("*").alias("_all"))
    return counts.join(sizes, "sid").where(f"_all >= {_common()}").select("sid", "n")


def _blocks(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(h, sid, n, rest, lone): the rarest shingles of sets (sid, head) given whole, which each linking pair shares one of.

    rest: how many of the shingles of the set that others have too come from here on; lone: the share that no other set has.
    A linking pair has 75 % of either in common, so the first common one has that many after it.
    """
    rare = Window.partitionBy("sid").orderBy("df", "h")
    ranked = _shared(sets).join(sizes, "sid").withColumn("_rank", F.row_number().over(rare)).withColumn("_all", F.count("*").over(Window.partitionBy("sid")))
    rest = (F.col("_all") - F.col("_rank") + 1).cast("int")
    return ranked.withColumn("rest", rest).where("4L * rest >= 3 * n").select("h", "sid", "n", "rest", (1 - F.col("_all") / F.col("n")).cast("float").alias("lone"))


def _fragments(batches):
    """(sid, parts, sketch): a set cut at equal ranges of the global order, and the parity of its shingles per bit of the sketch."""
    edges = np.array([part << (64 - FRAGMENTS.bit_length() + 1) for part in range(1, FRAGMENTS)], np.uint64)
    for batch in batches:
        parts, sketches = [], []
        for text in batch.column("text").cast(pa.binary()):
            found = shingles(text.as_py())
            parts.append(np.split(found.view(np.int64), np.searchsorted(found, edges)))
            odd = np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
            sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("sid"), pa.array([list(p) for p in parts], pa.list_(pa.list_(pa.int64()))), pa.array(sketches, pa.list_(pa.int64()))], ["sid", "parts", "sketch"])


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """Written to the shared folder as a table bucketed by sid: joins on sid leave it where it is."""
    spark = df.sparkSession
    name = f"jaccard_sets_{uuid.uuid4().hex}"
    df.repartition(buckets, "sid").mapInArrow(_fragments, "sid long, parts array<array<bigint>>, sketch array<bigint>").write.bucketBy(buckets, "sid").option(
        "path", shared_dir(spark, "fragments")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _verify(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Links (a, b) among pairs (x, c, nx, nc); many x may share one c.

    The bitmaps turn pairs away first; common shingles of the rest are counted by fragment and summed by pair.
    """
    pairs = stored(pairs, "pairs")
    # written, so that both sides of a join on c are shuffled and a c with many pairs can be split
    compared = stored(pairs.select("c").distinct().join(fragments.withColumnRenamed("sid", "c"), "c").select("c", F.col("parts").alias("_c"), F.col("sketch").alias("_cs")), "compared")
    sketched = pairs.join(fragments.select(F.col("sid").alias("x"), F.col("sketch").alias("_xs")), "x").join(compared.select("c", "_cs"), "c")
    differing = sum((F.bit_count(F.get("_xs", i).bitwiseXOR(F.get("_cs", i))) for i in range(SKETCH // 64)), F.lit(0))
    # 175 * common >= 75 * (nx + nc), and 2 * common <= nx + nc - differing
    near = sketched.where(F.col("nx") + F.col("nc") >= 7 * differing).select("x", "c", "nx", "nc")
    both = near.join(fragments.select(F.col("sid").alias("x"), F.col("parts").alias("_x")), "x").join(compared.select("c", "_c"), "c")
    partial = both.select("x", "c", "nx", "nc", F.explode(F.zip_with("_x", "_c", lambda x, c: F.size(F.array_intersect(x, c)))).alias("_n"))
    total = partial.groupBy("x", "c", "nx", "nc").agg(F.sum("_n").alias("_n"))
    return total.where("100 * _n >= 75 * (nx + nc - _n)").select(F.col("x").alias("a"), F.col("c").alias("b"))


def _classes(blocks: DataFrame, fragments: DataFrame) -> DataFrame:
    """(sid, component) of the sets in blocks, by rounds over the pairs across components."""
    component = blocks.select("sid").distinct().withColumn("component", F.col("sid"))
    done, limit = 0, 1
    # members with the fewest shingles of their own come first: in a group of edited copies they are the closest to all others
    order = [F.col("lone"), F.xxhash64("sid"), F.col("sid")]
    # a pair is compared from the one that comes first; members of former rounds have met all others already
    later = F.struct(*order) > F.struct("_lone", F.xxhash64("_sid"), "_sid")
    while True:
        members = blocks.join(component, "sid")
        # a block is open while it has two components and members that have not been compared with all others
        open_blocks = members.groupBy("h").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_m")).where(
            f"_low != _high AND _m > {done + 1}").select("h", "_m")
        live = stored(members.join(open_blocks, "h"), "open-blocks")
        most, members_left, squares = live.groupBy("h").agg(F.count("*").alias("_m")).agg(F.max("_m"), F.sum("_m"), F.sum(F.col("_m") * F.col("_m"))).first()
        if most is None:
            return component
        if done and squares <= FEW * members_left:
            limit = most  # what is left takes one round
        # the first ``limit`` members of each block, ranked in parts first
        parts = Window.partitionBy("h", "_part").orderBy(*order)
        ranked = live.withColumn("_part", F.pmod(F.xxhash64("sid"), F.lit(64))).withColumn("_r", F.row_number().over(parts)).where(F.col("_r") <= limit)
        ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("h").orderBy(*order))).where(F.col("_r").between(done + 1, limit))
        chosen = ranked.select("h", F.col("sid").alias("_sid"), F.col("n").alias("_n"), F.col("rest").alias("_rest"), F.col("lone").alias("_lone"), F.col("component").alias("_c"))
        across = live.join(chosen, "h").where(f"component != _c AND 4 * least(n, _n) >= 3 * greatest(n, _n) AND {_POSSIBLE}")
        pairs = across.where(later).select(F.col("sid").alias("x"), F.col("_sid").alias("c"), F.col("n").alias("nx"), F.col("_n").alias("nc")).distinct()
        links = stored(_verify(pairs, fragments), "found-links")
        if not links.isEmpty():
            of = lambda name: component.select(F.col("sid").alias(name), F.col("component").alias(f"c{name}"))
            joined = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
            merged = connect(joined).withColumnRenamed("node", "component")
            component = stored(component.join(merged, "component", "left").select("sid", F.coalesce("label", "component").alias("component")), "components")
        if limit >= most:
            return component
        # a closed block stays closed: components only grow
        blocks = live.drop("component", "_m")
        done, limit = limit, limit * GROWTH


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, n_shingles, set id, component (of sets) and component_id per row; docs: doc_id and text."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    hashed = read.withColumn("th", F.xxhash64("text"))
    keys = stored(hashed.mapInArrow(_keys, f"doc_id {kind}, th long, n_shingles long, sid long, head array<bigint>"), "sets")
    sets = keys.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.min("th").alias("th"))
    likely = stored(_likely(keys.where("head IS NOT NULL").select("sid", "head"), sets.select("sid", "n")), "likely-sets")
    # one text of each set; equal texts are reduced before the exchange
    wanted = sets.select("sid", "th").join(likely.select("sid"), "sid")
    texts = hashed.groupBy("th").agg(F.any_value("text").alias("text")).join(wanted, "th").select("sid", "text")
    fragments = _bucketed(texts, partitions(docs))
    blocks = stored(_blocks(fragments.select("sid", F.flatten("parts").alias("head")), likely), "blocks")
    shared = blocks.groupBy("h").agg(F.count("*").alias("_m")).where("_m > 1").select("h")
    blocks = stored(blocks.join(shared, "h"), "shared-blocks")
    component = _classes(blocks, fragments)
    named = sets.join(component, "sid", "left").select("sid", "first", F.coalesce("component", "sid").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_set = named.join(least, "component").select("sid", "component", "component_id")
    return keys.join(of_set, "sid", "left").select(
        "doc_id", "th", "n_shingles", "sid", "component", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id that can be reached over links."""
    return classified(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id (a null id comes last), then the smallest text hash.

    Rows are told apart by id and text, so texts that are not linked both stay even when they carry one id.  Of rows equal in both one
    stays; documents without words are linked with nothing and all stay.
    """
    found = classified(docs).where("sid IS NOT NULL")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("_k"))
    kept = first.select(F.col("_k.doc_id").alias("_id"), F.col("_k.th").alias("_kept"))
    text = F.coalesce("text", F.lit(""))
    named = docs.withColumn("_th", F.xxhash64(text))
    chosen = named.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_kept"))).dropDuplicates(["doc_id", "_th"])
    wordless = named.where(~text.rlike("[^\\x20\\x09-\\x0D]"))
    return chosen.select(*docs.columns).unionByName(wordless.select(*docs.columns))
