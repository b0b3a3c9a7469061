"""The training-data operators against plain Python on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from watchhouse.llm import curve_pack, curve_search, histogram_sort, jaccard_join, license_vote, page_difference, prefix_bpe, quality_fm, rule_cascade, suffix_dedup
from watchhouse.llm.hilbert import hilbert_keys

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, h string"
WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "x", "y", "z") for d, t in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    out = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 120)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \n\t "), (103, "Ünï 漢字 $%#* | <b>"), (104, "one line\none line\n\none line"), (105, "w1 w2 w3 w4 w5 w6 " * 4000)]
    return out + [out[3], out[3], (106, out[5][1]), (None, "no id here"), (None, None)]


def test_shards_are_equal_in_bytes_and_gapless(spark, texts):
    hot = texts + [(1000 + i, "the same text in very many rows") for i in range(400)]
    got = histogram_sort.shard_documents(frame(spark, hot), 5).collect()
    assert len(got) == len(hot) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert set(by) <= set(range(5))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    sums, largest = [sum(r.size for r in by[s]) for s in range(5)], max(len((t or "").encode()) + 8 for _, t in hot)
    assert max(sums) - min(sums) <= 2 * largest
    # without the one long text a shard is off by parts of a short row only, though most rows are one text
    short = [r for r in hot if r[0] != 105]
    even = histogram_sort.shard_documents(frame(spark, short), 5).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in even) - min(r.b for r in even) <= 2 * max(len((t or "").encode()) + 8 for _, t in short)


def test_packing_is_a_partition_of_all_ids(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = texts + [(200, "stop <|endoftext|> go")]
    got = curve_pack.pack(frame(spark, rows), path, 64, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    want = sorted((d is None, d or 0, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in rows)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id, r.sequence_id >> 40, r.start].append(r)
    for rows_ in sequences.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or at & (at - 1) == 0  # nothing is padded
    assert sum(r.length for r in got) == sum(len(w[2]) for w in want)
    single = [w for w in want if not w[0] and sum(v[1] == w[1] for v in want) == 1]
    for _, doc, ids in single:
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert tuple(i for r in mine for i in r.ids) == ids and {r.doc_tokens for r in mine} == {len(ids)}


def test_hilbert_neighbours_touch():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).astype("float32").tolist(), 1) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]  # one vector in very many rows
    bad = [(2000, None, 1), (2100, [0.0] * 8, 1), (2200, [float("nan")] * 8, 1), (2300, [1.0, None] + [0.0] * 6, 1), (2400, [float("inf")] * 8, 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    got = curve_search.nearest(df, F.col("vec_id") % 100 == 0, 10, curves=8, window=64).collect()
    vectors = np.array([r[1] for r in rows], dtype=float)
    ids, hits, total = np.array([r[0] for r in rows]), 0, 0
    for q in [i for i in ids if i % 100 == 0]:
        gap = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, gap)) if ids[i] != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [r.score for r in mine] == sorted(r.score for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & {int(ids[i]) for i in order}), total + 10
        if gap[order[9]] == 0:  # ties go to the smallest ids
            assert [r.vec_id for r in mine] == [int(ids[i]) for i in order]
    assert hits / total >= 0.9 and {r.query_id for r in got} == {int(i) for i in ids if i % 100 == 0}
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, score int")
    assert len(curve_search.nearest(few, F.col("vec_id") == 0, 10).collect()) == 2


def _recall(spark, vectors, **how):
    """Share of the ten nearest distances of every hundredth row that the operator reaches."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in curve_search.nearest(df, F.col("vec_id") % 100 == 0, 10, **how).collect():
        found[r.query_id].append(r.score)
    hits = 0
    for q in range(0, len(vectors), 100):
        tenth = np.sort(np.delete(np.sqrt(((vectors - vectors[q]) ** 2).sum(1)), q))[9]
        hits += sum(score <= tenth * (1 + 1e-12) for score in found[q])
    return hits / (10 * len(range(0, len(vectors), 100)))


def test_window_grows_with_the_rows(spark):
    vectors = np.random.default_rng(5).standard_normal((4000, 64))
    assert _recall(spark, vectors / np.linalg.norm(vectors, axis=1, keepdims=True), window=8) >= 0.9


def test_vectors_of_unequal_length(spark):
    rng = np.random.default_rng(6)
    for vectors in (rng.permutation(3000)[:, None] * rng.standard_normal(8) + 1e-9, rng.standard_normal((3000, 1))):
        assert _recall(spark, vectors, curves=4, window=16) >= 0.95


def test_licenses(spark, texts):
    phrases = ["MIT License", "Apache,  license!", "the general public License", "mit licenses", "general license public", "Redistribution and use in source and binary forms, with or "
               "without modification, are permitted", "mit mit license license", "Mozilla Public License"]
    rows = texts + [(300 + i, f"w1 {p} w2 é{p}") for i, p in enumerate(phrases)]
    got = license_vote.vote(frame(spark, rows)).collect()
    want = []
    for d, t in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        words, places, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), [], set()
        for phrase, label in license_vote.BASE:
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((d, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1)
    assert {r.labels for r in got if r.doc_id == 305} == {"bsd"} and {r.labels for r in got if r.doc_id == 307} == {"mpl"}


def _span_labels(words):
    """Labels and score of the method's own templates by the definition: different pairs on MAX_DRIFT + 1 neighbouring diagonals."""
    labels, score = set(), 0.0
    for phrase, label in license_vote.TEMPLATES:
        pairs = list(zip(phrase.split(), phrase.split()[1:]))
        hits = [(at - t, t) for at, pair in enumerate(zip(words, words[1:])) for t, p in enumerate(pairs) if p == pair]
        best = max((len({t for e, t in hits if d <= e <= d + license_vote.MAX_DRIFT}) for d, _ in hits), default=0)
        score = max(score, best / len(pairs))
        labels |= {label} if best >= max(1, math.ceil(len(pairs) * license_vote.MIN_COVER)) else set()
    return labels, score


def test_license_spans_are_verified(spark):
    """Repeated pairs do not add up; words put in or left out do no harm; labels and score as by definition."""
    rnd = random.Random(6)
    templates = [p.split() for p, _ in license_vote.TEMPLATES]
    texts = ["public license public license", "public license " * 50, "source public license form public license"]
    for n in range(120):
        words = list(rnd.choice(templates)) + [rnd.choice(["x", "public", "license", "software"]) for _ in range(rnd.randrange(8))]
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(words))
            words[at:at + rnd.randrange(2)] = rnd.choice([[], ["y"], [words[at]], ["public", "license"]])
        texts.append(" ".join(words))
    got = {r.doc_id: r for r in license_vote.vote(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        labels, score = _span_labels(t.split())
        based = set(got[i].base_labels.split(",")) - {""}
        assert got[i].labels == ",".join(sorted(labels | based)), t
        assert got[i].score == (1 if got[i].n_base else round(score, 6)), t
    assert got[0].labels == "" and got[1].labels == "" and got[0].score == 0.5


def test_page_text(spark):
    page = ("<html><head><title>T</title><script>if (a < b) {'<p>'}</script></head><body><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies</div>"
            "<article><h1>Head &amp; more</h1><p>One<br>two\n  three<p>Four <b>five</b></p><form>Mail</form><div class=\"comments\"><p>Nice!</p></div></article>"
            "<aside>Side</aside><footer>&copy; us</footer></body></html>")
    site = lambda body: f"<body><div>Site name</div><div>{body}</div><div>All rights</div></body>"
    rows = [(1, "http://a/x", page), (2, None, None), (3, "http://b/p/1", site("Alpha text")), (4, "http://b/p/2?q=1", site("Beta text")), (5, "http://c/", ""),
            (6, "http://d/1", "<p>same</p>"), (7, "http://d/2", "<p>same</p>"), (8, "http://e", "plain <!-- no --> text")]
    got = {r.page_id: r for r in page_difference.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & more\nOne two three\nFour five" and got[2].text == "" and got[5].text == ""
    assert got[3].text == "Alpha text" and got[4].text == "Beta text" and got[6].text == got[7].text == "same" and got[8].text == "plain text"
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[2].url is None and len(got) == 8


def test_page_partners_do_not_depend_on_partitions(spark):
    """Pages alone in their partitions, copies beside each other, and copies over whole partitions."""
    site = lambda body: f"<body><div>Site name</div><div>{body}</div><div>All rights</div></body>"
    rows = [(i, f"http://a/{i:03}", site(f"Text {i}")) for i in range(30)] + [(100 + i, f"http://b/{i:03}", site("Copied")) for i in range(20)]
    rows += [(200, "http://b/999", site("Other")), (300, "http://c/1", site("Alone")), (301, "http://b/005", ""), (302, None, site("No address"))]
    want = {**{i: f"Text {i}" for i in range(30)}, **{100 + i: "Copied" for i in range(20)}, 200: "Other", 301: "",
            300: "Site name\nAlone\nAll rights", 302: "Site name\nNo address\nAll rights"}
    df, before = spark.createDataFrame(rows, "page_id long, url string, html string"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = page_difference.extract(df).collect()
            assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_longest_common_subsequence():
    rnd = random.Random(3)
    for _ in range(500):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, other = page_difference.shared_lines(a, b), iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in other for i in sorted(found))


def test_bpe_equals_the_library(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rnd = random.Random(1)
    rows = texts + [(400, "ΣΑΣ İstanbul don't we'll 'sun"), (401, "x<|endoftext|>Y <|startoftext|>"), (402, "\x1c\x1d a\x85b​c　d ﬁ ǅ K Å"), (403, "a" * 3000)]
    rows += [(500 + i, "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(32, 0x500), rnd.randrange(0x20, 0xD7FF)])) for _ in range(80))) for i in range(60)]
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows_of(prefix_bpe.encode_documents(frame(spark, rows), path)) == sorted(want, key=str)


def _classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def test_jaccard_classes(spark, texts):
    rnd, rows = random.Random(2), list(texts)
    hot = " ".join(rnd.choice(WORDS) for _ in range(30))
    for g in range(16):
        base = [rnd.choice(WORDS) for _ in range(rnd.choice([3, 12, 40, 90, 400]))]
        for _ in range(70 if g == 5 else rnd.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(int(len(copy) * rnd.choice([0, 0.01, 0.03, 0.05]))):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            rows.append((2000 - len(rows), " ".join(copy) + (" " + hot if rnd.random() < 0.3 else "")))
    assert rows_of(jaccard_join.components(frame(spark, rows))) == _classes(rows)
    kept = [r.doc_id for r in jaccard_join.keep_one(frame(spark, rows)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({c for _, _, c in _classes(rows) if c is not None}) and kept.count(None) == 2


def test_one_of_each_class_by_id_and_text(spark):
    """Different texts of one id both stay; rows without an id are represented, or give way to one with an id."""
    words = lambda a: " ".join(f"w{a}x{i}" for i in range(40))
    rows = [(1, words("a")), (1, words("b")), (1, words("b")), (2, words("a") + " more"), (None, words("a")), (None, words("c")), (None, words("c")), (None, words("c") + " end"),
            (3, ""), (3, ""), (None, None), (None, " "), (4, words("d")), (None, words("d"))]
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(frame(spark, rows)).collect()), key=str)
    of_c = {t for d, t in got if d is None and t and t.startswith("wc")}
    assert len(of_c) == 1 and of_c <= {words("c"), words("c") + " end"}
    rest = [x for x in got if x[1] not in of_c]
    assert rest == sorted([(1, words("a")), (1, words("b")), (3, ""), (3, ""), (None, None), (None, " "), (4, words("d"))], key=str)


def test_rule_measures(spark, texts):
    rows = texts + [(600, "a b c d e x a b c d e y a b c d e"), (601, "ALL LOUD!! " * 20)]
    got = {r.doc_id: r for r in rule_cascade.judge(frame(spark, rows)).collect()}
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 2000 else set(range(len(words)))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        r = got[d] if d is not None else None
        if r:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
                len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed), d
            assert not (failed and r.kept)
    order = rule_cascade.plan_cascade(frame(spark, rows))
    assert sorted(order) == sorted([*rule_cascade.BASE_RULES, *rule_cascade.METHOD_RULES])
    assert sorted(r.doc_id for r in rule_cascade.keep_good(frame(spark, rows), order).where("doc_id IS NOT NULL").collect()) == sorted(
        r.doc_id for r in rule_cascade.judge(frame(spark, rows), order[::-1]).where("kept AND doc_id IS NOT NULL").collect())


def test_quality_learns_and_interactions_are_exact(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_fm.train(docs, labels)
    scored = quality_fm.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where(quality_fm.is_held_out(F.col("doc_id"))).collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.93 * len(scored)
    starts, index, value = model.rows(quality_fm.features(["some words and some more", ""], [3, None]))
    raw, _ = model.raw(starts, index, value)
    for row in range(2):
        at, x = index[starts[row]:starts[row + 1]], value[starts[row]:starts[row + 1]]
        slow = model.bias + model.weight[at] @ x + sum(
            model.factor[at[i]] @ model.factor[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert math.isclose(raw[row], slow, abs_tol=1e-9)


def test_quality_of_odd_rows(spark, texts):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_fm.score(frame(spark, texts), quality_fm.train(frame(spark, texts), labels)).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got) and got[0].shard == "y"


def _brute_repeats(rows, width=200):
    place, covered = defaultdict(list), defaultdict(set)
    for i, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            place[b[s:s + width]].append((i, s))
    for found in place.values():
        if len(found) > 1:
            for i, s in found:
                covered[i].update(range(s, s + width))
    out = []
    for i, (d, t) in enumerate(rows):
        b, c = (t or "").encode(), covered[i]
        out.append((d, len(b), len(c), sum(x - 1 not in c for x in c), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in c)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 5])
def test_repeated_strings(spark, group):
    rnd = random.Random(5)
    passages = ["".join(rnd.choice("abcdefghij ") for _ in range(n)) for n in (230, 200, 199, 450, 800)]
    rows = []
    for i in range(80):
        t = "".join(rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice("abcdeféß ") for _ in range(rnd.randrange(300))) for _ in range(rnd.randrange(1, 6)))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "xy" * 400), (103, "a" * 900), (104, "short"), (None, passages[3]), (7, "q" * 10 + passages[0]), (7, "q" * 10 + passages[0])]
    assert rows_of(suffix_dedup.remove_repeats(frame(spark, rows), group).drop("kept")) == _brute_repeats(rows)
    whole = suffix_dedup.dedup_documents(frame(spark, rows), group).collect()
    assert len(whole) == len(rows) and all(r.n_chars == len(r.text) and r.shard == "y" for r in whole)


def test_many_equal_rows(spark):
    """2 000 equal rows with an id, 500 without, and one text that shares a passage with them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    text, other, own = (" ".join(word() for _ in range(500)) for _ in range(3))
    rows = [(1, text, "a")] * 2000 + [(None, other, "b")] * 250 + [(None, other, "c")] * 250 + [(2, own + text[100:400], "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = suffix_dedup.remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    assert {(r[0], r[1], r[2]): r[3] for r in got} == {(1, len(text), len(text)): 2000, (None, len(other), len(other)): 500, (2, len(own) + 300, 300): 1}
    kept = suffix_dedup.dedup_documents(docs.withColumn("n_chars", F.length("text"))).groupBy("source", "n_chars").count().collect()
    assert {r[0]: (r[1], r[2]) for r in kept} == {"a": (0, 2000), "b": (0, 250), "c": (0, 250), "d": (len(own), 1)}


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for got in (
        histogram_sort.shard_documents(none, 24), curve_pack.pack(none, public_tokenizers.path("byte_bpe_50k.json")), license_vote.vote(none),
        page_difference.extract(pages), prefix_bpe.encode_documents(none, public_tokenizers.path("word_bpe_49k.json")), jaccard_join.components(none),
        rule_cascade.judge(none), suffix_dedup.remove_repeats(none), curve_search.nearest(vectors, F.col("vec_id") >= 0, 10),
        quality_fm.score(none, quality_fm.train(none, labels)),
    ):
        assert got.collect() == []


def test_jaccard_edited_copies_do_not_meet_in_pairs(spark, monkeypatch):
    """Copies of one text, each with 17 words of its own (a fifth of the shingles): none links with another, and few are compared."""
    rnd = random.Random(11)
    base = [f"b{rnd.randrange(10 ** 9)}" for _ in range(400)]

    def edited(i):
        words = list(base)
        for at in rnd.sample(range(400), 17):
            words[at] = f"e{i}x{at}"
        return " ".join(words)

    pairs = []
    store = jaccard_join.stored

    def counting(df, purpose):
        out = store(df, purpose)
        if purpose == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counting)
    rows = [(i, edited(i)) for i in range(80)]
    found = rows_of(jaccard_join.components(frame(spark, rows)))
    assert found == _classes(rows)
    assert sum(pairs) <= 4 * len(rows)


def test_lines_of_pages_are_moved_compressed(spark, monkeypatch):
    """The lines of a page are stored and exchanged in less than half of their bytes; the text is whole."""
    body = ["".join(f"<p>paragraph {p} of page {i} with some usual words in it</p>" for p in range(60)) for i in range(6)]
    sizes, store = [], page_difference.stored

    def measuring(df, purpose):
        out = store(df, purpose)
        if purpose == "page-lines":
            sizes.append(out.select(F.sum(F.octet_length("lines"))).first()[0])
        return out

    monkeypatch.setattr(page_difference, "stored", measuring)
    rows = [(i, f"http://h{i}.example/a", f"<html><body><article>{b}</article></body></html>") for i, b in enumerate(body)] + [(9, "http://h9.example/a", None)]
    got = page_difference.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {i: "\n".join(f"paragraph {p} of page {i} with some usual words in it" for p in range(60)) for i in range(6)} | {9: ""}
    assert {r.page_id: r.text for r in got} == want
    assert 0 < sizes[0] < sum(map(len, want.values())) / 2
