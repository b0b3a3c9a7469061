"""The corpus pipeline stage by stage against plain Python, each stage on what the one before it kept."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import _brute_repeats, _classes
from watchhouse.llm import quality_fm, rule_cascade
from watchhouse.llm.common import DOCUMENT_COLUMNS, stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def _odd_rows(docs):
    """The given documents with nulls, empty and repeated rows, one id with two texts, and columns of clashing names."""
    rows = [tuple(r) for r in docs.select(*DOCUMENT_COLUMNS).collect()]
    text = next(r[1] for r in rows if r[1] and len(r[1]) > 600)
    rows += [(9001, None, None, None, None), (9002, "", None, "s", 0), (None, None, None, None, None), (None, text, "en", "s", len(text)), (None, text, "en", "s", None),
             rows[5], rows[5], (rows[5][0], rows[6][1], "en", "other", 1), (9003, " ".join(["word"] * 30_000), "en", "s", None)]
    kept = docs.sparkSession.createDataFrame(rows, docs.select(*DOCUMENT_COLUMNS).schema)
    return kept.withColumns({"h": F.lit("clash"), "score": F.lit("clash"), "_th": F.lit("clash")})


def _pairs(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_against_plain_python(spark):
    docs = _odd_rows(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after[name] = docs.collect(), (docs := stored(stage(spark, docs, FOLDER), "stage")).collect()
        assert docs.columns == DOCUMENT_COLUMNS, name

    before, kept = after["quality classifier"]
    whole = spark.createDataFrame([(r.doc_id, r.text, r.n_chars) for r in before], "doc_id long, text string, n_chars long")
    model = quality_fm.train(whole, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = [(r, model.score(quality_fm.features([r.text or ""], [r.n_chars]))[0]) for r in before]
    assert _pairs(kept) == _pairs(r for r, score in scored if score >= quality_fm.THRESHOLD)

    before, kept = after["quality rules"]
    verdicts = rule_cascade.judge(spark.createDataFrame([(n, r.text) for n, r in enumerate(before)], "doc_id long, text string")).collect()
    assert _pairs(kept) == _pairs(before[v.doc_id] for v in verdicts if v.kept)

    before, kept = after["n-gram Jaccard join"]
    named = [(n, r.text) for n, r in enumerate(before)]  # classes of rows, whatever their ids
    component = {n: c for n, _, c in _classes(named)}
    members = {}
    for n, c in component.items():
        members.setdefault(c, []).append(before[n])
    assert len(kept) == len(members)
    for some in members.values():  # the smallest id of each class stays
        ids = [r.doc_id for r in some if r.doc_id is not None]
        assert any(r.doc_id == min(ids, default=None) and r.text in {x.text for x in some} for r in kept)

    before, kept = after["suffix-array dedup"]
    brute = _brute_repeats([(r.doc_id, r.text) for r in before])
    assert len(kept) == len(before) and Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in before)
    clean = Counter((d, n) for d, n, removed, *_ in brute if removed == 0)
    assert not clean - Counter((r.doc_id, len(r.text.encode())) for r in kept)
    assert sum(len(r.text.encode()) for r in kept) <= sum(n - removed for _, n, removed, *_ in brute)
    assert all(r.n_chars == len(r.text) for r in kept)

    pieces = stages["packing"](spark, docs, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in kept)
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == tokens
    assert sum(p.length for p in pieces) == sum(n * times for (_, n), times in tokens.items())
    filled = Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 1024


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == DOCUMENT_COLUMNS and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 0 and "sequence_id" in got.columns
