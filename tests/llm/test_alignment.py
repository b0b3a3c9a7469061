"""Tokens of two tokenizers aligned, against interval arithmetic in plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from watchhouse.llm import token_align
from watchhouse.llm.token_align import Csr, Tokenizers, align_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _spans(ids, table):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(table[i])))
        at += len(table[i])
    return out


def _expected(texts):
    coders = Tokenizers(A, B)
    per, documents = [], Counter()
    for text in texts:
        a, b = coders.encode([text or ""])[0]
        a, b = _spans(a, coders.a_bytes), _spans(b, coders.b_bytes)
        links = Counter((i, j) for i, x, y in a for j, z, w in b if x < w and z < y)
        documents.update(links.keys())
        cuts = sorted({y for _, _, y in a} & {y for _, _, y in b})
        groups, low = [], 0
        for high in cuts:
            groups.append([[str(i) for i, x, _ in side if low <= x < high] for side in (a, b)])
            low = high
        written = ";".join("|".join(",".join(side) for side in group) for group in groups)
        per.append((len(a), len(b), len(groups), links, sum(len(x) * len(y) for x, y in groups), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    highest = defaultdict(int)
    for (i, _), n in documents.items():
        highest[i] = max(highest[i], n)
    return [(n_a, n_b, n_g, sum(links.values()), sum(m for p, m in links.items() if documents[p] == highest[p[0]]),
             sum(m * documents[p] for p, m in links.items()), digest, shared) for n_a, n_b, n_g, links, shared, digest in per]


def _run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, chunk string").repartition(3)
    return sorted(tuple(r) for r in align_documents(docs, A, B).select(
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared").collect())


def test_equals_intervals(spark, monkeypatch):
    monkeypatch.setattr(token_align, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(token_align, "SLICE_BYTES", 500)
    words = "the quick données straße 東京 привет multi-token 12345 <s> <|endoftext|> é́ \x00 \t\n".split(" ")
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(60)] + [None, "", " ", "a▁b", "same", "same", "x" * 5000, "日本語" * 400]
    rows = [(n if n % 7 else None, t, "clash", "clash") for n, t in enumerate(texts)]
    assert _run(spark, rows) == sorted(_expected(texts))


@pytest.mark.parametrize("texts", [[], [None, None], [""]])
def test_nothing_to_align(spark, texts):
    got = _run(spark, [(n, t, None, None) for n, t in enumerate(texts)])
    assert got == [(0, 0, 0, 0, 0, 0, "", 0)] * len(texts)


def test_products():
    rng = np.random.default_rng(1)
    for shape in ((0, 3, 2), (5, 7, 4), (9, 1, 6)):
        x, y = (rng.integers(0, 3, (shape[i], shape[i + 1])) * (rng.random((shape[i], shape[i + 1])) < 0.5) for i in (0, 1))
        sparse = lambda m: Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0], m.shape[1])
        found = sparse(x).product(sparse(y))
        dense = np.zeros((shape[0], shape[2]), int)
        dense[found.row, found.column] = found.value
        assert (dense == x @ y).all()
        assert (sparse(x).product_sizes(sparse(y)) == (x != 0) @ (y != 0).sum(1)).all()
        back = sparse(x).transposed()
        again = np.zeros((shape[1], shape[0]), int)
        again[back.row, back.column] = back.value
        assert (again == x.T).all()


def test_common_letters_are_encoded_by_the_second_library():
    """The same ids as by tokenizers, which is asked only for long texts and rare letters."""
    coders = Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    usual = ["It's plain text, isn't it?  12 345", "Été à l'œuvre, größer; Привет", "a <|endoftext|> b", " \t\n\r\n  x  \x85 y\x1c\x00z ", "", "x" * 3000, " " * 120_000 + "y"]
    rare = ["漢字 と かな", "emoji 🙂 — dash", "w " * 70_000]
    asked = []

    class Watched:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return own.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    own, coders.a = coders.a, Watched()
    whole = [e.ids for e in own.encode_batch_fast([" " + t for t in usual + rare], add_special_tokens=False)]
    for text, ids, (a, _) in zip(usual + rare, whole, coders.encode(usual + rare)):
        assert a in (ids, [])
    for text, ids in zip(usual, whole):
        assert coders.fast_a.encode_ordinary(" " + text) == ids
    assert asked == [" " + t for t in rare]
