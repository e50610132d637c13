"""Texts that recombine common paragraphs: not similar, yet they share all their rare shingles."""

from __future__ import annotations

import random

import numpy as np
import pytest

from marketloom.llm import ngram_join
from tests.llm.test_operators import make, plain_components, words


def recombined(seed, documents, paragraphs=12, each=4, length=30):
    r = random.Random(seed)
    common = [" ".join(words(500 + k, length)) for k in range(paragraphs)]
    texts = ["\n".join(r.sample(common, each)) for _ in range(documents)]
    # a few similar ones among them: a paragraph's end differs
    return texts + [t + f" more{k} words{k}" for k, t in enumerate(texts[:20])] + [t.rsplit(" ", 3)[0] for t in texts[20:30]]


@pytest.mark.parametrize("crowd,blocks", [(256, 512), (10, 512), (10, 16)])
def test_equals_brute_force(crowd, blocks, spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", blocks)
    texts = recombined(crowd + blocks, 150)
    out = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in ngram_join.join_components(make(spark, texts), counted=True).collect()}
    assert [out[k] for k in range(len(texts))] == plain_components(texts)


def test_rows_of_the_ask_join_are_bounded(spark, monkeypatch, capsys):
    """The rows that lists of K components would give to the join of asks, and what is left."""
    monkeypatch.setattr(ngram_join, "CROWD", 20)
    seen = []
    crowded = ngram_join._crowded
    monkeypatch.setattr(ngram_join, "_crowded", lambda steps, mixed: seen.append((mixed, crowded(steps, mixed))) or seen[-1][1])
    drop = ngram_join.Steps.drop_all
    sizes = []

    def before_drop(steps):
        for mixed, lists in seen:
            rows = lambda df: sum(r.n * r.c for r in df.groupBy("token").agg({"cid": "count", "comp": "approx_count_distinct"}).toDF("token", "n", "c").collect())
            sizes.append((rows(mixed), rows(mixed.join(lists, "token", "left_anti")), mixed.join(lists, "token", "left_anti").count()))
        seen.clear()
        drop(steps)

    monkeypatch.setattr(ngram_join.Steps, "drop_all", before_drop)
    ngram_join.join_components(make(spark, recombined(3, 300))).count()
    whole, left, sets = sizes[0]
    print("ROWS OF ASKS", whole, left, sets)
    assert whole > 100_000 and left <= 25 * max(sets, 1)


def test_spanning_links_join_what_is_similar():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 2**63, 60).astype(np.uint64))
    near = [np.sort(np.concatenate((r.choice(base, 55, replace=False), r.integers(0, 2**63, 3).astype(np.uint64)))) for _ in range(30)]
    far = [np.unique(r.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(5)]
    sets = near + far
    one = ngram_join.spanning_links(sets, None, np.arange(35), 75)
    assert len(one) <= 29 and all(100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in one)
    two = ngram_join.spanning_links(near[:15], near[15:] + far, np.arange(35), 75)
    assert two and all(a >= 15 > b for a, b in two) and ngram_join.spanning_links(near, None, np.zeros(30), 75) == []
