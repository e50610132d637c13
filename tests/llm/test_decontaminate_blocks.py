"""Benchmarks of many blocks and passes: one index a shard, the same result as a plain search."""

from __future__ import annotations

import random

import pyarrow as pa

from marketloom.llm import decontaminate as dc

DOCS = "doc_id long, text string, lang string"


def case(seed=4, items=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bench = [(k, some(r.choice([3, 12, 30]))) for k in range(items)] + [(99, "shared shared"), (100, "shared shared"), (99, "shared shared"), (101, None), (102, "!!")]
    texts = []
    for k in range(80):
        parts = [some(20)]
        for _ in range(k % 3):
            t = r.choice(bench[:items])[1].split()
            at = r.randrange(max(1, len(t) - 11))
            parts += [" ".join(t[at : at + r.choice([5, 10, 14])]), some(5)]
        texts.append(" ".join(parts) + (" Shared, SHARED" if k % 7 == 0 else ""))
    return bench, [*texts, None, "", "?!"]


def plain(bench, text):
    """Items and hit words by looking at every window."""
    w = (text or "").lower().replace(",", "").split() if text != "?!" else []
    hit, items = set(), set()
    for item, t in bench:
        v = (t or "").split() if t != "!!" else []
        for at in range(max(len(v) - 9, 1) if v else 0):
            phrase = v[at : at + 10]
            for k in range(len(w) - len(phrase) + 1):
                if w[k : k + len(phrase)] == phrase:
                    items.add(str(item))
                    hit.update(range(k, k + len(phrase)))
    return len(hit), sorted(items)


def test_blocks_and_passes_equal_a_plain_search(spark):
    bench, texts = case()
    want = {k: plain(bench, t) for k, t in enumerate(texts)}
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], DOCS).repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    for block, most in ((1 << 20, 1 << 25), (300, 1 << 25), (300, 1500)):
        out = dc.decontaminate(docs, items, carry=["doc_id"], block_bytes=block, pass_bytes=most).collect()
        assert {r.doc_id: (r.n_hit, r.item_ids) for r in out} == want


def test_ten_blocks_share_one_index(monkeypatch):
    bench, texts = case()
    built = []
    index = dc.FMIndex
    monkeypatch.setattr(dc, "FMIndex", lambda seq: built.append(len(seq)) or index(seq))
    phrases = dc.Phrases([i for i, _ in bench], [t or "" for _, t in bench], 10, 200)
    assert len(phrases.blocks) >= 10
    dc.search_shard(pa.array(texts), phrases)
    assert len(built) == 1
