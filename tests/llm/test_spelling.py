"""Spelling variants against comparing all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketloom.llm import spelling

DOCS = "doc_id long, text string, word string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """One inserted, deleted or replaced code point, by trying."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, least=7):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    out = {}
    for w, k in n.items():
        around = sorted((-n[x], x) for x in n if near(w, x))
        form = around[0][1] if around and -around[0][0] >= 10 * k else None
        out[w] = (form, k, len(around), n[form] if form else None)
    roots = {}
    for w in out:
        x = w
        while out[x][0]:
            x = out[x][0]
        roots[w] = x
    return {w: (f, roots[w], k, m, fn) for w, (f, k, m, fn) in out.items()}


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def corpus(seed):
    """Words with chains of variants of falling frequency, long words, letters beyond ASCII."""
    r = random.Random(seed)
    letters = "abcéüß"
    words = []
    for _ in range(25):
        base = "".join(r.choice(letters) for _ in range(r.randrange(7, 13)))
        count = r.choice([3, 40, 900])
        words += [base] * count
        w = base
        for step in range(3):
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]])
            words += [w] * max(2, count // 15 ** (step + 1))
    words += ["A" * 40] * 3 + ["a" * 39 + "é"] * 2 + ["aaaaaaa", "AAAAAAA", "aaaaaaaa", "AAAAAAaa"]
    r.shuffle(words)
    sep = [" ", "1", "-", "\n", "×", ". "]  # the multiplication sign lies within À-ÿ
    texts = []
    while words:
        k = r.randrange(1, 60)
        texts.append("".join(w + r.choice(sep) for w in words[:k]))
        words = words[k:]
    return [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(1, None), (2, ""), (3, "12 -- 34"), (4, "x" * 200_000)]


@pytest.mark.parametrize("seed,group,cells", [(1, 1024, 1 << 22), (2, 3, 200), (3, 1, 50)])
def test_equals_all_pairs(seed, group, cells, spark, monkeypatch):
    """With groups as they are, with groups dealt by position, and with tiny matrices."""
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "CELLS", cells)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS).repartition(4)
    want = plain(rows)
    assert got(spelling.spelling_variants(df)) == want
    assert any(v[0] and v[1] != v[0] for v in want.values())  # chains are in it


def test_matrices_of_one_task_equal_all_pairs():
    import pyarrow as pa

    r = random.Random(4)
    words = sorted({"".join(r.choice("ab") for _ in range(r.choice([7, 8]))) for _ in range(150)})
    rows = pa.table({"key": pa.array([0] * len(words), pa.int64()), "lo": pa.array([0] * len(words), pa.int32()), "hi": pa.array([8] * len(words), pa.int32()), "word": words})
    a, b = spelling.near_in_groups(rows, 8)
    assert {frozenset((words[i], words[j])) for i, j in zip(a, b, strict=True)} == {frozenset((x, y)) for x in words for y in words if near(x, y) and max(len(x), len(y)) == 8}
    assert len(a) == len({frozenset(p) for p in zip(a, b, strict=True)})


def test_ties_go_to_the_smallest_word(spark):
    rows = [(k, "abcdefgh " * 2) for k in range(1)] + [(100 + k, "abcdefgx abcdefga ") for k in range(30)]
    out = got(spelling.spelling_variants(spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS), noise=10**9))
    assert out["abcdefgh"][0] == "abcdefga" and out["abcdefgh"][3] == 2 and out["abcdefgx"][3] == 2


def test_empty_tables_and_no_words(spark):
    df = spark.createDataFrame([(1, None, "", 0), (2, "short words 1 2", "", 0)], DOCS)
    assert spelling.spelling_variants(df).count() == 0 and spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more frequent"):
        spelling.spelling_variants(df, ratio=1)


def test_large_groups_are_dealt_by_position(spark, monkeypatch):
    """A third of all words share all but a few letters: no group stays over the bound of the alphabet."""
    monkeypatch.setattr(spelling, "GROUP", 40)
    words = [f"{a}{b}{c}commonending" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    dealt = spelling._dealt(df)
    large = dealt.groupBy("key").count().where(F.col("count") > 40).select("key")
    spread = spelling._spread(dealt.join(large, "key", "left_semi"))
    assert dealt.groupBy("key").count().agg(F.max("count")).first()[0] > 40 >= spread.groupBy("key").count().agg(F.max("count")).first()[0]
    assert spelling.near_words(df).count() == sum(near(a, b) for a in words for b in words)
