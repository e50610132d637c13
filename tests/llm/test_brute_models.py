"""The learned models against plain loops: Kneser and Ney's formula, the convolution, long texts."""

from __future__ import annotations

import math
import random
import resource
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import language_id, quality_cnn

TEXTS = {
    "en": ["the cat sat on the mat", "a dog and the cat", "The end of the story?"],
    "de": ["die katze saß auf der matte", "der hund und die katze", "das ende"],
    "x": ["ab", "Ba ab"],
}


def symbols(text):
    """Lower-case letters, runs of all else one space, spaces around."""
    out = [" "]
    for ch in text.lower():
        ch = ch if ch.isalpha() else " "
        if ch != " " or out[-1] != " ":
            out.append(ch)
    return [" ", *out, *([" "] if out[-1] != " " else [])]


def plain_bits(training, text):
    """Interpolated Kneser and Ney by dictionaries, one probability after another."""
    out = {}
    most = 0
    models = {}
    for lang, texts in training.items():
        tri = Counter()
        for t in texts:
            s = symbols(t)
            tri.update(zip(s, s[1:], s[2:], strict=False))
        bi, uni = Counter(g[1:] for g in tri), Counter()
        for g in bi:
            uni[g[1]] += 1
        models[lang] = tri, bi, uni
        most = max(most, len(uni))

    def discount(c):
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return one / (one + 2 * two) if one and two else 0.5

    for lang, (tri, bi, uni) in models.items():
        contexts = defaultdict(lambda: [0, 0])
        for table in (tri, bi):
            for g, n in table.items():
                contexts[g[:-1]][0] += n
                contexts[g[:-1]][1] += 1
        s, total = symbols(text), 0.0
        for g in zip(s, s[1:], s[2:], strict=False):
            d, n = discount(uni), sum(uni.values())
            p = max(uni[g[2]] - d, 0) / n + d * len(uni) / n / (most + 1)
            for table, gram in ((bi, g[1:]), (tri, g)):
                if gram[:-1] in contexts:
                    whole, kinds = contexts[gram[:-1]]
                    d = discount(table)
                    p = max(table[gram] - d, 0) / whole + d * kinds / whole * p
            total -= math.log2(p)
        out[lang] = total / (len(s) - 2)
    return out


@pytest.mark.parametrize("rows", [10**9, 0])
def test_kneser_ney_equals_plain_loops(rows, spark):
    df = spark.createDataFrame([(t, lang) for lang, ts in TEXTS.items() for t in ts], "text string, lang string")
    model = language_id.train(df, model_rows=rows)
    assert isinstance(model, language_id.Stored) == (rows == 0)
    asked = ["the hat", "DIE hütte!", "zzz 77", "ab", "cat, katze"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(asked)], "doc_id long, text string, bits string")
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for k, t in enumerate(asked):
        want = plain_bits(TEXTS, t)
        assert out[k].bits == pytest.approx(min(want.values()), rel=1e-9) and out[k].lang_pred == min(want, key=lambda x: (want[x], x))


@pytest.mark.parametrize("rows", [10**9, 0])
@pytest.mark.parametrize("limit", [1, 1 << 19])
def test_calibration_on_all_rows_equals_plain_loops(rows, limit, spark, monkeypatch):
    """Every row is counted, and every text calibrates once, against the others of its language: its
    copies don't count for it. A text that is alone in its language says nothing."""
    monkeypatch.setattr(language_id, "MEASURED_BYTES", limit)  # one text after another, or all at once
    letters = "abcdefghijklmnopqrstuvwxyz"
    training = {**TEXTS, "z": [letters, letters[::-1], letters[::2] + letters[1::2]], "one": ["solo", "solo"]}
    training["en"] = training["en"] + training["en"][:1] * 2
    made = [(t, lang) for lang, ts in training.items() for t in ts] + [("12 !", "en"), ("", "de"), (None, "de"), ("no one's", None)]
    model = language_id.train(spark.createDataFrame(made, "text string, lang string").repartition(3), model_rows=rows, every=True)
    assert isinstance(model, language_id.Stored) == (rows == 0)
    names, whole = sorted(training), {t: plain_bits(training, t) for ts in training.values() for t in ts}
    bits, truth = [], []
    for lang in set(names) - {"one"}:
        for t in sorted(set(training[lang])):
            without = plain_bits({**training, lang: [x for x in training[lang] if x != t]}, t)[lang]
            bits.append([without if x == lang else whole[t][x] for x in names])
            truth.append(names.index(lang))
    bits, truth = np.array(bits), np.array(truth)
    for k, lang in enumerate(names):
        own = bits[truth == k, k]
        want = own.mean() + language_id.REJECT_SD * own.std() if len(own) else np.inf
        assert model.limits[k] == pytest.approx(want, rel=1e-6), lang

    def fit(t):
        e = np.exp(-(bits - bits.min(axis=1, keepdims=True)) * t)
        return np.log(np.maximum((e / e.sum(axis=1, keepdims=True))[np.arange(len(truth)), truth], 1e-12)).sum()

    assert model.temperature == max(language_id.GRID, key=fit)


def test_a_model_in_the_shared_folder_gives_the_same(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + k, t, None, None, None) for k, t in enumerate([None, "", "12 !", "é", "x" * 100_000])], docs.schema)
    every = docs.unionByName(odd).unionByName(odd)
    small, large = (language_id.train(docs, model_rows=n) for n in (10**9, 0))
    assert (small.temperature, small.languages) == (large.temperature, large.languages) and np.allclose(small.limits, large.limits)
    a, b = (sorted((r.doc_id, r.lang_pred, round(r.score, 9), r.rejected) for r in language_id.identify(every, m, carry=["doc_id"]).collect()) for m in (small, large))
    assert a == b and len(a) == docs.count() + 10
    assert language_id.identify(every.limit(0), large).count() == 0


def test_convolution_equals_plain_loops():
    r = random.Random(1)
    net = quality_cnn.Network()
    net.v = np.random.default_rng(2).normal(0, 1, net.v.shape).astype(np.float32)
    net.b = np.random.default_rng(3).normal(0, 0.1, net.b.shape).astype(np.float32)
    texts = [b"", b"a", bytes(r.randrange(256) for _ in range(700)), b"word " * 300]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    got = net.scores(data, offs)
    for text, score in zip(texts, got, strict=True):
        step, starts = quality_cnn.CHUNK - quality_cnn.OVERLAP, [0]
        while starts[-1] + quality_cnn.CHUNK < len(text):
            starts.append(starts[-1] + step)
        pooled = []
        for at in starts:
            chunk = text[at : at + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
            best = np.full(quality_cnn.FILTERS, -np.inf)
            for k in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
                window = np.concatenate([net.e[b] for b in chunk[k : k + quality_cnn.WIDTH]])
                best = np.maximum(best, window @ net.w)
            pooled.append(np.maximum(best + net.b, 0))
        z = np.concatenate((np.mean(pooled, axis=0), np.max(pooled, axis=0))) @ net.v + net.c[0]
        assert score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_a_text_of_many_megabytes_takes_little_memory():
    net = quality_cnn.Network()
    text = np.frombuffer(b"some words and more " * 1_000_000, np.uint8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    one = net.scores(text, np.array([0, len(text)]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB, for 20 MB of text
    assert one == pytest.approx(net.scores(text[:2_000_000], np.array([0, 2_000_000])), abs=1e-3)


def test_ids_labelled_both_ways_are_not_learned_from(spark):
    docs = spark.createDataFrame([(k, "good words here " * 9 if k % 2 else "%%% $$$ " * 20) for k in range(40)] + [(99, "good words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(99, 0), (99, 1), (3, 1), (None, 1), (5, 7)], "doc_id long, quality int")
    plain = quality_cnn.train(docs, labels.where("doc_id < 40 and quality < 2"))
    assert (quality_cnn.train(docs, labels).v == plain.v).all()
    assert {r.predicted for r in quality_cnn.classify(docs, plain).where(F.col("doc_id") == 1).collect()} <= {0, 1}
