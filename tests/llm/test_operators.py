"""Small cases of the ten operators: nulls, empty and long texts, ties, repeated rows, empty
tables, clashing columns; brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import (
    chat_format,
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    quality_cnn,
    quality_rules,
    queries,
    token_counts,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, vocabulary: int = 5000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def make(spark, texts, **more):
    rows = [(k, t, "en", "s", len(t) if t else 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, data, same):
    same(queries.QUERIES[name](spark, data), queries.SQL[name])


ODD = [None, "", " \n\t\n", "one", "a b c d", "é ü ñ", "x" * 50_000, "word " * 20_000, "A\nB\nA\n\n", "\x00    "]


def odd_docs(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[3], (None, None, None, None, None)], DOCS)


OPERATORS = {
    "token_counts": lambda d: token_counts.token_counts(d),
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "quality_rules": lambda d: quality_rules.quality_rules(d),
    "mixing": lambda d: mixing.mix_sources(d),
    "ngram_join": lambda d: ngram_join.join_components(d, counted=True),
    "classify": lambda d: quality_cnn.classify(d, quality_cnn.Network()),
    "identify": lambda d: language_id.identify(d, language_id.train(d)),
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_give_a_row_each(name, spark):
    docs = odd_docs(spark)
    assert OPERATORS[name](docs).count() == docs.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, spark):
    assert OPERATORS[name](odd_docs(spark).limit(0)).count() == 0


CLASHING = ["n_words", "score", "kept", "bits", "n_lines", "n_tokens", "spans", "size", "sig", "id", "__text_in", "block", "__r", "__gone", "__lines"]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(name, spark):
    docs = odd_docs(spark).withColumns({c: F.lit("mine") for c in CLASHING})
    out = OPERATORS[name](docs)
    assert len(set(out.columns)) == len(out.columns)
    assert out.count() == docs.count()
    for c in ("__r", "__gone", "__lines", "__text_in"):
        assert c not in out.columns or {r[0] for r in out.select(c).distinct().collect()} == {"mine"}


def test_token_counts_equal_plain_viterbi():
    vocab = token_counts.Vocabulary(token_counts.load())
    r = random.Random(5)
    some = {bytes(r.choice(b"abcdeth \xc3\xa9xz01") for _ in range(r.randint(1, 14))) for _ in range(1500)} | {b"a" * 300, b"the", b" the", b"\xff"}
    ordered = sorted(some)

    def plain(w: bytes) -> int:
        best = [(0, 0)] + [(0, 0)] * len(w)
        for j in range(1, len(w) + 1):
            best[j] = max((best[i][0] + vocab.scores[w[i:j]], best[i][1] - 1) for i in range(j) if w[i:j] in vocab.scores)
        return -best[-1][1]

    assert token_counts.count_tokens(ordered, vocab).tolist() == [plain(w) for w in ordered]


@pytest.mark.parametrize("deep", [1, 5, 1 << 20])
def test_token_counts_of_whole_texts_equal_plain(deep, spark, monkeypatch):
    """The operator, slices, kept counts and single tails against a plain count of each text."""
    import regex

    vocab = token_counts.Vocabulary(token_counts.load())
    monkeypatch.setattr(token_counts, "DEEP", deep)
    r = random.Random(deep)
    texts = [" ".join(words(k, 40, 300)) + r.choice(["", "é" * 50, "a" * 900, "\n\n  x"]) for k in range(30)] + [None, ""]

    def plain(w: bytes) -> int:
        best = [(0, 0)] + [(0, 0)] * len(w)
        for j in range(1, len(w) + 1):
            best[j] = max((best[i][0] + vocab.scores[w[i:j]], best[i][1] - 1) for i in range(max(0, j - 130), j) if w[i:j] in vocab.scores)
        return -best[-1][1]

    want = {k: sum(plain(w.encode()) for w in regex.findall(token_counts.PATTERN, t or "")) for k, t in enumerate(texts)}
    assert {x.doc_id: x.n_tokens for x in token_counts.token_counts(make(spark, texts)).collect()} == want


def test_token_counts_add_up(spark):
    out = {r.doc_id: r for r in token_counts.token_counts(make(spark, ["the cat", None, "the cat the cat"])).collect()}
    assert (out[1].n_pretokens, out[1].n_tokens) == (0, 0)
    assert out[2].n_pretokens == 4 and out[0].n_pretokens == 2
    assert out[2].n_tokens >= 4


def test_warc_copies_and_predicates(spark, tmp_path):
    big, small = "<p>" + "x" * 1500, "tiny"
    pages = spark.createDataFrame([(1, "u\n1", big), (2, None, big), (3, "http://b", small), (4, "http://c", small), (5, "http://d", None), (None, "e", big), (7, "é%0A", "ü" * 999)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages.repartition(3), path)
    back = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert {k: v.record_type for k, v in back.items()} == {1: "revisit", 2: "response", 3: "response", 4: "response", 5: "response", None: "revisit", 7: "response"}
    assert back[1].refers_to == 2 and back[None].refers_to == 2 and back[1].payload is None
    assert bytes(back[2].payload) == big.encode() and back[1].payload_bytes == len(big)
    assert back[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert back[1].target_uri == "u\n1" and back[7].target_uri == "é%0A" and back[2].target_uri is None
    assert bytes(back[5].payload) == b""
    assert bytes(back[7].payload) == ("ü" * 999).encode()
    picked = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' and target_uri = 'e'").collect()
    assert [r.page_id for r in picked] == [None] and picked[0].payload is None
    reader = warc.WarcReader(path, True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.In(("payload_digest",), ("a", "b")), warc.EqualTo(("page_id",), 3)]))
    assert [f.attribute for f in left] == [("page_id",)]
    assert reader.wanted == {"warc-type": {"response"}, "warc-payload-digest": {"a", "b"}}


def test_warc_long_and_blank_edged_uris(spark, tmp_path):
    """Headers of every length round the read size, with payloads off; blanks at the edges."""
    uris = ["http://x/" + "u" * n for n in range(3660, 3780, 7)] + [" http://x ", "\thttp://%20 ", "  ", "a\n "]
    pages = spark.createDataFrame([(k, u, "b" * 123_456) for k, u in enumerate(uris)] + [(k + 1000, u, None) for k, u in enumerate(uris)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    out = {r.page_id: r for r in warc.read_warc(spark, path, payload=False).collect()}
    assert all(out[k].target_uri == u and out[k].payload_bytes == 123_456 and out[k + 1000].payload_bytes == 0 for k, u in enumerate(uris))
    assert {r.page_id % 1000 for r in warc.read_warc(spark, path).where(F.col("target_uri") == " http://x ").collect()} == {uris.index(" http://x ")}


def test_warc_members_too_long_for_the_field():
    rows = [{"record_type": "response", "page_id": k, "target_uri": None, "payload_digest": "d", "payload_bytes": n, "refers_to": None, "payload": b"z" * n} for k, n in enumerate((9_000, 10))]
    data = b"".join(warc.member(warc.record(r), most=100) for r in rows)
    assert [h["warc-record-id"] for h, _ in warc.records(_Sized(data), {})] == ["<urn:page:0>", "<urn:page:1>"]
    assert [h["warc-record-id"] for h, _ in warc.records(_Sized(data), {"warc-record-id": {"<urn:page:1>"}})] == ["<urn:page:1>"]


class _Sized:
    def __init__(self, data):
        import io

        self._f, self._n = io.BytesIO(data), len(data)

    def size(self):
        return self._n

    def __getattr__(self, name):
        return getattr(self._f, name)


def test_warc_empty_and_without_skip_lengths(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0
    rows = [{"record_type": "response", "page_id": k, "target_uri": None, "payload_digest": "d", "payload_bytes": n, "refers_to": None, "payload": b"z" * n} for k, n in enumerate((0, 10, 70_000))]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(r)) for r in rows))
    out = {r.page_id: len(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}/plain").collect()}
    assert out == {0: 0, 1: 10, 2: 70_000}


def test_line_dedup_threshold_and_positions(spark):
    common, rare = "  Shared LINE\t", "only nine"
    texts = [f"top {k}\n{common if k % 2 else common.upper()}\n{rare if k < 9 else 'x'}\n\n" for k in range(10)] + ["shared line", "shared line\nshared line\nend"]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(make(spark, texts)).collect()}
    assert out[0].text == f"top 0\n{rare}\n\n" and (out[0].n_lines, out[0].n_dropped) == (5, 1)
    assert out[10].text == "" and out[11].text == "end" and out[11].n_dropped == 2


def test_line_dedup_counts_ids_once(spark):
    rows = [(1, "again", None, None, 0)] * 20 + [(None, "again", None, None, 0)] * 20
    assert {r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()} == {"again"}


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_sep|>", "<", "|x", "<|im_start|>assistant<|im_sep|>", "", None, "\n\n  é🙂‍", "<\\\\|"]
    rows = [(k, t, "assistant" if t % 2 else "user", nasty[(k + t) % len(nasty)]) for k in range(9) for t in range(4)]
    rows += [(20, None, None, None), (20, 1, "assistant", "same"), (20, 1, "assistant", "same"), (None, 0, "assistant", "who")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    by: dict = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, items in by.items():
        items.sort()
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in items)
        loss = "".join(x for _, _, r, x in items if r == "assistant")
        assert out[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest(), c
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_token_mask_by_binary_search():
    offsets = np.array([(0, 2), (2, 5), (5, 5), (5, 9), (9, 12)])
    assert chat_format.token_mask(offsets, np.array([(2, 5), (9, 10)])).tolist() == [False, True, False, False, True]


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    up = list(range(len(texts)))
    links = [0] * len(texts)

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), find(k), links[k]) for k, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(seed, spark):
    """Chains and clusters around the threshold, exact copies, passages that many share."""
    r = random.Random(seed)
    texts: list = [None, "", "  ", "one two", "ONE two", "three"]
    passage = words(99, 60)
    for group in range(6):
        base = words(seed * 100 + group, r.choice([12, 60, 150]))
        for _ in range(r.choice([3, 25, 60])):
            x = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                x[r.randrange(len(x))] = f"n{r.randrange(10**6)}"
            if r.random() < 0.3:
                base = x
            texts.append(" ".join(x))
    texts += [" ".join(passage + words(1000 + k, 70)) for k in range(40)]
    texts += [texts[10]] * 15
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in ngram_join.join_components(make(spark, texts), counted=True).collect()}
    assert [got[k] for k in range(len(texts))] == plain_components(texts)


@pytest.mark.parametrize("no_id", [True, False])
def test_ngram_join_compares_rows_by_their_own_texts(no_id, spark):
    """Groups of near copies of which all rows share one id (or have none), and repeated rows."""
    texts = []
    for group in range(8):
        base = words(7000 + group, 60)
        texts += [" ".join(base), " ".join([*base[:-1], f"n{group}"]), " ".join(base[:40] + words(7100 + group, 20))]
    texts += [texts[0]] * 5
    rows = [(None if no_id else 9, t, "en", "s", len(t)) for t in texts] + [(100 + k, t + " end", "en", "s", len(t)) for k, t in enumerate(texts)]
    every = [r[1] for r in rows]
    out = ngram_join.join_components(spark.createDataFrame(rows, DOCS).repartition(3), keyed=True).collect()
    plain = plain_components(every)
    got = {}
    for r in out:
        got.setdefault(r.component, set()).add((r.doc_id, r.n_shingles, r.component_id))
    want = {}
    for r, (n, c, _) in zip(rows, plain, strict=True):
        ids = [x[0] for x, (_, y, _) in zip(rows, plain, strict=True) if y == c and x[0] is not None]
        want.setdefault(c, set()).add((r[0], n, min(ids) if ids else None))
    assert sorted(map(sorted, (map(str, g) for g in got.values()))) == sorted(map(sorted, (map(str, g) for g in want.values())))


@pytest.mark.parametrize("hot,blocks", [(0, 4), (1, 8)])
def test_ngram_join_equals_brute_force_past_its_bounds(hot, blocks, spark, monkeypatch):
    """Salted lists, thinned scans, shuffled joins, rounds and blocks; ids that are strings."""
    monkeypatch.setattr(ngram_join, "HOT_MEANS", hot)
    monkeypatch.setattr(ngram_join, "SMALL", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", blocks)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 5)
    reached = set()
    for name in ("_thinned", "_round_pairs", "_ask_blocks", "_derived"):
        plain = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda *a, _f=plain, _n=name: reached.add(_n) or _f(*a))
    kept = []
    lists = ngram_join._lists
    monkeypatch.setattr(ngram_join, "_lists", lambda *a: kept.append(lists(*a)) or kept[-1])
    r = random.Random(blocks)
    texts = []
    for group in range(4):
        base = words(blocks * 100 + group, 80)
        for _ in range(40):
            x = list(base)
            for _ in range(r.choice([1, 2, 3, 5])):
                x[r.randrange(len(x))] = f"n{r.randrange(10**6)}"
            if r.random() < 0.5:
                base = x
            texts.append(" ".join(x))
    passage = words(98, 70)
    texts += [" ".join(passage + words(2000 + k, 30)) for k in range(40)]
    docs = make(spark, texts).withColumn("doc_id", F.format_string("%05d", "doc_id"))
    got = {int(x.doc_id): (x.n_shingles, int(x.component_id), x.n_links) for x in ngram_join.join_components(docs, counted=True).collect()}
    assert [got[k] for k in range(len(texts))] == plain_components(texts)
    assert reached == {"_thinned", "_round_pairs", "_ask_blocks", "_derived"}
    assert kept[0].where("salt >= 0").count() > 0


def test_answers_equal_brute_force():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**63, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate((r.choice(base, 60, replace=False), r.integers(0, 2**63, r.integers(0, 30)).astype(np.uint64)))) for _ in range(120)]
    members, askers = sets[:60], sets[60:] + [np.zeros(0, np.uint64)]
    found = dict(ngram_join.answers(members, askers, 75))
    for k, s in enumerate(askers):
        ok = [m for m, t in enumerate(members) if len(s) and 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]
        assert sorted(found.get(k, [])) == ok


def test_quality_rules_cases(spark):
    clean = " ".join(words(4, 200))
    para = " ".join(words(8, 40))
    cases = {"clean": clean, "short": "a b c", "loop": "the same three words " * 40, "copy": clean + "\n" + para + "\n" + "\n".join([para + " end"] * 3), "symbols": " ".join(w + "###" for w in words(6, 100))}
    out = {r.doc_id: r for r in quality_rules.quality_rules(make(spark, list(cases.values()))).collect()}
    kept = dict(zip(cases, (out[k].kept for k in range(len(cases))), strict=True))
    assert kept == {"clean": True, "short": False, "loop": False, "copy": False, "symbols": False}
    assert out[2].n_repeat_words == 160 and out[3].n_dup_lines == 2


def test_fm_index_finds_every_occurrence():
    r = np.random.default_rng(1)
    seq = np.concatenate([np.append(r.integers(1, 4, n), 0) for n in (50, 1, 300, 20)])
    index = decontaminate.FMIndex(seq)
    for length in (1, 2, 4, 7):
        rows = np.unique(r.integers(1, 5, (60, length)), axis=0)
        which, lo, hi = index.search(rows, np.full(len(rows), length))
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi, strict=True)}
        for k, row in enumerate(rows):
            plain = [i for i in range(len(seq) - length + 1) if (seq[i : i + length] == row).all()]
            assert found.get(k, []) == plain


def test_decontaminate_blocks_and_clean_text(spark):
    passage = words(1, 12)
    bench = spark.createDataFrame([(7, " ".join(passage)), (8, "tiny item"), (9, None), (10, "..."), (7, "more words here " * 5)], "item_id long, text string")
    text = "Before it, " + "; ".join(passage).upper() + "! after Tiny-ITEM end"
    docs = make(spark, [text, "nothing", " ".join(passage[:9]), None])
    for block in (1 << 20, 40):
        out = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()}
        assert out[0].item_ids == ["7", "8"] and out[0].n_hit == 14
        assert out[0].clean_text == "Before it, ! after  end"
        assert (out[1].n_hit, out[2].n_hit, out[3].n_hit) == (0, 0, 0) and out[3].clean_text is None


def test_mixing_budgets(spark):
    texts = [("a " * (k % 50 + 1)).strip() for k in range(400)]
    rows = [(k, t, None, ["x", "y", None, "z"][k % 4] if k > 20 else "rare", 0) for k, t in enumerate(texts)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS).repartition(5)).toPandas()
    total = out["size"].sum()
    for _, g in out.groupby(out["source"].fillna("~")):
        assert g["taken"].sum() == int(np.floor(g["target"].iloc[0]))
        assert (g["taken"] <= 3 * g["size"]).all() and g["target"].iloc[0] <= 3 * g["source_size"].iloc[0] + 1e-6
    assert abs(out.groupby(out["source"].fillna("~"))["target"].first().sum() - total) < 1e-6
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], DOCS)).toPandas()
    assert sorted(out[["doc_id", "taken"]].itertuples(index=False)) == sorted(again[["doc_id", "taken"]].itertuples(index=False))


def test_mixing_many_ranges_agree(spark, monkeypatch):
    docs = make(spark, [("b " * (k % 7)).strip() for k in range(300)])
    one = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    assert {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()} == one


def test_language_id_held_out(spark, data):
    out = language_id.query(spark, data.replace("sf0.001", "sf0.01")).join(spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").toPandas()
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert held["score"].between(0, 1).all()


def test_language_id_without_letters(spark):
    docs = make(spark, ["the cat sat on the mat", "123 ...", None, ""])
    out = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert out[0].lang_pred == "en" and {out[k].lang_pred for k in (1, 2, 3)} == {"und"}


def test_kneser_ney_probabilities_add_up(spark):
    docs = make(spark, ["abab abba baab", "bb aa ab"])
    model = language_id.train(docs)
    ctx = language_id.trigrams("ab")[1] >> 21 if len(language_id.trigrams("ab")) > 1 else 0
    seen = np.array([(ctx << 21) | c for c in (ord("a"), ord("b"), 32, ord("q"))])
    p = 2.0 ** model.log_prob("en", seen)
    assert (p > 0).all() and p[:3].sum() + p[3] <= 1 + 1e-6 and p[3] < p[0]


def test_quality_cnn_held_out(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    out = quality_cnn.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1]["score"], out[out.quality == 0]["score"]
    assert len(bad) >= 5 and (good.values[:, None] > bad.values[None]).mean() > 0.9
    assert ((out.score >= 0.7).astype(int) == out.predicted).all()


def test_cnn_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 5000):
        data = (np.arange(n) % 251 + 1).astype(np.uint8)
        x, first = quality_cnn.chunks(data, np.array([0, n]))
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        back = np.zeros(max(n, 1) + 2 * quality_cnn.CHUNK, np.uint8)
        for k, c in enumerate(x):
            back[k * step : k * step + len(c)] = np.maximum(back[k * step : k * step + len(c)], c)
        assert (back[:n] == data).all() and not back[n:].any() and first.tolist() == [0, len(x)]


def test_cnn_without_labels_is_neutral(spark):
    docs = make(spark, ["some text", "other"])
    net = quality_cnn.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_cnn.classify(docs, net).collect()} == {0.5}
