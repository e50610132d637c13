"""Language identification with interpolated Kneser-Ney character trigrams.

Training counts every trigram of every training document in the tasks, adds the counts up
by language with partial aggregation, and derives the continuation counts of bigrams and
characters from the distinct trigrams, again as Spark aggregations. A language's model is
five sorted arrays of 64-bit hashes with their counts. The hash is a bijection of the packed
n-gram, so no two n-grams meet and the arrays grow with the distinct n-grams. A text is scored by its mean cross-entropy under each
language, over its whole length; the lowest wins. A temperature turns the differences into a
probability, and texts that fit no language as well as training rows do are marked as rejected.
Both are fitted on all training rows, each scored as if its own language had not counted it and
its copies (``left_out``): nothing is set apart and nothing is sampled. ``train`` alone can also
fit them on a few rows that the counts leave out, which reads the texts once less.

A model of up to ``MODEL_ROWS`` n-grams goes to the tasks whole. A larger one stays a table in the
shared folder: the distinct trigrams of slices of text are joined with it, and their logarithms
come back to the slices. Both ways give the same results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textbatch as tb
from marketloom.llm.scratch import table, write_through

#: Without ``every``: distinct training rows (each language's lowest hashes) on which temperature and
#: limits are fitted, shared out evenly; but a language has LEAST_ROWS at least, if it has so many. The
#: counts leave these rows out where a language has APART times as many; a rarer language
#: counts all its rows and is calibrated on some of them.
CALIBRATION_ROWS = 2_000
LEAST_ROWS = 50
APART = 4
#: A text is rejected if its cross-entropy is over the mean by so many standard deviations.
REJECT_SD = 5.0
#: N-grams, over all languages, that are collected and broadcast: 24 bytes each, so 100 MB.
MODEL_ROWS = 4_000_000
UNDETERMINED = "und"
#: Temperatures that are tried.
GRID = [2.0**k for k in range(-2, 8)]
#: The weight of a text in the integers that calibration sums up; copies share it.
UNIT = 1 << 28
#: Bytes of text that are measured at once in calibration: some twenty numbers a character.
MEASURED_BYTES = 1 << 19
_MASK = (1 << 21) - 1
_TABLES = ("tri", "tri_ctx", "bi", "bi_ctx", "uni")
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
    return _LETTER


def trigrams(text: str | None) -> np.ndarray:
    """Packed trigrams of the text: letters in lower case, each run of others one space,
    a space before and after. Empty if there is no letter."""
    if not text:
        return np.zeros(0, np.int64)
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letters()[x]
    if not letter.any():
        return np.zeros(0, np.int64)
    x = np.concatenate(([32], np.where(letter, x, 32), [32]))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    x = np.concatenate(([32], x[keep]))
    return (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]


def key(code: np.ndarray) -> np.ndarray:
    """The hash under which a packed n-gram is stored."""
    return tb.mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


class Verdicts:
    """What entropies say: probabilities, limits, and how both are fitted."""

    languages: list[str]
    temperature: float
    limits: np.ndarray

    def probabilities(self, bits: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = -(bits - np.nanmin(bits, axis=1, keepdims=True)) * (temperature or self.temperature)
        e = np.exp(np.maximum(z, -700))
        return e / e.sum(axis=1, keepdims=True)

    def calibrate(self, bits: np.ndarray, langs: list[str]) -> None:
        """Fit temperature and limits on the cross-entropies of labelled texts."""
        ok = ~np.isnan(bits).any(axis=1)
        if not ok.any():
            return
        bits, truth = bits[ok], np.array([self.languages.index(x) for x in np.array(langs, object)[ok]])
        rows = np.arange(len(truth))
        self.temperature = max(GRID, key=lambda t: np.log(np.maximum(self.probabilities(bits, t)[rows, truth], 1e-12)).mean())
        for k in range(len(self.languages)):
            own = bits[truth == k, k]
            if len(own) > 1:
                self.limits[k] = own.mean() + REJECT_SD * own.std() + 1e-9

    def sums(self, bits: np.ndarray, langs: list[str], copies: np.ndarray) -> pa.RecordBatch:
        """What ``fit`` needs of labelled texts: rows (lang, k, value) of integers, so that sums don't
        depend on their order. A text that comes several times weighs as one."""
        where = {lang: k for k, lang in enumerate(self.languages)}
        truth = np.array([where.get(x, -1) for x in langs], np.int64)
        ok = (truth >= 0) & ~np.isnan(bits).any(axis=1)
        bits, truth, weight = bits[ok], truth[ok], np.maximum(UNIT // copies[ok], 1)
        rows = np.arange(len(truth))
        own = bits[rows, truth]
        logs = (np.log(np.maximum(self.probabilities(bits, t)[rows, truth], 1e-12)) for t in GRID) if len(rows) else ()
        values = np.array([weight, *(np.rint(x * weight).astype(np.int64) for x in (own, own * own, *logs))])
        found = np.unique(truth)
        totals = np.array([values[:, truth == k].sum(axis=1) for k in found], np.int64).reshape(-1)
        names, ks = np.repeat(np.array(self.languages, object)[found], len(values)), np.tile(np.arange(len(values)), len(found))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ks, pa.int64()), pa.array(totals, pa.int64())], ["lang", "k", "value"])

    def fit(self, sums: DataFrame) -> None:
        """As ``calibrate``, on the ``sums`` of all texts."""
        rows = sums.groupBy("lang", "k").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        of = {(r.lang, r.k): int(r.value) for r in rows}  # a few numbers a language
        if of:
            self.temperature = max(GRID, key=lambda t: sum(of[lang, 3 + GRID.index(t)] for lang, k in of if not k))
        for i, lang in enumerate(self.languages):
            weight, s, squares = (of.get((lang, k), 0) for k in range(3))
            if weight > UNIT:  # several texts
                self.limits[i] = s / weight + REJECT_SD * (max(squares * weight - s * s, 0) / weight**2) ** 0.5 + 1e-9

    def columns(self, bits: np.ndarray) -> list[pa.Array]:
        """The ``ADDED`` columns for rows of entropies."""
        n = len(bits)
        lang, score, low, rejected = np.full(n, UNDETERMINED, object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        ok = np.flatnonzero(~np.isnan(bits).any(axis=1)) if self.languages else np.zeros(0, int)
        if len(ok):
            best = np.argmin(bits[ok], axis=1)
            lang[ok] = np.array(self.languages, object)[best]
            score[ok] = self.probabilities(bits[ok])[np.arange(len(ok)), best]
            low[ok] = bits[ok, best]
            rejected[ok] = low[ok] > self.limits[best]
        return [pa.array(lang, pa.string()), pa.array(score), pa.array(low, pa.float64(), from_pandas=True), pa.array(rejected)]


def left_out(distinct: np.ndarray, at: np.ndarray, sizes: np.ndarray, copies: np.ndarray, found: list[np.ndarray], facts: dict[str, tuple], symbols: int) -> np.ndarray:
    """Mean bits a character of texts of one language, each under the language's counts without it
    and its copies; NaN if nothing is left.

    ``distinct`` are packed trigrams, ``at`` where the texts' trigrams stand in it, text after text.
    ``found`` has for each of ``distinct`` what the language's tables hold: the trigram's count, its
    context's count and kinds, the same of the bigram, the character's count. ``facts`` has for
    "tri", "bi" and "uni" the counts that are 1 and 2, their total, and how many there are. Exact:
    trigrams of which none is left take their bigrams' kinds along, and so on to discounts.
    """
    many, width = len(sizes), len(distinct)
    if many == 1:  # perhaps a long text: no copies of its trigrams
        c = np.bincount(at, minlength=width)
        pair = np.flatnonzero(c)
        c = c[pair]
    else:
        pair, c = np.unique(np.repeat(np.arange(many) * width, sizes) + at, return_counts=True)
    t, j = pair // width, pair % width

    def groups(code: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a text with the same ``code``: the first of each, and which one a row is in."""
        kind = np.unique(code, return_inverse=True)[1]
        _, first, of = np.unique(t[rows] * width + kind[j[rows]], return_index=True, return_inverse=True)
        return first, of

    def discount(name: str, text: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        one, two = (facts[name][v - 1] - np.bincount(text, before == v, many) + np.bincount(text, after == v, many) for v in (1, 2))
        good = (one > 0) & (two > 0)
        return np.where(good, one / np.where(good, one + 2 * two, 1), 0.5)[text]

    def mixed(n: np.ndarray, d: np.ndarray, whole: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
        safe = np.where(whole > 0, whole, 1.0)
        return np.where(whole > 0, np.maximum(n - d, 0) / safe + d * kinds / safe * lower, lower)

    # a row for each text and trigram
    n3, whole3, kinds3, n2, whole2, kinds2, n1 = (x[j] for x in found)
    own = c * copies[t]
    left3 = np.maximum(n3 - own, 0)
    gone3 = left3 == 0
    _, of = groups(distinct >> 21, np.arange(len(pair)))
    whole3, kinds3 = whole3 - np.bincount(of, own)[of], kinds3 - np.bincount(of, gone3)[of]
    # for each text and bigram
    bi, bi_of = groups(distinct & ((1 << 42) - 1), np.arange(len(pair)))
    lost = np.bincount(bi_of, gone3)
    left2 = np.maximum(n2[bi] - lost, 0)
    gone2 = left2 == 0
    _, of = groups((distinct >> 21) & _MASK, bi)
    whole2, kinds2 = whole2[bi] - np.bincount(of, lost)[of], kinds2[bi] - np.bincount(of, gone2)[of]
    # for each text and character
    uni, uni_of = groups(distinct & _MASK, bi)
    t2, n1 = t[bi], n1[bi][uni]
    t1 = t2[uni]
    left1 = np.maximum(n1 - np.bincount(uni_of, gone2), 0)
    total = (facts["uni"][2] - np.bincount(t2, gone2, many))[t1]
    kinds1 = (facts["uni"][3] - np.bincount(t1, left1 == 0, many))[t1]

    p = mixed(left1, discount("uni", t1, n1, left1), total, kinds1, np.full(len(uni), 1 / symbols))
    p = np.where(total > 0, p, np.nan)[uni_of]
    p = mixed(left2, discount("bi", t2, n2[bi], left2), whole2, kinds2, p)[bi_of]
    p = mixed(left3, discount("tri", t, n3, left3), whole3, kinds3, p)
    return -np.bincount(t, c * np.log2(p), many) / sizes


class Model(Verdicts):
    """Sorted hash arrays by language."""

    def __init__(self, rows: pa.Table):
        """From (lang, name, k, n, kinds), a row for each n-gram."""
        lang, name = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "name"))
        names, codes = name.dictionary.to_pylist(), lang.indices.to_numpy().astype(np.int64) * len(_TABLES) + name.indices.to_numpy()
        k, n, kinds = (rows.column(c).to_numpy() for c in ("k", "n", "kinds"))
        order = np.lexsort((k, codes))
        codes, k, n, kinds = codes[order], k[order], n[order].astype(float), kinds[order].astype(float)
        self.tables: dict[str, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, one in enumerate(lang.dictionary.to_pylist()):
            cuts = np.searchsorted(codes, i * len(_TABLES) + np.arange(len(names) + 1))
            self.tables[one] = {x: (k[a:b], n[a:b], kinds[a:b]) for x, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)}
        self.languages = sorted(self.tables)
        self.symbols = max((len(t["uni"][0]) for t in self.tables.values()), default=0) + 1
        self.temperature, self.limits = 1.0, np.full(len(self.languages), np.inf)

    @staticmethod
    def _find(t: tuple, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(t[0], k), len(t[0]) - 1)
        ok = t[0][at] == k
        return np.where(ok, t[1][at], 0.0), np.where(ok, t[2][at], 0.0)

    @staticmethod
    def _discount(counts: np.ndarray) -> float:
        one, two = (counts == 1).sum(), (counts == 2).sum()
        return float(one / (one + 2 * two)) if one and two else 0.5

    def log_prob(self, lang: str, code: np.ndarray) -> np.ndarray:
        """log2 P(third | first two) of packed trigrams."""
        t = self.tables[lang]
        total = t["uni"][1].sum()
        d = self._discount(t["uni"][1])
        n, _ = self._find(t["uni"], key(code & _MASK))
        p = np.maximum(n - d, 0) / total + d * len(t["uni"][0]) / total / self.symbols
        for name, gram, ctx in (("bi", code & ((1 << 42) - 1), (code >> 21) & _MASK), ("tri", code, code >> 21)):
            d = self._discount(t[name][1])
            n, _ = self._find(t[name], key(gram))
            total, kinds = self._find(t[f"{name}_ctx"], key(ctx))
            seen = total > 0
            safe = np.where(seen, total, 1.0)
            p = np.where(seen, np.maximum(n - d, 0) / safe + d * kinds / safe * p, p)
        return np.log2(p)

    def _facts(self, lang: str) -> dict[str, tuple]:
        tables = ((x, self.tables[lang][x][1]) for x in ("tri", "bi", "uni"))
        return {x: ((n == 1).sum(), (n == 2).sum(), n.sum(), len(n)) for x, n in tables}

    def _own(self, lang: str, code: np.ndarray) -> list[np.ndarray]:
        """What the tables of a language hold of trigrams, as ``left_out`` takes it."""
        t = self.tables[lang]
        bigram, second, third = code & ((1 << 42) - 1), (code >> 21) & _MASK, code & _MASK
        return [self._find(t["tri"], key(code))[0], *self._find(t["tri_ctx"], key(code >> 21)), self._find(t["bi"], key(bigram))[0], *self._find(t["bi_ctx"], key(second)), self._find(t["uni"], key(third))[0]]

    def entropies(self, texts: list[str | None], langs: list[str] | None = None, copies: np.ndarray | None = None) -> np.ndarray:
        """Mean bits a character by text and language; NaN without letters. With the ``langs`` of the
        texts and how many ``copies`` of each were counted: their own language's without them."""
        grams = [trigrams(x) for x in texts]
        sizes = np.array([len(g) for g in grams])
        out = np.full((len(texts), len(self.languages)), np.nan)
        has = np.flatnonzero(sizes)
        if len(has) and self.languages:
            every = np.concatenate([grams[k] for k in has])
            s = np.sort(every)
            distinct = s[np.concatenate(([True], s[1:] != s[:-1]))]
            at = np.searchsorted(distinct, every)
            begin = np.cumsum(sizes[has]) - sizes[has]
            for k, lang in enumerate(self.languages):
                out[has, k] = -np.add.reduceat(self.log_prob(lang, distinct)[at], begin) / sizes[has]
                own = np.array([langs[x] == lang for x in has]) if langs else np.zeros(0, bool)
                if own.any():
                    some, mine = at if own.all() else at[np.repeat(own, sizes[has])], has[own]
                    out[mine, k] = left_out(distinct, some, sizes[mine], copies[mine], self._own(lang, distinct), self._facts(lang), self.symbols)
        return out


class Stored(Verdicts):
    """A model that stays a table: rows (lang, name, k, n, kinds) and, by language and table, the
    numbers that all probabilities share."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        one = lambda v: F.count(F.when(F.col("n") == v, 1))
        facts = rows.groupBy("lang", "name").agg(one(1).alias("one"), one(2).alias("two"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()
        self.facts = {(r.lang, r.name): (r.one / (r.one + 2 * r.two) if r.one and r.two else 0.5, r.total, r.kinds) for r in facts}
        self.counts = {(r.lang, r.name): (r.one, r.two, r.total, r.kinds) for r in facts}
        self.languages = sorted({r.lang for r in facts})
        self.symbols = max((r.kinds for r in facts if r.name == "uni"), default=0) + 1
        self.temperature, self.limits = 1.0, np.full(len(self.languages), np.inf)

    def log_probs(self, codes: DataFrame, found: bool = False) -> DataFrame:
        """(code, bits): log2 P(third | first two) by language of the trigrams ``codes``; if asked for, also
        what the tables hold of them by language, as ``left_out`` takes it."""

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c = b.column("code").to_numpy()
                of = (c, c >> 21, c & ((1 << 42) - 1), (c >> 21) & _MASK, c & _MASK)
                yield pa.RecordBatch.from_arrays([b.column("code"), *(pa.array(key(x)) for x in of)], ["code", *_TABLES])

        x = codes.mapInArrow(keyed, f"code long, {', '.join(f'{t} long' for t in _TABLES)}")
        for t in _TABLES:
            by = self.rows.where(F.col("name") == t).groupBy(F.col("k").alias(t)).agg(F.collect_list(F.struct("lang", "n", "kinds")).alias(f"{t}_by"))  # a row a language
            x = x.join(by, t, "left")
        facts, languages, symbols = self.facts, self.languages, self.symbols

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where = {lang: k for k, lang in enumerate(languages)}
            for b in batches:
                n = {t: np.zeros((b.num_rows, len(languages))) for t in _TABLES}
                kinds = {t: np.zeros((b.num_rows, len(languages))) for t in _TABLES}
                for t in _TABLES:
                    for row, found in enumerate(b.column(f"{t}_by").to_pylist()):
                        for f in found or ():
                            n[t][row, where[f["lang"]]], kinds[t][row, where[f["lang"]]] = f["n"], f["kinds"]
                out = np.zeros((b.num_rows, len(languages)))
                for lang, k in where.items():
                    d, total, many = facts[lang, "uni"]
                    p = np.maximum(n["uni"][:, k] - d, 0) / total + d * many / total / symbols
                    for t in ("bi", "tri"):
                        d = facts[lang, t][0]
                        whole, seen = n[f"{t}_ctx"][:, k], n[f"{t}_ctx"][:, k] > 0
                        safe = np.where(seen, whole, 1.0)
                        p = np.where(seen, np.maximum(n[t][:, k] - d, 0) / safe + d * kinds[f"{t}_ctx"][:, k] / safe * p, p)
                    out[:, k] = np.log2(p)
                made = [b.column("code"), pa.array(out.tolist(), pa.list_(pa.float64()))]
                if found:
                    held = np.stack([n["tri"], n["tri_ctx"], kinds["tri_ctx"], n["bi"], n["bi_ctx"], kinds["bi_ctx"], n["uni"]], axis=2)
                    made.append(pa.array(held.tolist(), pa.list_(pa.list_(pa.float64()))))
                yield pa.RecordBatch.from_arrays(made, ["code", "bits", "found"][: len(made)])

        return x.select("code", *(f"{t}_by" for t in _TABLES)).mapInArrow(score, "code long, bits array<double>" + ", found array<array<double>>" * found)

    def entropies(self, texts: DataFrame) -> DataFrame:
        """(h, bits) for each distinct hash of ``texts`` (h, text) with a letter: mean bits a
        character by language. A slice of texts is a row of trigram numbers; its distinct
        trigrams meet the model in a join and come back as one sorted list."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in tb.slices(whole, "text"):
                    grams = [trigrams(t) for t in batch.column("text").to_pylist()]
                    sizes = [len(g) for g in grams]
                    codes, at = np.unique(np.concatenate([np.zeros(0, np.int64), *grams]), return_inverse=True)
                    if len(codes):
                        row = [[uuid.uuid4().hex], [batch.column("h").to_pylist()], [sizes], [codes.tolist()], [at.tolist()]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, shape, strict=True)], schema=shape)

        shape = pa.schema([("slice", pa.string()), ("h", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64())), ("at", pa.list_(pa.int64()))])
        slices = write_through(texts.mapInArrow(cut, "slice string, h array<binary>, sizes array<long>, codes array<long>, at array<long>"), "lm-slices")
        asked = slices.select("slice", F.explode("codes").alias("code"))
        known = self.log_probs(asked.select("code").distinct())
        back = asked.join(known, "code").groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("code", "bits"))).alias("by"))  # a slice's own distinct trigrams
        both = slices.select("slice", "h", "sizes", "at").join(back, "slice")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    table_ = np.array([x["bits"] for x in row["by"]])[np.array(row["at"], np.int64)]
                    sizes = np.array(row["sizes"], np.int64)
                    has = np.flatnonzero(sizes)
                    begin = np.cumsum(sizes[has]) - sizes[has]
                    bits = -np.add.reduceat(table_, begin, axis=0) / sizes[has][:, None]
                    yield pa.RecordBatch.from_arrays([pa.array([row["h"][k] for k in has], pa.binary()), pa.array(bits.tolist(), pa.list_(pa.float64()))], ["h", "bits"])

        return both.mapInArrow(add, "h binary, bits array<double>").groupBy("h").agg(F.min("bits").alias("bits"))

    def own_sums(self, rows: DataFrame) -> DataFrame:
        """The ``sums`` of labelled texts (lang, text, copies), each without itself in the counts of its
        language. As in ``entropies``, but a slice has one language, whose tables come back too."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                langs = np.array(whole.column("lang").to_pylist(), object)
                for lang in sorted(set(langs)):
                    for batch in tb.slices(whole.take(pa.array(np.flatnonzero(langs == lang))), "text", MEASURED_BYTES):
                        grams = [trigrams(t) for t in batch.column("text").to_pylist()]
                        has = [k for k, g in enumerate(grams) if len(g)]
                        if has:
                            codes, at = np.unique(np.concatenate([grams[k] for k in has]), return_inverse=True)
                            copies = batch.column("copies").to_numpy()[has]
                            row = [[uuid.uuid4().hex], [lang], [copies.tolist()], [[len(grams[k]) for k in has]], [codes.tolist()], [at.tolist()]]
                            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, shape, strict=True)], schema=shape)

        longs = pa.list_(pa.int64())
        shape = pa.schema([("slice", pa.string()), ("lang", pa.string()), ("copies", longs), ("sizes", longs), ("codes", longs), ("at", longs)])
        slices = write_through(rows.mapInArrow(cut, "slice string, lang string, copies array<long>, sizes array<long>, codes array<long>, at array<long>"), "lm-own")
        asked = slices.select("slice", "lang", F.explode("codes").alias("code"))
        known = self.log_probs(asked.select("code").distinct(), found=True)
        place = F.array_position(F.array(*(F.lit(x) for x in self.languages)), F.col("lang")).cast("int")
        mine = asked.join(known, "code").select("slice", F.struct("code", "bits", F.element_at("found", place).alias("found")).alias("x"))
        back = mine.groupBy("slice").agg(F.array_sort(F.collect_list("x")).alias("by"))  # a slice's own distinct trigrams
        both = slices.select("slice", "lang", "copies", "sizes", "at").join(back, "slice")
        judge, counts, symbols = Verdicts(), self.counts, self.symbols
        judge.languages, judge.temperature = self.languages, 1.0

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    lang, at, sizes, copies = row["lang"], np.array(row["at"], np.int64), np.array(row["sizes"], np.int64), np.array(row["copies"], np.int64)
                    codes, found = np.array([x["code"] for x in row["by"]], np.int64), np.array([x["found"] for x in row["by"]])
                    bits = -np.add.reduceat(np.array([x["bits"] for x in row["by"]])[at], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                    facts = {t: counts[lang, t] for t in ("tri", "bi", "uni")}
                    bits[:, judge.languages.index(lang)] = left_out(codes, at, sizes, copies, list(found.T), facts, symbols)
                    yield judge.sums(bits, [lang] * len(sizes), copies)

        return both.mapInArrow(add, "lang string, k long, value long")


def text_hash(text: Column) -> Column:
    """128 bits by which equal texts are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", model_rows: int = MODEL_ROWS, every: bool = False) -> Model | Stored:
    """A model from all rows of ``docs`` with a text and a language; one of more than
    ``model_rows`` n-grams stays in the shared folder. With ``every``, all of them are counted and
    all of them calibrate it; without, ``CALIBRATION_ROWS`` do, which the counts may leave out."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null").withColumn("h", F.xxhash64("text", "lang"))
    if every:
        counted = rows.select("text", "lang")
    else:
        sample_keys = write_through(_calibration_keys(rows), "lm-sample")  # few rows a language
        counted = rows.join(F.broadcast(sample_keys.where("apart")), ["lang", "h"], "left_anti").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, "text"):
                texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
                for lang in sorted(set(langs)):
                    code, n = np.unique(np.concatenate([trigrams(texts[k]) for k in np.flatnonzero(langs == lang)]), return_counts=True)
                    if len(code):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    tri = write_through(counted.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "lm-trigrams")
    bi = tri.groupBy("lang", F.col("code").bitwiseAND((1 << 42) - 1).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    uni = bi.groupBy("lang", F.col("code").bitwiseAND(_MASK).alias("code")).agg(F.count(F.lit(1)).alias("n"))

    def named(name: str, df: DataFrame, code: Column) -> DataFrame:
        return df.select("lang", F.lit(name).alias("name"), code.alias("code"), "n")

    parts = named("tri", tri, F.col("code")).unionAll(named("tri_ctx", tri, F.shiftright("code", 21))).unionAll(named("bi", bi, F.col("code"))).unionAll(named("bi_ctx", bi, F.shiftright("code", 21))).unionAll(named("uni", uni, F.col("code")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("name"), pa.array(key(b.column("code").to_numpy())), b.column("n")], ["lang", "name", "k", "n"])

    summed = parts.mapInArrow(keyed, "lang string, name string, k long, n long").groupBy("lang", "name", "k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    summed = write_through(summed, "lm-model")  # a row for each distinct n-gram of a language
    model = Model(summed.toArrow()) if summed.count() <= model_rows else Stored(summed)
    if not model.languages:
        return model
    if every:
        _fit_on_all(model, rows)
        return model
    if isinstance(model, Stored):
        wanted = rows.join(F.broadcast(sample_keys.drop("apart")), ["lang", "h"]).select("lang", text_hash(F.col("text")).alias("t"), "text")
        bits = model.entropies(wanted.select(F.col("t").alias("h"), "text")).withColumnRenamed("h", "t")
        sample = sorted(((r.lang, bytes(r.t), r.bits) for r in wanted.select("lang", "t").distinct().join(bits, "t").collect()), key=lambda r: r[:2])  # few rows a language
        model.calibrate(np.array([r[2] for r in sample]).reshape(len(sample), -1), [r[0] for r in sample])
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, "text"):
                bits = sent.value.entropies(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(bits.tolist(), pa.list_(pa.float64()))], ["h", "lang", "bits"])

    # The texts are measured where they are; only numbers come to the driver.
    known = sample_keys.where(F.col("lang").isin(model.languages))
    found = rows.join(F.broadcast(known.drop("apart")), ["lang", "h"]).mapInArrow(measure, "h long, lang string, bits array<double>")
    sample = found.groupBy("lang", "h").agg(F.min("bits").alias("bits")).orderBy("lang", "h").collect()
    model.calibrate(np.array([r.bits for r in sample]).reshape(len(sample), -1), [r.lang for r in sample])
    return model


def _fit_on_all(model: Model | Stored, rows: DataFrame) -> None:
    """Calibrate a model on all ``rows`` (text, lang, h) that it counts, each left out with its copies."""
    often = rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    labelled = rows.join(write_through(often, "lm-copies"), ["lang", "h"], "left").select("lang", "text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    if isinstance(model, Stored):
        model.fit(model.own_sums(labelled))
        return
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, "text", MEASURED_BYTES):
                langs, copies = batch.column("lang").to_pylist(), batch.column("copies").to_numpy()
                yield sent.value.sums(sent.value.entropies(batch.column("text").to_pylist(), langs, copies), langs, copies)

    # The texts are measured where they are; only sums leave the tasks.
    model.fit(labelled.mapInArrow(measure, "lang string, k long, value long"))


def _calibration_keys(rows: DataFrame) -> DataFrame:
    """(lang, h, apart): the lowest distinct hashes of every language, and whether the counts
    can do without these rows. Hashes are even, so a bound that leaves about twice as many
    comes before the ranking."""
    distinct = write_through(rows.select("lang", "h").distinct(), "lm-keys")
    langs = write_through(distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "lm-langs")
    want = max(CALIBRATION_ROWS // max(langs.count(), 1), LEAST_ROWS)
    share = F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))
    low = distinct.join(F.broadcast(langs), "lang").where(share < F.lit(2.0 * want + 100) / F.col("rows"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h"))
    return low.withColumn("r", rank).where(F.col("r") <= want).select("lang", "h", (F.col("rows") >= APART * want).alias("apart"))


ADDED = ["lang_pred", "score", "bits", "rejected"]


def identify(docs: DataFrame, model: Model | Stored, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``carry`` of them) with ``lang_pred``, ``score`` (the
    probability of that language), ``bits`` (its cross-entropy) and ``rejected``.

    * A null text or one without letters is ``und`` with score 0 and is rejected; so is every
      text if the model has no language.
    * Equal cross-entropies: the first language by name. Rows are scored alone; repeated
      rows agree. Columns named like an added one give way. Empty tables stay empty.
    """
    keep = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in ADDED]
    hide = tb.free("__text_in", keep)
    frame = docs.select(*keep, F.col(text_col).cast("string").alias(hide))
    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    if isinstance(model, Stored):
        mark, own = tb.free("__h", keep), tb.free("__bits", keep)
        rows = frame.withColumn(mark, text_hash(F.col(hide)))
        bits = model.entropies(rows.select(F.col(mark).alias("h"), F.col(hide).alias("text"))).select(F.col("h").alias(mark), F.col("bits").alias(own))
        judge = Verdicts()
        judge.languages, judge.temperature, judge.limits = model.languages, model.temperature, model.limits

        def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                none = [np.nan] * len(judge.languages)
                found = np.array([none if x is None else x for x in batch.column(own).to_pylist()], float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *judge.columns(found)], [*keep, *ADDED])

        return rows.drop(hide).join(bits, mark, "left").mapInArrow(say, schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in tb.slices(whole, hide):
                bits = m.entropies(batch.column(hide).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *m.columns(bits)], [*keep, *ADDED])

    return frame.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on all rows that aren't held out, identify all rows."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()), every=True)
    return identify(docs.withColumn("held_out", held_out()), model, carry=["doc_id", "held_out"])
