"""Texts in JSON from outside: memos, stances, mandates and views, checked and clamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import clamp
from marketloom.operators.contracts import reasons
from marketloom.operators.joins import latest_at

#: Accepted words, ranges of days, lengths of lists, the shape of a ticker.
STANCES, DIRECTIONS, VIEWS, TILTS = ("attractive", "neutral", "avoid"), ("long", "avoid"), ("long", "avoid", "neutral"), ("favor", "avoid")
MEMO_DAYS, STANCE_DAYS, VIEW_DAYS, MANDATE_DAYS = (1, 180), (3, 40), (10, 90), (3, 180)
MAX_STANCES, MAX_WATCHLIST, MAX_SYMBOLS, MAX_STRINGS, MAX_FLAGS = 12, 8, 25, 20, 4
TICKER = r"^[A-Z][A-Z.\-]{0,5}$"
MIN_CONVICTION, EXPIRY_DAYS, REASON_CHARS = 0.3, 30, 60


def _at(v: Column, path: str, kind: str) -> Column:
    """The member at ``path``, or null where it is missing, null or of another kind."""
    return F.try_variant_get(v, path, kind)


def _parsed(raw: DataFrame) -> DataFrame:
    """``raw`` with the JSON object in ``v``; null where the text is none."""
    v = F.try_parse_json("raw")
    return raw.withColumn("v", F.when(_at(v, "$", "map<string,variant>").isNotNull(), v))


def _unusable(v: Column, path: str) -> Column:
    """True where a value stands that is no number."""
    return _at(v, path, "string").isNotNull() & _at(v, path, "double").isNull()


def _within(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(value.cast("int"), F.lit(high)), F.lit(low))


def _symbol(x: Column) -> Column:
    return F.upper(F.trim(x))


def validate_memos(raw: DataFrame, catalog: DataFrame, key: str = "memo_id") -> DataFrame:
    """Memos (``key, symbol, raw``) with ``errors``, and where there are none ``stance,
    confidence, horizon_days, citations``. A citation counts only if the symbol's ``catalog``
    (``symbol, source_id``) has its source; a memo with a direction needs one.

    Citations are joined to the catalogue row by row, so neither side is gathered. ``key`` is
    unique. Missing and null members have defaults: neutral, 0, 21 days."""
    m = _parsed(raw)
    cited = m.select(key, "symbol", F.posexplode(_at(F.col("v"), "$.citations", "array<variant>")).alias("pos", "c"))
    cited = cited.select(key, "symbol", "pos", F.coalesce(_at(F.col("c"), "$.source_id", "string"), _at(F.col("c"), "$", "string")).alias("source_id"))
    known = cited.join(catalog.select("symbol", "source_id"), ["symbol", "source_id"], "left_semi")
    lists = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_id"))), lambda s: s.source_id).alias("found"))
    x = m.join(lists, key, "left")
    stance = F.lower(F.coalesce(_at(F.col("v"), "$.stance", "string"), F.lit("neutral")))
    checks = reasons(("invalid stance", stance.isin(*STANCES)), ("directional memo has no verified citation", (stance == "neutral") | F.col("found").isNotNull()))
    bad = _unusable(F.col("v"), "$.confidence") | _unusable(F.col("v"), "$.horizon_days")
    errors = F.when(F.col("v").isNull(), F.array(F.lit("memo missing"))).when(bad, F.array(F.lit("invalid confidence or horizon"))).otherwise(checks)
    x = x.withColumn("errors", errors)
    good = F.size("errors") == 0
    out = {
        "stance": stance,
        "confidence": clamp(F.coalesce(_at(F.col("v"), "$.confidence", "double"), F.lit(0.0)), 0.0, 1.0),
        "horizon_days": _within(F.coalesce(_at(F.col("v"), "$.horizon_days", "double"), F.lit(21.0)), *MEMO_DAYS),
        "citations": F.coalesce("found", F.array().cast("array<string>")),
    }
    return x.select(*[c for c in raw.columns if c != "raw"], "errors", *(F.when(good, c).alias(n) for n, c in out.items()))


def validate_stances(raw: DataFrame, universe: DataFrame, key: str = "id") -> DataFrame:
    """Hypotheses (``key, tier, raw``) with ``stances`` and ``watchlist``. The first 12 stances
    count, of these the ones with a ticker, a known direction and numbers, clamped; the watch
    list has the first 8 tickers that ``universe`` (``symbol``) lacks. A north star has neither.
    Texts without a thesis are no hypotheses and have no row."""
    h = _parsed(raw).where(F.coalesce(F.trim(_at(F.col("v"), "$.thesis", "string")), F.lit("")) != "")
    north = F.coalesce(F.col("tier") == "north_star", F.lit(False))
    none = F.array().cast("array<variant>")
    made = F.transform(
        F.slice(F.coalesce(_at(F.col("v"), "$.stances", "array<variant>"), none), 1, MAX_STANCES),
        lambda s: F.struct(
            _symbol(_at(s, "$.symbol", "string")).alias("symbol"),
            _at(s, "$.direction", "string").alias("direction"),
            clamp(_at(s, "$.conviction", "double"), 0.0, 1.0).alias("conviction"),
            _within(_at(s, "$.horizon_days", "double"), *STANCE_DAYS).alias("horizon_days"),
            (_at(s, "$.conviction", "double").isNotNull() & _at(s, "$.horizon_days", "double").isNotNull()).alias("whole"),
        ),
    )
    kept = F.transform(F.filter(made, lambda s: s.whole & s.symbol.rlike(TICKER) & s.direction.isin(*DIRECTIONS)), lambda s: s.dropFields("whole"))
    watch = h.where(~north).select(key, F.posexplode(_at(F.col("v"), "$.watchlist", "array<variant>")).alias("pos", "w")).select(key, "pos", _symbol(_at(F.col("w"), "$", "string")).alias("symbol"))
    watch = watch.where(F.col("symbol").rlike(TICKER)).join(universe.select("symbol"), "symbol", "left_anti").groupBy(key, "symbol").agg(F.min("pos").alias("pos"))
    lists = watch.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda s: s.symbol), 1, MAX_WATCHLIST).alias("watchlist"))
    # The texts end here: what is sorted for the join is a few stances a row.
    kept = F.when(north, F.slice(kept, 1, 0)).otherwise(kept)
    slim = h.select(*[c for c in raw.columns if c != "raw"], kept.alias("stances"))
    return slim.join(lists, key, "left").withColumn("watchlist", F.coalesce("watchlist", F.array().cast("array<string>")))


def validate_mandates(raw: DataFrame, instruments: DataFrame, key: str = "id") -> DataFrame:
    """Mandates (``key, created_at, raw``) with ``confidence``, ``horizon_days``, ``expires_at``,
    ``themes`` (20 different texts of favored themes), ``favored`` and ``tilts`` (25 each).

    Symbols count if ``instruments`` has them. An expiry that is missing, no time or not after
    ``created_at`` becomes 30 days. Texts without a thesis have no row."""
    m = _parsed(raw).where(F.coalesce(F.trim(_at(F.col("v"), "$.thesis", "string")), F.lit("")) != "")
    none = F.array().cast("array<variant>")

    def items(path: str) -> Column:
        return F.coalesce(_at(F.col("v"), path, "array<variant>"), none)

    confidence = clamp(F.coalesce(_at(F.col("v"), "$.confidence", "double"), F.lit(0.0)), 0.0, 1.0)
    m = m.withColumn("confidence", confidence)
    named = m.select(key, F.posexplode(items("$.favored_symbols")).alias("pos", "s")).select(key, "pos", F.lit("favored").alias("part"), _symbol(F.coalesce(_at(F.col("s"), "$.symbol", "string"), _at(F.col("s"), "$", "string"))).alias("symbol"), F.lit("favor").alias("direction"), F.lit(None).cast("double").alias("confidence"))
    tilts = m.select(key, "confidence", F.posexplode(items("$.portfolio_tilts")).alias("pos", "s")).select(
        key, "pos", F.lit("tilts").alias("part"), _symbol(_at(F.col("s"), "$.symbol", "string")).alias("symbol"), F.lower(_at(F.col("s"), "$.direction", "string")).alias("direction"),
        clamp(F.coalesce(_at(F.col("s"), "$.confidence", "double"), F.col("confidence")), 0.0, 1.0).alias("confidence"),
    )
    rows = named.unionByName(tilts).where(F.col("direction").isin(*TILTS)).join(instruments.select("symbol"), "symbol", "left_semi")
    # A favored symbol counts once, tilts as they stand.
    rows = rows.groupBy(key, "part", "symbol", F.when(F.col("part") == "tilts", F.col("pos")).alias("each")).agg(F.min(F.struct("pos", "symbol", "direction", "confidence")).alias("r"))
    one = F.array_sort(F.collect_list(F.when(F.col("part") == "favored", F.col("r"))))
    two = F.array_sort(F.collect_list(F.when(F.col("part") == "tilts", F.col("r"))))
    lists = rows.groupBy(key).agg(F.slice(F.transform(one, lambda r: r.symbol), 1, MAX_SYMBOLS).alias("favored"), F.slice(F.transform(two, lambda r: r.dropFields("pos")), 1, MAX_SYMBOLS).alias("tilts"))
    stated = F.try_to_timestamp(_at(F.col("v"), "$.expiry", "string"))
    expiry = F.when(stated > F.col("created_at"), stated).otherwise(F.col("created_at") + F.make_dt_interval(days=F.lit(EXPIRY_DAYS)))
    themes = F.array_distinct(F.filter(F.transform(items("$.favored_themes"), lambda t: F.trim(F.coalesce(_at(t, "$.text", "string"), _at(t, "$", "string")))), lambda t: t != ""))
    return m.join(lists, key, "left").select(
        *[c for c in raw.columns if c != "raw"], "confidence", _within(F.coalesce(_at(F.col("v"), "$.horizon_days", "double"), F.lit(21.0)), *MANDATE_DAYS).alias("horizon_days"),
        expiry.alias("expires_at"), F.slice(themes, 1, MAX_STRINGS).alias("themes"), F.coalesce("favored", F.array().cast("array<string>")).alias("favored"), "tilts",
    )


def validate_views(raw: DataFrame) -> DataFrame:
    """Views with ``direction, conviction, horizon_days, red_flags``: an object, a known
    direction, a conviction that is a number of 0.3 or more after clamping. Others, and neutral views, have no row."""
    v = F.col("v")
    x = _parsed(raw).where(_at(v, "$.direction", "string").isin(*VIEWS) & _at(v, "$.conviction", "double").isNotNull() & ~_unusable(v, "$.horizon_days"))
    flags = F.transform(F.slice(F.coalesce(_at(v, "$.red_flags", "array<variant>"), F.array().cast("array<variant>")), 1, MAX_FLAGS), lambda f: F.substring(_at(f, "$", "string"), 1, REASON_CHARS))
    x = x.select(
        *[c for c in raw.columns if c != "raw"], _at(v, "$.direction", "string").alias("direction"), clamp(_at(v, "$.conviction", "double"), 0.0, 1.0).alias("conviction"),
        _within(F.coalesce(_at(v, "$.horizon_days", "double"), F.lit(40.0)), *VIEW_DAYS).alias("horizon_days"), flags.alias("red_flags"),
    )
    return x.where((F.col("direction") != "neutral") & (F.col("conviction") >= MIN_CONVICTION))


def veto_reason(given: Column) -> Column:
    """The first of the reasons up to a bracket or colon, trimmed, 60 characters at most; null
    without a reason."""
    return F.substring(F.trim(F.regexp_extract(F.get(given, F.lit(0)), r"^[^(:]*", 0)), 1, REASON_CHARS)


def hypothesis_stances(hypotheses: DataFrame, decisions: DataFrame, prices: DataFrame) -> DataFrame:
    """Signals of the hypothesis that is active at each whole hour of ``decisions``
    (``as_of``): one for each stance with a conviction and a price known by then.

    ``hypotheses``: ``activated_at, id, stances``; the last activated one is active, of several
    the one with the largest id. They are reduced to one an hour first, so the sorted stream
    has an hour's row, not a hypothesis's. ``prices``: ``symbol, d, close, atr_pct`` (null: 0.02)."""
    hour = F.timestamp_seconds(F.ceil(F.col("activated_at").cast("double") / 3600) * 3600)
    h = hypotheses.groupBy(hour.alias("as_of")).agg(F.max_by(F.struct("id", "stances"), F.struct("activated_at", "id")).alias("h")).select("as_of", "h.*", F.lit(0).alias("line"))
    at = decisions.select("as_of").distinct().withColumn("line", F.lit(0))
    s = latest_at(at, h, ["id", "stances"], ["line"], "as_of").select("as_of", "id", F.explode("stances").alias("s")).select("as_of", "id", "s.*", F.to_date("as_of").alias("d"))
    s = latest_at(s, prices, ["close", "atr_pct"], ["symbol"], "d").where("close is not null and conviction > 0")
    vol = F.coalesce("atr_pct", F.lit(0.02)) * F.sqrt("horizon_days")
    sign = F.when(F.col("direction") == "long", 1).otherwise(-1)
    return s.select("as_of", "symbol", "id", "direction", F.col("conviction").alias("score"), "horizon_days", (sign * F.col("conviction") * vol * 0.5).alias("expected_return"), vol.alias("expected_volatility"))
