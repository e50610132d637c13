"""Queries of the node registry and of the fusion of all families."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import families, fusion, nodes, signals
from marketloom.operators.joins import latest_at
from marketloom.plans.signals import BR, REGIME, RISKY, SAFE, SIGNALS
from marketloom.registry import register
from marketloom.sources import fixtures as fx

#: A human has switched these off.
OFF = ("congress_trades", "news_sentiment", "hypothesis")
REGISTRY = nodes.Registry()
#: What an issuer is known for on a day: its last closed month's volume and sessions.
_KEY = ("as_of", "symbol")


def _vote(value: str, confidence: str, horizon: int, gain: str, valid: int, seen: str = "true"):
    """A node that reads one column of the panel: a signal where it is not 0, seen while valid."""

    def compute(panel):
        x = panel.where(f"v is not null and datediff(as_of, at) < {valid} and {seen}").withColumn("x", F.expr(value))
        hit = x.where("x <> 0").select(
            *_KEY, F.when(F.col("x") > 0, "long").otherwise("avoid").alias("direction"), F.abs("x").alias("score"), F.expr(confidence).alias("confidence"),
            F.lit(horizon).alias("horizon_days"), F.expr(gain).alias("expected_return"),
        )
        return hit, x.select(*_KEY)

    return compute


#: node: value, confidence, horizon, expected return, days it is valid, where it has data.
VOTES = {
    "business_fundamentals": ("(v % 21 - 10) / 10", "greatest(0.1, (v % 7 + 1) / 8)", 60, "x * 0.35", 90, "true"),
    "company_catalyst": ("(v % 13 - 6) / 6", "0.6", 14, "x * 0.3", 31, "v % 4 > 0"),
    "earnings_drift": ("(n % 5 - 2) / 2", "0.5", 20, "x * 0.1", 45, "v % 3 = 0"),
    "insider": ("0.5", "0.4", 40, "x * 0.3", 14, "v % 11 = 0"),
    "quality_value": ("(v % 17 - 8) / 8", "0.7", 40, "x * 0.1", 200, "n > 1"),
}
for _name, _spec in VOTES.items():
    REGISTRY.node(_name)(_vote(*_spec))


def _world(spark, d):
    """Grid with regimes, the panel of what was known, price signals, multipliers."""
    bars, brands = fx.types_and_brands(spark, d)
    regime = fusion.regimes(bars, brands, RISKY, SAFE).select(F.col("d").alias("as_of"), "regime")
    rows = bars.where(F.col("symbol") != fx.BENCHMARK).select(F.col("d").alias("as_of"), "symbol", (F.col("symbol") == "PROMO").alias("is_fund"))
    grid = fx.stored(rows.join(F.broadcast(regime), "as_of", "left"), "family-grid")  # a row a session
    months = bars.where(F.col("symbol") != fx.BENCHMARK).groupBy("symbol", F.add_months(F.trunc("d", "month"), 1).alias("at")).agg(F.sum("volume").cast("long").alias("v"), F.count(F.lit(1)).alias("n"))
    known = latest_at(grid.select("as_of", "symbol", F.col("as_of").alias("when")), months.select("symbol", F.col("at").alias("when"), "at", "v", "n"), ["at", "v", "n"], ["symbol"], "when")
    names = [n for nodes_ in families.PRIORS.values() for n in nodes_]
    pick = F.array(*map(F.lit, names))[F.col("n_nationkey") % len(names)]
    regime_of = F.array(F.lit(None).cast("string"), *map(F.lit, ("risk_on", "neutral", "risk_off")))[F.col("n_nationkey") % 4]
    multipliers = fx.table(spark, d, "nation").select(pick.alias("node_id"), regime_of.alias("regime"), (0.1 + F.col("n_nationkey") / 12).alias("multiplier"))
    return bars, grid, known, multipliers


def _evaluated(spark, d):
    bars, grid, known, multipliers = _world(spark, d)
    priced = signals.price_signals(bars).where(F.col("symbol") != fx.BENCHMARK)
    panel = known.drop("when")
    registry = nodes.Registry()
    for node in REGISTRY.current():
        registry.node(node.name, node.version)(node.compute)
    enough = bars.where(F.col("symbol") != fx.BENCHMARK).select(F.col("d").alias("as_of"), "symbol", F.row_number().over(fusion.ind.by_date()).alias("k")).where("k >= 260")
    for name in ("momentum", "reversal", "gap", "vol_contraction", "sector_rotation"):
        registry.node(name)(lambda _, name=name: (priced.where(F.col("node_id") == name), enough))
    registry.node("congress_trades")(lambda p: p)
    return registry.run(panel, OFF), grid, multipliers


VALUES = [f"{f}_value" for f in families.COMPANY]
SHOWN = [*VALUES, "raw", "conflict", "production", "coverage", "gross", "net", "final"]


def _fused(spark, d):
    done, grid, multipliers = _evaluated(spark, d)
    return rounded(families.fuse(done, grid, multipliers, OFF), *SHOWN, digits=8)


def _num(x: float) -> str:
    return f"{x!r}::DOUBLE"


_SHARE = families.priors(OFF)
_NAMES = [n for g in families.PRIORS.values() for n in g]
_VOTE_SQL = " UNION ALL ".join(
    f"SELECT as_of, symbol, '{name}' AS node_id, x, {c.replace('v %', 'v::DOUBLE %')} AS confidence, {h} AS horizon_days, {g} AS er FROM (SELECT *, {x} AS x FROM known WHERE v IS NOT NULL AND datediff('day', since, as_of) < {valid} AND {seen})"
    for name, (x, c, h, g, valid, seen) in VOTES.items()
)
PRIOR_SQL = " ".join(f"WHEN '{n}' THEN {_num(p)}" for g in _SHARE.values() for n, p in g.items())
FAMILY_SQL = " ".join(f"WHEN '{n}' THEN '{f}'" for f, g in _SHARE.items() for n in g)
FLOOR_SQL = f"CASE WHEN node_id IN ({', '.join(repr(n) for n in families.EXPERIMENTAL)}) THEN 0.25 ELSE 0.5 END"
_W = {f: f"(CASE WHEN is_fund THEN {_num(families.FUND.get(f, 0.0))} ELSE {_num(w)} END)" for f, w in families.COMPANY.items()}


def _weighted(kind: str) -> str:
    return " + ".join(f"{_W[f]} * coalesce({f}_{kind}, 0)" for f in families.COMPANY)


FAMILIES = f"""{SIGNALS}, {BR}, {REGIME},
grid AS (SELECT b.d AS as_of, b.symbol, b.symbol = 'PROMO' AS is_fund, regime, row_number() OVER (PARTITION BY b.symbol ORDER BY b.d) AS k FROM bars b LEFT JOIN rg ON rg.d = b.d WHERE b.symbol <> 'ALL'),
months AS (SELECT symbol, (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE AS since, sum(volume)::BIGINT AS v, count(*) AS n FROM bars WHERE symbol <> 'ALL' GROUP BY 1, 2),
known AS (SELECT g.as_of, g.symbol, since, v, n FROM grid g ASOF LEFT JOIN months m ON g.symbol = m.symbol AND g.as_of >= m.since),
votes AS ({_VOTE_SQL}),
mult AS (SELECT [{', '.join(repr(n) for n in _NAMES)}][n_nationkey % {len(_NAMES)} + 1] AS node_id, [NULL, 'risk_on', 'neutral', 'risk_off'][n_nationkey % 4 + 1] AS regime, 0.1 + n_nationkey / 12 AS m FROM nation),
evs AS (SELECT as_of, symbol, node_id, CASE WHEN x > 0 THEN 1 ELSE -1 END AS sg, abs(x) AS score, confidence, horizon_days, er FROM votes WHERE x <> 0
  UNION ALL SELECT d, symbol, node_id, CASE WHEN direction = 'long' THEN 1 ELSE -1 END, abs(score), confidence, h, er FROM raw WHERE symbol <> 'ALL'
  UNION ALL SELECT as_of, symbol, 'macro_regime', CASE WHEN regime IN ('risk_on', 'neutral') THEN 1 ELSE -1 END, CASE regime WHEN 'risk_on' THEN 0.65 WHEN 'neutral' THEN 0.1 WHEN 'risk_off' THEN 0.5 ELSE 1.0 END, 1.0, 21, 0.0 FROM grid WHERE regime IS NOT NULL),
wt AS (SELECT e.*, CASE e.node_id {FAMILY_SQL} END AS fam, (CASE e.node_id {PRIOR_SQL} END) * greatest({FLOOR_SQL.replace('node_id', 'e.node_id')}, least(1.5, coalesce(a.m, b.m, 1.0))) AS w
  FROM evs e LEFT JOIN rg ON rg.d = e.as_of LEFT JOIN mult a ON a.node_id = e.node_id AND a.regime = rg.regime LEFT JOIN mult b ON b.node_id = e.node_id AND b.regime IS NULL),
al AS (SELECT *, sg * score * confidence * w AS p FROM wt WHERE fam IS NOT NULL),
fs AS (SELECT as_of, symbol, {', '.join(f"sum(p) FILTER (WHERE fam = '{f}') AS {f}_value, sum(greatest(p, 0)) FILTER (WHERE fam = '{f}') AS {f}_up, sum(greatest(-p, 0)) FILTER (WHERE fam = '{f}') AS {f}_down, sum(sg * abs(er) * w * confidence) FILTER (WHERE fam = '{f}') AS {f}_gain, sum(w * confidence) FILTER (WHERE fam = '{f}') AS {f}_mass" for f in families.COMPANY)},
  avg(horizon_days) FILTER (WHERE sg > 0 AND node_id <> 'macro_regime') AS hz FROM al GROUP BY 1, 2),
av AS (SELECT as_of, symbol, node_id FROM votes UNION SELECT as_of, symbol, node_id FROM evs UNION SELECT as_of, symbol, unnest(['momentum', 'reversal', 'gap', 'vol_contraction', 'sector_rotation']) FROM grid WHERE k >= 260),
cv AS (SELECT as_of, symbol, {', '.join(f"least(1, sum(CASE WHEN CASE node_id {FAMILY_SQL} END = '{f}' THEN CASE node_id {PRIOR_SQL} END ELSE 0 END)) AS {f}_cov" for f in families.COMPANY)} FROM av GROUP BY 1, 2),
t1 AS (SELECT g.*, {', '.join(f'CASE WHEN {_W[f]} > 0 THEN {f}_value END AS {f}_value' for f in families.COMPANY)}, {_weighted('value')} AS raw, {_weighted('up')} AS up, {_weighted('down')} AS dn, {_weighted('gain')} AS gn, {_weighted('mass')} AS ms, {_weighted('cov')} AS coverage, hz
  FROM grid g LEFT JOIN fs USING (as_of, symbol) LEFT JOIN cv USING (as_of, symbol)),
t2 AS (SELECT *, 1 - 0.5 * CASE WHEN up + dn > 0 THEN 2 * least(up, dn) / (up + dn) ELSE 0 END AS conflict, CASE WHEN ms > 0 THEN gn / ms ELSE 0 END AS gross FROM t1),
t3 AS (SELECT *, CASE WHEN raw > 0 THEN raw * conflict ELSE raw END AS production, gross - 0.0016 AS net FROM t2),
t4 AS (SELECT *, CASE WHEN raw > 0 AND hz IS NOT NULL THEN production - 0.0016 / greatest(abs(gross), 0.005) * 0.01 END AS final FROM t3)"""
register("e2_families", _fused, f"WITH {FAMILIES} SELECT as_of, symbol, {', '.join(f'round({c}, 8) AS {c}' for c in SHOWN)}, round(hz)::INT AS horizon_days FROM t4")


def _states(spark, d):
    """The registry with a node that fails: how many (as_of, symbol) are in which state, by node."""
    done, grid, _ = _evaluated(spark, d)
    done.node_states["options_vol"] = "blocked"
    return nodes.node_grid(done, grid).groupBy("node_id", "state").agg(F.count(F.lit(1)).alias("n"))


_PRICE = "('momentum', 'reversal', 'gap', 'vol_contraction', 'sector_rotation')"
register(
    "u1_node_states",
    _states,
    f"""WITH {FAMILIES}, nd AS (SELECT unnest([{', '.join(repr(n) for n in [*VOTES, 'momentum', 'reversal', 'gap', 'vol_contraction', 'sector_rotation', 'congress_trades', 'options_vol'])}]) AS node_id),
s1 AS (SELECT DISTINCT as_of, symbol, node_id FROM evs), s2 AS (SELECT DISTINCT as_of, symbol, node_id FROM av)
SELECT nd.node_id, CASE WHEN nd.node_id = 'congress_trades' THEN 'human_disabled' WHEN nd.node_id = 'options_vol' THEN 'blocked' WHEN s1.node_id IS NOT NULL THEN 'running' WHEN s2.node_id IS NOT NULL THEN 'verified_neutral' ELSE 'unavailable' END AS state, count(*) AS n
FROM grid CROSS JOIN nd LEFT JOIN s1 ON s1.as_of = grid.as_of AND s1.symbol = grid.symbol AND s1.node_id = nd.node_id LEFT JOIN s2 ON s2.as_of = grid.as_of AND s2.symbol = grid.symbol AND s2.node_id = nd.node_id GROUP BY 1, 2""",
)
