"""A registry of signal nodes: named, versioned functions that fail alone.

A node is a function of the panel. It is called, and its plan analysed, when the plan of all is
built; one that raises, or returns other columns than a signal has, is ``blocked`` with its error
while the others stand. A node is switched off only by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNAL = {"as_of": "date", "symbol": "string", "node_id": "string", "direction": "string", "score": "double", "confidence": "double", "horizon_days": "int", "expected_return": "double"}
ROLES = ("alpha", "filter", "gate", "overlay")
#: States in which a node counts as looked at.
AVAILABLE = ("running", "verified_neutral", "deemphasized")


@dataclass(frozen=True)
class Node:
    """``compute(panel)`` gives signals, or signals and ``seen``: the (as_of, symbol) it had data
    for, where no signal means neutral. A filter gives (as_of, symbol, passes)."""

    name: str
    version: str
    role: str
    compute: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]]


@dataclass
class Evaluated:
    """What came out: signals of all alpha nodes, (as_of, symbol, node_id) looked at, results of
    the other roles by name, the state of whole nodes, and errors."""

    signals: DataFrame | None
    seen: DataFrame | None
    others: dict[str, DataFrame] = field(default_factory=dict)
    node_states: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    versions: dict[str, str] = field(default_factory=dict)


class Registry:
    """Nodes by name; a name stands once for each version, the last added is the current one."""

    def __init__(self) -> None:
        self._nodes: dict[str, dict[str, Node]] = {}

    def node(self, name: str, version: str = "1", role: str = "alpha"):
        """Decorator: add the function as a node."""

        def add(compute):
            if role not in ROLES:
                raise ValueError(f"no role {role}")
            versions = self._nodes.setdefault(name, {})
            if version in versions:
                raise ValueError(f"node {name} {version} is there already")
            versions[version] = Node(name, version, role, compute)
            return compute

        return add

    def current(self, pinned: Mapping[str, str] | None = None) -> list[Node]:
        """The nodes, in order of name, in their newest or a pinned version."""
        return [v[(pinned or {}).get(name, list(v)[-1])] for name, v in sorted(self._nodes.items())]

    def run(self, panel: DataFrame, disabled: tuple[str, ...] = (), pinned: Mapping[str, str] | None = None) -> Evaluated:
        """All enabled nodes over ``panel``."""
        out = Evaluated(None, None)
        signals, seen = [], []
        for name, versions in sorted(self._nodes.items()):
            if name in disabled:
                out.node_states[name] = "human_disabled"
                continue
            try:
                node = versions[(pinned or {}).get(name, list(versions)[-1])]
                made = node.compute(panel)
                mine, looked = made if isinstance(made, tuple) else (made, None)
                if node.role == "alpha":
                    mine = mine.select(*(F.col(c).cast(t) for c, t in SIGNAL.items() if c != "node_id"), F.lit(name).alias("node_id"))
                else:
                    mine = mine.select("as_of", "symbol", *[c for c in mine.columns if c not in ("as_of", "symbol")])
                mine.schema  # noqa: B018 - analysis happens here
                if looked is not None:
                    looked = looked.select(F.col("as_of").cast("date").alias("as_of"), F.col("symbol").cast("string").alias("symbol"), F.lit(name).alias("node_id"))
                    looked.schema  # noqa: B018
            except Exception as e:  # noqa: BLE001 - whatever a node does wrong is its own affair
                out.node_states[name], out.errors[name] = "blocked", f"{type(e).__name__}: {e}"[:500]
                continue
            out.versions[name] = node.version
            if node.role != "alpha":
                out.others[name] = mine
                continue
            out.node_states[name] = "unavailable" if looked is not None else "verified_neutral"
            signals.append(mine)
            if looked is not None:
                seen.append(looked)
        out.signals = reduce(DataFrame.unionByName, signals) if signals else None
        out.seen = reduce(DataFrame.unionByName, seen) if seen else None
        return out


def node_grid(done: Evaluated, grid: DataFrame) -> DataFrame:
    """The state of every node for every (as_of, symbol) of ``grid``: running with a signal, else
    what the whole node says if it is blocked or off, else verified_neutral where it was looked
    at. The nodes are few; the grid is multiplied by their number."""
    names = F.array(*(F.lit(n) for n in sorted(done.node_states)))
    base = grid.select("as_of", "symbol", F.explode(names).alias("node_id"))
    key = ["as_of", "symbol", "node_id"]
    marks = [base.withColumn("rank", F.lit(0))]
    if done.seen is not None:
        marks.append(done.seen.select(*key, F.lit(1).alias("rank")))
    if done.signals is not None:
        marks.append(done.signals.select(*key, F.lit(2).alias("rank")))
    best = reduce(DataFrame.unionByName, marks).groupBy(*key).agg(F.max("rank").alias("rank"), F.min("rank").alias("low")).where("low = 0")
    whole = F.create_map(*[F.lit(x) for kv in sorted(done.node_states.items()) for x in kv])[F.col("node_id")]
    return best.select(*key, F.when(F.col("rank") == 2, "running").when(F.col("rank") == 1, "verified_neutral").otherwise(whole).alias("state"))
