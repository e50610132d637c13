"""Token counts under a unigram model, by dynamic programming shared over a trie.

The pre-tokens of a slice of documents that the task has not met yet are made distinct and sorted, which lays out their
trie level by level: a node is a distinct prefix. One forward pass goes down the levels for
all nodes of a level at once. A node keeps the best score of any segmentation of its prefix,
and the vocabulary pieces still open there, each with the level at which it began; children
inherit those, so what pre-tokens share is scored once. At the nodes where pre-tokens end
the number of tokens of the best segmentation is stored, and documents add those numbers up.

The vocabulary is a public one, read as it is. A piece's score is that of Zipf's law for its
rank, in whole thousandths of a nat, so that sums are exact; of equal scores the
segmentation with fewer tokens wins.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textbatch as tb
from marketloom.llm.scratch import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of the rank files that splits text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A score is kept above the number of tokens: score * 2**TOKEN_BITS - tokens.
TOKEN_BITS = 24
#: Where so few prefixes are left, or beyond so many bytes, each word goes on by itself.
FEW, DEEP = 4, 1 << 20
#: Bytes of pre-tokens whose counts a task keeps.
KNOWN_BYTES = 32 << 20


class Vocabulary:
    """Pieces as a trie in arrays: sorted (state, byte) keys, next states, terminal scores."""

    def __init__(self, pieces: list[bytes]):
        total = sum(1.0 / k for k in range(1, len(pieces) + 1))
        score = {p: int(round(-1000 * np.log((k + 1) * total))) for k, p in enumerate(pieces)}
        states, keys = {b"": 0}, {}
        for p in sorted(score):
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    keys[states[p[: k - 1]] << 8 | p[k - 1]] = states[p[:k]]
        self.keys = np.array(sorted(keys), np.int64)
        self.next = np.array([keys[k] for k in self.keys.tolist()], np.int64)
        self.gain = np.full(len(states), np.iinfo(np.int64).min)
        for p, s in score.items():
            self.gain[states[p]] = (s << TOKEN_BITS) - 1
        missing = [b for b in range(256) if bytes([b]) not in score]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.scores = score
        self._links: dict[int, int] | None = None

    def tail(self, word: bytes, at: int, pieces: list[tuple[int, int, int]]) -> int:
        """Tokens of a word whose pieces open at byte ``at`` are (score, -tokens, state) where
        they began. One word alone, in plain numbers of any size."""
        if self._links is None:
            self._links = dict(zip(self.keys.tolist(), self.next.tolist(), strict=True))
            self._gain = {k: (g + 1) >> TOKEN_BITS for k, g in enumerate(self.gain.tolist()) if g > np.iinfo(np.int64).min}
        links, gain, best = self._links, self._gain, (0, 0)
        for byte in word[at:]:
            best, open_ = None, []
            for score, less, state in pieces:
                to = links.get(state << 8 | byte)
                if to is None:
                    continue
                open_.append((score, less, to))
                if to in gain and (best is None or (score + gain[to], less - 1) > best):
                    best = (score + gain[to], less - 1)
            pieces = [*open_, (*best, 0)]
        return -best[1]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states, or -1."""
        k = state << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.next[at], -1)


def load(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return sorted(ranks, key=ranks.__getitem__)


def count_tokens(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of the best segmentation of each of the sorted, distinct, non-empty words."""
    size = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(size) - size
    out = np.zeros(len(words), np.int64)
    alive = np.arange(len(words))
    parent = np.zeros(len(words), np.int64)
    # Open pieces, sorted by node: node, best value where the piece began, state.
    node, base, state = (np.zeros(1, np.int64) for _ in range(3))
    level = 0
    while len(alive):
        byte = data[begin[alive] + level].astype(np.int64)
        new = np.ones(len(alive), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (byte[1:] != byte[:-1])
        own = np.cumsum(new) - 1
        up, b = parent[new], byte[new]
        # Every child continues the pieces that are open at its parent.
        lo, hi = np.searchsorted(node, up, side="left"), np.searchsorted(node, up, side="right")
        many = hi - lo
        child = np.repeat(np.arange(len(up)), many)
        take = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        went = vocabulary.step(state[take], b[child])
        ok = went >= 0
        child, went, from_ = child[ok], went[ok], base[take[ok]]
        ends = vocabulary.gain[went] > np.iinfo(np.int64).min
        best = np.full(len(up), np.iinfo(np.int64).min)
        np.maximum.at(best, child[ends], from_[ends] + vocabulary.gain[went[ends]])
        level += 1
        done = size[alive] == level
        out[alive[done]] = (-best[own[done]]) & ((1 << TOKEN_BITS) - 1)
        alive, parent = alive[~done], own[~done]
        # Open pieces of the next level: those that went on, and one that begins at each node.
        node = np.concatenate((child, np.arange(len(up))))
        base = np.concatenate((from_, best))
        state = np.concatenate((went, np.zeros(len(up), np.int64)))
        order = np.argsort(node, kind="stable")
        node, base, state = node[order], base[order], state[order]
        if len(alive) <= FEW or level >= DEEP:
            for k, p in zip(alive.tolist(), parent.tolist(), strict=True):
                lo, hi = np.searchsorted(node, p, side="left"), np.searchsorted(node, p, side="right")
                less = (-base[lo:hi]) & ((1 << TOKEN_BITS) - 1)
                out[k] = vocabulary.tail(words[k], level, list(zip(((base[lo:hi] + less) >> TOKEN_BITS).tolist(), (-less).tolist(), state[lo:hi].tolist(), strict=True)))
            break
    return out


ADDED = ["n_pretokens", "n_tokens"]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``carry`` of them) with ``n_pretokens`` and ``n_tokens``.

    * A null or empty text has 0 of both. A pre-token of any length is counted whole.
    * Rows are counted alone; repeated rows agree. Columns named like an added one give way.
      An empty table stays empty. A very long text is a slice of its own.
    """
    pieces = Vocabulary(load(vocabulary))  # on the driver; a file of fixed size
    keep = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in ADDED]
    hide = tb.free("__text_in", keep)
    frame = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(hide))
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, vocab = regex.compile(PATTERN).findall, sent.value
        known: dict[str, int] = {}
        held = 0
        for whole in batches:
            for batch in tb.slices(whole, hide):
                ids: dict[str, int] = {}
                docs_ids = [np.array([ids.setdefault(w, len(ids)) for w in split(t)], np.int64) for t in batch.column(hide).to_pylist()]
                fresh = sorted((w.encode(), w) for w in ids if w not in known)
                for (_, w), n in zip(fresh, count_tokens([b for b, _ in fresh], vocab).tolist(), strict=True):
                    known[w] = n
                counts = np.array([known[w] for w in ids], np.int64)
                held += sum(len(b) for b, _ in fresh)
                if held > KNOWN_BYTES:
                    known, held = {}, 0
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array([len(x) for x in docs_ids], pa.int64()), pa.array([int(counts[x].sum()) for x in docs_ids], pa.int64())],
                    [*keep, *ADDED],
                )

    return frame.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_counts`` over all documents."""
    return token_counts(table(spark, sf_dir, "documents"), carry=["doc_id"])
