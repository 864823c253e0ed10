"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie one after another in one array of byte symbols. In each step every
sequence merges all places of its own lowest-rank pair at once; a sequence without a pair that
the vocabulary merges is done, and its surviving symbols are counted.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPECIAL, CachedEncoder, byte_alphabet, vocabulary_path
from .common import ready, text_or_empty

_NONE = np.iinfo(np.int32).max


class RankMerger:
    """Counts symbols of pre-tokens under the merges of a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = 1 << 16
        keys = np.fromiter((ids[a] * self.width + ids[b] for a, b in pairs), np.int64, len(pairs))
        made = np.fromiter((ids[a + b] for a, b in pairs), np.int32, len(pairs))
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        self.byte = np.array([ids[c] for c in byte_alphabet()], np.int32)

    def _places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), at

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Number of surviving symbols of each token (0 for an empty one)."""
        out = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), out)
        rank, at = self._ranked(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(starts, append=len(owner))
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest != _NONE
            out[owner[starts[~live]]] = sizes[~live]
            hit = (rank == np.repeat(lowest, sizes)) & (rank != _NONE)
            # of a run of overlapping places every other one merges, from the left
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit, -1, place))
            hit &= (place - run) % 2 == 1
            symbols = np.where(hit, self.made[at], symbols)
            keep = np.repeat(live, sizes)
            keep[1:] &= ~hit[:-1]
            changed = hit.copy()
            changed[:-1] |= hit[1:]  # the pair on the left of a merged one is new as well
            changed[:-2] |= hit[2:]
            symbols, owner, rank, at, changed = symbols[keep], owner[keep], rank[keep], at[keep], changed[keep]
            again = np.flatnonzero(changed)
            if len(again):
                rank[again], at[again] = self._ranked(symbols, owner, again)
        return out

    def _ranked(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and table row of the pairs that start at ``at``, or everywhere."""
        i = np.arange(len(symbols)) if at is None else at
        j = np.minimum(i + 1, len(symbols) - 1)
        rank, row = self._places(symbols[i], symbols[j])
        rank[(owner[i] != owner[j]) | (i == j)] = _NONE
        return rank, row


@functools.lru_cache(maxsize=1)
def counter(path: str, limit: int = 1_000_000) -> CachedEncoder:
    """Counts by :class:`RankMerger` behind the piece cache; its ids mean nothing. A special
    token's string in a text is one token, as the library has it by default."""
    merger = RankMerger(path)

    def pretokens(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = merger.counts([k.encode() for k in keys])
        return np.zeros(int(lengths.sum()), np.uint32), lengths

    def text(t: str) -> np.ndarray:
        parts = t.split(SPECIAL)
        tokens = [w.encode() for p in parts for w in made.split(p)]
        return np.zeros(len(parts) - 1 + int(merger.counts(tokens).sum()) if tokens else len(parts) - 1, np.uint32)

    made = CachedEncoder(pretokens, text, limit)
    return made


def count_tokens(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) for every row.

    Null and empty texts have 0 tokens; null ids and repeated rows are kept as they are; an empty
    table gives an empty one; other columns play no part. Map-only: no shuffle.
    """
    ready(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def run(batches):
        count = counter(path)
        for b in batches:
            n = count.encode(b.column(2).to_pylist())[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
