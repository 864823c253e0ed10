"""Best-fit packing of token pieces into sequences by a configuration linear program.

The program has a column for each pattern of lengths that fits a sequence and a row for each
length. It starts from the patterns of best fit and from prices by volume; a knapsack by dynamic
programming tells how far the prices are from a lower bound that holds, and adds the best patterns;
multiplicative weights move the prices of lengths that are held too rarely and the times of patterns
that are worth more than a sequence, and the times of the rounds are averaged. It ends when the times
are within ``gap`` of the bound. They are rounded down, and what is left is placed by best fit.
All counts are by length, so the plan's cost depends on the sequence length and not on the
number of pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import cut, ready, text_or_empty

Plan = list[tuple[list[int], int]]


def _knapsack(prices: np.ndarray, lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity up to ``room`` with lengths used any number of times, and the length used."""
    best, used = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(room + 1), side="right")
    for c in range(int(lengths[0]), room + 1):
        value = best[c - lengths[: upto[c]]] + prices[: upto[c]]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], used[c] = value[k], lengths[k]
        else:
            best[c] = best[c - 1]
    return best, used


def _pattern(first: int, used: np.ndarray, room: int) -> list[int]:
    out, c = [first], room - first
    while c > 0:
        if used[c]:
            out.append(int(used[c]))
            c -= int(used[c])
        else:
            c -= 1
    return out


class Program:
    """The covering program of ``counts[l]`` pieces of each length ``l`` and what is known of its value:
    ``lower`` bounds it for sure, ``value`` is that of the best ``times`` of ``shapes``."""

    def __init__(self, counts: np.ndarray, room: int, start: Plan) -> None:
        self.room, self.lengths = room, np.flatnonzero(counts)
        self.want = counts[self.lengths].astype(float)
        self.place = np.zeros(room + 1, np.int64)
        self.place[self.lengths] = np.arange(len(self.lengths))
        self.shapes: dict[tuple, int] = {}
        first: dict[int, float] = {}
        for shape, times in start:
            k = self.shapes.setdefault(tuple(sorted(shape, reverse=True)), len(self.shapes))
            first[k] = first.get(k, 0.0) + times
        for v in self.lengths.tolist():  # so that each length can be held
            self.shapes.setdefault((v,) * int(room // v), len(self.shapes))
        self.alone = np.array([self.shapes[(v,) * int(room // v)] for v in self.lengths.tolist()], np.int64)
        self.times = np.array([first.get(k, 0.0) for k in range(len(self.shapes))])
        self.value, self.lower = float(self.times.sum()), 0.0
        if self.shapes:
            self.index()

    def index(self) -> None:
        """Rows of the columns' entries in turn, and where each column begins."""
        shapes = list(self.shapes)
        sizes = np.array([len(p) for p in shapes])
        self.rows = self.place[np.concatenate([np.array(p) for p in shapes])]
        self.first, self.of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(shapes)), sizes)

    def price(self, prices: np.ndarray, columns: int) -> None:
        """The bound of these prices, and the best patterns at them as columns."""
        best, used = _knapsack(prices, self.lengths, self.room)
        # no pattern is worth more than best[room], so prices divided by that are a solution of the dual
        self.lower = max(self.lower, float(self.want @ prices) / best[self.room])
        for head in self.lengths[np.argsort(-(prices + best[self.room - self.lengths]), kind="stable")[:columns]].tolist():
            self.shapes.setdefault(tuple(sorted(_pattern(head, used, self.room), reverse=True)), len(self.shapes))
        self.times = np.concatenate([self.times, np.zeros(len(self.shapes) - len(self.times))])
        self.index()

    def held(self, times: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, times[self.of], len(self.lengths))

    def offer(self, times: np.ndarray) -> None:
        """Takes ``times``, with what they lack held by sequences of one length, if that is the least so far."""
        short = np.maximum(self.want - self.held(times), 0)
        times = times.copy()
        np.add.at(times, self.alone, short / (self.room // self.lengths))
        if times.sum() < self.value:
            self.value, self.times = float(times.sum()), times


def at_once(counts: np.ndarray, room: int, *, rounds: int = 120, columns: int = 24, step: float = 0.4, rate: float = 0.5) -> Plan:
    """A plan of nearly full patterns, each taken as the knapsack finds it, and best fit of the rest: where
    best fit alone is not within the gap, its patterns are columns that the program begins with."""
    left = counts.astype(np.int64).copy()
    made: Plan = []
    if left[room]:
        made.append(([room], int(left[room])))
        left[room] = 0
    want = np.maximum(left, 1).astype(float)
    weight = np.zeros(room + 1)
    for _ in range(rounds):
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        share = left[lengths] / want[lengths]
        mean = float((left[lengths] * lengths).sum() / (want[lengths] * lengths).sum())
        weight[lengths] = np.clip(weight[lengths] + rate * (share - mean), -0.7, 0.7)
        prices = lengths / room * np.exp(weight[lengths] * 0.2)
        best, used = _knapsack(prices, lengths, room)
        total = prices + best[room - lengths]
        for first in lengths[np.argsort(-total, kind="stable")[:columns]].tolist():
            if not left[first]:
                continue
            shape = _pattern(first, used, room)
            sizes, often = np.unique(shape, return_counts=True)
            fits = int((left[sizes] // often).min())
            # a pattern with room left would waste it as often as it is used
            if not fits or sum(shape) < room - max(2, room // 256):
                continue
            times = max(1, int(fits * step))
            left[sizes] -= often * times
            made.append((shape, times))
    return made + best_fit(left, room)


def covering(counts: np.ndarray, room: int, *, start: Plan | None = None, gap: float = 1e-3, rounds: int = 60, columns: int = 32, inner: int = 60, rate: float = 0.05) -> Program:
    """The program solved until its value is within ``gap`` of its bound, or for ``rounds``."""
    if start is None:
        start = best_fit(counts, room)
        if sum(t for _, t in start) > (1 + gap) * int((counts * np.arange(room + 1)).sum()) / room + 1:
            start = min(start, at_once(counts, room), key=lambda p: sum(t for _, t in p))
    solved = Program(counts, room, start)
    if not len(solved.lengths):
        return solved
    prices, times, total, weighed = solved.lengths / room, np.zeros(0), np.zeros(0), 0
    for turn in range(rounds):
        solved.price(prices, columns)
        if solved.value <= (1 + gap) * solved.lower or solved.value < solved.lower + 1:
            break
        # a column begins with a hundredth of the sequences that its scarcest length could fill
        fresh = np.minimum.reduceat(solved.want[solved.rows], solved.first)[len(times) :] * 1e-2
        times = np.concatenate([times, fresh])
        total = np.concatenate([total, np.zeros(len(times) - len(total))])
        for _ in range(inner if turn + 1 < rounds else 10 * inner):
            held = solved.held(times)
            prices = prices * np.clip(solved.want / np.maximum(held, 1e-9), 0.1, 10.0) ** rate
            worth = np.add.reduceat(prices[solved.rows], solved.first)
            times = np.maximum(times * np.clip(worth, 0.1, 10.0) ** rate, 1e-9)
            total, weighed = total + times, weighed + 1
        solved.offer(total / weighed)
        solved.offer(times)
        if turn & (turn + 1) == 0:  # the average forgets what came before it doubled
            total, weighed = np.zeros(len(times)), 0
    return solved


def plan(counts: np.ndarray, room: int, **options) -> Plan:
    """Patterns of lengths and how often to use each; together they hold ``counts[l]`` pieces of each length ``l``."""
    solved = covering(counts, room, **options)
    left = counts.astype(np.int64).copy()
    made: Plan = []
    for shape, times in sorted(zip(solved.shapes, solved.times.tolist(), strict=True), key=lambda c: -c[1]):
        sizes, often = np.unique(shape, return_counts=True)
        use = min(int(times + 1e-6), int((left[sizes] // often).min()))
        if use > 0:
            left[sizes] -= often * use
            made.append((list(shape), use))
    return made + best_fit(left, room)


def best_fit(left: np.ndarray, room: int) -> Plan:
    """Best fit in descending order of length, by groups of equal sequences."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    spaces = np.zeros(room + 1, np.int64)
    closed: Plan = []
    for length in np.flatnonzero(left)[::-1].tolist():
        need = int(left[length])
        while need:
            fit = np.flatnonzero(spaces[length:])
            if len(fit):
                space = length + int(fit[0])
                shape, times = open_[space].pop()
                each = min(space // length, max(1, -(-need // times)))
                use = min(times, need // each) if need >= each else 0
                if not use:
                    each, use = need, 1
                if use < times:
                    open_[space].append((shape, times - use))
                spaces[space] -= use
            else:
                each = min(room // length, need)
                use = max(1, need // each)
                shape, space = [], room
            need -= each * use
            grown, rest = shape + [length] * each, space - each * length
            if rest:
                open_.setdefault(rest, []).append((grown, use))
                spaces[rest] += use
            else:
                closed.append((grown, use))
    return closed + [x for groups in open_.values() for x in groups]


class Placement:
    """Sequence and offset of the ``rank``-th piece of a length under a plan."""

    def __init__(self, made: Plan, counts: np.ndarray) -> None:
        rows = [np.empty((0, 4), np.int64)]
        base = 0
        for shape, times in made:
            at = np.cumsum(shape) - shape
            rows.append(np.stack([np.array(shape), np.full(len(shape), times), np.full(len(shape), base), at], axis=1))
            base += times
        slots = np.concatenate(rows)
        slots = slots[np.argsort(slots[:, 0], kind="stable")]
        self.sequences, self.first = base, np.cumsum(slots[:, 1]) - slots[:, 1]
        self.base, self.offset = slots[:, 2], slots[:, 3]
        self.of_length = np.cumsum(counts) - counts

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.of_length[length] + rank
        k = np.searchsorted(self.first, at, side="right") - 1
        return self.base[k] + at - self.first[k], self.offset[k]


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", room: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece: ids of the whole text and then
    ``end_id``; only longer documents are cut, the first piece takes what does not fill one."""
    ready(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).alias("text"))

    def run(batches):
        made = encoder(path)
        for b in batches:
            flat, per = made.encode(b.column(1).to_pylist())
            out: list[list] = [[], [], [], [], []]
            for d, own in zip(b.column(0).to_pylist(), np.split(flat, np.cumsum(per)[:-1]), strict=True):
                ids = memoryview(np.append(own, np.uint32(end_id)).astype("<u4").tobytes())
                n = len(own) + 1
                starts = [0, *range(n % room or room, n, room)]
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    for column, value in zip(out, (d, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, *, room: int = 2048, salts: int = 64, **options) -> DataFrame:
    """:func:`pieces` with ``sequence_id`` and ``offset``.

    Null and empty texts are one end id; null ids and repeated rows are packed like others; an
    empty table gives an empty one; other columns play no part. Pieces of a length are numbered
    within ``salts`` parts of it, so no length meets in one task; the driver holds the histogram
    of lengths by part (``room * salts`` numbers at most) and the plan.
    """
    cut_up = cut(pieces(docs, room=room, **options).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    table = cut_up.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "salt"])
    counts = np.zeros(room + 1, np.int64)
    np.add.at(counts, table["length"].to_numpy(np.int64), table["n"].to_numpy(np.int64))
    place = Placement(plan(counts, room), counts)
    first = np.zeros((room + 1) * salts, np.int64)
    first[table["length"].to_numpy(np.int64) * salts + table["salt"].to_numpy(np.int64)] = (table["n"].cumsum() - table["n"]).to_numpy(np.int64)
    first -= np.repeat(place.of_length, salts)  # within the length

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, salt: pd.Series, nth: pd.Series) -> pd.DataFrame:
        size = length.to_numpy()
        sequence, offset = place(size, first[size * salts + salt.to_numpy()] + nth.to_numpy() - 1)
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = cut_up.withColumn("nth", nth).withColumn("at", placed("length", "salt", "nth"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
