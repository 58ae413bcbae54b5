"""Items of varying length packed into containers of fixed capacity.

Hierarchical packing over context sizes. Items are routed to tiers by length, and every tier has
windows of its own size. From the longest tier down, a tier packs its items into its windows
(best-fit decreasing), and the gaps left in them are filled from the shorter tiers, longest fitting item
first; what a shorter tier has left is packed into its own windows next. The windows are stacked, by what
they really hold, into containers of the full capacity. The shortest tier goes by octaves of length: each
first fills what the stacked windows leave, and its rest is packed and stacked in turn. Containers are dealt out to step groups so that every step gets
its share of every kind of window.

What the driver plans with is the histogram of lengths, at most one number per length up to the
capacity whatever the corpus size, so the plan sees every item and no group of items is gathered.
Items find their window by their rank among items of equal length; ranks come from bucket offsets.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

CAPACITY = 2048
TIERS = (256, 512, 1024, 2048)
STEP = 64


def pieces_of(counts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """``key, piece_no, size``: a document, or the pieces of one longer than the capacity.

    All pieces but the last are full. A document without tokens, or of unknown length, has none.
    """
    n = F.col(tokens)
    last = F.ceil(n / capacity) - 1
    return (
        counts.where(n > 0)
        .select(key, tokens, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
        .select(key, "piece_no", F.least(n - F.col("piece_no") * capacity, F.lit(capacity)).cast("int").alias("size"))
    )


class Windows:
    """Windows of one size: runs of ranks that go into them, and the gaps they still have.

    A run (size, first_rank, first_window, per_window) sends the items of one length and consecutive ranks to
    consecutive windows, ``per_window`` to each.
    """

    def __init__(self, size: int):
        self.size = size
        self.count = 0
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.runs: list[tuple[int, int, int, int]] = []

    def _leave(self, gap: int, first: int, n: int) -> None:
        if n:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            heapq.heappush(self.open[gap], (first, n))

    def _take(self, gap: int) -> tuple[int, int]:
        taken = heapq.heappop(self.open[gap])
        if not self.open[gap]:
            del self.open[gap]
            self.gaps.pop(bisect_left(self.gaps, gap))
        return taken

    def _fill(self, size: int, rank: int, count: int, gap: int, first: int, n: int) -> int:
        """Put up to ``count`` items into n windows of one gap; returns how many went in."""
        each = gap // size
        placed = min(count, n * each)
        full, rest = divmod(placed, each)
        self.runs.append((size, rank, first, each))
        self._leave(gap - each * size, first, full)
        if rest:
            self._leave(gap - rest * size, first + full, 1)
        used = full + (rest > 0)
        self._leave(gap, first + used, n - used)
        return placed

    def fill(self, size: int, rank: int, count: int) -> int:
        """Place items of one length into gaps, tightest first; returns how many found one."""
        placed = 0
        while placed < count and (at := bisect_left(self.gaps, size)) < len(self.gaps):
            gap = self.gaps[at]
            placed += self._fill(size, rank + placed, count - placed, gap, *self._take(gap))
        return placed

    def add(self, size: int, rank: int, count: int) -> None:
        """Place all items of one length: gaps first, then new windows."""
        placed = self.fill(size, rank, count)
        if placed < count:
            n = -(-(count - placed) // (self.size // size))
            first, self.count = self.count, self.count + n
            self._fill(size, rank + placed, count - placed, self.size, first, n)

    def contents(self) -> list[tuple[int, int, int]]:
        """(used, first_window, n) of all windows."""
        return sorted((self.size - gap, first, n) for gap, runs in self.open.items() for first, n in runs)

    def close(self) -> None:
        """No window takes any more."""
        self.gaps.clear()
        self.open.clear()


class Plan:
    """Windows of every tier, and the containers their windows are stacked into."""

    def __init__(self, histogram: dict[int, int], capacity: int, tiers: tuple[int, ...], windows_first: bool = True):
        bounds = [0, *tiers]
        self.windows = [Windows(t) for t in tiers]
        routed = [sorted((s for s in histogram if low < s <= high), reverse=True) for low, high in zip(bounds, tiers, strict=False)]
        done = dict.fromkeys(histogram, 0)
        stack = Windows(capacity)
        self.base, self.held, self.total = {}, [], 0
        self._per_used: dict[int, int] = {}
        direct: list[tuple[int, int, int, int]] = []

        def settle(tier: int, sizes: list[int]) -> None:
            """Items fill what the stacked windows leave; the rest has windows of its own, stacked at once."""
            stacked, stack.runs = stack.runs, direct
            for size in sizes:
                done[size] += stack.fill(size, done[size], histogram[size] - done[size])
            stack.runs = stacked
            self._pack(self.windows[tier], sizes, histogram, done)
            self._stack(stack, [tier])

        longer = list(reversed(range(1, len(tiers))))
        for tier in longer:
            if windows_first:
                self._pack(self.windows[tier], routed[tier], histogram, done)
                for shorter in reversed(range(1, tier)):
                    for size in routed[shorter]:
                        done[size] += self.windows[tier].fill(size, done[size], histogram[size] - done[size])
            else:
                settle(tier, routed[tier])
        if windows_first:
            self._stack(stack, longer)
        # The shortest tier goes by octaves, so that each fills what the windows of the octave before leave.
        high = tiers[0]
        while high:
            settle(0, [size for size in routed[0] if high // 2 < size <= high])
            high //= 2
        self.containers, self.stack_runs = stack.count, stack.runs
        self.runs = [(size, rank, first + self.base[t], each, self.windows[t].size) for t, w in enumerate(self.windows) for size, rank, first, each in w.runs]
        # A piece in a container's own gap has the container as its window, numbered behind all others.
        self.runs += [(size, rank, first + self.total, each, capacity) for size, rank, first, each in direct]

    @staticmethod
    def _pack(windows: Windows, sizes: list[int], histogram: dict[int, int], done: dict[int, int]) -> None:
        for size in sizes:
            if done[size] < histogram[size]:
                windows.add(size, done[size], histogram[size] - done[size])
                done[size] = histogram[size]

    def _stack(self, stack: Windows, tiers: list[int]) -> None:
        """Stack the windows of some tiers, by what they hold, the fullest first."""
        held = []
        for tier in tiers:
            base = self.base.setdefault(tier, self.total)
            held += [(used, first + base, n) for used, first, n in self.windows[tier].contents()]
            self.total = base + self.windows[tier].count
            self.windows[tier].close()
        more: dict[int, int] = {}
        for used, first, n in sorted(held, reverse=True):
            self.held.append((first, used, self._per_used.get(used, 0) + more.get(used, 0)))
            more[used] = more.get(used, 0) + n
        for used, n in more.items():
            stack.add(used, self._per_used.get(used, 0), n)
            self._per_used[used] = self._per_used.get(used, 0) + n

    def placer(self) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function of (size, rank) arrays to (window, window size, container); it carries the runs and nothing else."""
        items, windows, stacked, total = _Runs(self.runs, 5), np.array(sorted(self.held), np.int64).reshape(-1, 3), _Runs(self.stack_runs, 4), self.total

        def place(size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            run = items.of(size, rank)
            window = run[:, 2] + (rank - run[:, 1]) // np.maximum(run[:, 3], 1)
            container = window - total
            inner = window < total
            if inner.any():
                at = windows[np.searchsorted(windows[:, 0], window[inner], side="right") - 1]
                used, no = at[:, 1], at[:, 2] + window[inner] - at[:, 0]
                stack = stacked.of(used, no)
                container[inner] = stack[:, 2] + (no - stack[:, 1]) // stack[:, 3]
            return window, run[:, 4], container

        return place


class _Runs:
    """Runs sorted for a lookup by (size, rank)."""

    def __init__(self, runs: list[tuple[int, ...]], width: int):
        self.rows = np.array(sorted(runs), np.int64).reshape(-1, width)
        self.stride = int(self.rows[:, 1].max(initial=0)) + 1
        self.starts = self.rows[:, 0] * self.stride + self.rows[:, 1]

    def of(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The run each pair falls into."""
        if not len(size):
            return np.zeros((0, self.rows.shape[1]), np.int64)
        key = size * self.stride + np.minimum(rank, self.stride - 1)
        return self.rows[np.searchsorted(self.starts, key, side="right") - 1]


def plan_tiers(histogram: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> Plan:
    """The plan of a histogram of lengths.

    The gaps of long windows are filled from shorter tiers either before the windows are stacked or after; both are
    planned, and the plan with fewer containers is taken.
    """
    return min((Plan(histogram, capacity, tiers, first) for first in (True, False)), key=lambda plan: plan.containers)


def rank_in_group(df: DataFrame, by: str, order: list[str], buckets: int, out: str) -> DataFrame:
    """``df`` plus ``out``: 0-based numbers within ``by``, from bucket offsets and local ranks."""
    cut = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy("__by").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(F.col(by).alias("__by"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
        .select("__by", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    local = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(*order))
    return (
        cut.join(offsets, (F.col(by) == F.col("__by")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(out, F.col("__offset") + local - 1)
        .drop("__by", "__b", "__bucket", "__offset")
    )


def tier_of(size: Column, tiers: tuple[int, ...] = TIERS) -> Column:
    """The smallest tier window that holds a length."""
    out = F.when(size <= tiers[0], tiers[0])
    for t in tiers[1:]:
        out = out.when(size <= t, t)
    return out


def pack(
    counts: DataFrame, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, step: int = STEP, key: str = "doc_id", tokens: str = "n_tokens"
) -> DataFrame:
    """``key, piece_no, token_from, token_to, tier, window, window_id, container_id, step_no`` of every piece.

    Every token of every document is in exactly one piece and every piece in one container, whose
    pieces sum to at most ``capacity``. ``tier`` is the context size a piece is routed to by its length, ``window``
    the size of the window it was put into (a longer one where it fills a gap) and ``window_id`` that window.
    Null and zero lengths need no container; an empty table gives no row. ``key`` must be unique. ``step_no``
    groups about ``step`` containers. Counting and the ranks run while the frame is being built.
    """
    if tiers[-1] != capacity or sorted(set(tiers)) != list(tiers) or tiers[0] < 1:
        raise ValueError("tiers must rise and end at the capacity")
    scratch = Scratch(counts.sparkSession)
    kept = scratch.cut(counts.select(key, tokens), "counts")
    pieces = pieces_of(kept, capacity, key, tokens)
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    plan = plan_tiers(histogram, capacity, tiers)
    steps = max(1, -(-plan.containers // step))
    place_items = plan.placer()
    ranked = rank_in_group(pieces, "size", [key, "piece_no"], max(16, sum(histogram.values()) // 200_000), "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            placed = place_items(size, rank)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *[pa.array(x, pa.int64()) for x in placed]],
                names=[key, "piece_no", "size", "window_id", "window", "container_id"],
            )

    kind = counts.schema[key].dataType.simpleString()
    placed = ranked.select(key, "piece_no", "size", "rank").mapInArrow(
        place, f"`{key}` {kind}, piece_no bigint, size int, window_id bigint, window bigint, container_id bigint"
    )
    begin = F.col("piece_no") * capacity
    return placed.select(
        key, "piece_no", begin.alias("token_from"), (begin + F.col("size")).alias("token_to"),
        tier_of(F.col("size"), tiers).alias("tier"), F.col("window").cast("int").alias("window"), "window_id", "container_id",
        (F.col("container_id") % steps).alias("step_no"),
    )


def step_balance(packed: DataFrame) -> DataFrame:
    """``step_no, containers, pieces, tokens`` of every step group."""
    size = F.col("token_to") - F.col("token_from")
    per = packed.groupBy("step_no", "container_id").agg(F.count(F.lit(1)).alias("p"), F.sum(size).alias("t"))
    return per.groupBy("step_no").agg(F.count(F.lit(1)).alias("containers"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"))


def packing_faults(packed: DataFrame, counts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """One row: ``documents`` placed, and the number of containers and windows too full, documents not placed whole, windows in two containers."""
    size = F.col("token_to") - F.col("token_from")
    zero = F.lit(0).cast("bigint")
    window = packed.groupBy("window_id", "window").agg(F.sum(size).alias("held"), F.min("container_id").alias("lo"), F.max("container_id").alias("hi"))
    container = window.groupBy("lo").agg(F.sum("held").alias("held"))
    placed = packed.groupBy(key).agg(F.sum(size).alias("got"), F.max("token_to").alias("last"), F.count_distinct("piece_no").alias("p"), F.max("piece_no").alias("top"))
    whole = (F.col("got") == F.col(tokens)) & (F.col("last") == F.col(tokens)) & (F.col("p") == F.col("top") + 1)
    docs = counts.where(F.col(tokens) > 0).select(key, tokens).join(placed, key, "full")
    parts = [
        docs.select(F.when(F.col("got").isNotNull(), 1).otherwise(0).alias("documents"), zero.alias("a"), zero.alias("b"), F.when(whole, 0).otherwise(1).alias("c"), zero.alias("d")),
        container.select(zero, F.when(F.col("held") > capacity, 1).otherwise(0), zero, zero, zero),
        window.select(zero, zero, F.when(F.col("held") > F.col("window"), 1).otherwise(0), zero, F.when(F.col("lo") != F.col("hi"), 1).otherwise(0)),
    ]
    names = ("documents", "over_capacity", "over_window", "incomplete", "in_two_containers")
    return parts[0].union(parts[1]).union(parts[2]).toDF(*names).agg(*[F.sum(n).alias(n) for n in names])
