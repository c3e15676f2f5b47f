"""Filling windows of a fixed capacity with documents, splitting none that fits.

Only the number of items of each size reaches the driver, at most capacity + 1 rows however many documents there
are. On these counts the plan is made: items above a third of the capacity go at most two to a window, the largest
with the largest that still fits; then the smaller ones, largest first, into the tightest gap that takes them. The
plan says which ranks of which size go into which windows, and Spark assigns the documents by their rank among those
of equal size. They are ranked in parts of about ``PART`` documents, of which a size has as many as its count asks for,
so a size that a third of all documents share, as do the full pieces of large ones, is spread over as many tasks.

Defined cases: a document larger than the capacity is cut into pieces of the capacity and a rest; one of size 0
takes a window but no room, spread evenly; a null size counts as 0; equal sizes are ranked by salt and id, so the
result is the same for the same rows; no documents give no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window as W, functions as F

#: Documents of one size that are ranked together, about.
PART = 50_000
PLAN_SCHEMA = "window_id string, size bigint, rank_lo bigint, rank_hi bigint, window_lo bigint, per_window bigint"


class _Gaps:
    """Windows by the room left in them; the tightest that takes an item is found by bits, in blocks of 512 sizes."""

    def __init__(self, capacity: int) -> None:
        self.windows: dict[int, list[tuple[int, int]]] = {}
        self.words, self.top = [0] * ((capacity >> 9) + 1), 0

    def free(self, gap: int, window: int, many: int) -> None:
        if gap and many:
            if gap not in self.windows:
                self.windows[gap] = []
                self.words[gap >> 9] |= 1 << (gap & 511)
                self.top |= 1 << (gap >> 9)
            self.windows[gap].append((window, many))

    def tightest(self, size: int) -> int:
        """The least room that takes the size, 0 if there is none."""
        block = size >> 9
        word = self.words[block] >> (size & 511) << (size & 511)
        if not word:
            above = self.top >> (block + 1)
            if not above:
                return 0
            block += (above & -above).bit_length()
            word = self.words[block]
        return (block << 9) + (word & -word).bit_length() - 1

    def take(self, gap: int) -> tuple[int, int]:
        out = self.windows[gap].pop()
        if not self.windows[gap]:
            del self.windows[gap]
            self.words[gap >> 9] &= ~(1 << (gap & 511))
            if not self.words[gap >> 9]:
                self.top &= ~(1 << (gap >> 9))
        return out


def plan_windows(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows ``(size, rank_lo, rank_hi, window_lo, per_window)`` and the number of windows.

    The item of rank r in [rank_lo, rank_hi) of its size goes into window window_lo + (r - rank_lo) // per_window.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    done = dict.fromkeys(counts, 0)
    gaps = _Gaps(capacity)
    windows = 0

    def put(size: int, items: int, window: int, per: int) -> None:
        plan.append((size, done[size], done[size] + items, window, per))
        done[size] += items

    large = sorted(s for s in left if 3 * s > capacity)
    lower = list(range(len(large)))  # of each place, a place at or below it nearer to one with items left

    def down(k: int) -> int:
        """The last place up to k whose size has items left, or -1."""
        way = []
        while k >= 0 and not left[large[k]]:
            way.append(k)
            k = lower[k] if lower[k] < k else k - 1
        for x in way:
            lower[x] = k
        return k

    at = down(len(large) - 1)
    while at >= 0:
        a = large[at]
        k = down(min(at, bisect_right(large, capacity - a) - 1))
        if k == at and left[a] == 1:  # one item is left of a size that pairs with itself
            k = down(at - 1)
        if k < 0:
            n = left[a]
            put(a, n, windows, 1)
            gaps.free(capacity - a, windows, n)
        else:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, windows, 1)
            put(b, n, windows, 1)
            gaps.free(capacity - a - b, windows, n)
            left[b] -= n
        left[a] -= n
        windows += n
        at = down(at)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            gap = gaps.tightest(s)
            if not gap:
                per = min(capacity // s, n)
                full = n // per
                put(s, full * per, windows, per)
                gaps.free(capacity - per * s, windows, full)
                windows += full
                n -= full * per
                continue
            window, many = gaps.take(gap)
            per = min(gap // s, n)
            full = min(many, n // per)
            put(s, full * per, window, per)
            gaps.free(gap, window + full, many - full)
            gaps.free(gap - per * s, window, full)
            n -= full * per
    if n := counts.get(0, 0):
        windows = max(windows, 1)
        put(0, n, 0, -(-n // windows))
    return plan, windows


def _pieces(sizes: DataFrame, capacities: dict[str, int], id_col: str, size_col: str) -> DataFrame:
    """A row for each piece of each document under each capacity."""
    windows = F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).cast("bigint").alias("capacity")) for w, c in sorted(capacities.items())])
    size, cap = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint"), F.col("w.capacity")
    last = F.greatest(F.lit(0), F.floor((F.col("total") - 1) / cap)).cast("int")
    return (
        sizes.select(F.col(id_col).alias("doc_id"), size.alias("total"), F.explode(windows).alias("w"))
        .select("doc_id", "w.window_id", "w.capacity", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .select("doc_id", "window_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.least("capacity", F.col("total") - F.col("piece") * F.col("capacity")).alias("size"))
    )


def pack(sizes: DataFrame, capacities: dict[str, int], id_col: str = "doc_id", size_col: str = "n_tokens", part: int = PART) -> DataFrame:
    """``(window_id, doc_id, piece, start_token, n_tokens, window_no)`` for every piece of every document.

    ``capacities`` is a small, fixed map of window kind to capacity. ``sizes`` is read three times, so pass a table that
    was written, see ``factloom.session.cut``.
    """
    spark = sizes.sparkSession
    if bad := {w: c for w, c in capacities.items() if not c or c < 1}:
        raise ValueError(f"capacities must be positive: {bad}")
    by = ["window_id", "size"]
    pieces = _pieces(sizes, capacities, id_col, size_col)
    rows = pieces.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 sizes of a window kind
    plan = []
    for w, capacity in capacities.items():
        made, _ = plan_windows({r.size: r.n for r in rows if r.window_id == w}, capacity)
        plan += [(w, *x) for x in made]
    shared = F.broadcast(spark.createDataFrame([(r.window_id, r.size, -(-r.n // part)) for r in rows if r.n > part], "window_id string, size bigint, parts bigint"))
    salted = pieces.join(shared, by, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("parts", F.lit(1)))).drop("parts")
    counts = salted.groupBy(*by, "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(*by, "salt", (F.sum("n").over(W.partitionBy(*by).orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("nth", F.row_number().over(W.partitionBy(*by, "salt").orderBy("doc_id", "piece")) - 1)
    # both sides are partitioned by size and salt, so this join moves the offsets only
    ranked = ranked.join(offsets.hint("merge"), [*by, "salt"]).withColumn("rank", F.col("before") + F.col("nth"))
    where = F.broadcast(spark.createDataFrame(plan, PLAN_SCHEMA))
    r, p = ranked.alias("r"), where.alias("p")
    hit = (F.col("r.window_id") == F.col("p.window_id")) & (F.col("r.size") == F.col("p.size")) & (F.col("r.rank") >= F.col("p.rank_lo")) & (F.col("r.rank") < F.col("p.rank_hi"))
    number = F.col("p.window_lo") + F.floor((F.col("r.rank") - F.col("p.rank_lo")) / F.col("p.per_window"))
    return r.join(p, hit).select("r.window_id", "r.doc_id", "r.piece", "r.start_token", F.col("r.size").alias("n_tokens"), number.cast("bigint").alias("window_no"))


def report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per window kind: windows used, the least that any packing needs, and the share of room filled."""
    spark = packed.sparkSession
    caps = F.broadcast(spark.createDataFrame(sorted(capacities.items()), "window_id string, capacity bigint"))
    per = packed.groupBy("window_id", "window_no").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    out = per.groupBy("window_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("pieces").alias("pieces"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return out.join(caps, "window_id").withColumn("least_windows", least).withColumn("filled", F.round(F.col("tokens") / (F.col("windows") * F.col("capacity")), 6))
