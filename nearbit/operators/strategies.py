"""Six ways to find all pairs within Hamming distance ``d``.

Each strategy rewrites the theta join into equi-joins on signatures, which
Catalyst cannot derive by itself, and adds a residual predicate that lets each
pair through at exactly one signature, so no ``distinct`` over pairs is needed.

``candidates(points, spec)`` gives the rows a strategy ships through its
exchange (its communication cost); ``pairs(points, spec)`` gives
``(l, r, dist)``, or ``(l, r, lid, rid, dist)`` when the points carry ids.

``points`` has a column ``v`` and, in bag mode, a unique ``id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce, wraps
from math import ceil

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from nearbit.functions import bits as B
from nearbit.operators import anchors as A
from nearbit.operators import balls, cells
from nearbit.operators.anchors import AnchorSet
from nearbit.sources.scratch import kept


Step = Callable[[DataFrame, "Spec"], DataFrame]
#: Rows of one value beyond which they are dealt to parts.
COPIES = 4_000
#: Rows of a task of a nested loop with a broadcast side.
NESTED = 1_000
#: Rows that a task makes of the values it expands, or looks up, about.
LOOKUPS = 4_000_000
#: Nodes of the tree of chunks within chunks, at most.
NODES = 2_000


class Counters:
    """Counts what one run of a join ships, looks at and finds, while it runs."""

    def __init__(self) -> None:
        self._seen = {name: Observation() for name in ("shipped", "candidates", "pairs")}

    def watch(self, df: DataFrame, name: str) -> DataFrame:
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """After the run; waits for its end."""
        return {name: seen.get["n"] for name, seen in self._seen.items()}


@dataclass(frozen=True)
class Spec:
    """What to join: distance ``d`` over strings of ``bits`` bits.

    ``grid``: bands per side of the triangular grid; ``residue``: bands by the
    value's residue instead of a hash of the row. ``chunks``: masks of the
    chunks of ``split``, d + 1 that share the bits; None: runs of bits.
    ``bucket``: rows beyond which a chunk's bucket is cut into cells.
    ``anchors``: a DataFrame with a column ``c``, or None for a seeded draw;
    ``complement``: it holds what is no anchor. ``reducers``: partitions that the joins' keys are dealt
    to (Spark raises it to spark.sql.shuffle.partitions); None leaves it to Spark. ``join_hint``: physical hint for the joins of
    expanded sides; None means sort-merge, in which Spark splits hot keys.
    ``counters``: what one run ships (of one side), looks at and finds; for
    strategies that join signatures, a run each.
    """

    d: int
    bits: int = 32
    bag: bool = False
    grid: int = 8
    residue: bool = False
    chunks: tuple[int, ...] | None = None
    bucket: int = 4_000
    seed: int = 17
    anchors: DataFrame | None = field(default=None, compare=False)
    complement: bool = False
    reducers: int | None = None
    join_hint: str | None = None
    counters: Counters | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= B.WORD:
            raise ValueError("bits must be 1..32")
        if self.d < 0:
            raise ValueError("d must be 0 or more")
        if self.grid < 1:
            raise ValueError("grid must be 1 or more")
        if self.bucket < 1:
            raise ValueError("bucket must be 1 or more")
        if self.chunks is not None and (len(self.chunks) < min(self.reach + 1, self.bits) or sum(self.chunks) != (1 << self.bits) - 1 or any(a & b for i, a in enumerate(self.chunks) for b in self.chunks[:i])):
            raise ValueError("chunks must share the bits, d + 1 of them")
        if self.reducers is not None and self.reducers < 1:
            raise ValueError("reducers must be 1 or more")

    @property
    def reach(self) -> int:
        return min(self.d, self.bits)


def _sides(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    return points.select(F.col("v").alias("l")), points.select(F.col("v").alias("r"))


def _ordered() -> Column:
    """Each unordered pair once."""
    return F.col("l") < F.col("r")


def _close(spec: Spec) -> Column:
    return B.distance(F.col("l"), F.col("r")) <= spec.reach


def _out(df: DataFrame, spec: Spec) -> DataFrame:
    out = df.select("l", "r", B.distance(F.col("l"), F.col("r")).alias("dist"))
    return spec.counters.watch(out, "pairs") if spec.counters else out


def _of_rows(found: DataFrame, points: DataFrame, spec: Spec) -> DataFrame:
    """Pairs of values, and each value with itself, as pairs of their rows; the rows of frequent values are dealt to parts."""
    values = points.groupBy("v").agg(F.count("*").alias("n"))
    pairs = found.unionByName(values.where("n > 1").select(F.col("v").alias("l"), F.col("v").alias("r"), F.lit(0).alias("dist")))
    parts = values.where(F.col("n") > COPIES).select(F.col("v").alias("r"), F.ceil(F.col("n") / COPIES).cast("int").alias("parts"))
    parts, one = cells.by_size(kept(parts)), F.coalesce("parts", F.lit(1))
    left = pairs.join(points.select(F.col("v").alias("l"), F.col("id").alias("lid")).hint("merge"), "l").join(parts, "r", "left")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), one - 1)))
    right = points.select(F.col("v").alias("r"), F.col("id").alias("rid")).join(parts, "r", "left").withColumn("part", F.pmod(F.xxhash64("rid"), one).cast("int"))
    rows = left.drop("parts").join(right.drop("parts").hint("merge"), ["r", "part"])
    return rows.where("l < r or lid < rid").select("l", "r", "lid", "rid", "dist")


def _by_value(pairs: Step) -> Step:
    """Rows that share a value are joined as one; their pairs are made behind the join, where they are the result."""

    @wraps(pairs)
    def joined(points: DataFrame, spec: Spec) -> DataFrame:
        if not spec.bag:
            return pairs(points, spec)
        return _of_rows(pairs(points.select("v").distinct(), replace(spec, bag=False)), points, spec)

    return joined


def _shared(values: DataFrame, times: int) -> DataFrame:
    """The values dealt to tasks by what they expand to, ``times`` their number; by their own few bytes Spark would give them to one."""
    return values.repartition(max(1, min(cells.PARTITIONS, ceil(values.count() * times / LOOKUPS))), "v")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], spec: Spec) -> DataFrame:
    """The join of expanded sides. They carry a hint, since Catalyst does not see that explode multiplies rows."""
    if spec.reducers:
        left, right = (df.repartition(spec.reducers, *keys) for df in (left, right))
    if not spec.counters:
        return left.join(right.hint(spec.join_hint or "merge"), keys)
    return spec.counters.watch(spec.counters.watch(left, "shipped").join(right.hint(spec.join_hint or "merge"), keys), "candidates")


# Nested loop -----------------------------------------------------------------


def nested_candidates(points: DataFrame, spec: Spec) -> DataFrame:
    return points


@_by_value
def nested_pairs(points: DataFrame, spec: Spec) -> DataFrame:
    """One side is broadcast if its count allows it, the other dealt to tasks of about ``NESTED`` rows."""
    left, right = _sides(points)
    n = points.limit(cells.FEW + 1).count()
    if n <= cells.FEW:
        left, right = left.repartition(max(1, ceil(n / NESTED)), "l"), F.broadcast(right)
    return _out(left.join(right, _ordered() & _close(spec)), spec)


# Triangular grid -------------------------------------------------------------


def grid_candidates(points: DataFrame, spec: Spec) -> DataFrame:
    """``grid`` copies of each point: one for each cell of its row and column."""
    ids = ["id"] if spec.bag else []
    band = F.pmod(F.col("v"), F.lit(spec.grid)) if spec.residue else cells.dealt(points, ids, spec.grid)
    return cells.in_cells(points, band, F.lit(spec.grid))


def grid_cell_id() -> Column:
    return (F.col("hi") * (F.col("hi") + 1) / 2 + F.col("lo")).cast("int")


def _pairs_in_cells(got: DataFrame, keys: list[str], spec: Spec, also: Column | None = None) -> DataFrame:
    """Two bands meet in one cell; ``l`` comes from the row side, then is put in order. ``also``: a condition on ``l`` and ``r``."""
    a = got.where("row").select(*keys, F.col("v").alias("l"))
    b = got.where("column").select(*keys, F.col("v").alias("r"))
    joined = _meet(a, b, keys, spec).where(((F.col("lo") < F.col("hi")) | _ordered()) & _close(spec))
    joined = joined if also is None else joined.where(also)
    return _out(joined.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")), spec)


@_by_value
def grid_pairs(points: DataFrame, spec: Spec) -> DataFrame:
    return _pairs_in_cells(grid_candidates(points, spec), ["lo", "hi"], spec)


# Half-radius balls -----------------------------------------------------------


def ball_half_candidates(points: DataFrame, spec: Spec) -> DataFrame:
    return balls.neighbours(points, spec.bits, ceil(spec.reach / 2), 0, name="centre")


@_by_value
def ball_half_pairs(points: DataFrame, spec: Spec) -> DataFrame:
    """Both sides expand, the nearer one less far; a pair counts only at its canonical centre.

    With x = l XOR r of w bits, t = ceil(w / 2) of them lie in one half of the
    universe. One value takes the t lowest of these to the centre, so it
    flips bits of one half only; the other takes the rest, and it is the one that
    has the rest's highest bit (of a rest of none, the larger). So one
    side has a quarter or so of its ball's strings, the other a half.
    """
    most, low = ceil(spec.reach / 2), spec.bits // 2
    if not spec.reach:
        left, right = _sides(points)
        return _out(left.join(right, F.lit(False)), spec)
    left, right = _sides(_shared(points, 1 + B.ball_size(spec.bits, most)))
    taken = balls.in_halves(left, spec.bits, most, value="l", name="centre")
    rest = balls.neighbours(right, spec.bits, spec.reach // 2, 0, value="r", name="centre").where("centre <= r")
    x = F.col("l").bitwiseXOR(F.col("r"))
    lower, t = x.bitwiseAND(F.lit((1 << low) - 1)), F.ceil(F.bit_count(x) / 2)
    half = F.when(F.bit_count(lower) >= t, lower).otherwise(x.bitwiseXOR(lower))
    canon = F.col("l").bitwiseXOR(half).bitwiseXOR(B.clear_lowest(half, t, most))
    met = _meet(taken, rest, ["centre"], spec).where(_close(spec) & ((F.col("centre") < F.col("r")) | _ordered()) & (F.col("centre") == canon))
    return _out(met.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")), spec)


# Full-radius balls -----------------------------------------------------------


def ball_full_candidates(points: DataFrame, spec: Spec) -> DataFrame:
    """Each point itself, and its smaller neighbours within ``d`` under the point's value."""
    itself = points.select(*points.columns, F.col("v").alias("centre"))
    if not spec.reach:
        return itself
    return itself.unionByName(balls.neighbours(points, spec.bits, spec.reach, name="centre").where("centre < v"))


@_by_value
def ball_full_pairs(points: DataFrame, spec: Spec) -> DataFrame:
    """One side expands downwards and meets the data in an equi-join: the match itself proves the distance."""
    left, right = _sides(points)
    if not spec.reach:
        return _out(left.join(right, F.lit(False)), spec)
    right = _shared(points, B.ball_size(spec.bits, spec.reach)).select(F.col("v").alias("r"))
    around = balls.neighbours(right, spec.bits, spec.reach, value="r", name="l").where("l < r")
    return _out(_meet(left, around, ["l"], spec), spec)


# Chunk splitting -------------------------------------------------------------


def _layout(spec: Spec) -> list[int]:
    return list(spec.chunks or B.chunk_masks(spec.bits, spec.reach + 1))


def split_candidates(points: DataFrame, spec: Spec) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(j).alias("j"), F.col("v").bitwiseAND(F.lit(m)).alias("k")) for j, m in enumerate(_layout(spec))])
    return points.withColumn("part", F.explode(parts)).select(*points.columns, "part.j", "part.k")


@_by_value
def split_pairs(points: DataFrame, spec: Spec) -> DataFrame:
    """d + 1 chunks: strings within d agree in one at least; a pair counts at the first of them.

    Buckets are counted. One of more than ``bucket`` rows is split again: its
    strings agree in a chunk, so the bits outside it are dealt to d + 1 chunks of
    about equal entropy, and so on. Where that would send a row more often than
    cutting the bucket into bands that meet pair by pair, or where bits or
    nodes run out, it is cut, so that no key holds more than about twice ``bucket``.
    """
    if spec.reach >= spec.bits:  # more differences than chunks can hold: every pair qualifies
        return nested_pairs(points, spec)
    layout = _layout(spec)
    rows, x = split_candidates(points, spec), F.col("l").bitwiseXOR(F.col("r"))
    heavy = _heavy(rows, spec)
    if not heavy.limit(1).count():
        left, right = (rows.select("j", "k", F.col("v").alias(side)) for side in ("l", "r"))
        first = B.first_equal_chunk(x, layout) == F.col("j")
        return _out(_meet(left, right, ["j", "k"], spec).where(_ordered() & _close(spec) & first), spec)
    rows = split_candidates(_shared(points, (spec.reach + 1) ** 4), spec)
    shares = points.agg(*[F.avg(F.getbit("v", F.lit(i)).cast("double")) for i in range(spec.bits)]).first()
    nodes = [Node(m, tuple(layout[:j])) for j, m in enumerate(layout)]
    done = []
    while True:
        again = {}  # the nodes with a bucket to split, and their first child
        for (j,) in heavy.where(F.col("bands") > spec.reach + 1).select("j").distinct().collect():
            chunks = nodes[j].chunks(shares, spec)
            if chunks and len(nodes) + len(chunks) <= NODES:
                again[j] = len(nodes)
                nodes += [Node(nodes[j].fixed | m, nodes[j].differ + tuple(chunks[:i])) for i, m in enumerate(chunks)]
        marked = rows.join(cells.by_size(heavy), ["j", "k"], "left").withColumn("bands", F.coalesce("bands", F.lit(1)))
        if not again:
            done.append(marked.select("v", "j", "k", "bands"))
            break
        child = _by_node(again, len(nodes), -1)
        goes = (F.col("bands") > spec.reach + 1) & (child >= 0)
        done.append(marked.where(~goes).select("v", "j", "k", "bands"))
        fixed = [F.struct((child + i).cast("int").alias("j"), F.col("v").bitwiseAND(_by_node({j: nodes[first + i].fixed for j, first in again.items()}, len(nodes))).alias("k")) for i in range(spec.reach + 1)]
        rows = marked.where(goes).select("v", F.inline(F.array(*fixed)))
        heavy = _heavy(rows, spec)
    every = reduce(DataFrame.unionByName, done)
    in_bands = cells.in_cells(every, cells.dealt(every, [], F.col("bands")), F.col("bands"))
    differ = [_by_node({j: n.differ[i] for j, n in enumerate(nodes) if i < len(n.differ)}, len(nodes), -1) for i in range(max(len(n.differ) for n in nodes))]
    first = reduce(Column.__and__, [x.bitwiseAND(m) != 0 for m in differ], F.lit(True))
    return _pairs_in_cells(in_bands, ["j", "k", "lo", "hi"], spec, first)


@dataclass(frozen=True)
class Node:
    """Strings that agree in the bits ``fixed``; of a pair that counts here, each mask of ``differ`` holds a difference."""

    fixed: int
    differ: tuple[int, ...]

    def chunks(self, shares: list[float], spec: Spec) -> list[int]:
        """Masks of d + 1 chunks of the other bits, each with one that varies; none, if there are too few of those."""
        free = [i for i in range(spec.bits) if not self.fixed >> i & 1]
        if sum(0 < shares[i] < 1 for i in free) <= spec.reach:
            return []
        return [sum(1 << free[i] for i in range(len(free)) if m >> i & 1) for m in B.dealt_chunks([shares[i] for i in free], spec.reach + 1)]


def _by_node(values: dict[int, int], n: int, default: int = 0) -> Column:
    """What the row's node has, from a literal."""
    return F.get(F.lit([values.get(j, default) for j in range(n)]).cast("array<bigint>"), F.col("j"))


def _heavy(rows: DataFrame, spec: Spec) -> DataFrame:
    """``(j, k, bands)`` of the buckets beyond ``bucket``, written, since they are counted and joined."""
    return kept(cells.heavy_buckets(rows, ["j", "k"], spec.bucket).select("j", "k", F.ceil(F.col("n") / spec.bucket).alias("bands")))


# Anchor points ---------------------------------------------------------------


def _anchor_set(points: DataFrame, spec: Spec) -> AnchorSet:
    """The given or drawn anchors."""
    if spec.anchors is None:
        return A.drawn(points.sparkSession, spec.bits, spec.d, spec.seed)
    return AnchorSet(spec.anchors.select("c").distinct(), spec.complement)


def homes(points: DataFrame, spec: Spec) -> DataFrame:
    """``(l, c)``: each distinct value's nearest anchor within ``d``, ties to the smaller; what no anchor covers is its own."""
    values = points.select("v").distinct()
    if spec.anchors is None and A.sizing(spec.bits, spec.d)["anchors"] == 1 << spec.bits:
        if A.target(spec.bits, spec.d) == 1 << spec.bits:  # it takes every string to cover all
            return values.select(F.col("v").alias("l"), F.col("v").alias("c"))
        given = AnchorSet(A.covering(values, spec.bits, spec.reach, spec.seed))  # too many to draw from the universe
    else:
        given = _anchor_set(points, spec)
    how = A.way(given, values, spec.bits, spec.reach)
    near = A.looked_up(_shared(values, 1 + B.ball_size(spec.bits, spec.reach)), given, spec.bits, spec.reach) if how == "expand" and A.bitmaps(given.table) is not None else A.near(values, given, spec.bits, spec.reach, how)
    got = near.groupBy("v").agg(A.nearest().alias("m"))
    return values.join(got.hint("merge"), "v", "left").select(F.col("v").alias("l"), F.coalesce("m.c", "v").alias("c"))


def anchor_candidates(points: DataFrame, spec: Spec) -> DataFrame:
    """Each point once for every anchor within ``2d``, uncovered points among the anchors."""
    given, values = _anchor_set(points, spec), points.select("v").distinct()
    covered = A.near(values, given, spec.bits, spec.reach, A.way(given, values, spec.bits, spec.reach)).select("v").distinct()
    bare = AnchorSet(values.join(covered.hint("merge"), "v", "left_anti").select(F.col("v").alias("c")))
    reach = min(2 * spec.reach, spec.bits)
    near_given, near_bare = (A.near(points, s, spec.bits, reach, A.way(s, points, spec.bits, reach)) for s in (given, bare))
    return near_given.unionByName(near_bare).select(*points.columns, "c")


def anchor_home(points: DataFrame, anchors: DataFrame, *, bits: int = B.WORD, d: int | None = None, scan: bool | None = None) -> DataFrame:
    """Nearest anchor of each distinct value, ``(v, home, dist)``; ties go to the smaller anchor.

    With ``d``, anchors farther away do not count and values without one are
    left out. Few anchors, by a count, are scanned if that is less than the
    ball of ``d``; else each distance from 0 on is looked up for those values
    that have none yet. ``scan`` decides instead of the count.
    """
    given, values = AnchorSet(anchors.select("c").distinct()), points.select("v").distinct()
    reach = bits if d is None else min(d, bits)
    size = given.table.limit(A.SCAN_LIMIT + 1).count()
    if size <= A.SCAN_LIMIT and (size < A.SHIP_COST * (1 + B.ball_size(bits, reach)) if scan is None else scan):
        best = A.near(values, given, bits, reach, "scan").groupBy("v").agg(A.nearest().alias("m")).select("v", "m.c", "m.far")
    else:
        best = A.growing(values, given, bits, reach)
    return best.select("v", F.col("c").alias("home"), F.col("far").alias("dist"))


#: Values that one row of a home's group holds, about; larger groups are dealt to rows.
GROUP = 4_096


def _groups(home: DataFrame, spec: Spec) -> DataFrame:
    """``(c, far, ls)``: the values that sit ``far`` from their home, in rows of about ``GROUP`` at most."""
    row = F.pmod(F.xxhash64("l"), F.lit(ceil((1 + B.ball_size(spec.bits, spec.reach)) / GROUP)))
    far = B.distance(F.col("l"), F.col("c"))
    return home.groupBy("c", far.alias("far"), row.alias("row")).agg(F.collect_list("l").alias("ls")).drop("row")


@_by_value
def anchor_pairs(points: DataFrame, spec: Spec) -> DataFrame:
    """``l`` sits at its home anchor, ``far`` away; every ``r`` within ``d`` of it is a member within ``far + d``.

    Bits that never vary are left out when anchors are drawn. Only homes have
    members. They are looked up in the balls around the homes, or met in cells,
    whichever is less by count; each home brings its values along, so that the
    members, by far the most rows, need not travel to them. Where a home's ball
    holds more strings than those of its few values together, or a home has one
    value only, the values become anchors of their own.
    """
    if spec.anchors is not None:
        return _out(_anchor_pairs(points, spec), spec)
    seen = points.agg(F.bit_or("v").alias("any"), F.bit_and("v").alias("all")).first()
    varying, rest = ((seen["any"] or 0) & ~(seen["all"] or 0)), seen["all"] or 0
    packed = points.select(B.gathered(F.col("v"), varying).alias("v"))
    found = _anchor_pairs(packed, replace(spec, bits=max(1, varying.bit_count()), chunks=None))
    return _out(found.select(*[B.spread(F.col(x), varying, rest).alias(x) for x in ("l", "r")]), spec)


def _anchor_pairs(values: DataFrame, spec: Spec) -> DataFrame:
    bits, reach = spec.bits, spec.reach
    groups = kept(_groups(homes(values, spec), spec))
    around = [1 + B.ball_size(bits, min(far + reach, bits)) for far in range(reach + 1)]
    ball, size = F.get(F.array(*[F.lit(b).cast("bigint") for b in around]), F.col("far")), F.size("ls")
    seen = groups.agg(F.sum(F.least(size * F.lit(around[0]), ball)).alias("lookups"), F.count("*").alias("n")).first()
    lookups, n, held = seen["lookups"] or 0, values.count(), A.bitmaps(values, "v")
    look_up = lookups * (A.SHIP_COST if held is None else 1) <= n * seen["n"]
    own = (F.col("far") > 0) & ((size * F.lit(around[0]) < ball) if look_up else (size == 1))
    alone = groups.where(own).select(F.explode("ls").alias("c"), F.lit(0).alias("far"))
    rows = groups.where(~own).unionByName(alone.withColumn("ls", F.array("c")))
    if look_up:
        parts, met = min(cells.PARTITIONS, ceil(lookups / LOOKUPS) or 1), []
        for far in range(reach + 1):
            some = rows.where(F.col("far") == far).select("c", "ls", F.array_min("ls").alias("lowest")).repartition(parts, "c")
            met.append(balls.neighbours(some, bits, min(far + reach, bits), 0, value="c", name="v").where("v > lowest").select("v", "ls"))
        every = reduce(DataFrame.unionByName, met)
        found = every.join(values.hint("merge"), "v") if held is None else A.in_bitmaps(every, held, "v")
    else:
        found = cells.between(values, rows, B.distance(F.col("v"), F.col("c")) <= F.col("far") + reach)
    return found.select(F.col("v").alias("r"), F.explode("ls").alias("l")).where(_ordered() & _close(spec))


#: name -> (candidates, pairs)
STRATEGIES: dict[str, tuple[Step, Step]] = {
    "nested_loop": (nested_candidates, nested_pairs),
    "grid": (grid_candidates, grid_pairs),
    "ball_half": (ball_half_candidates, ball_half_pairs),
    "ball_full": (ball_full_candidates, ball_full_pairs),
    "split": (split_candidates, split_pairs),
    "anchor": (anchor_candidates, anchor_pairs),
}
