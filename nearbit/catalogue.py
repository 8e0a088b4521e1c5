"""The engine's queries over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearbit import api
from nearbit.functions import bits as B
from nearbit.operators import anchors, balls
from nearbit.operators import strategies as S
from nearbit.operators.compare import compare
from nearbit.plans import planner
from nearbit.sources import generators, readers, scratch, writers
from nearbit.sources.readers import parquet_points

Query = Callable[[SparkSession, str], DataFrame]

# name -> (table, bits or None for those of the largest value, Spark expression, DuckDB expression)
POINTS = {
    "dense": ("part", None, "p_partkey", "p_partkey"),
    "cust": ("customer", None, "c_custkey", "c_custkey"),
    "mixed": ("part", 16, "(p_partkey * 40503 + p_partkey * p_partkey * 31) % 65536", "(p_partkey * 40503 + p_partkey * p_partkey * 31) % 65536"),
    "ids32": ("customer", 32, "c_custkey", "c_custkey"),
    "by8": ("part", 16, "p_partkey * 8 % 65536", "p_partkey * 8 % 65536"),
    "lines": ("lineitem", 32, "l_orderkey * 8 + l_linenumber", "l_orderkey * 8 + l_linenumber"),
    "emb16": ("embeddings", 16, "aggregate(sequence(0, 15), 0L, (acc, i) -> acc | if(embedding[i] > 0, shiftleft(1L, i), 0L))", "list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END FOR i IN range(16)])::BIGINT"),
    "emb32": ("embeddings", 32, "aggregate(sequence(0, 31), 0L, (acc, i) -> acc | if(embedding[i] > 0, shiftleft(1L, i), 0L))", "list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END FOR i IN range(32)])::BIGINT"),
}
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, _, expr, _ = POINTS[name]
    return parquet_points(spark, f"{sf_dir}/{table}.parquet", expr).distinct()


def _sql_points(name: str) -> str:
    table, _, _, expr = POINTS[name]
    return f"SELECT DISTINCT CAST({expr} AS BIGINT) AS v FROM {table}"


def _sql_pairs(name: str, d: int) -> str:
    return f"WITH p AS ({_sql_points(name)}) SELECT a.v AS l, b.v AS r, CAST(bit_count(xor(a.v, b.v)) AS INTEGER) AS dist FROM p a JOIN p b ON a.v < b.v AND bit_count(xor(a.v, b.v)) <= {d}"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _join(name: str, points_of: str, d: int, strategy: str, **options) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return api.hamming_self_join(points(spark, sf_dir, points_of), "v", d=d, bits=POINTS[points_of][1], strategy=strategy, **options)

    _add(name, query, _sql_pairs(points_of, d))


for _d in (1, 2, 3):
    for _s in [*S.STRATEGIES, "auto"]:
        _join(f"join_{_s}_d{_d}", "mixed", _d, _s)
_join("join_split_dense", "dense", 1, "split")
_join("join_ball_half_emb32_d6", "emb32", 6, "ball_half")
_join("join_grid_emb32_d6", "emb32", 6, "grid", grid=5)
_join("join_anchor_few", "mixed", 2, "anchor", seed=3)
_join("join_anchor_dense", "dense", 2, "anchor")
_join("join_anchor_emb32_d2", "emb32", 2, "anchor")
_join("join_anchor_scan_d4", "mixed", 4, "anchor")
_join("join_ball_half_cust_d3", "cust", 3, "ball_half")
_join("join_split_reducers", "mixed", 2, "split", reducers=5)
_join("join_split_d0", "mixed", 0, "split")
_join("join_split_hot", "ids32", 1, "split", bucket=200)
_join("join_split_hot_d2", "ids32", 2, "split", bucket=150)
_join("join_auto_hot", "ids32", 1, "auto")
_join("join_auto_lines", "lines", 1, "auto")
_join("join_grid_multiples", "by8", 2, "grid", grid=6)
_join("join_split_multiples", "by8", 1, "split", chunks=tuple(B.chunk_masks(16, 2)), bucket=100)
_join("join_anchor_emb32_d6", "emb32", 6, "anchor")
_join("join_anchor_lines", "ids32", 2, "anchor")


def _bag(strategy: str, d: int = 2, name: str = "emb16", **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, bits, expr, _ = POINTS[name]
        return api.hamming_self_join(spark.read.parquet(f"{sf_dir}/{table}.parquet"), expr, d=d, bits=bits, id="vec_id", mode="bag", strategy=strategy, **options)

    return query


def _sql_bag(d: int = 2, name: str = "emb16") -> str:
    return f"WITH p AS (SELECT vec_id, CAST({POINTS[name][3]} AS BIGINT) AS v FROM embeddings) SELECT a.v AS l, b.v AS r, a.vec_id AS lid, b.vec_id AS rid, CAST(bit_count(xor(a.v, b.v)) AS INTEGER) AS dist FROM p a JOIN p b ON (a.v < b.v OR (a.v = b.v AND a.vec_id < b.vec_id)) AND bit_count(xor(a.v, b.v)) <= {d}"


for _s in S.STRATEGIES:
    _add(f"join_bag_{_s}", _bag(_s), _sql_bag())
for _s in ("split", "ball_half", "anchor"):
    _add(f"join_bag_{_s}_d0", _bag(_s, 0), _sql_bag(0))
    _add(f"join_bag_{_s}_d3", _bag(_s, 3), _sql_bag(3))
_add("join_bag_split_hot", _bag("split", 2, "emb16", bucket=3), _sql_bag())
_add("join_bag_anchor_emb32", _bag("anchor", 2, "emb32"), _sql_bag(2, "emb32"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.rendered(QUERIES["join_split_d2"](spark, sf_dir))


_add("join_rendered", _rendered, f"SELECT lpad(bin(l), 32, '0') AS l, lpad(bin(r), 32, '0') AS r FROM ({_sql_pairs('mixed', 2)})")
_add("count_pairs", lambda spark, d: writers.count_pairs(QUERIES["join_split_d3"](spark, d)), f"SELECT count(*) AS n_pairs FROM ({_sql_pairs('mixed', 3)})")
_add("hamming_histogram", lambda spark, d: QUERIES["join_split_d3"](spark, d).groupBy("dist").agg(F.count("*").alias("n")), f"SELECT dist, count(*) AS n FROM ({_sql_pairs('mixed', 3)}) GROUP BY dist")


# Communication cost


def _cost(strategy: str, d: int, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return writers.count_shipped(points(spark, sf_dir, "mixed"), strategy, S.Spec(d=d, bits=16, **options))

    return query


_n = f"(SELECT count(*) FROM ({_sql_points('mixed')}))"
_add("cost_grid", _cost("grid", 2, grid=7), f"SELECT 7 * {_n} AS n_rows")
_add("cost_split", _cost("split", 2), f"SELECT 3 * {_n} AS n_rows")
_add("cost_ball_half", _cost("ball_half", 3), f"SELECT {1 + comb(16, 1) + comb(16, 2)} * {_n} AS n_rows")
_add("cost_ball_full", _cost("ball_full", 2), f"WITH p AS ({_sql_points('mixed')}), m AS (SELECT range AS m FROM range(65536) WHERE bit_count(range) BETWEEN 1 AND 2) SELECT {_n} + (SELECT count(*) FROM p, m WHERE xor(v, m) < v) AS n_rows")


def _fixed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "mixed").where("v % 40 = 0").select(F.col("v").alias("c"))


_sql_anchors = f"p AS ({_sql_points('mixed')}), c AS (SELECT v AS c FROM p WHERE v % 40 = 0)"


def _cost_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = S.Spec(d=2, bits=16, anchors=_fixed_anchors(spark, sf_dir))
    return writers.count_shipped(points(spark, sf_dir, "mixed"), "anchor", spec)


_add("cost_anchor", _cost_anchor, f"WITH {_sql_anchors}, a AS (SELECT c FROM c UNION SELECT v FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE bit_count(xor(p.v, c.c)) <= 2)) SELECT count(*) AS n_rows FROM p, a WHERE bit_count(xor(p.v, a.c)) <= 4")
_add("anchor_home", lambda spark, d: S.anchor_home(points(spark, d, "mixed"), _fixed_anchors(spark, d)), f"WITH {_sql_anchors} SELECT v, c AS home, CAST(dist AS INTEGER) AS dist FROM (SELECT v, c, bit_count(xor(v, c)) AS dist, row_number() OVER (PARTITION BY v ORDER BY bit_count(xor(v, c)), c) AS k FROM p, c) WHERE k = 1")


def _members_of(complement: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return anchors.AnchorSet(_fixed_anchors(spark, sf_dir), complement).keep(points(spark, sf_dir, "mixed"), "v")

    return query


_add("anchor_membership", _members_of(False), f"WITH {_sql_anchors} SELECT v FROM p WHERE v IN (SELECT c FROM c)")
_add("anchor_membership_complement", _members_of(True), f"WITH {_sql_anchors} SELECT v FROM p WHERE v NOT IN (SELECT c FROM c)")


def _join_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.hamming_self_join(points(spark, sf_dir, "mixed"), "v", d=1, bits=16, strategy="anchor", anchors=_fixed_anchors(spark, sf_dir), complement=True)


_add("join_anchor_complement", _join_complement, _sql_pairs("mixed", 1))

#: Tables whose keys' largest decides the bits.
_SIZED = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey"}


def _sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the keys of each table and each distance: the anchors wanted, and those that are really drawn and held."""
    rows = []
    for name, key in _SIZED.items():
        b = api.bits_of(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)
        for d in (1, 2, 3, 4):
            made = anchors.sizing(b, d)
            rows.append((name, b, d, anchors.target(b, d), B.ball_size(b, min(2 * d, b)), made["complement"], made["held"]))
    return spark.createDataFrame(rows, "name string, bits int, d int, target long, ball long, complement boolean, held long")


_ball = "CAST((SELECT sum(factorial(CAST(b AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(b - i AS INTEGER)))) FROM range(1, {r} + 1) t(i)) AS BIGINT)"
_tops = " UNION ALL ".join(f"SELECT '{name}' AS name, length(bin(max({key}))) AS b FROM {name}" for name, key in _SIZED.items())
_add(
    "anchor_sizing",
    _sizing,
    f"WITH s AS (SELECT name, b, d, CAST(2 ** b AS BIGINT) AS u FROM ({_tops}), (VALUES (1), (2), (3), (4)) t(d)), "
    f"x AS (SELECT name, b, d, u, {_ball.format(r='least(d, b)')} AS one, {_ball.format(r='least(2 * d, b)')} AS ball FROM s), "
    "y AS (SELECT *, CAST(least(u, ceil(ln(1000 * u) * u / one)) AS BIGINT) AS target FROM x) "
    f"SELECT name, CAST(b AS INTEGER) AS bits, CAST(d AS INTEGER) AS d, target, ball, target > u // 2 OR least(target, u - target) > {anchors.DRAW_LIMIT} AS complement, CASE WHEN least(target, u - target) > {anchors.DRAW_LIMIT} THEN 0 WHEN target > u // 2 THEN u - target ELSE target END AS held FROM y",
)


# Balls, nearest anchors, bitmaps


def _ball_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many strings lie within 4 of each key, and their sum; masks come from ranks."""
    around = balls.neighbours(points(spark, sf_dir, "ids32").where("v < 2048"), 11, 5)
    return around.groupBy("v").agg(F.count("*").alias("n"), F.sum("c").alias("total"))


def _home_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's nearest order, both as scattered 24-bit strings, by growing distance."""
    held = parquet_points(spark, f"{sf_dir}/orders.parquet", "(o_orderkey * 40503 + o_orderkey * o_orderkey * 31) % 16777216")
    mine = parquet_points(spark, f"{sf_dir}/customer.parquet", "(c_custkey * 50021 + c_custkey * c_custkey * 77) % 16777216").distinct()
    return S.anchor_home(mine, held.select(F.col("v").alias("c")), bits=24, scan=False)


def _in_bitmaps(complement: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Parts' strings that are, or aren't, an order line's, looked up in bitmaps."""
        held = points(spark, sf_dir, "lines").select(F.col("v").alias("c"))
        found = anchors.bitmaps(held)
        rows = points(spark, sf_dir, "mixed")
        return anchors.in_bitmaps(rows, found, "v", complement)

    return query


_add("ball_sums", _ball_sums, f"SELECT p.v, count(*) AS n, CAST(sum(xor(v, m)) AS BIGINT) AS total FROM ({_sql_points('ids32')}) p, (SELECT range AS m FROM range(2048) WHERE bit_count(range) BETWEEN 1 AND 5) WHERE v < 2048 GROUP BY 1")
_add("anchor_home_growing", _home_growing, "WITH c AS (SELECT DISTINCT (o_orderkey * 40503 + o_orderkey * o_orderkey * 31) % 16777216 AS c FROM orders), p AS (SELECT DISTINCT (c_custkey * 50021 + c_custkey * c_custkey * 77) % 16777216 AS v FROM customer) SELECT v, m.c AS home, CAST(m.far AS INTEGER) AS dist FROM (SELECT v, min({'far': bit_count(xor(v, c)), 'c': c}) AS m FROM p, c GROUP BY v)")
_add("anchor_bitmap", _in_bitmaps(False), f"SELECT v FROM ({_sql_points('mixed')}) WHERE v IN (SELECT v FROM ({_sql_points('lines')}))")
_add("anchor_bitmap_complement", _in_bitmaps(True), f"SELECT v FROM ({_sql_points('mixed')}) WHERE v NOT IN (SELECT v FROM ({_sql_points('lines')}))")


# What the planner measures


def _plan_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.bit_counts(points(spark, sf_dir, "mixed"), 16)


_LAYOUTS = {"runs": B.chunk_masks(32, 3), "striped": [sum(1 << i for i in range(j, 32, 3)) for j in range(3)]}


def _plan_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.bucket_statistics(points(spark, sf_dir, "ids32"), _LAYOUTS)


def _plan_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What splitting is estimated to ship and to look at, by runs of bits and by bits dealt to chunks."""
    rows = []
    for name in ("ids32", "mixed", "lines"):
        stats = planner.measure(points(spark, sf_dir, name), 1, POINTS[name][1])
        rows += [(name, layout, float(stats.n), found.squares / 2) for layout, found in stats.layouts.items() if layout == "runs"]
    return spark.createDataFrame(rows, "name string, layout string, n double, candidates double")


_masks = ", ".join(f"('{name}', {j}, {m})" for name, masks in _LAYOUTS.items() for j, m in enumerate(masks))
_add("plan_bit_counts", _plan_bits, f"SELECT count(*) AS n, {', '.join(f'CAST(coalesce(sum((v >> {i}) & 1), 0) AS BIGINT) AS b{i}' for i in range(16))} FROM ({_sql_points('mixed')})")
_add("plan_buckets", _plan_buckets, f"WITH b AS (SELECT layout, j, v & m AS k, count(*) AS n FROM ({_sql_points('ids32')}), (VALUES {_masks}) t(layout, j, m) GROUP BY ALL) SELECT layout, CAST(j AS INTEGER) AS j, count(*) AS buckets, max(n) AS largest, CAST(sum(n * n) AS DOUBLE) AS squares FROM b GROUP BY layout, j")
_halves = {name: B.chunk_masks(POINTS[name][1], 2) for name in ("ids32", "mixed", "lines")}
_add("plan_split_cost", _plan_choice, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, 'runs' AS layout, (SELECT CAST(count(*) AS DOUBLE) FROM ({_sql_points(name)})) AS n, CAST(sum(n * n) / 2 AS DOUBLE) AS candidates FROM (SELECT j, v & m AS k, count(*) AS n FROM ({_sql_points(name)}), (VALUES (0, {a}), (1, {b})) t(j, m) GROUP BY ALL)" for name, (a, b) in _halves.items()) + f") WHERE n > {planner.SMALL}")


# What a run really does


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = S.Counters()
    writers.discard(S.STRATEGIES["split"][1](points(spark, sf_dir, "mixed"), S.Spec(d=2, bits=16, counters=counters)))
    return spark.createDataFrame([tuple(counters.counts().values())], "n_shipped long, n_candidates long, n_pairs long")


def _exchanged(strategy: str, keys: list[str], **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = S.STRATEGIES[strategy][0](points(spark, sf_dir, "mixed"), S.Spec(bits=16, **options))
        return writers.exchanged(got, *keys).select("n_rows")

    return query


_thirds = ", ".join(f"({j}, {m})" for j, m in enumerate(B.chunk_masks(16, 3)))
_add("join_counters", _counted, f"WITH b AS (SELECT j, v & m AS k, count(*) AS n FROM ({_sql_points('mixed')}), (VALUES {_thirds}) t(j, m) GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_shipped, CAST(sum(n * n) AS BIGINT) AS n_candidates, (SELECT count(*) FROM ({_sql_pairs('mixed', 2)})) AS n_pairs FROM b")
_add("exchange_split", _exchanged("split", ["j", "k"], d=2), f"SELECT 3 * {_n} AS n_rows")
_add("exchange_grid", _exchanged("grid", ["lo", "hi"], d=2, grid=7), f"SELECT 7 * {_n} AS n_rows")
_add("exchange_ball_half", _exchanged("ball_half", ["centre"], d=3), f"SELECT {1 + comb(16, 1) + comb(16, 2)} * {_n} AS n_rows")


# Placement


def _grid_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.grid_candidates(points(spark, sf_dir, "mixed"), S.Spec(d=2, bits=16, grid=4, residue=True))
    return got.groupBy(S.grid_cell_id().alias("cell")).agg(F.count("*").alias("n_rows"))


_add("grid_cell_load", _grid_load, f"WITH p AS ({_sql_points('mixed')}), x AS (SELECT least(v % 4, j) AS lo, greatest(v % 4, j) AS hi FROM p, range(4) t(j)) SELECT CAST(hi * (hi + 1) // 2 + lo AS INTEGER) AS cell, count(*) AS n_rows FROM x GROUP BY 1")


def _chunk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_candidates(points(spark, sf_dir, "mixed"), S.Spec(d=2, bits=16)).groupBy("j", "k").agg(F.count("*").alias("n_rows"))


_chunks = ", ".join(f"({j}, {m})" for j, m in enumerate(B.chunk_masks(16, 3)))
_add("chunk_bucket_load", _chunk_load, f"WITH p AS ({_sql_points('mixed')}) SELECT CAST(j AS INTEGER) AS j, v & m AS k, count(*) AS n_rows FROM p, (VALUES {_chunks}) t(j, m) GROUP BY 1, 2")


def _reducer_load(rows: Query, placed: Callable[[], Column]) -> Query:
    return lambda spark, d: rows(spark, d).groupBy(placed().alias("reducer")).agg(F.count("*").alias("n_rows"))


_add("placement_by_value", _reducer_load(lambda s, d: points(s, d, "emb32"), lambda: B.reducer_of_value("v", 7)), f"WITH p AS ({_sql_points('emb32')}) SELECT CAST(abs(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END) % 7 AS INTEGER) AS reducer, count(*) AS n_rows FROM p GROUP BY 1")
_add("placement_by_cell", _reducer_load(lambda s, d: S.grid_candidates(points(s, d, "mixed"), S.Spec(d=2, bits=16, grid=4, residue=True)), lambda: F.pmod(S.grid_cell_id(), F.lit(7)).cast("int")), f"WITH p AS ({_sql_points('mixed')}), x AS (SELECT least(v % 4, j) AS lo, greatest(v % 4, j) AS hi FROM p, range(4) t(j)) SELECT CAST((hi * (hi + 1) // 2 + lo) % 7 AS INTEGER) AS reducer, count(*) AS n_rows FROM x GROUP BY 1")
_add("placement_by_pair", _reducer_load(lambda s, d: _one(s, d), lambda: B.reducer_of_pair("l", "r", 7)), f"SELECT CAST((l % 7 + r % 7) % 7 AS INTEGER) AS reducer, count(*) AS n_rows FROM ({_sql_pairs('mixed', 1)}) GROUP BY 1")


# Comparison


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["join_split_d1"](spark, sf_dir)


def _compare_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _one(spark, sf_dir).select("l", "r"), QUERIES["join_ball_half_d2"](spark, sf_dir).select("l", "r")
    twice = a.where("l % 5 = 0").select(F.col("r").alias("l"), F.col("l").alias("r"))
    return compare(a.union(twice), b)


_d1, _d2 = (f"SELECT l, r FROM ({_sql_pairs('mixed', d)})" for d in (1, 2))
_sql_diff = """
, c AS (SELECT coalesce(x.l, y.l) AS l, coalesce(x.r, y.r) AS r, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b
  FROM (SELECT l, r, count(*) AS n FROM one GROUP BY 1, 2) x FULL JOIN (SELECT l, r, count(*) AS n FROM two GROUP BY 1, 2) y ON x.l = y.l AND x.r = y.r)
SELECT 'missing_in_second' AS kind, l, r, a AS n FROM c WHERE b = 0
UNION ALL SELECT 'missing_in_first', l, r, b FROM c WHERE a = 0
UNION ALL SELECT 'duplicate_in_first', l, r, a FROM c WHERE a > 1
UNION ALL SELECT 'duplicate_in_second', l, r, b FROM c WHERE b > 1
"""
_add("compare_diff", _compare_diff, f"WITH d1 AS ({_d1}), one AS (SELECT * FROM d1 UNION ALL SELECT * FROM d1 WHERE l % 5 = 0), two AS ({_d2}) {_sql_diff}")


def _compare_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(_one(spark, sf_dir), QUERIES["join_ball_full_d1"](spark, sf_dir))


_add("compare_equal", _compare_equal, f"WITH one AS ({_d1}), two AS ({_d1}) {_sql_diff}")
_add("compare_equal_count", lambda spark, d: _compare_equal(spark, d).agg(F.count("*").alias("n_differences")), "SELECT CAST(0 AS BIGINT) AS n_differences")

# Generators and representation


def _sql_scatter(bits: int, seed: int, ids: str) -> str:
    x, whole = "range", 1 << bits
    steps = []
    for k, m in enumerate(B.SCATTER):
        steps.append(f"SELECT xor(y, y >> {(bits + 1) // 2}) AS x{k} FROM (SELECT (({x} + {(seed * (2 * k + 1) + k) % whole}) * {m}) % {whole} AS y FROM {ids})")
        x, ids = f"x{k}", f"({steps[-1]})"
    return f"SELECT {x} AS v FROM {ids}"


_keys10 = "SELECT p_partkey & 1023 AS v, count(*) AS n FROM part GROUP BY 1"


def _parts10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_points(spark, f"{sf_dir}/part.parquet", "p_partkey & 1023").groupBy("v").agg(F.count("*").alias("n"))


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of 10 bits, and how many parts have it as their key's end."""
    return generators.universe_full(spark, 10).join(_parts10(spark, sf_dir), "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n_parts"))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of one string in eight, and whether the data have it."""
    have = points(spark, sf_dir, "mixed").withColumn("taken", F.lit(True))
    return generators.universe_sample(spark, 16, 8, seed=42).join(have, "v", "left").select("v", F.coalesce("taken", F.lit(False)).alias("taken"))


def _universe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the whole universe of which the data have the smaller string."""
    pairs = api.hamming_self_join(generators.universe_full(spark, 10), "v", d=2, bits=10, strategy="ball_half")
    return pairs.join(_parts10(spark, sf_dir).select(F.col("v").alias("l")), "l", "left_semi").select("l", "r", "dist")


_add("universe_full_b10", _universe, f"SELECT range AS v, coalesce(n, 0) AS n_parts FROM range(1024) LEFT JOIN ({_keys10}) ON v = range")
_add("universe_sample", _sample, f"SELECT s.v, p.v IS NOT NULL AS taken FROM ({_sql_scatter(16, 42, 'range(8192)')}) s LEFT JOIN ({_sql_points('mixed')}) p ON s.v = p.v")
_add("universe_pairs_b10", _universe_pairs, f"SELECT a.range AS l, b.range AS r, CAST(bit_count(xor(a.range, b.range)) AS INTEGER) AS dist FROM range(1024) a, range(1024) b WHERE a.range < b.range AND bit_count(xor(a.range, b.range)) <= 2 AND a.range IN (SELECT v FROM ({_keys10}))")


def _sequence_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch.folder(spark)}/points"
    writers.write_sequence(points(spark, sf_dir, "emb32"), path)
    return readers.sequence_points(spark, path)


def _text_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch.folder(spark)}/pairs"
    writers.write_text(QUERIES["join_grid_emb32_d6"](spark, sf_dir), path)
    return readers.text_pairs(spark, path)


def _anchor_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch.folder(spark)}/anchors"
    writers.write_sequence(_fixed_anchors(spark, sf_dir).select(F.col("c").alias("v")), path)
    return api.hamming_self_join(points(spark, sf_dir, "mixed"), "v", d=2, bits=16, strategy="anchor", anchors=readers.anchor_table(spark, path))


def _compare_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark)
    writers.write_text(_one(spark, sf_dir), f"{path}/one")
    writers.write_text(QUERIES["join_ball_half_d2"](spark, sf_dir), f"{path}/two")
    return compare(readers.text_pairs(spark, f"{path}/one"), readers.text_pairs(spark, f"{path}/two"), reducers=6)


_add("sequence_round_trip", _sequence_trip, _sql_points("emb32"))
_add("text_round_trip", _text_trip, f"SELECT l, r FROM ({_sql_pairs('emb32', 6)})")
_add("join_anchor_from_file", _anchor_file, _sql_pairs("mixed", 2))
_add("compare_files", _compare_files, f"WITH one AS ({_d1}), two AS ({_d2}) {_sql_diff}")


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return points(spark, sf_dir, "emb32").select("v", B.to_int32(v).alias("signed"), B.render(v).alias("text"), B.parse(B.render(v)).alias("parsed"), B.from_int32(B.to_int32(v)).alias("back"))


_add("bits_round_trip", _signed, f"WITH p AS ({_sql_points('emb32')}) SELECT v, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INTEGER) AS signed, lpad(bin(v), 32, '0') AS text, v AS parsed, v AS back FROM p")
