"""Queries of numeric functions, generators and puzzles."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as fn
from ..functions.strings import by_row
from ..operators import puzzles
from ..sources import table
from . import query


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_orderkey + l_partkey AS total, l_partkey * l_suppkey AS product, (l_partkey - 1000) // (l_suppkey + 1) AS ratio FROM lineitem")
def bit_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_orderkey + l_partkey AS total", "l_partkey * l_suppkey AS product", "(l_partkey - 1000) div (l_suppkey + 1) AS ratio")


@query("SELECT o_orderkey, floor(sqrt(o_orderkey))::BIGINT AS root, power(1.0 + o_orderkey / 100000.0, -3) AS cube FROM orders")
def roots_and_powers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.floor(F.sqrt(k)).alias("root"), F.pow(1.0 + k / 100000.0, F.lit(-3)).alias("cube"))


@query("SELECT o_orderkey, list_sum(list_transform(range(0, 32), lambda i: ((o_orderkey >> i) & 1) << (31 - i)))::BIGINT AS reversed FROM orders")
def reverse_bits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.reverse_bits("o_orderkey").alias("reversed"))


@query("SELECT p AS nth_prime, row_number() OVER (ORDER BY p) AS n FROM range(2, 600) r(p) WHERE NOT EXISTS (SELECT 1 FROM range(2, 30) f(x) WHERE x < p AND p % x = 0)")
def nth_prime(spark: SparkSession, d: str) -> DataFrame:
    """A sieve: numbers without those that are multiples."""
    n = spark.range(2, 600).select(F.col("id").alias("p"))
    multiples = spark.range(2, 25).select(F.explode(F.expr("sequence(2 * id, 599L, id)")).alias("p"))
    primes = n.join(multiples, "p", "left_anti")
    return primes.select(F.col("p").alias("nth_prime"), F.row_number().over(Window.orderBy("p")).cast("long").alias("n"))


@query("SELECT o_orderkey, list_transform(range(0, 8), lambda i: ((o_orderkey >> (8 * (7 - i))) & 255)::INTEGER) AS bytes FROM orders")
def long_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.bytes_of("o_orderkey").alias("bytes"))


@query("""WITH p AS (SELECT s_suppkey AS k, s_suppkey % 10 AS x, (s_suppkey * 7) % 13 AS y FROM supplier),
l AS (SELECT a.k, CASE WHEN b.x = a.x THEN NULL ELSE (b.y - a.y)::DOUBLE / (b.x - a.x) END AS slope, count(*) AS n FROM p a JOIN p b ON a.k <> b.k GROUP BY ALL) SELECT max(n) + 1 AS most FROM l""")
def most_collinear(spark: SparkSession, d: str) -> DataFrame:
    """Points on one line: by anchor and slope (in lowest terms of its float), the anchor itself counted. Rows at one place are one point with
    a count, so pairs are of places (of which these have at most 130); rows of the anchor's own key are no others."""
    keys = table(spark, d, "supplier").where("s_suppkey IS NOT NULL").groupBy("s_suppkey").agg(F.count("*").alias("own")).selectExpr("s_suppkey % 10 AS x", "(s_suppkey * 7) % 13 AS y", "own")
    kinds = keys.groupBy("x", "y", "own").agg(F.sum("own").alias("n"))
    a, b = kinds.selectExpr("x AS x1", "y AS y1", "own").distinct(), kinds.groupBy("x", "y").agg(F.sum("n").alias("n"))
    others = F.expr("own * (n - if(x = x1 AND y = y1, own, 0))")
    lines = a.crossJoin(b).groupBy("x1", "y1", "own", F.expr("if(x = x1, null, double(y - y1) / (x - x1))").alias("slope")).agg(F.sum(others).alias("n"))
    return lines.where("n > 0").agg((F.max("n") + 1).alias("most"))


@query("WITH RECURSIVE c(n, c) AS (SELECT 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, c * 2 * (2 * n + 1) // (n + 2) FROM c WHERE n < 30) SELECT n, c FROM c")
def catalan(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(31).select(F.col("id").alias("n"), fn.catalan("id").alias("c"))


@query("SELECT k, list_transform(range(0, k + 1), lambda i: round(factorial(k::INTEGER) / (factorial(i::INTEGER) * factorial((k - i)::INTEGER)))::BIGINT) AS row FROM range(0, 20) r(k)")
def pascal_row(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(20).select(F.col("id").alias("k"), fn.pascal_row("id").alias("row"))


@query()
def coin_flips(spark: SparkSession, d: str) -> DataFrame:
    """Tails before the first head, over seeded trials."""
    return spark.range(0, 100_000, 1, 8).select(F.floor(F.log(1 - F.rand(11)) / F.log(F.lit(0.5))).alias("tails")).agg(F.sum("tails").alias("tails"), F.count("*").alias("trials"))


@query("SELECT m, ((m & (m - 1)) % 3)::INTEGER AS source, (((m | (m - 1)) + 1) % 3)::INTEGER AS target FROM range(1, 1024) r(m)")
def hanoi_moves(spark: SparkSession, d: str) -> DataFrame:
    """Move m of a tower needs no other move: its pegs are in its bits."""
    return spark.range(1, 1024).selectExpr("id AS m", "int((id & (id - 1)) % 3) AS source", "int(((id | (id - 1)) + 1) % 3) AS target")


@query("SELECT n AS switch, count(*) % 2 = 1 AS is_on FROM range(1, 201) a(n), range(1, 201) b(p) WHERE n % p = 0 GROUP BY n")
def light_switches(spark: SparkSession, d: str) -> DataFrame:
    presses = spark.range(1, 201).select(F.explode(F.expr("sequence(id, 200L, id)")).alias("switch"))
    return presses.groupBy("switch").agg((F.count("*") % 2 == 1).alias("is_on"))


@query("""WITH p AS (SELECT s_suppkey AS k, s_suppkey % 20 AS x, s_suppkey * 3 % 17 AS y FROM supplier), e(x1, y1, x2, y2) AS (VALUES (2, 1, 15, 3), (15, 3, 12, 14), (12, 14, 4, 12), (4, 12, 2, 1))
SELECT k, bool_and((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0) AS inside FROM p, e GROUP BY k""")
def in_polygon(spark: SparkSession, d: str) -> DataFrame:
    corners = [(2, 1), (15, 3), (12, 14), (4, 12)]
    sides = [f"({c[0]} - {a[0]}) * (y - {a[1]}) - ({c[1]} - {a[1]}) * (x - {a[0]}) >= 0" for a, c in zip(corners, corners[1:] + corners[:1])]
    return table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_suppkey % 20 AS x", "s_suppkey * 3 % 17 AS y").selectExpr("k", f"{' AND '.join(sides)} AS inside")


# --- generators ---


@query("SELECT a, b, c FROM range(0, 4) x(a), range(0, 9) y(b), range(0, 18) z(c) WHERE 5 * a + 2 * b + c = 17")
def coin_change(spark: SparkSession, d: str) -> DataFrame:
    """Ways to pay 17 in coins of 5, 2 and 1: one row a way, built coin by coin from what is left."""
    w = spark.range(1).select(F.lit(17).alias("left"))
    for name, coin in (("a", 5), ("b", 2)):
        w = w.withColumn(name, F.explode(F.expr(f"sequence(0, left div {coin})"))).withColumn("left", F.col("left") - coin * F.col(name))
    return w.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("left").cast("long").alias("c"))


@query()
def combination_sum(spark: SparkSession, d: str) -> DataFrame:
    combos = by_row(lambda t: puzzles.combinations([2, 3, 6, 7], t), "array<array<int>>")
    return spark.range(1, 31).select(F.col("id").alias("target"), F.explode(combos("id")).alias("members"))


@query("SELECT DISTINCT a.i AS a, b.i AS b, c.i AS c FROM (VALUES (1, 1), (2, 1), (3, 2)) a(k, i), (VALUES (1, 1), (2, 1), (3, 2)) b(k, i), (VALUES (1, 1), (2, 1), (3, 2)) c(k, i) WHERE a.k <> b.k AND a.k <> c.k AND b.k <> c.k")
def permutations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orders of a multiset."""
    rows = spark.createDataFrame([([1, 1, 2],)], "v array<int>")
    orders = by_row(lambda v: [list(p) for p in sorted(set(itertools.permutations(v)))], "array<array<int>>")
    return rows.select(F.explode(orders("v")).alias("p")).selectExpr("p[0] AS a", "p[1] AS b", "p[2] AS c")


@query()
def subsets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sub-multisets: for every value a number of copies."""
    rows = table(spark, d, "nation").where("n_nationkey < 8").agg(F.array_sort(F.collect_list("n_regionkey")).alias("v"))
    return rows.select(F.explode(by_row(lambda v: puzzles.sub_multisets(list(v)), "array<array<int>>")("v")).alias("members"))


QUEENS = """WITH RECURSIVE q(n, p) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT n + 1, list_append(p, c) FROM q, range(0, 6) r(c) WHERE n < 6 AND len(list_filter(p, lambda x, i: x = c OR abs(x - c) = n + 1 - i)) = 0) SELECT p AS queens FROM q WHERE n = 6"""


@query(QUEENS)
def queens(spark: SparkSession, d: str) -> DataFrame:
    """Boards row by row: each step extends all partial boards by the columns that no queen attacks."""
    n = 6
    boards = spark.range(1).select(F.expr("cast(array() as array<bigint>)").alias("queens"))
    for row in range(n):
        boards = boards.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        boards = boards.where(f"NOT exists(transform(queens, (q, i) -> q = c OR abs(q - c) = {row} - i), x -> x)").select(F.array_append("queens", F.col("c")).alias("queens"))
    return boards


SUDOKU = "53..7....6..195....98....6.8...6...34..8.3..17...2...6.6....28....419..5....8..79"


@query()
def sudoku_solve(spark: SparkSession, d: str) -> DataFrame:
    boards = spark.createDataFrame([(0, SUDOKU), (1, "11" + "." * 79)], "id int, board string")
    return boards.select("id", by_row(lambda b: puzzles.solve_sudoku(b) or "none", "string")("board").alias("solved"))


@query()
def sudoku_check(spark: SparkSession, d: str) -> DataFrame:
    """No value twice in a row, column or box."""
    boards = spark.createDataFrame([(0, SUDOKU), (1, "11" + "." * 79)], "id int, board string")
    cells = boards.select("id", F.posexplode(F.split("board", "")).alias("i", "v")).where("v BETWEEN '1' AND '9'")
    units = cells.select("id", "v", F.explode(F.expr("array(concat('r', i div 9), concat('c', i % 9), concat('b', i div 27, i % 9 div 3))")).alias("u"))
    twice = units.groupBy("id", "u", "v").agg(F.count("*").alias("n")).groupBy("id").agg(F.max("n").alias("most"))
    return boards.join(twice, "id", "left").select("id", (F.coalesce("most", F.lit(0)) <= 1).alias("valid"))


@query()
def sliding_puzzle(spark: SparkSession, d: str) -> DataFrame:
    """Shortest moves by breadth: each round is the boards one move on, without those seen."""
    rows = spark.createDataFrame([("123456078",), ("123056478",), ("412053786",)], "board string")
    return rows.select("board", by_row(puzzles.slide, "int")("board").alias("moves"))


@query()
def twenty_four(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey", "array(p_size % 13 + 1, p_partkey % 13 + 1, p_partkey % 7 + 1, p_size % 5 + 1) AS v")
    return p.select("p_partkey", by_row(lambda v: puzzles.reaches([int(x) for x in v], 24), "boolean")(F.when(~F.exists("v", lambda x: x.isNull()), F.col("v"))).alias("ok"))


@query()
def grid_games(spark: SparkSession, d: str) -> DataFrame:
    """Largest rectangle of ones and largest X of ones in 0/1 grids seven wide, of all parts of a group; a last row is filled up with zeros."""
    g = table(spark, d, "part").groupBy((F.col("p_partkey") % 40).alias("g")).agg(F.expr("transform(array_sort(collect_list(struct(p_partkey, p_size))), x -> int(x.p_size % 3 > 0))").alias("v"))
    one = lambda f: by_row(lambda v: f([[*map(int, v[i : i + 7]), *[0] * (i + 7 - len(v))] for i in range(0, len(v), 7)]), "int")
    return g.select("g", one(puzzles.ones_rectangle)("v").alias("rectangle"), one(puzzles.ones_cross)("v").alias("cross"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey::HUGEINT + (2147483648 - l_partkey)::HUGEINT + (2147483647::HUGEINT + l_suppkey) * 2147483648 + 2 * l_orderkey::HUGEINT * 2147483648 * 2147483648 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, [(t % 2147483648)::BIGINT, ((t // 2147483648) % 2147483648)::BIGINT, (t // 2147483648 // 2147483648)::BIGINT] AS digits FROM t""")
def big_addition(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of three digits in base 2^31 that carry, the least digit first."""
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "array(l_partkey, 2147483647L, l_orderkey) AS a", "array(2147483648L - l_partkey, l_suppkey, l_orderkey) AS b")
    return x.select("l_orderkey", "l_linenumber", fn.add_digits("a", "b").alias("digits"))


@query("SELECT o_orderkey, (('1' || repeat(o_orderkey::VARCHAR, 3) || repeat('9', (o_orderkey % 5)::INT))::HUGEINT + 1)::VARCHAR AS next FROM orders")
def big_increment(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").selectExpr("o_orderkey", "concat('1', repeat(string(o_orderkey), 3), repeat('9', int(o_orderkey % 5))) AS s")
    return x.select("o_orderkey", fn.plus_one("s").alias("next"))
