"""Relational queries: joins, ranking, de-duplication, k-sums, selection, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as op
from ..sources import table
from . import query

USER = 7


@query(f"""
WITH me AS (SELECT * FROM customer WHERE c_custkey = {USER}),
f AS (SELECT c.c_custkey AS friend FROM customer c, me WHERE c.c_nationkey = me.c_nationkey AND c.c_mktsegment = me.c_mktsegment AND c.c_custkey <> me.c_custkey),
p AS (SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT l_partkey AS product, count(*) AS cnt FROM p JOIN f ON o_custkey = friend
WHERE l_partkey NOT IN (SELECT l_partkey FROM p WHERE o_custkey = {USER}) GROUP BY l_partkey""")
def friend_purchase_rank(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    me = c.where(F.col("c_custkey") == USER).select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("user"))
    friends = c.join(F.broadcast(me), ["c_nationkey", "c_mktsegment"]).where("c_custkey <> user").select("user", F.col("c_custkey").alias("friend"))
    bought = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("product"))
    return op.purchase_rank(friends, bought, USER).orderBy(F.desc("cnt"), "product")


@query("""SELECT user_id, round(avg(value), 6) AS score FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5 GROUP BY user_id""")
def top5_avg(spark: SparkSession, d: str) -> DataFrame:
    best = op.top_n(table(spark, d, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 5)
    return best.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("score"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT reverse(p_type) FROM part UNION SELECT p_type FROM part),
k AS (SELECT word, list_aggregate(list_sort(string_split(word, '')), 'string_agg', '') AS key FROM w)
SELECT word, key FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)""")
def anagram_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    w = p.select(F.explode(F.split("p_name", " ")).alias("word")).union(p.select(F.reverse("p_type"))).union(p.select("p_type")).distinct()
    w = w.withColumn("key", op.anagram_key(F.col("word")))
    return w.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("word", "key")


CO = "SELECT DISTINCT o_custkey % 200 AS a, l_suppkey % 50 + 1000 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
EDGES = f"e AS (SELECT a AS src, b AS dst FROM ({CO}) UNION SELECT b, a FROM ({CO}))"


def co_edges(spark: SparkSession, d: str) -> DataFrame:
    """Both directions of customer group - supplier group links."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = o.select((F.col("o_custkey") % 200).alias("src"), (F.col("l_suppkey") % 50 + 1000).alias("dst")).distinct()
    return e.union(e.select("dst", "src"))


@query(f"""WITH {EDGES} SELECT DISTINCT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = x.src AND e.dst = y.dst)""")
def second_degree(spark: SparkSession, d: str) -> DataFrame:
    return op.second_degree(co_edges(spark, d))


@query("SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w HAVING count(*) > 500")
def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).where("cnt > 500")


@query("SELECT count(*) AS lines, count(DISTINCT l) AS distinct_lines FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)")
def distinct_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("l")).groupBy("l").agg(F.count("*").alias("n"))
    return lines.agg(F.sum("n").alias("lines"), F.count("*").alias("distinct_lines"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts < TIMESTAMP '2024-01-05 14:00:00'")
def log_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-05 10:00:00' AND ts < timestamp_ntz'2024-01-05 14:00:00'").select("event_id", "user_id", "event_type")


@query("SELECT p_partkey, (p_size - 25) * (p_size - 25) + (p_retailprice - 1000) * (p_retailprice - 1000) AS d2 FROM part ORDER BY d2, p_partkey LIMIT 10")
def nearest_points(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("p_size") - 25, F.col("p_retailprice") - 1000
    return table(spark, d, "part").select("p_partkey", (x * x + y * y).alias("d2")).orderBy("d2", "p_partkey").limit(10)


@query("SELECT median(p_size)::DOUBLE AS x, median(p_retailprice)::DOUBLE AS y FROM part")
def manhattan_point(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.percentile("p_size", 0.5).alias("x"), F.percentile("p_retailprice", 0.5).alias("y"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type FROM events)
SELECT a.user_id, min(abs(a.pos - b.pos)) AS distance FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' GROUP BY a.user_id""")
def word_distance(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("pos", F.row_number().over(w))
    last = lambda t: F.last(F.when(F.col("event_type") == t, F.col("pos")), ignorenulls=True).over(w)
    gap = F.when(F.col("event_type") == "click", F.col("pos") - last("error")).when(F.col("event_type") == "error", F.col("pos") - last("click"))
    return e.withColumn("gap", gap).groupBy("user_id").agg(F.min("gap").cast("long").alias("distance")).where("distance IS NOT NULL")


@query("""WITH knows AS (SELECT DISTINCT n_nationkey AS src, 3 AS dst FROM nation WHERE n_nationkey <> 3 UNION SELECT n_nationkey, n_regionkey + 10 FROM nation WHERE n_nationkey NOT IN (3, n_regionkey + 10)),
people AS (SELECT count(DISTINCT p) AS n FROM (SELECT src AS p FROM knows UNION SELECT dst FROM knows))
SELECT dst AS celebrity FROM knows, people WHERE dst NOT IN (SELECT src FROM knows) GROUP BY dst, people.n HAVING count(DISTINCT src) = people.n - 1""")
def celebrity(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    knows = n.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("src"), F.lit(3).alias("dst")).union(n.where("n_nationkey <> 3 AND n_nationkey <> n_regionkey + 10").select("n_nationkey", F.col("n_regionkey") + 10)).distinct()
    people = knows.select(F.col("src").alias("p")).union(knows.select("dst")).distinct().agg(F.count("*").alias("n"))
    known = knows.join(knows.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti").groupBy("dst").agg(F.countDistinct("src").alias("k"))
    return known.join(F.broadcast(people), F.col("k") == F.col("n") - 1).select(F.col("dst").alias("celebrity"))


@query("SELECT count(*) AS inversions FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_size > b.p_size")
def count_inversions(spark: SparkSession, d: str) -> DataFrame:
    return op.inversions(table(spark, d, "part"), "p_partkey", "p_size", 6)


@query("""SELECT a.r_regionkey, product(b.r_regionkey + 1)::DOUBLE AS others FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey GROUP BY a.r_regionkey""")
def exclusive_product(spark: SparkSession, d: str) -> DataFrame:
    """The product of all others: products before and after, which zeros don't trouble."""
    w = Window.orderBy("r_regionkey")  # one short list
    v = F.col("r_regionkey") + 1
    before = F.product(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.product(v).over(w.rowsBetween(1, Window.unboundedFollowing))
    return table(spark, d, "region").select("r_regionkey", (F.coalesce(before, F.lit(1.0)) * F.coalesce(after, F.lit(1.0))).alias("others"))


# --- distinct, k-sums ---


@query("SELECT DISTINCT p_size FROM part")
def distinct_sorted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_size").distinct()


@query("SELECT p_size, p_partkey FROM (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 2")
def keep_two(spark: SparkSession, d: str) -> DataFrame:
    return op.top_n(table(spark, d, "part"), ["p_size"], [F.asc("p_partkey")], 2).select("p_size", "p_partkey")


@query("SELECT l_suppkey % 7 AS k, min(l_partkey) AS first_part FROM lineitem GROUP BY 1")
def distinct_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("k")).agg(F.min("l_partkey").alias("first_part"))


@query("SELECT c_acctbal FROM customer GROUP BY c_acctbal HAVING count(*) = 1")
def singletons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_acctbal").agg(F.count("*").alias("n")).where("n = 1").select("c_acctbal")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'click'")
def remove_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type <> 'click'").select("event_id", "event_type")


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size HAVING count(*) % 3 <> 0")
def mod3_single(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).where("n % 3 <> 0")


@query("SELECT a.n_nationkey AS k1, b.n_nationkey AS k2, a.n_regionkey * 3 + a.n_nationkey AS v1, b.n_regionkey * 3 + b.n_nationkey AS v2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey * 3 + a.n_nationkey + b.n_regionkey * 3 + b.n_nationkey = 30")
def two_sum(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("v", F.col("n_regionkey") * 3 + F.col("n_nationkey"))
    return op.pair_sum(n, "n_nationkey", "v", 30)


NUMS = "v AS (SELECT n_nationkey AS k, n_nationkey - 12 + n_regionkey AS v FROM nation)"


def nums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select((F.col("n_nationkey") - 12 + F.col("n_regionkey")).alias("v"))


@query(f"WITH {NUMS} SELECT DISTINCT x.v AS a, y.v AS b, z.v AS c FROM v x JOIN v y ON x.k <> y.k AND x.v <= y.v JOIN v z ON z.k <> x.k AND z.k <> y.k AND y.v <= z.v WHERE x.v + y.v + z.v = 0")
def three_sum(spark: SparkSession, d: str) -> DataFrame:
    return op.three_sum(nums(spark, d), "v", 0)


@query(f"WITH {NUMS} SELECT DISTINCT x.v AS a, y.v AS b, z.v AS c, w.v AS d FROM v x JOIN v y ON x.k <> y.k AND x.v <= y.v JOIN v z ON z.k NOT IN (x.k, y.k) AND y.v <= z.v JOIN v w ON w.k NOT IN (x.k, y.k, z.k) AND z.v <= w.v WHERE x.v + y.v + z.v + w.v = 5")
def four_sum(spark: SparkSession, d: str) -> DataFrame:
    return op.four_sum(nums(spark, d), "v", 5)


@query(f"WITH {NUMS}, s AS (SELECT x.v + y.v + z.v AS s FROM v x JOIN v y ON x.k < y.k JOIN v z ON y.k < z.k) SELECT s AS closest FROM s ORDER BY abs(s - 43), s LIMIT 1")
def three_sum_closest(spark: SparkSession, d: str) -> DataFrame:
    return op.closest_three_sum(nums(spark, d), "v", 43)


@query("WITH v AS (SELECT DISTINCT floor(value)::BIGINT AS v FROM events) SELECT min(n)::BIGINT AS first_missing FROM (SELECT 1 AS n UNION ALL SELECT v + 1 FROM v WHERE v > 0) WHERE n NOT IN (SELECT v FROM v)")
def first_missing(spark: SparkSession, d: str) -> DataFrame:
    return op.first_missing(table(spark, d, "events").select(F.floor("value").alias("v")), "v")


@query("SELECT count(*) AS n FROM range(0, 40) a(m), range(0, 40) b(n) WHERE m * m + n * n < 1500")
def squares_below(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with m^2 + n^2 < N: for each m, the number of n is known, so no pair is made."""
    return spark.range(40).where("id * id < 1500").agg(F.sum(F.ceil(F.sqrt(1500 - F.col("id") * F.col("id")))).alias("n"))


@query("""WITH v AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))
SELECT v, lag(v) OVER (ORDER BY v) AS prev, lead(v) OVER (ORDER BY v) AS next FROM v""")
def available_numbers(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("v"))
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("v")).distinct().join(gone, "v", "left_anti")
    w = Window.orderBy("v")
    return v.select("v", F.lag("v").over(w).alias("prev"), F.lead("v").over(w).alias("next"))


@query("SELECT s_suppkey, (SELECT min(c_acctbal) FROM customer WHERE c_acctbal >= s_acctbal) AS at_least FROM supplier")
def smallest_remaining(spark: SparkSession, d: str) -> DataFrame:
    """As-of: the least value at or above each probe, by one sort of both sides together, in ranges."""
    probes = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"))
    return op.at_or_above(probes, "x", table(spark, d, "customer").select(F.col("c_acctbal").alias("y")), "y", "at_least").select("s_suppkey", "at_least")


# --- selection ---


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS place FROM part")
def sorted_places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.orderBy("p_retailprice", "p_partkey")).cast("long").alias("place"))


@query("SELECT c_nationkey, c_acctbal AS third FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn FROM customer) WHERE rn = 3")
def kth_smallest(spark: SparkSession, d: str) -> DataFrame:
    return op.top_n(table(spark, d, "customer"), ["c_nationkey"], [F.asc("c_acctbal"), F.asc("c_custkey")], 3).where("rn = 3").select("c_nationkey", F.col("c_acctbal").alias("third"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_heap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT n_nationkey, row_number() OVER (ORDER BY CASE n_regionkey WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, n_nationkey) AS place FROM nation")
def three_way_sort(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("n_regionkey") == 1, 0).when(F.col("n_regionkey") == 2, 1).otherwise(2)
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(code, "n_nationkey")).cast("long").alias("place"))


BOTH = "(SELECT s_acctbal AS v FROM supplier UNION ALL SELECT c_acctbal FROM customer)"


@query(f"SELECT v, row_number() OVER (ORDER BY v) AS place FROM {BOTH}")
def merge_sorted(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")).union(table(spark, d, "customer").select("c_acctbal"))
    return both.select("v", F.row_number().over(Window.orderBy("v")).cast("long").alias("place"))


@query(f"SELECT round(median(v), 6) AS median FROM {BOTH}")
def median_two(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")).union(table(spark, d, "customer").select("c_acctbal"))
    return op.median(both, "v").select(F.round("median", 6).alias("median"))


@query("""WITH s AS (SELECT p_size AS v, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS i FROM part)
SELECT t, COALESCE(min(i), -1) AS leftmost FROM range(0, 60) r(t) LEFT JOIN s ON v = t GROUP BY t""")
def left_bound(spark: SparkSession, d: str) -> DataFrame:
    below = table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    first = below.select(F.col("p_size").cast("long").alias("t"), (F.sum("n").over(Window.orderBy("p_size")) - F.col("n")).alias("i"))  # a row a distinct value
    return spark.range(60).select(F.col("id").alias("t")).join(first, "t", "left").select("t", F.coalesce("i", F.lit(-1)).alias("leftmost"))


@query("SELECT t, (SELECT count(*) FROM part WHERE p_size < t) AS below, (SELECT count(*) FROM part WHERE p_size <= t) AS upto FROM range(0, 60) r(t)")
def lower_bound(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("t")).agg(F.count("*").alias("n"))
    probes = spark.range(60).select(F.col("id").alias("t"), F.lit(0).cast("long").alias("n"))
    all_ = n.union(probes).groupBy("t").agg(F.sum("n").alias("n"))
    w = Window.orderBy("t")
    s = F.sum("n").over(w)
    return all_.select("t", (s - F.col("n")).alias("below"), s.alias("upto")).where("t < 60")


@query("""WITH a AS (SELECT list(v ORDER BY k) AS a FROM (SELECT n_nationkey AS v, (n_nationkey + 9) % 25 AS k FROM nation))
SELECT t, COALESCE(list_position(a, t::INTEGER), 0)::INTEGER - 1 AS i FROM a, range(0, 30) r(t)""")
def rotated_search(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct(((F.col("n_nationkey") + 9) % 25).alias("k"), F.col("n_nationkey").alias("v")))).alias("a"))
    return spark.range(30).crossJoin(F.broadcast(a)).select(F.col("id").alias("t"), F.expr("int(array_position(transform(a, x -> x.v), int(id)) - 1)").alias("i"))


@query("SELECT t, EXISTS (SELECT 1 FROM nation WHERE n_nationkey + 3 * n_regionkey = t) AS found FROM range(0, 50) r(t)")
def matrix_search(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "nation").select((F.col("n_nationkey") + 3 * F.col("n_regionkey")).cast("long").alias("t")).distinct().withColumn("f", F.lit(True))
    return spark.range(50).select(F.col("id").alias("t")).join(cells, "t", "left").select("t", F.coalesce("f", F.lit(False)).alias("found"))


# --- intervals ---

SESSIONS = "s AS (SELECT user_id % 10 AS g, floor(epoch(min(ts)) / 60)::BIGINT AS s, floor(epoch(min(ts)) / 60)::BIGINT + (user_id * 37) % 600 AS e FROM events GROUP BY user_id, date_trunc('day', ts))"
MERGED = """m AS (SELECT g, s, e, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {0}),
i AS (SELECT g, s, e, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
u AS (SELECT g, min(s) AS s, max(e) AS e FROM i GROUP BY g, k)"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("t"))
    s = F.floor(F.col("t") / 60)
    return e.select((F.col("user_id") % 10).alias("g"), s.alias("s"), (s + (F.col("user_id") * 37) % 600).alias("e"))


@query(f"WITH {SESSIONS}, {MERGED.format('s')} SELECT g, s, e FROM u")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return op.merge_intervals(sessions(spark, d), ["g"])


@query(f"WITH {SESSIONS}, x AS (SELECT * FROM s UNION ALL SELECT DISTINCT g, 28401120, 28411200 FROM s), {MERGED.format('x')} SELECT g, s, e FROM u")
def insert_interval(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d)
    return op.merge_intervals(s.union(s.select("g", F.lit(28401120).cast("long"), F.lit(28411200).cast("long")).distinct()), ["g"])


@query(f"WITH {SESSIONS}, {MERGED.format('s')} SELECT g, sum(e - s)::BIGINT AS covered FROM u GROUP BY g")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return op.merge_intervals(sessions(spark, d), ["g"]).groupBy("g").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))


@query("SELECT event_id, ts + INTERVAL 10 MINUTE AS ends FROM events WHERE ts <= TIMESTAMP '2024-01-03 00:00:00' AND ts + INTERVAL 10 MINUTE > TIMESTAMP '2024-01-03 00:00:00'")
def calendar_due(spark: SparkSession, d: str) -> DataFrame:
    """Events of ten minutes that are under way at one time."""
    return table(spark, d, "events").where("ts <= timestamp_ntz'2024-01-03 00:00:00' AND ts > timestamp_ntz'2024-01-02 23:50:00'").select("event_id", F.expr("ts + INTERVAL 10 MINUTES").alias("ends"))


@query("SELECT a.l_partkey AS part, min(a.l_orderkey) AS place FROM lineitem a WHERE a.l_linenumber = 1 AND a.l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 2) GROUP BY a.l_partkey")
def list_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Parts that stand first in an order and second in another, with the first order where they stand first."""
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("place"), "l_linenumber")
    return op.intersection(x.where("l_linenumber = 1"), x.where("l_linenumber = 2"), "part", "place")


@query("SELECT o_orderkey, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM orders")
def next_satisfying(spark: SparkSession, d: str) -> DataFrame:
    """For each order the customer's next one, itself included, that is filled."""
    return op.next_value(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F").select("o_orderkey", "following")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), r AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS n, unnest(x) AS line FROM l)
SELECT line, min(p).doc_id AS doc_id, min(p).n AS n FROM (SELECT line, {'doc_id': doc_id, 'n': n} AS p, doc_id, n FROM r) GROUP BY line""")
def distinct_lines(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate lines of all documents removed."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return op.first_lines(lines.select("line", "doc_id", (F.col("i") + 1).cast("long").alias("n")), "line", "doc_id", "n")


@query()
def shuffled_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return op.shuffled(lines, 11, "doc_id", "n")
