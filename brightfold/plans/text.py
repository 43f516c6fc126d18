"""Queries of string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as fn
from ..sources import table
from . import query


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b", F.levenshtein("a", "b").alias("distance"))


@query("""WITH m AS (SELECT p_type AS t, min(p_name) AS lo, max(p_name) AS hi FROM part WHERE p_name LIKE 's%' GROUP BY p_type)
SELECT t, substr(lo, 1, (SELECT count(*) FROM range(1, 50) r(i) WHERE i <= length(lo) AND substr(lo, 1, i) = substr(hi, 1, i))::BIGINT) AS prefix FROM m""")
def longest_common_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_name LIKE 's%'").groupBy(F.col("p_type").alias("t")).agg(fn.common_prefix(F.col("p_name")).alias("prefix"))


@query("SELECT doc_id, length(list_extract(string_split(rtrim(text, ' '), ' '), -1))::INTEGER AS n FROM documents")
def last_word_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.last_word_length(F.col("text")).alias("n"))


@query("SELECT p_partkey, replace(p_name, ' ', '%20') AS url FROM part")
def escape_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.escape_spaces(F.col("p_name")).alias("url"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents), n AS (SELECT w, lower(regexp_replace(w, '[^0-9A-Za-z]', '', 'g')) AS n FROM w) SELECT w FROM n WHERE n = reverse(n)""")
def palindromes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct().where(fn.is_palindrome(F.col("w")))


@query("SELECT doc_id, instr(text, 'token')::INTEGER AS place, substr(text, instr(text, 'token'), 20) AS found FROM documents WHERE contains(text, 'token')")
def find_substring(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", "token")
    return table(spark, d, "documents").where(F.col("text").contains("token")).select("doc_id", at.alias("place"), F.substring("text", at, F.lit(20)).alias("found"))


@query("SELECT p_partkey, bool_or(contains(p_name, q)) AS has FROM part, (VALUES ('ring'), ('red w'), ('zz')) t(q) GROUP BY p_partkey")
def ngram_index(spark: SparkSession, d: str) -> DataFrame:
    """Membership by an index of n-grams: grams of each name of the probes' lengths, semi-joined by value."""
    probes = spark.createDataFrame([("ring",), ("red w",), ("zz",)], "q string")
    grams = table(spark, d, "part").select("p_partkey", F.explode(F.expr("flatten(transform(array(2, 4, 5), n -> if(length(p_name) < n, cast(array() as array<string>), transform(sequence(1, length(p_name) - n + 1), i -> substr(p_name, i, n)))))")).alias("q"))
    hit = grams.join(F.broadcast(probes), "q", "left_semi").select("p_partkey").distinct().withColumn("h", F.lit(True))
    return table(spark, d, "part").select("p_partkey").join(hit, "p_partkey", "left").select("p_partkey", F.coalesce("h", F.lit(False)).alias("has"))


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_name, 's.*l.? r*ing.*')")
def full_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(fn.full_regex(F.col("p_name"), "s.*l.? r*ing.*")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name GLOB 'r?d *g*'")
def wildcard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(fn.wildcard(F.col("p_name"), "r?d *g*")).select("p_partkey")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_name AS a, p_type AS b, CASE WHEN p_partkey % 2 = 0 THEN p_name || p_type ELSE reverse(p_name) || p_type END AS c FROM part),
w(k, a, b, c, i, j) AS (SELECT k, a, b, c, 0::BIGINT, 0::BIGINT FROM p UNION SELECT k, a, b, c, i + x, j + 1 - x FROM w, range(0, 2) r(x)
WHERE (x = 1 AND i < length(a) AND substr(a, i + 1, 1) = substr(c, i + j + 1, 1)) OR (x = 0 AND j < length(b) AND substr(b, j + 1, 1) = substr(c, i + j + 1, 1)))
SELECT k, bool_or(i = length(a) AND j = length(b)) AS woven FROM w GROUP BY k""")
def interleaves(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", "p_type")).otherwise(F.concat(F.reverse("p_name"), "p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), fn.by_row(fn.interleaves, "boolean")("p_name", "p_type", c).alias("woven"))


@query("""SELECT p_partkey, len(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 1) = 'e'))::BIGINT AS ways FROM part""")
def distinct_subsequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.by_row(fn.distinct_subsequences, "long")("p_name", F.lit("e")).alias("ways"))


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS s FROM orders),
w(k, s, i, n) AS (SELECT k, s, 0::BIGINT, 1::BIGINT FROM s UNION ALL SELECT k, s, i + x, n FROM w, range(1, 3) r(x) WHERE i + x <= length(s) AND substr(s, i + 1, 1) <> '0' AND (x = 1 OR substr(s, i + 1, 2) <= '26'))
SELECT s.k, count(w.k) AS ways FROM s LEFT JOIN w ON w.k = s.k AND w.i = length(w.s) GROUP BY s.k""")
def decode_ways(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("s"))
    return o.select("k", fn.decodings("s").alias("ways"))


@query()
def encode_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.by_row(fn.encode_runs, "string")(F.concat(F.col("o_orderkey").cast("string"), F.lit("xx"), F.col("o_orderpriority"))).alias("runs"))


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS k, p_name AS s FROM part), c AS (SELECT k, i, substr(s, i, 1) AS c FROM s, range(1, 60) r(i) WHERE i <= length(s)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY k, c ORDER BY i) AS g FROM c), r AS (SELECT k, c, g, min(i) AS i, count(*) AS n FROM g GROUP BY ALL)
SELECT k, string_agg(CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END || c, '' ORDER BY i) AS runs FROM r GROUP BY k""")
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), fn.run_lengths("p_name").alias("runs"))


@query()
def justify_text(spark: SparkSession, d: str) -> DataFrame:
    lines = fn.by_row(lambda t: fn.justify(t.split(), 40), "array<string>")
    return table(spark, d, "benchmark").select("item_id", F.posexplode(lines("text")).alias("line_no", "line"))


@query()
def simplify_path(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").withColumn("p", F.concat(F.regexp_extract("url", "//[^/]+(/[^?]*)", 1), F.lit("/./x//../y")))
    return p.select("page_id", fn.simplify_path("p").alias("path"))


@query("""WITH s AS (SELECT c_custkey AS k, (25525511100 + c_custkey * 37)::VARCHAR AS s FROM customer),
q AS (SELECT k, substr(s, 1, a) AS p1, substr(s, a + 1, b) AS p2, substr(s, a + b + 1, c) AS p3, substr(s, a + b + c + 1) AS p4 FROM s, range(1, 4) x(a), range(1, 4) y(b), range(1, 4) z(c))
SELECT k, p1 || '.' || p2 || '.' || p3 || '.' || p4 AS ip FROM q WHERE length(p4) BETWEEN 1 AND 3 AND p1::INT::VARCHAR = p1 AND p2::INT::VARCHAR = p2 AND p3::INT::VARCHAR = p3 AND p4::INT::VARCHAR = p4 AND greatest(p1::INT, p2::INT, p3::INT, p4::INT) < 256""")
def restore_ip(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.lit(25525511100) + F.col("c_custkey") * 37).cast("string").alias("s"))
    for x in "abc":
        s = s.withColumn(x, F.explode(F.sequence(F.lit(1), F.lit(3))))
    parts = s.select("k", F.expr("array(substr(s, 1, a), substr(s, a + 1, b), substr(s, a + b + 1, c), substr(s, a + b + c + 1))").alias("p"))
    return parts.where("forall(p, x -> x rlike '^(0|[1-9][0-9]{0,2})$' AND int(x) < 256)").select("k", F.array_join("p", ".").alias("ip"))


@query("SELECT o_orderkey, (o_orderkey::HUGEINT * 123456789012345678 * 987654321)::VARCHAR AS product FROM orders")
def multiply_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.by_row(lambda a, b: str(int(a) * int(b)), "string")(F.col("o_orderkey").cast("string"), F.lit(str(123456789012345678 * 987654321))).alias("product"))


@query("""WITH s AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS s FROM part WHERE NOT regexp_matches(p_partkey::VARCHAR, '[89]')),
n AS (SELECT k, list_sum(list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1)::BIGINT * (8 ^ (length(s) - i))::BIGINT))::BIGINT AS n FROM s)
SELECT k, CASE WHEN n = 0 THEN '' ELSE lower(to_hex(n)) END AS hex FROM n""")
def octal_to_hex(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where(~F.col("p_partkey").cast("string").rlike("[89]"))
    return p.select(F.col("p_partkey").alias("k"), fn.octal_to_hex(F.col("p_partkey").cast("string")).alias("hex"))


EXCEL = """WITH RECURSIVE c(k, n, s) AS (SELECT o_orderkey, o_orderkey + 1, '' FROM orders UNION ALL SELECT k, (n - 1) // 26, chr((65 + (n - 1) % 26)::INTEGER) || s FROM c WHERE n > 0) SELECT k, s AS col FROM c WHERE n = 0"""


@query(EXCEL)
def excel_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), fn.excel_column("o_orderkey + 1").alias("col"))


@query("SELECT o_orderkey AS k, o_orderkey + 1 AS n FROM orders")
def excel_number(spark: SparkSession, d: str) -> DataFrame:
    c = excel_column(spark, d)
    return c.select("k", fn.excel_number("col").alias("n"))


@query()
def repeating_decimal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.by_row(fn.repeating_decimal, "string")("p_size", F.col("p_partkey") % 97 + 1).alias("decimal"))


@query("""SELECT event_id, lpad(bin(floor((value / 500) * 1024)::BIGINT), 10, '0') AS bits FROM events""")
def binary_fraction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.binary_fraction(F.col("value") / 500).alias("bits"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_partkey + l_suppkey * l_linenumber - l_orderkey AS result FROM lineitem")
def evaluate(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("%d+%d*%d-%d", "l_partkey", "l_suppkey", "l_linenumber", "l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", fn.by_row(fn.evaluate, "long")(text).alias("result"))


@query("""SELECT n_nationkey AS k, lpad(bin(x), 5, '0') AS bits FROM nation, range(0, 32) r(x) WHERE lpad(bin(x), 5, '0') LIKE replace(lpad(bin(n_nationkey), 5, '0'), '1', '_')""")
def expand_bits(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_replace(F.lpad(F.bin("n_nationkey"), 5, "0"), "1", "?")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(fn.by_row(fn.expand_bits, "array<string>")(p)).alias("bits"))


@query("WITH p AS (SELECT x FROM range(0, 2000000) r(x) WHERE x::VARCHAR = reverse(x::VARCHAR)) SELECT o_orderkey AS k, x AS next FROM orders ASOF JOIN p ON x > o_orderkey")
def next_palindrome(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), fn.by_row(fn.next_palindrome, "long")("o_orderkey").alias("next"))


@query()
def word_in_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("g")).agg(F.array_sort(F.collect_list("p_name")).alias("grid"))
    return rows.select("g", fn.by_row(lambda g: fn.word_in_grid(list(g), "ring"), "boolean")("grid").alias("found"))


@query()
def ordered_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", fn.by_row(fn.ordered_window, "int")("text", F.lit("thre")).alias("n"))


@query()
def palindrome_partitions(spark: SparkSession, d: str) -> DataFrame:
    cuts = fn.by_row(fn.palindrome_cuts, "int")
    ways = fn.by_row(lambda s: str(fn.palindrome_ways(s)), "string")  # as text: it can double with every character
    return table(spark, d, "part").select("p_partkey", cuts("p_type").alias("cuts"), ways("p_type").alias("ways"))


@query()
def remove_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.by_row(lambda s: fn.without_digits(s, 2), "string")((F.col("o_orderkey") + 10000).cast("string")).alias("least"))


@query("SELECT word, list_extract(list_filter(string_split(word, ''), lambda c: length(word) - length(replace(word, c, '')) = 1), 1) AS first FROM (SELECT DISTINCT p_name AS word FROM part)")
def first_single(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("word")).distinct().select("word", fn.first_single("word").alias("first"))


@query("SELECT p_partkey + 1 AS n, p_partkey + 1 AS back FROM part")
def roman_numerals(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("n"), fn.roman("p_partkey + 1").alias("r"))
    return r.select("n", fn.roman_number("r").cast("long").alias("back"))


@query("SELECT o_orderkey, ('99999999999999999999' || o_orderkey::VARCHAR)::HUGEINT + 1 AS x, ((('99999999999999999999' || o_orderkey::VARCHAR)::HUGEINT + 1)::VARCHAR) AS plus FROM orders".replace(" ('99999999999999999999' || o_orderkey::VARCHAR)::HUGEINT + 1 AS x,", ""))
def big_plus_one(spark: SparkSession, d: str) -> DataFrame:
    big = F.concat(F.lit("9" * 20), F.col("o_orderkey").cast("string")).cast("decimal(38,0)")
    return table(spark, d, "orders").select("o_orderkey", (big + 1).cast("string").alias("plus"))


@query()
def word_break(spark: SparkSession, d: str) -> DataFrame:
    words = set("small red blue large ring widget bolt gear green".split())
    return table(spark, d, "part").select("p_partkey", fn.by_row(lambda s: fn.word_breaks(s, words), "boolean")(F.replace("p_name", F.lit(" "), F.lit(""))).alias("ok"))


@query("SELECT p_partkey FROM part WHERE p_name IN ('red ring', 'small ring', 'blue bolt') OR starts_with(p_name, 'large')")
def trie_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_name").isin("red ring", "small ring", "blue bolt") | F.col("p_name").startswith("large")).select("p_partkey")
