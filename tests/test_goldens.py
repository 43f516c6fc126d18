"""Small cases with known answers, and brute force for functions that are loops."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from brightfold.functions import numeric, strings
from brightfold.operators import graphs, puzzles, relational, sequences, treerows


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column).first()[0]


def test_strings():
    assert strings.without_digits("1432219", 3) == "1219"
    assert strings.encode_runs("3xabc") == "1x3xabc"
    assert strings.encode_runs("332x4abc") == "2x31x2x4abc"
    assert [strings.next_palindrome(x) for x in (121, 900, 99)] == [131, 909, 101]
    assert [strings.repeating_decimal(*x) for x in ((1, 9), (6, 7), (22, 7), (7, 7))] == [".(1)", ".(857142)", "3.(142857)", "1."]
    assert strings.evaluate("1-2+3") == 2 and strings.evaluate("2*3*4-5") == 19
    assert strings.interleaves("ab", "cd", "acbd") and not strings.interleaves("ab", "cd", "adbc")
    assert strings.distinct_subsequences("rabbbit", "rabbit") == 3 and strings.distinct_subsequences("x", "") == 0
    assert strings.justify("a bb ccc d".split(), 6) == ["a   bb", "ccc  d"] or strings.justify("a bb ccc d".split(), 6) == ["a   bb", "ccc d "]
    assert sorted(map(tuple, strings.palindrome_partitions("aab"))) == [("a", "a", "b"), ("aa", "b")] and strings.palindrome_cuts("aab") == 1
    assert all(strings.palindrome_ways(x) == len(strings.palindrome_partitions(x)) for x in ("", "a", "aab", "abcba", "aaaaaaa", "noonabbad"))
    assert strings.expand_bits("0?1") == ["001", "011"]
    assert strings.word_in_grid(["abc", "def"], "abed") and not strings.word_in_grid(["ab"], "aba")
    assert strings.ordered_window("xaybzab", "ab") == 2 and strings.word_breaks("redring", {"red", "ring"})


def test_columns(spark):
    assert one(spark, strings.octal_to_hex(F.col("s")), s="321") == "d1"
    assert one(spark, numeric.reverse_bits("x"), x=0x1323) == 0xC4C80000
    assert one(spark, strings.first_single("s"), s="geeksforgeeks") == "f"
    assert one(spark, strings.first_single("s"), s="geeksforgeeksFirst") == "o"
    assert one(spark, strings.simplify_path("s"), s="/a/./b/../../c/") == "/c"
    assert one(spark, strings.decodings("s"), s="226") == 3
    assert one(spark, strings.decodings("s"), s="") == 0
    assert one(spark, strings.is_palindrome(F.col("s")), s="A man, a plan: nam a nalp; Panama"[:5]) is False
    assert one(spark, strings.roman("n"), n=1994) == "MCMXCIV"


def test_sequences(spark):
    assert sequences.next_greater([2, 1, 3]) == [3, 3, None]
    assert sequences.largest_rectangle([2, 1, 2]) == 3
    assert len(sequences.increasing([1, 5, 3, 2, 4, 0, 6, 6, 9, 9, 8, 9] + [1] * 11)) == 6
    assert sequences.least_after_swaps([4, 2, 1, 3], 2) == [1, 4, 2, 3]
    assert sequences.seats([(3, 0), (2, 0), (1, 0)]) == [1, 2, 3]
    r = random.Random(1)
    for _ in range(50):
        v = [r.randint(0, 9) for _ in range(r.randint(1, 9))]
        assert sequences.widest_container(v) == max([0] + [(j - i) * min(v[i], v[j]) for i, j in combinations(range(len(v)), 2)])
        longest = max(k for k in range(1, len(v) + 1) for c in combinations(v, k) if list(c) == sorted(c))
        assert len(sequences.increasing(v, False)) == longest


def test_three_sum_of_zeros(spark):
    zeros = spark.createDataFrame([(0,)] * 3, "v int")
    assert [tuple(x) for x in relational.three_sum(zeros, "v", 0).collect()] == [(0, 0, 0)]
    assert relational.three_sum(zeros.limit(2), "v", 0).count() == 0


def test_graphs_and_trees(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "src long, dst long")
    assert {tuple(x) for x in graphs.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert graphs.euler_circuit([(0, 1), (1, 2), (2, 0)]) and not graphs.euler_circuit([(0, 1)])
    rows = treerows.from_pre_in([1, 2, 3], [2, 1, 3])
    assert sorted((x["id"], x["parent"]) for x in rows) == [(1, 0), (2, 1), (3, 1)]
    assert len(treerows.all_bsts(1, 4)) == 14


def test_puzzles():
    assert puzzles.reaches([1, 2, 3, 5], 24) and not puzzles.reaches([1, 1, 1, 1], 24)
    assert puzzles.slide("123456078") == 2 and puzzles.slide("123456870") == -1
    assert puzzles.combinations([2, 3, 6, 7], 7) == [[2, 2, 3], [7]]
    assert puzzles.solve_sudoku("11" + "." * 79) is None
