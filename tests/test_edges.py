"""Nulls, empty tables and line ends in functions and operators of the core."""

from pyspark.sql import functions as F

from brightfold import streaming
from brightfold.functions import numeric
from brightfold.functions import strings as fn
from brightfold.operators import graphs, ml, relational


def test_null_beside_numbers(spark):
    rows = spark.createDataFrame([(121,), (None,), (9,)], "n long").coalesce(1)
    got = [r[0] for r in rows.select(fn.by_row(fn.next_palindrome, "long")("n")).collect()]
    assert got == [131, None, 11]


def test_a_line_end_is_no_full_match(spark):
    rows = spark.createDataFrame([("ab",), ("ab\n",), (None,)], "s string")
    assert [r[0] for r in rows.select(fn.full_regex(F.col("s"), "ab")).collect()] == [True, False, None]


def test_columns_of_eight_letters(spark):
    n = sum(26**i for i in range(8)) + 25
    assert spark.range(1).select(F.expr(f"bigint({n})").alias("n")).select(fn.excel_column("n")).first()[0] == "AAAAAAAZ"


def test_depths_of_nothing_and_of_a_cycle(spark):
    for edges in ([], [(1, 2), (2, 1)]):
        found = graphs.topological_depth(spark.createDataFrame(edges, "src long, dst long"))
        assert found.columns == ["node", "depth"] and found.count() == 0


def test_layers(spark):
    x = spark.createDataFrame([([1.0, 2.0, 4.0],), ([900.0, 900.0, 900.0],)], "x array<double>")
    a, b = x.select(ml.log_softmax("x").alias("p"), ml.layer_norm("x").alias("n")).collect()
    assert [round(v, 6) for v in a.p] == [-3.169846, -2.169846, -0.169846] and [round(v, 4) for v in a.n] == [-1.069, -0.2673, 1.3363]
    assert [round(v, 6) for v in b.p] == [-1.098612] * 3 and b.n == [0.0] * 3


def test_big_numbers(spark):
    base = 1 << 31
    value = lambda digits: sum(x * base**i for i, x in enumerate(digits))
    pairs = [([base - 1, base - 1], [1]), ([], []), ([5], [base - 1, base - 1, 7]), ([0], [0])]
    got = spark.createDataFrame(pairs, "a array<long>, b array<long>").coalesce(1).select(numeric.add_digits("a", "b").alias("s")).collect()
    assert [value(r.s) for r in got] == [value(a) + value(b) for a, b in pairs]
    texts = ["9" * 50, "1" + "0" * 60, "19", "0", "8999", None]
    got = spark.createDataFrame([(s,) for s in texts], "s string").coalesce(1).select(numeric.plus_one("s").alias("n")).collect()
    assert [r.n for r in got] == [s and str(int(s) + 1) for s in texts]


def test_lists_and_lines(spark):
    a = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), (None, 0)], "k string, p int")
    b = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    assert [tuple(r) for r in relational.intersection(a, b, "k", "p").collect()] == [("x", 1)]
    lines = spark.createDataFrame([("l", 2, 1), ("l", 1, 9), ("", 1, 2), (None, 1, 3)], "line string, d int, n int")
    assert {tuple(r) for r in relational.first_lines(lines, "line", "d", "n").collect()} == {("l", 1, 9), ("", 1, 2), (None, 1, 3)}
    assert sorted(map(tuple, relational.shuffled(lines.dropna(), 5, "d", "n").collect())) == sorted(map(tuple, lines.dropna().collect()))
    v = spark.createDataFrame([(1, 1), (1, 4), (1, 6), (2, 9)], "g int, v int")
    assert {tuple(r) for r in relational.next_value(v, ["g"], "v", F.col("v") % 2 == 0).collect()} == {(1, 1, 4), (1, 4, 4), (1, 6, 6), (2, 9, None)}


def test_training_by_batches(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x, y = r.normal(size=(23, 3)), r.integers(0, 2, 23)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(23)], "i long, x array<double>, y int")
    w, bias, losses = ml.train_batches(df, "i", "x", "y", 2, 3, 0.1, 2, size=10, momentum=0.9)
    want, speed, ones = np.zeros((2, 4)), np.zeros((2, 4)), np.column_stack([x, np.ones(23)])
    for _ in range(2):
        for at in range(0, 23, 10):
            xs, ys = ones[at : at + 10], y[at : at + 10]
            p = np.exp(xs @ want.T)
            p = p / p.sum(1, keepdims=True) - np.eye(2)[ys]
            speed = 0.9 * speed + p.T @ xs / len(xs)
            want = want - 0.1 * speed
    assert np.allclose(np.column_stack([w, bias]), want) and losses[1] < losses[0]


def test_a_stream_of_two_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, "a", 1), (1, "b", 2), (2, "a", 3)], [(1, "a", 4), (1, "c", 5)]]):
        spark.createDataFrame(rows, "u long, v string, event_id int").withColumn("at", F.timestamp_seconds("event_id")).coalesce(1).write.parquet(f"{tmp_path}/in/p={i}")
    files = spark.readStream.schema("u long, v string, event_id int, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    kept = streaming.drain(streaming.lru(files, "u", "v", 2), "update", ("u",))
    assert {(r.u, *r.kept) for r in kept.collect()} == {(1, "c", "a"), (2, "a")}
    assert {tuple(r) for r in streaming.drain(files.groupBy("v").count(), "complete").collect()} == {("a", 3), ("b", 1), ("c", 1)}


def test_components_of_a_long_chain(spark, monkeypatch):
    want = [(i, 0 if i < 3000 else 5000) for i in (*range(3000), 5000, 5001)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(2999)] + [(5001, 5000)], "src long, dst long")
    for few in (graphs.FEW, 0):
        monkeypatch.setattr(graphs, "FEW", few)
        assert sorted(map(tuple, graphs.components(edges).collect())) == want


def test_isles_across_strips(spark):
    cells = [(10 * r + c, r, c, int(c == 0 or (r + c) % 5 == 0)) for r in range(30) for c in range(4)]
    at = {(r, c): (i, v) for i, r, c, v in cells}
    want = {}
    for i, r, c, v in cells:
        if i not in want:
            todo = [(r, c)]
            while todo:
                r, c = todo.pop()
                if (r, c) in at and at[r, c][1] == v and at[r, c][0] not in want:
                    want[at[r, c][0]] = i
                    todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    got = graphs.grid_components(spark.createDataFrame(cells, "id long, r long, c long, v int"), rows=4)
    assert {x["id"]: x["isle"] for x in got.collect()} == want


def test_reaching_is_as_by_trying_all(spark):
    from fractions import Fraction
    from itertools import product

    from brightfold.operators import puzzles

    def tried(values, target):
        if len(values) == 1:
            return values[0] == target
        for i, j in product(range(len(values)), repeat=2):
            if i != j:
                a, b, rest = values[i], values[j], [v for k, v in enumerate(values) if k not in (i, j)]
                if any(tried([*rest, x], target) for x in (a + b, a - b, a * b, *([a / b] if b else []))):
                    return True
        return False

    lists = [[a, b, c] for a, b, c in product(range(-1, 5), repeat=3)] + [[0], [3, 8], [3, 3, 8, 8], [1, 5, 5, 5], [7, 7, 7, 7]]
    for target in (24, 0, -3, 5):
        assert all(puzzles.reaches(v, target) == tried([Fraction(x) for x in v], target) for v in lists)


def test_many_hands_of_four():
    import time
    from itertools import combinations_with_replacement

    from brightfold.operators import puzzles

    start = time.process_time()
    assert sum(puzzles.reaches(list(v), 24) for v in combinations_with_replacement(range(1, 14), 4)) == 1362  # of 1820
    assert time.process_time() - start < 20


def test_at_or_above(spark):
    import random
    import time

    r = random.Random(1)
    held = [r.randrange(10**6) / 4 for _ in range(40000)]
    probes = [(i, r.randrange(-1000, 10**6 + 9000) / 4) for i in range(40000)] + [(-1, None)]
    start = time.time()
    got = relational.at_or_above(spark.createDataFrame(probes, "i long, x double"), "x", spark.createDataFrame([(y,) for y in [*held, None]], "y double"), "y", "z")
    held.sort()
    from bisect import bisect_left

    want = {i: None if x is None or x > held[-1] else held[bisect_left(held, x)] for i, x in probes}
    assert {a.i: a.z for a in got.collect()} == want and time.time() - start < 60


def test_many_batches(spark):
    import time

    import numpy as np

    r = np.random.default_rng(6)
    x, y = r.normal(size=(20000, 2)), r.integers(0, 2, 20000)
    df = spark.createDataFrame([(3 * i, x[i].tolist(), int(y[i])) for i in r.permutation(20000).tolist()], "i long, x array<double>, y int")
    start = time.time()
    w, bias, losses = ml.train_batches(df, "i", "x", "y", 2, 2, 0.1, 1, size=48)
    took = time.time() - start
    want, ones = np.zeros((2, 3)), np.column_stack([x, np.ones(20000)])
    for at in range(0, 20000, 16):
        p = np.exp(ones[at : at + 16] @ want.T)
        want = want - 0.1 * (p / p.sum(1, keepdims=True) - np.eye(2)[y[at : at + 16]]).T @ ones[at : at + 16] / 16
    assert np.allclose(np.column_stack([w, bias]), want) and took < 40


def test_numerals_of_any_size(spark):
    texts = {1: "I", 3999: "MMMCMXCIX", 4000: "(IV)", 4001: "(IV)I", 1234567: "(MCCXXXIV)DLXVII", 4000000: "((IV))", 7200009: "((VII)CC)IX"}
    n = [*texts, *range(1, 4100), 2**31 + 5, 999_999_999_999, 2**63 - 1]
    got = spark.createDataFrame([(x,) for x in n], "n long").select("n", fn.roman("n").alias("r")).select("n", "r", fn.roman_number("r").alias("back"), F.length("r").alias("size")).collect()
    assert all(r.back == r.n and r.size < 120 for r in got) and {r.n: r.r for r in got if r.n in texts} == texts
    assert spark.createDataFrame([(None,)], "n long").select(fn.roman("n")).first()[0] is None
