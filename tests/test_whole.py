"""Queries over whole tables against brute force on small tables."""

import itertools
from collections import defaultdict

import pytest

from brightfold import plans

plans.load()


@pytest.fixture
def tables(spark, tmp_path):
    def make(**named):
        for name, (schema, values) in named.items():
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


def run(spark, name, d):
    return sorted(map(tuple, plans.QUERIES[name](spark, d).collect()))


LINES = [(1, 10, 1), (2, 10, 2), (3, 11, 2), (40, 12, 3), (200, 12, 4), (201, 13, 5)]


def test_graphs_of_all_lines(spark, tables):
    d = tables(lineitem=("l_orderkey long, l_partkey long, l_suppkey long", LINES), orders=("o_orderkey long, o_custkey long", [(k, k % 5) for k, _, _ in LINES]))
    near = defaultdict(set)
    for _, p, s in LINES:
        near[p % 400].add(s % 90 + 1000)
        near[s % 90 + 1000].add(p % 400)
    dist = {}
    for start in near:
        dist[start], edge = {start: 0}, [start]
        for n in itertools.count(1):
            edge = sorted({y for x in edge for y in near[x]} - dist[start].keys())
            if not edge:
                break
            dist[start] |= dict.fromkeys(edge, n)
    assert run(spark, "components", d) == sorted((n, min(dist[n])) for n in near)
    assert run(spark, "actor_distance", d) == sorted(dist[10].items())
    assert run(spark, "is_tree", d) == [(False, False)]
    pairs = {(k % 5 % 200, s % 50 + 1000) for k, _, s in LINES}
    e = pairs | {(b, a) for a, b in pairs}
    assert run(spark, "second_degree", d) == sorted({(a, y) for a, b in e for x, y in e if b == x and a != y and (a, y) not in e})


def part(n):
    return ("p_partkey long, p_name string, p_type string, p_size int", [(k, f"name{k}", "type", (k * 37) % 50 + 1) for k in range(n)])


def test_trees_of_all_parts(spark, tables):
    n = 300
    d = tables(part=part(n))
    val = {k: (k * 37) % 50 + 1 for k in range(1, n)}

    def visit(kind, k=1):
        if k >= n:
            return []
        left, right = visit(kind, 2 * k), visit(kind, 2 * k + 1)
        return {"pre": [k, *left, *right], "in": [*left, k, *right], "post": [*left, *right, k]}[kind]

    for kind in ("pre", "in", "post"):
        assert run(spark, f"{kind}_order", d) == sorted((k, i) for i, k in enumerate(visit(kind), 1))
    above = {k: [k >> i for i in range(k.bit_length())] for k in val}
    want = []
    for x, y in itertools.pairwise(sorted(val)):
        lca = max(set(above[x]) & set(above[y]))
        want.append((x, y, lca, x.bit_length() + y.bit_length() - 2 * lca.bit_length()))
    assert run(spark, "lowest_common_ancestor", d) == want
    assert run(spark, "subtree_sums", d) == [(k, sum(val[x] for x in val if k in above[x])) for k in val]
    assert {r["id"] for r in plans.QUERIES["build_tree"](spark, d).collect()} == set(val)


def test_grids_of_all_rows(spark, tables):
    n = 260
    d = tables(part=part(n), supplier=("s_suppkey long", [(k,) for k in range(120)]))
    cell = {divmod(k, 20): (int(((k * 37) % 50 + 1) % 3 > 0), k) for k in range(n)}
    seen, isles, inside = set(), defaultdict(int), {k: v for v, k in cell.values()}
    for at in cell:
        if at in seen:
            continue
        isle, todo = set(), [at]
        while todo:
            r, c = x = todo.pop()
            if x in isle or x not in cell or cell[x][0] != cell[at][0]:
                continue
            isle.add(x)
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        seen |= isle
        isles[cell[at][0]] += 1
        if not cell[at][0] and not any(r in (0, 12) or c in (0, 19) for r, c in isle):
            inside |= {cell[x][1]: 1 for x in isle}
    assert run(spark, "count_islands", d) == sorted(isles.items())
    assert run(spark, "surrounded_regions", d) == sorted(inside.items())
    g = [[(10 * r + c) * 7919 % 23 - 11 for c in range(10)] for r in range(12)]
    best = max(sum(sum(row[c:e]) for row in g[r:s]) for r in range(12) for s in range(r + 1, 13) for c in range(10) for e in range(c + 1, 11))
    assert run(spark, "max_rectangle_sum", d) == [(max(best, 0),)]
    least = {}
    for r, c in itertools.product(range(12), range(10)):
        least[r, c] = g[r][c] + min((least[x] for x in ((r - 1, c), (r, c - 1)) if x in least), default=0)
    assert run(spark, "grid_min_path", d) == [(least[11, 9],)]


def test_rows_past_the_ids_of_the_sql(spark, tables):
    lines = [(k, 1000 + k, k % 7, 1) for k in (1, 299, 300, 499, 500, 20000)]
    orders = [(k,) for k in (1, 199, 200, 2226, 3111, 10000, 12345)]
    p = part(400)
    d = tables(
        lineitem=("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", lines),
        orders=("o_orderkey long", orders),
        part=p,
        supplier=("s_suppkey long", [(k,) for k in range(90)]),
        customer=("c_custkey long", [(1,), (199,), (200,), (4321,)]),
    )
    assert [r[0] for r in run(spark, "bit_arithmetic", d)] == [x[0] for x in lines]
    assert [(r["l_orderkey"], r["result"]) for r in plans.QUERIES["evaluate"](spark, d).orderBy("l_orderkey").collect()] == [(o, q + s * n - o) for o, q, s, n in lines]
    nexts = {k: next(x for x in itertools.count(k + 1) if str(x) == str(x)[::-1]) for (k,) in orders}
    assert run(spark, "next_palindrome", d) == sorted(nexts.items())
    assert {r[0] for r in run(spark, "decode_ways", d)} == {k for (k,) in orders}
    assert [r[0] for r in run(spark, "interleaves", d)] == list(range(400))
    assert [r[0] for r in run(spark, "twenty_four", d)] == list(range(400))
    text = {k: str(25525511100 + k * 37) for k in (1, 199, 200, 4321)}

    def addresses(s, n):
        if n == 0:
            return [""] if not s else []
        return [x for i in (1, 2, 3) if s[:i] and str(int(s[:i])) == s[:i] and int(s[:i]) < 256 for x in addresses(s[i:], n - 1)]

    assert {r[0] for r in run(spark, "restore_ip", d)} == {k for k, s in text.items() if addresses(s, 4)}
    points = [(k % 10, k * 7 % 13) for k in range(90)]
    most = 0
    for i, (x, y) in enumerate(points):
        lines_at = defaultdict(int)
        for j, (a, b) in enumerate(points):
            if i != j:
                lines_at[None if a == x else (b - y) / (a - x)] += 1
        most = max(most, *lines_at.values())
    assert run(spark, "most_collinear", d) == [(most + 1,)]
    assert run(spark, "common_suffix", d) == [(399 - 24,)]


def test_flattened_lists_of_all_orders(spark, tables):
    d = tables(orders=("o_orderkey long", [(1,), (200,), (900,)]), lineitem=("l_orderkey long, l_partkey long, l_linenumber int", [(1, 5, 1), (200, 6, 1), (900, 7, 1), (900, 8, 2)]))
    assert run(spark, "flatten_levels", d) == [(1, 5, 1), (200, 6, 1), (900, 7, 1), (900, 8, 2)]


def test_whole_lists(spark, tables):
    import datetime

    vals = {1: [(k * 37) % 90 + 1 for k in range(150)], 2: [5.0] * 100, 3: [3, 1, 2]}
    start = datetime.datetime(2024, 1, 1)
    events = [(u, 1000 * u + i, start + datetime.timedelta(minutes=i), float(v)) for u, vs in vals.items() for i, v in enumerate(vs)]
    d = tables(events=("user_id long, event_id long, ts timestamp_ntz, value double", events))
    cents = {u: [round(v * 100) for v in vs] for u, vs in vals.items()}
    areas = {u: max(min(v[a:b]) * (b - a) for a in range(len(v)) for b in range(a + 1, len(v) + 1)) for u, v in cents.items()}
    assert run(spark, "histogram_rectangle", d) == sorted(areas.items())
    water = {u: max((b - a) * min(v[a], v[b]) for a, b in itertools.combinations(range(len(v)), 2)) for u, v in cents.items()}
    assert run(spark, "container_water", d) == sorted(water.items())
    swapped = {r["user_id"]: r["members"] for r in plans.QUERIES["least_after_swaps"](spark, d).collect()}
    assert {u: sorted(m) for u, m in swapped.items()} == {u: sorted(v) for u, v in cents.items()}


def test_whole_grids(spark, tables):
    n = 40 * 73
    d = tables(part=("p_partkey long, p_name string, p_size int", [(k, "x", 3 if k // 40 < 50 else 1) for k in range(n)]))
    # zeros in the first 50 places, then 23 ones: 6 in row 7, rows 8 and 9 whole, 3 in row 10
    assert run(spark, "grid_games", d) == [(g, max(2 * 7, 3 * 6), 2) for g in range(40)]


def test_a_word_past_the_sixth_name(spark, tmp_path):
    names = ["aaaa"] * 6 + ["ring"]
    spark.createDataFrame([(50 * i, x) for i, x in enumerate(names)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert run(spark, "word_in_grid", str(tmp_path)) == [(0, True)]


def test_numbers_past_a_bigint(spark, tmp_path):
    n = 70000
    spark.range(1, n).selectExpr("id AS p_partkey", "int((id * 37) % 50 + 1) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    number = {}
    for k in range(1, n):
        number[k] = number.get(k >> 1, 0) * 10 + ((k * 37) % 50 + 1) % 10
    total = sum(number[k] for k in range((n + 1) // 2, n))
    assert total >= 2**63 and run(spark, "sum_numbers", str(tmp_path)) == [(total,)]


def test_long_queues(spark, tables):
    import random
    import time

    r = random.Random(2)
    people = [(i, i % 2 if i % 9 else None, None if i % 500 == 7 else r.randrange(500) / 4) for i in range(60000)]
    r.shuffle(people)
    d = tables(customer=("c_custkey long, c_nationkey int, c_acctbal double", people))
    start = time.time()
    got = {x["g"]: x["queue"] for x in plans.QUERIES["queue_reconstruction"](spark, d).collect()}
    assert got == {g: [h for _, n, h in sorted(people, key=lambda p: p[0]) if n == g] for g in (0, 1, None)}
    assert time.time() - start < 60


def test_a_rectangle_of_many_rows(spark, tables):
    import time

    keys = [k for k in range(30000) if k % 17]  # with gaps
    d = tables(supplier=("s_suppkey long", [(k,) for k in keys]))
    columns = [[0] * 3000 for _ in range(10)]
    for k in keys:
        columns[k % 10][k // 10] = k * 7919 % 23 - 11
    best = 0
    for a in range(10):
        sums = [0] * 3000
        for column in columns[a:]:
            sums, run_ = [x + y for x, y in zip(sums, column)], 0
            for s in sums:
                run_ = max(0, run_ + s)
                best = max(best, run_)
    start = time.time()
    assert run(spark, "max_rectangle_sum", d) == [(best,)] and time.time() - start < 60


def test_lines_through_many_points(spark, tables):
    import time

    n = 200_000
    d = tables(supplier=("s_suppkey long", [(k,) for k in range(n)]))
    places = defaultdict(int)
    for k in range(n):
        places[k % 10, k * 7 % 13] += 1
    most = 0
    for x, y in places:
        lines = defaultdict(int)
        for (a, b), m in places.items():
            lines[None if a == x else (b - y) / (a - x)] += m
        lines[None] -= 1
        most = max(most, *lines.values())
    start = time.time()
    assert run(spark, "most_collinear", d) == [(most + 1,)] and time.time() - start < 60


def test_lines_of_copies_and_of_one_point(spark, tmp_path):
    for name, keys, want in (("one", [4], [(None,)]), ("two", [4, 134], [(2,)]), ("copies", [1, 1, 2, 12, 5, None], [(3,)])):
        spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / name / "supplier.parquet"))
        assert run(spark, "most_collinear", str(tmp_path / name)) == want, name


def test_a_tree_in_many_texts(spark, tmp_path):
    from brightfold.operators import treerows

    gone = {3, 8192 * 2 + 2}  # what is below a gap is there still
    ids = [k for k in range(1, 40000) if k not in gone]
    spark.createDataFrame([(k,) for k in ids], "p_partkey long").selectExpr("p_partkey", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    assert run(spark, "serialised_tree", str(tmp_path)) == [(k, k // 2) for k in ids]
    assert treerows.write_part({"": (1, 0), "L": (2, 1), "RL": (6, 3)}) == "0 1 2 # # # 3L 6 # #"
