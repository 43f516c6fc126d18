"""MinHash near-duplicates with fast similarity sketches, banding and exact verification.

A document's set of word shingles is sketched into `bins` places: in round i every shingle is put by hash into one place
with value i + u, a place keeps its least value, and rounds go on until every place is filled; after `bins` rounds, round
bins + j puts every shingle into place j, so all fill. Long sets need one round, and agreement of two sketches concentrates
about the sets' similarity. Bands of `rows` places are the candidate keys.

1. Rows with equal sets become one node (the least row of the set), by hash of the set.
2. Every node is compared with the first and the last node (by hash) of all its buckets, exactly, on full sets; found links are
   merged. This is only to keep the next step small.
3. In buckets that hold several components, sketches (a byte a place) are compared across components, in blocks; components with a
   pair whose estimate is not 0.12 under the threshold (five standard errors) are one family, of which a cell gives a spanning forest.
4. Within a family of several components all members of different components are compared exactly, on full sets. Only links that join
   components are returned. In 3 and 4, large groups are cells of two blocks of members, never two blocks of one component.
   Pairs are never rows, so a group of copies costs as many rows as it has members, times the blocks it must be compared with.

A pair at the threshold shares no band with probability (1 - s^rows)^bands: 5e-7 at 0.8 with 48 bands of 6.

Defined results: a null or empty text, or one without words, has the empty set and links with nothing; fewer words than a
shingle has: the whole sequence as one; equal rows are copies; an empty table gives an empty result. Rows are told apart by
their place in the table as well as their id, so repeated ids do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, among, mix, pick, shingles, stage, trim, unstage, with_ids, words

BANDS, ROWS, SLACK, BLOCK, CELL = 48, 6, 0.12, 1024, 512
_GOLD = 0x9E3779B97F4A7C15


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Sketches of non-empty sets, a row each."""
    n = len(sets)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    left, data, owner = np.arange(n), np.concatenate(sets), np.repeat(np.arange(n), sizes)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            h = mix(data + np.uint64((i + 1) * _GOLD & (2**64 - 1)))
            low = np.uint64(i << 40) | (h & np.uint64((1 << 40) - 1))
            place = ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64) if i < bins else i - bins
            np.minimum.at(out, owner * bins + place, low)
            open_ = (out.reshape(n, bins)[left] == np.iinfo(np.uint64).max).any(1)
            if not open_.any():
                break
            if not open_.all():
                still = np.zeros(n, bool)
                still[left[open_]] = True
                left, held = left[open_], still[owner]
                data, owner = data[held], owner[held]
    return out.reshape(n, bins)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each sketch; the band's number is part of it."""
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD) + np.zeros((len(sketches), 1), np.uint64)
        for i in range(rows):
            key = mix((key ^ sketches.reshape(-1, bands, rows)[:, :, i]) + np.uint64(_GOLD))
    return key.view(np.int64)


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row (its place), n_shingles, two hashes of the set, band keys and the sketch's low bytes."""
    schema = "doc_id string, row long, n long, h1 long, h2 long, bands array<long>, low binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.iloc[a : a + 256]
                sets = [shingles(hashes.array(words(t)), k) for t in part["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                s = sketch([sets[i] for i in full], bands * rows) if full else np.zeros((0, bands * rows), np.uint64)
                keys, low = [None] * len(sets), [b""] * len(sets)
                for i, key, x in zip(full, band_keys(s, bands, rows), mix(s).astype(np.uint8)):
                    keys[i], low[i] = key, x.tobytes()
                yield pd.DataFrame({"doc_id": part["doc_id"], "row": part["row"], "n": [len(x) for x in sets], "h1": [np.int64(xxhash.xxh64_intdigest(x.tobytes()) - 2**63) for x in sets], "h2": [np.int64(xxhash.xxh64_intdigest(x.tobytes(), 1) - 2**63) for x in sets], "bands": keys, "low": low})

        trim()

    return with_ids(docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those linked on their full sets. texts: node, text."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    # members' texts travel to their leader's, which comes once a partition: rows arrive sorted by it
    rows = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, kept = WordHashes(), None, None
        for x in batches:
            good = np.zeros(len(x), bool)
            for i, (b, ta, tb) in enumerate(zip(x["b"].tolist(), x["ta"], x["tb"])):
                if b != last:
                    last, kept = b, shingles(hashes.array(words(tb)), k)
                good[i] = similar(shingles(hashes.array(words(ta)), k), kept, percent)
            yield x.loc[good, ["a", "b"]]
        trim()

    return rows.mapInPandas(run, "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """node, component (its least node) of every node of edges (a, b); the staged tables that hold it. Every round each node takes
    the least label beside it and then its label's label, so chains shorten by doubling."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct()
    both, at = stage(both, "edges")
    labels, old = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        beside = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("beside"))
        hooked = labels.join(beside, "node").select("node", "label", F.least("label", "beside").alias("new"))
        # the label of a label is a node's own, so this halves every path
        jumped = hooked.join(hooked.select(F.col("node").alias("new"), F.col("new").alias("far")), "new", "left")
        result, path = stage(jumped.select("node", F.coalesce("far", "new").alias("label"), (F.coalesce("far", "new") != F.col("label")).alias("moved")), "labels")
        moved = bool(result.where("moved").take(1))
        unstage(spark, old)
        labels, old = result.select("node", "label"), path
        if not moved:
            unstage(spark, at)
            return labels.withColumnRenamed("label", "component"), [path]


def by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by keys, one at a time."""
    held: list[pd.DataFrame] = []
    for x in batches:
        key = x[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(x)]
        for a, b in zip(cuts, cuts[1:]):
            if held and (held[-1][keys].to_numpy()[-1] != key[a]).any():
                yield pd.concat(held, ignore_index=True)
                held = []
            if a < b:
                held.append(x.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)


class Forest:
    """Merges labels; add() tells whether it joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (nxt := self.up.get(root, root)) != root:
            root = nxt
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def add(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def in_cells(members: DataFrame, most: int) -> DataFrame:
    """members (group, component, node, ...) with `cell` and `block`, as often as needed for every two members of a group that are of
    different components to meet in a cell. A group of up to `most` members is one cell. In a larger one, a component of `most` or more
    has blocks of its own, others share blocks; two blocks are a cell, but not two of one component."""
    per = members.groupBy("group", "component").agg(F.count("*").alias("n_own"))
    sizes = per.groupBy("group").agg(F.sum("n_own").alias("size"), F.sum(F.when(F.col("n_own") < most, F.col("n_own"))).alias("rest"))
    large = sizes.where(F.col("size") > most)
    one = members.join(large.select("group").hint("merge"), "group", "left_anti").withColumn("cell", F.xxhash64("group")).withColumn("block", F.lit(0).cast("long"))
    per = per.join(large, "group")
    placed = members.join(per.hint("merge"), ["group", "component"])
    own = F.col("n_own") >= most
    count = F.when(own, F.ceil(F.col("n_own") / most)).otherwise(F.ceil(F.col("rest") / most))
    spread = F.when(own, F.xxhash64("node")).otherwise(F.xxhash64("component"))
    placed = placed.withColumn("whose", F.when(own, F.col("component").cast("string")).otherwise("*")).withColumn("part", F.pmod(spread, count)).drop("n_own", "size", "rest")
    blocks = per.select("group", F.when(own, F.col("component").cast("string")).otherwise("*").alias("whose"), count.alias("count")).distinct()
    blocks = blocks.select("group", "whose", F.explode(F.expr("sequence(0L, count - 1)")).alias("part"))
    left, right = blocks.select("group", F.struct("whose", "part").alias("x")), blocks.select("group", F.struct("whose", "part").alias("y"))
    cells = left.join(right, "group").where("x <= y AND (x.whose <> y.whose OR x.whose = '*')")
    sides = cells.select("group", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("b")).select("group", F.xxhash64("group", "x", "y").alias("cell"), F.col("b.whose").alias("whose"), F.col("b.part").alias("part"))
    both = placed.join(sides, ["group", "whose", "part"]).withColumn("block", F.xxhash64("whose", "part"))
    return one.select(*members.columns, "cell", "block").union(both.select(*members.columns, "cell", "block"))


def near_components(members: DataFrame, sketches: DataFrame, percent: int, bins: int) -> DataFrame:
    """Pairs of components, of every cell a spanning forest of those with members whose sizes and sketches allow a link.
    members: group (a bucket), node, component, n; sketches: node, low."""
    rows = in_cells(members, BLOCK).join(sketches.hint("merge"), "node")
    rows = rows.select("cell", "block", "component", "n", "low").repartition("cell").sortWithinPartitions("cell")
    least = percent / 100 - SLACK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for x in by_group(batches, ["cell"]):
            comp, n, block = (x[c].to_numpy() for c in ("component", "n", "block"))
            low = np.frombuffer(b"".join(x["low"]), np.uint8).reshape(len(x), bins)
            across, forest = block.min() != block.max(), Forest()
            for s in range(0, len(x), 128):
                i, j = np.meshgrid(np.arange(s, min(s + 128, len(x))), np.arange(s, len(x)), indexing="ij")
                ok = (j > i) & (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                if across:  # pairs within a block are those of another cell
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                for c in range(0, len(i), 20_000):
                    p, q = i[c : c + 20_000], j[c : c + 20_000]
                    close = (low[p] == low[q]).mean(1) >= least
                    pairs = np.unique(np.sort(np.column_stack([comp[p[close]], comp[q[close]]]), 1), axis=0)
                    out += [(a, b) for a, b in pairs.tolist() if forest.add(a, b)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        trim()

    return rows.mapInPandas(run, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, [a, a + 2048])
        x = np.zeros((len(sets), 2048), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def links_within(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between the components of each family that join them, from all pairs of members of different components.
    members: group (a family), component, node; texts: node, text."""
    rows = in_cells(members, CELL).join(texts.hint("merge"), "node")
    rows = rows.select("cell", "component", "node", "text").repartition("cell").sortWithinPartitions("cell", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for x in by_group(batches, ["cell"]):
            sets = [shingles(hashes.array(words(t)), k) for t in x["text"]]
            both, sizes = overlaps(sets), np.array([len(s) for s in sets])
            comp, node, forest = x["component"].to_numpy(), x["node"].to_numpy(), Forest()
            i, j = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes - both), 1) & (comp[:, None] != comp))
            got = [(a, b) for a, b, c, d in zip(node[i].tolist(), node[j].tolist(), comp[i].tolist(), comp[j].tolist()) if forest.add(c, d)]
            yield pd.DataFrame(got, columns=["a", "b"]).astype("int64")
        trim()

    return rows.mapInPandas(run, "a long, b long")


def leaders(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """buckets (bucket, node, n) that hold several nodes; pairs (a, b) of each node with the first and the last node of all its buckets,
    where their sizes allow a link; and the staged tables' paths. nodes: node, n, bands."""
    keys = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared, shared_at = stage(keys.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y"), "shared")
    # most buckets hold one node: their keys are not sent again
    buckets, buckets_at = stage(among(keys, "bucket", shared.select("bucket")).join(shared.hint("merge"), "bucket"), "buckets")
    lead, lead_at = stage(buckets.groupBy("node", "n").agg(F.min("x").alias("x"), F.max("y").alias("y")), "leaders")
    stars = lead.select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode(F.array("x", "y")).alias("b")).where("a != b")
    stars = stars.join(lead.select(F.col("node").alias("b"), F.col("n").alias("nb")).hint("merge"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    stars, stars_at = stage(stars.select("a", "b"), "stars")
    return buckets.select("bucket", "node", "n"), stars, [shared_at, buckets_at, lead_at, stars_at]


def groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row, n_shingles, component_id (the least doc_id reachable), and first (the row that stands for its component) of every row of docs, which has
    the columns doc_id, text and row (a number of its own for every row, the same whenever it is read)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "row")
    base, base_at = stage(sketched(docs, k, bands, rows), "sketches")
    same = base.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("row").alias("node"))
    members, members_at = stage(base.select("doc_id", "row", "n", "h1", "h2").join(same, ["h1", "h2", "n"], "left").select("doc_id", "row", "n", F.coalesce("node", "row").alias("node")), "members")
    # rows that are no node of their own, or not the only ones of it, are found out exactly; all others are nodes as they stand
    other, other_at = stage(members.where("node != row").select("row").union(members.groupBy("row").agg(F.count("*").alias("times")).where("times > 1").select("row")), "others")
    full = base.where("n > 0").select("row", "n", "bands")
    nodes = among(full, "row", other).join(members.where("node = row").select("row").distinct().hint("merge"), "row").dropDuplicates(["row"])
    nodes = nodes.union(among(full, "row", other, but=True))
    buckets, stars, used = leaders(nodes.withColumnRenamed("row", "node"), percent)
    used += [base_at, members_at, other_at]

    def texts(nodes: DataFrame) -> DataFrame:
        """node and text of the nodes; only their texts are sent, and few others."""
        rows = among(docs.select(F.col("row").alias("node"), "text"), "node", nodes)
        return rows.join(nodes.hint("merge"), "node").dropDuplicates(["node"])  # a semi-join would be moved before the filter

    starred = stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct()
    links, at = stage(verified(stars, texts(starred), k, percent), "links")
    known, known_at = components(spark, links)
    used += [at, *known_at]

    labelled = buckets.join(known, "node", "left").select(F.col("bucket").alias("group"), "node", F.coalesce("component", "node").alias("component"), "n")
    # near copies share many bands: of buckets with the same members (by size and two sums of hashes) one is enough
    mark = [F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("m1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("m2")]
    mixed = labelled.groupBy("group").agg(*mark).where("lo != hi").groupBy("size", "m1", "m2").agg(F.min("group").alias("group")).select("group")
    open_, at = stage(labelled.join(mixed, "group", "left_semi"), "open")
    used.append(at)
    seen = open_.select("node").distinct()
    low = among(base.select(F.col("row").alias("node"), "low"), "node", seen).join(seen.hint("merge"), "node").dropDuplicates(["node"])
    near, at = stage(near_components(open_, low, percent, bands * rows), "near")
    used.append(at)
    if near.take(1):
        family, family_at = components(spark, near)
        family = family.select(F.col("node").alias("component"), F.col("component").alias("group"))
        inside = members.where("n > 0").select("node").distinct().join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component")).join(family, "component")
        inside, inside_at = stage(inside.select("group", "component", "node"), "families")
        second, second_at = stage(links_within(inside, texts(inside.select("node")), k, percent), "links")
        used += [second_at, inside_at, *family_at]
        if second.take(1):
            known, at = components(spark, links.union(second))
            used += at
    # what is joined are written tables, so that a hot component or node is split like any skewed join
    final, at = stage(members.join(known, "node", "left").select("doc_id", "row", "n", F.coalesce("component", "node").alias("c")), "labelled")
    used.append(at)
    several = final.groupBy("c").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("f")).where("size > 1")
    several, at = stage(several.select("c", "least", F.col("f.row").alias("first")), "components")
    used.append(at)
    result = final.join(several.hint("merge"), "c", "left")
    alone = F.col("first").isNull()
    result, _ = stage(result.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), (alone | (F.col("row") == F.col("first"))).alias("first")), "groups")
    unstage(spark, *used)
    return result


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `row`, the hash of the id and the text, which is the same whenever the table is read. Rows equal in both share it."""
    return pick(docs, doc_id="long", text="string").withColumn("row", F.xxhash64(F.col("doc_id"), F.col("text")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group: one of each group of near-duplicates."""
    mine = "_row"
    while mine in docs.columns:
        mine += "_"
    found = groups(numbered(docs), k, percent)
    repeated = found.groupBy("row").agg(F.count("*").alias("times")).where("times > 1").select("row")
    gone, gone_at = stage(found.where("NOT first").select("row").union(repeated), "gone")
    rows = docs.withColumn(mine, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    first = found.where("first").select(F.col("row").alias(mine)).distinct().hint("merge")
    kept = among(rows, mine, gone).join(first, mine).dropDuplicates([mine])
    return among(rows, mine, gone, but=True).unionByName(kept).drop(mine)
