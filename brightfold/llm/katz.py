"""Language-model scores by Katz backoff: Good-Turing discounted n-gram counts, backoff weights that normalise exactly.

The model: p(w | h) = d_c c(h, w) / c(h) for n-grams seen in training, else alpha(h) p(w | h'), h' the shorter history, with
alpha(h) = (mass taken from h's n-grams) / (1 - sum of p(w | h') over the words seen after h); histories never seen
pass on to h'. The unigrams' mass goes to one unknown word. Counts over `CUT` are not discounted; a history all of whose
counts are over it keeps one event in c(h) + 1 for other words, so that nothing has probability 0. Where counts of
counts don't allow Good-Turing's ratios, an absolute discount n1 / (n1 + 2 n2) (a half without singletons) takes their place.

How: texts become blocks of about a million tokens (a row each: vocabulary and token numbers), which are written once, in buckets,
and not sent again. For each order, a block sends its distinct n-grams with their counts, cut by the hash of their history into as many
pieces as there are buckets; a bucket's task adds up the counts, writes its part of the n-gram table and answers each piece with counts
and history totals, and, for histories beside which the block has unseen words, what their backoff weight is made of. A block then has
all it needs for its tokens, order by order. A frequent word or n-gram is one entry a block, never a row a token; the number of buckets
grows with that of blocks. Words are known by 64-bit hashes until the unigrams' buckets have counted them; then by numbers in order of
frequency, which compress and tell a word's count: the numbers of a count begin where the driver's list of counts says, which has an entry
for each different count (their sum is the corpus, so at most about the square root of twice its tokens). Histories of several words are
64-bit hashes of their numbers.

Defined results: null or empty text is its end token alone; a null id is in training (its remainder is null, not the held
out one); equal rows are scored and counted each; an empty table gives an empty result; without training tokens every word is the
unknown word with probability 1. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, stage, stage_by, texts, trim, unstage, unstage_by, words

CUT = 5
END, START = np.uint64(1), np.uint64(0)  # the end token's hash, and the number of the place before a text
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as their bytes by place (all first bytes, all second ...), compressed together."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() if len(x) else b"" for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(x) for x in planes], np.int64).tobytes() + b"".join(planes))


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    at, out = 8 * len(kinds), []
    for size, kind in zip(raw[:at].view(np.int64).tolist(), kinds):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(wide, -1).T).view(kind).reshape(-1))
        at += size
    return out


def blocks(docs: DataFrame, modulus: int, held: int, tokens: int) -> DataFrame:
    """block, and packed its documents' ids, sizes and flags (1: held out, 2: id is null), vocabulary and token numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, hashes = TaskContext.get().partitionId() << 32, WordHashes()
        ids, sizes, flags, keys, have = [], [], [], [], 0

        def close() -> pd.DataFrame:
            nonlocal number, ids, sizes, flags, keys, have
            vocabulary, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # frequent words get small numbers, which compress
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            out = pd.DataFrame([(number, pack(np.array(ids, np.int64), np.array(sizes, np.uint32), np.array(flags, np.uint8), vocabulary[order], place[at]))], columns=["block", "data"])
            number, ids, sizes, flags, keys, have = number + 1, [], [], [], [], 0
            return out

        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                x, null = np.append(hashes.array(words(text)), END), doc is None
                ids.append(0 if null else int(doc))
                flags.append(2 if null else zlib.crc32(doc.encode()) % modulus == held)
                sizes.append(len(x))
                keys.append(x)
                have += len(x)
                if have >= tokens:
                    yield close()
        if ids:
            yield close()
        trim()

    return texts(docs).mapInPandas(run, "block long, data binary")


class Discounts:
    """d_1 .. d_CUT from the counts of counts n[1] .. n[CUT + 1]."""

    def __init__(self, n: list[int]):
        n = np.array([0, *n], np.float64)
        r = np.arange(1, CUT + 1)
        with np.errstate(all="ignore"):
            share = (CUT + 1) * n[CUT + 1] / n[1]
            d = ((r + 1) * n[2:] / (r * n[1:-1]) - share) / (1 - share)
        if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
            taken = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            d = (r - taken) / r
        self.d = np.append(np.append(1.0, d), 1.0)

    def of(self, c: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(c, CUT + 1)]

    def taken(self, few: np.ndarray) -> np.ndarray:
        """The events taken from histories that have few[:, r - 1] n-grams of count r."""
        r = np.arange(1, CUT + 1)
        return (few * (r * (1 - self.d[1:-1]))).sum(-1)


class Block:
    """A block's tokens, and for each order its distinct n-grams in the order in which they are sent."""

    def __init__(self, row, buckets: int):
        self.buckets = buckets
        self.ids, sizes, self.flags, vocabulary, tokens = unpack(row.data, np.int64, np.uint32, np.uint8, np.uint64, np.uint32)
        self.sizes = sizes.astype(np.int64)
        self.word = vocabulary[tokens]
        first = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.word)) - np.repeat(first, self.sizes)
        self.train = np.repeat(self.flags & 1, self.sizes) == 0

    def history(self, order: int) -> np.ndarray:
        """The number of the token before each token; for more tokens, a hash of their numbers."""
        h = np.zeros(len(self.word), np.uint64)
        with np.errstate(over="ignore"):
            for back in range(order - 1, 0, -1):
                before = np.full(len(self.word), START)
                before[back:] = self.number[:-back]
                before[self.place < back] = START
                h = before if order == 2 else mix(h * np.uint64(31) + before)
        return h

    def grams(self, order: int) -> tuple[np.ndarray, ...]:
        """Distinct n-grams by bucket, history and word: history, word, training count, a token that has it, each token's n-gram and the pieces' bounds."""
        h, word = self.history(order), self.word if order == 1 else self.number
        with np.errstate(over="ignore"):
            code = mix(mix(h) ^ (word * np.uint64(0x9E3779B97F4A7C15)))
        _, one, back = np.unique(code, return_index=True, return_inverse=True)
        key = mix(h[one]) if order > 1 else word[one]  # a bucket is a range of keys
        bucket = ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        by = np.lexsort((word[one], h[one], bucket))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        one, back = one[by], place[back]
        count = np.bincount(back, self.train, len(one)).astype(np.uint32)
        return h[one], word[one], count, one, back, np.searchsorted(bucket[by], np.arange(self.buckets + 1))


def sent(h: np.ndarray, w: np.ndarray, c: np.ndarray, low: np.ndarray | None = None) -> bytes:
    """A piece, sorted by history and word: histories and their numbers of words, words, counts and probabilities of lower order."""
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    start = np.flatnonzero(new)
    starts, step = h[start], w.copy()
    step[1:] -= np.where(new[1:], np.uint64(0), w[:-1])
    starts[1:] -= h[start][:-1]
    return pack(starts, np.diff(np.append(start, len(h))).astype(np.uint32), step, c.astype(np.uint32), np.zeros(0) if low is None else low)


def received(data: bytes) -> tuple[np.ndarray, ...]:
    """Histories (each once), their numbers of words, words, counts and probabilities of a piece."""
    starts, size, step, c, low = unpack(data, np.uint64, np.uint32, np.uint64, np.uint32, np.float64)
    size = size.astype(np.int64)
    first = np.cumsum(size) - size
    w = np.cumsum(step, dtype=np.uint64)
    w -= np.repeat(w[first] - step[first], size)  # sums begin anew with each history
    return np.cumsum(starts, dtype=np.uint64), size, w, c.astype(np.int64), low


SENT = "block long, bucket int, data binary"
GOT = "block long, bucket int, data binary, stats array<long>, counts array<long>, words array<long>"


class Unigrams:
    """Probabilities by training count, and the count of a word's number. counts: different counts, most first; most: of a count, the
    largest number of words that a bucket has."""

    def __init__(self, stats: list[int], counts: np.ndarray, most: np.ndarray, buckets: int):
        *self.n, self.total, self.types = stats
        self.counts, self.buckets = counts, buckets
        self.starts = np.uint64(1) + np.append(0, np.cumsum(most[:-1] * buckets)).astype(np.uint64)

    def number(self, c: np.ndarray, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Numbers of words by count and by place among their bucket's words of that count."""
        at = len(self.counts) - 1 - np.searchsorted(self.counts[::-1], c)
        return self.starts[at] + (place.astype(np.uint64) * np.uint64(self.buckets) + bucket.astype(np.uint64))

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        d = Discounts(self.n)
        taken = float(d.taken(np.array(self.n[:CUT], np.float64)))
        whole = self.total if taken > 0 else self.total + 1
        return np.where(c > 0, d.of(c) * c / whole, (taken if taken > 0 else 1.0) / whole)

    def of(self, number: np.ndarray) -> np.ndarray:
        return self.p(self.counts)[np.searchsorted(self.starts, number, "right") - 1]


def tally(order: int, unigrams: Unigrams | None):
    """The task of a bucket: pieces of n-grams in; out the bucket's part of the table (block -1) and an answer to each piece. An answer to
    unigrams: counts, and places among the bucket's words of that count. To others: counts; of each history twice its total, plus one if it has an n-gram of
    a count that is discounted; of histories with an unseen word, the sum of lower probabilities and the numbers of n-grams by count."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pieces = [received(x) for x in group["data"]]
        h = np.concatenate([np.repeat(p[0], p[1]) for p in pieces])
        w, c, low = (np.concatenate([p[i] for p in pieces]) for i in (2, 3, 4))
        by = np.lexsort((w, h))
        hs, ws = h[by], w[by]
        new = np.append(True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1]))
        kind = np.cumsum(new) - 1
        total = np.bincount(kind, c[by]).astype(np.int64)
        entry = np.empty(len(h), np.int64)
        entry[by] = kind
        seen = total > 0
        th, tw = hs[new], ws[new]
        bucket = int(group["bucket"].iloc[0])
        stats = [int((total == r).sum()) for r in range(1, CUT + 2)] + [int(total.sum()), int(seen.sum())]
        counts = words = []
        if order == 1:
            by_count = np.argsort(-total, kind="stable")
            counts, first, words = np.unique(-total[by_count], return_index=True, return_counts=True)
            place = np.empty(len(total), np.int64)
            place[by_count] = np.arange(len(total)) - np.repeat(first, words)
            counts, words = (-counts).tolist(), words.tolist()
        else:
            hist = np.append(True, th[1:] != th[:-1])
            at = np.cumsum(hist) - 1
            known, n = th[hist], int(at[-1]) + 1
            tl = unigrams.of(tw) if order == 2 else low[by][new]
            sums = np.bincount(at, total, n).astype(np.int64)
            lows = np.bincount(at, tl * seen, n)
            few = np.stack([np.bincount(at, total == r, n) for r in range(1, CUT + 1)], 1)
        out = [(-1, bucket, sent(th[seen], tw[seen], total[seen]), stats, counts, words)]
        i = 0
        for block, p in zip(group["block"].tolist(), pieces):
            mine = entry[i : i + len(p[2])]
            i += len(mine)
            if order == 1:
                data = pack(total[mine].astype(np.uint32), place[mine].astype(np.uint32))
            else:
                a = np.searchsorted(known, p[0])
                open_ = a[np.bincount(np.repeat(np.arange(len(a)), p[1]), total[mine] == 0, len(a)) > 0]
                data = pack(total[mine].astype(np.uint32), (2 * sums[a] + few[a].any(1)).astype(np.uint64), lows[open_], few[open_].astype(np.uint32).reshape(-1))
            out.append((int(block), bucket, data, None, None, None))
        trim()
        return pd.DataFrame(out, columns=[x.split()[0] for x in GOT.split(", ")])

    return run


class Scorer:
    """Probabilities of a block's tokens, order by order, from the answers to its pieces."""

    def __init__(self, block: Block, unigrams: Unigrams | None, stats: list[list[int]]):
        self.block, self.words, self.stats = block, unigrams, stats

    def unigrams(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        _, _, _, _, back, bounds = self.block.grams(1)
        got = [unpack(data, np.uint32, np.uint32) for _, data in answers]
        c, place = (np.concatenate([x[i] for x in got]).astype(np.int64) for i in (0, 1))
        self.block.number = self.words.number(c, place, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))[back]
        self.known = c[back]
        return self.words.p(self.known)

    def higher(self, order: int, answers: list[tuple[int, bytes]], p: np.ndarray) -> np.ndarray:
        h, _, _, one, back, _ = self.block.grams(order)
        d = Discounts(self.stats[order - 1][: CUT + 1])
        got = [unpack(data, np.uint32, np.uint64, np.float64, np.uint32) for _, data in answers]
        c, totals, lows, few = (np.concatenate([x[i] for x in got]) for i in range(4))
        at = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
        whole, discounted = (totals >> np.uint64(1)).astype(np.float64), (totals & np.uint64(1)) == 1
        alpha, open_ = np.ones(len(totals)), np.zeros(len(totals), bool)
        open_[at[c == 0]] = True
        taken = d.taken(few.reshape(-1, CUT))
        beyond = np.where(taken > 0, taken, 1.0) / np.maximum(whole[open_] + ~discounted[open_], 1) / np.maximum(1 - lows, 1e-300)
        alpha[open_] = np.where(whole[open_] > 0, beyond, 1.0)
        return np.where(c > 0, d.of(c) * c / np.maximum(whole + ~discounted, 1)[at], alpha[at] * p[one])[back]


def scores(docs: DataFrame, order: int = 2, modulus: int = 7, held: int = 2, tokens: int = 1_500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model's log10 probability) of
    every text, the model being trained on those whose crc32 of the id's text modulo `modulus` is not `held`."""
    spark = docs.sparkSession
    base, base_name = stage_by(blocks(docs, modulus, held, tokens), "block", "blocks")
    buckets = base.count()
    if not buckets:
        unstage_by(spark, base_name)
        return spark.createDataFrame([], SCORES)
    stats, answers, used, unigrams = [], [], [], None

    def states(row, m: int, unigrams: Unigrams | None, stats: list) -> tuple[Scorer, np.ndarray | None]:
        """A block's scorer and its tokens' probabilities of order m, from the answers a1 .. am."""
        s, p = Scorer(Block(row, buckets), unigrams, stats), None
        for k in range(1, m + 1):
            got = sorted((x["bucket"], x["data"]) for x in getattr(row, f"a{k}"))
            p = s.unigrams(got) if k == 1 else s.higher(k, got, p)
        return s, p

    def joined() -> DataFrame:
        """Blocks with the answers to their pieces; the blocks' side is not sent."""
        out = base
        for m, a in enumerate(answers, 1):
            listed = a.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias(f"a{m}"))
            out = out.join(listed.hint("merge"), "block")
        return out

    for m in range(1, order + 1):

        def send(batches: Iterator[pd.DataFrame], m: int = m, unigrams: Unigrams | None = unigrams, stats: list = [*stats]) -> Iterator[pd.DataFrame]:  # noqa: B006
            for b in batches:
                for row in b.itertuples(index=False):
                    s, p = states(row, m - 1, unigrams, stats)
                    h, w, c, one, _, bounds = s.block.grams(m)
                    low = p[one] if m > 2 else None  # bigrams' lower probabilities follow from the words' numbers
                    out = [(row.block, i, sent(h[a:z], w[a:z], c[a:z], None if low is None else low[a:z])) for i, (a, z) in enumerate(zip(bounds, bounds[1:])) if z > a]
                    yield pd.DataFrame(out, columns=["block", "bucket", "data"])
                    del s, p, h, w, c, one, low
            trim()

        got, at = stage(joined().mapInPandas(send, SENT).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(tally(m, unigrams), GOT), f"{m}-grams")
        table = got.where("block = -1")
        sums = table.agg(*[F.sum(F.col("stats")[i]) for i in range(CUT + 3)]).first()
        stats.append([int(x or 0) for x in sums])
        if m == 1:
            rows = table.select(F.explode(F.arrays_zip("counts", "words")).alias("x")).groupBy("x.counts").agg(F.max("x.words").alias("most")).orderBy(F.desc("counts")).collect()
            unigrams = Unigrams(stats[0], np.array([r.counts for r in rows], np.int64), np.array([r.most for r in rows], np.int64), buckets)
        answers.append(got)
        used.append(at)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                s, p = states(row, order, unigrams, stats)
                k = s.block
                doc = np.repeat(np.arange(len(k.ids)), k.sizes)
                add = lambda x: np.bincount(doc, x, len(k.ids))
                ids = pd.array(k.ids, dtype="Int64")
                ids[k.flags >= 2] = pd.NA
                known, total = s.known, unigrams.total
                yield pd.DataFrame({"doc_id": ids, "held_out": (k.flags & 1) == 1, "n_tokens": k.sizes, "n_known": add(known > 0).astype(np.int64), "train_tokens": np.full(len(k.ids), total), "base_score": add(np.log10((known + 1) / (total + unigrams.types + 1))), "score": add(np.log10(p))})
        trim()

    result, _ = stage(joined().mapInPandas(finish, SCORES), "scores")
    unstage(spark, *used)
    unstage_by(spark, base_name)
    return result
