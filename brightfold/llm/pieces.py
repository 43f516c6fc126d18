"""SentencePiece encoding, decoding and token counts over a piece vocabulary read as a unigram lattice.

A text becomes "▁" + text with every space as "▁"; its segmentation is the path of pieces with the largest sum of the
file's scores, ties to the path whose last piece (then the one before, and so on) starts earliest. A character that no
piece holds costs the least score less 10 and is written as its bytes' pieces. No piece but runs of
"▁" holds one past its start, so every "▁" after another character is a cut that all paths go through; a run of "▁" is
segmented with the word after it.

encode(): words are segmented once and kept; a giant text is cut into chunks anywhere, each gives the max-plus matrix of
best scores from each overhang of a piece at its start to each at its end, and matrices are combined by a tree of max-plus products
(scan()) into the scores at every boundary: products of FAN neighbours, of FAN such products and so on, then scores carried down
again, so that no task holds more than FAN matrices of a text at once. Each chunk is traced back on its own, for every exit; which
exit leads to which entry is a map, and maps are composed by the same tree.

token_counts(): distinct words of a batch are walked in order, that is, along the trie that they form; the forward state
(best score, tokens so far, open pieces) of a shared prefix is computed once, the count at a word's end is kept.

Defined results: null or empty text has no ids; decode(encode(text)) is the text, whatever it holds; equal rows give equal
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, stage, texts, unstage, with_ids

SPACE, UNKNOWN_PENALTY = "▁", 10.0
LITERAL = "\ud800"  # stands for a "▁" of the text itself, which no text of Spark's can hold
NONE = float("-inf")
FAN = 16  # neighbours that are combined at once
REACH = 64  # characters that a piece may reach past its chunk
UNIT, CUT = re.compile(f"{SPACE}+[^{SPACE}]*"), re.compile(f"[^{SPACE}](?={SPACE})")


class Lattice:
    def __init__(self, path: str, most: int = 100_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown = min(sp.get_score(i) for i in plain) - UNKNOWN_PENALTY
        self.ids = {self.pieces[i]: i for i in plain if SPACE not in self.pieces[i][1:] or not self.pieces[i].strip(SPACE)}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.root: dict = {}
        for piece, score in self.score.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.most, self.words, self.counts = most, {}, {}

    def step(self, opens: list, best: list, i: int, c: str) -> tuple[list, float, int]:
        """From the pieces open before character i to those open after it, and the best score and start of a piece that ends there."""
        now, top, back = [], NONE, i
        for node, start in opens:
            if (node := node.get(c)) is not None:
                now.append((node, start))
                if (score := node.get("")) is not None and best[start] + score > top:
                    top, back = best[start] + score, start
        if (node := self.root.get(c)) is not None:
            now.append((node, i))
            score = node.get("", self.unknown)
        else:
            score = self.unknown
        if best[i] + score > top:
            top, back = best[i] + score, i
        return now, top, back

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int], list[int], list[float]]]:
        """Each word in order with the starts of the best pieces that end at, the tokens up to and the score of each place;
        what a word shares with the one before is not computed again."""
        last = ""
        best, backs, tokens, opens = [0.0], [0], [0], [[]]
        for word in sorted(words):
            n, most = 0, min(len(word), len(last))
            while n < most and word[n] == last[n]:
                n += 1
            del best[n + 1 :], backs[n + 1 :], tokens[n + 1 :], opens[n + 1 :]
            for i in range(n, len(word)):
                now, top, back = self.step(opens[i], best, i, word[i])
                opens.append(now)
                best.append(top)
                backs.append(back)
                extra = 1 if back < i or word[i] in self.ids else len(word[i].encode("utf-8", "surrogatepass"))
                tokens.append(tokens[back] + extra)
            last = word
            yield word, backs, tokens, best

    def spell(self, text: str) -> list[int]:
        """The ids of one piece of a path, or of a character that none holds."""
        if text in self.ids:
            return [self.ids[text]]
        return [self.bytes[b] for b in text.replace(LITERAL, SPACE).encode("utf-8", "surrogatepass")]

    def path(self, word: str, backs: list[int]) -> list[int]:
        out, i = [], len(word)
        while i:
            out.append(self.spell(word[backs[i] : i]))
            i = backs[i]
        return [x for ids in reversed(out) for x in ids]

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.words) > self.most:
            self.words.clear()
        for word, backs, _, _ in self.walk([SPACE + w for w in {w for ws in texts for w in ws} - self.words.keys()]):
            self.words[word[1:]] = np.asarray(self.path(word, backs), "<u4").tobytes()

    def count(self, texts: list[list[str]]) -> None:
        if len(self.counts) > self.most:
            self.counts.clear()
        for word, _, tokens, _ in self.walk([SPACE + w for w in {w for ws in texts for w in ws} - self.counts.keys()]):
            self.counts[word[1:]] = tokens[len(word)]

    def decode(self, ids) -> str:
        if not hasattr(self, "spelling"):
            raw = {i: bytes([b]) for b, i in self.bytes.items()}
            self.spelling = [raw.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        return b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    # --- chunks of giant texts ---

    def matrix(self, text: str, n: int) -> np.ndarray:
        """Best scores from a piece's start at place i of a chunk of n characters to the next chunk's place j. text: the chunk and
        what a piece that starts in it may reach."""
        wide = self.longest
        cuts = [m.end() for m in CUT.finditer(text, 0, n)]
        cut = cuts[0] if cuts else n
        best = np.full((len(text) + wide + 1, wide), NONE)
        for i in range(min(wide, cut + 1)):
            best[i, i] = 0.0  # no piece reaches past a cut
        last = cuts[-1] if cuts else -1
        if last > cut:  # whole words between the first and the last cut: one number
            self.forward(text, 0, cut, best)
            middle = sum(score[len(w)] for w, _, _, score in self.scored(text[cut:last]))
            best[last] = np.where(np.arange(wide) <= cut, best[cut] + middle, NONE)
            best[cut + 1 : last] = NONE
            self.forward(text, last, n, best)
        else:
            self.forward(text, 0, n, best)
        return best[n : n + wide].T.copy()

    def scored(self, text: str) -> Iterator:
        for unit in UNIT.findall(text):
            yield from self.walk([unit])

    def forward(self, text: str, start: int, stop: int, best: np.ndarray) -> None:
        """Carry the rows of best on from the places start to stop - 1."""
        for i in range(start, stop):
            if not (best[i] > NONE).any():
                continue
            node, j = self.root, i
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                score = node.get("")
                if score is not None:
                    np.maximum(best[j], best[i] + score, out=best[j])
            if text[i] not in self.ids:
                np.maximum(best[i + 1], best[i] + self.unknown, out=best[i + 1])

    def trace(self, text: str, n: int, entry: np.ndarray) -> tuple[list[float], list[int]]:
        """The best score and the start of the last piece for each place of a chunk, given the scores at its first places; -1: a path may enter there."""
        size = n + self.longest + 1
        best, back = [NONE] * size, [-1] * size
        for i in range(min(size, self.longest)):
            best[i] = float(entry[i])
        for i in range(n):
            if best[i] == NONE:
                continue
            node, j = self.root, i
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                score = node.get("")
                if score is not None and best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, i
            if text[i] not in self.ids and best[i] + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.unknown, i
        return best, back


def split(text: str | None) -> list[str]:
    """A text's words, what stands between spaces; of a run of spaces, all but the first are marks before the next word."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [unit[1:] for unit in UNIT.findall(SPACE + marked(text))]
    return text.replace(SPACE, LITERAL).split(" ")


def encode(docs: DataFrame, path: str, giant: int = 65_536, chunk: int = 16_384) -> DataFrame:
    """doc_id, text and ids (array of int) of every row."""
    rows = texts(docs)
    small = rows.where(F.col("text").isNull() | (F.length("text") <= giant))
    large = rows.where(F.length("text") > giant)

    @freed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(path)
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                texts = [split(t) for t in part["text"]]
                lattice.learn(texts)
                get = lattice.words.__getitem__
                yield part.assign(ids=[np.frombuffer(b"".join(map(get, ws)), "<u4").astype(np.int32) for ws in texts])

    done = small.mapInPandas(run, "doc_id string, text string, ids array<int>")
    return with_ids(done.unionByName(encode_giants(large, path, chunk)))


def encode_giants(docs: DataFrame, path: str, chunk: int = 16_384) -> DataFrame:
    """encode() for texts of many chunks; a text is at most one cell, so a document's ids fit one task. A vocabulary with pieces longer
    than REACH is an error."""
    spark = docs.sparkSession
    docs, _ = stage(docs.withColumn("key", F.monotonically_increasing_id()), "giants")
    whole = docs.select("key", F.concat(F.lit(" "), "text").alias("t")).withColumn("size", F.length("t")).withColumn("last", F.expr(f"int((size - 1) div {chunk})"))
    chunks = whole.select("key", "t", "size", "last", F.explode(F.sequence(F.lit(0), "last")).alias("c"))
    chunks = chunks.select("key", "c", F.expr(f"substring(t, c * {chunk} + 1, {chunk + REACH})").alias("t"), F.expr(f"int(least({chunk}, size - c * {chunk}))").alias("n"), (F.col("last") - F.col("c")).alias("after"))
    chunks, _ = stage(chunks.repartition("key", "c"), "chunks")
    most = (chunks.agg(F.max("c")).first()[0] or 0) + 1

    @freed
    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(path)
        if lattice.longest > REACH:
            raise ValueError(f"a piece of {lattice.longest} characters; chunks reach {REACH} past their end")
        for b in batches:
            yield b[["key", "c"]].assign(m=[lattice.matrix(marked(t), n).tobytes() for t, n in zip(b["t"], b["n"])])

    @freed
    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(path)
        for b in batches:
            out = []
            for t, n, entry in zip(b["t"], b["n"], b["state"]):
                best, back = lattice.trace(marked(t), n, np.frombuffer(entry))
                out.append(np.array([_entry(back, n + j) if best[n + j] > NONE else -1 for j in range(lattice.longest)], np.int32).tobytes())
            yield pd.DataFrame({"key": b["key"], "c": b["after"], "m": out})

    @freed
    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(path)
        for b in batches:
            out = []
            for t, n, entry, leaves in zip(b["t"], b["n"], b["state"], b["leaves"]):
                t, leaves = marked(t), int(np.frombuffer(leaves, np.int32)[0])
                _, back = lattice.trace(t, n, np.frombuffer(entry))
                i, ids = n + leaves, []
                while back[i] >= 0:
                    ids.append(lattice.spell(t[back[i] : i]))
                    i = back[i]
                out.append(np.array([x for p in reversed(ids) for x in p], np.int32))
            yield b[["key", "c"]].assign(ids=out)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [group["key"].iloc[0]], "ids": [np.concatenate(list(group.sort_values("c")["ids"]))]})

    products, at_products = stage(chunks.mapInPandas(matrices, "key long, c int, m binary"), "matrices")
    entries, _ = stage(scan(products, most, scores_product, scores_after, scores_start), "entries")
    traced = chunks.join(entries, ["key", "c"])
    maps, at_maps = stage(traced.mapInPandas(exits, "key long, c int, m binary"), "exits")
    leaves, _ = stage(scan(maps, most, map_product, map_after, map_start).select("key", F.col("c").alias("after"), F.col("state").alias("leaves")), "leaves")
    unstage(spark, at_products, at_maps)
    spelt = traced.join(leaves, ["key", "after"]).mapInPandas(spell, "key long, c int, ids array<int>")
    return docs.join(spelt.groupBy("key").applyInPandas(join, "key long, ids array<int>"), "key").select("doc_id", "text", "ids")


def scan(rows: DataFrame, most: int, product: Callable, after: Callable, start: Callable) -> DataFrame:
    """key, c (0, 1, ... below `most`) and m -> key, c and state, what the m of all smaller c make of the start in order of c. product(m, m)
    is associative and after(after(state, a), b) is after(state, product(a, b)); start(m) is the state before the first."""
    above = F.expr(f"int(c div {FAN})")

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        return pd.DataFrame({"key": [group["key"].iloc[0]], "c": [group["above"].iloc[0]], "m": [reduce(product, group["m"])]})

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        out, state = [], group["state"].iloc[0] if "state" in group else start(group["m"].iloc[0])
        for m in group["m"]:
            out.append(state)
            state = after(state, m)
        return group[["key", "c"]].assign(state=out)

    levels = [rows]
    while most > FAN:
        levels.append(levels[-1].withColumn("above", above).groupBy("key", "above").applyInPandas(multiply, "key long, c int, m binary"))
        most = -(-most // FAN)
    states = levels.pop().groupBy("key").applyInPandas(carry, "key long, c int, state binary")
    for level in reversed(levels):
        held = level.withColumn("above", above).join(states.withColumnRenamed("c", "above"), ["key", "above"])
        states = held.groupBy("key", "above").applyInPandas(carry, "key long, c int, state binary")
    return states


def _square(m: bytes) -> np.ndarray:
    return np.frombuffer(m).reshape(math.isqrt(len(m) // 8), -1)


def _level(x: np.ndarray) -> bytes:
    """Scores less the best one: differences decide, and stay exact however long the text is."""
    return (x - x.max() if x.max() > NONE else x).tobytes()


def scores_product(a: bytes, b: bytes) -> bytes:
    return _level((_square(a)[:, :, None] + _square(b)[None]).max(1))


def scores_after(state: bytes, m: bytes) -> bytes:
    return _level((np.frombuffer(state)[:, None] + _square(m)).max(0))


def scores_start(m: bytes) -> bytes:
    return np.where(np.arange(len(_square(m))) == 0, 0.0, NONE).tobytes()  # a text starts at its first place


def map_product(a: bytes, b: bytes) -> bytes:
    first, then = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
    return np.where(first >= 0, then[first], -1).astype(np.int32).tobytes()


def map_after(state: bytes, m: bytes) -> bytes:
    return np.frombuffer(m, np.int32)[np.frombuffer(state, np.int32)].tobytes()


def map_start(m: bytes) -> bytes:
    return np.zeros(1, np.int32).tobytes()  # a text ends at its last chunk's end


def marked(text: str) -> str:
    return text.replace(SPACE, LITERAL).replace(" ", SPACE)


def _entry(back: list[int], i: int) -> int:
    while back[i] >= 0:
        i = back[i]
    return i


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Every row of encode()'s form with `decoded`, the text of its ids."""

    @freed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(path)
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                yield part.assign(decoded=[lattice.decode(ids) for ids in part["ids"]])

    return with_ids(encoded.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, text string, ids array<int>, decoded string"))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words (pre-tokens) and n_tokens of every row."""

    @freed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(path)
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                texts = [split(t) for t in part["text"]]
                lattice.count(texts)
                get = lattice.counts.__getitem__
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_words": [t.count(" ") + 1 if t else 0 for t in part["text"]], "n_tokens": [sum(map(get, ws)) for ws in texts]})

    return with_ids(texts(docs).mapInPandas(run, "doc_id string, n_words long, n_tokens long"))


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids) and round_trip (the decoded ids are the text) of encode()'s rows."""

    @freed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(path)
        for b in batches:
            out = [(len(x), zlib.crc32(np.asarray(x, "<u4").tobytes()), (t or "") == lattice.decode(x.tolist())) for t, x in zip(b["text"], b["ids"])]
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_ids", "ids_crc32", "round_trip"])], axis=1)

    return with_ids(encoded.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, n_ids long, ids_crc32 long, round_trip boolean"))
