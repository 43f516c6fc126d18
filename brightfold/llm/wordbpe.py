"""Ids of whole texts under a word-level BPE tokenizer file, as array operations over many texts at a time.

Pre-tokens are cut by character class over a block of texts at once, known by a 64-bit hash of their bytes, and new ones
are merged together as a matrix, one merge a pre-token and step. Their ids are kept in one pool. Texts that are not in
normal form or hold code points that Unicode tables disagree on, and very long pre-tokens, go through the tokenizers library, and
so do, if the file's added tokens count, texts that hold the string of one.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

#: The contractions that the file's pre-token pattern puts first, and its end-of-word mark. Fixed values.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
END_OF_WORD = "</w>"
LONGEST, NEVER = 48, np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def classes() -> np.ndarray:
    """The class of each code point of the basic plane; all others count as odd."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.full(0x10001, ODD, np.uint8)
    for c in range(0x10000):
        cat = unicodedata.category(chr(c))
        out[c] = ODD if cat in ("Cn", "Co", "Cs") else kinds.get(cat[0], OTHER)
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    out[[0x200B, 0x3A3, 0x180E]] = [OTHER, ODD, ODD]  # capital sigma has two lower cases
    return out


class WordBpe:
    def __init__(self, path: str, most: int = 400_000, added: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added  # if not, their strings in a text are ordinary text
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.size = len(vocab)
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + END_OF_WORD] for b in range(256)], np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.kind = classes()
        self.table = np.random.default_rng(7).integers(1, 2**63, (LONGEST, 256), np.uint64)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge's rank for each pair of symbols; NEVER where there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], NEVER).astype(np.int32)

    def merged(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens of about equal length, as bytes."""
        n, lengths = len(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
        wide = int(lengths.max())
        sym = np.full((n, wide + 1), -1, np.int32)
        row = np.repeat(np.arange(n), lengths)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        sym[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = self.inner[data]
        sym[np.arange(n), lengths - 1] = self.last[data[np.cumsum(lengths) - 1]]
        rank = self.rank(sym[:, :-1], sym[:, 1:])
        done, live, cols = sym, np.arange(n), np.arange(wide + 1)
        out = np.full((n, wide + 1), -1, np.int32)
        while len(live):
            least = rank.min(1)
            go = least < NEVER
            out[live[~go], : done.shape[1]] = done[~go]
            live, done, rank, least = live[go], done[go], rank[go], least[go]
            if not len(live):
                break
            at, i = rank.argmin(1), np.arange(len(live))
            done[i, at] = self.made[least]
            take = np.minimum(cols + (cols > at[:, None]), wide)
            done = np.take_along_axis(done, take, 1)
            done[:, -1] = -1
            take = np.minimum(cols[:-1] + (cols[:-1] >= at[:, None]), wide - 1)
            rank = np.take_along_axis(rank, take, 1)
            rank[:, -1] = NEVER
            rank[i, at] = self.rank(done[i, at], done[i, np.minimum(at + 1, wide)])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.rank(done[left, at[left] - 1], done[left, at[left]])
        held = out >= 0
        return out[held].astype("<u4"), held.sum(1)

    def library(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, hashes: np.ndarray, tokens: list[bytes]) -> None:
        """Add the ids of new pre-tokens to the pool."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        order = np.argsort(lengths, kind="stable")
        ids, counts = [], []
        for a in range(0, len(order), 4096):
            block = [tokens[i] for i in order[a : a + 4096]]
            if len(block[-1]) <= LONGEST:
                x, n = self.merged(block)
            else:
                each = [self.library(t.decode()) for t in block]
                x, n = np.concatenate(each), np.array([len(e) for e in each])
            ids.append(x)
            counts.append(n)
        n = np.concatenate(counts)
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate([self.pool, *ids])
        known = np.concatenate([self.known, hashes[order]])
        by = np.argsort(known, kind="stable")
        self.known, self.at, self.count = known[by], np.concatenate([self.at, at])[by], np.concatenate([self.count, n])[by]

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that hold none but plain code points, in lower case."""
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        kind = self.kind[points]
        start = kind != SPACE
        start[1:] &= (kind[1:] == NUMBER) | (kind[1:] != kind[:-1])
        quotes = np.flatnonzero((points == ord("'")) & start)
        for c in CONTRACTIONS:
            here = quotes[quotes + len(c) <= len(points)]
            for i, letter in enumerate(c[1:], 1):
                here = here[points[here + i] == ord(letter)]
            for i in range(1, len(c)):
                start[here + i] = False
            after = here[here + len(c) < len(points)] + len(c)
            start[after] = kind[after] != SPACE
        first = np.flatnonzero(start)
        bounds = np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)
        if not len(first):
            return [self.pool[:0]] * len(texts)
        wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF)
        byte_at = np.cumsum(wide) - wide
        inside = kind != SPACE
        token = np.cumsum(start) - 1
        size = np.bincount(token[inside], wide[inside], len(first)).astype(np.int64)
        begin = byte_at[first]
        place = np.repeat(np.arange(len(first)), size)
        within = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
        raw = data[np.repeat(begin, size) + within]
        value = np.add.reduceat(self.table[within % LONGEST, raw] * (2 * (within // LONGEST).astype(np.uint64) + np.uint64(1)), np.cumsum(size) - size)
        distinct, one, back = np.unique(value, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        new[spot < len(self.known)] = self.known[spot[spot < len(self.known)]] != distinct[spot < len(self.known)]
        if new.any():
            text = data.tobytes()
            b = begin[one[new]]
            self.learn(distinct[new], [text[x:y] for x, y in zip(b.tolist(), (b + size[one[new]]).tolist())])
            spot = np.searchsorted(self.known, distinct)
        count, at = self.count[spot][back], self.at[spot][back]
        before = np.cumsum(count) - count
        ids = self.pool[np.repeat(at - before, count) + np.arange(int(count.sum()))]
        cuts = np.append(before, len(ids))[np.searchsorted(first, bounds)]
        return np.split(ids, cuts)

    def texts(self, texts: list[str | None], together: int = 1_000_000) -> list[np.ndarray]:
        """The ids of each text, null as empty; texts of about `together` characters are taken at once."""
        out: list = [self.pool[:0]] * len(texts)
        places, held, size = [], [], 0
        for i, text in enumerate(texts):
            if text and text.isascii() or text and unicodedata.is_normalized("NFC", text) and self.simple(text):
                low = text.lower()
                if any(a in low for a in self.added):
                    out[i] = self.library(text)
                else:
                    places.append(i)
                    held.append(low)
                    size += len(low)
            elif text:
                out[i] = self.library(text)
            if held and (size >= together or i + 1 == len(texts)):
                if len(self.known) > self.most:
                    self.forget()
                for j, ids in zip(places, self.block(held)):
                    out[j] = ids
                places, held, size = [], [], 0
        return out

    def simple(self, text: str) -> bool:
        points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)
        return not (self.kind[points] == ODD).any()
