"""String functions as columns; `python` below holds those that need a loop, for use in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def last_word_length(s: Column) -> Column:
    return F.length(F.element_at(F.split(F.rtrim(s), " "), -1))


def escape_spaces(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit("%20"))


def is_palindrome(s: Column) -> Column:
    """Letters and digits only, without case; nothing left counts as one."""
    x = F.lower(F.regexp_replace(s, "[^0-9A-Za-z]", ""))
    return x == F.reverse(x)


def wildcard(s: Column, pattern: str) -> Column:
    """Full match of a pattern with ? and *."""
    return s.like(re.sub(r"([%_\\])", r"\\\1", pattern).replace("*", "%").replace("?", "_"))


def full_regex(s: Column, pattern: str) -> Column:
    return s.rlike(rf"\A(?:{pattern})\z")


def common_prefix(strings: Column) -> Column:
    """Of an aggregate's strings: that of the least and the greatest."""
    lo, hi = F.min(strings), F.max(strings)
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(lo), F.lit(1))), lambda i: F.substring(lo, F.lit(1), i) == F.substring(hi, F.lit(1), i)))
    return F.when(F.length(lo) == 0, "").otherwise(F.substring(lo, F.lit(1), n))


def octal_to_hex(s: Column) -> Column:
    """Lower case; zero is nothing."""
    return F.when(F.conv(s, 8, 10) == "0", "").otherwise(F.lower(F.conv(s, 8, 16)))


def excel_number(s: str) -> Column:
    return F.expr(f"aggregate(split({s}, ''), 0L, (a, c) -> a * 26 + ascii(c) - 64)")


def excel_column(n: str) -> Column:
    """Digits 1 to 26, carried by (n - 1); fourteen letters hold every long."""
    return F.expr(f"aggregate(sequence(1, 14), named_struct('n', bigint({n}), 's', ''), (a, i) -> if(a.n > 0, named_struct('n', (a.n - 1) div 26, 's', concat(char(65 + (a.n - 1) % 26), a.s)), a), a -> a.s)")


def simplify_path(s: str) -> Column:
    """Without '.', '..' and repeated slashes."""
    return F.expr(f"concat('/', array_join(aggregate(filter(split({s}, '/'), p -> p <> '' AND p <> '.'), cast(array() as array<string>), (a, p) -> if(p = '..', slice(a, 1, greatest(size(a) - 1, 0)), array_append(a, p))), '/'))")


def decodings(s: str) -> Column:
    """Ways to read digits as letters A=1 .. Z=26; none for '' and for a leading zero."""
    step = f"(a, i) -> named_struct('p', a.q, 'q', if(substr({s}, i, 1) = '0', 0L, a.q) + if(i > 1 AND substr({s}, i - 1, 2) BETWEEN '10' AND '26', a.p, 0L))"
    return F.expr(f"if(length({s}) = 0, 0L, aggregate(sequence(1, length({s})), named_struct('p', 0L, 'q', 1L), {step}, a -> a.q))")


def run_lengths(s: str) -> Column:
    """Runs as [count]char, the count left out where it is 1; nothing is escaped."""
    return F.expr(f"concat_ws('', transform(regexp_extract_all({s}, '((.)\\\\2*)', 1), r -> concat(if(length(r) > 1, string(length(r)), ''), left(r, 1))))")


def binary_fraction(x: Column) -> Column:
    """Ten binary digits of a fraction in [0, 1)."""
    return F.lpad(F.bin(F.floor(x * 1024)), 10, "0")


def roman(n: str) -> Column:
    """Roman numerals. From 4000 on the thousands stand in brackets before the rest, and theirs in more: (IV)I is 4001; so a numeral's length
    grows with the number's digits."""
    steps = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
    table = ", ".join(f"named_struct('v', {v}, 's', '{s}')" for v, s in steps)
    part = f"aggregate(array({table}), named_struct('n', int(_part), 's', ''), (a, t) -> named_struct('n', a.n % t.v, 's', concat(a.s, repeat(t.s, a.n div t.v))), a -> a.s)"
    powers = f"array({', '.join(f'{1000**i}L' for i in range(7))})"
    deep = f"size(filter({powers}, _p -> _n div _p >= 4000))"
    parts = f"transform(sequence(_deep, 0, -1), _i -> if(_i = _deep, _n div {powers}[_i], _n div {powers}[_i] % 1000))"
    # one-element arrays bind what is computed once a row, to names that no column has
    return F.expr(f"if(({n}) IS NULL, null, transform(array(bigint({n})), _n -> transform(array({deep}), _deep -> concat(repeat('(', _deep), array_join(transform({parts}, _part -> {part}), ')')))[0])[0])")


def roman_number(s: str) -> Column:
    """One pass: a sign larger than the one before it takes that back twice; a bracket that closes makes thousands of what stands before it."""
    value = "element_at(map('(', 0L, 'I', 1L, 'V', 5L, 'X', 10L, 'L', 50L, 'C', 100L, 'D', 500L, 'M', 1000L), c)"
    step = f"if(c = ')', named_struct('n', a.n * 1000, 'last', 0L), transform(array({value}), _v -> named_struct('n', a.n + _v - if(_v > a.last, 2 * a.last, 0L), 'last', _v))[0])"
    return F.expr(f"aggregate(split({s}, ''), named_struct('n', 0L, 'last', 0L), (a, c) -> {step}, a -> a.n)")


def first_single(s: str) -> Column:
    """The first character, as lower case, that doesn't come again in either case; null if there is none."""
    return F.expr(f"try_element_at(filter(split(lower({s}), ''), c -> length({s}) - length(replace(lower({s}), c, '')) = 1), 1)")


def by_row(f: Callable, kind: str) -> Callable[..., Column]:
    """A Python function as a column function, in Arrow batches; null (or no number) in, null out. Beside a null, whole numbers reach
    pandas as floats: they are made whole again."""

    def missing(x: object) -> bool:
        return x is None or isinstance(x, float) and x != x

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        columns = [c.convert_dtypes().astype(object).where(c.notna(), None) if c.dtype.kind == "f" and c.isna().any() else c for c in columns]
        return pd.Series([None if any(map(missing, r)) else f(*r) for r in zip(*columns)], dtype=object)

    return run


# --- python ---


def encode_runs(s: str) -> str:
    """Run-length code in which digits that stand before an x are escaped, so that it can be read back: a run of n is n, x and the character if
    n > 1 and the character and what follows could be misread; digit runs before an x are each written as count, x, digit."""
    out, i = [], 0
    while i < len(s):
        j = i
        while j < len(s) and s[j].isdigit():
            j += 1
        if j > i and j < len(s) and s[j] == "x":
            while i < j:
                k = i
                while k < j and s[k] == s[i]:
                    k += 1
                out.append(f"{k - i}x{s[i]}")
                i = k
            n = 1
            while i + n < len(s) and s[i + n] == "x":
                n += 1
            out.append(f"{n}x" if n > 1 else "x")
            i += n
            continue
        k = i
        while k < len(s) and s[k] == s[i]:
            k += 1
        out.append(f"{k - i if k - i > 1 else ''}{s[i]}")
        i = k
    return "".join(out)


def interleaves(a: str, b: str, c: str) -> bool:
    if len(a) + len(b) != len(c):
        return False
    ok = [True] + [False] * len(b)
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                ok[j] = (i > 0 and ok[j] and a[i - 1] == c[i + j - 1]) or (j > 0 and ok[j - 1] and b[j - 1] == c[i + j - 1])
    return ok[-1]


def distinct_subsequences(s: str, t: str) -> int:
    """How often t is a subsequence of s; an empty t counts as none."""
    ways = [1] + [0] * len(t)
    for c in s:
        for j in range(len(t), 0, -1):
            if t[j - 1] == c:
                ways[j] += ways[j - 1]
    return ways[-1] if t else 0


def justify(words: list[str], width: int) -> list[str]:
    """Lines of a width: spare spaces all go to the first gap, the last line to the left."""
    lines, now = [], []
    for w in words:
        if now and sum(map(len, now)) + len(now) + len(w) > width:
            spare = width - sum(map(len, now)) - (len(now) - 1)
            lines.append(now[0] + " " * spare + (" " if len(now) > 1 else "") + " ".join(now[1:]))
            now = []
        now.append(w)
    return lines + ([" ".join(now).ljust(width)] if now else [])


def palindrome_ways(s: str) -> int:
    """How many partitions into palindromes there are, counted without listing them."""
    ways = [1]
    for j in range(1, len(s) + 1):
        ways.append(sum(ways[i] for i in range(j) if s[i:j] == s[i:j][::-1]))
    return ways[-1]


def palindrome_partitions(s: str) -> list[list[str]]:
    if not s:
        return [[]]
    return [[s[:i], *rest] for i in range(1, len(s) + 1) if s[:i] == s[:i][::-1] for rest in palindrome_partitions(s[i:])]


def palindrome_cuts(s: str) -> int:
    best = [-1]
    for j in range(1, len(s) + 1):
        best.append(min(best[i] + 1 for i in range(j) if s[i:j] == s[i:j][::-1]))
    return max(best[-1], 0)


def repeating_decimal(a: int, b: int) -> str:
    """a / b with the repeating digits in brackets; no digit before the point for a < b."""
    whole, rest = divmod(a, b)
    digits, seen = [], {}
    while rest and rest not in seen:
        seen[rest] = len(digits)
        d, rest = divmod(rest * 10, b)
        digits.append(str(d))
    if rest:
        digits.insert(seen[rest], "(")
        digits.append(")")
    return f"{whole or ''}.{''.join(digits)}"


def evaluate(s: str) -> int:
    """Whole numbers with + - *, without brackets."""
    total = 0
    for sign, term in re.findall(r"([+-]?)([\d*]+)", s.replace(" ", "")):
        product = 1
        for x in term.split("*"):
            product *= int(x)
        total += -product if sign == "-" else product
    return total


def expand_bits(pattern: str) -> list[str]:
    """Every pattern of bits that a pattern with other characters as wildcards stands for."""
    out = [""]
    for c in pattern:
        out = [x + y for x in out for y in (c if c in "01" else "01")]
    return out


def next_palindrome(n: int) -> int:
    """The least palindrome above n."""
    s = str(n + 1)
    half = s[: (len(s) + 1) // 2]
    for h in (half, str(int(half) + 1)):
        p = int(h + h[::-1][len(s) % 2 :])
        if p > n and len(str(p)) == len(s):
            return p
    return int("1" + "0" * (len(s) - 1) + "1")


def word_in_grid(grid: list[str], word: str) -> bool:
    def walk(r: int, c: int, k: int, used: frozenset) -> bool:
        if k == len(word):
            return True
        if (r, c) in used or not (0 <= r < len(grid) and 0 <= c < len(grid[r])) or grid[r][c] != word[k]:
            return False
        return any(walk(r + x, c + y, k + 1, used | {(r, c)}) for x, y in ((0, 1), (1, 0), (0, -1), (-1, 0)))

    return not word or any(walk(r, c, 0, frozenset()) for r in range(len(grid)) for c in range(len(grid[r])))


def ordered_window(s: str, target: str) -> int:
    """Length of the shortest part of s that holds target's characters in order; 0 if none does."""
    starts, best = [None] * len(target), 0
    for i, c in enumerate(s):
        for k in range(len(target) - 1, -1, -1):
            if target[k] == c:
                starts[k] = i if k == 0 else starts[k - 1]
        if target and starts[-1] is not None and (not best or i - starts[-1] + 1 < best):
            best = i - starts[-1] + 1
    return best


def word_breaks(s: str, words: set[str]) -> bool:
    ok = {0}
    for i in range(1, len(s) + 1):
        if any(j in ok and s[j:i] in words for j in range(i)):
            ok.add(i)
    return len(s) in ok


def without_digits(s: str, k: int) -> str:
    """The least number left after k digits are removed."""
    out: list[str] = []
    for c in s:
        while k and out and out[-1] > c:
            out.pop()
            k -= 1
        out.append(c)
    return "".join(out[: len(out) - k] if k else out)
