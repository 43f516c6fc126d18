"""Numeric and bit functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_bits(x: str) -> Column:
    """Of a 32-bit word."""
    return F.expr(f"cast(conv(reverse(lpad(bin({x} & 4294967295L), 32, '0')), 2, 10) AS bigint)")


def bytes_of(x: str) -> Column:
    """The bytes of a long, the highest first."""
    return F.expr(f"transform(sequence(7, 0, -1), i -> int(shiftrightunsigned(bigint({x}), i * 8) & 255L))")


def catalan(n: str) -> Column:
    return F.expr(f"aggregate(if({n} > 0, sequence(1, int({n})), array()), 1L, (c, i) -> c * 2 * (2 * i - 1) div (i + 1))")


def pascal_row(k: str) -> Column:
    return F.expr(f"aggregate(if({k} > 0, sequence(1, int({k})), array()), array(1L), (r, i) -> concat(array(1L), transform(sequence(1, size(r)), j -> r[j - 1] + if(j < size(r), r[j], 0L))))")


def add_digits(a: str, b: str, base: int = 1 << 31) -> Column:
    """The sum of two numbers given as arrays of digits, the least first, in any base up to 2^62; a carry past both makes a digit more."""
    step = f"(_s, _d) -> named_struct('c', (_s.c + _d) div {base}L, 'd', concat(_s.d, array((_s.c + _d) % {base}L)))"
    digits = f"zip_with({a}, {b}, (_x, _y) -> coalesce(bigint(_x), 0L) + coalesce(bigint(_y), 0L))"
    return F.expr(f"aggregate({digits}, named_struct('c', 0L, 'd', cast(array() AS array<bigint>)), {step}, _s -> if(_s.c > 0, concat(_s.d, array(_s.c)), _s.d))")


def plus_one(s: str) -> Column:
    """A decimal string of any length and one: nines at the end turn to noughts, the digit before them goes up."""
    head, digit = f"regexp_extract({s}, '^([0-9]*?)([0-8]?)(9*)$', 1)", f"regexp_extract({s}, '^([0-9]*?)([0-8]?)(9*)$', 2)"
    nines = f"length(regexp_extract({s}, '^([0-9]*?)([0-8]?)(9*)$', 3))"
    return F.expr(f"concat({head}, if({digit} = '', '1', cast(cast({digit} AS int) + 1 AS string)), repeat('0', {nines}))")
