"""MurmurHash3 (x86, 32 bit) as a column expression.

Spark's own hash() is another function: it differs in the bytes it reads and in its tail. Products
are taken in 16-bit halves, because a 32-bit product in a BIGINT would overflow under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M32 = 0xFFFFFFFF
#: Fixed values of the published hash.
C1, C2, BLOCK_ADD, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once: an expression that is written twice doubles at each use."""
    return F.transform(F.array(value), then)[0]


def _times(x: Column, c: int) -> Column:
    high = (F.shiftright(x, 16) * c).bitwiseAND(0xFFFF) * 65536
    return (x.bitwiseAND(0xFFFF) * F.lit(c) + high).bitwiseAND(_M32)


def _rotate(x: Column, r: int) -> Column:
    return (F.shiftleft(x, r).bitwiseAND(_M32)).bitwiseOR(F.shiftright(x, 32 - r))


def _scramble(k: Column) -> Column:
    return _let(_times(k, C1), lambda x: _let(_rotate(x, 15), lambda y: _times(y, C2)))


def _byte(digits: Column, i: int) -> Column:
    """Byte i of a text of hexadecimal digits; 0 beyond its end."""
    return F.coalesce(F.conv(F.nullif(F.substring(digits, 2 * i + 1, 2), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long"))


def _word(digits: Column, at: int) -> Column:
    out = _byte(digits, at)
    for i in range(1, 4):
        out = out + F.shiftleft(_byte(digits, at + i), 8 * i)
    return out


def murmur3(text: Column, seed: Column | int, max_bytes: int = 8) -> Column:
    """The signed hash, as a long, of the UTF-8 bytes of a text of at most `max_bytes` (a bigram has up to eight)."""
    return _let(F.hex(F.encode(text, "UTF-8")), lambda digits: _hash(digits, (F.lit(seed) if isinstance(seed, int) else seed).cast("long"), max_bytes))


def _hash(digits: Column, seed: Column, max_bytes: int) -> Column:
    size = (F.length(digits) / 2).cast("long")

    def block(h: Column, b: int) -> Column:
        if b == max_bytes // 4:
            return h
        mixed = lambda h: _let(h.bitwiseXOR(_scramble(_word(digits, 4 * b))), lambda x: (_times(_rotate(x, 13), 5) + BLOCK_ADD).bitwiseAND(_M32))
        return _let(F.when(size >= 4 * (b + 1), mixed(h)).otherwise(h), lambda x: block(x, b + 1))

    # digits end with the text, so the word after the last full block holds the tail alone
    word = F.lit(0).cast("long")
    for b in range(max_bytes // 4 + 1):
        word = F.when((size > 4 * b) & (size < 4 * (b + 1)), _word(digits, 4 * b)).otherwise(word)
    steps = [
        lambda h: h.bitwiseXOR(_scramble(word)).bitwiseXOR(size),
        lambda h: _times(h.bitwiseXOR(F.shiftright(h, 16)), MIX1),
        lambda h: _times(h.bitwiseXOR(F.shiftright(h, 13)), MIX2),
        lambda h: h.bitwiseXOR(F.shiftright(h, 16)),
        lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h),
    ]

    def finish(h: Column, at: int) -> Column:
        return h if at == len(steps) else _let(steps[at](h), lambda x: finish(x, at + 1))

    return _let(block(seed, 0), lambda h: finish(h, 0))
