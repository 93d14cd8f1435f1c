"""Draws that depend on a key alone, so that a rerun or a retried task repeats
them.  The arithmetic keys are ones that any SQL engine can work out."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 4_294_967_296
#: A prime whose squares stay under 2^63.
_PRIME = 3_037_000_493
#: From the seed of a normal draw's radius to that of its angle.
_OTHER = 1_000_003


def _stages(seed: int) -> list[tuple[int, int]]:
    """(factor, offset) of each step; a seed has its own, so orders of different
    seeds are not shifts of one another."""
    out = []
    for k in range(3):
        digest = hashlib.sha256(f"{seed}:{k}".encode()).digest()
        out.append((1 << 30 | int.from_bytes(digest[:4], "big") >> 3 | 1, int.from_bytes(digest[4:8], "big") >> 1))
    return out


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


#: Bits of the pieces that an id is taken in, so that each stays under _PRIME.
_BITS = 31


def order_key(ident: Column, seed: int) -> Column:
    """Seeded order of 64-bit ids, as BIGINT from 0 to 2^32 - 1: linear steps
    with squares between them, modulo a prime.  A further piece of the id enters
    after each square, so ids that share a draw by chance do so for one seed
    alone.  No product reaches 2^63."""
    ident, mask = ident.cast("long"), _long((1 << _BITS) - 1)
    x = ident.bitwiseAND(mask)
    *steps, (factor, offset) = _stages(seed)
    for k, (f, o) in enumerate(steps, 1):
        x = F.pmod(x * _long(f) + _long(o), _long(_PRIME))
        x = F.pmod(x * x + F.shiftright(ident, k * _BITS).bitwiseAND(mask), _long(_PRIME))
    return F.pmod(x * _long(factor) + _long(offset), _long(MODULUS))


def order_key_sql(ident: str, seed: int) -> str:
    ident, mask = f"cast({ident} as bigint)", (1 << _BITS) - 1
    x = f"({ident} & {mask})"
    *steps, (factor, offset) = _stages(seed)
    for k, (f, o) in enumerate(steps, 1):
        x = f"(({x} * {f} + {o}) % {_PRIME})"
        x = f"(({x} * {x} + (({ident} >> {k * _BITS}) & {mask})) % {_PRIME})"
    return f"(({x} * {factor} + {offset}) % {MODULUS})"


def text_key(value: Column) -> Column:
    """60 bits of a text's digest, an id for ``order_key``."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("long")


def text_key_sql(value: str) -> str:
    return f"cast('0x' || substr(md5(cast({value} as varchar)), 1, 15) as bigint)"


def place_at(key: Column, place: Column | int, seed: int) -> Column:
    """``place_key`` from the id's ``order_key``, worked out once."""
    place = F.lit(place) if isinstance(place, int) else place
    return order_key(key + place.cast("long") * _long(MODULUS), seed)


def place_key(ident: Column, place: Column | int, seed: int) -> Column:
    """As ``order_key``, of an id and a place under 2^31 (a channel, a draw)."""
    return place_at(order_key(ident, seed), place, seed)


def place_key_sql(ident: str, place: str, seed: int) -> str:
    return order_key_sql(f"({order_key_sql(ident, seed)} + cast({place} as bigint) * {MODULUS})", seed)


def share(key: Column) -> Column:
    """A key as a uniform draw in (0, 1)."""
    return (key + 0.5) / float(MODULUS)


def share_sql(key: str) -> str:
    return f"(({key} + cast(0.5 as double)) / cast({MODULUS} as double))"


def gaussian_keys(ident: Column, seed: int) -> Column:
    """What ``gaussian_at`` needs of a row, to be worked out once."""
    return F.struct(order_key(ident, seed).alias("r"), order_key(ident, seed + _OTHER).alias("a"))


def gaussian_at(keys: Column, place: Column | int, seed: int) -> Column:
    """Standard normal by Box-Muller on the draws of two seeds."""
    r, a = place_at(keys["r"], place, seed), place_at(keys["a"], place, seed + _OTHER)
    return F.sqrt(-2 * F.log(share(r))) * F.cos(2 * F.pi() * share(a))


def gaussian(ident: Column, place: Column | int, seed: int) -> Column:
    return gaussian_at(gaussian_keys(ident, seed), place, seed)


def gaussian_sql(ident: str, place: str, seed: int) -> str:
    return f"(sqrt(-2 * ln({share_sql(place_key_sql(ident, place, seed))})) * cos(2 * pi() * {share_sql(place_key_sql(ident, place, seed + _OTHER))}))"


def uniform(seed: int, *key: Column) -> Column:
    """Uniform in (0, 1) by a 64-bit hash of seed and key."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *key: Column) -> Column:
    """Standard normal by Box-Muller on two uniform draws."""
    return F.sqrt(-2 * F.log(uniform(seed, F.lit("r"), *key))) * F.cos(2 * F.pi() * uniform(seed, F.lit("a"), *key))
