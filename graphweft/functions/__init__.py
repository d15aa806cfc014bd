"""Column functions: seeded hashing, distances of sketches and dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) fixed by the parts: the first 52 bits of the MD5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


#: Modulus and multipliers of the integer hashes below: products of two numbers under 2^31 fit 63 bits in any engine.
PRIME, SEED_A, SEED_B, SLOT, STIR = (1 << 31) - 1, (668265263, 374761393), (974711, 461845907), 1640531527, 1103515245


def seeds(item: Column | str, text: bool = False) -> list[Column]:
    """Two numbers below PRIME that stand for an item in all its races; of a text they come from its MD5."""
    c = F.col(item) if isinstance(item, str) else item
    if text:
        return [F.conv(F.substring(F.md5(c), at, 7), 16, 10).cast("long") for at in (1, 8)]
    low, high = c.bitwiseAND(F.lit(PRIME)), F.pmod(F.shiftright(c, 31), F.lit(PRIME))
    return [(low * a + high * b + b) % PRIME for a, b in zip(SEED_A, SEED_B)]


def race_key(x: Column, y: Column, slot: Column | int) -> Column:
    """Exponential clock, in a slot, of the item with the seeds x, y; divided by a weight, the least key wins with
    probability as the weight."""
    turn = F.lit((slot + 1) * SLOT % PRIME) if isinstance(slot, int) else (slot.cast("long") + 1) * SLOT % PRIME
    h = (x * turn + y) % PRIME
    g = h.bitwiseXOR(F.shiftright(h, 15)) * STIR % PRIME
    return -F.log((g + (h + F.lit(0.5)) / PRIME) / PRIME)


def positional_similarity(a: Column | str, b: Column | str) -> Column:
    """Share of positions at which two arrays of equal length agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def positional_distance(a: Column | str, b: Column | str) -> Column:
    """Jaccard distance of two sketches, 1 - share of equal positions."""
    return F.lit(1.0) - positional_similarity(a, b)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot_distance(a: Column | str, b: Column | str) -> Column:
    """1 - a.b, which may be negative."""
    return F.lit(1.0) - dot(a, b)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((na > 0) & (nb > 0), F.lit(1.0) - dot(a, b) / F.sqrt(na * nb)).otherwise(F.lit(1.0))


def directed_distance(distance, source_a, target_a, source_b, target_b) -> Column:
    """Mean of the distances source-source, target-target and source-target."""
    return (distance(source_a, source_b) + distance(target_a, target_b) + distance(source_a, target_b)) / F.lit(3.0)
