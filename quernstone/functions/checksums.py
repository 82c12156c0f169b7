"""CRC-32 of a whole from the CRC-32 values of its parts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
#: Lengths up to 2^48 bytes.
_BITS = 48


def _times(matrix: list[int], vector: int) -> int:
    found = 0
    for row in matrix:
        if vector & 1:
            found ^= row
        vector >>= 1
    return found


def _zeros() -> list[list[int]]:
    """Matrices over GF(2) that carry a checksum over 1, 2, 4, .. zero bytes; row k is what becomes of bit k."""
    one_bit = [_POLYNOMIAL, *(1 << k for k in range(31))]
    square = lambda m: [_times(m, row) for row in m]
    found = [square(square(square(one_bit)))]
    while len(found) < _BITS:
        found.append(square(found[-1]))
    return found


def shifted(crc: Column, length: Column) -> Column:
    """What ``crc`` contributes to the checksum of a text in which ``length`` bytes follow."""
    matrices = F.from_json(F.lit(json.dumps(_zeros())), "array<array<bigint>>")
    bit = lambda c, k: c.cast("long").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k))
    over = lambda m, v: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, k: F.when(bit(v, k) != 0, s.bitwiseXOR(F.get(m, k))).otherwise(s))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_BITS - 1)), crc.cast("long"), lambda v, k: F.when(bit(length, k) != 0, over(F.get(matrices, k), v)).otherwise(v))


def combined(parts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by.., crc32, length) of wholes from rows (by.., order.., crc32, length): the parts put together by ``order``.

    The checksum of a whole is the exclusive or of its parts' checksums, each carried over the bytes behind it, so parts
    are summed in any order once it is known how much follows them. No part is read again.
    """
    later = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("behind", F.coalesce(F.sum("length").over(later), F.lit(0)))
    return placed.select(*by, shifted(F.col("crc32"), F.col("behind")).alias("crc32"), "length").groupBy(*by).agg(F.bit_xor("crc32").alias("crc32"), F.sum("length").cast("long").alias("length"))
