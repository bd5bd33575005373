"""Keeping rows out of a join's shuffle that surely have no partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_BITS, BITS_EACH = 20, 16  # at most 2**20 words; 16 bits a key while that suffices


def free_name(taken: list[str], wish: str) -> str:
    """A column name that no column of ``taken`` has (names are compared without case)."""
    lower = {name.lower() for name in taken}
    while wish.lower() in lower:
        wish += "_"
    return wish


def sieve(rows: DataFrame, own: list[Column], keys: DataFrame, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among ``keys``, the other rows).

    A blocked Bloom filter over the keys, one 64-bit word a slot, is broadcast: at most
    2**slot_bits words, whatever the number of keys. With more keys than it is made for,
    more rows are let through, none is lost. The rows themselves are not shuffled.
    """
    n = keys.count()
    if not n:
        return rows, rows.where(F.lit(False))
    slots = 1 << max(0, min(slot_bits, (n * BITS_EACH // 64).bit_length()))
    hashed, slot, mask, word = (free_name(rows.columns, x) for x in ("hash", "slot", "mask", "word"))

    def placed(df: DataFrame, columns: list) -> DataFrame:
        bits = [f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {at}) & 63 as int))" for at in (40, 46, 52, 58)]
        return (df.withColumn(hashed, F.xxhash64(*columns))
                .withColumns({slot: F.pmod(hashed, F.lit(slots)), mask: F.expr(" | ".join(bits))}).drop(hashed))

    words = placed(keys, [F.col(c) for c in keys.columns]).groupBy(slot).agg(F.bit_or(mask).alias(word))
    marked = placed(rows, own).join(F.broadcast(words), slot, "left")
    maybe = F.coalesce(F.col(word).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
    return marked.where(~maybe).select(*rows.columns), marked.where(maybe).select(*rows.columns)
