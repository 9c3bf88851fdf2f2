"""A bitmap of key hashes that is broadcast to drop rows whose key can't be in a table before they are shuffled.

It is sized by the number of keys (``PER_KEY`` bits each, up to twice that, and one hash: at most about one stranger in ``PER_KEY`` passes) and never exceeds ``MOST_BITS``,
32 MiB; with so many keys that it would hold fewer than ``LEAST`` bits a key it says nothing and isn't made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_KEY, LEAST, MOST_BITS = 16, 2, 1 << 28
#: Bits of one row's bitmap, as bitmap_construct_agg makes them.
ROW_BITS = 1 << 15


def bits_for(n_keys: int) -> int:
    """A power of two, or 0 where no sketch is made."""
    if n_keys * LEAST > MOST_BITS:
        return 0
    return min(MOST_BITS, max(ROW_BITS, 1 << (PER_KEY * n_keys).bit_length()))


def _place(bits: int, columns: list[Column]) -> tuple[Column, Column]:
    """Row and bit of a key."""
    place = F.xxhash64(*columns).bitwiseAND(F.lit(bits - 1))
    return F.shiftright(place, ROW_BITS.bit_length() - 1), place.bitwiseAND(F.lit(ROW_BITS - 1))


def may_match(rows: DataFrame, columns: list[str], keys: DataFrame, key_columns: list[str]) -> DataFrame:
    """The rows whose ``columns`` may be among ``key_columns`` of ``keys`` (all that are, and few others). A null key is hashed like a value. No
    shuffle of ``rows``; ``keys`` is read twice, so it should be staged."""
    bits = bits_for(keys.count())
    if not bits:
        return rows
    row, bit = _place(bits, [keys[c] for c in key_columns])
    maps = keys.select(row.alias("sketch_row"), bit.alias("sketch_bit")).groupBy("sketch_row").agg(F.bitmap_construct_agg("sketch_bit").alias("sketch_bits"))
    row, bit = _place(bits, [rows[c] for c in columns])
    octet = F.conv(F.hex(F.substr(maps["sketch_bits"], F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(octet, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(maps), (row == maps["sketch_row"]) & held, "left_semi")
