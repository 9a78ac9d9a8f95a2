"""Sharding by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import range_width, ranked

#: Fixed values of jump consistent hashing: the multiplier of its generator, by 32-bit halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
MASK = 0xFFFFFFFF


def _low_product(a0: Column, a1: Column, factor: int) -> tuple[Column, Column]:
    """(a1 * 2^16 + a0) * factor as 32-bit (low, carry); no step passes 2^63, so ANSI arithmetic is safe."""
    first, second = a0 * F.lit(factor), a1 * F.lit(factor)
    total = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    return total.bitwiseAND(F.lit(MASK)), F.shiftright(total, 32) + F.shiftright(second, 16)


def _let(value: Column, body) -> Column:
    """`body` of `value`, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _next_key(high: Column, low: Column) -> Column:
    """key * multiplier + 1 modulo 2^64, as a struct of 32-bit halves."""
    low0, low1 = low.bitwiseAND(F.lit(0xFFFF)), F.shiftright(low, 16)
    high0, high1 = high.bitwiseAND(F.lit(0xFFFF)), F.shiftright(high, 16)
    product, carry = _low_product(low0, low1, MULTIPLIER_LOW)
    cross, _ = _low_product(low0, low1, MULTIPLIER_HIGH)
    other, _ = _low_product(high0, high1, MULTIPLIER_LOW)
    low_plus = product + F.lit(1)
    return F.struct(
        (carry + cross + other + F.shiftright(low_plus, 32)).bitwiseAND(F.lit(MASK)).alias("high"),
        low_plus.bitwiseAND(F.lit(MASK)).alias("low"),
    )


def jump_shards(key: Column, shards: int) -> Column:
    """Struct of the jump hash of a long for `shards` buckets (`now`) and for one more (`grown`).

    The jumps for n and n + 1 buckets are one ascending sequence, so both are read off the same walk.
    Each jump goes up by one at least: `shards` + 1 steps always end it.
    """
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(MASK)).alias("low"),
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("grown"),
    )

    def step(state: Column, _: Column) -> Column:
        moved = _let(
            _next_key(state["high"], state["low"]),
            lambda k: F.struct(
                k["high"].alias("high"), k["low"].alias("low"),
                F.floor((state["at"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(k["high"], 1) + 1).cast("double"))).cast("long").alias("at"),
                F.when(state["at"] < shards, state["at"]).otherwise(state["now"]).alias("now"),
                state["at"].alias("grown"),
            ),
        )
        return F.when(state["at"] <= shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Places documents into `shards` shards by their key alone; law `key`.

    Returns doc_id, size (UTF-8 bytes of the text plus 8; a null text has none), text_crc32, law, shard,
    slot (place in the shard by doc_id, gapless from 0) and grown_shard (with one more shard: the same, or
    the new one). A null doc_id counts as key 0 and comes first in its shard. Repeated rows take a slot each;
    ties go by size and checksum. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = keyed.withColumn("_jump", jump_shards(F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), shards)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"),
        F.col("_jump.now").cast("int").alias("shard"), F.col("_jump.grown").cast("int").alias("grown_shard"),
    )
    width = range_width(documents.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id")
    return ranked(placed, ["shard"], "doc_id", [F.col("size"), F.col("text_crc32")], width, "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
