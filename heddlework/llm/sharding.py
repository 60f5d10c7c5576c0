"""Sharding by a Feistel permutation of global row numbers.

A keyed Feistel network permutes the numbers of the smallest even-bit domain that holds all
rows; a number that lands outside the rows walks on along its cycle until it lands inside.
So the network is a bijection of 0 to N-1 that anybody can compute, forwards and backwards,
from the number of rows and the key alone. A row's new place gives shard (place mod shards)
and slot (place div shards): shard sizes differ by one row at most and slots have no gaps.

Rows are numbered by id, then checksum and size. Rows equal in all three are interchangeable.
Null texts have size 1; null ids come first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddlework.llm.common import numbered, text_bytes

KEY = 0x5EED
ROUNDS = 6


class Feistel:
    """A permutation of 0 to ``n`` - 1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [_mix(np.array([key * 1_000_003 + r], dtype=np.uint64))[0] for r in range(rounds)]

    def place(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._forward)

    def number(self, places: np.ndarray) -> np.ndarray:
        """The inverse of ``place``."""
        return self._walk(places, self._back)

    def _walk(self, values: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(values).astype(np.uint64))
        while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[outside] = step(out[outside])
        return out.astype(np.int64)

    def _forward(self, x: np.ndarray) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (_mix(right ^ key) & self.mask)
        return (left << shift) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ (_mix(left ^ key) & self.mask), left
        return (left << shift) | right


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with the constants of splitmix64 (fixed values)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shard_rows(docs: DataFrame, stage, shards: int = 8, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, one row for each document."""
    data = text_bytes("text")
    narrow = docs.select(
        "doc_id", (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")
    )
    rows, n = numbered(narrow, stage, ["doc_id", "text_crc32", "size"])
    network = Feistel(n, key)

    def place(numbers: pa.Array) -> pa.Array:
        return pa.array(network.place(numbers.to_numpy(zero_copy_only=False)))

    place.__annotations__ = {"numbers": pa.Array, "return": pa.Array}
    placed = rows.withColumn("place", F.arrow_udf(place, "bigint")("row_number"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place DIV {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
