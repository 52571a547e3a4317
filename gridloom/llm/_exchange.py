"""Dealing packed keys to buckets: a map step sends arrays of 64-bit keys, one task sorts one bucket at a time.

A row holds all keys that one block of documents has in one bucket, so a shuffle moves 8 bytes a key and no row overhead.
Buckets are ranges of the key; their number follows the data, so that a bucket stays near TARGET bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession

TARGET = 16 << 20


def n_buckets(spark: SparkSession, key_bytes: float) -> int:
    return int(min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-key_bytes // TARGET))))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cuts(sorted_keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, a, b) of each bucket that has keys, where sorted_keys[a:b] are its keys."""
    if len(sorted_keys):
        b = bucket_of(sorted_keys, n)
        at = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield int(b[i]), i, j


def block_ids() -> Iterator[int]:
    """Ids that no other task gives, and that a repeated attempt gives again."""
    k = TaskContext.get().partitionId() << 31
    while True:
        yield k
        k += 1
