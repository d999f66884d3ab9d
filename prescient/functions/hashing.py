"""Deterministic, partition-independent hashing used for splits and samples.

``randomSplit`` depends on partitioning and ordering; an md5 bucket of the row
key does not, so a split is reproducible across cluster sizes and equals the
same expression evaluated by any SQL engine that has ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bucket space and the train share of a 70/30 split.
BUCKETS = 1000
TRAIN_BUCKETS = 700


def md5_bucket(salt, key) -> Column:
    """First 32 bits of md5('<salt>_<key>') as a non-negative bigint."""
    salt_c = salt if isinstance(salt, Column) else F.lit(str(salt))
    key_c = key if isinstance(key, Column) else F.col(key)
    digest = F.md5(F.concat_ws("_", salt_c.cast("string"), key_c.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
