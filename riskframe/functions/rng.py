"""Hashed, partition-independent randomness.

Every random choice in the library (splits, folds, resamples, SMOTE partners,
isolation-tree subsamples, permutations) is a pure function of a seed and a row
key, so the same query gives the same answer on one core or a thousand
executors, after a lost executor is recomputed, and in the DuckDB oracle.

``h(seed, key)`` = first 8 hex digits of ``md5(seed || '|' || key)`` read as an
unsigned 32-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

H_RANGE = 4294967296.0  # 16**8


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x)


def h(seed, key) -> Column:
    """32-bit hash of ``seed|key`` as a bigint in [0, 2**32)."""
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat(seed_c.cast("string"), F.lit("|"), _as_col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def u01(seed, key) -> Column:
    """Uniform double in [0, 1) derived from ``h``."""
    return h(seed, key) / F.lit(H_RANGE)


def h_sql(seed_sql: str, key_sql: str) -> str:
    """The same hash as DuckDB SQL text (used by the oracle queries)."""
    return f"cast(('0x'||substr(md5(concat({seed_sql},'|',{key_sql})),1,8)) as ubigint)::bigint"


def h_spark_sql(seed_sql: str, key_sql: str) -> str:
    """The same hash as Spark SQL text."""
    return f"cast(conv(substr(md5(concat({seed_sql},'|',{key_sql})),1,8),16,10) as bigint)"


class KeyedBijection:
    """A bijection on 0 … n − 1 chosen by a seed: rounds that add a hash of one half of the number to the other
    (a Feistel network on a × b ≥ n numbers), walked on until the number is below n. Any number's image is worked out
    alone, so distinct ranks can be drawn without ranking anything."""

    def __init__(self, n: int, *seed: int, rounds: int = 6) -> None:
        import numpy as np
        self.n = n
        self.a = max(1, int(np.ceil(np.sqrt(n))))
        self.b = -(-n // self.a)
        self.keys = np.random.default_rng(seed).integers(0, 1 << 63, rounds).astype(np.uint64)

    def _mixed(self, x, key):
        import numpy as np
        with np.errstate(over="ignore"):
            z = (x.astype(np.uint64) ^ key) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(32))

    def _once(self, x):
        import numpy as np
        left, right = x // self.b, x % self.b
        for k, key in enumerate(self.keys):
            if k % 2:
                right = (right + (self._mixed(left, key) % np.uint64(self.b)).astype(np.int64)) % self.b
            else:
                left = (left + (self._mixed(right, key) % np.uint64(self.a)).astype(np.int64)) % self.a
        return left * self.b + right

    def __call__(self, x):
        """Images of an array of numbers below n."""
        import numpy as np
        x = self._once(np.asarray(x, np.int64))
        while (out := x >= self.n).any():
            x[out] = self._once(x[out])
        return x
