"""Permutations of row numbers that are computed, not sorted.

Number x of 0..n-1 is a pair (u, v) with x = v a + u, a the root of n rounded up.  Six rounds add a keyed function of one
half to the other, which can be undone, so they are a bijection of the a b pairs; what lands at n or above takes the rounds
again until it doesn't.  Hence any row's partner under permutation p of a seed is known without the other rows: no sort,
no window, no shuffle of units times permutations.  The column function, the numpy function and the SQL give the same
numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import materialise, maybe_broadcast

#: A prime below 2^31 and two multipliers, so that every product stays below 2^62.
PRIME, FIRST, SECOND, ROUNDS = 2147483647, 48271, 69621, 6


def _mixed(x, key):
    """A keyed function of whole numbers, for columns and arrays alike."""
    y = (x + key) % PRIME * FIRST % PRIME
    return (y * y % PRIME * SECOND + key) % PRIME


def _key(seed, perm, r: int):
    return _mixed((perm * 8191 + seed * 131071 + r * 524287 + 17) % PRIME, 12345)


def partners(place: np.ndarray, n: int, perm: int, seed: int) -> np.ndarray:
    """Where permutation `perm` of `seed` takes each of `place` (below n); perm 0 leaves them."""
    if perm == 0:
        return place.astype(np.int64)
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    keys = [int(_key(seed, perm, r)) for r in range(ROUNDS)]
    out, due = np.array(place, np.int64), np.arange(len(place))
    while len(due):
        u, v = out[due] % a, out[due] // a
        for r, k in enumerate(keys):
            if r % 2:
                v = (v + _mixed(u, k)) % b
            else:
                u = (u + _mixed(v, k)) % a
        out[due] = v * a + u
        due = due[out[due] >= n]
    return out


#: Shares of a Poisson variable of mean one that are at most 0, 1, 2, ...
POISSON = [sum(np.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def poisson(place: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """How often draw `draw` of `seed` has each row, by its number."""
    key = int(_key(seed, draw, 99))
    u = _mixed(_mixed(place % PRIME, key), int(_key(seed, draw, 100))) / PRIME
    return np.searchsorted(POISSON, u, "right").astype(float)


def _round_trip(x: Column, a: Column, b: Column, seed: int, perm: Column) -> Column:
    u, v = x % a, F.floor(x / a).cast("long")
    state = F.struct(u.alias("u"), v.alias("v"))
    keys = F.array(*[_key(F.lit(seed).cast("long"), perm.cast("long"), r) for r in range(ROUNDS)])
    step = lambda s, k: F.struct(((s["u"] + _mixed(s["v"], k["even"])) % a).alias("u"), s["v"].alias("v"))
    both = lambda s, k: (lambda t: F.struct(t["u"].alias("u"), ((t["v"] + _mixed(t["u"], k["odd"])) % b).alias("v")))(step(s, k))
    pairs = F.array(*[F.struct(F.get(keys, F.lit(r)).alias("even"), F.get(keys, F.lit(r + 1)).alias("odd")) for r in range(0, ROUNDS, 2)])
    return F.aggregate(pairs, state, both, lambda s: s["v"] * a + s["u"])


def partner(place: Column, n: Column, perm: Column, seed: int) -> Column:
    """`partners` as a column.  At most a b - n numbers lie at n or above, so that many further rounds end every walk; rows
    that need none, nearly all, don't take them."""
    n = n.cast("long")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    once = _round_trip(place.cast("long"), a, b, seed, perm)
    again = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(a * b - n, F.lit(1))), once, lambda x, _: F.when(x < n, x).otherwise(_round_trip(x, a, b, seed, perm)))
    return F.when(perm == 0, place.cast("long")).when(once < n, once).otherwise(again)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """df with row numbers 0, 1, ... within `keys` in the order of `order`, null first, and `n`, how many rows the keys have.
    Ranges of the order are numbered by themselves and moved by what lies before them, so that no task sees all rows of a
    key."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    ranges = df.repartitionByRange(*by).sortWithinPartitions(*by)
    held = materialise(ranges.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "numbered")
    parts = held.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__c"), F.min("__at").alias("__first"))
    within = Window.partitionBy(*keys)  # a row for each range that a key lies in
    starts = parts.select(*keys, "__part", "__first", (F.sum("__c").over(within.orderBy("__part")) - F.col("__c")).alias("__before"), F.sum("__c").over(within).alias("n"))
    at = starts.select("__part", "__first", "__before", "n", *[F.col(k).alias(f"__{k}") for k in keys])
    same = F.col("__p") == F.col("__part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = held.withColumnRenamed("__part", "__p").join(maybe_broadcast(materialise(at, "number-starts")), same)
    return both.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__p", "__at", "__first", "__before", *[f"__{k}" for k in keys])


def poisson_sql(place: str, draw: str, seed: int) -> str:
    """`poisson` for DuckDB."""
    mixed = lambda x, k: f"((((({x}) + {k}) % {PRIME} * {FIRST}) % {PRIME}) * ((({x}) + {k}) % {PRIME} * {FIRST} % {PRIME}) % {PRIME} * {SECOND} + {k}) % {PRIME}"
    key = lambda r: f"({mixed(f'(({draw}) * 8191 + {seed * 131071} + {r * 524287} + 17) % {PRIME}', 12345)})"
    u = f"({mixed(mixed(place, key(99)), key(100))})::DOUBLE / {PRIME}"
    return f"len(list_filter([{', '.join(map(repr, map(float, POISSON)))}]::DOUBLE[], lambda s: s <= {u}))"


def sql(rows: str, keys: str, perms: int, seed: int, name: str = "dealt") -> str:
    """CTEs ending in `name` (keys, perm, place, partner) for a CTE `rows` with keys and n, for a DuckDB WITH RECURSIVE."""
    mixed = lambda x, k: f"((((({x}) + {k}) % {PRIME} * {FIRST}) % {PRIME}) * ((({x}) + {k}) % {PRIME} * {FIRST} % {PRIME}) % {PRIME} * {SECOND} + {k}) % {PRIME}"
    key = lambda r: f"({mixed(f'((perm * 8191 + {seed * 131071} + {r * 524287} + 17) % {PRIME})', 12345)})"
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"f.{k} = w.{k}" for k in names)
    ctes = [f"{name}_n AS (SELECT DISTINCT {keys}, n::BIGINT AS n, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b FROM {rows})", f"{name}_k AS (SELECT perm, {', '.join(f'{key(r)} AS k{r}' for r in range(ROUNDS))} FROM range(1, {perms + 1}) t(perm))"]
    ctes.append(f"{name}_0 AS (SELECT n.*, k.*, x, x % a AS u, x // a AS v FROM {name}_n n CROSS JOIN {name}_k k CROSS JOIN LATERAL (SELECT unnest(range(0, a * b)) AS x))")
    for r in range(ROUNDS):
        half = f"(u + {mixed('v', f'k{r}')}) % a AS u" if r % 2 == 0 else f"(v + {mixed('u', f'k{r}')}) % b AS v"
        ctes.append(f"{name}_{r + 1} AS (SELECT * REPLACE ({half}) FROM {name}_{r})")
    ctes.append(f"{name}_f AS (SELECT {keys}, n, perm, x, v * a + u AS y FROM {name}_{ROUNDS})")
    ctes.append(f"{name}_w AS (SELECT {keys}, n, perm, x AS place, y FROM {name}_f WHERE x < n UNION ALL SELECT {', '.join(f'w.{k}' for k in names)}, w.n, w.perm, place, f.y FROM {name}_w w JOIN {name}_f f ON {same} AND f.perm = w.perm AND f.x = w.y WHERE w.y >= w.n)")
    ctes.append(f"{name} AS (SELECT {keys}, perm, place, y AS partner FROM {name}_w WHERE y < n UNION ALL SELECT {keys}, 0, x, x FROM {name}_n CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS x))")
    return ",\n".join(ctes)
