"""Exact samples of bounded size, by the smallest hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_RANGE = 1 << 30


def smallest_keys(spark: SparkSession, rows: DataFrame, group: str, sample: int) -> DataFrame | None:
    """(group, key) of the ``sample`` different keys of each group that are smallest modulo 2**30; None without any row.

    ``rows`` has a string column ``group`` and a column ``key`` of hashes.  A key counts once however often it
    occurs.  One row per group and about twice the sample of each reach the driver.
    """
    keys = rows.select(group, "key").distinct()
    sizes = {r[0]: r.n for r in keys.groupBy(group).agg(F.count("*").alias("n")).collect()}  # one row per group
    if not sizes:
        return None
    chosen: dict[str, list] = {}
    wanted = {name: 2.0 * sample / n for name, n in sizes.items()}
    while wanted:  # a share of twice the sample holds it all but surely; where not, the share grows
        limits = {name: int(min(1.0, share) * _RANGE) for name, share in wanted.items()}
        if len(sizes) == 1:
            part = keys.where(F.pmod("key", F.lit(_RANGE)) < next(iter(limits.values())))
        else:
            most = spark.createDataFrame(list(limits.items()), f"{group} string, most long")
            part = keys.join(F.broadcast(most), group).where(F.pmod("key", F.lit(_RANGE)) < F.col("most")).select(group, "key")
        found: dict[str, list] = {name: [] for name in wanted}
        for r in part.collect():
            found[r[0]].append((r.key % _RANGE, r.key))
        done = [name for name, rows_ in found.items() if len(rows_) >= min(sample, sizes[name])]
        chosen |= {name: sorted(found[name])[:sample] for name in done}
        wanted = {name: 2 * share for name, share in wanted.items() if name not in done}
    return spark.createDataFrame([(name, key) for name, rows_ in chosen.items() for _, key in rows_], f"{group} string, key long")
