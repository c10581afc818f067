"""Every query of the library and its SQL, by name.

Whole numbers of a query are 64-bit on both sides, whatever width an operator chose.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import queries_headers, queries_search, queries_text


def _wide(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(run)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.withColumns({f.name: F.col(f"`{f.name}`").cast("long") for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))})

    return query


QUERIES = {name: _wide(run) for name, run in (queries_text.QUERIES | queries_search.QUERIES | queries_headers.QUERIES).items()}
ORACLES = {name: sql.replace(" AS INT)", " AS BIGINT)") for name, sql in (queries_text.ORACLES | queries_search.ORACLES | queries_headers.ORACLES).items()}
