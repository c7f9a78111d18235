"""Functions for SQL: register(spark) makes them known to a session.

    safe_path(p), json_str(s), excluded_path(p)    SQL expressions, inlined into plans
    cdc_chunks(key, data)                          table function: content-defined chunks
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemark.functions.scalars import EXCLUDED, LONGEST_PATH

EXPRESSIONS = {
    "safe_path": ("p STRING", "BOOLEAN", rf"octet_length(p) <= {LONGEST_PATH} AND NOT contains(p, '\\') AND NOT contains(p, '\u0000') AND forall(split(p, '/', -1), s -> s NOT IN ('', '.', '..'))"),
    "excluded_path": ("p STRING", "BOOLEAN", f"arrays_overlap(split(p, '/'), array({', '.join(repr(n) for n in EXCLUDED)}))"),
    "json_str": ("s STRING", "STRING", "substring(to_json(array(s)), 2, length(to_json(array(s))) - 2)"),
}


@udtf(returnType="pos int, start long, length long, hash string")
class CdcChunks:
    def eval(self, data: bytes, least: int, average: int, most: int) -> Iterator[tuple]:
        from tidemark.operators.chunks import cut_points

        start = 0
        for pos, end in enumerate(cut_points(data or b"", least, average, most)):
            yield pos, start, end - start, hashlib.sha256(data[start:end]).hexdigest()
            start = end


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("cdc_chunks", CdcChunks)
