"""SQL functions of this library for a session: scalar and table functions that the optimizer inlines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

FUNCTIONS = {
    "lw_tier(score DOUBLE) RETURNS STRING": "CASE WHEN score >= 9 THEN 'platinum' WHEN score >= 7 THEN 'gold' WHEN score >= 5 THEN 'silver' ELSE 'rejected' END",
    "lw_preview(content STRING, n INT) RETURNS STRING": "CASE WHEN length(content) > n THEN concat(substring(content, 1, n), '…') ELSE content END",
    # For LATERAL over columns of a table use lw_paragraph_list and inline: a table function over a column is joined to the rows again by their whole texts.
    "lw_paragraphs(content STRING, least INT) RETURNS TABLE (paragraph INT, body STRING)": "SELECT pos, col FROM posexplode(split(content, chr(10))) WHERE length(trim(col)) >= least",
    "lw_paragraph_list(content STRING, least INT) RETURNS ARRAY<STRUCT<paragraph: INT, body: STRING>>": "filter(transform(split(content, chr(10)), (p, i) -> struct(i AS paragraph, p AS body)), x -> length(trim(x.body)) >= least)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; calling it again changes nothing."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def visits_function(gap_s: float):
    """A table function over TABLE(...) PARTITION BY key ORDER BY time: visits of a key, which end after a pause of gap_s seconds.

    The table has key (text) and t (seconds). Batches of rows come in order; one visit is kept.
    """

    class Visits:
        def __init__(self):
            self.now = None

        def eval(self, rows: pa.RecordBatch):
            keys, times = rows.column("key").to_pylist(), rows.column("t").to_pylist()
            done = []
            for key, t in zip(keys, times, strict=True):
                if self.now is not None and self.now[0] == key and t - self.now[2] < gap_s:
                    self.now = (key, self.now[1], t, self.now[3] + 1)
                else:
                    done += [self.now] if self.now is not None else []
                    self.now = (key, t, t, 1)
            yield self._table(done)

        def terminate(self):
            yield self._table([self.now] if self.now is not None else [])

        @staticmethod
        def _table(rows: list) -> pa.Table:
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (("key", pa.string()), ("since", pa.float64()), ("until", pa.float64()), ("n", pa.int64()))
            return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)})

    return F.arrow_udtf(Visits, returnType="key string, since double, until double, n long")


def register_visits(spark: SparkSession, name: str = "lw_visits", gap_s: float = 1800.0) -> None:
    """Makes visits_function known to the session's SQL."""
    spark.udtf.register(name, visits_function(gap_s))
