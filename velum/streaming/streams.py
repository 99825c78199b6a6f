"""The operators on streams: row by row without state, and a token vault with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.operators import gate, mask
from velum.operators.detect import find, find_udf

#: SQL name of find over one text, after register_sql().
SQL_NAME = "velum_find"


def register_sql(spark, name: str = SQL_NAME, **options) -> None:
    """find as an SQL function: ``SELECT inline(velum_find(text)) FROM t``, on tables and streams."""
    spark.udf.register(name, find_udf(**options))


find_stream = find  # a row's matches come from that row alone: append mode, no state
mask_stream = mask.mask
decide_stream = gate.decide


def exposure_by_window(found: DataFrame, time_col: str, window: str = "10 minutes", late: str = "20 minutes", slide: str | None = None) -> DataFrame:
    """Matches per entity and time window of a stream of matches; rows later than ``late`` are left out."""
    frame = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return found.withWatermark(time_col, late).groupBy(frame.alias("window"), "entity").agg(F.count("*").alias("n_matches"))


def vault_stream(events: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Reveals over a stream of (scope_id, kind, token, value): 'put' stores a token, 'get' answers with the value once.

    State is one map for each scope, with a time to live, in the state store;
    needs the RocksDB provider. A 'get' uses up the whole scope.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Vault(StatefulProcessor):
        def init(self, handle):
            self.tokens = handle.getMapState("tokens", "token string", "value string", ttl_ms)

        def handleInputRows(self, key, rows, timer_values):
            import pandas as pd

            asked, out = [], []
            for batch in rows:
                for r in batch.itertuples():
                    if r.kind == "put":
                        self.tokens.updateValue((r.token,), (r.value,))
                    else:
                        asked.append(r.token)
            for token in asked:
                found = self.tokens.getValue((token,)) if self.tokens.containsKey((token,)) else None
                out.append((key[0], token, found[0] if found else None))
            if asked:
                self.tokens.clear()
            yield pd.DataFrame(out, columns=["scope_id", "token", "value"])

        def close(self):
            pass

    return events.groupBy("scope_id").transformWithStateInPandas(statefulProcessor=Vault(), outputStructType="scope_id string, token string, value string", outputMode="Append", timeMode="ProcessingTime")
