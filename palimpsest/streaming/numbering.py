"""Streams: stateless pseudonyms, numbering kept by session, verified batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions.crypto import fuzzy
from palimpsest.operators import anonymize as an
from palimpsest.operators import detectors as dt
from palimpsest.operators import verify as vf

NUMBERED = T.StructType([T.StructField("session", T.StringType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("error", T.StringType())])
STATE = T.StructType([T.StructField("keys", T.MapType(T.StringType(), T.IntegerType())), T.StructField("counters", T.MapType(T.StringType(), T.IntegerType()))])


def stateless(df: DataFrame, key: bytes, text: str = "text", detectors: list[dt.Detector] = dt.ALL) -> DataFrame:
    """Pseudonyms from a keyed index: the same in every batch without state, so the first choice for streams."""
    return an.anonymize(dt.with_entities(df, text, detectors), text, strategy="keyed", key=key)


def numbered(df: DataFrame, session: str = "session_id", text: str = "text", detectors: list[dt.Detector] = dt.ALL, most: int = 100_000, timeout: str = "ProcessingTimeTimeout") -> DataFrame:
    """(session, type, text, index, error): new entities of a stream numbered within their session and type, by arrival.

    The state holds a session's known texts, `most` at most: beyond it a row carries the error and the session takes no more.
    Batches number by position, streams by arrival; use `stateless` where both must agree.
    """
    rows = dt.entity_rows(df.select(F.col(session).alias("session"), F.col(text).alias("__t")), ["session"], "__t", detectors).where(~an.is_secret(F.col("type")) & F.col("session").isNotNull())
    keyed = rows.select("session", "type", "text", fuzzy(F.col("text")).alias("key"), "start")

    def step(group: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, counters = (dict(x) for x in state.get) if state.exists else ({}, {})
        out = []
        for batch in batches:
            for r in batch.itertuples():
                if r.key in keys:
                    continue
                if len(keys) >= most:
                    out.append((group[0], r.type, r.text, None, "session full"))
                    continue
                counters[r.type] = counters.get(r.type, 0) + 1
                keys[r.key] = counters[r.type]
                out.append((group[0], r.type, r.text, counters[r.type], None))
        state.update((keys, counters))
        yield pd.DataFrame(out, columns=NUMBERED.names)

    return keyed.groupBy("session").applyInPandasWithState(step, NUMBERED, STATE, "append", GroupStateTimeout.NoTimeout if timeout == "NoTimeout" else getattr(GroupStateTimeout, timeout))


def verified_batches(source: str = "text", on_clean: Callable[[DataFrame, int], None] = lambda df, n: None, on_rejected: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for `foreachBatch`: anonymise, verify, hand over clean and rejected rows.

    Without a place for rejected rows, a leak fails the batch, which is then not committed.
    """

    def run(batch: DataFrame, number: int) -> None:
        found = dt.with_entities(batch, source)
        out = vf.verify(an.anonymize(found, source, mark=an.nonce(F.col(source)), expose_secrets=True), source)
        clean, rejected = vf.strict(out)
        if on_rejected is None:
            if rejected.limit(1).count():
                raise RuntimeError("leaks in the output: batch refused")
        else:
            on_rejected(rejected, number)
        on_clean(clean, number)

    return run
