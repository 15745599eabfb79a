"""Scoring arrivals against their entity's past, held in Spark's state store.

A micro-batch is added up by entity where it is read, so that a busy entity reaches its state as a few
rows, whichever task holds it. The state of an entity is three exact sums. It hands back the sums from
before the batch, one row for each entity that the batch has; entities not in the batch are not read.
The arrivals themselves go past the state, in the same batch, and are scored with block-wise running sums
that split a busy entity over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywarden.functions.exact import scaled
from tallywarden.plans.skew import ROWS_PER_TASK
from tallywarden.session import ship_package
from tallywarden.streaming.profile import SUMS, outliers
from tallywarden.streaming.sinks import write_batch

SUM_TYPES = ", ".join(f"{c} decimal(38,0)" for c in SUMS)
PRIOR = "_prior"
# Square sums are put together from parts of this many bits, so that none overflows 64.
PART_BITS = 24


def batch_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count, sum, sum of squares and latest time of each entity among some rows (entity, cents, micros), exactly."""
    for rows in frames:
        if rows.empty:
            continue
        cents = rows["cents"].to_numpy()
        high, low = cents >> PART_BITS, cents & ((1 << PART_BITS) - 1)
        parts = pd.DataFrame(
            {"entity": rows["entity"], "n": 1, "s": cents, "hh": high * high, "hl": high * low, "ll": low * low}
        )
        sums = parts.groupby("entity", sort=False).sum()
        latest = rows.groupby("entity", sort=False)["micros"].max()
        squares = [
            (int(hh) << 2 * PART_BITS) + (int(hl) << PART_BITS + 1) + int(ll)
            for hh, hl, ll in zip(sums["hh"], sums["hl"], sums["ll"], strict=True)
        ]
        yield pd.DataFrame(
            {
                "entity": sums.index,
                "n": [Decimal(int(x)) for x in sums["n"]],
                "s": [Decimal(int(x)) for x in sums["s"]],
                "ss": [Decimal(x) for x in squares],
                "micros": latest.reindex(sums.index).to_numpy(),
            }
        )


class Past(StatefulProcessor):
    """The sums of an entity: adds those of a batch and returns the ones from before it.

    With ``quiet_ms`` an entity that had no rows for so long, in event time, is forgotten.
    """

    def __init__(self, quiet_ms: int | None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", f"{SUM_TYPES}, until bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        old = self.sums.get() if self.sums.exists() else None
        if old and self.quiet_ms is not None and old[3] <= timerValues.getCurrentWatermarkInMs():
            # Its timer has run out as well, but Spark hands over rows first.
            self.handle.deleteTimer(old[3])
            old = None
        before = tuple(old[:3]) if old else (Decimal(0),) * 3
        added, latest = [Decimal(0)] * 3, 0
        for frame in rows:
            added = [a + sum(frame[c], Decimal(0)) for a, c in zip(added, SUMS, strict=True)]
            latest = max(latest, int(frame["micros"].max()))
        until = old[3] if old else 0
        if self.quiet_ms is not None:
            wanted = max(until, latest // 1000 + self.quiet_ms)
            if wanted != until:
                if until:
                    self.handle.deleteTimer(until)
                self.handle.registerTimer(wanted)
            until = wanted
        self.sums.update((*(b + a for b, a in zip(before, added, strict=True)), until))
        yield pd.DataFrame({"entity": [key[0]], **{c: [v] for c, v in zip(SUMS, before, strict=True)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.sums.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_past(events: DataFrame, entity: str, amount: str, ts: str = "ts", quiet_ms: int | None = None) -> DataFrame:
    """The stream's rows and, for each entity of a micro-batch, a row with its sums from before that batch.

    ``_prior`` marks the latter; they have the entity and the sums only. Rows without an entity or amount
    have no score, teach nothing and are left out. ``quiet_ms`` needs a watermark.
    """
    ship_package(events.sparkSession)
    known = events.where(F.col(entity).isNotNull() & F.col(amount).isNotNull())
    key = events.schema[entity].dataType
    slim = known.select(
        F.col(entity).alias("entity"), scaled(amount).alias("cents"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros")
    )
    summed = slim.mapInPandas(batch_sums, f"entity {key.simpleString()}, {SUM_TYPES}, micros bigint")
    past = summed.groupBy("entity").transformWithStateInPandas(
        Past(quiet_ms),
        outputStructType=f"entity {key.simpleString()}, {SUM_TYPES}",
        outputMode="Append",
        timeMode="EventTime" if quiet_ms is not None else "None",
    )
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != entity]
    priors = past.select(F.lit(True).alias(PRIOR), F.col("entity").alias(entity), *nothing, *(F.col(c).alias(f"{PRIOR}_{c}") for c in SUMS))
    rows = known.select(F.lit(False).alias(PRIOR), "*", *(F.lit(None).cast("decimal(38,0)").alias(f"{PRIOR}_{c}") for c in SUMS))
    return rows.unionByName(priors)


def state_scorer(
    folder: str, entity: str, order: list[str], amount: str, min_n: int, k: float, limit: int = ROWS_PER_TASK
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler for ``with_past`` that writes outliers to ``folder``/alerts.

    A repeated batch starts from the state before it and replaces its own output.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The state is read once for a batch; a lost part is worked out again from the state before it.
        batch = batch.persist()
        try:
            past = batch.where(PRIOR).select(entity, *(F.col(f"{PRIOR}_{c}").alias(c) for c in SUMS))
            rows = batch.where(~F.col(PRIOR)).drop(PRIOR, *(f"{PRIOR}_{c}" for c in SUMS))
            write_batch(outliers(rows, past, entity, order, amount, min_n, k, limit), f"{folder}/alerts", batch_id)
        finally:
            batch.unpersist()

    return handle
