"""The run log and the people who wait for pages, as streams that take up after a stop where they were."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE = "at timestamp, id long, outcome string, asked string, status string, reopened boolean, runs long"
STEP_STATES = "step long, source long, outcome string, asked string, status string, again boolean, runs long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _StepRuns(StatefulProcessor):
    """One step at one source: its last run that answered, whether it was reopened since, and how many runs there were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)
        self.opened = handle.getValueState("opened", "at timestamp, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held = self.last.get() if self.last.exists() else None
        reopened = self.opened.get() if self.opened.exists() else None
        at, ident, outcome, asked, n = (held[0], held[1], held[2], held[3], held[6]) if held else (None, None, None, None, 0)
        for b in rows:
            for r in b.itertuples(index=False):
                n += 1
                mark = (r.ts, r.id)
                if r.outcome == "reopen":
                    reopened = max(reopened, mark) if reopened else mark
                elif r.outcome != "error" and (at is None or mark > (at, ident)):
                    at, ident, outcome, asked = r.ts, r.id, r.outcome, r.asked
        again = bool(reopened and at is not None and tuple(reopened) > (at, ident))
        status = "done" if outcome == "found" and not again else "planned"
        self.last.update((at, ident, outcome, asked, status, again, n))
        if reopened:
            self.opened.update(tuple(reopened))
        yield pd.DataFrame({"step": [key[0]], "source": [key[1]], "outcome": [outcome], "asked": [asked], "status": [status], "again": [again], "runs": [n]})

    def close(self) -> None:
        pass


def step_states(runs: DataFrame) -> DataFrame:
    """STEP_STATES of the steps that a batch of ``runs`` (step, source, ts, id, outcome, asked) touches, in update mode.

    The last run that is neither an error nor a reopening counts, by ts and id, whatever order runs come in; a later reopening
    plans the step again. A step is done while its last run found its record. Steps and sources are keys of state; rows without one are dropped.
    """
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = runs.where("step IS NOT NULL AND source IS NOT NULL AND ts IS NOT NULL").select(F.col("step").cast("long").alias("step"), F.col("source").cast("long").alias("source"), "ts", F.col("id").cast("long").alias("id"), "outcome", "asked")
    return keyed.groupBy("step", "source").transformWithStateInPandas(statefulProcessor=_StepRuns(), outputStructType=STEP_STATES, outputMode="Update", timeMode="None")


def log_runs(runs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the states that each batch touches to ``out``/batch=N; a batch repeated after a failure replaces its own."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return step_states(runs).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, out: str) -> DataFrame:
    """The present state of every step: its row of the last batch that touched it."""
    rows = spark.read.parquet(out)
    value = F.struct(*[c for c in rows.columns if c not in ("step", "source", "batch")])
    return rows.groupBy("step", "source").agg(F.max_by(value, "batch").alias("v")).select("step", "source", "v.*")


def resume_waiting(arrivals: DataFrame, waiting: str, out: str, checkpoint: str) -> StreamingQuery:
    """(person, n_came, n_open) for the people whom each batch of ``arrivals`` (page) reaches, in ``out``/people/batch=N.

    ``waiting`` is a table (person, page). A page counts once, however often it arrives; n_open is how many of the person's pages are still
    out after the batch. Pages seen are kept in ``out``/pages/batch=N and a batch looks only at those of batches before its own, so one that is repeated after a failure
    gives the same rows again in the same place: each arrival is taken in exactly once.
    """

    def take(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        pages = batch.select("page").where("page IS NOT NULL").distinct()
        if n:
            seen = session.read.schema("page long, batch int").option("basePath", f"{out}/pages").parquet(f"{out}/pages").where(F.col("batch") < n).select("page")
            pages = pages.join(seen, "page", "left_anti")
        pages.write.mode("overwrite").parquet(f"{out}/pages/batch={n}")
        here = session.read.schema("page long, batch int").option("basePath", f"{out}/pages").parquet(f"{out}/pages").where(F.col("batch") <= n)
        w = session.read.parquet(waiting).select("person", "page").distinct().join(here, "page", "left")
        people = w.groupBy("person").agg(F.count_if(F.col("batch") == n).alias("n_came"), F.count_if(F.col("batch").isNull()).alias("n_open")).where("n_came > 0")
        people.write.mode("overwrite").parquet(f"{out}/people/batch={n}")

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
