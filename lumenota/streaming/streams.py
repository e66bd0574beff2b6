"""Streaming forms: findings as invoices arrive, newest records per case, and running spend."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lumenota.operators.ordering import latest_per_key
from lumenota.operators.rules import validate

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPEND_SCHEMA = (
    "run_id string, ordinal bigint, spent decimal(18,8), assumed decimal(18,8), "
    "largest decimal(18,8), admitted boolean"
)
_STATE = "spent string, assumed string, largest string, stopped boolean"


def validate_stream(invoices: DataFrame, reference_date: str) -> DataFrame:
    """Findings of a stream of nested invoices: the batch rules, stateless and in append mode."""
    return validate(invoices, reference_date)


def latest_stream(
    records: DataFrame, path: str, order: list[str], checkpoint: str
) -> StreamingQuery:
    """Keep the newest record per case under ``path`` while records arrive.

    Each batch writes only its own newest records, into a folder named by its number, so a batch
    that is run again after a failure replaces what it wrote. ``read_latest`` merges the folders.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        newest = latest_per_key(batch, ["case_id"], order)
        newest.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return (
        records.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """The newest record per case over all batches of ``latest_stream``."""
    return latest_per_key(spark.read.parquet(path).drop("batch"), ["case_id"], order)


def compact(spark: SparkSession, path: str, target: str, order: list[str]) -> None:
    """Write the merged table once to a new folder, which can stand for the batches so far."""
    read_latest(spark, path, order).write.mode("errorifexists").parquet(f"{target}/batch=-1")


class SpendProcessor(StatefulProcessor):
    """Running spent, assumed and largest cost of a run; rows come in order of arrival."""

    def __init__(self, cap: str, reserve: str) -> None:
        self.cap, self.reserve = Decimal(cap), Decimal(reserve)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spend", _STATE)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        zero = Decimal(0)
        spent, assumed, largest, stopped = zero, zero, zero, False
        if self.state.exists():
            held = self.state.get()
            spent, assumed, largest = (Decimal(held[i]) for i in range(3))
            stopped = held[3]
        # One trigger's records of a run, put in order; the source's per-trigger limit bounds them.
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("ordinal")
        out = []
        for row in arrived.itertuples():
            following = max(self.reserve, largest)
            stopped = stopped or spent + assumed + following > self.cap
            spent, assumed = spent + row.spent, assumed + row.assumed
            largest = max(largest, row.spent)
            out.append((key[0], row.ordinal, spent, assumed, largest, not stopped))
        yield pd.DataFrame(
            out, columns=["run_id", "ordinal", "spent", "assumed", "largest", "admitted"]
        )
        self.state.update((str(spent), str(assumed), str(largest), stopped))

    def close(self) -> None:
        pass


def spend_stream(charged: DataFrame, cap: str, reserve: str) -> DataFrame:
    """Running spend and the stop flag per run of a stream of charged records (append mode).

    Needs the RocksDB state store provider. Each trigger's records must not come before those of
    earlier triggers in ``ordinal``.
    """
    narrow = charged.select("run_id", "ordinal", "spent", "assumed")
    return narrow.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=SpendProcessor(cap, reserve),
        outputStructType=SPEND_SCHEMA,
        outputMode="Append",
        timeMode="None",
    )


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over what is there now, handing each batch to ``sink``."""
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
