from decimal import Decimal as D

from lumenota.operators import rules
from lumenota.streaming import streams
from tests.fixtures import SCHEMA, frame, invoice


def test_validate_stream_equals_batch(spark, tmp_path):
    bad = invoice(2)
    bad["recipient"]["uf"] = "ZZ"
    frame(spark, [invoice(1), bad]).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    seen = []
    streams.drain(
        streams.validate_stream(source, "2026-04-01"),
        lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "state"),
    )
    batch = rules.validate(frame(spark, [invoice(1), bad]), "2026-04-01").collect()
    assert sorted(map(str, seen)) == sorted(map(str, batch)) and seen


def test_latest_stream_over_two_batches(spark, tmp_path):
    schema = "case_id string, ordinal int, status string"
    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.latest_stream(source, str(tmp_path / "t"), ["ordinal"], str(tmp_path / "s")).awaitTermination()

    run([("a", 1, "x"), ("b", 2, "x"), ("a", 3, "y")])
    run([("b", 4, "z")])
    found = {r.case_id: r.status for r in streams.read_latest(spark, str(tmp_path / "t"), ["ordinal"]).collect()}
    assert found == {"a": "y", "b": "z"}


def test_spend_stream_keeps_state_between_batches(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    schema = "run_id string, ordinal bigint, spent decimal(18,8), assumed decimal(18,8)"
    seen = []

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.drain(
            streams.spend_stream(source, "3", "1"),
            lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "state"),
        )

    run([("r", 1, D(1), D(0)), ("r", 2, D(1), D(0))])
    run([("r", 3, D(0), D(1)), ("r", 4, D(0), D(0))])
    got = {r.ordinal: (r.spent, r.assumed, r.admitted) for r in seen}
    assert got == {1: (1, 0, True), 2: (2, 0, True), 3: (2, 1, True), 4: (2, 1, False)}
