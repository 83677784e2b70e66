"""The positions → risk plan on a file stream gives the batch answer."""

import uuid

from pyspark.sql import functions as F

from ledgerlake.operators.positions import rollup_positions
from ledgerlake.operators.risk import risk_factors, risk_summary
from ledgerlake.session import scratch_path
from ledgerlake.sources import fixtures as FX
from ledgerlake.sources.tables import Tables
from ledgerlake.streaming import live_risk

from conftest import SF_SMALL


def test_stream_matches_batch(spark):
    facts = FX.position_facts(Tables(spark, SF_SMALL)).select(
        "entity_id", "revenue", "expenses", (F.coalesce("open_amt", F.lit(0.0)) * 0.5).alias("liabilities"),
        F.col("collected").alias("cash"))
    src = scratch_path(spark, "stream-src")
    facts.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"live_{uuid.uuid4().hex[:8]}"
    q = (live_risk(stream).writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", scratch_path(spark, "stream-ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["entity_id"]: r["risk_level"] for r in spark.table(name).collect()}
    want = {r["entity_id"]: r["risk_level"] for r in risk_summary(risk_factors(rollup_positions(facts))).collect()}
    assert got == want
