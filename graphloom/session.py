"""A session with the settings that keyed graph tables want."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    # data hashed by graph_id serves joins and aggregates on (graph_id, ...) without another shuffle
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "graphloom", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    return (builder.master(master) if master else builder).getOrCreate()
