"""Message-broker source and sink options. The connector jar comes with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming.envelope import TOPICS, encode_events

# Fixed value: the consumer group that existing deployments use.
GROUP = "inventory-manager"


def source_options(servers: str, topics: list[str] | None = None, group: str = GROUP, start: str = "latest",
                   max_per_batch: int | None = None, fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of the source. Lost offsets stop the query unless ``fail_on_data_loss`` is off."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics or sorted(set(TOPICS.values()))),
               "kafka.group.id": group, "startingOffsets": start, "failOnDataLoss": str(fail_on_data_loss).lower()}
    if max_per_batch is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_batch)
    return options


def sink_options(servers: str, retries: int = 3) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.retries": str(retries)}


def read_stream(spark: SparkSession, servers: str, **options) -> DataFrame:
    return spark.readStream.format("kafka").options(**source_options(servers, **options)).load()


def write_stream(events: DataFrame, servers: str, checkpoint: str):
    """Key, topic and value come from the envelope; the checkpoint gives at-least-once delivery."""
    return (encode_events(events).writeStream.format("kafka").options(**sink_options(servers))
            .option("checkpointLocation", checkpoint))
