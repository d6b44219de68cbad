"""Requests as a stream against the static table of places. The table of places is not a stream; nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.service import answer
from ..sources.files import json_response, parse_requests


def serve(places: DataFrame, bodies: DataFrame, path: str, checkpoint: str, k: int = 10, once: bool = False) -> StreamingQuery:
    """Answers a stream (req_id, body); each batch appends (req_id, response) as Parquet under path, in a folder of its own.

    A batch that is run again after a failure replaces its own folder. Requests without any hit have no reply row.
    """

    def reply(batch: DataFrame, number: int) -> None:
        json_response(answer(places, parse_requests(batch), k), "req_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = bodies.writeStream.foreachBatch(reply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
