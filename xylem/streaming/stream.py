"""Validation of a stream of documents: each micro-batch is validated as a table, as every document stands by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from xylem.operators.validate import Report, validate
from xylem.plans.schema import Schema


def validate_stream(docs: DataFrame, schema: Schema, sink: Callable[[Report, int], None], checkpoint: str, phase: str | None = None, id_col: str = "doc_id", xml_col: str = "xml", once: bool = False) -> StreamingQuery:
    """Starts a query that hands each batch's report and number to sink. once: ends when what is there has been read."""

    def each(batch: DataFrame, number: int) -> None:
        sink(validate(batch, schema, phase, id_col, xml_col), number)

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
