"""Matching a stream of reads against an index that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.match import MatchOptions, match, with_mask
from ..operators.seeds import Mask


def match_stream(reads: DataFrame, index: DataFrame, frequency: DataFrame, mask: Mask, out: str, checkpoint: str, options: MatchOptions = MatchOptions()):
    """Match each batch of a stream of reads (read_id, end_no, seq); candidates go to Parquet, a folder per batch.

    A batch that is tried again writes its folder anew, so each read's candidates stand there once.
    """

    def matched(batch: DataFrame, number: int) -> None:
        cals, _ = match(batch, index, frequency, mask, options)
        with_mask(cals, mask).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(matched).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
