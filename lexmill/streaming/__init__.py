from lexmill.streaming.jobs import (
    append_stream,
    each_batch,
    read_arriving,
    read_batches,
    score_stream,
    score_stream_by_join,
    score_stream_by_stage,
    stream_token_counts,
    summed_counts,
)

__all__ = [
    "append_stream",
    "each_batch",
    "read_arriving",
    "read_batches",
    "score_stream",
    "score_stream_by_join",
    "score_stream_by_stage",
    "stream_token_counts",
    "summed_counts",
]
