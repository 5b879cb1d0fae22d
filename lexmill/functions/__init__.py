from lexmill.functions.arrays import (
    argmax,
    decode,
    negative_log_likelihood,
    predicted_class,
    predicted_probability,
    round_half_even,
    softmax,
)
from lexmill.functions.text import (
    class_index,
    drop_last_segment,
    first_tokens,
    hash_fraction,
    last_segment,
    normalized_text,
    rewrite_mount_prefix,
    stringify,
    tokens,
)

__all__ = [
    "argmax",
    "class_index",
    "decode",
    "drop_last_segment",
    "first_tokens",
    "hash_fraction",
    "last_segment",
    "negative_log_likelihood",
    "normalized_text",
    "predicted_class",
    "predicted_probability",
    "rewrite_mount_prefix",
    "round_half_even",
    "softmax",
    "stringify",
    "tokens",
]
