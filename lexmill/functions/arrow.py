"""Texts as Arrow arrays, taken apart inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cuts(texts: pa.StringArray, most_bytes: int, most_rows: int | None = None) -> list[tuple[int, int]]:
    """Starts and ends of runs of ``most_bytes`` (or one text) and ``most_rows`` at most."""
    chunk = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // most_bytes
    rows = np.arange(0, len(texts), most_rows or len(texts) or 1)
    ends = np.unique(np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, rows, len(texts)]).tolist()
    return list(zip(ends[:-1], ends[1:]))


def coded_tokens(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens of lower-cased texts, each distinct one held once, and the row of every token.

    Of separators in a row, and at either end, come empty tokens.
    """
    words = pc.split_pattern(_spaced(texts), " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    return words.flatten().dictionary_encode(), row


def _spaced(texts: pa.StringArray) -> pa.StringArray:
    """The texts with blanks for tabs and line ends; in UTF-8 these bytes stand for nothing else."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]].copy() if held else np.empty(0, np.uint8)
    data[(data == 9) | (data == 10) | (data == 13)] = 32
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))
