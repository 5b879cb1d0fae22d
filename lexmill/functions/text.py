"""Column expressions over text, keys and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Token separators, the word a null turns into under stringify, and
# the path scheme that is mounted as a folder.
TOKEN_SEPARATORS = "[ \t\n\r]+"
NULL_LITERAL = "None"
MOUNT_SCHEME = "dbfs"
MOUNT_FOLDER = "/dbfs"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens between blanks, tabs and line ends; null text gives null."""
    return F.array_remove(F.split(F.lower(_col(text)), TOKEN_SEPARATORS), "")


def first_tokens(text: Column | str, n: int) -> Column:
    """The first ``n`` tokens of a text, joined by single blanks."""
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def normalized_text(text: Column | str) -> Column:
    """The tokens of a text, joined by single blanks."""
    return F.array_join(tokens(text), " ")


def stringify(value: Column | str) -> Column:
    """Force to string before encoding; a null becomes the literal ``None``."""
    return F.coalesce(_col(value).cast("string"), F.lit(NULL_LITERAL))


def class_index(value: Column | str, classes: Sequence[str]) -> Column:
    """0-based label of a category in a known class list; null where it is not listed."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), _col(value))
    return F.when(position > 0, position - 1).cast("int")


def hash_fraction(key: Column | str, salt: str = "") -> Column:
    """A value in [0, 1) from the md5 of the key: equal keys always get equal values."""
    seeded = F.concat(F.lit(salt), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(seeded), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def rewrite_mount_prefix(path: Column | str) -> Column:
    """A path under the mounted scheme as a path in its folder; decided per path, others stay."""
    return F.regexp_replace(_col(path), f"^{MOUNT_SCHEME}:/*", f"{MOUNT_FOLDER}/")


def drop_last_segment(path: Column | str) -> Column:
    """Everything before the last ``/``; empty when there is none."""
    return F.when(F.instr(_col(path), "/") == 0, F.lit("")).otherwise(
        F.regexp_replace(_col(path), "/[^/]*$", "")
    )


def last_segment(path: Column | str) -> Column:
    """Everything after the last ``/``."""
    return F.substring_index(_col(path), "/", -1)
