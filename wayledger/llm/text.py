"""Text keys as Arrow UDFs: one call per batch, each distinct value handled once."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import functions as F


def plain_term(text: str | None) -> str | None:
    """NFC, lower case, white-space runs as one space and none at the ends; None if blank."""
    return text and (" ".join(unicodedata.normalize("NFC", text).lower().split()) or None) or None


def photo_path(path: str | None) -> str | None:
    """The file a path leads to from the store's root; None if it names none.

    Cut at the first '?', percent escapes decoded, any slash, lower case, empty and '.' segments
    dropped, '..' going up (not above the root). Broken escapes stay as they are.
    """
    if path is None:
        return None
    path = path.split("?", 1)[0]
    if "%" in path:
        path = unquote_to_bytes(path).decode("utf-8", "replace")
    kept: list[str] = []
    for part in re.split(r"[/\\]", path.lower()):
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    path = "/".join(kept)
    return path if path.strip() else None


def _per_value(values: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    coded = values.dictionary_encode()
    return pa.array([f(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def term_column(column):
    """``plain_term`` of a string column."""

    @F.arrow_udf("string")
    def plain(values: pa.Array) -> pa.Array:
        return _per_value(values, plain_term)

    return plain(column)


def photo_column(column):
    """``photo_path`` of a string column."""

    @F.arrow_udf("string")
    def photo(values: pa.Array) -> pa.Array:
        return _per_value(values, photo_path)

    return photo(column)
