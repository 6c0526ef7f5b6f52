"""Compression of binary columns: zlib, LZ4 blocks and ZIP archives of one file."""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = (1980, 1, 1, 0, 0, 0)  # the time ZIP entries get, so equal contents give equal archives


def _each(values: pa.Array, f) -> pa.Array:
    return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.binary())


def _or_null(f, *errors):
    def g(data: bytes) -> bytes | None:
        try:
            return f(data)
        except errors:
            return None

    return g


def deflate(c: Column, level: int = 6) -> Column:
    """zlib stream of the bytes."""
    return F.arrow_udf(lambda v: _each(v, lambda x: zlib.compress(x, level)), T.BinaryType())(c)


def inflate(c: Column) -> Column:
    """The bytes of a zlib stream; null if it is broken."""
    return F.arrow_udf(lambda v: _each(v, _or_null(zlib.decompress, zlib.error)), T.BinaryType())(c)


def _lz4(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="lz4_raw", asbytes=True)


def _unlz4(data: bytes) -> bytes:
    size = int.from_bytes(data[:4], "little")
    return pa.decompress(data[4:], decompressed_size=size, codec="lz4_raw", asbytes=True) if size else b""


def lz4(c: Column) -> Column:
    """The size, four bytes with the lowest first, and an LZ4 block."""
    return F.arrow_udf(lambda v: _each(v, _lz4), T.BinaryType())(c)


def unlz4(c: Column) -> Column:
    """The bytes of what ``lz4`` gave; null if it is broken."""
    return F.arrow_udf(lambda v: _each(v, _or_null(_unlz4, pa.ArrowException, OSError, ValueError)), T.BinaryType())(c)


def _zip(name: str):
    def pack(data: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name, _EPOCH), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    return pack


def _unzip(data: bytes) -> bytes | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(z.namelist()[0]) if z.namelist() else None


def zip_one(c: Column, name: str) -> Column:
    """A ZIP archive with the bytes as its only file."""
    return F.arrow_udf(lambda v: _each(v, _zip(name)), T.BinaryType())(c)


def unzip_first(c: Column) -> Column:
    """The first file of a ZIP archive; null if there is none or the archive is broken."""
    return F.arrow_udf(lambda v: _each(v, _or_null(_unzip, zipfile.BadZipFile, zlib.error)), T.BinaryType())(c)


STRIPS = 64  # strips of a tile


def _pack_tile(pixels: bytes) -> bytes:
    size = -(-len(pixels) // STRIPS)
    strips = [pa.compress(pixels[i * size : (i + 1) * size], codec="lz4_raw", asbytes=True) if pixels[i * size : (i + 1) * size] else b"" for i in range(STRIPS)]
    return len(pixels).to_bytes(4, "little") + b"".join(len(s).to_bytes(4, "little") for s in strips) + b"".join(strips)


def _unpack_tile(data: bytes) -> bytes:
    whole = int.from_bytes(data[:4], "little")
    size, at, out = -(-whole // STRIPS), 4 + 4 * STRIPS, b""
    for i in range(STRIPS):
        n = int.from_bytes(data[4 + 4 * i : 8 + 4 * i], "little")
        here = max(0, min(size, whole - i * size))
        out += pa.decompress(data[at : at + n], decompressed_size=here, codec="lz4_raw", asbytes=True) if here else b""
        at += n
    return out


def pack_tile(c: Column) -> Column:
    """A tile's pixels as strips of LZ4 behind a header with the whole size and the size of each strip."""
    return F.arrow_udf(lambda v: _each(v, _pack_tile), T.BinaryType())(c)


def unpack_tile(c: Column) -> Column:
    """The pixels of a packed tile; null if it is broken."""
    return F.arrow_udf(lambda v: _each(v, _or_null(_unpack_tile, pa.ArrowException, OSError, ValueError)), T.BinaryType())(c)
