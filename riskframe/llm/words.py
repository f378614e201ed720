"""Words of whole texts: runs of digits, letters a-z and all characters beyond ASCII,
with only A-Z lower-cased."""

from __future__ import annotations

import pyarrow as pa

#: byte by byte: A-Z to a-z; digits, a-z and the bytes of longer characters stay; the rest is space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(utf8: bytes) -> list[bytes]:
    return utf8.translate(_FOLD).split()


def utf8_of(texts: pa.Array, i: int) -> bytes:
    """The bytes of one text of an Arrow column, without a Python string; null: empty."""
    one = texts[i]
    return one.as_buffer().to_pybytes() if one.is_valid else b""
