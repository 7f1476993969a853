"""Base58 over whole Arrow batches: all keys of a batch are divided, or multiplied up, at once.

A number is an array of 32-bit limbs for each key, and five digits are one step, as
58 ** 5 times a limb fits into 64 bits. Keys are taken in classes of like length; a key
of more than ``LONG`` bytes or digits (none of the stream's is) is converted alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Digits of base58; a fixed value of the format.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

GROUP = 5
STEP = np.uint64(58**GROUP)
LONG = 128
_LIMB = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_DIGIT = {c: i for i, c in enumerate(BASE58)}
_CHARS = np.frombuffer(BASE58.encode(), np.uint8)
_VALUES = np.full(256, 255, np.uint8)
_VALUES[_CHARS] = np.arange(58)


def encode_one(raw: bytes) -> str:
    number, out = int.from_bytes(raw, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        out = BASE58[digit] + out
    return BASE58[0] * (len(raw) - len(raw.lstrip(b"\0"))) + out


def decode_one(text: str) -> bytes | None:
    number = 0
    for c in text:
        if c not in _DIGIT:
            return None
        number = number * 58 + _DIGIT[c]
    zeros = len(text) - len(text.lstrip(BASE58[0]))
    return bytes(zeros) + number.to_bytes((number.bit_length() + 7) // 8, "big")


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values as rows of bytes with zeros on the left, and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), np.uint8)
    out[np.arange(width) >= width - lengths[:, None]] = data[offsets[0] : offsets[-1]]
    return out, lengths


def _unpadded(rows: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The last ``lengths`` bytes of each row."""
    width = rows.shape[1]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    data = np.ascontiguousarray(rows[np.arange(width) >= width - lengths[:, None]])
    return pa.Array.from_buffers(kind, len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _first_set(rows: np.ndarray) -> np.ndarray:
    """Zeros at the left of each row."""
    return np.where(rows.any(axis=1), (rows != 0).argmax(axis=1), rows.shape[1])


def _encode_class(column: pa.Array, width: int) -> pa.Array:
    raw, lengths = _padded(column, width)
    zeros = _first_set(raw) - (width - lengths)
    limbs = raw.reshape(len(raw), -1, 4).view(">u4")[:, :, 0].astype(np.uint64)
    steps = -(-width * 1366 // (1000 * GROUP)) + 1  # a byte takes 1.366 digits
    digits = np.zeros((len(raw), steps * GROUP), np.uint8)
    for step in range(steps):
        rest = np.zeros(len(raw), np.uint64)
        for k in range(limbs.shape[1]):
            rest = rest << _LIMB | limbs[:, k]
            limbs[:, k], rest = rest // STEP, rest % STEP
        for k in range(GROUP):
            digits[:, -1 - step * GROUP - k] = rest % np.uint64(58)
            rest //= np.uint64(58)
    return _unpadded(_CHARS[digits], digits.shape[1] - _first_set(digits) + zeros, pa.string())


def _decode_class(column: pa.Array, width: int) -> pa.Array:
    text, lengths = _padded(column, width)
    used = np.arange(width) >= width - lengths[:, None]
    digits = np.where(used, _VALUES[text], 0)
    good = (digits != 255).all(axis=1)
    digits[~good] = 0
    ones = _first_set(digits) - (width - lengths)
    limbs = np.zeros((len(text), width * 733 // 4000 + 2), np.uint64)  # a digit takes 0.733 bytes
    for step in range(0, width, GROUP):
        carry = np.zeros(len(text), np.uint64)
        for k in range(GROUP):
            carry = carry * np.uint64(58) + digits[:, step + k]
        for k in range(limbs.shape[1] - 1, -1, -1):
            whole = limbs[:, k] * STEP + carry
            limbs[:, k], carry = whole & _LOW, whole >> _LIMB
    raw = limbs.astype(">u4").view(np.uint8).reshape(len(text), -1)
    lengths = raw.shape[1] - _first_set(raw) + ones
    room = int(max(0, lengths.max(initial=0) - raw.shape[1]))
    found = _unpadded(np.pad(raw, ((0, 0), (room, 0))), lengths, pa.binary())
    return pc.if_else(pa.array(good), found, pa.scalar(None, pa.binary()))


def _by_class(column: pa.Array, of_class: Callable[[pa.Array, int], pa.Array], unit: int, one: Callable, kind: pa.DataType) -> pa.Array:
    """Convert values of like length together; nulls stay null."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    lengths = np.where(np.isnan(lengths), -1, lengths).astype(np.int64) if column.null_count else lengths.astype(np.int64)
    width = -(-np.maximum(lengths, 1) // unit) * unit
    width[lengths < 0] = -1
    width[lengths > LONG] = 0
    parts, places = [], []
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        own = column.take(pa.array(at)) if len(at) < len(column) else column
        places.append(at)
        if w > 0:
            parts.append(of_class(own, w))
        else:
            parts.append(pa.nulls(len(at), kind) if w < 0 else pa.array([one(x) for x in own.to_pylist()], kind))
    if len(parts) == 1:
        return parts[0]
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places)))) if parts else pa.nulls(0, kind)


def encode(raw: pa.Array) -> pa.Array:
    """Bytes to base58 text."""
    return _by_class(raw.cast(pa.binary()), _encode_class, 4, encode_one, pa.string())


def decode(text: pa.Array) -> pa.Array:
    """Base58 text to bytes; null where a text is not base58."""
    return _by_class(text.cast(pa.string()), _decode_class, GROUP, decode_one, pa.binary())


def each(convert: Callable[[pa.Array], pa.Array], lists: pa.Array) -> pa.Array:
    """Convert the items of lists, all at once; an item that comes often is converted once, as programs are few."""
    items = lists.flatten().dictionary_encode()
    flat = convert(items.dictionary).take(items.indices)
    sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, flat, mask=pc.is_null(lists)) if len(lists) else pa.nulls(0, pa.list_(flat.type))
