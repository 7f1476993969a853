"""Column functions; all but the base58 ones are built-in expressions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructField, StructType

from tallyflow.functions import base58

#: Status codes 0 to 6; fixed values of the stream format.
STATUS_NAMES = ("processed", "confirmed", "finalized", "first_shred_received", "completed", "created_bank", "dead")


def status_name(code: Column) -> Column:
    """Name of a slot status code, ``unknown`` if there is none."""
    out = F.lit("unknown")
    for number, name in reversed(list(enumerate(STATUS_NAMES))):
        out = F.when(code == number, F.lit(name)).otherwise(out)
    return out


def stress_level(skip_rate: Column) -> Column:
    return F.when(skip_rate < 0.02, "normal").when(skip_rate < 0.05, "elevated").when(skip_rate < 0.10, "high").otherwise("critical")


def event_slot() -> Column:
    """Slot of any event, 0 for kinds without one."""
    return F.coalesce(F.col("slot"), F.lit(0).cast("long"))


def time_bucket(ts: Column, unit: str) -> Column:
    """Start of a row's time unit, which is a calendar unit or a number of hours that divides the day (``2 hours``)."""
    number, _, name = unit.rpartition(" ")
    if not number:
        return F.date_trunc(name, ts)
    hour = F.date_trunc("hour", ts)
    return hour - F.make_dt_interval(F.lit(0), F.hour(hour) % int(number))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss+00:00")


def per_second(count: Column, elapsed: Column) -> Column:
    """Events a second; 0 for spans too short to tell."""
    return F.when(elapsed < 0.1, F.lit(0.0)).otherwise(count.cast("double") / elapsed)


def lag_millis(as_of: Column, then: Column) -> Column:
    """Milliseconds from ``then`` to ``as_of``, at least 0; null if ``then`` is."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.when(then.isNotNull(), F.greatest(F.lit(0).cast("long"), F.floor(micros / 1000).cast("long")))


def trimmed_list(text: Column, separator: str = ",") -> Column:
    """Parts of a separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def slug(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def watched_programs(instruction_index: Column, account_keys: Column) -> Column:
    """Keys that instructions point at: out-of-range ones skipped, first-seen order, once each."""
    return F.array_distinct(F.filter(F.transform(instruction_index, lambda i: F.get(account_keys, i)), lambda x: x.isNotNull()))


def key_text(raw: bytes) -> str:
    """The base58 text of a key."""
    return base58.encode_one(raw)


def key_bytes(text: str) -> bytes:
    """Bytes of a key's text: what its base58 stands for, or the text itself where it is not base58."""
    trimmed = text.strip()
    raw = base58.decode_one(trimmed) if trimmed else None
    return text.encode() if raw is None else raw


def key_bytes_of(text: Column) -> Column:
    """``key_bytes`` of a column."""
    return F.arrow_udf(_key_bytes_all, BinaryType())(text)


def as_key(value: Column, kind: DataType) -> Column:
    """A key column as bytes: binary keys as they are, keys of other types by their text."""
    return value if isinstance(kind, BinaryType) else value.cast("string").cast("binary")


def base58_encode(raw: Column) -> Column:
    return F.arrow_udf(_encode_all, StringType())(raw)


def base58_encode_each(raws: Column) -> Column:
    """An array of bytes as an array of base58 texts."""
    return F.arrow_udf(_encode_arrays, ArrayType(StringType()))(raws)


def base58_decode(text: Column | str) -> Column:
    """Null for text that is not base58."""
    return F.arrow_udf(_decode_all, BinaryType())(text)


def is_base58(text: Column) -> Column:
    """Whether ``base58_decode`` gives bytes, as a built-in expression."""
    return text.rlike(f"^[{base58.BASE58}]*\\z")


def base58_decode_each(texts: Column) -> Column:
    """An array of base58 texts as an array of bytes; null where a text is not base58."""
    return F.arrow_udf(_decode_arrays, ArrayType(BinaryType()))(texts)


def checked_key(text: Column | str) -> Column:
    """Struct of the 32-byte key of a base58 text, or the reason why there is none."""
    return F.arrow_udf(_check_all, StructType([StructField("bytes", BinaryType()), StructField("reason", StringType())]))(text)


def _encode_all(raw: pa.Array) -> pa.Array:
    return base58.encode(raw)


def _decode_all(text: pa.Array) -> pa.Array:
    return base58.decode(text)


def _encode_arrays(raws: pa.Array) -> pa.Array:
    return base58.each(base58.encode, raws)


def _decode_arrays(texts: pa.Array) -> pa.Array:
    return base58.each(base58.decode, texts)


def _key_bytes_all(text: pa.Array) -> pa.Array:
    trimmed = pc.utf8_trim_whitespace(text)
    raw = base58.decode(pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, trimmed.type), trimmed))
    return pc.coalesce(raw, text.cast(pa.binary()))


def _check_all(text: pa.Array) -> pa.Array:
    trimmed = pc.utf8_trim_whitespace(pc.coalesce(text, pa.scalar("", text.type)))
    raw = base58.decode(trimmed)
    length = pc.binary_length(raw)
    wrong = pc.binary_join_element_wise(length.cast(pa.string()), " bytes, not 32", "")
    none = pa.scalar(None, pa.string())
    reason = pc.case_when(
        pc.make_struct(pc.equal(trimmed, ""), pc.is_null(raw), pc.not_equal(length, 32)), pa.scalar("empty"), pa.scalar("not base58"), wrong, none,
    )
    return pa.StructArray.from_arrays([pc.if_else(pc.is_null(reason), raw, pa.scalar(None, pa.binary())), reason], names=["bytes", "reason"])
