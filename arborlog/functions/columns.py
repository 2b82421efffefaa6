"""Codecs as Columns: the encoders natively, the variable-length decoders as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import codec


def _bytes(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def varint_col(n: Column) -> Column:
    """Varint of a BIGINT of 0 or more; anything else is an error."""
    digits = F.hex(n.cast("long"))
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    body = F.concat(F.lpad(F.hex((F.length(even) / 2).cast("long")), 2, "0"), even)
    return F.when(n == 0, _bytes("00")).when(n > 0, F.unhex(body)).when(n.isNotNull(), F.raise_error(F.lit("varint of a negative number")).cast("binary"))


def read_varint_col(b: Column) -> Column:
    """The number at the start of a varint of up to seven value bytes; null if truncated."""
    n = F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int")
    value = F.conv(F.hex(b.substr(F.lit(2), n)), 16, 10).cast("long")
    return F.when(F.length(b) < n + 1, F.lit(None).cast("long")).when(n == 0, F.lit(0).cast("long")).otherwise(value)


def valid_field(name: Column) -> Column:
    return ~name.rlike(r"[\x00-\x1f]")


def raw_field(name: Column) -> Column:
    """A path segment of a name that is known to be valid."""
    return F.concat(_bytes("00"), name.cast("binary"))


def field(name: Column) -> Column:
    """A path segment of a name; a control byte is an error, as it would read as the layout's own."""
    return F.when(name.isNotNull() & ~valid_field(name), F.raise_error(F.lit("a field name has a control byte")).cast("binary")).otherwise(raw_field(name))


def _pid(pid: Column) -> Column:
    pid = pid.cast("long")
    return F.when(pid.isNull() | pid.between(1, codec.MAX_U32), pid).otherwise(F.raise_error(F.lit("a peer id is not in 1..2^32-1")).cast("long"))


def _sequence(seq: Column) -> Column:
    seq = seq.cast("long")
    return F.when(seq.isNull() | seq.between(0, codec.MAX_U32), seq).otherwise(F.raise_error(F.lit("a sequence number is not in 0..2^32-1")).cast("long"))


def index(*segments: tuple[Column, Column]) -> Column:
    """A path segment of a fractional index of (pid, seq) parts."""
    return F.concat(_bytes("00"), *(varint_col(x) for pid, seq in segments for x in (_pid(pid), _sequence(seq))))


def lww() -> Column:
    return _bytes("001E")


def chunked(end: Column) -> Column:
    return F.concat(_bytes("001F"), varint_col(end))


def counter(pid: Column) -> Column:
    return F.concat(_bytes("001D"), F.unhex(F.lpad(F.hex(_pid(pid)), 8, "0")))


def path(*parts: Column, checked: bool = True) -> Column:
    """A key of segments and a terminator; an error if it is too long, unless not checked."""
    key = F.concat(*parts)
    return F.when(F.length(key) > codec.MAX_PATH, F.raise_error(F.lit("a key is too long")).cast("binary")).otherwise(key) if checked else key


def within_limit(key: Column) -> Column:
    return F.length(key) <= codec.MAX_PATH


_SEGMENT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("field", T.StringType()), T.StructField("index", T.BinaryType())])
_TERM = T.StructType([T.StructField("kind", T.StringType()), T.StructField("number", T.DecimalType(20, 0))])
_PATH = T.StructType([T.StructField("segments", T.ArrayType(_SEGMENT)), T.StructField("term", _TERM)])
_INDEX = T.ArrayType(T.StructType([T.StructField("pid", T.LongType()), T.StructField("seq", T.LongType())]))


@pandas_udf(_PATH)
def decode_path_col(keys: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Segments and terminator of a key; both null for a null or broken key."""
    from decimal import Decimal

    for batch in keys:
        segments, terms = [], []
        for key in batch:
            try:
                parts, end = codec.decode_path(bytes(key))
            except (TypeError, codec.PathError):
                segments.append(None)
                terms.append(None)
                continue
            segments.append([{"kind": "field", "field": p, "index": None} if isinstance(p, str) else {"kind": "index", "field": None, "index": p} for p in parts])
            terms.append({"kind": end.kind, "number": Decimal(end.number)})
        yield pd.DataFrame({"segments": segments, "term": terms}, dtype=object)


@pandas_udf(_INDEX)
def index_segments_col(indices: pd.Series) -> pd.Series:
    return indices.map(lambda b: [{"pid": p, "seq": s} for p, s in codec.read_index(bytes(b))[0]] if b is not None and codec.is_index(bytes(b)) else None)


def show_index_col(segments: Column) -> Column:
    return F.concat_ws(":", F.transform(segments, lambda s: F.concat(F.lit("("), F.lower(F.hex(s["pid"])), F.lit("@"), s["seq"].cast("string"), F.lit(")"))))


@pandas_udf(T.BooleanType())
def is_index_col(indices: pd.Series) -> pd.Series:
    return indices.map(lambda b: None if b is None else codec.is_index(bytes(b)))


@pandas_udf(T.BinaryType())
def index_between_col(before: pd.Series, after: pd.Series, pid: pd.Series) -> pd.Series:
    def one(a, b, p):
        a, b = (codec.read_index(bytes(x))[0] if x is not None and len(x) else None for x in (a, b))
        return codec.index_bytes(codec.index_between(a, b, int(p)))

    return pd.Series([one(*x) for x in zip(before, after, pid)], dtype=object)


@pandas_udf(T.BinaryType())
def json_to_cbor(values: pd.Series) -> pd.Series:
    import json

    return values.map(lambda v: None if v is None else codec.cbor(json.loads(v)))


@pandas_udf(T.StringType())
def cbor_to_json(values: pd.Series) -> pd.Series:
    import json

    return values.map(lambda v: None if v is None else json.dumps(codec.read_cbor(bytes(v)), ensure_ascii=False))
