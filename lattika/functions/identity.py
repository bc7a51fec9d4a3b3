"""Content hashes and identifiers."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the base-32 digits of sortable identifiers.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ecmascript_number(x: int | float) -> str:
    """A number as ECMAScript writes it: the fewest digits that read back as the same double, plain up to 21 digits before the point and six zeros after it, else with an exponent."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    mantissa, _, exponent = np.format_float_scientific(abs(x), unique=True, trim="-").partition("e")
    digits, point = mantissa.replace(".", ""), int(exponent) + 1  # the value is 0.digits * 10 ** point
    sign = "-" if x < 0 else ""
    if len(digits) <= point <= 21:
        return sign + digits.ljust(point, "0")
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{digits.rjust(len(digits) - point, '0')}"
    fraction = f".{digits[1:]}" if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{fraction}e{point - 1:+d}"


def _written(v) -> str:
    """A value of JSON with sorted keys and without spaces."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_written, v)) + "]"
    return ecmascript_number(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else json.dumps(v, ensure_ascii=False)


def _canonical(text: str | None, without: str | None = None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text)
        if without and isinstance(value, dict):
            value.pop(without, None)
        return _written(value)
    except (ValueError, RecursionError):  # no JSON, a number that is not finite, or nested too deep
        return None


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no spaces and numbers as ECMAScript writes them; null where the text is no JSON, NaN and Infinity included."""
    return s.map(_canonical)


@F.pandas_udf(StringType())
def _hashed_body(s: pd.Series) -> pd.Series:
    return s.map(lambda v: _canonical(v, "contentHash"))


def content_hash(json_text: Column) -> Column:
    return F.sha2(canonical_json(json_text), 256)


def record_hash(json_text: Column) -> Column:
    """`sha256:` and the hash of a record, its own contentHash left out; null where the text is no JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(_hashed_body(json_text), 256))


def time_id(ms: Column, seed: Column) -> Column:
    """A sortable identifier: ten base-32 digits of a time in milliseconds, 16 of the SHA-256 of a seed, so that a task that runs again makes the same."""
    time = F.translate(F.lpad(F.upper(F.conv(ms.cast("string"), 10, 32)), 10, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", DIGITS)
    return F.concat(time, F.substring(short_id(seed), 1, 16))


def id_time(identifier: Column) -> Column:
    """Milliseconds of a sortable identifier; null for other texts."""
    digits = F.translate(F.substring(identifier, 1, 10), DIGITS, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    return F.when(identifier.rlike(f"^[0-7][{DIGITS}]{{25}}$"), F.conv(digits, 32, 10).cast("long"))


def short_id(value: Column) -> Column:
    """26 base-32 digits from the first 130 bits of a SHA-256: stable for equal values."""
    hexed = F.concat(F.sha2(value, 256), F.lit("000"))
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(7)]
    return F.substring(F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", DIGITS), 1, 26)
