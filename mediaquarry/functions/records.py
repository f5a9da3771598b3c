"""Record-level rules and codecs: cross-field checks, canonical JSON, vectors as bytes, lenient parsing."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def face_rules() -> dict[str, Column]:
    """Cross-field rules of a face record; each is true where the rule holds."""
    e = F.col("eligible")
    automatic = F.col("assignment") == "auto_high_confidence"
    return {
        "eligible_needs_person": ~e | F.col("person_id").isNotNull(),
        "automatic_needs_confidence": ~(e & automatic) | F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False)),
        "open_assignment_is_not_eligible": ~e | F.col("assignment").isin("user_confirmed", "auto_high_confidence"),
    }


def media_rules() -> dict[str, Column]:
    return {
        "quarantined_is_excluded": (F.col("kind") != "audio") | F.col("excluded"),
        "unknown_precision_has_no_time": (F.col("time_precision") != "unknown") | F.col("captured").isNull(),
        "primary_has_group": ~F.col("is_primary") | F.col("group_id").isNotNull(),
    }


def moment_rules() -> dict[str, Column]:
    """Snap points sorted and within the range, words not empty."""
    return {
        "snaps_sorted": F.array_sort("snaps") == F.col("snaps"),
        "snaps_inside": F.forall("snaps", lambda s: (s >= F.col("lo")) & (s < F.col("hi"))),
        "trim_ordered": F.col("lo") < F.col("hi"),
    }


def job_rules() -> dict[str, Column]:
    return {
        "egress_needs_consent": ~F.col("egress") | F.col("consent").isNotNull(),
        "local_has_no_consent": F.col("egress") | F.col("consent").isNull(),
        "journal_is_local": F.col("egress") | ~F.exists("journal", lambda x: x == "network"),
    }


def strict_rfc3339(text: Column) -> Column:
    """Microseconds of a timestamp with an explicit offset; anything else is null."""
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$")
    return F.when(whole, F.unix_micros(F.try_to_timestamp(text)))


def display_text(text: Column, limit: int) -> Column:
    """Without control and direction marks, cut to a length with an ellipsis."""
    plain = F.regexp_replace(text, r"[\p{Cc}‎‏‪-‮⁦-⁩]", "")
    return F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, limit - 1), F.lit("…"))).otherwise(plain)


def leaks(values: Column) -> Column:
    """Does any value of a map look like a path or a private key."""
    return F.exists(F.map_values(values), lambda v: v.rlike(r"(?i)^(/|[a-z]:\\|file:)|-----BEGIN [A-Z ]*PRIVATE KEY-----"))


def price(tokens: Column, rate: Column) -> Column:
    return F.round(tokens * rate / 1e6, 6)


@F.pandas_udf(T.BinaryType())
def pack_vector(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_vector(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4").tolist())


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def number_text(x: float | int) -> str:
    """A number as ECMAScript writes it: shortest digits, exponent from 1e21 and below 1e-6."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    mantissa, _, exp = f"{x!r}".partition("e")
    whole, _, frac = mantissa.partition(".")
    frac = "" if frac == "0" else frac
    digits = (whole + frac).lstrip("0")
    point = int(exp or 0) + len(whole) if whole != "0" else int(exp or 0) - (len(frac) - len(frac.lstrip("0")))
    digits = digits.rstrip("0")
    if 0 < point <= 21:
        text = digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        text = f"0.{'0' * -point}{digits}"
    else:
        rest = f".{digits[1:]}" if len(digits) > 1 else ""
        text = f"{digits[0]}{rest}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + text


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and numbers in their one shortest form."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return number_text(value)


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null for texts that are not JSON."""

    def one(x):
        try:
            return None if x is None else canonical(json.loads(x))
        except ValueError:
            return None

    return s.map(one)


def lenient(text: str | None) -> tuple[str, str | None]:
    """(status, JSON text) of the one JSON object in a reply: fences and prose around it are passed over, one trailing comma is mended."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise KeyError("duplicate key")
        return dict(pairs)

    start = (text or "").find("{")
    if start < 0:
        return "no_object", None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            continue
        quoted = c == '"'
        depth += (c == "{") - (c == "}")
        if not depth:
            span = text[start : i + 1]
            for status, body in (("ok", span), ("repaired", re.sub(r",(\s*[}\]])", r"\1", span, count=1))):
                try:
                    return status, json.dumps(json.loads(body, object_pairs_hook=unique))
                except KeyError:
                    return "duplicate_key", None
                except ValueError:
                    continue
            return "malformed", None
    return "unbalanced", None


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("payload", T.StringType())]))
def lenient_json(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lenient(x) for x in s], columns=["status", "payload"])
