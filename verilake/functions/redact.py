"""Redaction of nested documents (JSON text), in Arrow batches; flat maps stay built-in."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of fields that hold biometric data, and parts of such names.
EXACT = frozenset(
    "image crop photo base64 vector face biometric embedding embeddings query_embedding ref_embedding embedding_vector embedding_norm face_input face_crop face_image aligned_crop raw_image image_bytes image_bgr image_rgb image_base64 image_b64 base64_image input_image".split()
)
PARTS = "embed face_input face_crop face_image image_bytes image_bgr image_rgb raw_image image_base64 image_b64 base64_image aligned_crop".split()
#: Fields that a stored result never shows.
SENSITIVE = frozenset("completed_at error metrics image image_b64 image_bytes raw_image face_input embedding query_embedding vector payload full_payload bytes service_timings timings timestamps job_timings".split())
#: Patterns of encoded blobs and of printed arrays.
_BLOB = re.compile(r"[A-Za-z0-9+/=]{256,}")
_ARRAY = re.compile(r"\[[0-9eE.,\-+\s]{200,}\]")


def is_biometric_key(key: str) -> bool:
    low = key.lower()
    return low in EXACT or any(p in low for p in PARTS)


def biometric_key(column: Column) -> Column:
    """The same test as an expression."""
    low = F.lower(column)
    found = low.isin(*sorted(EXACT))
    for part in PARTS:
        found = found | low.contains(part)
    return found


def redact_map(column: Column) -> Column:
    """A map<string,string> with the values of biometric fields replaced and long blobs tagged."""
    from verilake.functions.exprs import redact_text

    return F.transform_values(column, lambda k, v: F.when(biometric_key(k), F.lit("[REDACTED]")).otherwise(redact_text(v)))


def mask_text(text: str) -> str:
    return _ARRAY.sub("[REDACTED:array]", _BLOB.sub("[REDACTED:b64]", text))


def _masked(value):
    """What stands for a value under a biometric name: a mark for each leaf, names and shape stay."""
    pending, top = [], [value]
    pending.append((top, 0))
    while pending:
        holder, key = pending.pop()
        inner = holder[key]
        if isinstance(inner, dict | list):
            pending += [(inner, k) for k in (inner if isinstance(inner, dict) else range(len(inner)))]
        else:
            holder[key] = "[REDACTED]"
    return top[0]


def _redact_members(members: list[tuple[str, object]]) -> dict:
    """Called by the parser for every object, the innermost first."""
    return {name: _masked(value) if is_biometric_key(name) else value for name, value in members}


def _mask_strings(document):
    """Blobs and printed arrays in the remaining strings, by a stack of containers."""
    top = [document]
    pending: list = [top]
    while pending:
        holder = pending.pop()
        for key in holder if isinstance(holder, dict) else range(len(holder)):
            if isinstance(holder[key], str):
                holder[key] = mask_text(holder[key])
            elif isinstance(holder[key], dict | list):
                pending.append(holder[key])
    return top[0]


def _public_members(members: list[tuple[str, object]]) -> dict:
    return {name: value for name, value in members if name not in SENSITIVE}


def _over_json(hook, after=None):
    """JSON texts parsed with a hook for objects and written again, keys in order; null if it isn't JSON."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                try:
                    document = None if text is None else json.loads(text, object_pairs_hook=hook)
                    out.append(None if text is None else json.dumps(after(document) if after else document, ensure_ascii=False, sort_keys=True))
                except (ValueError, RecursionError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return batches


def redact_bytes(column) -> Column:
    """A binary column as the mark with its length that logs show instead."""
    return F.when(F.col(column).isNotNull(), F.concat(F.lit("[REDACTED:bytes:"), F.octet_length(column).cast("string"), F.lit("]")))


def redact_fields(column) -> Column:
    """JSON text redacted at every depth, keys in order; null if it isn't JSON."""
    return F.pandas_udf(_over_json(_redact_members, _mask_strings), "string")(column)


def sanitize_result(column) -> Column:
    """JSON text without sensitive fields at every depth, keys in order; null if it isn't JSON."""
    return F.pandas_udf(_over_json(_public_members), "string")(column)
