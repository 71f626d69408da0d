"""Column expressions: vectors, boxes, numbers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, LOW = 0.45, 0.30


def as_doubles(vector) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sum of products in double; null if the lengths differ."""
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(vector) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine of two vectors as they are; null if the lengths differ or a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(vector, zero="skip", dim: int | None = None) -> Column:
    """vector / its norm. A zero norm or wrong length gives null (skip), the vector itself (keep), or an error (raise)."""
    size = norm(vector)
    bad = (size == 0) | (F.size(vector) != dim if dim else F.lit(False))
    unit = F.transform(as_doubles(vector), lambda x: F.try_divide(x, size))
    otherwise = {"skip": F.lit(None), "keep": as_doubles(vector), "raise": F.raise_error(F.lit("vector of zero norm or wrong length"))}[zero]
    return F.when(bad, otherwise.cast("array<double>")).otherwise(unit)


def area(x1, y1, x2, y2) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def iou(a, b, clamp=True) -> Column:
    """Overlap of two boxes, structs of x1, y1, x2, y2; 0 if they have no area together."""
    inner = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    own = (lambda c: area(c.x1, c.y1, c.x2, c.y2)) if clamp else (lambda c: (c.x2 - c.x1) * (c.y2 - c.y1))
    union = own(a) + own(b) - inner
    return F.when(union > 0, F.try_divide(inner, union)).otherwise(0.0)


def softmax_real(logits) -> Column:
    """Probabilities of the second (real) and third (spoof) of three logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.struct((F.exp(logits[1] - top) / total).alias("real"), (F.exp(logits[2] - top) / total).alias("spoof"))


def parse_float(text) -> Column:
    """A number from text, null if it isn't one; the words true and false aren't numbers."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("double")


def uniform_frame_indices(n, total) -> Column:
    """min(n, total) frames spread evenly over 0 .. total - 1, ends included, halves to even."""
    k = F.least(n, total)
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (total - 1) / (k - 1)).cast("int"))
    return F.when((total <= 0) | (n <= 0), F.array().cast("array<int>")).when(k == 1, F.array(F.lit(0))).otherwise(spread)


def redact_text(text) -> Column:
    """Long base64 runs, then long numeric arrays, replaced by tags."""
    no_blobs = F.regexp_replace(text, r"[A-Za-z0-9+/=]{256,}", "[REDACTED:b64]")
    return F.regexp_replace(no_blobs, r"\[[0-9eE.,\-+\s]{200,}\]", "[REDACTED:array]")


def client_ip(real_ip, forwarded, host, fallback=None) -> Column:
    """X-Real-IP, else the first of X-Forwarded-For, else the host, else fallback."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(real_ip), blank(F.split(forwarded, ",")[0]), blank(host), F.lit(fallback))


def scale_boxes(values, sx, sy) -> Column:
    """x, y, x, y, ... from a resized image back to the original."""
    return F.transform(values, lambda v, i: v * F.when(i % 2 == 0, sx).otherwise(sy))


def expand_bbox(box, scale, width, height) -> Column:
    """A box of the same centre with its sides times scale, inside the image."""
    cx, cy, hw, hh = (box.x1 + box.x2) / 2, (box.y1 + box.y2) / 2, (box.x2 - box.x1) * scale / 2, (box.y2 - box.y1) * scale / 2
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    return F.struct(clamp(cx - hw, width).alias("x1"), clamp(cy - hh, height).alias("y1"), clamp(cx + hw, width).alias("x2"), clamp(cy + hh, height).alias("y2"))


def format_number(value, places=3) -> Column:
    """Fixed decimals; blank for null, NaN and infinity."""
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(fine, F.format_string(f"%.{places}f", value)).otherwise("")
