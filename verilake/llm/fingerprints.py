"""Document fingerprints by locally consistent parsing.

A text is a row of names, at first its code points. On each level equal neighbours become one
name, deterministic coin tossing colours the names so that neighbours differ (each round takes
the lowest bit in which a name differs from that before it, until three colours are left),
and local maxima of the colour, and minima that aren't next to one, begin phrases of two or three
names. A phrase's name is a hash of the names in it. Where a phrase begins depends on a few
names around it only, so equal substrings have equal phrases inside, wherever they stand.

The names from level LEVEL on (some 14 code points and more) are a text's signatures. Its fingerprint holds, for
each of SLOTS hash functions, a byte of their minimum. Likeness is the share of signatures that two
texts have in common, twice the common ones by those of both, as estimated from equal slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, cut, releasing, table

#: First level whose names are signatures, hash functions of a fingerprint, code points parsed at once.
LEVEL, SLOTS, AT_ONCE = 3, 128, 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
NONE = 7
#: The smallest of three colours that neither neighbour has; NONE stands for no neighbour.
_FREE = np.array([[min({0, 1, 2} - {a, b}) for b in range(NONE + 1)] for a in range(NONE + 1)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SALTS = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64) * _GOLD)
_FACTORS = mixed(_SALTS) | _ONE


def _tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which each name differs from that before it, plus the name's own bit there; a text's first name meets its complement."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = ~names[first]
    differ = names ^ before
    at = np.bitwise_count((differ & (~differ + names.dtype.type(1))) - names.dtype.type(1))
    bit = (names >> np.minimum(at, 8 * names.itemsize - 1).astype(names.dtype)) & names.dtype.type(1)
    return (at << 1 | bit.astype(np.uint8)).astype(np.uint8)


def colours(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three colours, different for neighbours in a text, as neighbours' names are; first holds where texts begin."""
    found = names
    for _ in range(4):  # 64 bits: at most 130 colours, then 16, 8, 6
        found = _tossed(found, first)
    for colour in (5, 4, 3):
        at = np.flatnonzero(found == colour)
        left, right = _neighbours(found, first)
        found[at] = _FREE[left[at], right[at]]
    return found


def _neighbours(found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.full_like(found, NONE), np.full_like(found, NONE)
    left[1:], right[:-1] = found[:-1], found[1:]
    left[first] = NONE
    right[first[1:] - 1] = NONE
    return left, right


def phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level, and where texts begin among them."""
    begins = np.zeros(len(names), bool)
    begins[first] = True
    heads = np.flatnonzero(begins | np.concatenate([[True], names[1:] != names[:-1]]))
    lengths = np.diff(np.append(heads, len(names)))
    names = names[heads]
    several = lengths > 1
    names[several] = mixed(names[several] + lengths[several].astype(np.uint64) * _GOLD)
    first = np.flatnonzero(begins[heads])
    colour = colours(names, first)
    left, right = _neighbours(colour, first)
    top = (colour > left) | (left == NONE)
    top &= (colour > right) | (right == NONE)
    near = np.zeros(len(names), bool)
    near[:-1] = top[1:]
    near[first[1:] - 1] = False  # the next text's first name is no neighbour
    near[1:] |= top[:-1]  # a text's first name begins a phrase anyway
    low = (colour < left) & (colour < right) & ~near  # NONE is above all colours
    starts = top | low
    starts[first] = True
    begins = np.zeros(len(names), bool)
    begins[first] = True
    at = np.flatnonzero(starts)
    inside = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    made = mixed(np.add.reduceat(mixed(names + (inside.astype(np.uint64) + _ONE) * _GOLD), at))
    return made, np.flatnonzero(begins[at])


def signatures(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: names, where texts begin among them, and which texts these are; of texts with one name before LEVEL, that name."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    own = np.flatnonzero(sizes)
    if not len(own):
        return
    names = mixed(np.concatenate(points).astype(np.uint64) + _GOLD)
    first = np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
    level = 0
    while True:
        counts = np.diff(np.append(first, len(names)))
        last = counts == 1
        kept = ~last
        if level >= LEVEL:
            yield names, first, own
        elif last.any():
            yield names[first[last]], np.arange(last.sum()), own[last]
        if not kept.any():
            return
        if last.any():  # a text of one name is done
            names = names[np.repeat(kept, counts)]
            first = np.concatenate([[0], np.cumsum(counts[kept])[:-1]])
            own = own[kept]
        names, first = phrases(names, first)
        level += 1


def _minima(texts: list[str]) -> np.ndarray:
    least = np.full((SLOTS, len(texts)), np.uint64((1 << 64) - 1))
    for names, first, own in signatures(texts):
        for row, salt, factor in zip(least, _SALTS, _FACTORS):
            row[own] = np.minimum(row[own], np.minimum.reduceat((names ^ salt) * factor, first))
    return least.T.astype(np.uint8)


def prints_of(texts: list[str]) -> list[bytes]:
    """The fingerprints of texts; of the empty text: no bytes."""
    out: list[bytes] = []
    start = held = 0
    for i, text in enumerate([*texts, None]):
        if text is None or (held and held + len(text) > AT_ONCE):
            some = texts[start:i]
            out += [row.tobytes() if t else b"" for t, row in zip(some, _minima(some))] if some else []
            start, held = i, 0
        held += len(text or "")
    return out


def fingerprints_of(texts: list[str]) -> list[str]:
    """Hex digits of the fingerprints of texts."""
    return [p.hex() for p in prints_of(texts)]


def fingerprint(text: Column) -> Column:
    """The fingerprint of each text, 2 * SLOTS hex digits; of null and empty texts: the empty string."""

    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints_of(["" if t is None else t for t in texts]), dtype=object)

    return F.pandas_udf(prints, "string")(text)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: share of signatures in common, from the equal slots of two fingerprints less those that chance makes equal.

    1 for equal fingerprints, so for two empty ones as well; 0 if only one is empty; null if one is null.
    """
    slots = lambda c: F.regexp_extract_all(c, F.lit("(..)"), F.lit(1))
    same = F.size(F.filter(F.zip_with(slots(a), slots(b), lambda x, y: x == y), lambda e: e)) / F.lit(SLOTS)
    shared = F.greatest((same - 1 / 256) / (1 - 1 / 256), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when(a.isNotNull() & b.isNotNull(), F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(2 * shared / (1 + shared)))


PAIR, HEAD, TAIL = range(3)
_EDITED = "_kind byte, _part int, _id string, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, next_fingerprint binary, _text string"


def _pairs(ids: list, texts: list[str], prints: list[bytes], part: int) -> pd.DataFrame:
    """A row for each text but the last, with what comes of it and the next one."""
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
    digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited]
    n = pd.Series([len(t) for t in texts[:-1]], dtype="int64")
    return pd.DataFrame({"_kind": PAIR, "_part": part, "_id": ids[:-1], "n_chars": n, "edited_sha256": digests, "fingerprint": prints[:-1], "edited_fingerprint": prints_of(edited), "next_fingerprint": prints[1:], "_text": None})


def _end(i, text: str, own: bytes, part: int, kind: int) -> pd.DataFrame:
    return pd.DataFrame({"_kind": [kind], "_part": [part], "_id": [i], "n_chars": [len(text)], "edited_sha256": [None], "fingerprint": [own], "edited_fingerprint": [None], "next_fingerprint": [None], "_text": [text]})


@releasing
def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row of a sorted partition with the next one; its first and its last row with their texts, as what comes before and after them is in other partitions."""
    part = TaskContext.get().partitionId()
    held: tuple[list, list, list] | None = None  # the last row so far
    for batch in batches:
        ids = batch["_id"].tolist()
        texts = ["" if t is None else t for t in batch["_text"]]
        if not ids:
            continue
        prints = prints_of(texts)
        if held is None:
            yield _end(ids[0], texts[0], prints[0], part, HEAD)
        else:
            ids, texts, prints = held[0] + ids, held[1] + texts, held[2] + prints
        if len(ids) > 1:
            yield _pairs(ids, texts, prints, part)
        held = ids[-1:], texts[-1:], prints[-1:]
    if held is not None:
        yield _end(held[0][0], held[1][0], held[2][0], part, TAIL)


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield _pairs([row.id, None], [row.a, row.b], [row.fa, row.fb], 0)


def edited_fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint of each row of docs.

    The edited text's last half of code points (rounded down) is replaced by the first as many, or all, of
    the next row's text, in descending order of the id; after the last comes the first. Null texts are empty ones. Null ids
    come last, rows of one id in order of a hash of their texts. A single row is next to
    itself; an empty table gives no rows.

    Rows are sorted across the cluster once. The texts at both ends of each partition are all that is written, beside digests and fingerprints as bytes.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    # The last key splits many equal rows, whose order doesn't matter.
    order = [F.col("_id").desc_nulls_last(), F.xxhash64("_text"), F.col("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    made = cut(dealt.select(F.col("_id").cast("string"), "_text").mapInPandas(_edits, _EDITED))
    parts = sorted(r._part for r in made.filter(F.col("_kind") == HEAD).select("_part").collect())  # a number for each partition
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "_part int, _next int")
    tails = made.filter(F.col("_kind") == TAIL).select("_part", F.col("_id").alias("id"), F.col("_text").alias("a"), F.col("fingerprint").alias("fa"))
    heads = made.filter(F.col("_kind") == HEAD).select(F.col("_part").alias("_next"), F.col("_text").alias("b"), F.col("fingerprint").alias("fb"))
    across = tails.join(follows, "_part").join(heads, "_next").select("id", "a", "fa", "b", "fb").mapInPandas(_joined, _EDITED)
    whole = made.filter(F.col("_kind") == PAIR).unionByName(across)
    digits = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")]
    return whole.select(F.col("_id").cast(kind).alias(id_col), "n_chars", *digits)


def op12_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    made = edited_fingerprints(table(spark, sf_dir, "documents"))
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))}
    return made.withColumns(near).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
