"""Suffix-array dedup with sparse suffixes.

Only suffixes that begin at content-selected positions are kept: the minimisers of a hash of
GRAM words over WINDOW neighbouring positions. A passage of MIN_WORDS words holds at least
one such position with DEPTH words after it, and equal passages hold the same ones.

The suffixes are sorted across the cluster, word block by word block, each block as a 64-bit
hash: the first DEPTH words, then the words around these that can belong to a common window
of MIN_WORDS words, then the place. Each is compared with its neighbour before it. If both
blocks are equal, so are all windows around the suffix, and the later one repeats them
whole. If only the first block is, the match ends somewhere in between: such suffixes, one of
each class of equals, are extended to the left and right, window by window, and each window
meets the first of its equals. Both blocks together are 128 bits.

Since a match always points to a smaller (id, text, place), the first copy of a passage stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, cut, drop, releasing, table

MIN_WORDS, WINDOW, GRAM = 50, 25, 8
DEPTH = MIN_WORDS - WINDOW + 1
#: A window starts at most so many words before a kept suffix of its own.
REACH = WINDOW - 1
#: Stands for a null id, so that such rows come last.
NO_ID = (1 << 63) - 1
#: Words whose hashes a worker keeps while it runs a task.
CACHE = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = re.compile(r"\S+")
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class _Hashes(dict):
    """64-bit hash of a word; of bounded size."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


_hash_of = _Hashes()
clear_hashes = _hash_of.clear


def word_hashes(text: str) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
    return _POWERS[0], _POWERS[1]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width words from each position on."""
    n = len(hashes)
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * up[:n])])
    return _mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


def _sliding(values: np.ndarray, width: int, f) -> np.ndarray:
    """f over each width neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def kept_suffixes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the minimisers that have DEPTH words, the hash of those words, that of the words around them, and how many of these follow."""
    n = len(hashes)
    if n < MIN_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int8)
    places = n - DEPTH + 1
    order = rolling(hashes, GRAM)[:places]
    least = _sliding(order, WINDOW, np.minimum)
    bounded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    at = np.flatnonzero(order == _sliding(bounded, WINDOW, np.maximum))
    before, after = np.minimum(at, REACH), np.minimum(n - DEPTH - at, REACH)
    key = rolling(hashes, DEPTH)[at]
    salted = hashes * _INVERSE ^ (hashes >> np.uint64(32))  # a second hash of each word
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(salted * up[:n])])
    around = _mixed((sums[at + DEPTH + after] - sums[at - before]) * down[at - before]) ^ _mixed((before * (REACH + 1) + after).astype(np.uint64) + np.uint64(1))
    return at, key, around, after.astype(np.int8)


@releasing
def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, found = [], []
        for i, h, text in zip(batch["_id"], batch["_hash"], batch["text"]):
            own = kept_suffixes(word_hashes(text)) if text else ((),)
            if len(own[0]):
                rows.append((i, h, len(own[0])))
                found.append(own)
        if found:
            at, key, around, after = (np.concatenate(x) for x in zip(*found))
            ids, hashes, n = (np.array(x, np.int64) for x in zip(*rows))
            yield pd.DataFrame({"_key": key.view(np.int64), "_around": around.view(np.int64), "_id": np.repeat(ids, n), "_hash": np.repeat(hashes, n), "_at": at.astype(np.int32), "_after": after})
    _hash_of.clear()


#: Kinds of rows that the comparison of neighbours gives.
WHOLE, EDGE, HEAD, TAIL = range(4)
_COMPARED = "_kind byte, _id long, _hash long, _at int, _after byte, _from long, _part int, _key long, _around long"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare each of the sorted suffixes of one partition with that before it.

    WHOLE: equal in both blocks to an earlier one, the first of which is from; _part is set
    as long as the partition's first class lasts, which may have begun before it. EDGE: the
    first of its class where the first block has several classes. HEAD and TAIL: the
    partition's first suffix, and the first one of its last class.
    """
    part = TaskContext.get().partitionId()
    held: pd.DataFrame | None = None  # the first suffix of the last class so far
    before = None  # the last row; rows equal in id, text and place come from repeated rows, and only the first counts
    lead, started, mixed = True, False, False
    for batch in batches:
        place = batch[["_id", "_hash", "_at"]].to_numpy()
        if len(place):
            fresh = np.concatenate([[before is None or (place[0] != before).any()], (place[1:] != place[:-1]).any(1)])
            before, batch = place[-1], batch[fresh]
        if not len(batch):
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key, around = rows["_key"].to_numpy(), rows["_around"].to_numpy()
        same_key = np.concatenate([[False], key[1:] == key[:-1]])
        whole = same_key & np.concatenate([[False], around[1:] == around[:-1]])
        first = np.maximum.accumulate(np.where(whole, 0, np.arange(len(rows))))  # the first of each one's class
        classes = np.flatnonzero(~whole)
        if not started:
            yield _compared(rows.iloc[:1], HEAD, part)
            started = True
        # A class shares its first block with that before or after it; what held knows of the one before is kept in mixed.
        joins = same_key[classes]
        several = joins | np.append(joins[1:], False)
        several[0] |= mixed
        settled = several.copy()
        settled[-1] = False  # the last class is settled by the next batch or the next partition
        yield _compared(rows.iloc[classes[settled]], EDGE, part)
        out = _compared(rows.iloc[np.flatnonzero(whole)], WHOLE, -1)
        out["_from"] = rows["_id"].to_numpy()[first[whole]]
        if lead:
            out.loc[(first[whole] == 0), "_part"] = part
            lead = len(classes) == 1
        yield out
        mixed = bool(several[-1])
        held = rows.iloc[[classes[-1]]]
    if held is not None:
        if mixed:
            yield _compared(held, EDGE, part)
        last = _compared(held, TAIL, part)
        last["_from"] = int(lead)  # whether it is the class that the partition begins with
        yield last


def _compared(rows: pd.DataFrame, kind: int, part: int) -> pd.DataFrame:
    out = rows[["_id", "_hash", "_at", "_after", "_key", "_around"]].copy()
    if kind in (WHOLE, EDGE):
        out["_key"] = out["_around"] = 0
    out["_kind"], out["_part"], out["_from"] = kind, part, 0
    return out[["_kind", "_id", "_hash", "_at", "_after", "_from", "_part", "_key", "_around"]]


def _across(ends: list) -> tuple[dict[int, int], list[tuple]]:
    """What neighbours in different partitions add, from the HEAD and TAIL of each: partition -> the id that its first class begins with, and rows (kind, id, hash, at, after, from)."""
    heads = {r._part: r for r in ends if r._kind == HEAD}
    tails = {r._part: r for r in ends if r._kind == TAIL}
    begun: dict[int, int] = {}
    more: list[tuple] = []
    last = None  # first suffix of the class that the partitions so far end with
    for part in sorted(heads):
        head, tail = heads[part], tails[part]
        if last is not None and last._key == head._key:
            more += [(EDGE, x._id, x._hash, x._at, x._after, 0) for x in (last, head)]
            if last._around == head._around:
                begun[part] = last._id
                more.append((WHOLE, head._id, head._hash, head._at, head._after, last._id))
                if tail._from:  # one class fills the partition
                    continue
        last = tail
    return begun, more


def open_windows(places: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of MIN_WORDS words, of n words, in which one of the kept suffixes at places lies with its DEPTH words."""
    change = np.zeros(n + 2, np.int32)
    np.add.at(change, np.clip(places - REACH, 0, n), 1)
    np.add.at(change, places + 1, -1)
    return np.flatnonzero(np.add.accumulate(change)[: max(n - MIN_WORDS + 1, 0)] > 0)


@releasing
def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, starts, grams, again = [], [], [], []
        for i, h, text, places in zip(batch["_id"], batch["_hash"], batch["text"], batch["_places"]):
            own = word_hashes(text)
            at = open_windows(np.asarray(places, np.int64), len(own))
            if len(at):
                rows.append((i, h, len(at)))
                starts.append(at)
                grams.append(rolling(own, MIN_WORDS)[at])
                again.append(rolling(own * _INVERSE ^ (own >> np.uint64(32)), MIN_WORDS)[at])
        if rows:
            ids, hashes, n = (np.array(x, np.int64) for x in zip(*rows))
            yield pd.DataFrame({"_gram": np.concatenate(grams).view(np.int64), "_gram2": np.concatenate(again).view(np.int64), "_id": np.repeat(ids, n), "_hash": np.repeat(hashes, n), "_at": np.concatenate(starts).astype(np.int32)})
    _hash_of.clear()


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _hash, text of the rows with a text; the largest long stands for a null id."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    return own.filter("text IS NOT NULL")


def matches(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """_id, _hash, _start, _end, _from: stretches of words that stand at an earlier place too, and the id of the first of these.

    All windows of MIN_WORDS words in a stretch are repeated, and each repeated window is
    in one. Rows are told apart by id and text; rows equal in both are one document.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = _named(docs, id_col, text_col)
    order = ["_key", "_around", "_id", "_hash", "_at"]
    suffixes = cut(own.mapInPandas(_suffixes, "_key long, _around long, _id long, _hash long, _at int, _after byte"))
    # The place is part of the order, so a block that many documents share is dealt over partitions as well.
    compared = cut(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_neighbours, _COMPARED))
    drop(suffixes)
    # Two rows of each partition, however large the table.
    begun, more = _across(compared.filter(F.col("_kind") >= HEAD).select("_kind", "_part", "_key", "_around", "_id", "_hash", "_at", "_after", "_from").collect())
    added = spark.createDataFrame(more, "_kind byte, _id long, _hash long, _at int, _after byte, _from long")
    since = F.create_map(*[F.lit(x) for pair in begun.items() for x in pair]) if begun else F.create_map().cast("map<int,bigint>")
    rows = compared.filter(F.col("_kind") < HEAD).select("_kind", "_id", "_hash", "_at", "_after", F.coalesce(F.try_element_at(since, F.col("_part")), F.col("_from")).alias("_from")).unionByName(added)
    whole = rows.filter(F.col("_kind") == WHOLE).select("_id", "_hash", F.greatest(F.col("_at") - REACH, F.lit(0)).alias("_start"), (F.col("_at") + DEPTH + F.col("_after")).alias("_end"), "_from")
    places = rows.filter(F.col("_kind") == EDGE).groupBy("_id", "_hash").agg(F.collect_set("_at").alias("_places"))
    windows = cut(own.dropDuplicates(["_id", "_hash"]).join(places, ["_id", "_hash"]).mapInPandas(_windows, "_gram long, _gram2 long, _id long, _hash long, _at int"))
    gram = ["_gram", "_gram2"]
    first = cut(windows.groupBy(gram).agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_hash", "_at")).alias("_first")).filter("_n > 1").drop("_n"))
    later = windows.join(first, gram).filter(F.struct("_id", "_hash", "_at") > F.col("_first"))
    return whole.unionByName(later.select("_id", "_hash", F.col("_at").alias("_start"), (F.col("_at") + MIN_WORDS).alias("_end"), F.col("_first._id").alias("_from")))


def _passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _hash, start_word, end_word, _from of the repeated passages; stretches that overlap or touch are one."""
    order = Window.partitionBy("_id", "_hash").orderBy("_start", "_end")
    found = matches(docs, id_col, text_col).groupBy("_id", "_hash", "_start").agg(F.max("_end").alias("_end"), F.min("_from").alias("_from"))
    reached = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("_new", F.coalesce(F.col("_start") > reached, F.lit(True)).cast("int"))
    parts = parts.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("_id", "_hash", "_run").agg(F.min("_start").alias("start_word"), F.max("_end").alias("end_word"), F.min("_from").alias("_from"))


def repeated_passages(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, start_word, end_word, n_words, first_doc_id of every passage that repeats an earlier one.

    Passages that overlap or touch in a document are one; first_doc_id is the smallest id that
    they repeat (the document's own, if it repeats itself). Null and empty texts have none.
    Null ids come last in the order, and stay null. Different texts of one id are
    different documents; rows equal in id and text are one. Exact copies of other ids
    repeat their whole text if it has MIN_WORDS words.
    """
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return _passages(docs, id_col, text_col).select(real("_id").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), real("_from").alias("first_doc_id"))


def without_spans(text: str | None, spans) -> str | None:
    """The text without the words of the spans (start, end), and the white space after them."""
    if text is None or spans is None or not len(spans):
        return text
    words, out, at = [m.start() for m in _WORD.finditer(text)], [], 0
    for start, end in sorted((s["start_word"], s["end_word"]) for s in spans):
        begin, stop = words[start] if start < len(words) else len(text), words[end] if end < len(words) else len(text)
        out.append(text[at : max(begin, at)])
        at = max(stop, at)
    return "".join([*out, text[at:]]).rstrip() if at >= len(text) else "".join([*out, text[at:]])


def cut_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs with the repeated passages cut from the text; a text of nothing else becomes empty. All rows and columns stay, whatever their names; rows equal in id and text are cut alike."""

    def shorter(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, s) for t, s in zip(text, spans)], dtype=object)

    spans = _passages(docs, id_col, text_col).groupBy("_id", "_hash").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    keyed = rows.withColumns({"_id": F.coalesce(F.col("row")[id_col].cast("long"), F.lit(NO_ID)), "_hash": F.xxhash64(F.col("row")[text_col])})
    joined = keyed.join(spans, ["_id", "_hash"], "left")
    text = F.pandas_udf(shorter, "string")(F.col("row")[text_col], F.col("spans"))
    return joined.withColumn("text", text).select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op3_suffixes(spark, sf_dir):
    """Repeated passages of all documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))
