"""Periodic runs of words by Lyndon arrays from Baier's grouping.

The first phase of Baier's suffix sorter keeps suffixes in ordered groups, each with a
context that its members begin with, and takes them from the highest down: each member of a group
points to the nearest suffix before it in a lower group, and suffixes that the group's context
follows l times move, l by l, to a new group right above their own, with a context longer by
that. When a suffix's own group is taken, its context is the longest Lyndon word that starts
there, so this phase alone gives the Lyndon array. It runs under an order of the words and its reverse.

Every run has roots that are longest Lyndon words in one of the two arrays, and a run of four periods
holds three of them side by side. Where three lengths are equal so, the root is extended
by the longest common extension to both sides, which gives the run.

A run of EXPONENT periods has each of its words so many times. So words that the text has less
often end every run, and the stretches between them are sorted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, releasing, table

#: A run has at least so many words and so many periods.
LEAST, EXPONENT = 6, 4


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, by the grouping phase; symbols are small whole numbers."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.diff(symbols[order])) + 1
    members = [m.tolist() for m in np.split(order + 1, cuts)]  # places from 1 on, as 0 stands for none
    k = len(members)
    group = np.zeros(n + 1, np.int64)
    group[order + 1] = np.repeat(np.arange(k), np.diff(np.concatenate([[0], cuts, [n]])))
    group = group.tolist()
    size = [len(m) for m in members]
    length = [1] * k
    below, above = list(range(-1, k - 1)), [*range(1, k), -1]
    before = list(range(n + 1))  # the nearest place up to this one that isn't taken, found by halving paths
    out = [0] * (n + 1)
    at = k - 1
    while at >= 0:
        own = members[at]
        if len(own) > size[at]:
            own = [i for i in own if group[i] == at]
        context = length[at]
        for i in own:
            before[i] = i - 1
            out[i] = context
        follows: dict[int, int] = {}
        for i in own:
            while before[i] != i:
                before[i] = before[before[i]]
                i = before[i]
            if i:
                follows[i] = follows.get(i, 0) + 1
        if follows:
            split: dict[tuple, list] = {}
            for i, times in follows.items():
                split.setdefault((-times, group[i]), []).append(i)
            for times, old in sorted(split):  # most repeats first, so that these end up highest
                moved = split[times, old]
                if len(moved) == size[old]:
                    length[old] -= times * context
                    continue
                new, high = len(members), above[old]
                members.append(moved)
                size.append(len(moved))
                length.append(length[old] - times * context)
                below.append(old)
                above.append(high)
                above[old] = new
                below[high] = new  # a group above it always exists: the one that is taken now
                size[old] -= len(moved)
                for i in moved:
                    group[i] = new
        at = below[at]
    return np.array(out[1:], np.int64)


def extension(a: np.ndarray, b: np.ndarray) -> int:
    """Words that a and b have in common from their starts, in blocks that double."""
    n, done, step = min(len(a), len(b)), 0, 16
    while done < n:
        apart = np.flatnonzero(a[done : done + step][: n - done] != b[done : done + step][: n - done])
        if len(apart):
            return done + int(apart[0])
        done, step = done + step, step * 2
    return n


def runs_of(symbols: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of LEAST words and EXPONENT periods.

    Longest Lyndon words don't cross, so triples of one length are disjoint, and those of
    different lengths nest by a factor of three: all extensions that fail take n log n steps.
    """
    found: set[tuple[int, int, int]] = set()
    n = len(symbols)
    for way in (symbols, symbols.max(initial=0) - symbols):
        lengths = lyndon_lengths(way)
        place = np.arange(n)
        next_, third = place + lengths, place + 2 * lengths
        triple = third < n
        triple[triple] = (lengths[next_[triple]] == lengths[triple]) & (lengths[third[triple]] == lengths[triple])
        reached: dict[int, int] = {}
        for i in np.flatnonzero(triple).tolist():
            period = int(lengths[i])
            if reached.get(period, -1) >= i + period:
                continue  # inside the last run of this period
            right = i + period + extension(symbols[i:], symbols[i + period :])
            left = i - extension(symbols[:i][::-1], symbols[: i + period][::-1])
            if right - left >= max(LEAST, EXPONENT * period):
                found.add((left, right - left, period))
                reached[period] = right
    return found


def stretches(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the stretches of LEAST words or more without a word that the text has fewer than EXPONENT times."""
    often = np.concatenate([[False], np.bincount(symbols)[symbols] >= EXPONENT, [False]])
    edges = np.flatnonzero(often[1:] != often[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= LEAST]


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a list of words, by start, then period."""
    number: dict = {}
    symbols = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = []
    for start, end in stretches(symbols) if len(words) >= LEAST else ():
        inner = np.unique(symbols[start:end], return_inverse=True)[1]
        found += [(start + at, length, period) for at, length, period in runs_of(inner)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    keep = np.cumsum(dropped)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


@releasing
def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        runs, texts = [], []
        for text in batch.pop("_text"):
            words = text.encode("utf-8", "replace").split() if text else []
            own = word_runs(words)
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
            texts.append(b" ".join(collapsed(words, own)).decode())
        batch["runs"], batch["collapsed"] = runs, texts
        yield batch


def periodic_runs(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, runs (start, length, period; by start, then period) and collapsed of each row of docs.

    Words are what stands between ASCII white space. A run is a longest stretch with a smallest period, of
    LEAST words and EXPONENT periods or more. collapsed holds the words, joined by one space, without those that a
    run has after its first period. Null and empty texts have no runs and an empty collapsed
    text; null ids and repeated rows give a row each; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))  # a string, as pandas has no whole numbers beside nulls
    found = own.mapInPandas(_found, "_id string, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "runs", "collapsed")


def _repeating(text, doc_id):
    """Every tenth text by crc32 of its id, with its end made periodic, so that there are runs to find; the others as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    a = (g % n).cast("int")
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
    parts = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))
    # Computed once a row: the lambda's argument holds the words and numbers.
    made = F.transform(F.array(parts), lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(i >= x["a"], F.get(x["w"], x["a"] + (i - x["a"]) % x["p"])).otherwise(w)), " "))
    return F.when((h % 10 == 0) & (F.coalesce(n, F.lit(0)) > 0), made[0]).otherwise(text)


def op11_runs(spark, sf_dir):
    """Runs of all documents, a tenth of which are made periodic: their number, the longest, digests of all runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", _repeating(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    named = found.withColumns({"_best": best, "_lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))})
    length = -F.col("_best.l")
    return named.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        length.alias("length"),
        F.col("_best.p").alias("period"),
        F.expr("-_best.l * 1000 div _best.p").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
