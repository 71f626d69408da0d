"""Exact BM25 top-k: inverted index per shard, block-max pruning, exact merge.

Documents with the same words equally often have the same scores: they are one document of the
index, with the smallest ids and the number of its copies. Queries with the same words are one query.

Documents that have the same most frequent term, and then like lengths, are neighbours, so a
shard, one row with packed arrays, holds alike documents. It is bounded in documents and
in postings, and cut into blocks of BLOCK documents and wide blocks of WIDE.

For each query the largest impact of each of its terms in a shard bounds what the shard's
documents can reach; a shard below the query's floor is left at once. Within a shard the
lists of rare terms are read and added up by document; for frequent terms, whose lists make
up most of the index, the largest impact in each block is known, and the sum of these with
the largest of the rare sums bounds a block. Alike queries, those with the same best wide
block, are taken GROUP at a time: first their wide blocks are bounded, then the blocks of those that
reach the floor of any, then single documents of the blocks that reach the query's own. These
bounds are products of whole arrays in 32 bits, raised by what rounding can lack. As in WAND, what can't pass by
its maxima is skipped unread; but no cursor moves from document to document. What
passes is scored in 64 bits in one order of terms, so equal documents tie exactly; where many pass,
the best by their bounds are scored first, which raises the query's threshold.

The shards are searched in two rounds or three: about the square root of their number first, evenly
over the kinds of documents, whose k-th best score is the floor for the others; of many shards,
again the square root of what each of these stands for, then the rest. A task
keeps the k best of each query over its shards, which raises the floors further.

Document frequencies, the number of documents and their mean length are those of the whole
collection, so the scores of all shards compare, and the best k of all are exact. The
queries meet the shards in blocks of QUERIES, one grid cell at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, cut, releasing, rows_at_once, table

K1, B, TOP = 1.2, 0.75, 10
#: Bounds of a shard, in documents and postings; documents of a block; queries that meet a shard at once; terms whose frequencies are looked up at once.
SHARD, POSTINGS, BLOCK, QUERIES, TERMS = 2048, 750_000, 2, 2048, 50_000
#: Documents of a wide block; postings in a row of rare ones; documents that are bounded at once; their share of a shard from which all are.
WIDE, CHUNK, AHEAD, DENSE = 64, 8, 512, 1 / 16
#: Bundles of queries in a file, and so in a task.
AT_ONCE = 8
#: From so large a step on between the shards of the first round, there is a round between it and the last.
ROUNDS = 16
#: Queries that are searched together; documents that may pass before the best of a query are scored first to raise its floor; a frequent term's share of a shard, and how many there are at most.
GROUP, MANY, FREQUENT, MOST = 128, 32, 1 / 16, 1024
#: Parts that the documents of one leading term are dealt to: SALT at least, and one for each PART documents of the collection, so that a hot term's parts don't grow with it.
SALT, PART = 16, 16_384
#: Relative error of sums in another order, with a margin; that of a number in 32 bits; terms whose hashes a worker keeps while it runs a task.
ERROR, ROUNDED, CACHE = 1e-9, 1.2e-7, 200_000
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """64-bit hash of a term; of bounded size."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


_hash_of = _Hashes()


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct lower-case words, in order, and how often each occurs."""
    words = _WORD.findall(text.lower()) if text else []
    hashes = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words)).view(np.int64)
    return np.unique(hashes, return_counts=True)


POSTINGS_SCHEMA = "_ids binary, _copies long, _lead long, _length long, _terms binary, _counts binary, _print binary"


def _postings(k: int):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Texts with the same words are one row, so a text that is very common is one in each batch.
            alike: dict[bytes, list] = {}
            for i, text in zip(batch["_id"].tolist(), batch["text"]):
                terms, counts = terms_of(text)
                packed = terms.tobytes(), counts.astype(np.int32).tobytes()
                alike.setdefault(b"".join(packed), [terms, counts, *packed, []])[-1].append(i)
            found = list(alike.values())
            # The most frequent term tells languages and subjects apart; like lengths have like impacts.
            lead = [int(t[n.argmax()]) if len(t) else 0 for t, n, *_ in found]
            columns = [_some(x[-1], k) for x in found], [len(x[-1]) for x in found], lead, [int(x[1].sum()) for x in found], [x[2] for x in found], [x[3] for x in found], [xxhash.xxh3_128_digest(same) for same in alike]
            yield pd.DataFrame(dict(zip(("_ids", "_copies", "_lead", "_length", "_terms", "_counts", "_print"), columns)))
        _hash_of.clear()

    return run


def _some(ids: list[int], k: int) -> bytes:
    """The k smallest: of texts with the same words, which have the same scores, no others can be among the k best."""
    return np.array(sorted(ids)[:k], np.int64).tobytes()


def _narrow(numbers: np.ndarray) -> bytes:
    """In as few bytes each as the largest needs: one, two or four."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _kind(packed: bytes, n: int) -> np.dtype:
    """The type in which n numbers are packed."""
    return np.dtype(f"u{len(packed) // n if n else 1}")


def _pack(ids: list, found: list[tuple[np.ndarray, np.ndarray]], lead: int = 0, copies: list[int] | None = None) -> dict:
    """A shard of documents, in the order in which they come. ids: of each document, or of each its own ids; copies: how many there are of each."""
    own = [np.atleast_1d(np.asarray(i, np.int64)) for i in ids]
    sizes = np.array([len(t) for t, _ in found], np.int64)
    term = np.concatenate([t for t, _ in found]) if found else np.empty(0, np.int64)
    count = np.concatenate([n for _, n in found]) if found else np.empty(0, np.int32)
    doc = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
    by = np.argsort(term, kind="stable")
    term, count, doc = term[by], count[by], doc[by]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
    return {
        "ids": np.concatenate(own or [np.empty(0, np.int64)]).tobytes(),
        "kept": np.array([len(i) for i in own], np.int32).tobytes(),
        "copies": np.array(copies or [1] * len(own), np.int64).tobytes(),
        "lengths": np.array([int(n.sum()) for _, n in found], np.int64).tobytes(),
        "terms": term[first].tobytes(),
        "starts": np.append(first, len(term)).astype(np.int64).tobytes(),
        "docs": _narrow(doc),
        "counts": _narrow(count),
        "lead": lead,
    }


SHARD_SCHEMA = "ids binary, kept binary, copies binary, lengths binary, terms binary, starts binary, docs binary, counts binary, lead long"


def _shards(k: int):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, found, copies, lead, postings, last = [], [], [], 0, 0, None
        for batch in batches:
            for i, n, own, terms, counts in zip(batch["_ids"], batch["_copies"], batch["_lead"], batch["_terms"], batch["_counts"]):
                i = np.frombuffer(i, np.int64)
                if (terms, counts) == last:
                    ids[-1], copies[-1] = np.sort(np.append(ids[-1], i))[:k], copies[-1] + int(n)
                    continue
                last = terms, counts
                if ids and (len(ids) == SHARD or postings + len(terms) // 8 > POSTINGS):
                    yield pd.DataFrame([_pack(ids, found, lead, copies)])
                    ids, found, copies, postings = [], [], [], 0
                lead = lead if ids else int(own)
                ids.append(i)
                copies.append(int(n))
                found.append((np.frombuffer(terms, np.int64), np.frombuffer(counts, np.int32)))
                postings += len(found[-1][0])
        if ids:
            yield pd.DataFrame([_pack(ids, found, lead, copies)])

    return run


def build_shards(docs: DataFrame, id_col="doc_id", text_col="text", k=TOP) -> DataFrame:
    """One row for each shard, for searches of k documents at most. Rows with a null id are left out; empty and null texts are documents of length 0."""
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).filter("_id IS NOT NULL")
    salt = max(SALT, own.select("_id").count() // PART)
    rows = own.mapInPandas(_postings(k), POSTINGS_SCHEMA)
    dealt = rows.repartition("_lead", F.pmod(F.xxhash64("_print"), F.lit(salt))).sortWithinPartitions("_lead", "_length", "_print", "_terms", "_counts")
    return dealt.drop("_length", "_print").mapInPandas(_shards(k), SHARD_SCHEMA)


class Shard:
    """A shard's arrays, with impacts, block maxima and shard maxima for a mean length."""

    def __init__(self, row, mean_length: float):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.id_starts = np.append(0, np.cumsum(np.frombuffer(row["kept"], np.int32), dtype=np.int64))
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.int64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.docs = np.frombuffer(row["docs"], _kind(row["docs"], self.starts[-1]))
        counts = np.frombuffer(row["counts"], _kind(row["counts"], self.starts[-1])).astype(np.float64)
        weight = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        self.impacts = counts * (K1 + 1) / (counts + weight[self.docs])
        self.most = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(self.terms) else np.empty(0)
        self.n = len(lengths)
        wide = -(-self.n // WIDE)
        self.blocks = wide * (WIDE // BLOCK)
        sizes = np.diff(self.starts)
        frequent = np.flatnonzero(sizes >= max(self.n * FREQUENT, BLOCK))
        frequent = frequent[np.argsort(-sizes[frequent], kind="stable")[:MOST]]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((self.blocks * BLOCK, len(frequent)), np.float32)
        at, n = _spread(self.starts[frequent], self.starts[frequent + 1])
        self.matrix[self.docs[at], np.repeat(np.arange(len(frequent)), n)] = self.impacts[at]
        self.block_max = self.matrix.reshape(self.blocks, BLOCK, len(frequent)).max(1)
        self.wide_max = self.block_max.reshape(wide, WIDE // BLOCK, len(frequent)).max(1)
        # The lists of rare terms in rows of CHUNK postings, filled up with impacts of 0, so that whole rows are read.
        sizes[frequent] = 0
        self.rows = np.append(0, np.cumsum(-(-sizes // CHUNK)))
        at, n = _spread(self.starts[:-1], self.starts[:-1] + sizes)
        to, _ = _spread(self.rows[:-1] * CHUNK, self.rows[:-1] * CHUNK + sizes)
        self.rare_docs, self.rare_impacts = np.zeros((self.rows[-1], CHUNK), np.int32), np.zeros((self.rows[-1], CHUNK), np.float32)
        self.rare_docs.ravel()[to] = self.docs[at]
        self.rare_impacts.ravel()[to] = self.impacts[at]
        # The postings by document.
        self.by_doc = np.argsort(self.docs, kind="stable")
        self.doc_terms = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))[self.by_doc]
        self.doc_starts = np.append(0, np.cumsum(np.bincount(self.docs, minlength=self.n)))

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in the shard, -1 for others."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def reach(self, at: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bound of all documents of the shard, for each of the queries whose terms begin at first."""
        return np.add.reduceat(np.where(at >= 0, self.most[at] * weights, 0), first) if len(self.terms) else np.zeros(len(first))

    def best(self, terms: np.ndarray, weights: np.ndarray, first: np.ndarray, floors: np.ndarray, k: int, places: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, ids, scores): the k best documents that reach its floor, ties by the smaller id, of each query; its terms begin at first. With places, the terms are distinct, and places says which one stands where."""
        once = self.find(terms)
        if not len(self.terms):
            return []
        places = np.arange(len(once)) if places is None else places
        ends = np.append(first[1:], len(places))
        at = once[places]
        reach = np.add.reduceat(np.where(once >= 0, self.most[once], 0)[places] * weights, first)
        open_ = np.flatnonzero((reach > 0) & (reach * (1 + ERROR) >= floors))
        if not len(open_):
            return []
        column = np.where(once >= 0, self.column[once], -1)[places]
        often = np.flatnonzero(column >= 0)
        dense = np.zeros((len(first), self.matrix.shape[1]), np.float32)
        dense[np.searchsorted(ends, often, "right"), column[often]] = weights[often]
        light = weights.astype(np.float32)
        # Where the rare lists of each term begin and end.
        starts, stops = np.where(once >= 0, self.rows[once], 0)[places], np.where(once >= 0, self.rows[once + 1], 0)[places]
        # What sums of so many rounded numbers may lack.
        near = (1 + (ends - first + 16) * ROUNDED).astype(np.float32)
        wide = dense @ self.wide_max.T
        open_ = open_[np.argsort(wide[open_].argmax(1), kind="stable")]
        slots = np.full(len(self.terms), -1, np.int32)
        found = []
        for start in range(0, len(open_), GROUP):
            group = open_[start : start + GROUP]
            every, sizes = _spread(first[group], ends[group])
            mine = stops[every] > starts[every]
            own, asks = every[mine], np.repeat(np.arange(0, len(group) * len(self.matrix), len(self.matrix), np.int32), sizes)[mine]
            place, sizes = _spread(starts[own], stops[own])
            to, much = self.rare_docs.take(place, 0), self.rare_impacts.take(place, 0)
            to += np.repeat(asks, sizes)[:, None]
            much *= np.repeat(light[own], sizes)[:, None]
            rare = np.bincount(to.ravel(), much.ravel(), len(group) * len(self.matrix)).astype(np.float32).reshape(len(group), -1)
            rare_max = _by_block(rare)
            least = floors[group]
            may = (wide[group] + rare_max.reshape(len(group), -1, WIDE // BLOCK).max(2)) * near[group, None] >= least[:, None]
            live, parts = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if not len(live):
                continue
            if len(live) < len(group):
                group, least, rare, rare_max = group[live], least[live], rare[live], rare_max[live]
            blocks = (parts[:, None] * (WIDE // BLOCK) + np.arange(WIDE // BLOCK)).ravel()
            whole = len(blocks) == self.blocks
            rare_max = rare_max if whole else rare_max[:, blocks]
            frequent = dense[group] @ (self.block_max if whole else self.block_max[blocks]).T
            bound = frequent + rare_max
            bound *= near[group, None]
            q, which = np.nonzero((bound >= least[:, None]) & (bound > 0))
            for n, docs, bound in self._passing(q, blocks[which], frequent[q, which], dense[group], rare, near[group], least):
                a, b = first[group[n]], ends[group[n]]
                if len(docs) > max(MANY, 2 * k):
                    # The floor lets many pass: the best of them raise it.
                    ahead = np.argpartition(-bound, 2 * k)[: 2 * k]
                    scores = self.score(docs[ahead], at, weights, a, b, slots)
                    docs = docs[bound >= np.partition(scores, k)[k] * (1 - ROUNDED)]
                exact = self.score(docs, at, weights, a, b, slots)
                good = np.flatnonzero((exact >= floors[group[n]]) & (exact > 0))
                if len(good):
                    at_id, sizes = _spread(self.id_starts[docs[good]], self.id_starts[docs[good] + 1])
                    ids, scores = self.ids[at_id], np.repeat(exact[good], sizes)
                    order = np.lexsort((ids, -scores))[:k]
                    found.append((int(group[n]), ids[order], scores[order]))
        return found

    def _passing(self, q: np.ndarray, blocks: np.ndarray, frequent: np.ndarray, dense: np.ndarray, rare: np.ndarray, near: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number in the group, documents, their bounds): those of the passing blocks which themselves may reach the threshold; frequent: bounds of the blocks without rare terms; q is in order."""
        docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        q, frequent = np.repeat(q, BLOCK), np.repeat(frequent, BLOCK)
        bound = rare[q, docs]
        may = np.flatnonzero(((frequent + bound) * near[q] >= least[q]) & (docs < self.n))
        q, docs, bound = q[may], docs[may], bound[may]
        if len(docs) > len(dense) * len(self.matrix) * DENSE:
            bound += (dense @ self.matrix.T)[q, docs]
        else:
            for start in range(0, len(docs), AHEAD):
                part = slice(start, start + AHEAD)
                bound[part] += np.einsum("ij,ij->i", self.matrix[docs[part]], dense[q[part]])
        bound *= near[q]
        passed = np.flatnonzero((bound >= least[q] * (1 - ROUNDED)) & (bound > 0))
        q, docs, bound = q[passed], docs[passed], bound[passed]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        ends = np.append(starts[1:], len(q))
        for a, b in zip(starts, ends):
            yield int(q[a]), docs[a:b], bound[a:b]

    def score(self, docs: np.ndarray, at: np.ndarray, weights: np.ndarray, first: int, end: int, slots: np.ndarray) -> np.ndarray:
        """Scores of single documents: all terms of the query in its order, 0 for what is missing, so that the sum is the same in any shard. slots: -1 for each term, before and after."""
        own = at[first:end]
        here = np.flatnonzero(own >= 0)
        slots[own[here]] = here
        place, sizes = _spread(self.doc_starts[docs], self.doc_starts[docs + 1])
        slot = slots[self.doc_terms[place]]
        hit = np.flatnonzero(slot >= 0)
        slots[own[here]] = -1
        every = np.zeros((len(docs), end - first))
        every[np.repeat(np.arange(len(docs)), sizes)[hit], slot[hit]] = self.impacts[self.by_doc[place[hit]]]
        return (every * weights[first:end]).sum(1)


class Best:
    """The k best documents that a task has found for each query of a bundle; they raise its floors."""

    def __init__(self, queries: np.ndarray, floors: np.ndarray, k: int):
        self.queries, self.floors, self.k = queries, floors.copy(), k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, found: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        for q, ids, scores in found:
            if q in self.found:
                ids, scores = np.concatenate([self.found[q][0], ids]), np.concatenate([self.found[q][1], scores])
                order = np.lexsort((ids, -scores))[: self.k]
                ids, scores = ids[order], scores[order]
            self.found[q] = ids, scores
            if len(scores) == self.k:
                self.floors[q] = max(self.floors[q], scores[-1])

    def rows(self) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        out += [(np.full(len(ids), self.queries[q]), ids, scores) for q, (ids, scores) in self.found.items()]
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("query_id", "doc_id", "score"))})


def _by_block(numbers: np.ndarray) -> np.ndarray:
    """The largest number of each block; a column for each document."""
    most = numbers[:, ::BLOCK].copy()
    for n in range(1, BLOCK):
        np.maximum(most, numbers[:, n::BLOCK], out=most)
    return most


def _spread(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, and the length of each range."""
    n = stops - starts
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - n), n), n


def _query_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        own = [terms_of(text)[0].tobytes() for text in batch["text"]]
        yield pd.DataFrame({"_id": batch["_id"], "_terms": own, "_print": [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in own]})


def _query_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        own = [np.frombuffer(x, np.int64) for x in batch["_terms"]]
        yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(np.int64), [len(t) for t in own]), "term": np.concatenate(own) if own else np.empty(0, np.int64)})


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for shard_terms, starts, docs, copies, wanted in zip(*(batch[c] for c in ("terms", "starts", "docs", "copies", "wanted"))):
            terms, starts, copies = np.frombuffer(shard_terms, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(copies, np.int64)
            if (copies > 1).any():
                starts = np.append(0, np.cumsum(copies[np.frombuffer(docs, _kind(docs, starts[-1]))]))[starts]
            wanted = np.sort(np.asarray(wanted, np.int64))
            at = np.searchsorted(terms, wanted)
            here = at < len(terms)
            here[here] = terms[at[here]] == wanted[here]
            yield pd.DataFrame({"term": wanted[here], "n": starts[at[here] + 1] - starts[at[here]]})


def _bundle(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["query_id", "term"])
    ids, first = np.unique(rows["query_id"].to_numpy(np.int64), return_index=True)
    floors = rows["floor"].to_numpy(np.float64)[first]
    terms, one, places = np.unique(rows["term"].to_numpy(np.int64), return_index=True, return_inverse=True)
    weights = rows["weight"].to_numpy(np.float64)[one]
    return pd.DataFrame([{"queries": ids.tobytes(), "first": first.astype(np.int64).tobytes(), "floors": floors.tobytes(), "wanted": terms.tobytes(), "places": places.astype(np.int32).tobytes(), "weights": weights.tobytes()}])


def top_k(docs: DataFrame, queries: DataFrame, k=TOP, id_col="doc_id", text_col="text") -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents for each row of queries (id, whole text as its set of words).

    Ties go to the smaller id. A query without words, or whose words no document has, gets
    no rows; a query that is a document itself finds itself too. Null ids are left out.
    Of the texts of a repeated query id the smallest counts; documents of one id are found
    each for itself.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = cut(build_shards(docs, id_col, text_col, k), big_rows=True)
    with rows_at_once(spark, 2):
        stats = shards.select("lengths", "copies").mapInPandas(_lengths, "n long, total long").agg(F.count("*").alias("shards"), F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n_docs = stats.n or 0
    mean = stats.total / n_docs if n_docs else 0.0
    own = queries.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).filter("_id IS NOT NULL AND text IS NOT NULL").groupBy("_id").agg(F.min("text").alias("text"))
    # Queries with the same words have the same documents, so one of them is searched.
    worded = cut(own.mapInPandas(_query_words, "_id long, _terms binary, _print long"))
    asked_once = worded.groupBy("_print", "_terms").agg(F.min("_id").alias("query_id"))
    members = worded.join(asked_once, ["_print", "_terms"]).select("query_id", "_id")
    asked = cut(asked_once.mapInPandas(_query_terms, "query_id long, term long"))
    distinct = asked.select("term").distinct()
    sizes = asked.agg(F.count_distinct("query_id").alias("q"), F.approx_count_distinct("term").alias("t")).first()
    term_parts, bundle_parts = max(1, -(-sizes.t // TERMS)), max(1, -(-sizes.q // QUERIES))
    term_blocks = distinct.groupBy(F.pmod("term", F.lit(term_parts)).alias("_b")).agg(F.collect_list("term").alias("wanted")).drop("_b").coalesce(term_parts)
    asked_for = cut(term_blocks)
    with rows_at_once(spark, 2):
        df = cut(shards.select("terms", "starts", "docs", "copies").crossJoin(asked_for).mapInPandas(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("df")))
    weight = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = cut(asked.join(df, "term").select("query_id", "term", weight.alias("weight"), F.pmod(F.xxhash64("query_id"), F.lit(bundle_parts)).alias("_b")))

    @releasing
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[bytes, Shard] | None = None
        best: dict[bytes, Best] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                if held is None or held[0] != row["ids"]:
                    held = (row["ids"], Shard(row, mean))
                ids, first, floors, terms, places, weights = (np.frombuffer(row[c], kind) for c, kind in (("queries", np.int64), ("first", np.int64), ("floors", np.float64), ("wanted", np.int64), ("places", np.int32), ("weights", np.float64)))
                own = best.setdefault(row["queries"], Best(ids, floors, k))
                own.add(held[1].best(terms, weights[places], first, own.floors, k, places))
        for own in best.values():
            yield own.rows()

    def round_of(part: DataFrame, floors: DataFrame | None) -> DataFrame:
        """The best documents of some shards, above the floors of the queries."""
        rows = weighted.withColumn("floor", F.lit(0.0)) if floors is None else weighted.join(floors, "query_id", "left").fillna(0.0, ["floor"])
        bundles = rows.groupBy("_b").applyInPandas(_bundle, "queries binary, first binary, floors binary, wanted binary, places binary, weights binary")
        # A shard that a task has unpacked meets several bundles.
        bundles = cut(bundles.coalesce(-(-bundle_parts // AT_ONCE)), big_rows=True)
        with rows_at_once(spark, 2):
            return cut(part.crossJoin(bundles).mapInPandas(search, "query_id long, doc_id long, score double"))

    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    # Numbers of the shards by kind of document: a few bytes for each shard, which holds thousands of documents.
    kinds = shards.select(F.xxhash64("ids").alias("shard"), F.row_number().over(Window.orderBy("lead", F.xxhash64("ids"))).alias("nth"))
    step = max(1, math.isqrt(stats.shards))
    steps = [step, math.isqrt(step), 1] if step >= ROUNDS else [step, 1]
    # The number of the round in which a shard is searched: the first whose step it is at.
    rounds = cut(kinds.select("shard", F.coalesce(*(F.when(F.col("nth") % n == 0, i) for i, n in enumerate(steps))).alias("_round")))
    named = shards.withColumn("shard", F.xxhash64("ids"))
    found = floors = None
    for i, n in enumerate(steps):
        part = named.join(F.broadcast(rounds.filter(F.col("_round") == i).select("shard")), "shard", "left_semi").drop("shard")
        if n > 1:
            # Several shards in a task, so that few rows leave it.
            part = cut(part.repartition(1 + math.isqrt(stats.shards // n)), big_rows=True)
        new = round_of(part, floors)
        found = new if found is None else found.unionByName(new)
        if n > 1:
            floors = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.join(members, "query_id").select(F.col("_id").alias("query_id"), "rank", "doc_id", "score")


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        own = [(np.frombuffer(x, np.int64), np.frombuffer(n, np.int64)) for x, n in zip(batch["lengths"], batch["copies"])]
        yield pd.DataFrame({"n": [int(n.sum()) for _, n in own], "total": [int((x * n).sum()) for x, n in own]})


def op6_search(spark, sf_dir):
    """Every document whose id is divisible by 50 as a query against all documents."""
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.filter("doc_id % 50 = 0"))
