"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters of a word, one of toxic and one of ordinary documents, share
what they back off to: continuation counts over all documents, labelled or not, smooth what
a class has rarely or never seen, and give both classes the same value. A document's
evidence is the difference of its two log-likelihoods per word; a logistic curve, fitted
on labelled documents that the models haven't seen, turns it into a score.

The n-grams of all documents are counted under their own characters, in tables that grow
with the corpus. Where neither class has an n-gram more often than the discount, both
models give it the shared value times what its context leaves over, so the shared value
cancels out. Only n-grams that a class has more often need it. These come from labelled
documents, a sample of LABELS rows at most, so they and the statistics of their contexts
are few and are sent to the workers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, cut, drop, held_out, releasing, table

#: Highest order of the models.
ORDER = 6
#: Taken off each count: of the shared model, and of the classes, where what is rare says little.
DISCOUNT, CLASS_DISCOUNT = 0.75, 6.0
#: The least share of a context that goes to what lies below it.
LEAST = 1e-6
#: Evidence of a word, in nats, that only chance differences of the classes explain; the second measure leaves it out.
CHANCE = 3.0
#: Evidence of a word is rounded to so many decimals, so that it doesn't depend on its neighbours in a batch.
PLACES = 6
#: Bounds on the labelled documents for the class counts, and for the curve.
LABELS, CURVE = 400_000, 50_000
#: Distinct words that are counted or scored at once.
WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xBF58476D1CE4E5B9)
_CLASSES = ("toxic", "ordinary")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@releasing
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by word, once a document, so that no repetitive one sets the counts: in all, toxic, ordinary."""
    seen: dict[str, list[int]] = {}

    def rows() -> pd.DataFrame:
        counts = np.array([*seen.values()], np.int64).reshape(-1, 3)
        return pd.DataFrame({"word": [*seen], "every": counts[:, 0], "toxic": counts[:, 1], "ordinary": counts[:, 2]})

    for batch in batches:
        for kind, own in batch["text"].groupby(batch["toxic"].fillna(-1).astype(int)):
            counts: Counter = Counter()
            for text in own:
                counts.update(set(words(text)))
            for word, k in counts.items():
                entry = seen.get(word)
                if entry is None:
                    entry = seen[word] = [0, 0, 0]
                entry[0] += k
                if kind >= 0:
                    entry[1 if kind == 1 else 2] += k
        if len(seen) >= WORDS:
            yield rows()
            seen.clear()
    if seen:
        yield rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, every, toxic, ordinary: the documents with each word; docs: text, toxic (1, 0 or null)."""
    counted = docs.mapInPandas(_count, "word string, every long, toxic long, ordinary long")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("every", *_CLASSES)])


def n_grams(vocabulary: DataFrame) -> DataFrame:
    """gram, every, toxic, ordinary: the counts of the n-grams at which the words of a vocabulary are judged: those of ORDER characters of ^word^, and the shorter ones that begin it."""
    framed = vocabulary.select(F.concat(F.lit("^"), "word", F.lit("^")).alias("framed"), "every", *_CLASSES)
    ends = F.sequence(F.lit(2), F.length("framed"))
    grams = framed.select(F.explode(F.transform(ends, lambda end: F.col("framed").substr(F.greatest(F.lit(1), end - ORDER + 1), F.least(F.lit(ORDER), end)))).alias("gram"), "every", *_CLASSES)
    return grams.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("every", *_CLASSES)])


def continuations(judged: DataFrame) -> DataFrame:
    """gram, count: how many distinct n-grams of one more character end with each n-gram of 1 to ORDER - 1 characters that doesn't begin a word."""
    found, longer = None, judged.filter(F.length("gram") == ORDER).select("gram")
    for n in range(ORDER - 1, 0, -1):
        own = cut(longer.groupBy(F.expr("substr(gram, 2)").alias("gram")).agg(F.count("*").alias("count")))
        found = own if found is None else found.unionByName(own)
        longer = own.select("gram").unionByName(judged.filter((F.length("gram") == n) & F.col("gram").startswith("^")).select("gram"))
    return found


def _context(gram) -> F.Column:
    return F.expr(f"left({gram}, length({gram}) - 1)")


def _kept(count, discount: float) -> F.Column:
    return F.greatest(F.col(count) - discount, F.lit(0.0))


def _pandas(rows: DataFrame, order: str) -> pd.DataFrame:
    return rows.toArrow().to_pandas().sort_values(order, ignore_index=True)


def build(judged: DataFrame) -> Model:
    """The model from the n-grams at which a corpus is judged.

    An n-gram inside words of less than ORDER characters counts by its continuations; one that
    begins a word has none, so its own count is taken.
    """
    own = judged.filter("toxic > 0 OR ordinary > 0").withColumn("context", _context("gram"))
    sums = [x for c in _CLASSES for x in (F.sum(c).alias(f"total_{c}"), F.sum(_kept(c, CLASS_DISCOUNT)).alias(f"kept_{c}"))]
    contexts = _pandas(own.groupBy("context").agg(*sums).filter("kept_toxic > 0 OR kept_ordinary > 0"), "context")
    often = _pandas(own.filter((F.col("toxic") > CLASS_DISCOUNT) | (F.col("ordinary") > CLASS_DISCOUNT)).select("gram", *_CLASSES), "gram")
    # What the shared values of these n-grams need: their own endings, and all n-grams in the contexts of those.
    endings = sorted({g[i:] for g in often["gram"] for i in range(len(g))})
    spark = judged.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(c,) for c in sorted({g[:-1] for g in endings})], "context string"))
    plain = judged.select("gram", "every").withColumn("context", _context("gram")).join(wanted, "context", "left_semi").select("gram", "context", F.col("every").alias("count"))
    longer = continuations(judged).withColumn("context", _context("gram")).join(wanted, "context", "left_semi").select("gram", "context", "count")
    counts = cut(plain.unionByName(longer).withColumn("count", F.col("count") + F.when(F.length("gram") == 1, 0.01).otherwise(0.0)))
    totals = _pandas(counts.groupBy("context").agg(F.sum("count").alias("total"), F.sum(_kept("count", DISCOUNT)).alias("kept")), "context")
    needed = F.broadcast(spark.createDataFrame([(g,) for g in endings], "gram string"))
    known = _pandas(counts.join(needed, "gram", "left_semi").select("gram", "count"), "gram")
    drop(counts)
    total = {c: (t, k) for c, t, k in zip(totals["context"], totals["total"], totals["kept"])}
    count = dict(zip(known["gram"], known["count"]))
    shared: dict[str, float] = {}
    for gram in sorted(endings, key=len):
        all_, kept = total[gram[:-1]]
        if len(gram) == 1:
            shared[gram] = count[gram] / all_
        else:
            shared[gram] = max(count[gram] - DISCOUNT, 0) / all_ + max(1 - kept / all_, LEAST) * shared[gram[1:]]
    left = {}
    for c in _CLASSES:
        share = 1 - contexts[f"kept_{c}"] / contexts[f"total_{c}"].clip(lower=1)
        left[c] = dict(zip(contexts["context"], share.clip(lower=LEAST)))
    sizes = {c: dict(zip(contexts["context"], contexts[f"total_{c}"])) for c in _CLASSES}
    evidence = []
    for gram, *seen in zip(often["gram"], *(often[c] for c in _CLASSES)):
        context = gram[:-1]
        likely = [max(k - CLASS_DISCOUNT, 0) / max(sizes[c][context], 1) + left[c][context] * shared[gram] for k, c in zip(seen, _CLASSES)]
        evidence.append(math.log(likely[0]) - math.log(likely[1]))
    rest = [math.log(left["toxic"][c]) - math.log(left["ordinary"][c]) for c in contexts["context"]]
    return Model(*_sorted([*often["gram"]], evidence), *_sorted([*contexts["context"]], rest))


def _sorted(strings: list[str], values: list[float]) -> tuple[np.ndarray, np.ndarray]:
    keys = keys_of(strings)
    order = np.argsort(keys)
    return keys[order], np.array(values, np.float64)[order]


def _mixed(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) + np.uint64(1)) * _MIX


def _first_state(mixed: np.ndarray) -> np.ndarray:
    return mixed ^ (mixed >> np.uint64(29))


def _next_state(state: np.ndarray, mixed: np.ndarray, n: int) -> np.ndarray:
    """The state of n-grams from that of their last n - 1 characters and the character before these."""
    state = (state ^ (mixed + np.uint64(n))) * _TURN
    return state ^ (state >> np.uint64(31))


def keys_of(strings: list[str]) -> np.ndarray:
    """A 64-bit key of each string of 1 to ORDER characters."""
    out = np.zeros(len(strings), np.uint64)
    sizes = np.array([len(s) for s in strings], np.int64)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        codes = np.frombuffer("".join(strings[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        mixed = _mixed(codes)
        state = _first_state(mixed[:, -1])
        for k in range(2, n + 1):
            state = _next_state(state, mixed[:, -k], k)
        out[at] = state
    return out


def _layout(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ^word^word^ ... ^ and the place of each within its word, the ^ before it being 0."""
    codes = np.frombuffer(("^" + "^".join(vocabulary) + "^").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(codes == ord("^"))
    places = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    places[starts[1:]] = np.diff(starts)  # the ^ at a word's end belongs to it
    return codes, places


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, out: np.ndarray) -> None:
    """Put the values of the known keys into out."""
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[at] == wanted
        out[known] = values[at[known]]


@dataclass
class Model:
    """Evidence of the n-grams that a class has often, and of contexts for all others; in order of their keys."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    contexts: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    rest: np.ndarray = field(default_factory=lambda: np.empty(0))
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)

    def evidence(self, vocabulary: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not vocabulary:
            return np.empty(0)
        codes, places = _layout(vocabulary)
        mixed = _mixed(codes)
        state = _first_state(mixed)
        gram, context = state.copy(), np.zeros_like(state)
        for n in range(2, ORDER + 1):
            deep = places >= n - 1
            longer = np.zeros_like(state)
            longer[n - 1 :] = _next_state(state[n - 1 :], mixed[: len(mixed) - n + 1], n)
            np.copyto(context[1:], state[:-1], where=deep[1:])  # the gram of n - 1 characters before
            np.copyto(gram, longer, where=deep)
            state = longer
        value = np.zeros(len(codes))
        _look_up(self.contexts, self.rest, context, value)
        _look_up(self.keys, self.values, gram, value)
        value[0] = 0
        ends = np.flatnonzero(codes == ord("^"))
        return np.round(np.add.reduceat(value, ends[:-1] + 1), PLACES)

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Two measures of each whole text, both 0 without words.

        They are the difference of the log-likelihoods per word, and the same without the
        part of each word's difference that chance explains.
        """
        out = np.zeros((len(texts), 2))
        split: list[list[str]] = []
        fresh: set[str] = set()
        for i, text in enumerate(texts):
            split.append(words(text) if text else [])
            fresh.update(split[-1])
            if len(fresh) >= WORDS or i == len(texts) - 1:
                vocabulary = [*fresh]
                plain = self.evidence(vocabulary)
                sure = np.sign(plain) * np.maximum(np.abs(plain) - CHANCE, 0)
                number = dict(zip(vocabulary, range(len(vocabulary))))
                for j, own in enumerate(split, i + 1 - len(split)):
                    if own:
                        at = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                        out[j] = plain[at].mean(), sure[at].mean()
                fresh.clear()
                split.clear()
        return out


def on_curve(raw: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw @ np.array(curve[:2]) + curve[2], -30, 30)))


def fit_curve(raw: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Slopes and shift of the logistic curve, lightly regularised; by Newton's method."""
    if not len(raw) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return 1.0, 1.0, float(np.log(share / (1 - share)))
    x = np.column_stack([raw, np.ones(len(raw))])
    theta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (labels - p) - 1e-3 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(theta)), slope)
        theta += step * min(1, 5 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, theta))


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About most rows at the most, by a hash of the id."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> Model:
    """Learn from labels of documents with crc32(id) mod 5 of 1 to 4: class counts from 1 to 3, the curve from 4.

    The shared counts, which need no label, cover all documents. labels has the id and toxic
    (0, 1 or null; a document labelled twice counts as toxic if any label says so). Null
    texts teach nothing; a null id has no label. Rows of one id all take its label.
    """
    bounded_batches(docs.sparkSession)
    fold = F.crc32(F.col("_id").cast("string")) % 5
    corpus = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    marked = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("_id").agg(F.max("toxic").alias("toxic"))
    taught = F.broadcast(_sample(marked.filter(fold.between(1, 3)), LABELS))
    grams = cut(n_grams(vocabulary(corpus.join(taught, "_id", "left").select("text", "toxic"))))
    model = build(grams)
    drop(grams)
    sent = send(docs, model)

    @releasing
    def raw(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            yield pd.DataFrame(sent.value.raw([*text]), columns=["plain", "sure"])

    checked = corpus.filter(fold == 4).join(F.broadcast(_sample(marked.filter(fold == 4), CURVE)), "_id")
    seen = checked.select(F.pandas_udf(raw, "plain double, sure double")("text").alias("raw"), "toxic").select("raw.*", "toxic").toArrow().to_pandas()
    seen = seen.sort_values(["plain", "sure", "toxic"])  # the same sums whatever the order of the rows
    model.curve = fit_curve(seen[["plain", "sure"]].to_numpy(float), seen["toxic"].to_numpy(float))
    return model


def send(docs: DataFrame, model: Model) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(model)


def score_column(docs: DataFrame, model: Model, text_col="text") -> F.Column:
    """The score of each whole text, 0 to 1, however long; null, empty and letterless texts have no evidence and get the curve's value at 0."""
    sent = send(docs, model)

    @releasing
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series(on_curve(sent.value.raw([*text]), sent.value.curve))

    bounded_batches(docs.sparkSession)
    return F.pandas_udf(score, "double")(text_col)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", threshold=0.5) -> DataFrame:
    """The rows of docs that score below the threshold, learned from docs and labels; all columns stay as they are, whatever their names."""
    model = learn(docs, labels, id_col, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), score_column(docs, model, text_col).alias("score"))
    return rows.filter(F.col("score") < threshold).select("row.*")


def op1_toxicity(spark, sf_dir):
    """Every document scored; labels only from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
