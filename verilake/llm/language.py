"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (1 to 3 characters, words padded with a
boundary) of a language, counted over all training rows. A document's own list is
compared with each profile by the out-of-place distance: the sum of the differences in
rank, with a fixed penalty for n-grams that the profile lacks. The nearest profile wins;
ties go to the smaller language code.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, held_out, table

#: N-grams of a profile, and the penalty for one that is missing.
TOP = 300
#: Bits of one character in a packed n-gram; 0 stands for no character, 1 for a word boundary.
BITS = 18
#: The largest alphabet whose n-grams are counted in one array, and the largest that packs into 32 bits.
DENSE, SMALL = 160, 1280
#: Letters of a text that are counted at once.
PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> 1 + code point for letters, else 1, the boundary."""
    points = np.ones(0x110000, np.uint32)
    for p in range(1 << BITS):
        if chr(p).isalpha():
            points[p] = p + 1
    return points


def letters(text: str) -> np.ndarray:
    """Letters of a text in lower case, with one boundary between words and at both ends; empty if there are none."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[points]
    codes = np.concatenate([[1], codes, [1]]).astype(np.uint32)
    keep = codes != 1
    keep[1:] |= codes[:-1] != 1
    codes = codes[keep]
    return np.concatenate([[1], codes]).astype(np.uint32) if len(codes) else codes


def _without(grams: np.ndarray, parted: np.ndarray, width: int) -> np.ndarray:
    """grams but for those, width characters long, that reach over one of the places parted."""
    hit = (parted[:, None] - np.arange(width)).ravel()
    return np.delete(grams, hit[(hit >= 0) & (hit < len(grams))])


def _grams(codes: np.ndarray, base: int, dtype, starts: int | None) -> np.ndarray:
    """Packed 1-, 2- and 3-grams, over an alphabet below base, that begin at the first starts places; shorter ones begin with zeros.

    The code 0 parts texts, and no n-gram reaches over it.
    """
    c = codes.astype(dtype)
    pairs = c[:-1] * dtype(base) + c[1:]
    triples = pairs[:-1] * dtype(base) + c[2:]
    single, pairs, triples = c[:starts], pairs[:starts], triples[:starts]
    parted = np.flatnonzero(c == 0)
    if len(parted):
        pairs, triples = _without(pairs, parted, 2), _without(triples, parted, 3)
    return np.concatenate([single[single > 1], pairs, triples])


def count_grams(codes: np.ndarray, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams, in order, and how often each occurs; with starts only those that begin at the first so many places."""
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(1 << BITS, bool)
    seen[codes] = True
    seen[:2] = True
    alphabet = np.flatnonzero(seen)
    base = len(alphabet)
    dense = np.zeros(1 << BITS, np.int32)
    dense[alphabet] = np.arange(base)
    own = dense[codes]
    if base <= DENSE and len(own) > base**3 // 4:
        counts = np.bincount(_grams(own, base, np.int32, starts), minlength=1)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        grams = np.sort(_grams(own, base, np.int32 if base <= SMALL else np.int64, starts))
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
        found, counts = grams[first].astype(np.int64), np.diff(np.concatenate([first, [len(grams)]]))
    a, b, c = found // (base * base), found // base % base, found % base
    return (alphabet[a].astype(np.int64) << 2 * BITS) | (alphabet[b].astype(np.int64) << BITS) | alphabet[c], counts


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Long texts in pieces of PIECE places and the two after them, at which no n-gram begins."""
    for at in range(0, len(codes), PIECE):
        yield codes[at : at + PIECE + 2]


def _count_by_language(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, list] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            parts = totals.setdefault(lang, [])
            codes = [x for x in map(letters, texts) if len(x)]
            apart = [x for own in codes for x in (own, np.zeros(1, np.uint32))]
            for piece in _pieces(np.concatenate(apart)) if codes else ():
                parts.append(count_grams(piece, PIECE))
            if len(parts) > 16:
                totals[lang] = [_merge(parts)]
    for lang, parts in totals.items():
        if parts:
            grams, counts = _merge(parts)
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": counts})


def learn_profiles(train: DataFrame, text_col="text", lang_col="lang", top=TOP) -> DataFrame:
    """lang, gram, rank: the top n-grams of each language over all rows; ties by the packed n-gram. Rows with a null text or language don't count."""
    bounded_batches(train.sparkSession)
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    counts = rows.mapInPandas(_count_by_language, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    return ranked.filter(F.col("rank") <= top).select("lang", "gram", "rank")


def out_of_place(codes: np.ndarray, grams: np.ndarray, ranks: np.ndarray, top: int) -> np.ndarray:
    """Mean distance, 0 to 1, of a document to each profile; ranks has a row for each of grams, which are in order, and a last row of penalties."""
    found, counts = count_grams(codes)
    order = np.argsort(-counts, kind="stable")[:top]
    own = found[order]
    at = np.searchsorted(grams, own)
    at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != own)] = len(grams)
    places = np.arange(1, len(own) + 1)[:, None]
    far = np.where(ranks[at] > top, top, np.abs(ranks[at] - places))
    return far.sum(0) / (top * len(own))


def identify(docs: DataFrame, profiles: DataFrame, id_col="doc_id", text_col="text", keep=(), top=TOP) -> DataFrame:
    """id, the columns keep, lang_pred and score of every whole text.

    lang_pred is `und` and score 0 if the text is null or has no letter, or if there is no
    profile. Else score is one minus the mean out-of-place distance. Repeated rows stay.
    The profiles, at most top rows a language, are held by the driver and sent along.
    """
    learned = profiles.toArrow().to_pandas()
    langs = sorted(learned["lang"].unique())
    grams = np.unique(learned["gram"].to_numpy(np.int64))
    ranks = np.full((len(grams) + 1, len(langs)), top + 1, np.int64)
    for i, lang in enumerate(langs):
        own = learned[learned["lang"] == lang]
        ranks[np.searchsorted(grams, own["gram"].to_numpy(np.int64)), i] = own["rank"]

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            out = []
            for t in text:
                codes = letters(t) if t and langs else ()
                if not len(codes):
                    out.append(("und", 0.0))
                    continue
                far = out_of_place(codes, grams, ranks, top)
                out.append((langs[int(far.argmin())], float(1 - far.min())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    made = F.pandas_udf(predict, "lang_pred string, score double")
    return docs.select(id_col, *keep, made(text_col).alias("f")).select(id_col, *keep, "f.*")


def op4_language(spark, sf_dir):
    """The language of every document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    profiles = learn_profiles(docs.filter("NOT held_out"))
    return identify(docs, profiles, keep=("held_out",))
