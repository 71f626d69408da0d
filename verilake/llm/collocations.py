"""Phrase collocations by prefix-free parsing.

A document's tokens are its words and a mark for each break between pieces. A window of OVERLAP tokens whose
hash is 0 modulo EVERY is a trigger. Chunks run from the start of one trigger to the end of the next,
so neighbours share OVERLAP tokens and no chunk is a prefix of another. Equal passages have equal
chunks inside; distinct chunks form the dictionary, with the number of times that the
corpus has each. An n-gram of up to OVERLAP + 1 words belongs to the chunk in which it starts
before the last OVERLAP tokens. So each is counted once, inside distinct chunks, weighted.

Pairs of words are first counted by a hash. Longer phrases are made only where all their pairs may have
LEAST occurrences, which a bitmap of fixed size tells, and of these the longest at each place only: a shorter phrase
at that place begins it, so its count is summed up from those, length by length. Phrases are counted by their words, so the
counts are exact whatever collides.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, cut, drop, releasing, table

#: Words of the longest phrase, occurrences of the rarest, phrases reported for a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Tokens that neighbouring chunks share, mean tokens between triggers, language of rows without one.
OVERLAP, EVERY, NO_LANG = LONGEST - 1, 64, "und"
#: Bits of the bitmap of frequent pairs, 16 MB; with more pairs than that it spares less work.
BITS = 1 << 27
#: Words and distinct phrases that a worker holds before it gives them out.
HELD = 500_000
#: Parts in which a language's phrases are ranked before its first ones meet.
PARTS = 64
BREAK = b"\n"
#: A-Z to a-z, tab to space, piece ends to breaks.
_FOLD = bytes(ord(BREAK) if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAKS = re.compile(rb" *\n[ \n]*")
_MIX, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of a word; of bounded size."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= HELD:
            self.clear()
        self[word] = value
        return value


_hash_of = _Hashes()


def tokens(text: str | None) -> list[bytes]:
    """Words, and BREAK where a piece ends; lower-cased."""
    folded = (text or "").encode("utf-8", "replace").translate(_FOLD)
    return [t for t in _BREAKS.sub(b" \n ", folded).split(b" ") if t]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width tokens from each place on."""
    out = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[k : len(hashes) - width + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * _ODD
    return out ^ (out >> np.uint64(29))


def chunks_of(words: list[bytes]) -> list[bytes]:
    """The chunks of a document, tokens joined by spaces; OVERLAP breaks are put after its end."""
    if not words:
        return []
    padded = words + [BREAK] * OVERLAP
    at = np.flatnonzero(_rolled(_hashes(padded), OVERLAP) % np.uint64(EVERY) == 0)
    starts = [0, *[a for a in at.tolist() if 0 < a < len(words)]]
    return [b" ".join(padded[a : b + OVERLAP]) for a, b in zip(starts, [*starts[1:], len(words)])]


@releasing
def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            counts.setdefault(lang, Counter()).update(chunks_of(tokens(text)))
        for lang, found in counts.items():
            yield pd.DataFrame({"lang": lang, "chunk": [c.decode() for c in found], "n": np.fromiter(found.values(), np.int64, len(found))})


def dictionary(docs: DataFrame, text_col="text", lang_col="lang") -> DataFrame:
    """lang, chunk, n: the distinct chunks of the documents of each language, and how often they occur in its parse."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return own.mapInPandas(_parsed, "lang string, chunk string, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


class _Numbers(dict):
    """A number for each token, from 0 on; BREAK is 0."""

    def __missing__(self, token: bytes) -> int:
        self[token] = value = len(self)
        return value


def _flat(chunks, numbers: _Numbers) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each chunk; of all chunks together the number of each token (0 is BREAK), the chunk that it is in, and whether a phrase may start at it."""
    split = [c.encode().split(b" ") for c in chunks]
    sizes = np.array([len(s) for s in split], np.int64)
    number = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
    chunk = np.repeat(np.arange(len(split)), sizes)
    inside = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return split, number, chunk, (inside < sizes[chunk] - OVERLAP) & (number > 0)


def _pair_hashes(words: np.ndarray, salts: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of each token, the next one and the language."""
    own = words[number]
    out = (own[:-1] ^ (own[:-1] >> np.uint64(29))) * _MIX + own[1:] + salts[:-1]
    out = (out ^ (out >> np.uint64(32))) * _ODD
    return out ^ (out >> np.uint64(29))


def _salts(langs: pd.Series) -> np.ndarray:
    codes, names = pd.factorize(langs)
    return np.array([xxhash.xxh3_64_intdigest(n.encode()) for n in names], np.uint64)[codes]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their n, which are whole numbers of 64 bits."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _summed, for keys that are small numbers; n in two halves, as bincount adds up doubles."""
    low, high = (np.bincount(keys, part).astype(np.int64) for part in (n & 0xFFFFFF, n >> 24))
    found = np.flatnonzero(np.bincount(keys))
    return found, low[found] + (high[found] << 24)


@releasing
def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (lang, word) and of hashes of pairs (pair)."""
    for batch in batches:
        numbers = _Numbers({BREAK: 0})
        _, number, chunk, starts = _flat(batch["chunk"], numbers)
        names = list(numbers)
        weights, salts = batch["n"].to_numpy(np.int64), _salts(batch["lang"])
        codes, langs = pd.factorize(batch["lang"])
        at = np.flatnonzero(starts)
        keys, sums = _totals(number[at] * len(langs) + codes[chunk[at]], weights[chunk[at]])
        yield pd.DataFrame({"lang": np.asarray(langs, object)[keys % len(langs)], "word": [names[k].decode() for k in (keys // len(langs)).tolist()], "pair": pd.array([None] * len(keys), "Int64"), "n": sums})
        pairs = np.flatnonzero(starts[:-1] & (number[1:] > 0))
        hashes = _pair_hashes(_hashes(names), salts[chunk], number)[pairs]
        keys, sums = _summed(hashes, weights[chunk[pairs]])
        yield pd.DataFrame({"lang": None, "word": None, "pair": keys.view(np.int64), "n": sums})


def _merged(number: np.ndarray, reach: np.ndarray, at: np.ndarray, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct phrase (of a language, the words from at on that reach counts), and the sum of its n.

    Places are brought together by a hash and compared by their words, so a collision may leave a phrase in several parts, never two in one.
    """
    words = np.stack([np.where(reach[at] > k, number[np.minimum(at + k, len(number) - 1)], 0) for k in range(LONGEST)] + [codes])
    key = np.zeros(len(at), np.uint64)
    for row in words:
        key = (key ^ (key >> np.uint64(29))) * _MIX + row.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    words = words[:, order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(at), 1), bool), (words[:, 1:] != words[:, :-1]).any(0)]))
    return at[order][begins], np.add.reduceat(n[order], begins) if len(begins) else n[:0]


def _longest(bitmap):
    """Counts of the longest phrase at each place, of 2 to LONGEST words, all of whose pairs are in the bitmap."""

    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        held: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            numbers = _Numbers({BREAK: 0})
            split, number, chunk, starts = _flat(batch["chunk"], numbers)
            weights, langs = batch["n"].to_numpy(np.int64), batch["lang"].tolist()
            place = _pair_hashes(_hashes(list(numbers)), _salts(batch["lang"])[chunk], number) % np.uint64(BITS)
            frequent = np.append((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (number[1:] > 0) & (number[:-1] > 0) & (chunk[1:] == chunk[:-1]), False)
            reach = np.ones(len(number), np.int64)  # words of the longest phrase from each token on
            for k in range(1, LONGEST):
                more = reach[: len(reach) - k] == k
                reach[: len(reach) - k][more & frequent[k - 1 : len(frequent) - 1]] += 1
            first = np.searchsorted(chunk, np.arange(len(split)))
            at = np.flatnonzero(starts & (reach > 1))
            at, sums = _merged(number, reach, at, pd.factorize(batch["lang"])[0][chunk[at]], weights[chunk[at]])
            for i, c, longest, n in zip((at - first[chunk[at]]).tolist(), chunk[at].tolist(), reach[at].tolist(), sums.tolist()):
                key = langs[c], b" ".join(split[c][i : i + longest])
                held[key] = held.get(key, 0) + n
            if len(held) > HELD:
                yield _given(held)
                held = {}
        if held:
            yield _given(held)

    return run


def _given(held: dict) -> pd.DataFrame:
    return pd.DataFrame({"lang": [lang for lang, _ in held], "phrase": [p.decode() for _, p in held], "words": np.fromiter((p.count(b" ") + 1 for _, p in held), np.int32, len(held)), "n": np.fromiter(held.values(), np.int64, len(held))})


def _bitmap(pairs: DataFrame) -> bytes:
    """Bits of the hashes in the column pair, at most BITS; Spark makes them in parts of 4 KB."""
    place = F.col("pair").bitwiseAND(BITS - 1) + 1  # Spark numbers bits from 1
    parts = pairs.select(place.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for part in parts.toLocalIterator():  # at most BITS / 8 bytes in all
        own = np.frombuffer(part.bits, np.uint8)
        begin = (part.k - 1) * len(own)
        out[begin : begin + len(own)] = own
    return out.tobytes()


def _all_lengths(longest: DataFrame) -> list[DataFrame]:
    """(lang, phrase, words, n) of each length from LONGEST down to 2, from the counts of the longest phrase at each place: a phrase occurs where it is the longest, and where one with a word more begins with it."""
    counted: list[DataFrame] = []
    for k in range(LONGEST, 1, -1):
        rows = longest.filter(F.col("words") == k).select("lang", "phrase", "n")
        if counted:
            rows = rows.unionByName(counted[-1].select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "n"))
        counted.append(cut(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).select("lang", "phrase", F.lit(k).alias("words"), "n")))
    return counted


def phrase_counts(docs: DataFrame, text_col="text", lang_col="lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of the words and phrases of up to LONGEST words that occur LEAST times or more in a language, and (lang, total) of all words."""
    spark = docs.sparkSession
    chunks = cut(dictionary(docs, text_col, lang_col))
    counted = chunks.mapInPandas(_counted, "lang string, word string, pair long, n long")
    sums = cut(counted.groupBy("lang", "word", "pair").agg(F.sum("n").alias("n")))
    words = sums.filter("word IS NOT NULL")
    bitmap = spark.sparkContext.broadcast(_bitmap(sums.filter((F.col("n") >= LEAST) & F.col("pair").isNotNull())))
    longest = cut(chunks.mapInPandas(_longest(bitmap), "lang string, phrase string, words int, n long"))
    frequent = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    lengths = _all_lengths(longest)
    for own in lengths:
        frequent = frequent.unionByName(own)
    frequent = cut(frequent.filter(F.col("n") >= LEAST))
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("total")))
    drop(chunks, sums, longest, *lengths)
    bitmap.destroy()
    return frequent, totals


def collocations(docs: DataFrame, text_col="text", lang_col="lang", top=TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first top phrases of each language.

    a is the number of occurrences, l and r those of the parts at the cut with the lowest score, which
    is 1000 * a * n / (l * r), rounded down; n is the number of words of the language. Phrases
    with a longer one around them that is as frequent are left out. Rows without a language are
    one more language; null and empty texts have no words; repeated rows count as often as they
    are there; an empty table gives no rows.
    """
    frequent, totals = phrase_counts(docs, text_col, lang_col)
    found = frequent.filter("words > 1")
    # A phrase inside a longer one that is as frequent lies in one with a word more, too, that is as frequent.
    longer = found.filter("words > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"), "n")
    around = longer.groupBy("lang", "phrase").agg(F.max("n").alias("_around"))
    kept = found.join(around, ["lang", "phrase"], "left").filter("_around IS NULL OR _around < n")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"_first": F.expr("substring_index(phrase, ' ', k)"), "_rest": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda name, c: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(c))
    scored = cuts.join(part("_first", "l"), ["lang", "_first"]).join(part("_rest", "r"), ["lang", "_rest"]).join(totals.withColumnRenamed("total", "n"), "lang")
    # 36 digits hold 1000 * a * n; the quotient fits 64 bits, as it is at most 1000 * n / LEAST.
    scored = scored.withColumn("score", F.expr("(cast(a AS decimal(14,0)) * cast(n AS decimal(16,0)) * cast(1000 AS decimal(4,0))) div (cast(l AS decimal(14,0)) * cast(r AS decimal(14,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("_nth", place("_part")).filter(F.col("_nth") <= top)
    ranked = first.withColumn("rank", place()).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    """The first phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz '), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) AS piece
    FROM documents),
worded AS (SELECT lang, list_filter(string_split(piece, ' '), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
grams AS (SELECT lang, w, i, unnest(range(1, 6)) AS k FROM starts),
counted AS (
    SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k AS words, count(*) AS f FROM grams WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
often AS (SELECT * FROM counted WHERE f >= 100),
split AS (SELECT lang, phrase, words, f, string_split(phrase, ' ') AS w FROM often WHERE words > 1),
inner_phrases AS (
    SELECT DISTINCT s.lang, array_to_string(s.w[p : p + m - 1], ' ') AS phrase, s.f
    FROM split AS s, range(1, 5) AS a(p), range(2, 5) AS b(m) WHERE m < s.words AND p + m - 1 <= s.words),
candidates AS (
    SELECT * FROM split AS c WHERE NOT EXISTS (SELECT 1 FROM inner_phrases AS i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, t.n,
        ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM candidates AS c, range(1, 5) AS q(k), often AS l, often AS r, totals AS t
    WHERE k < c.words AND l.lang = c.lang AND r.lang = c.lang AND t.lang = c.lang
        AND l.phrase = array_to_string(c.w[1:k], ' ') AND r.phrase = array_to_string(c.w[k + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
