"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius 2 of each other have a common variant within 1 of both, so
every distinct fingerprint emits itself and its 64 one-bit variants, and those that
share a variant are linked. All that share one are within 2 of each other, so a star to
the smallest gives the same components as all pairs; a variant has 65 fingerprints
around it at most. Equal fingerprints are counted as one before the shuffle.
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

from verilake.llm.common import bounded_batches, cut, drop, may_be_in, releasing, table
from verilake.llm.suffixes import clear_hashes, rolling, word_hashes

SHINGLE, SEED, BITS = 3, 42, 64
#: For similar texts: words of a shingle, least similarity, one in how many rows shows the hot shingles, and how many of these are sent to the workers.
WIDE, SIMILARITY, SHARE, HOT = 5, 0.8, 16, 200_000
#: Turns of comparing classes with the heads of their cells, different orders of these in each, and the similarity to a head from which differences from it are looked at.
TURNS, ORDERS, AROUND = 1, 3, 0.5
_WORDS = re.compile("[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14


def _signed_bits(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number; without words it is 0."""
    words = _WORDS.findall(text.translate(_LOWER)) if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [" ".join(words)]
    else:
        shingles = [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), BLOCK):
        counts += _signed_bits([digest(s.encode("utf-8", "replace"), SEED) for s in shingles[at : at + BLOCK]])
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big", signed=True)


@releasing
def _prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield pd.Series([fingerprint(t) for t in text], dtype="int64")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """_id, _print for every row; null and empty texts have fingerprint 0."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("_id"), F.pandas_udf(_prints, "long")(text_col).alias("_print"))


def ball_links(prints: DataFrame) -> DataFrame:
    """src, dst: each distinct fingerprint with the smallest one around each of its variants, where that differs."""
    # Dealt out first, in turn: each row becomes 65, and AQE has put the few bytes of the fingerprints into few tasks.
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)])
    variants = prints.select("_print", F.explode(flips).alias("_flip")).select("_print", F.col("_print").bitwiseXOR(F.col("_flip")).alias("_variant"))
    balls = variants.groupBy("_variant").agg(F.collect_list("_print").alias("_near")).filter(F.size("_near") > 1)
    pairs = balls.select(F.explode("_near").alias("src"), F.array_min("_near").alias("dst")).filter("src <> dst")
    return pairs.filter(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of an edge reaches.

    Rounds of large and small stars, as in published work on components by sorting: each
    node hands its larger neighbours, then its smaller ones, to its smallest neighbour,
    until nothing changes. A round's table has no more rows than the edges, and is written
    to the checkpoint folder. Hubs are summed up by their minimum, never listed.
    """
    links = cut(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).filter("hi <> lo").distinct())
    before = None
    # The minima are written before they are joined, so that both sides are dealt anew and AQE can split a hub.
    while True:
        state = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if before == (state.n, state.h) or not state.n:
            break
        before = (state.n, state.h)
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct())
        small_low = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(small_low, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("a"), F.col("m").alias("b")), F.struct(F.col("lo").alias("a"), F.col("m").alias("b")))).alias("e"))
        used = (links, low, large, small_low)
        links = cut(small.select(F.col("e.a").alias("hi"), F.col("e.b").alias("lo")).filter("hi <> lo").distinct())
        drop(*used)
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the smallest id of the component, of every row.

    Fingerprints link at two or fewer differing bits. Texts without words share
    fingerprint 0 and are linked like any other. Repeated rows stay. A null id gets its
    component, which is null only if all its ids are null.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("_print").agg(F.min("_id").alias("_first")))
    roots = components(ball_links(distinct.select("_print")))
    members = cut(distinct.join(roots, F.col("_print") == F.col("node"), "left").select("_print", "_first", F.coalesce("root", "_print").alias("_root")))
    smallest = cut(members.groupBy("_root").agg(F.min("_first").alias("component_id")))
    owner = cut(members.join(smallest, "_root").select("_print", "component_id"))
    return prints.join(owner, "_print").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct WIDE-word shingles; a shorter text is one shingle, and one without words has none."""
    hashes = word_hashes(text.translate(_LOWER))
    return np.unique(rolling(hashes, min(WIDE, len(hashes)))) if len(hashes) else hashes


def set_class(own: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return int.from_bytes(xxhash.xxh3_64_digest(own.tobytes()), "big", signed=True)


@releasing
def _shingle_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(text) for text in batch["text"]]
        token, n = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
        yield pd.DataFrame({"token": token.view(np.int64), "n": n})
    clear_hashes()


def rare_first(own: np.ndarray, hot: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A set in the common order of all sets: by the count of a hot shingle, 0 for others, then by the hash."""
    if not len(hot):
        return own
    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
    return own[np.argsort(np.where(hot[at] == own, often[at], 0), kind="stable")]


@releasing
def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(text) for text in batch["text"]]
        yield pd.DataFrame({"_class": [set_class(own) for own in sets], "_set": [own.tobytes() for own in sets]})
    clear_hashes()


def set_similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of distinct hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([*map(set_similarity, a, b)], dtype="float64")


def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """The hashes that are in one of two sets only."""
    return pd.Series([np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).view(np.int64) for x, y in zip(a, b)], dtype=object)


def similar_links(docs: DataFrame, id_col="doc_id", text_col="text", similarity=SIMILARITY) -> DataFrame:
    """src, dst: links of rows whose sets of five-word shingles have a similarity of 0.8 or more; src is the larger id.

    The components of the links are those of all such pairs. Rows of one set are a class and
    are linked to its smallest id. In the common order of rare_first two similar sets have
    a shingle of their prefixes in common (of a set of n the first n - ceil(0.8 n) + 1), so
    the classes of a prefix shingle are compared: first, in TURNS turns, each with a few heads,
    then each pair that isn't in one component yet. The lengths, and what can follow the places of
    the shingle, rule pairs out without loss; the rest is judged by the full sets. The hot
    shingles come from a share of the rows, which changes the cost, not the result.

    Near copies of one text share nearly all shingles, so these tell little about their pairs. What tells is how
    they differ from one head: sets of n and m hashes that differ from it by d and e hashes differ from each other by
    d + e - 2 k, k of these in common, and are similar only if that is at most (n + m) / 9. So where two classes have one head,
    a shingle by which both differ from it must bring them together, the rare ones first. Pairs that need none
    in common (d + e <= (n + m) / 9) are both similar to the head, and linked by it.

    A shingle of the prefixes is looked at further only if several classes have it; a
    class's entries are narrow rows, written once. Before the full sets are fetched, the
    shingles that two prefixes have in common are counted: beyond its prefix a set has
    0.8 n - 1 more at most, so similar sets share nearly half of their prefixes.

    Rows with a null id, and texts without words, have no links; of repeated ids all texts
    count.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).filter("_id IS NOT NULL AND text IS NOT NULL")
    some = own.filter(F.pmod(F.xxhash64("_id"), F.lit(SHARE)) == 0).mapInPandas(_shingle_counts, "token long, n long")
    hot = some.groupBy("token").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "token").limit(HOT).toArrow().to_pandas()
    token, often = hot["token"].to_numpy(np.int64).view(np.uint64), hot["n"].to_numpy(np.int64)
    by = np.argsort(token)
    sent = spark.sparkContext.broadcast((token[by], often[by]))

    @releasing
    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, tokens = [], []
            for i, text in zip(batch["_id"], batch["text"]):
                own = shingle_set(text)
                n = len(own)
                if n:
                    tokens.append(rare_first(own, *sent.value)[: n - math.ceil(similarity * n - 1e-9) + 1])
                    rows.append((i, set_class(own), n, len(tokens[-1])))
            if rows:
                ids, classes, n, k = (np.array(x, np.int64) for x in zip(*rows))
                at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                yield pd.DataFrame({"_id": np.repeat(ids, k), "_class": np.repeat(classes, k), "_n": np.repeat(n, k).astype(np.int32), "_at": at.astype(np.int32), "_token": np.concatenate(tokens).view(np.int64)})
        clear_hashes()

    entries = cut(own.mapInPandas(prefixes, "_id long, _class long, _n int, _at int, _token long"))
    ids = entries.filter("_at = 0").select("_id", "_class")
    names = cut(ids.groupBy("_class").agg(F.min("_id").alias("_first")))
    same = ids.join(names, "_class").filter("_id <> _first").select(F.col("_id").alias("src"), F.col("_first").alias("dst")).distinct()

    # Most shingles of the prefixes are in one class only; what is left of them is written before the join, so that a hot one can be split.
    shared = cut(entries.groupBy("_token").agg(F.min("_class").alias("_least"), F.max("_class").alias("_last")).filter("_least <> _last").select("_token"))
    cells = cut(entries.drop("_id").join(shared, "_token").distinct())
    drop(shared)
    # A class's shingles as one row, so that a pair of classes is one row as well and not one for each shingle that they share.
    shared_by = cut(cells.groupBy("_class").agg(F.first("_n").alias("_n"), F.collect_set("_token").alias("_tokens")))
    # How much a class shares: in a group of copies of one text, those that changed least share most, and most are similar to them.
    size = cut(cells.groupBy("_token").agg(F.count("*").alias("_k")))
    central = cut(cells.select("_class", "_token").join(size, "_token").groupBy("_class").agg(F.floor(8 * F.log2(F.sum("_k"))).alias("_level")))

    def side(rows: DataFrame, i: int) -> DataFrame:
        return rows.select("_token", *[F.col(c).alias(f"{c}{i}") for c in rows.columns if c != "_token"])

    n, m, least = F.col("_n1"), F.col("_n2"), similarity / (1 + similarity)
    fits = (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (F.least(n - F.col("_at1"), m - F.col("_at2")) >= least * (n + m) - 1e-9)

    def full_sets(classes: DataFrame) -> DataFrame:
        """_class, _set of the classes in the column _class."""
        wanted = cut(classes.distinct().join(names, "_class"))
        rows = may_be_in(own.withColumn("_key", F.xxhash64("_id")), "_key", wanted.select(F.xxhash64("_first").alias("_key")), "_maybe")
        found = rows.filter("_maybe").select("text").mapInPandas(_sets, "_class long, _set binary")
        return cut(found.join(wanted, "_class", "left_semi").dropDuplicates(["_class"]))

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs of classes (a, b) that are similar by their full sets."""
        pairs = cut(pairs.distinct())
        end = lambda name: shared_by.select(F.col("_class").alias(name), F.col("_n").alias(f"n_{name}"), F.col("_tokens").alias(f"t_{name}"))
        common = pairs.join(end("a"), "a").join(end("b"), "b").withColumn("k", F.size(F.array_intersect("t_a", "t_b")))
        beyond = lambda c: F.ceil(similarity * F.col(c) - 1e-9) - 1
        pairs = cut(common.filter(F.col("k") + F.greatest(beyond("n_a"), beyond("n_b")) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9).select("a", "b"))
        sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("_class")))
        both = pairs.join(sets.select(F.col("_class").alias("a"), F.col("_set").alias("_x")), "a").join(sets.select(F.col("_class").alias("b"), F.col("_set").alias("_y")), "b")
        made = cut(both.withColumn("_s", F.pandas_udf(_similar, "double")("_x", "_y")).filter(F.col("_s") >= similarity).select("a", "b"))
        drop(sets)
        return made

    def at_heads(rows: DataFrame, turn: int) -> DataFrame:
        """Each class with the head of its cells: one of those that share most, by a hash; cells have a few different orders, so that one class has several heads."""
        order = F.struct(-F.col("_level"), F.xxhash64("_class", F.pmod("_token", F.lit(ORDERS)), F.lit(turn)))
        heads = cut(rows.groupBy("_token").agg(F.min(F.struct(order.alias("o"), *[F.col(c) for c in rows.columns if c != "_token"])).alias("_h")))
        heads = heads.select("_token", *[F.col(f"_h.{c}").alias(f"{c}1") for c in rows.columns if c != "_token"])
        return heads.join(side(rows, 2), "_token").filter((F.col("_class1") != F.col("_class2")) & (F.col("_root1") != F.col("_root2")) & fits)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("_class1", "_class2").alias("a"), F.greatest("_class1", "_class2").alias("b"))

    def apart(rows: DataFrame) -> DataFrame:
        """_class, _n, its head (of all its cells the class that shares most), their similarity _s, and the hashes by which they differ; only where that is worth it.

        It is where the head has a quarter of the class's prefix and the similarity is AROUND or more. Other classes have no head.
        """
        first = cut(rows.groupBy("_token").agg(F.min(F.struct((-F.col("_level")).alias("o"), F.col("_class").alias("head"))).alias("_h")))
        headed = rows.select("_token", "_class", "_n").join(first, "_token").groupBy("_class").agg(F.first("_n").alias("_n"), F.min("_h").alias("_h")).select("_class", "_n", F.col("_h.head").alias("_head"))
        end = lambda name, i: shared_by.select(F.col("_class").alias(name), F.col("_n").alias(f"n{i}"), F.col("_tokens").alias(f"t{i}"))
        near = headed.join(end("_class", 1), "_class").join(end("_head", 2), "_head").filter(F.least("n1", "n2") >= AROUND * F.greatest("n1", "n2"))
        headed = cut(near.filter(4 * F.size(F.array_intersect("t1", "t2")) >= (1 - similarity) * F.col("n1")).select("_class", "_n", "_head"))
        sets = full_sets(headed.select("_class").union(headed.select("_head")))
        both = headed.join(sets.withColumnRenamed("_set", "_x"), "_class").join(sets.select(F.col("_class").alias("_head"), F.col("_set").alias("_y")), "_head")
        both = both.withColumn("_apart", F.pandas_udf(_apart, "array<long>")("_x", "_y")).withColumn("_sum", F.col("_n") + F.length("_y") / 8)
        made = cut(both.withColumn("_s", (F.col("_sum") - F.size("_apart")) / (F.col("_sum") + F.size("_apart"))).filter(F.col("_s") >= min(AROUND, similarity)).select("_class", "_n", "_head", "_s", "_apart"))
        drop(sets)
        return made

    def of_one_head(differing: DataFrame) -> DataFrame:
        """Pairs of classes of one head that aren't in one component and may be similar by their differences from it."""
        tokens = differing.select("_class", "_n", "_root", "_head", F.size("_apart").alias("_d"), F.explode("_apart").alias("_token"))
        often = cut(tokens.groupBy("_head", "_token").agg(F.count("*").alias("_k"), F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).filter("_k > 1"))
        tokens = tokens.join(often, ["_head", "_token"])
        # The differences from this one on, in the order of their counts: as many can be in common at most if this is the first one.
        tokens = tokens.withColumn("_left", F.row_number().over(Window.partitionBy("_class").orderBy(F.desc("_k"), F.desc("_token"))))
        tokens = cut(tokens.filter("_lo <> _hi").select("_head", "_token", "_class", "_n", "_root", "_d", "_left"))
        end = lambda i: tokens.select("_head", "_token", *[F.col(c).alias(f"{c}{i}") for c in ("_class", "_n", "_root", "_d", "_left")])
        common = (F.col("_d1") + F.col("_d2") - (1 - similarity) / (1 + similarity) * (n + m)) / 2
        return end(1).join(end(2), ["_head", "_token"]).filter((F.col("_class1") < F.col("_class2")) & (F.col("_root1") != F.col("_root2")) & (F.least("_left1", "_left2") >= common - 1e-9))

    def placed(rows: DataFrame, links: DataFrame) -> DataFrame:
        """rows with the component _root that each class is in by the links."""
        roots = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        return rows.join(roots, F.col("_class") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_class")).drop("node", "root")

    def mixed(rows: DataFrame) -> DataFrame:
        """Of rows with _root, the cells whose classes aren't all in one component; only these have pairs left."""
        found = rows.groupBy("_token").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).filter("_lo <> _hi").select("_token")
        return cut(rows.join(found, "_token", "left_semi"))

    linked, rest = None, cells.withColumn("_root", F.col("_class")).join(central, "_class")
    for turn in range(TURNS):
        more = alike(ordered(at_heads(rest, turn)))
        linked = more if linked is None else linked.unionByName(more)
        rest = mixed(placed(cells, linked)).join(central, "_class")
    differing = apart(rest)
    to_head = differing.filter((F.col("_s") >= similarity) & (F.col("_class") != F.col("_head")))
    linked = linked.unionByName(to_head.select(F.least("_class", "_head").alias("a"), F.greatest("_class", "_head").alias("b")))
    where = cut(placed(cells.select("_class").distinct(), linked))
    rest = mixed(cells.join(where, "_class")).join(differing.select("_class", "_head"), "_class", "left")
    others = side(rest, 1).join(side(rest, 2), "_token").filter((F.col("_class1") < F.col("_class2")) & (F.col("_root1") != F.col("_root2")) & fits & ~F.coalesce(F.col("_head1") == F.col("_head2"), F.lit(False)))
    linked = linked.unionByName(alike(ordered(others).unionByName(ordered(of_one_head(differing.join(where, "_class"))))))

    named = linked.join(names.select(F.col("_class").alias("a"), F.col("_first").alias("x")), "a").join(names.select(F.col("_class").alias("b"), F.col("_first").alias("y")), "b")
    return same.unionByName(named.select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst")).filter("src <> dst").distinct())


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", similarity: float | None = SIMILARITY) -> DataFrame:
    """One row of docs for each group: that of the smallest id, null ids last; of equal ids that of the smallest hash of id and text.

    Groups are the components of all links: of close fingerprints, as in near_duplicates, and,
    unless similarity is None, of similar texts. Rows are told apart by id and text, so
    texts of one id, or without an id, go only where their own text has a kept copy. All
    columns stay as they are, whatever their names.
    """
    rows = docs.select(F.struct(*docs.columns).alias("all"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("_row"))
    order = F.struct(F.col("id").isNull().alias("late"), "id", F.col("_row").alias("row"))
    prints = cut(fingerprints(rows.select("text", order.alias("_order")), "_order", "text"))
    near = components(ball_links(prints.select("_print").distinct()))
    placed = cut(prints.join(near, F.col("_print") == F.col("node"), "left").select(F.col("_id").alias("_order"), F.coalesce("root", "_print").alias("_group")))
    if similarity is not None:
        # Links between rows become links between the groups that these have by their fingerprints.
        group = lambda name, to: placed.select(F.col("_order.row").alias(name), F.col("_group").alias(to)).distinct()
        edges = similar_links(rows, "_row", "text", similarity).join(group("src", "a"), "src").join(group("dst", "b"), "dst")
        wider = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).filter("src <> dst").distinct())
        placed = cut(placed.join(wider, F.col("_group") == F.col("node"), "left").select("_order", F.coalesce("root", "_group").alias("_group")))
    first = cut(placed.groupBy("_group").agg(F.min("_order").alias("_first")))
    lost = placed.join(first, "_group").filter(F.col("_order") != F.col("_first")).select(F.col("_order.row").alias("_row")).distinct()
    repeated = placed.groupBy(F.col("_order.row").alias("_row")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_row")
    # Few rows are lost or repeated; only those that may be among them are shuffled with their texts.
    marked = cut(lost.withColumn("_lost", F.lit(True)).unionByName(repeated.withColumn("_lost", F.lit(False))).groupBy("_row").agg(F.max("_lost").alias("_lost")))
    asked = may_be_in(rows.select("all", "_row"), "_row", marked.select("_row"), "_maybe")
    sure = asked.filter("NOT _maybe").select("all", "_row")
    judged = asked.filter("_maybe").select("all", "_row").join(marked, "_row", "left")
    once = judged.filter("NOT _lost").dropDuplicates(["_row"])
    return sure.unionByName(judged.filter("_lost IS NULL").select("all", "_row")).unionByName(once.select("all", "_row")).select("all.*")


def op10_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
