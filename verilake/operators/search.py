"""Exact cosine search by a metric index: cells around pivots, of which most can't hold a probe's nearest rows.

Pivots come from a bounded sample. Each vector lies in the cell of its nearest pivot, and a cell knows how
far, as an angle, its rows are from the pivot. By the triangle inequality a probe's angle to
a row of the cell is at least its angle to the pivot less the farthest, and at least the nearest
less it. A probe first meets one block of its own cell, which gives its floor; then the blocks of
those cells only whose bound reaches the floor. Ranks count rows ahead of a known score, so cells that lie
on one side of it whole are counted unread.

Blocks are packed matrices, each a matrix product with a block of probes. A block of the gallery goes
once to each group of probe blocks that need it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.functions.exprs import dot, norm
from verilake.functions.memory import bounded_batches, releasing

#: Vectors of a block, and decimals of a similarity, rounded once so that ties are stable.
BLOCK, PLACES = 2048, 6
#: Pivots, rows of the sample that they are fitted on, rows for which one more pivot is worth it, and rounds of the fit.
PIVOTS, SAMPLE, PER_PIVOT, ROUNDS = 256, 4096, 64, 5
#: Probe blocks in a group; each group gets the gallery's blocks once.
GROUP = 64
#: Bounds are loosened by this, far more than their rounding.
LOOSE = 1e-5


def _matrix(vectors) -> np.ndarray:
    return np.array([*vectors], np.float64).reshape(len(vectors), -1)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of each vector to each pivot (unit vectors), and the vectors' norms; a zero vector is at right angles to all."""
    norms = np.sqrt((vectors * vectors).sum(1))
    cosines = vectors @ pivots.T / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cosines, -1.0, 1.0)), norms


def _fitted(vectors: np.ndarray, n: int) -> np.ndarray:
    """n unit pivots: means of the directions nearest to them, from evenly spaced rows on."""
    norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    unit = vectors[norms[:, 0] > 0] / norms[norms[:, 0] > 0]
    if not len(unit):
        return np.eye(1, vectors.shape[1])
    pivots = unit[np.linspace(0, len(unit) - 1, min(n, len(unit))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (unit @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, unit)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        pivots = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), pivots)
    return pivots


@dataclass
class _Cells:
    """pivots, and of each cell that has rows its number, rows, parts, nearest and farthest angle, largest and smallest norm; bounded, so it goes along with tasks."""

    pivots: np.ndarray
    cells: pd.DataFrame

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest and the smallest score that a row of each cell can have with each vector."""
        c = self.cells
        angle, norms = _angles(vectors, self.pivots[c["cell"].to_numpy()])
        least = np.maximum(0.0, np.maximum(angle - c["far"].to_numpy(), c["near"].to_numpy() - angle))
        most = np.minimum(np.pi, angle + c["far"].to_numpy())
        scale = norms[:, None] * c["norm"].to_numpy()
        small = norms[:, None] * c["small"].to_numpy()
        top, low = np.cos(least), np.cos(most)
        return np.where(top > 0, top * scale, top * small) + LOOSE, np.where(low > 0, low * small, low * scale) - LOOSE

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """Place among the cells of the one nearest to each vector."""
        return _angles(vectors, self.pivots[self.cells["cell"].to_numpy()])[0].argmin(1)


def _index(gallery: DataFrame) -> tuple[_Cells, DataFrame] | None:
    """The cells of a gallery (key, vector) and its blocks (cell, part, g_keys, g_vectors); None if it is empty. It runs jobs for the count, the sample and a row for each cell."""
    bounded_batches(gallery.sparkSession)  # a packed block of probes is a row of a MB and more
    n = gallery.count()
    if not n:
        return None
    sample = gallery.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").toPandas()  # at most SAMPLE rows
    pivots = _fitted(_matrix(sample["vector"]), max(1, min(PIVOTS, n // PER_PIVOT)))

    @releasing
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                angle, norms = _angles(_matrix(batch["vector"]), pivots)
                cell = angle.argmin(1)
                yield pd.DataFrame({"key": batch["key"], "vector": batch["vector"], "cell": cell.astype(np.int32), "angle": angle[np.arange(len(cell)), cell], "size": norms})

    placed = gallery.mapInPandas(place, "key long, vector array<double>, cell int, angle double, size double")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.max("size").alias("norm"), F.min("size").alias("small")).toPandas().sort_values("cell", ignore_index=True)  # at most PIVOTS rows
    cells["parts"] = -(-cells["n"] // BLOCK)
    dealt = placed.select("key", "vector", "cell", _part("cell", dict(zip(cells["cell"], cells["parts"]))).alias("part"))
    return _Cells(pivots, cells), dealt.groupBy("cell", "part").applyInPandas(_pack_gallery, "cell int, part int, g_keys binary, g_vectors binary")


def _pack_gallery(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("key")
    return pd.DataFrame([{"cell": rows["cell"].iloc[0], "part": rows["part"].iloc[0], "g_keys": rows["key"].to_numpy(np.int64).tobytes(), "g_vectors": _matrix(rows["vector"]).tobytes()}])


#: A block of probes as packed arrays: keys, vectors, and for each its floor (or the score to be ranked), and the row that has this score (-1 for none).
_PROBES = "block long, home int, p_keys binary, p_vectors binary, p_score binary, p_own binary"


def _part(cell: str, parts: dict[int, int]):
    """One of the parts of a row's cell, by a hash of its key."""
    if not parts:
        return F.lit(0)
    return F.pmod(F.xxhash64("key"), F.try_element_at(F.create_map(*[F.lit(int(x)) for kv in parts.items() for x in kv]), F.col(cell))).cast("int")


def _probe_blocks(probes: DataFrame, cells: _Cells) -> tuple[DataFrame, int]:
    """probes (key, vector, score, own) of one home cell in blocks of about BLOCK, and the number of blocks."""

    @releasing
    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(home=cells.home(_matrix(batch["vector"])).astype(np.int32))

    placed = probes.select("key", "vector", "score", "own").mapInPandas(homes, "key long, vector array<double>, score double, own long, home int")
    parts = {r.home: -(-r["count"] // BLOCK) for r in placed.groupBy("home").count().collect()}  # at most PIVOTS rows
    most = max(parts.values(), default=1)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["own"].fillna(-1).to_numpy(np.int64)
        home, part = int(rows["home"].iloc[0]), int(rows["part"].iloc[0])
        return pd.DataFrame([{"block": home * most + part, "home": home, "p_keys": rows["key"].to_numpy(np.int64).tobytes(), "p_vectors": _matrix(rows["vector"]).tobytes(), "p_score": rows["score"].to_numpy(np.float64).tobytes(), "p_own": own.tobytes()}])

    return placed.withColumn("part", _part("home", parts)).groupBy("home", "part").applyInPandas(pack, _PROBES), sum(parts.values())


def _unpacked(row) -> tuple[np.ndarray, ...]:
    keys, own, score = np.frombuffer(row["p_keys"], np.int64), np.frombuffer(row["p_own"], np.int64), np.frombuffer(row["p_score"], np.float64)
    return keys, np.frombuffer(row["p_vectors"], np.float64).reshape(len(keys), -1), score, own


def _meetings(made: tuple[DataFrame, int], index: tuple[_Cells, DataFrame], wanted) -> DataFrame:
    """Each block of probes with each block of the gallery that wanted(cells, row of a block) asks for; it gives the cell, the part, and which probes (null: all)."""
    (blocks, n), (cells, theirs) = made, index
    groups = max(1, -(-n // GROUP))

    @releasing
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                found = [(row["block"], cell, part, mask) for cell, part, mask in wanted(cells, row)]
                if found:
                    yield pd.DataFrame(found, columns=["block", "cell", "part", "p_mask"])

    pairs = blocks.mapInPandas(ask, "block long, cell int, part int, p_mask binary")
    theirs = theirs.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    mine = pairs.join(blocks, "block").withColumn("_group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    return mine.join(theirs, ["cell", "part", "_group"])


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Keys, scores and own rows of the probes of a meeting, keys of the gallery's rows in order, and the similarities between them."""
    for batch in batches:
        for row in batch.to_dict("records"):
            keys, vectors, score, own = _unpacked(row)
            mask = slice(None) if row["p_mask"] is None else np.unpackbits(np.frombuffer(row["p_mask"], np.uint8), count=len(keys)).astype(bool)
            others = np.frombuffer(row["g_keys"], np.int64)
            theirs = np.frombuffer(row["g_vectors"], np.float64).reshape(len(others), -1)
            yield keys[mask], score[mask], own[mask], others, np.round(vectors[mask] @ theirs.T, PLACES)


def _first_block(cells: _Cells, row) -> list[tuple]:
    """One block of the home cell."""
    return [(int(cells.cells["cell"][row["home"]]), 0, None)]


def _every(cells: _Cells, row) -> list[tuple]:
    """All blocks."""
    return [(int(cell), part, None) for cell, parts in zip(cells.cells["cell"], cells.cells["parts"]) for part in range(int(parts))]


def _reaching(cells: _Cells, row) -> list[tuple]:
    """Blocks of the cells whose bound reaches the floor of some probe, and which ones."""
    _, vectors, floor, _ = _unpacked(row)
    return _masked(cells, cells.bounds(vectors)[0] >= floor[:, None])


def _undecided(cells: _Cells, row) -> list[tuple]:
    """Blocks of the cells whose rows may lie on both sides of the score of some probe, and which ones."""
    _, vectors, score, own = _unpacked(row)
    high, low = cells.bounds(vectors)
    return _masked(cells, (high >= score[:, None]) & (low <= score[:, None]) & (own >= 0)[:, None])


def _masked(cells: _Cells, meets: np.ndarray) -> list[tuple]:
    out = []
    for i in np.flatnonzero(meets.any(0)).tolist():
        mask = np.packbits(meets[:, i]).tobytes()
        out += [(int(cells.cells["cell"][i]), part, mask) for part in range(int(cells.cells["parts"][i]))]
    return out


def _vectors(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("sample_idx").alias("key"), F.col("embedding").cast("array<double>").alias("vector"), *more)


def _nearest(k: int, floor: float):
    """The k best similarities, at least the probe's score and floor, of each probe in a meeting."""

    @releasing
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, score, _, others, found in _products(batches):
            least = np.maximum(score, floor)
            n = min(k, len(others))
            if n < len(others):  # the k best and all that tie with the last of them
                least = np.maximum(least, np.partition(found, len(others) - n, axis=1)[:, len(others) - n])
            at, hit = np.nonzero(found >= least[:, None])
            value = found[at, hit]
            order = np.lexsort((others[hit], -value, at))
            at, hit, value = at[order], hit[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            keep = place < k
            yield pd.DataFrame({"probe_idx": keys[at[keep]], "sample_idx": others[hit[keep]], "similarity": value[keep]})

    return best


def products(probes: DataFrame, gallery: DataFrame, k=2) -> DataFrame:
    """n: the products (probe x row) of each meeting of blocks in a search for the k nearest; to see how far the index prunes."""
    index = _index(_vectors(gallery))
    blocks = _probe_blocks(_floors(probes, index, k, float("-inf")), index[0])

    @releasing
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, _, _, others, _ in _products(batches):
            yield pd.DataFrame({"n": [len(keys) * len(others)]})

    return _meetings(blocks, index, _reaching).mapInPandas(counted, "n long")


def top_k_search(probes: DataFrame, gallery: DataFrame, k=2, sim_threshold: float | None = None) -> DataFrame:
    """probe_idx, rank, sample_idx, similarity: the k nearest gallery rows of every probe by dot product, the cosine of unit vectors.

    One row per embedding, not per user. Ties go to the smaller sample_idx. An empty
    gallery gives nothing; with sim_threshold nearer ones only are returned.
    """
    floor = float("-inf") if sim_threshold is None else sim_threshold
    index = _index(_vectors(gallery))
    if index is None:
        return probes.sparkSession.createDataFrame([], "probe_idx long, sample_idx long, similarity double, rank int")
    return _first(_meetings(_probe_blocks(_floors(probes, index, k, floor), index[0]), index, _reaching).mapInPandas(_nearest(k, floor), _FOUND), k)


def exhaustive_search(probes: DataFrame, gallery: DataFrame, k=2) -> DataFrame:
    """As top_k_search, without bounds: every block of probes meets every block of the gallery; to check the index by."""
    index = _index(_vectors(gallery))
    if index is None:
        return probes.sparkSession.createDataFrame([], "probe_idx long, sample_idx long, similarity double, rank int")
    plain = _vectors(probes, F.lit(float("-inf")).alias("score"), F.lit(None).cast("long").alias("own"))
    return _first(_meetings(_probe_blocks(plain, index[0]), index, _every).mapInPandas(_nearest(k, float("-inf")), _FOUND), k)


_FOUND = "probe_idx long, sample_idx long, similarity double"


def _first(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("probe_idx").orderBy(F.desc("similarity"), "sample_idx"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k)


def _floors(probes: DataFrame, index: tuple[_Cells, DataFrame], k: int, floor: float) -> DataFrame:
    """key, vector, score, own: the probes with the similarity that their k nearest have at least."""
    plain = _vectors(probes, F.lit(float("-inf")).alias("score"), F.lit(None).cast("long").alias("own"))
    first = _meetings(_probe_blocks(plain, index[0]), index, _first_block).mapInPandas(_nearest(k, floor), _FOUND)
    # A probe that found fewer than k rows has no floor but the one that is asked for.
    known = first.groupBy(F.col("probe_idx").alias("key")).agg(F.when(F.count("*") >= k, F.min("similarity")).alias("_floor"))
    return plain.join(known, "key", "left").select("key", "vector", F.greatest(F.coalesce("_floor", F.lit(float("-inf"))), F.lit(floor)).alias("score"), "own")


def probe_ranks(probes: DataFrame, gallery: DataFrame) -> DataFrame:
    """probe_idx, rank: 1 + gallery rows that come before the probe's own identity (better, or as good with a smaller index); null if it has none."""
    index = _index(_vectors(gallery))
    if index is None:
        return probes.select(F.col("sample_idx").alias("probe_idx"), F.lit(None).cast("long").alias("rank"))
    first = gallery.groupBy("identity").agg(F.min("sample_idx").alias("own"))
    target = gallery.select(F.col("sample_idx").alias("own"), F.col("embedding").alias("_target"))
    mine = probes.join(first, "identity", "left").join(target, "own", "left")
    known = _vectors(mine, F.coalesce(F.round(dot(F.col("embedding"), F.col("_target")), PLACES), F.lit(0.0)).alias("score"), F.col("own").cast("long").alias("own"))
    cells = index[0]
    blocks = _probe_blocks(known, cells)
    sizes = cells.cells["n"].to_numpy(np.int64)

    @releasing
    def unread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                keys, vectors, score, own = _unpacked(row)
                before = cells.bounds(vectors)[1] > score[:, None]
                yield pd.DataFrame({"probe_idx": keys, "n": before @ sizes})[own >= 0]

    @releasing
    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, score, own, others, found in _products(batches):
            before = (found > score[:, None]) | ((found == score[:, None]) & (others[None, :] < own[:, None]))
            yield pd.DataFrame({"probe_idx": keys, "n": before.sum(1)})

    kind = "probe_idx long, n long"
    some = blocks[0].mapInPandas(unread, kind).unionByName(_meetings(blocks, index, _undecided).mapInPandas(ahead, kind))
    counts = some.groupBy("probe_idx").agg((F.sum("n") + 1).alias("rank"))
    return probes.select(F.col("sample_idx").alias("probe_idx")).join(counts, "probe_idx", "left")


def top2_margin(found: DataFrame) -> DataFrame:
    """probe_idx, top1, top1_idx and margin = top1 - top2, a missing second being 0."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    out = found.groupBy("probe_idx").agg(at(1, "similarity").alias("top1"), at(1, "sample_idx").alias("top1_idx"), at(2, "similarity").alias("top2"))
    return out.withColumn("margin", F.col("top1") - F.coalesce("top2", F.lit(0.0))).drop("top2")


def search_consistency(probes: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """n_probes, n_mismatch of two top-1 tables (probe_idx, sample_idx); a probe without a result in either is a mismatch."""
    side = lambda df, name: df.select("probe_idx", F.col("sample_idx").alias(name))
    joined = probes.select(F.col("sample_idx").alias("probe_idx")).join(side(a, "x"), "probe_idx", "left").join(side(b, "y"), "probe_idx", "left")
    return joined.agg(F.count("*").alias("n_probes"), F.count_if(~F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("n_mismatch"))


#: Identities whose sums a task holds before it gives them out.
HELD = 20_000


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of vectors by identity; rows of one identity may come in any order."""
    held: dict = {}
    for batch in batches:
        for identity, vector in zip(batch["identity"], batch["vector"]):
            own = np.asarray(vector, np.float64)
            held[identity] = held[identity] + own if identity in held else own.copy()
        if len(held) > HELD:
            yield pd.DataFrame({"identity": list(held), "vector": list(held.values())})
            held = {}
    if held:
        yield pd.DataFrame({"identity": list(held), "vector": list(held.values())})


def user_centroids(samples: DataFrame, places=PLACES) -> DataFrame:
    """identity, centroid: the mean of an identity's vectors, normalised; null for a zero mean.

    Vectors are added up in the tasks that read them, so one for each identity and task is shuffled. Rows without an identity or a vector don't count.
    """
    kind = f"identity {samples.schema['identity'].dataType.simpleString()}, vector array<double>"
    own = samples.filter("identity IS NOT NULL AND embedding IS NOT NULL").select("identity", F.col("embedding").cast("array<double>").alias("vector"))
    sums = own.mapInPandas(_sums, kind).repartition("identity").sortWithinPartitions("identity").mapInPandas(_whole_sums, kind)
    length = norm(F.col("vector"))
    return sums.select("identity", F.when(length > 0, F.transform("vector", lambda x: F.round(x / length, places))).alias("centroid"))


def _whole_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sum for each identity; rows come sorted by it."""
    last = total = None
    for batch in batches:
        done: list[tuple] = []
        for identity, vector in zip(batch["identity"], batch["vector"]):
            if total is not None and identity == last:
                total = total + vector
            else:
                if total is not None:
                    done.append((last, total))
                last, total = identity, np.asarray(vector, np.float64)
        if done:
            yield pd.DataFrame(done, columns=["identity", "vector"])
    if total is not None:
        yield pd.DataFrame([(last, total)], columns=["identity", "vector"])


def resolve_is_genuine(attempts: DataFrame, samples: DataFrame, top1: DataFrame, simple=True, high=0.45) -> DataFrame:
    """attempts (probe_idx, expected_identity, fallback) with is_genuine.

    Without an expected identity the fallback holds; an unknown one is false. Simple: the
    top-1 row belongs to it. Else: the cosine to its centroid reaches high.
    """
    known = samples.groupBy(F.col("identity").alias("expected_identity")).agg(F.lit(True).alias("_known"))
    rows = attempts.join(known, "expected_identity", "left")
    if simple:
        owner = samples.select(F.col("sample_idx").alias("top1_idx"), F.col("identity").alias("_owner"))
        hit = top1.select("probe_idx", "top1_idx").join(owner, "top1_idx")
        verdict = F.coalesce(F.col("_owner") == F.col("expected_identity"), F.lit(False))
        rows = rows.join(hit.drop("top1_idx"), "probe_idx", "left")
    else:
        centroid = user_centroids(samples).select(F.col("identity").alias("expected_identity"), "centroid")
        vectors = samples.select(F.col("sample_idx").alias("probe_idx"), "embedding")
        rows = rows.join(vectors, "probe_idx", "left").join(centroid, "expected_identity", "left")
        verdict = F.coalesce(dot(F.col("embedding"), F.col("centroid")) >= high, F.lit(False))
    genuine = F.when(F.col("expected_identity").isNull(), F.col("fallback")).when(F.col("_known").isNull(), False).otherwise(verdict)
    return rows.select("probe_idx", "expected_identity", genuine.alias("is_genuine"))
