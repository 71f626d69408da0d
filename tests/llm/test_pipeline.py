"""The pipeline: each stage against plain Python on what its predecessor kept, and the whole run."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_codecs import library
from verilake.llm import mixing, toxicity

STAGES = dict(corpus_pipeline.STAGES)


def rows_and_labels():
    """Clean and toxic prose, exact and near copies, passages that repeat, odd rows."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(320):
        words = prose(rng, rng.randint(45, 90)).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(40), rng.choice(["vilezug", "vilekrab", "vilem"]))
        rows.append((i, " ".join(words), "en", f"s{i % 5}"))
        labels.append((i, 1, int(i % 4 == 0)))
    passage = prose(rng, 60)
    rows += [(400 + i, f"{prose(rng, 20)} {passage}\n{prose(rng, 25)}", "en", "s1") for i in range(5)]
    rows += [(500, rows[1][1], "fr", "s2"), (501, rows[1][1], "en", None), (502, rows[2][1] + " one word more", "en", "s3"), (503, " ".join(rows[3][1].split()[2:]), "en", "s3")]
    rows += [(600, None, "en", "s0"), (601, "", "en", "s0"), (602, " \n", None, None), (603, prose(rng, 2), "en", "s4"), (None, prose(rng, 30), "en", "s4"), (None, None, None, None), (604, prose(rng, 6000), "en", "s4")]
    return rows + [rows[5], rows[-2]], labels


@pytest.fixture(scope="module")
def kept(spark, make, tmp_path_factory):
    """What each stage keeps, written and read again, as the pipeline does; the folder of the input tables under the name input."""
    base = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = rows_and_labels()
    docs = make(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    out, current = {"input": base, "documents": spark.read.parquet(f"{base}/documents.parquet")}, spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, base).write.parquet(f"{base}/{name}")
        current = out[name] = spark.read.parquet(f"{base}/{name}")
    return out


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffixes", "mixing", "bpe"]


def test_toxicity_stage(spark, kept):
    before, after = Counter(plain(kept["documents"])), Counter(plain(kept["toxicity"]))
    assert not after - before
    model = toxicity.learn(kept["documents"], spark.read.parquet(f"{kept['input']}/labels.parquet"))
    scores = {(r.doc_id, r.text): r.score for r in kept["documents"].select("doc_id", "text", toxicity.score_column(kept["documents"], model).alias("score")).collect()}
    assert after == Counter({r: n for r, n in before.items() if scores[r[0], r[1]] < 0.5})
    gone = {r[0] for r in before - after}
    toxic = {i for i in range(320) if i % 4 == 0}
    assert gone <= toxic and len(gone) > 0.9 * len(toxic)


def linked(texts):
    """Class of each text: links of fingerprints by two bits or fewer, and of five-word shingles alike by 0.8."""
    prints, sets = [], []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = lambda k: [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams(3)]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
        sets.append(set(grams(5)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and sets[i]
            if alike or (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_simhash_stage(kept):
    before, after = plain(kept["toxicity"]), plain(kept["simhash"])
    assert not Counter(after) - Counter(before)
    classes = defaultdict(list)
    for row, c in zip(before, linked([r[1] for r in before])):
        classes[c].append(row)
    chosen = {c: [r for r in after if r in own] for c, own in classes.items()}
    assert all(len(r) == 1 for r in chosen.values()) and len(after) == len(classes)
    for c, own in classes.items():
        assert chosen[c][0][0] == min((r[0] for r in own), key=lambda i: (i is None, i))
    assert len(before) - len(after) >= 6


def test_suffixes_stage(kept):
    before, after = plain(kept["simhash"]), plain(kept["suffixes"])
    assert len(before) == len(after)
    words = {(r[0], r[1]): (r[1] or "").split() for r in before}
    places = defaultdict(list)
    for doc, own in words.items():
        for p in range(len(own) - 49):
            places[tuple(own[p : p + 50])].append(((doc[0] is None, doc[0] or 0), p, doc))
    gone = defaultdict(set)
    for found in places.values():
        for _, p, doc in sorted(found)[1:]:
            gone[doc].update(range(p, p + 50))
    expected = Counter((doc[0], None if doc[1] is None else tuple(w for i, w in enumerate(own) if i not in gone[doc])) for doc, own in words.items())
    assert Counter((r[0], None if r[1] is None else tuple(r[1].split())) for r in after) == expected
    assert sum(map(len, gone.values())) >= 4 * 60
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in after)


def test_mixing_stage(kept):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{kept['input']}/suffixes/*.parquet'")
    cursor = con.execute(mixing.SQL)
    names = [d[0] for d in cursor.description]
    expected, empty = Counter(), set()
    for row in cursor.fetchall():
        r = dict(zip(names, row))
        if r["size"]:
            expected[r["doc_id"]] += r["taken"] // r["size"]
        else:
            empty.add(r["doc_id"])
    got = Counter(r[0] for r in plain(kept["mixing"]) if r[1] and r[1].strip())
    assert all(Counter(r[0] for r in plain(kept["mixing"]))[i] <= 2 for i in empty)  # texts without words come with their source's share
    assert +got == +expected and not Counter(plain(kept["mixing"])).keys() - Counter(plain(kept["suffixes"])).keys()


def test_bpe_stage(kept):
    """The library's ids; the text that they decode to has the same characters but for capitals and white space."""
    known = library()
    bare = lambda t: "".join((t or "").lower().split())
    expected = []
    for doc, text, _, source, _ in plain(kept["mixing"]):
        ids = known.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, source, tuple(ids), len(ids), bare(text)))
    got = [(r.doc_id, r.source, tuple(r.ids), r.n_tokens, bare(r.decoded)) for r in kept["bpe"].collect()]
    assert Counter(got) == Counter(expected)


def test_whole_run(spark, kept):
    run = Counter((r.doc_id, r.source, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, kept["input"]).collect())
    assert run == Counter((r.doc_id, r.source, tuple(r.ids), r.decoded) for r in kept["bpe"].collect())


def test_empty_tables(spark, make, tmp_path):
    make([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
