"""Toxicity and language: held-out accuracy and odd inputs."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tests.llm.conftest import prose
from verilake.llm import language, toxicity


def corpus(n=700):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(rng, 60).split()
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["vilezug", "vilekrab", "vilem"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def scored(docs, model):
    return {r.doc_id: r.score for r in docs.select("doc_id", toxicity.score_column(docs, model).alias("score")).collect()}


def test_toxicity(spark, make):
    rows, labels = corpus()
    odd = [(9001, None), (9002, ""), (9003, "!!! 123"), (None, "vilezug vilekrab"), (9004, "vilezug " * 30000), (0, rows[0][1])]
    docs = make(rows + odd)
    marks = spark.createDataFrame(labels + [(9001, 1, 1), (None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    got = docs.select("doc_id", toxicity.score_column(docs, model).alias("score")).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    bad, good = [score[i] for i in held if i % 4 == 0], [score[i] for i in held if i % 4]
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    assert score[9001] == score[9002] == score[9003] and score[9004] > 0.5
    kept = toxicity.reject_toxic(docs, marks)
    want = sorted((r.doc_id or -1, r.score < 0.5) for r in got)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [i for i, fine in want if fine] and kept.first().score == 0.5


def test_toxicity_does_not_depend_on_partitions_or_batches(spark, make, monkeypatch):
    rows, labels = corpus(200)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = scored(make(rows), toxicity.learn(make(rows), marks))
    dealt = make(rows).repartition(7)
    monkeypatch.setattr(toxicity, "WORDS", 20)
    assert scored(dealt, toxicity.learn(dealt, marks)) == one


def kneser_ney(known):
    """Evidence of each word by plain dictionaries; known: word -> (every, toxic, ordinary)."""
    top = toxicity.ORDER
    grams = {n: defaultdict(lambda: [0, 0, 0]) for n in range(2, top + 1)}
    for word, counts in known.items():
        framed = f"^{word}^"
        for end in range(2, len(framed) + 1):
            for n in range(2, min(top, end) + 1):
                for k in range(3):
                    grams[n][framed[end - n : end]][k] += counts[k]
    single = Counter(g[1:] for g in grams[2])
    total = sum(c + 0.01 for c in single.values())

    def count(g):
        longer = sum(1 for x in grams[len(g) + 1] if x[1:] == g) if len(g) < top else 0
        return longer if longer and g[0] != "^" else grams[len(g)][g][0]

    def mix(g, of, discount, below):
        others = [of(x) for x in grams[len(g)] if x[:-1] == g[:-1]]
        if not sum(others):
            return below
        kept = sum(max(c - discount, 0) for c in others)
        return max(of(g) - discount, 0) / sum(others) + max(1 - kept / sum(others), toxicity.LEAST) * below

    def shared(g):
        if len(g) == 1:
            return (single[g] + 0.01) / total
        return mix(g, count, toxicity.DISCOUNT, shared(g[1:]))

    out = {}
    for word in known:
        framed, evidence = f"^{word}^", 0.0
        for end in range(2, len(framed) + 1):
            g = framed[max(0, end - top) : end]
            p, q = (mix(g, lambda x, k=k: grams[len(x)][x][k], toxicity.CLASS_DISCOUNT, shared(g)) for k in (1, 2))
            evidence += math.log(p) - math.log(q)
        out[word] = evidence
    return out


def test_evidence_against_brute_force(spark, rng):
    known = {w: (k, min(k, rng.randint(0, 20)), rng.randint(0, 30)) for w in set(prose(rng, 60, "aeinst").split()) | {"a", "supercalifragilistic"} for k in [rng.randint(1, 60)]}
    table = spark.createDataFrame([(w, *c) for w, c in known.items()], "word string, every long, toxic long, ordinary long")
    model = toxicity.build(toxicity.n_grams(table))
    want = kneser_ney(known)
    got = dict(zip(want, model.evidence([*want])))
    assert all(abs(got[w] - want[w]) < 1e-5 for w in want) and max(abs(e) for e in want.values()) > 1


def test_continuations(spark):
    known = ["one", "once", "bone", "no"]
    table = spark.createDataFrame([(w, 1, 0, 0) for w in known], "word string, every long, toxic long, ordinary long")
    grams = {n: {f"^{w}^"[i : i + n] for w in known for i in range(len(w) + 3 - n)} for n in range(2, toxicity.ORDER + 1)}
    want = Counter(g[1:] for n in grams for g in grams[n])
    assert {r.gram: r["count"] for r in toxicity.continuations(toxicity.n_grams(table)).collect()} == want


def test_vocabulary_counts_every_document(spark):
    rows = [(f"same word{'abcdefghij'[i % 10]} same", (None, 0, 1)[i % 3]) for i in range(40)]
    got = {r.word: (r.every, r.toxic, r.ordinary) for r in toxicity.vocabulary(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    assert got["same"] == (40, 13, 13) and got["worda"] == (4, 1, 1)


def test_toxicity_without_labels(spark, make):
    docs = make([(1, "some words here"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = scored(docs, toxicity.learn(docs, none))
    assert len(set(scores.values())) == 1 and all(0 <= x <= 1 for x in scores.values())
    empty = docs.limit(0)
    assert scored(empty, toxicity.learn(empty, none)) == {}


def test_language(spark, make, rng):
    rows = [(i, prose(rng, 40, "etaoin"), "aa") for i in range(40)] + [(100 + i, prose(rng, 40, "zuvxyk"), "bb") for i in range(40)]
    docs = make(rows)
    profiles = language.learn_profiles(docs)
    odd = make([(900, None), (901, "12 !!"), (902, ""), (903, "zuvx " * 200000), (904, "日本"), (None, "etaoin")])
    got = {r.doc_id: r for r in language.identify(docs.unionByName(odd), profiles).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred == "bb" and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language.identify(docs, language.learn_profiles(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def profile_of(texts, top):
    """The most frequent n-grams of texts by plain counting, packed, with their counts' order."""
    counts = Counter()
    for text in texts:
        own = language.letters(text).tolist()
        for n in (1, 2, 3):
            for i in range(len(own) - n + 1):
                if own[i : i + n] != [1]:
                    counts[sum(c << language.BITS * (n - 1 - k) for k, c in enumerate(own[i : i + n]))] += 1
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:top]


def test_profiles_and_distance_against_brute_force(make, rng, monkeypatch):
    monkeypatch.setattr(language, "PIECE", 37)  # pieces don't change the counts
    rows = [(i, prose(rng, 30, ("etaoin", "zuvxyk")[i % 2]), ("aa", "bb")[i % 2]) for i in range(30)]
    docs = make(rows)
    learned = language.learn_profiles(docs, top=40)
    profiles = {lang: profile_of([t for _, t, x in rows if x == lang], 40) for lang in ("aa", "bb")}
    got = {lang: [r.gram for r in sorted(learned.collect(), key=lambda r: r["rank"]) if r.lang == lang] for lang in profiles}
    assert got == profiles
    assert sorted(map(tuple, learned.collect())) == sorted(map(tuple, language.learn_profiles(docs.repartition(7), top=40).collect()))
    for r in language.identify(docs, learned, top=40, keep=("text",)).collect():
        own = profile_of([r.text], 40)
        far = {lang: sum(abs(p.index(g) - k) if g in p else 40 for k, g in enumerate(own)) / (40 * len(own)) for lang, p in profiles.items()}
        assert r.lang_pred == min(far, key=lambda x: (far[x], x)) and abs(r.score - (1 - min(far.values()))) < 1e-9


def test_grams_against_brute_force(rng):
    text = prose(rng, 50, "abcé") + " 日本"
    codes = language.letters(text)
    grams, counts = language.count_grams(codes)
    want = Counter()
    own = codes.tolist()
    for n in (1, 2, 3):
        for i in range(len(own) - n + 1):
            g = own[i : i + n]
            if g != [1]:
                want[sum(c << language.BITS * (n - 1 - k) for k, c in enumerate(g))] += 1
    assert dict(zip(grams.tolist(), counts.tolist())) == want
