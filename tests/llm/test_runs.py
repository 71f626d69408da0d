"""Periodic runs, document fingerprints and collocations against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from verilake.llm import collocations, fingerprints, runs


def lyndon_by_definition(s):
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def runs_by_definition(s):
    """Longest stretches by trying every period at every place."""
    found = []
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            own = s[i : j + q]
            if len(own) >= max(6, 4 * q) and all(any(own[t] != own[t + d] for t in range(len(own) - d)) for d in range(1, q)):
                found.append((i, len(own), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths(rng):
    for _ in range(400):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 40))]
        assert runs.lyndon_lengths(np.array(s)).tolist() == lyndon_by_definition(s)


def test_word_runs(rng):
    seen = 0
    for _ in range(1500):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 70))]
        a, p = rng.randrange(len(s)), rng.randint(1, 7)
        if rng.random() < 0.7:
            s = [s[min(a + (i - a) % p, len(s) - 1)] if i >= a else x for i, x in enumerate(s)]
        expected = runs_by_definition(s)
        seen += len(expected)
        assert runs.word_runs(s) == expected
    assert seen > 500


def test_word_runs_of_long_texts():
    assert runs.word_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    assert runs.word_runs([*"ab"] * 100_000 + ["b"] * 7) == [(0, 200_000, 2), (199_999, 8, 1)]


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs_by_definition(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.fixture
def odd_rows(rng):
    """Nulls, empties, repeats, odd white space, periodic texts and plain ones."""
    rows = [(None, "a b a b a b a b"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "x y x y\x1cz " * 9), (5, "a " * 7), (5, "a " * 7), (5, "b a")]
    for i in range(10, 250):
        words = [rng.choice(["ka", "lo", "mi", "Été", "zz"]) for _ in range(rng.randint(1, 90))]
        if i % 3 == 0:
            words = words[:5] + words[5 : 5 + rng.randint(1, 6)] * rng.randint(2, 9) + words[20:]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


def test_op11(spark, make, odd_rows, tmp_path):
    make(odd_rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = runs.op11_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in found.dtypes} == {"bigint", "string"}
    key = lambda r: tuple((x is not None, x) for x in r)
    expected = sorted((expected_row(*r) for r in odd_rows), key=key)
    assert sorted(map(tuple, found.collect()), key=key) == expected
    assert sum(r[1] > 0 for r in expected) > 40
    made = runs.periodic_runs(make(odd_rows)).filter("doc_id = 5").collect()
    assert sorted(r.collapsed for r in made) == ["a", "a", "b a"]


def test_op11_empty(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert runs.op11_runs(spark, str(tmp_path)).count() == 0


def parse_by_definition(text):
    return tuple(re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def phrases_by_definition(rows, least, top):
    """Score every phrase of every language from counts of all n-grams."""
    counts, total = {}, {}
    for lang, text in rows:
        lang = lang or "und"
        for piece in parse_by_definition(text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    often = {k: f for k, f in counts.items() if f >= least}
    held = {}
    for (lang, p), f in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = lang, p[i : i + m]
                held[key] = max(held.get(key, 0), f)
    scored = {}
    for (lang, p), a in often.items():
        if len(p) > 1 and held.get((lang, p), 0) < a:
            score, k = min((1000 * a * total[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p)))
            scored.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), often[lang, p[:k]], often[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, own in scored.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


@pytest.fixture
def phrase_rows(rng):
    """Short vocabularies, copies, marks, odd white space, upper case, a null language, null and empty texts."""
    vocabulary = ["Ka", "lo", "mi", "Été", "zz", "a\x1cb", "ß", "日本", "x-y"]
    rows = [("en", None), (None, None), ("en", ""), ("en", " \t.,;!?\n"), ("en", "ka " * 3000), (None, "Null lang. " * 120)]
    for i in range(300):
        words = [rng.choices(vocabulary, [9, 6, 4, 2, 1, 1, 1, 1, 1])[0] + rng.choice(["", "", "", "", ""] * 3 + [",", ".", "\n", "\r"]) for _ in range(rng.randint(1, 160))]
        rows.append((rng.choice(["en", "en", "fr", None]), rng.choice([" ", "\t", "  "]).join(words)))
    return rows + rows[20:60] * 3


def test_collocations(spark, make, phrase_rows, tmp_path):
    make([(i, text, lang) for i, (lang, text) in enumerate(phrase_rows)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = collocations.op13_collocations(spark, str(tmp_path))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = phrases_by_definition(phrase_rows, 100, 2000)
    assert sorted(map(tuple, found.collect())) == expected
    assert len(expected) > 80
    few = collocations.collocations(make([(i, text, lang) for i, (lang, text) in enumerate(phrase_rows)]), top=7)
    assert sorted(map(tuple, few.collect())) == phrases_by_definition(phrase_rows, 100, 7)


def test_chunks_hold_every_phrase_once(rng):
    for n in (0, 1, 3, 7, 40, 900):
        words = [rng.choice([b"a", b"b", b"c", b"\n"]) if n > 40 else b"w%d" % rng.randrange(9) for _ in range(n)]
        again = [t for c in collocations.chunks_of(words) for t in c.split(b" ")[: -collocations.OVERLAP]]
        assert again == words
        grams = [tuple(c.split(b" ")[i : i + 5]) for c in collocations.chunks_of(words) for i in range(len(c.split(b" ")) - collocations.OVERLAP)]
        padded = words + [b"\n"] * 4
        assert grams == [tuple(padded[i : i + 5]) for i in range(n)]


def test_chunks_are_prefix_free(rng):
    chunks = {c for _ in range(60) for c in collocations.chunks_of([rng.choice([b"a", b"b", b"cc"]) for _ in range(400)])}
    apart = sorted(c.split(b" ") for c in chunks)
    assert len(apart) > 50
    assert not any(b[: len(a)] == a for a, b in zip(apart, apart[1:]))


def test_bitmap(spark):
    pairs = [0, 1, -1, 7, 32767, 32768, (1 << 27) - 1, 1 << 27, -(1 << 63), 123456789012345]
    bits = np.frombuffer(collocations._bitmap(spark.createDataFrame([(p,) for p in pairs], "pair long")), np.uint8)
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == sorted({p % collocations.BITS for p in pairs})


def test_collocations_one_row_a_place(spark):
    """Ten words in a row whose pairs are all frequent: a row for the longest phrase at each place, not one for each length; all lengths are counted."""
    words = [f"w{i}" for i in range(10)]
    chunk = " ".join(words + ["\n"] * collocations.OVERLAP)
    every = spark.sparkContext.broadcast(b"\xff" * (collocations.BITS // 8))
    made = pd.concat(collocations._longest(every)(iter([pd.DataFrame({"lang": ["en", "de", "en"], "chunk": [chunk, chunk, chunk], "n": [3, 4, 5]})])))
    expected = {(lang, " ".join(words[i : i + 5]), n) for lang, n in (("en", 8), ("de", 4)) for i in range(9)}
    assert len(made) == len(expected) and {*zip(made["lang"], made["phrase"], made["n"])} == expected
    lengths = collocations._all_lengths(spark.createDataFrame(made))
    got = {(r.lang, r.phrase, r.words, r.n) for own in lengths for r in own.collect()}
    assert got == {(lang, " ".join(words[i : i + k]), k, n) for lang, n in (("en", 8), ("de", 4)) for k in range(2, 6) for i in range(11 - k)}


def test_collocations_empty(spark, make):
    assert collocations.collocations(make([])).count() == 0
    assert collocations.collocations(make([(1, "too rare to count", "en")])).count() == 0


def names(text):
    return {n for level, _, _ in fingerprints.signatures([text]) for n in level.tolist()}


def test_phrases_are_consistent(rng):
    """A substring has the same phrases wherever it stands, but for those at its ends; neighbours' colours differ."""
    inner = "".join(rng.choice("abcdefgh  ") for _ in range(3000))
    for before, after in (("", "x"), ("q", ""), ("abc abc ", "zz"), ("".join(rng.choice("ab") for _ in range(500)), "e" * 90)):
        assert len(names(inner) & names(before + inner + after)) > 0.93 * len(names(inner))
    for _ in range(200):
        row = fingerprints.mixed(np.array([rng.randrange(3) for _ in range(rng.randint(1, 60))], np.uint64))
        row = row[np.concatenate([[True], row[1:] != row[:-1]])]
        colour = fingerprints.colours(row, np.array([0]))
        assert colour.max() < 3 and (colour[1:] != colour[:-1]).all()
        made, first = fingerprints.phrases(row, np.array([0]))
        assert first.tolist() == [0] and len(made) <= len(row) // 2 + 1


def test_batches_do_not_matter(rng, monkeypatch):
    texts = ["", "a", "aa", "ab", "a" * 5000, *["".join(rng.choice("abc d") for _ in range(rng.randint(1, 900))) for _ in range(40)]]
    one_by_one = [fingerprints.fingerprints_of([t])[0] for t in texts]
    assert fingerprints.fingerprints_of(texts) == one_by_one
    monkeypatch.setattr(fingerprints, "AT_ONCE", 700)
    assert fingerprints.fingerprints_of(texts) == one_by_one
    assert one_by_one[0] == "" and {len(p) for p in one_by_one[1:]} == {256}


def test_op12(spark, make, odd_rows, rng, tmp_path):
    big = (1 << 60) + 1  # more than a double holds, beside nulls
    letters = [chr(c) for c in range(97, 123)] + [" "] * 5 + ["é", "日", "😀"]
    long = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(900, 4000)))) for i in range(1000, 1060)]
    rows = odd_rows + long + [(1100, long[5][1]), (1101, long[5][1]), (big, "x" * 70_000)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = fingerprints.op12_fingerprints(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = found.collect()
    assert len(got) == len(rows)
    alone = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 5}
    texts = {i: t or "" for i, t in rows if i is not None and i != 5}
    order = sorted(texts, reverse=True)
    last_null = {t or "" for i, t in rows if i is None}
    for i, next_id in zip(order, order[1:]):
        row, text = alone[i], texts[i]
        if 5 in range(next_id + 1, i):
            continue  # several rows have the id 5
        edited = text[: len(text) - len(text) // 2] + texts[next_id][: len(text) // 2]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [row.fingerprint, row.edited_fingerprint] == fingerprints.fingerprints_of([text, edited])
        for likeness, other in ((row.near_edited, edited), (row.near_next, texts[next_id])):
            a, b = names(text), names(other)
            true = 1.0 if text == other else 2 * len(a & b) / (len(a) + len(b))
            assert 0 <= likeness <= 1 and abs(likeness - true) < 0.25
    assert alone[1101].near_next == 1.0 and alone[1101].near_edited < 1.0
    nulls = [r for r in got if r.doc_id is None]
    assert len(nulls) == 2 and len(last_null) == 2
    # After the last row comes the first.
    ends = {hashlib.sha256((t[: len(t) - len(t) // 2] + "x" * (len(t) // 2)).encode()).hexdigest() for t in last_null}
    assert sum(r.edited_sha256 in ends for r in nulls) >= 1


def test_fingerprints_of_few_rows(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprints.op12_fingerprints(spark, f"{tmp_path}/none").count() == 0
    make([(7, "abcdefgh")]).write.parquet(f"{tmp_path}/one/documents.parquet")
    (row,) = fingerprints.op12_fingerprints(spark, f"{tmp_path}/one").collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest() and row.near_next == 1.0
    texts = spark.createDataFrame([("a b c d e f g h i j k",), ("",), (None,)], "t string")
    made = texts.select(fingerprints.fingerprint(texts.t).alias("f"))
    assert sorted(len(r.f) for r in made.collect()) == [0, 0, 256]
