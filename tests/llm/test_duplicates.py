"""SimHash, suffixes and chunks against brute force."""

import random
from collections import defaultdict

from tests.llm.conftest import prose
from verilake.llm import chunks, simhash, suffixes


def near_rows():
    rng = random.Random(4)
    base = [prose(rng, 150) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(40):
        words = base[k % 6].split()
        words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, base[0]) for k in range(30)]
    return rows + [(300, None), (301, ""), (302, " \t"), (303, "One Two"), (304, "one two"), (300, None), (None, base[1])]


def test_simhash(make):
    rows = near_rows()
    got = simhash.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    prints = [simhash.fingerprint(t) & (2**64 - 1) for _, t in rows]
    assert sorted(int(r.fingerprint, 16) for r in got) == sorted(prints) and all(len(r.fingerprint) == 16 for r in got)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    want = {rows[i][0]: min(x for x in groups[find(i)] if x is not None) for i in range(len(rows)) if rows[i][0] is not None}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert want[301] == want[302] == 300 and want[304] == 303
    kept = simhash.keep_one(make(rows), similarity=None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == make(rows).columns
    assert simhash.near_duplicates(make(rows).limit(0)).count() == 0


def test_chain_of_fingerprints(spark):
    # Each is within two bits of the next only; the component is the whole chain.
    chain = [0]
    for k in range(30):
        chain.append(chain[-1] ^ (3 << (2 * k)))
    edges = simhash.ball_links(spark.createDataFrame([(x,) for x in chain], "_print long"))
    roots = simhash.components(edges).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 30


def test_similar_texts(make):
    rng = random.Random(6)
    base = [prose(rng, 200) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        words = base[k % 3].split()
        for _ in range(k % 4 + 1):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((100 + k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "two words"), (303, "Two words"), (None, base[1])]
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows if i is not None and t and len(t.split()) > 4}
    links = {(r.src, r.dst) for r in simhash.similar_links(make(rows)).collect()}
    for a, b in links - {(303, 302)}:
        assert len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    close = [i for i in sets if i >= 100 and len(sets[i] & sets[(i - 100) % 3]) / len(sets[i] | sets[(i - 100) % 3]) >= 0.8]
    left = {r.doc_id for r in simhash.keep_one(make(rows)).collect()}
    assert len([i for i in close if i in left]) <= 0.1 * len(close) and set(range(6)) <= left and 303 not in left


def test_similar_texts_beyond_the_first(make):
    # The smallest id is far from both others, which are close to each other; and a pair whose words are ordered anew in part.
    rng = random.Random(7)
    b = prose(rng, 400).split()
    c = [*b[:-9], *prose(rng, 9).split()]
    a = [*b[:310], *prose(rng, 90).split()]
    lines = [prose(rng, 40) for _ in range(30)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(b[200:260])), (5, " ".join([*b[200:259], "new"]))]
    rows += [(10 + k, " ".join(rng.sample(lines, 8))) for k in range(60)]  # of common lines only
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i > j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert {(3, 2), (5, 4)} <= want and (2, 1) not in want
    got = {(r.src, r.dst) for r in simhash.similar_links(make(rows)).collect()}
    assert got <= want and {(r.node, r.root) for r in simhash.components(make(rows).sparkSession.createDataFrame([*got], "src long, dst long")).collect()} >= {(3, 2), (5, 4)}
    assert {r.doc_id for r in simhash.keep_one(make(rows)).collect()} & {1, 2, 3, 4, 5} == {1, 2, 4}


def test_similar_short_texts(make):
    # A few new words at the end change many bits of a short text's prints, but few of its shingles.
    rng = random.Random(11)
    rows = []
    for k in range(150):
        words = prose(rng, 34).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-3], *prose(rng, 3).split()]))]
    links = {(r.src, r.dst) for r in simhash.similar_links(make(rows)).collect()}
    assert links == {(2 * k + 1, 2 * k) for k in range(150)}


def test_keep_one_tells_rows_of_one_id_apart(make):
    rng = random.Random(9)
    texts = [prose(rng, 60) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[4]), (9, texts[2]), (10, texts[5])]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(make(rows)).collect())
    assert kept == sorted([(0, texts[0]), (0, texts[1]), (7, texts[3]), (7, texts[4]), (9, texts[2]), (10, texts[5])])


def repeats():
    rng = random.Random(8)
    passage, other = prose(rng, 70), prose(rng, 55)
    rows = [(i, prose(rng, 120)) for i in range(10)]
    rows += [(20 + i, f"{prose(rng, 30)} {passage} {prose(rng, 40)}") for i in range(6)]
    rows += [(40, f"{other}\n{prose(rng, 20)} {other}"), (41, prose(rng, 49)), (42, rows[3][1]), (43, rows[3][1]), (50, None), (51, ""), (52, "a " * 3000)]
    return rows, passage


def test_suffixes(make):
    rows, passage = repeats()
    words = {i: (t or "").split() for i, t in rows}
    places = defaultdict(list)
    for i in words:
        for p in range(len(words[i]) - 49):
            places[tuple(words[i][p : p + 50])].append((i, p))
    need = defaultdict(set)
    for found in places.values():
        for i, p in found:
            if (i, p) != min(found):
                need[i].update(range(p, p + 50))
    got = defaultdict(set)
    for r in suffixes.repeated_passages(make(rows)).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == need
    docs = make(rows)
    cut = {r.doc_id: r.text for r in suffixes.cut_repeats(docs).collect()}
    assert passage in cut[20] and all(passage not in cut[i] for i in range(21, 26))
    assert cut[42].strip() == "" and cut[3] == dict(rows)[3] and cut[50] is None and cut[0] == dict(rows)[0] and cut[41] == dict(rows)[41]
    assert suffixes.cut_repeats(docs).columns == docs.columns and suffixes.repeated_passages(docs.limit(0)).count() == 0


def brute_passages(rows):
    """Words of each (id, text) that belong to a window of 50 words with an earlier copy."""
    places, need = defaultdict(list), defaultdict(set)
    rows = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is None, r[0]))
    for order, (i, t) in enumerate(rows):
        words = t.split()
        for p in range(len(words) - 49):
            places[tuple(words[p : p + 50])].append((order, p))
    for found in places.values():
        for order, p in found:
            if (order, p) != min(found):
                need[rows[order][0]].update(range(p, p + 50))
    return need


def test_suffixes_dealt_over_many_partitions(make, spark):
    # One passage that most rows share, with and without the same words around it, and repeated words, in partitions of a few suffixes each.
    rng = random.Random(12)
    passage, wide = prose(rng, 60), prose(rng, 130)
    rows = [(i, f"{prose(rng, 9 + i % 5)} {passage} {prose(rng, 20)}") for i in range(60)]
    rows += [(100 + i, wide) for i in range(60)] + [(200, "la " * 400), (201, "la " * 90), (202, " ".join(wide.split()[:70])), (None, wide), (None, passage)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, firsts = defaultdict(set), {}
        for r in suffixes.repeated_passages(make(rows)).collect():
            got[r.doc_id].update(range(r.start_word, r.end_word))
            firsts[r.doc_id] = r.first_doc_id
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_passages(rows)
    assert all(firsts[i] == 0 for i in range(1, 60)) and all(firsts[i] == 100 for i in range(101, 160)) and firsts[202] == 100


def test_suffixes_of_repeated_ids(make):
    rng = random.Random(13)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = [(1, a), (1, b), (1, b), (2, f"{a} {prose(rng, 4)}"), (3, b), (None, a), (None, prose(rng, 80)), (4, None), (5, "")]
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in suffixes.repeated_passages(make(rows)).collect()}
    assert got == {(2, 0, 100, 1), (3, 0, 100, 1), (None, 0, 100, 1)}
    cut = sorted((r.doc_id or 0, len((r.text or "").split())) for r in suffixes.cut_repeats(make(rows)).collect())
    assert cut == sorted([(1, 100), (1, 100), (1, 100), (2, 4), (3, 0), (0, 0), (0, 80), (4, 0), (5, 0)])


def test_suffixes_whose_first_partner_is_short(make):
    # 100 words are repeated; earlier documents hold pieces of 40 of them, so the first equal of every suffix is in a short one.
    rng = random.Random(10)
    passage = prose(rng, 100).split()
    rows = [(k, f"{prose(rng, 20)} {' '.join(passage[10 * k : 10 * k + 40])} {prose(rng, 20)}") for k in range(7)]
    rows += [(20, f"{prose(rng, 30)} {' '.join(passage)} {prose(rng, 30)}"), (21, f"{prose(rng, 5)} {' '.join(passage)} {prose(rng, 5)}")]
    got = {tuple(r) for r in suffixes.repeated_passages(make(rows)).collect()}
    assert got == {(21, 5, 105, 100, 20)}


def test_without_spans():
    text = "a b  c\nd e"
    assert suffixes.without_spans(text, [{"start_word": 1, "end_word": 3}]) == "a d e"
    assert suffixes.without_spans(text, [{"start_word": 0, "end_word": 5}]) == ""
    assert suffixes.without_spans(text, None) == text and suffixes.without_spans(None, []) is None


def test_chunks(make):
    rows, passage = repeats()
    docs = make([*rows, (None, passage)])
    found = chunks.repeated_runs(docs).collect()
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert {20, 21, 22, 23, 24, 25, 3, 42, 43} <= set(by) and not set(range(3)) & set(by) and None not in by
    raw = {i: (t or "").encode() for i, t in rows}
    for r in found:
        piece = raw[r.doc_id][r.start_byte : r.start_byte + r.n_bytes]
        assert len(piece) == r.n_bytes and (r.kept or r.first_doc_id <= r.doc_id)
    assert all(r.kept for r in by[3]) and not any(r.kept for r in by[42])
    own = {tuple(x) for x in chunks.chunks(docs).select("_id", "_start", "_size").collect()}
    for i, data in raw.items():
        assert sum(n for d, _, n in own if d == i) == len(data)
    assert chunks.repeated_runs(docs.limit(0)).count() == 0


def brute_runs(rows):
    """Runs of repeated chunks of rows (id, text) by plain dictionaries: (id, start, bytes, chunks, first id, kept)."""
    import numpy as np

    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    places, out = defaultdict(list), []
    cut = []
    for k, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        ends = chunks.chunk_ends(np.frombuffer(raw, np.uint8))
        cut.append([raw[s:e] for s, e in zip([0, *ends], ends)])
        for nth, piece in enumerate(cut[-1]):
            places[piece].append((k, nth))
    for k, pieces in enumerate(cut):
        at, last = 0, None
        for nth, piece in enumerate(pieces):
            found = places[piece]
            kept = found[0] == (k, nth)
            if len(found) > 1:
                if last == (nth - 1, kept):
                    s, n, c, first, _ = out[-1][1:]
                    out[-1] = (rows[k][0], s, n + len(piece), c + 1, min(first, rows[found[0][0]][0]), kept)
                else:
                    out.append((rows[k][0], at, len(piece), 1, rows[found[0][0]][0], kept))
                last = (nth, kept)
            at += len(piece)
    return sorted(out)


def test_chunks_against_brute_force(make):
    rows, passage = repeats()
    rows += [(60, rows[2][1]), (60, rows[2][1]), (61, rows[1][1] * 300), (70, passage * 2)]
    assert sorted(tuple(r) for r in chunks.repeated_runs(make(rows)).collect()) == brute_runs(rows)


def test_chunks_of_repeated_ids(make):
    rng = random.Random(15)
    a, b = prose(rng, 60), prose(rng, 60)
    found = sorted((r.doc_id, r.start_byte, r.n_bytes, r.kept) for r in chunks.repeated_runs(make([(1, a), (1, b), (2, a), (3, b), (4, a)])).collect())
    assert found == sorted([(1, 0, len(a), True), (1, 0, len(b), True), (2, 0, len(a), False), (3, 0, len(b), False), (4, 0, len(a), False)])
    twice = sorted((r.doc_id, r.n_bytes, r.kept) for r in chunks.repeated_runs(make([(1, a), (1, a)])).collect())
    assert twice == [(1, len(a), False), (1, len(a), True)]


def test_chunks_of_short_copies(make):
    rows = [(1, "All rights reserved."), (2, "All rights reserved."), (3, "x"), (4, "x"), (5, "another one")]
    found = {(r.doc_id, r.start_byte, r.n_bytes, r.first_doc_id, r.kept) for r in chunks.repeated_runs(make(rows)).collect()}
    assert found == {(1, 0, 20, 1, True), (2, 0, 20, 1, False), (3, 0, 1, 3, True), (4, 0, 1, 3, False)}


def test_chunks_resist_insertions():
    import numpy as np

    rng = random.Random(1)
    data = prose(rng, 400).encode()
    ends = lambda b: {b[s:e] for s, e in zip([0, *chunks.chunk_ends(np.frombuffer(b, np.uint8))], chunks.chunk_ends(np.frombuffer(b, np.uint8)))}
    a, b = ends(data), ends(data[:700] + b"INSERTED" + data[700:])
    assert len(a - b) <= 3
    plain = 0
    for byte in data[:60]:
        plain = (plain * 2 + int(chunks.GEAR[byte])) % 2**32
    assert int(chunks.gear_hashes(np.frombuffer(data[:60], np.uint8))[-1]) == plain


def test_a_pair_is_one_row(make, monkeypatch):
    """What two classes share is counted without a row for each shingle that they share."""
    import re

    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i:]])) for i in range(12)]
    plans, real = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a))
    assert {(r.src, r.dst) for r in simhash.similar_links(make(rows)).collect()}
    assert not [p for p in plans if re.search(r"Join Inner, \(+b#\d+L = b#\d+L\) AND \(_token#", p)]


def test_near_copies_of_one_text(make, monkeypatch):
    """Copies of one text with two to four new words each: few pairs are compared, and all components are found."""
    rng = random.Random(12)
    base, rows = prose(rng, 150).split(), []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([2, 2, 3, 4])):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(146)} for i, t in rows}
    pairs = [(i, j) for i in sets for j in range(i)]
    similar = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    plain = {i: i for i in sets}
    for _ in sets:
        for i, j in similar:
            plain[i] = plain[j] = min(plain[i], plain[j])
    compared, real = [], simhash.cut

    def counted(df, *a):
        made = real(df, *a)
        if df.columns == ["a", "b"]:
            compared.append(made.count())
        return made

    monkeypatch.setattr(simhash, "cut", counted)
    links = {(r.src, r.dst) for r in simhash.similar_links(make(rows)).collect()}
    assert links <= similar
    found = {i: i for i in sets}
    for _ in sets:
        for i, j in links:
            found[i] = found[j] = min(found[i], found[j])
    assert found == plain and 1 < len({*plain.values()}) < 120
    assert max(compared) < len(pairs) / 4
