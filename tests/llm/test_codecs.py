"""Media round trips, the tokenizer against the library, page text, mixing and search."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from verilake.llm import bpe, html_text, media, mixing, search


@pytest.mark.parametrize("filters", [None, 0, 1, 2, 3, 4])
@pytest.mark.parametrize("text", ["", "a", "x" * 192, "é日🎉" * 1000])
def test_png_round_trip(filters, text):
    payload = media.pad(text.encode())
    assert len(payload) % 192 == 0 and payload
    image = media.encode_png(payload, filters)
    assert media.decode_png(image).tobytes() == payload
    for at in (3, 20, len(image) // 2, len(image) - 3):
        with pytest.raises(media.BadImage):
            media.decode_png(image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :])
    with pytest.raises(media.BadImage):
        media.decode_png(image[:-5])


def test_all_filters():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (5, 12), np.uint8)
    lines, above = [], np.zeros(12, int)
    for kind, row in enumerate(rows.astype(int)):
        left = np.concatenate([[0] * 3, row[:-3]])
        corner = np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines.append([kind, *((row - [0 * row, left, above, (left + above) // 2, paeth][kind]) % 256)])
        above = row
    both = media._unfilter([np.array(lines, np.uint8), np.array(lines[:3], np.uint8)], 3)
    assert (both[0] == rows).all() and (both[1] == rows[:3]).all()


def test_filters_are_chosen_by_row():
    text = ("abc" * 64 + "abd" * 64) * 3 + "".join(chr(97 + (7 * i) % 26) for i in range(1920)) + " " * 384
    image = media.encode_png(media.pad(text.encode()))
    at, packed = 8, b""
    while at < len(image):
        size = int.from_bytes(image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            packed += image[at + 8 : at + 8 + size]
        at += 12 + size
    kinds = {*np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, 193)[:, 0].tolist()}
    assert len(kinds) > 1 and kinds <= {0, 1, 2, 4}


def test_phash_against_brute_force():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (32, 32, 3), np.uint8)
    grey = pixels.sum(2).tolist()
    low = [[sum(math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) * grey[y][x] for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    middle = sorted(c for i, c in enumerate(c for line in low for c in line) if i)[31]
    bits = "".join(str(int(c > middle)) for line in low for c in line)
    assert media.phash(pixels) == f"{int(bits, 2):016x}"


def test_media_table(make, spark):
    docs = make([(1, "abc"), (2, None), (3, ""), (4, "abc"), (4, "abc"), (None, "long " * 50000)])
    stored = media.store_texts(docs)
    got = stored.select("doc_id", "n_bytes", F.pandas_udf(media.png_features, media.FEATURES)("media").alias("f")).select("doc_id", "n_bytes", "f.*").collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0][1:] == by[4][0][1:] and len(by[4]) == 2 and by[2][0][1:] == by[3][0][1:] and by[2][0].n_bytes == 0
    assert by[1][0].payload_sha256 == hashlib.sha256(b"abc" + b" " * 189).hexdigest() and by[1][0].tail_crc32 == zlib.crc32(b" " * 16)
    broken = spark.createDataFrame([(b"junk",), (None,)], "media binary")
    assert all(r.f.feature is None for r in broken.select(F.pandas_udf(media.png_features, media.FEATURES)("media").alias("f")).collect())


def library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def texts():
    rng = random.Random(3)
    odd = ["", " ", "a\x1cb", "Σας ΣΑΣ", "İstanbul", "x<|endoftext|>y <|startoftext|><|endoftext|>", "it's we'LL  don't", "12½ Ⅷ ²", "é ａ　b", "日本語🎉🎉", "<|endoftext|", "ß\x85x", "a" * 5000, "x\x00y"]
    long_words = ["".join(rng.choice("theaniorsl") for _ in range(n)) for n in (100, 3000, 9000)]
    return odd + long_words + [prose(rng, 300, "abcdefghijklmnopqrstuvwxyzéñ,.'!") for _ in range(20)] + ["the and of " * 30000]


def test_bpe_against_library():
    own, known = bpe.coder(bpe.VOCABULARY), library()
    for text in texts():
        e = known.encode(text, add_special_tokens=False)
        ids = [*own.encode(text)]
        assert ids == e.ids
        decoded = known.decode(ids, skip_special_tokens=False)
        assert "".join(bpe.TokenDecoder(own).feed(ids)) == decoded
        assert own.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_of_single_characters():
    """Every letter, digit and capital that two versions of Unicode may see differently, and every 97th other character."""
    own, known = bpe.coder(bpe.VOCABULARY), library()
    newer = [c for a, b in (part.split("-") if "-" in part else (part, part) for part in bpe.NEWER.split()) for c in (range(int(a, 16) - 1, int(b, 16) + 2, max(1, (int(b, 16) - int(a, 16)) // 9)))]
    points = {*newer, *bpe.SMALL, *bpe.SMALL.values(), *range(0, 0x110000, 97), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7FF), *range(0x105C0, 0x10600)}
    texts = ["a" + chr(c) + "b" for c in sorted(points) if not 0xD800 <= c < 0xE000]
    for text, e in zip(texts, known.encode_batch(texts, add_special_tokens=False)):
        assert [*own.encode(text)] == e.ids, ascii(text)


def test_lookahead_by_brute_force():
    merges = [("a", "b"), ("ab", "a"), ("b", "b"), ("aba", "bb"), ("a", "a</w>")]
    far = bpe.sufficient_lookahead(merges)
    rank = {m: r for r, m in enumerate(merges)}

    def encode(symbols):
        symbols = list(symbols)
        while True:
            best = min(((rank.get(p, 99), i) for i, p in enumerate(zip(symbols, symbols[1:]))), default=(99, 0))
            if best[0] == 99:
                return symbols
            symbols[best[1] : best[1] + 2] = ["".join(symbols[best[1] : best[1] + 2])]

    rng = random.Random(0)
    for _ in range(400):
        head = [rng.choice("ab") for _ in range(rng.randint(far, 14))]
        seen = set()
        for _ in range(8):
            tail = [rng.choice("ab") for _ in range(rng.randint(0, 8))] + ["a</w>"]
            ends, stable = 0, []
            for token in encode(head + tail):
                ends += len(token.removesuffix("</w>"))
                if ends > len(head) - far:
                    break
                stable.append(token)
            seen.add(tuple(stable))
        assert len(seen) == 1


def test_bpe_tables(make):
    docs = make([(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld")])
    got = bpe.encode_digests(docs).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, got[0].n_tokens, got[0].n_tokens] and got[0].n_tokens > 1
    back = bpe.decode_ids(bpe.encode_texts(docs)).collect()
    assert [r.decoded.strip() for r in back] == ["hello wörld", "", "", "hello wörld"] and bpe.encode_digests(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1><a href=x>Home</a></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="ad">Buy this now</div><div id="cookie-notice"><p>We use cookies on this site.</p></div>
%s<aside><p>Side text that is quite long as well, yes indeed.</p></aside><form><input><p>Sign up here</p></form>
<section class="comments"><p>A very long reader comment about this and that and everything else under the sun.</p></section><footer>&copy; 2020</footer></body></html>"""
BODY = "<h1>The &amp; title</h1><p><b>First   line<br><p>Second paragraph&nbsp;with &eacute; and a <a href=q>link</a> inside.<!-- gone --></p><p>Third one, &#x41; &lt;tag&gt; it is.</p><script>x()</script>"
TEXT = "The & title\nFirst line\nSecond paragraph with é and a link inside.\nThird one, A <tag> it is."


def test_pages():
    assert html_text.main_text(PAGE % f"<article>{BODY}</article>") == TEXT
    assert html_text.main_text(PAGE % f'<div class="content">{BODY}</div>') == TEXT
    assert html_text.main_text(PAGE % f"<main><div>{BODY}</div></main>") == TEXT
    assert [html_text.main_text(x) for x in (None, "", "<html></html>", "<", "<!-- open")] == ["", "", "", "<", ""]
    assert html_text.main_text("<p>a<p>b") == "a\nb"
    deep = "<div>" * 3000 + "<p>inside here</p>"
    assert html_text.main_text(deep) == "inside here"


class Tree(HTMLParser):
    """Nodes of well-formed pages: [tag, children, own text]."""

    def __init__(self, source):
        super().__init__()
        self.stack = [["#page", [], ""]]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.stack.append([tag, [], ""])
        self.stack[-2][1].append(self.stack[-1])

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2] += "".join(data.split())


def composite(source):
    """The text of the node of the largest density sum by plain recursion, without widening and thresholds."""
    root = Tree(source).stack[0]

    def measure(node, linked=False):
        linked = linked or node[0] == "a"
        parts = [measure(c, linked) for c in node[1]]
        chars = len(node[2]) + sum(p[0] for p in parts)
        links = len(node[2]) * linked + sum(p[1] for p in parts)
        tags = sum(p[2] + 1 for p in parts)
        anchors = sum(p[3] + (c[0] == "a") for p, c in zip(parts, node[1]))
        node.append((chars, links, tags, anchors))
        return node[3]

    measure(root)
    body = next(c for c in root[1][0][1] if c[0] == "body")
    share = body[3][1] / max(body[3][0], 1)

    def density(node):
        c, lc, t, lt = node[3]
        if not c:
            return 0.0
        t = max(t, 1)
        base = math.log(lc * c / max(c - lc, 1) + share * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1)) / math.log(max(base, 1) + 1)

    def nodes(node):
        yield node
        for child in node[1]:
            yield from nodes(child)

    value = lambda node: sum(map(density, node[1])) or density(node) * 0.999
    best = max(nodes(body), key=value)
    return "".join(n[2] for n in nodes(best))


def test_core_against_brute_force():
    rng = random.Random(21)
    for _ in range(60):
        def block(depth):
            if depth == 0 or rng.random() < 0.3:
                text = prose(rng, rng.randint(1, 40))
                return f"<p>{text}</p>" if rng.random() < 0.7 else f'<span><a href="x">{text}</a></span>'
            return "<div>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

        source = "<html><body>" + "".join(block(3) for _ in range(3)) + "</body></html>"
        page = html_text.Page(source)
        density, sums, _ = page.densities()
        best = max(range(page.body(), len(page.tags)), key=lambda i: (sums[i], -i))
        inside = [False] * len(page.tags)
        for i in range(best, len(page.tags)):
            inside[i] = i == best or inside[page.parents[i]]
        own = "".join("".join(t.split()) for node, t in page.events if t and inside[node])
        assert own == composite(source)
        kept = page.kept()
        assert all(kept[i] for i in range(len(inside)) if inside[i])


@pytest.mark.parametrize("name", ["content with-sidebar", "no-sidebar", "has-comments", "layout-sidebar-right", "post related-topic", "share-story article-body"])
def test_classes_that_say_more_keep_their_article(name):
    assert html_text.main_text(PAGE % f'<div class="{name}">{BODY}</div>') == TEXT
    assert html_text.main_text(f'<html><body class="{name}"><form><div class="{name}">{BODY}</div></form></body></html>') == TEXT


def test_density_decides():
    long = "".join(f"<p>{prose(random.Random(k), 60)}</p>" for k in range(5))
    links = "".join(f'<li><a href="/{k}">{prose(random.Random(k), 4)}</a></li>' for k in range(12))
    text = html_text.main_text(f"<html><body><div>{long}</div><div><ul>{links}</ul></div></body></html>")
    assert text.count("\n") == 4 and text == html_text.main_text(f"<html><body><div>{long}</div></body></html>")
    # Not what stands in an article or main element: the text is elsewhere.
    assert html_text.main_text(f"<html><body><article><ul>{links}</ul></article><div>{long}</div></body></html>") == text
    # A second dense part is kept by the threshold.
    both = html_text.main_text(f"<html><body><div>{long}</div><ul>{links}</ul><div>{long}</div></body></html>")
    assert both == f"{text}\n{text}"
    wide = html_text.main_text(f"<html><body><div>{long * 4000}</div></body></html>")
    assert wide.count("\n") == 5 * 4000 - 1


def test_page_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE % f"<article>{BODY}</article>", "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert got[1].text == TEXT and got[1].n_chars == len(TEXT) and got[2].text == "" and got[2].n_chars == 0
    assert html_text.extract(pages).count() == 3 and html_text.extract(pages.limit(0)).count() == 0


def test_mixing(make, rng):
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", s) for i, s in enumerate(rng.choices(["a", "b", "c", None], [60, 10, 20, 10], k=900))]
    rows += [(2000, None, "en", "a"), (2001, "", "en", "b"), (2002, "x y", "en", "a"), (2002, "x y", "en", "a")]
    docs = make(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s))
    weights = dict(zip(order, [5, 2, 1, 5]))
    sizes = {s: sum(r.size for r in by[s]) for s in by}
    targets, left, open_ = {}, 1.5 * total, set(by)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            targets |= share
            break
        for s in full:
            targets[s] = 2 * sizes[s]
            left -= targets[s]
        open_ -= full
    for s in by:
        assert by[s][0].target == pytest.approx(targets[s]) and by[s][0].source_size == sizes[s]
        assert sum(r.taken for r in by[s]) == pytest.approx(targets[s], abs=150)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda rows: Counter((r.doc_id, r.source, r.copies, r.text_hash) for r in rows)
    assert key(again) == key(got)
    emitted = mixing.emit_mixture(docs)
    assert emitted.columns == docs.columns and Counter(r.doc_id for r in emitted.collect()) == Counter({i: n for i, n in ((i, sum(r.copies for r in got if r.doc_id == i)) for i, *_ in rows) if n})
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(make([(1, "a b", "en", "z")])).first().taken in (2, 4)


def test_search(make, rng, monkeypatch):
    rows = [(i, prose(rng, rng.randint(3, 60), "abc")) for i in range(300)] + [(400, None), (401, ""), (402, "!!"), (500, "abab " * 2000), (501, prose(rng, 9)), (0, None), (None, "abc")]
    rows[50] = (50, rows[0][1])
    docs = make(rows)
    got = defaultdict(list)
    for r in search.top_k(docs, docs.filter("doc_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    words = {(i, k): Counter(re.findall(r"[^\W_]+", (t or "").lower())) for k, (i, t) in enumerate(rows) if i is not None}
    size = {i: sum(c.values()) for i, c in words.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for c in words.values() for w in c)
    for (q, _), asked in words.items():
        if q % 50 or not asked:
            continue
        scores = {}
        for i, c in words.items():
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w in asked if w in c)
            if s > 0:
                scores[i] = round(s, 9)
        assert got[q] == [i[0] for i in sorted(scores, key=lambda i: (-scores[i], i))][:10]
    assert search.top_k(docs.limit(0), docs.limit(0)).count() == 0


def test_pruned_shard_equals_full_scores():
    rng = random.Random(9)
    found = [search.terms_of(prose(rng, rng.randint(5, 80), "abcd")) for _ in range(2000)]
    shard = search.Shard(search._pack(list(range(2000)), found), 40.0)
    asked = [found[q][0] for q in range(0, 2000, 13)]
    terms, weights = np.concatenate(asked), np.concatenate([np.linspace(0.5, 3, len(t)) for t in asked])
    first = np.cumsum([0, *map(len, asked)])[:-1]
    every = {}
    for q, own in enumerate(asked):
        at = shard.find(own)
        lists, n = search._spread(shard.starts[at], shard.starts[at + 1])
        every[q] = np.bincount(shard.docs[lists], shard.impacts[lists] * np.repeat(np.linspace(0.5, 3, len(own)), n), 2000)
    got = {q: (ids, scores) for q, ids, scores in shard.best(terms, weights, first, np.zeros(len(asked)), 10)}
    for q, scores in every.items():
        want = sorted(range(2000), key=lambda i: (-round(scores[i], 9), i))[:10]
        assert got[q][0].tolist() == want and np.allclose(got[q][1], scores[want])
    assert (shard.reach(shard.find(terms), weights, first) >= [got[q][1][0] for q in range(len(asked))]).all()
    floors = np.array([got[q][1][4] for q in range(len(asked))])
    for q, ids, scores in shard.best(terms, weights, first, floors, 10):
        assert ids.tolist() == got[q][0][: len(ids)].tolist() and len(ids) >= 5
    assert not shard.best(terms, weights, first, np.full(len(asked), 1e9), 10)


def test_search_over_many_shards(make, rng, monkeypatch):
    # Small shards and bundles give the same as one; very long and very repetitive documents keep their counts.
    rows = [(i, prose(rng, rng.randint(3, 40), ("abc", "xyz")[i % 2])) for i in range(120)] + [(200, "abab " * 70_000), (201, "abab " * 70_001 + "bb"), (50, "xx abab"), (50, "abab")]
    docs = make(rows)
    find = lambda: sorted(map(tuple, search.top_k(docs, docs.filter("doc_id % 50 = 0"), k=5).collect()))
    one = find()
    for name, value in (("SHARD", 7), ("POSTINGS", 60), ("QUERIES", 2), ("TERMS", 3)):
        monkeypatch.setattr(search, name, value)
    assert find() == one and one


def test_search_meets_equal_texts_once(make, rng, monkeypatch):
    # 20 copies of each text: the index holds one, with its ten smallest ids; three queries of twelve are searched.
    texts = [prose(rng, 12, "abc") for _ in range(30)]
    docs = make([(i, texts[i % 30]) for i in range(600)])
    shards = search.build_shards(docs).collect()
    assert sum(len(s.lengths) // 8 for s in shards) == 30 and sum(len(s.ids) // 8 for s in shards) == 300
    assert sum(np.frombuffer(s.copies, np.int64).sum() for s in shards) == 600
    find = lambda: sorted(map(tuple, search.top_k(docs, docs.filter("doc_id % 50 = 0")).collect()))
    one = find()
    assert [r[:3] for r in one] == [(q, n + 1, q % 30 + 30 * n) for q in range(0, 600, 50) for n in range(10)]
    for name, value in (("SHARD", 1), ("QUERIES", 2), ("ROUNDS", 2)):
        monkeypatch.setattr(search, name, value)
    assert find() == one
