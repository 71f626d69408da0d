"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The merge list fixes how far a change to the right of a position can reach to the left.
A difference between two continuations moves left only by a merge (u, v) whose u ends at
the present frontier; the frontier then stands before u, and a later merge can move it
on only if its right part begins with that u. The longest such chain, summed over the
lengths of its left parts, is a sufficient lookahead: tokens that end at least so many
symbols before the end of what was read are final. encode_word keeps a buffer of fixed
size and emits tokens as they become final, so one word of any length takes constant
memory. Words, cut out by the pre-tokenizer, never influence one another.

Decoding is a state machine over ids: it holds at most one incomplete UTF-8 sequence.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, releasing, table

VOCABULARY = "word_bpe_49k.json"
#: Unicode white space, as the vocabulary's own normalizer takes it.
SPACES = "\t-\r \x85\xa0  -     　"
_SPACE = regex.compile(f"[{SPACES}]+")


#: Letters and digits that regex knows and the vocabulary's own engine, of Unicode 16, doesn't; to it they are symbols.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee
11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda
18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff
1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_NEWER = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in NEWER.split())
#: Small letters of capitals that Python's unicodedata doesn't know yet.
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITAL = re.compile(f"[{''.join(map(chr, SMALL))}]")
#: How the vocabulary cuts text into words (fixed).
_PIECES = regex.compile(rf"(?V1)[\p{{L}}--[{_NEWER}]]+|'s|'t|'re|'ve|'m|'ll|'d|[\p{{N}}--[{_NEWER}]]|[[^{SPACES}\p{{L}}\p{{N}}]{_NEWER}]+")
#: The same for text before the first of the newer letters, and for ASCII text.
_COMMON_PIECES = regex.compile(r"[\p{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^" + SPACES + r"\p{L}\p{N}]+")
_BEYOND = re.compile("[\u0558-\U0010ffff]")
_ASCII_PIECES = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9]+")
END = "</w>"
#: Entries of each cache of a worker, and characters of a text that are split at once.
CACHE, SEGMENT = 150_000, 1 << 16
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible Latin-1, else the next from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in seen else next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right of a token's end that settle it, for a list in which parts precede what they make."""
    reach: dict[str, int] = {}
    most = 0
    for left, right in merges:
        text = right.removesuffix(END)
        far = len(left) + max((reach.get(text[:k], 0) for k in range(1, len(text) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), far)
        most = max(most, far)
    return most


def is_proper(merges: list[tuple[str, str]], symbols: Iterable[str]) -> bool:
    """Each part of a merge is a symbol or the result of an earlier merge."""
    known = set(symbols)
    for left, right in merges:
        if left not in known or right not in known:
            return False
        known.add(left + right)
    return True


class Transducer:
    """Encoder and decoder for one vocabulary file with byte symbols and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = byte_alphabet()
        if not is_proper(merges, [x + e for x in letters for e in ("", END)]):
            raise ValueError("a merge comes before its parts; no lookahead is known")
        self.lookahead = sufficient_lookahead(merges)
        self.buffer = 4 * self.lookahead + 64
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + END] for x in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in (self.vocab | self.special).items()}
        self.base = max(self.strings) + 1
        self.rank = {self.vocab[a] * self.base + self.vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.width = {i: len(t.removesuffix(END)) for i, t in self.strings.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes = {i: b"\x20" if t == "" else bytes(byte_of[c] for c in t.removesuffix(END)) + (b" " if t.endswith(END) else b"") for t, i in self.vocab.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self._words: dict[str, tuple[str, int, str, tuple[int, ...]]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of one buffer, by rank and from the left; ids is used up."""
        if len(ids) > 64:
            return self._merge_long(ids)
        get, base, made = self.rank.get, self.base, self.made
        ranks = [get(a * base + b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * base + ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] * base + ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, base, n = self.rank, self.base, len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] * base + ids[i + 1], NEVER)) < NEVER]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i] if i < n else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := rank.get(ids[i] * base + ids[after[i]], NEVER)) < NEVER:
                    heapq.heappush(queue, (q, i, ids[i], ids[after[i]]))
            if (h := before[i]) >= 0 and (q := rank.get(ids[h] * base + ids[i], NEVER)) < NEVER:
                heapq.heappush(queue, (q, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: bytes) -> Iterator[int]:
        """Tokens of one word; each is emitted once no further byte can change it."""
        inner, n, start = self.inner, len(word), 0
        while n - start > self.buffer:
            stop, end = start + self.buffer, start
            settled = stop - self.lookahead
            for token in self.merge([inner[b] for b in word[start:stop]]):
                end += self.width[token]
                if end > settled:
                    break
                yield token
                start = end
        if n > start:
            yield from self.merge([*(inner[b] for b in word[start : n - 1]), self.final[word[n - 1]]])

    def forget(self) -> None:
        """Empty the cache of words, so that an idle worker holds no memory."""
        self._words.clear()

    def encode(self, text: str) -> Iterator[int]:
        """Tokens of a whole text, in stretches of bounded length."""
        for kind, part in self._parts(text):
            if kind:
                yield self.special[part]
            else:
                for piece in self._pieces(part):
                    yield from (self._words.get(piece) or self._rendered(piece))[3]

    def _parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special tokens (true) and stretches of ordinary text between them, cut at white space."""
        at, hits = 0, self.cut.finditer(text) if self.cut and "<|" in text else ()
        for hit in hits:
            yield from ((False, x) for x in _stretches(text, at, hit.start()))
            yield True, hit.group()
            at = hit.end()
        yield from ((False, x) for x in _stretches(text, at, len(text)))

    def _pieces(self, stretch: str) -> list[str]:
        if stretch.isascii():
            return _ASCII_PIECES.findall(stretch.lower())
        small = unicodedata.normalize("NFC", stretch).replace("Σ", "σ").lower()
        if not _BEYOND.search(small):
            return _COMMON_PIECES.findall(small)
        return _PIECES.findall(small.translate(SMALL) if _CAPITAL.search(small) else small)

    def _rendered(self, piece: str) -> tuple[str, int, str, tuple[int, ...]]:
        ids = (*self.encode_word(piece.encode("utf-8", "replace")),)
        made = (" ".join(map(str, ids)), len(ids), "".join(TokenDecoder(self).feed(ids)), ids)
        if len(piece) <= 64:
            if len(self._words) >= CACHE:
                self._words.clear()
            self._words[piece] = made
        return made

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and the digests of the ids and of the decoded text."""
        ids, decoded, n, known = hashlib.sha256(), hashlib.sha256(), 0, self._words
        for kind, part in self._parts(text):
            if kind:
                made = [(str(self.special[part]), 1, part)]
            else:
                made = [known.get(piece) or self._rendered(piece) for piece in self._pieces(part)]
            if made:
                gap = " " if n else ""
                ids.update((gap + " ".join([x[0] for x in made])).encode())
                decoded.update((gap + " ".join([x[2] for x in made])).encode())
                n += sum([x[1] for x in made])
        return n, ids.hexdigest(), decoded.hexdigest()


def _stretches(text: str, start: int, stop: int) -> Iterator[str]:
    """The text in stretches of about SEGMENT characters that end before white space."""
    while start < stop:
        end = min(stop, start + SEGMENT)
        if end < stop:
            space = _SPACE.search(text, end, stop)
            end = space.start() if space else stop
        yield text[start:end]
        start = end


class TokenDecoder:
    """The library's text for a vocabulary without decoder: token strings with one space between, piece by piece."""

    def __init__(self, coder: Transducer):
        self.strings, self.begun = coder.strings, False

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            yield (" " if self.begun else "") + self.strings[i]
            self.begun = True


class TextDecoder:
    """Bytes of the tokens as readable text; an incomplete UTF-8 sequence waits for its rest."""

    def __init__(self, coder: Transducer):
        self.bytes, self.state = coder.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            if text := self.state.decode(self.bytes[i]):
                yield text

    def close(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def coder(name: str) -> Transducer:
    """One per worker, by the name of an installed vocabulary or its path."""
    if "/" in name:
        return Transducer(name)
    import public_tokenizers

    return Transducer(public_tokenizers.path(name))


def encode_digests(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary=VOCABULARY) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no tokens; repeated rows stay; other columns are ignored.
    """

    @releasing
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(vocabulary)
        for text in texts:
            yield pd.DataFrame([own.digest(t or "") for t in text], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    bounded_batches(docs.sparkSession)
    made = F.pandas_udf(digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(id_col, made(text_col).alias("f")).select(id_col, "f.*")


def encode_texts(docs: DataFrame, text_col="text", vocabulary=VOCABULARY) -> DataFrame:
    """The rows of docs with the column ids, array<int>; a column of that name is replaced. Null texts give an empty array."""

    @releasing
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(vocabulary)
        for text in texts:
            yield pd.Series([np.fromiter(own.encode(t or ""), np.int32) for t in text], dtype=object)
        own.forget()

    bounded_batches(docs.sparkSession)
    return docs.withColumn("ids", F.pandas_udf(ids, "array<int>")(text_col))


def _read(machine: TextDecoder, ids: Iterable[int]) -> str:
    return "".join(machine.feed(ids)) + machine.close()


def encode_and_decode(docs: DataFrame, text_col="text", vocabulary=VOCABULARY) -> DataFrame:
    """The rows of docs with ids and decoded, as encode_texts and decode_ids give them, in one pass through Python."""

    @releasing
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(vocabulary)
        for text in texts:
            ids = [np.fromiter(own.encode(t or ""), np.int32) for t in text]
            yield pd.DataFrame({"ids": ids, "decoded": [_read(TextDecoder(own), x.tolist()) for x in ids]})
        own.forget()

    bounded_batches(docs.sparkSession)
    made = docs.select(F.struct(*docs.columns).alias("row"), F.pandas_udf(both, "ids array<int>, decoded string")(text_col).alias("made"))
    return made.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("ids", "decoded")], "made.ids", "made.decoded")


def decode_ids(tokens: DataFrame, ids_col="ids", vocabulary=VOCABULARY) -> DataFrame:
    """The rows of tokens with the column decoded, readable text. Null ids give an empty text."""

    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(vocabulary)
        for batch in batches:
            yield pd.Series([_read(TextDecoder(own), () if ids is None else ids) for ids in batch], dtype=object)

    bounded_batches(tokens.sparkSession)
    return tokens.withColumn("decoded", F.pandas_udf(text, "string")(ids_col))


def op8_bpe(spark, sf_dir):
    """Every text encoded and decoded; the digests of both."""
    return encode_digests(table(spark, sf_dir, "documents"))
