"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The symbols of a word are the leaves' left ends; leaf ``i`` holds the rank of the
pair that starts at symbol ``i`` (none: infinite). Every inner node holds the
least ``(rank, position)`` below it, so the root is the leftmost pair of lowest
rank. One merge changes three leaves, each in logarithmic time, and the loop ends
when the root is infinite: a run of n letters costs O(n log n) however long it is.

The vocabulary file is a parameter (a ``tokenizers`` JSON of kind BPE with a
word-end suffix); it is read where it is, on each worker, and never copied.

Defined results: a null text is an empty text; an empty text has no ids, and both
digests are those of the empty string. Strings of the file's special tokens found
in a text become their ids, as the library does. Rows are kept one for one, so
repeated rows and null ids come back as they are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import arrow_batches


#: Words of one generation of a worker's memory; there are two (results don't change).
CACHE_WORDS = 200_000
_NONE = 1 << 62
#: White space for this kind of file: Unicode's, without the four ASCII separators.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Fixed values of Unicode 16 and 17: capitals (first, last, distance to the small letter).
_NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
#: Letters and numbers (first, last) assigned after Unicode 16. The library's splitter
#: doesn't know them yet, the ``regex`` module does.
_LATER_RANGES = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER_RANGES) + "]")
_LOWER_NEWER = {c: c + step for first, last, step in _NEWER_CAPITALS for c in range(first, last + 1)}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte used by byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = [""] * 256
    for b in shown:
        symbols[b] = chr(b)
    for k, b in enumerate(x for x in range(256) if not symbols[x]):
        symbols[b] = chr(256 + k)
    return symbols


def merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until none is left.

    ``ranks`` has the rank of pair (a, b) at ``a << 20 | b``, ``made`` the symbol that
    a rank's merge makes. The tree is one list: leaf of pair ``i`` at ``width + i``,
    the root at 1; a leaf is ``rank << 32 | i``. ``put`` is written out three times,
    as a call costs more than its work on a short word.
    """
    n = len(symbols)
    if n == 2:
        rank = ranks.get(symbols[0] << 20 | symbols[1])
        return symbols if rank is None else [made[rank]]
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * width)
    rank_of = ranks.get
    left, k, found = symbols[0], width, False
    for right in symbols[1:]:
        rank = rank_of(left << 20 | right)
        if rank is not None:
            tree[k] = rank << 32 | (k - width)
            found = True
        left = right
        k += 1
    if not found:
        return symbols
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    root = tree[1]
    while root != _NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbols[i] = new = made[root >> 32]
        after[i] = k = after[j]
        before[k] = i
        if k < n:  # the pair that began at the absorbed symbol is gone
            at = width + j
            if tree[at] != _NONE:
                tree[at] = _NONE
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    least = a if a < b else b
                    if tree[at] == least:
                        break
                    tree[at] = least
                    at >>= 1
            rank = rank_of(new << 20 | symbols[k])
            value = _NONE if rank is None else rank << 32 | i
        else:
            value = _NONE
        at = width + i
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                break
            tree[at] = least
            at >>= 1
        h = before[i]
        if h >= 0:
            rank = rank_of(symbols[h] << 20 | new)
            value = _NONE if rank is None else rank << 32 | h
            at = width + h
            if tree[at] != value:
                tree[at] = value
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    least = a if a < b else b
                    if tree[at] == least:
                        break
                    tree[at] = least
                    at >>= 1
        root = tree[1]
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splitter, level = spec["pre_tokenizer"]["pretokenizers"]
        known = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and splitter["type"] == "Split"
            and (splitter["behavior"], splitter["invert"]) == ("Removed", True)
            and (level["type"], level["use_regex"], level["add_prefix_space"]) == ("ByteLevel", False, False)
            and model["type"] == "BPE"
            and not model["unk_token"]
            and not model["continuing_subword_prefix"]
            and spec["decoder"] is None
        )
        if not known:
            raise ValueError(f"{path}: a vocabulary of another kind")
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.pattern = regex.compile(splitter["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.digits = [str(i) for i in range(size)]
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def word(self, piece: str) -> list[int]:
        """Ids of one piece without white space, already normalised but for capitals that the interpreter doesn't know."""
        if not piece.isascii():
            piece = piece.translate(_LOWER_NEWER)
        out: list[int] = []
        if piece.isascii():
            parts = [piece] if piece.isalpha() else self.pattern.findall(piece)
        elif _LATER.search(piece):
            # neither letter nor number to the library: a symbol stands in while the piece is cut
            shown = _LATER.sub("\ufffd", piece)
            parts = [piece[m.start() : m.end()] for m in self.pattern.finditer(shown)]
        else:
            parts = self.pattern.findall(piece)
        for part in parts:
            raw = part.encode("utf-8")
            symbols = [self.inner[b] for b in raw[:-1]]
            symbols.append(self.last[raw[-1]])
            out += merged(symbols, self.ranks, self.made) if len(symbols) > 1 else symbols
        return out

    def plain(self, text: str) -> list[int]:
        """Ids of a text that holds no special token's string."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        pieces = _SPACE.split(text) if _SEPARATORS.search(text) else text.split()
        young, out = self.young, []
        for piece in pieces:
            ids = young.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    ids = self.word(piece)
                if len(piece) <= 64:
                    if len(young) >= CACHE_WORDS:  # what is wanted again comes back from the old generation
                        self.old, self.young = young, {}
                        young = self.young
                    young[piece] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special_at is None or not self.special_at.search(text):
            return self.plain(text)
        out: list[int] = []
        for k, part in enumerate(self.special_at.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: this kind of file has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def ids_text(self, ids: list[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``doc_id, ids array<int>, decoded string`` for every row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode then decode every text; return ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.ids_text(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
