"""Token ids as one compressed wavelet matrix per shard.

Texts are encoded once, dealt by ranges of ``doc_id`` and sorted there; a task cuts a
shard file whenever it has gathered ``SHARD_TOKENS`` ids, so no shard grows with the
data. A shard file holds bit planes, most significant first. Each plane has its rank
directory (ones before every block of 512 bits) and is compressed in chunks of 8 KB, so
``access``, ``rank``, ``select``, ``count`` and ``occurrences`` read the file itself: a
lookup takes one directory entry and one chunk for each plane, and nothing else is expanded.
Files travel as the ``blob`` column of a table that Spark's writers commit in the shared
folder, so any store that Spark reaches will do.

File layout, little-endian::

    4s magic 'SFWM' | u32 version | u32 levels | u64 n_tokens | u64 n_docs | u32 crc32 of the rest
    levels x u64 zeros                      symbols with a 0 in that plane
    3 x u64                                 length of each zstd block of the documents
    levels x (blocks + 1) x u32             rank directories
    levels x chunks x u32                   length of each zstd chunk of a plane
    zstd: doc ids, i64 | zstd: 1 byte a doc, id is null | zstd: lengths, u32
    chunks, plane by plane: bits, packed, most significant bit first

Defined results: a null text is an empty text and has only the end id; ties of doc_id stand
side by side, ordered by the digest of their ids (repeated rows are alike); rows with a null
doc_id come last. An id that very many rows share is dealt over several ranges, by that
digest. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array as array_of_u32
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import arrow_batches, published

#: Ids of one shard, about; the last document of a shard is never split.
SHARD_TOKENS = 1 << 20
#: Rows of one range of doc ids: the unit that is dealt out and sorted.
RANGE_ROWS = 2000
#: Most ranges: their bounds are known to the driver. Beyond, ranges get longer and every range
#: is a task of its own, which sorts on disk and cuts shards as it goes.
RANGES = 20_000
#: Pieces of one generation of a worker's memory; there are two.
CACHE_PIECES = 600_000
#: Unknown pieces that are encoded as one text.
LINE_PIECES = 12
#: Characters of one group of texts encoded together.
GROUP_CHARS = 8 << 20
_TAIL = r'(\p{L})([.,;:!?|%$&#*()"]+)( |$)'
#: Marks a piece that no space precedes; texts that hold it are encoded whole.
_FIRST = "\x01"
#: White space other than single spaces and line feeds between non-spaces.
_ODD = r"[\x01\t\r\v\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
_MAGIC, _VERSION, _BLOCK = b"SFWM", 2, 512
#: Blocks of one chunk: 8 KB of bits.
_CHUNK = 128
#: Symbols of one stretch of a partition.
_STRETCH = 1 << 15
_HEAD = struct.Struct("<4sIIQQI")


def _parted(values: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Stable partition: values without the bit, then those with it; by stretches that stay in a core's cache."""
    out, low, high = np.empty_like(values), 0, len(values) - int(np.count_nonzero(bit))
    for k in range(0, len(values), _STRETCH):
        own, on = values[k : k + _STRETCH], bit[k : k + _STRETCH]
        for at, where in ((low, np.flatnonzero(~on)), (high, np.flatnonzero(on))):
            out[at : at + len(where)] = own.take(where)
        ones = int(np.count_nonzero(on))
        low, high = low + len(own) - ones, high + ones
    return out


def _unparted(values: np.ndarray, bit: np.ndarray, zeros: int) -> np.ndarray:
    """The order before a stable partition."""
    out, low, high = np.empty_like(values), 0, zeros
    for k in range(0, len(values), _STRETCH):
        own, on = out[k : k + _STRETCH], bit[k : k + _STRETCH]
        ones, off = np.flatnonzero(on), np.flatnonzero(~on)
        own[ones], own[off] = values[high : high + len(ones)], values[low : low + len(off)]
        low, high = low + len(off), high + len(ones)
    return out


class WaveletMatrix:
    """Bit planes of a sequence of unsigned 32-bit symbols, packed, with rank directories."""

    def __init__(self, n: int, zeros: list[int], ones: np.ndarray, chunk: Callable[[int, int], bytes]):
        #: ones[level]: set bits before each block; chunk(level, k): the packed bytes of a chunk.
        self.n, self.zeros, self.ones, self._chunk = n, zeros, ones, chunk

    @classmethod
    def build(cls, symbols: np.ndarray) -> WaveletMatrix:
        symbols = np.asarray(symbols)
        n = len(symbols)
        levels = max(1, int(symbols.max()).bit_length()) if n else 1
        rest = symbols.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, packed = [], []
        for shift in range(levels - 1, -1, -1):
            bit = (rest & rest.dtype.type(1 << shift)) != 0
            packed.append(np.packbits(bit))
            zeros.append(n - int(np.count_nonzero(bit)))
            rest = _parted(rest, bit)
        blocks = -(-n // _BLOCK)
        held = np.zeros((levels, blocks + 1), "<u4")
        for level, plane in enumerate(packed):
            whole = np.zeros(blocks * _BLOCK // 8, np.uint8)
            whole[: len(plane)] = plane
            held[level, 1:] = np.cumsum(np.bitwise_count(whole.reshape(blocks, _BLOCK // 8)).sum(1, dtype=np.uint32))
        size = _CHUNK * _BLOCK // 8
        return cls(n, zeros, held, lambda level, k: packed[level][k * size : (k + 1) * size].tobytes())

    @property
    def chunks(self) -> int:
        return -(-self.n // (_CHUNK * _BLOCK))

    def _bytes(self, level: int, k: int) -> np.ndarray:
        """The bytes of a chunk, one row for each block."""
        raw = np.frombuffer(self._chunk(level, k), np.uint8)
        if len(raw) % (_BLOCK // 8):
            raw = np.concatenate([raw, np.zeros(-len(raw) % (_BLOCK // 8), np.uint8)])
        return raw.reshape(-1, _BLOCK // 8)

    def symbols(self) -> np.ndarray:
        """The whole sequence: undo the stable partitions from the last plane up."""
        if not self.n:
            return np.zeros(0, np.uint32)
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for shift, level in enumerate(range(len(self.zeros) - 1, -1, -1)):
            raw = b"".join(self._chunk(level, k) for k in range(self.chunks))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            zeros = self.zeros[level]
            values[zeros:] |= kind(1 << shift)
            values = _unparted(values, bit, zeros)
        return values.astype(np.uint32)

    def _ranks(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position: the directory's count, then the rest of a block."""
        block, rest = at // _BLOCK, at % _BLOCK
        found = self.ones[level][block].astype(np.int64)
        inside = rest > 0
        for k in np.unique(block[inside] // _CHUNK).tolist():
            own = np.flatnonzero(inside & (block // _CHUNK == k))
            rows = self._bytes(level, k)[block[own] % _CHUNK]
            whole, odd = rest[own] // 8, rest[own] % 8
            counts = np.bitwise_count(rows).astype(np.int64)
            found[own] += np.where(np.arange(_BLOCK // 8) < whole[:, None], counts, 0).sum(1)
            found[own] += np.bitwise_count(rows[np.arange(len(own)), np.minimum(whole, _BLOCK // 8 - 1)] >> (8 - odd).astype(np.uint8))
        return found

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane: search the directory, then one block."""
        ones = self.ones[level].astype(np.int64)
        upto = ones if bit else np.arange(len(ones)) * _BLOCK - ones
        block = int(np.searchsorted(upto, k, side="right")) - 1
        bits = np.unpackbits(self._bytes(level, block // _CHUNK)[block % _CHUNK])
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(upto[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            before, upto = self._ranks(level, np.array([i, i + 1])).tolist()
            bit = upto - before
            value = value << 1 | bit
            i = zeros + before if bit else i - before
        return value

    def _spans(self, symbol: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbol's occurrences in each [lo, hi) lie below the last plane."""
        levels = len(self.zeros)
        if symbol < 0 or symbol >> levels:
            return np.zeros_like(lo), np.zeros_like(lo)
        for level, zeros in enumerate(self.zeros):
            ranks = self._ranks(level, np.concatenate([lo, hi]))
            a, b = ranks[: len(lo)], ranks[len(lo) :]
            lo, hi = (zeros + a, zeros + b) if symbol >> (levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def counts(self, symbol: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Occurrences in each of many ranges [lo, hi)."""
        lo, hi = self._spans(symbol, np.asarray(lo, np.int64), np.asarray(hi, np.int64))
        return hi - lo

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        lo, hi = max(lo, 0), self.n if hi is None else min(hi, self.n)
        return int(self.counts(symbol, np.array([lo]), np.array([hi]))[0]) if lo < hi else 0

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences before position ``i``."""
        return self.count(symbol, 0, i)

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        lo, hi = (int(x[0]) for x in self._spans(symbol, np.zeros(1, np.int64), np.array([self.n])))
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = symbol >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]


def write_shard(doc_ids: list[int | None], lengths: list[int], symbols: np.ndarray) -> bytes:
    """The bytes of one shard file."""
    matrix = WaveletMatrix.build(symbols)
    levels = range(len(matrix.zeros))
    press = zstandard.ZstdCompressor(level=1).compress
    blocks = [press(x) for x in (np.array([i or 0 for i in doc_ids], "<i8").tobytes(), bytes(i is None for i in doc_ids), np.array(lengths, "<u4").tobytes())]
    chunks = [press(matrix._chunk(level, k)) for level in levels for k in range(matrix.chunks)]
    tables = [struct.pack(f"<{len(matrix.zeros)}Q", *matrix.zeros), struct.pack("<3Q", *map(len, blocks)), matrix.ones.tobytes(), np.array([len(x) for x in chunks], "<u4").tobytes()]
    rest = b"".join([*tables, *blocks, *chunks])
    return _HEAD.pack(_MAGIC, _VERSION, len(matrix.zeros), len(symbols), len(doc_ids), zlib.crc32(rest)) + rest


class Shard:
    """A shard file opened for reading: only its tables of documents are expanded."""

    def __init__(self, blob: bytes):
        magic, version, levels, n, docs, crc = _HEAD.unpack_from(blob)
        if (magic, version) != (_MAGIC, _VERSION) or zlib.crc32(memoryview(blob)[_HEAD.size :]) != crc:
            raise ValueError("not a whole shard file")
        at = _HEAD.size
        zeros = list(struct.unpack_from(f"<{levels}Q", blob, at))
        sizes = struct.unpack_from("<3Q", blob, at + 8 * levels)
        at += 8 * levels + 24
        blocks, chunks = -(-n // _BLOCK) + 1, -(-n // (_CHUNK * _BLOCK))
        ones = np.frombuffer(blob, "<u4", levels * blocks, at).reshape(levels, blocks)
        at += 4 * levels * blocks
        lengths = np.frombuffer(blob, "<u4", levels * chunks, at).astype(np.int64)
        at += 4 * levels * chunks
        self._unpress = zstandard.ZstdDecompressor().decompress
        parts = []
        for size in sizes:
            parts.append(self._unpress(blob[at : at + size]) if size else b"")
            at += size
        ends = at + np.cumsum(lengths)
        self.doc_ids = [None if x else int(i) for i, x in zip(np.frombuffer(parts[0], "<i8"), parts[1], strict=True)]
        self.lengths = np.frombuffer(parts[2], "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.expanded = 0
        assert docs == len(self.doc_ids)

        def chunk(level: int, k: int) -> bytes:
            self.expanded += 1
            j = level * chunks + k
            return self._unpress(blob[ends[j] - lengths[j] : ends[j]])

        self.matrix = WaveletMatrix(n, zeros, ones, lru_cache(maxsize=64)(chunk))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first position in the shard, its ids), in the file's order."""
        symbols = self.matrix.symbols()
        for k, i in enumerate(self.doc_ids):
            yield i, int(self.starts[k]), symbols[self.starts[k] : self.starts[k + 1]]


class PieceEncoder:
    """The tokenizers library behind a memory of pieces.

    A byte-level file splits text by a pattern whose matches never cross a place between
    a non-space and one space or line feed that a non-space follows, so pieces cut there
    can be encoded alone. Texts with other white space go to the library whole.

    Arrow cuts the texts of a batch and numbers their distinct pieces, Python looks up one
    entry for each distinct piece, and numpy lays the ids out: nothing is done word by word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        level = self.tokenizer.pre_tokenizer.__getstate__().decode()
        plain = '"ByteLevel"' in level and '"add_prefix_space":false' in level and '"use_regex":true' in level and self.tokenizer.normalizer is None
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.cuts = plain and not any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added)
        self.odd = "|".join([_ODD, *(re.escape(x.content) for x in added)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Ids travel as 16 bits where all fit.
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), *self.tokenizer.get_added_tokens_decoder(), 0) <= 1 << 16 else "<u4"
        line = self._whole(["\n"])[0]
        #: The id of a line feed: parts pieces that are encoded together.
        self.feed = line[0] if len(line) == 1 else None

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces without line feeds, ``LINE_PIECES`` as lines of one text: a text costs more than a piece.

        A line feed between non-empty pieces is always a match of its own, with an id that no
        other match has, so it parts the ids again; a count that differs sends all to the library alone.
        """
        if self.feed is not None:
            texts = ["\n".join(pieces[k : k + LINE_PIECES]) for k in range(0, len(pieces), LINE_PIECES)]
            ids = np.array([i for x in self._whole(texts) for i in (*x, self.feed)], "<u4")
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) == len(pieces):
                raw, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + 1])
                return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]
        return [array_of_u32("I", x).tobytes() for x in self._whole(pieces)]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, in groups of bounded size."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > GROUP_CHARS:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group) if group else out

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        array = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(array, self.odd).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        odd |= pc.equal(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            if texts[k]:
                out[k] = np.array(self._whole([texts[k]])[0], np.uint32)
        rows = np.flatnonzero(~odd)
        if not len(rows):
            return out
        # A piece after a space stands for itself with that space; one after a line feed, or
        # the first, is marked instead.
        empty = pa.scalar("", pa.large_string())
        marked = pc.binary_join_element_wise(empty, pc.replace_substring(array.take(pa.array(rows)), "\n", f" \n {_FIRST}"), pa.scalar(_FIRST, pa.large_string()))
        # Punctuation after a letter is a match of its own: stem and tail become two pieces.
        marked = pc.replace_substring_regex(marked, _TAIL, f"\\1 {_FIRST}\\2\\3")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        packed = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = np.frombuffer(b"".join(packed), np.uint32)
        codes = coded.indices.to_numpy()
        counts = sizes[codes]
        ends = np.cumsum(counts)
        starts = (np.cumsum(sizes) - sizes)[codes]
        laid = ids[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for k, row in enumerate(rows.tolist()):
            out[row] = laid[bounds[k] : bounds[k + 1]]
        return out

    def _known(self, wanted: list[str]) -> list[bytes]:
        """The packed ids of each wanted piece.

        Two generations: a full young one becomes the old one, whose pieces return when
        they are wanted again, so that frequent pieces stay and the size is bounded.
        """
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, wanted))
        new = [k for k, ids in enumerate(found) if ids is None]
        unknown = []
        for k in new:
            ids = old.get(wanted[k])
            if ids is None:
                unknown.append(k)
            else:
                young[wanted[k]] = found[k] = ids
        for at in range(0, len(unknown), 20_000):
            part = unknown[at : at + 20_000]
            plain = [x[1:] if x[0] == _FIRST else " " + x for x in map(wanted.__getitem__, part)]
            single = [k for k, x in zip(part, plain, strict=True) if x == " \n" or not x]
            if single:  # a line feed, or nothing, can't be a line
                for k in single:
                    young[wanted[k]] = found[k] = array_of_u32("I", self._whole(["\n"])[0] if wanted[k] == "\n" else []).tobytes()
                keep = [(k, x) for k, x in zip(part, plain, strict=True) if x and x != " \n"]
                part, plain = [k for k, _ in keep], [x for _, x in keep]
            if part:
                fresh = self._fresh(plain)
                young.update(zip(map(wanted.__getitem__, part), fresh, strict=True))
                for k, ids in zip(part, fresh, strict=True):
                    found[k] = ids
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


_SHARDS = "bucket long, part long, n_docs long, n_tokens long, blob binary"


def write_shards(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, sort and write; return the published table of shard files."""
    spark = docs.sparkSession
    arrow_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = Ranges.of(source)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in own.encode(b.column(1).to_pylist())]
            digest = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            raw = [x.astype(own.kind).tobytes() for x in ids]
            bucket = [ranges.number(i, d) for i, d in zip(b.column(0).to_pylist(), digest, strict=True)]
            yield pa.record_batch([pa.array(bucket, pa.int64()), b.column(0), pa.array(digest, pa.int64()), pa.array(raw, pa.binary())], ["bucket", "doc_id", "digest", "payload"])

    dealt = source.mapInArrow(encode, "bucket long, doc_id long, digest long, payload binary").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges.tasks), "bucket")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        bucket, part, ids, lengths, symbols, total = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            blob = write_shard(ids, lengths, np.concatenate(symbols))
            return pa.record_batch([pa.array([x], kind) for x, kind in ((bucket, pa.int64()), (part, pa.int64()), (len(ids), pa.int64()), (total, pa.int64()), (blob, pa.binary()))], ["bucket", "part", "n_docs", "n_tokens", "blob"])

        for b in batches:
            for key, i, payload in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if ids and (key != bucket or total >= SHARD_TOKENS):
                    yield flush()
                    part = part + 1 if key == bucket else 0
                    ids, lengths, symbols, total = [], [], [], 0
                bucket = key
                own = np.frombuffer(payload, kind)
                ids.append(i)
                lengths.append(len(own))
                symbols.append(own)
                total += len(own)
        if ids:
            yield flush()

    ordered = dealt.sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "digest", "payload")
    return published(ordered.mapInArrow(pack, _SHARDS), "token-shards")


@dataclass(frozen=True)
class Ranges:
    """Consecutive ranges of doc ids, numbered in order; an id with many rows has several of its own."""

    #: Distinct bounds, the number of the range below each, and how many an id that is a bound has.
    bounds: list[int]
    first: list[int]
    own: list[int]
    #: Ranges of rows without an id.
    nulls: int
    tasks: int

    @classmethod
    def of(cls, source: DataFrame) -> Ranges:
        """Bounds from a mergeable quantile summary of one column; a bound met twice is an id that fills ranges."""
        rows, filled = source.agg(F.count("*"), F.count("doc_id")).first()
        ranges = min(RANGES, -(-rows // RANGE_ROWS))
        share = [k / ranges for k in range(1, ranges)]
        found = Counter(source.agg(F.percentile_approx("doc_id", share, 10 * RANGES).alias("c")).first()["c"] or []) if share else {}
        bounds = sorted(found)
        own = [found[x] if found[x] > 1 else 0 for x in bounds]
        first = [0]
        for k in own:
            first.append(first[-1] + 1 + k)
        return cls(bounds, first, own, max(1, -(-(rows - filled) * ranges // max(rows, 1))), min(ranges, -(-rows // (8 * RANGE_ROWS))))

    def number(self, doc_id: int | None, digest: int) -> int:
        """The range of a row; ``digest`` (32 bits) parts the rows of one id."""
        if doc_id is None:
            return self.first[-1] + 1 + (digest * self.nulls >> 32)
        k = bisect_right(self.bounds, doc_id)
        if not k:
            return 0
        if self.bounds[k - 1] == doc_id and self.own[k - 1]:
            return self.first[k - 1] + 1 + (digest * self.own[k - 1] >> 32)
        return self.first[k]


def read_documents(shards: DataFrame, symbol: int) -> DataFrame:
    """Read shard files back: ``doc_id, start, n_tokens, ids_crc32, n_symbol``; the last is counted by rank."""
    arrow_batches(shards.sparkSession)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, part, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = Shard(blob)
                rows = [(i, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, at, ids in shard.documents()]
                columns = [[bucket] * len(rows), [part] * len(rows), *zip(*rows, strict=True), shard.matrix.counts(symbol, shard.starts[:-1], shard.starts[1:])]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["bucket", "part", "doc_id", "at", "n_tokens", "ids_crc32", "n_symbol"])

    rows = shards.select("bucket", "part", "blob").mapInArrow(unpack, "bucket long, part long, doc_id long, at long, n_tokens long, ids_crc32 long, n_symbol long")
    # Offsets by three levels of sums, so that no window grows with the data's size.
    sizes = shards.select("bucket", "part", "n_tokens", F.floor(F.col("bucket") / 1024).alias("band"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    of_band = sizes.groupBy("band").agg(F.sum("n_tokens").alias("n")).select("band", F.coalesce(F.sum("n").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("band_at"))
    of_bucket = sizes.groupBy("band", "bucket").agg(F.sum("n_tokens").alias("n")).select("band", "bucket", F.coalesce(F.sum("n").over(before("band", "bucket")), F.lit(0)).alias("bucket_at"))
    of_part = sizes.select("bucket", "part", F.coalesce(F.sum("n_tokens").over(before("bucket", "part")), F.lit(0)).alias("part_at"))
    offsets = of_part.join(of_bucket, "bucket").join(of_band, "band").select("bucket", "part", (F.col("part_at") + F.col("bucket_at") + F.col("band_at")).alias("offset"))
    return rows.join(offsets, ["bucket", "part"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_symbol")
