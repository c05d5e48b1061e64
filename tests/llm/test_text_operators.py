"""Operators on documents: odd rows, and brute force where SQL can't say it."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from spanforge.llm import bpe, chat_format, licenses, line_dedup, quality_fm, quality_rules, wavelet
from spanforge.llm.queries import tokenizer_path

ODD = [
    (1, "The cat sat on the mat.\nAll rights reserved.", "en", "a", 43),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", "a", 4),
    (None, "orphan words here <|endoftext|> x", "fr", None, 5),
    (5, "word " * 30_000, "en", "a", 150_000),
    (5, "word " * 30_000, "en", "a", 150_000),
    (6, "a" * 5_000, "de", "b", 5_000),
    (7, "Größe İΣ café 日本語 🎉\r\nline\x0btwo cc BY", "de", "b", 3),
    (8, "one two three four", "en", "b", 18),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bad string, score double, host string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 0.5, "h") for r in ODD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def _texts(seed, n, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_bpe_equals_the_library():
    path, own = tokenizer_path("word_bpe_49k.json"), None
    own, lib = bpe.load(path), _tokenizer("word_bpe_49k.json")
    for text in [t or "" for _, t, *_ in ODD] + _texts(1, 400, "abcdeAB 'ts1é.\n\x1c") + ["<|startoftext|>a<|endoftext|>", "ΑΣ ﬁ ẞ é", "ab" * 3000]:
        want = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_bpe_rows(odd, empty):
    path, lib = tokenizer_path("word_bpe_49k.json"), _tokenizer("word_bpe_49k.json")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256) for r in bpe.digest_documents(odd, path).collect())
    want = []
    for i, text, *_ in ODD:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digest_documents(empty, path).count() == 0
    assert {len(r.ids) for r in bpe.encode_documents(odd, path).where("doc_id = 3").collect()} == {0}


def test_merge_order_is_leftmost_lowest():
    ranks = {1 << 20 | 1: 1, 1 << 20 | 2: 0, 3 << 20 | 3: 2}
    assert bpe.merged([1, 1, 1, 2], ranks, [4, 3, 5]) == [3, 4]
    assert bpe.merged([1, 1, 1, 1], ranks, [4, 3, 5]) == [5]
    assert bpe.merged([2, 2], ranks, [4, 3, 5]) == [2, 2]


def test_wavelet_answers():
    rng = np.random.default_rng(3)
    for symbols in (rng.integers(0, 90, 3000), np.zeros(5, int), np.array([70_000, 1, 70_000]), np.zeros(0, int)):
        m = wavelet.WaveletMatrix.build(symbols.astype(np.uint32))
        assert (m.symbols() == symbols).all()
        for i in range(0, len(symbols), 101):
            assert m.access(i) == symbols[i]
        for s in {*symbols[:20].tolist(), 12345}:
            places = np.flatnonzero(symbols == s).tolist()
            assert m.occurrences(s) == places
            assert m.count(s) == len(places)
            assert m.rank(s, len(symbols) // 2) == sum(p < len(symbols) // 2 for p in places)


def test_lookups_read_the_file_and_not_all_planes():
    rng = np.random.default_rng(9)
    symbols = np.concatenate([rng.integers(0, 50_000, 300_000), np.repeat(7, 1000), rng.integers(0, 9, 100_001)]).astype(np.uint32)
    lengths = [len(symbols) - 5, 0, 5]
    blob = wavelet.write_shard([1, 2, None], lengths, symbols)
    levels = int(symbols.max()).bit_length()
    for i in rng.integers(0, len(symbols), 40).tolist():
        shard = wavelet.Shard(blob)
        assert shard.matrix.access(i) == symbols[i] and shard.expanded <= levels
    shard = wavelet.Shard(blob)
    assert shard.matrix.count(7) == int((symbols == 7).sum()) and shard.expanded <= 2 * levels < shard.matrix.chunks * levels
    for s in (7, int(symbols[0]), 49_999, 60_000, 1 << 20):
        places = np.flatnonzero(symbols == s)
        assert shard.matrix.occurrences(s)[:200] == places[:200].tolist()
        lo, hi = np.sort(rng.integers(0, len(symbols) + 1, (2, 300)), 0)
        assert shard.matrix.counts(s, lo, hi).tolist() == [int(((places >= a) & (places < b)).sum()) for a, b in zip(lo, hi, strict=True)]
    assert (shard.matrix.symbols() == symbols).all()
    with pytest.raises(IndexError):
        shard.matrix.access(len(symbols))


def test_an_id_of_many_rows_has_ranges_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "RANGE_ROWS", 10)
    rng = random.Random(3)
    rows = [(7, f"text {rng.randrange(10**6)}") for _ in range(300)] + [(k, f"other {k}") for k in range(200)] + [(None, f"lost {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ranges = wavelet.Ranges.of(docs)
    numbers = [ranges.number(i, d) for i in (6, 7, 8, None) for d in (0, 1 << 30, (1 << 32) - 1)]
    assert numbers == sorted(numbers) and len(set(numbers[3:6])) == 3 and len(set(numbers[9:])) == 3
    found = sorted(wavelet.read_documents(wavelet.write_shards(docs, tokenizer_path("byte_bpe_50k.json"), 2), 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows if i is not None) + [None] * 100
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:k]) for k in range(len(found))] and all(r.n_symbol == 1 for r in found)
    assert len({r.ids_crc32 for r in found if r.doc_id == 7}) > 250


def test_wavelet_file_is_checked():
    blob = wavelet.write_shard([4, None], [2, 0], np.array([9, 8], np.uint32))
    shard = wavelet.Shard(blob)
    assert [(i, at, x.tolist()) for i, at, x in shard.documents()] == [(4, 0, [9, 8]), (None, 2, [])]
    with pytest.raises(ValueError):
        wavelet.Shard(blob[:-1])


def test_pieces_equal_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    own, lib = wavelet.PieceEncoder(path), _tokenizer("byte_bpe_50k.json")
    texts = [t or "" for _, t, *_ in ODD] + _texts(2, 2000, "ab'. \n\t1é ​,!") + ["a<|endoftext|>b", "it's  I'LL", "x\x01y"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids


def test_shards_round_trip(odd, empty, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 500)
    monkeypatch.setattr(wavelet, "RANGE_ROWS", 3)
    path, lib = tokenizer_path("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.json")
    shards = wavelet.write_shards(odd, path, 2)
    assert shards.count() > 2
    got = sorted(((r.doc_id if r.doc_id is not None else 99), r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(shards, 2).collect())
    at, want = 0, []
    for i, text, *_ in sorted(ODD, key=lambda r: 99 if r[0] is None else r[0]):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((99 if i is None else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert wavelet.read_documents(wavelet.write_shards(empty, path, 2), 2).count() == 0


def test_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(5)
    wide = quality_fm.BUCKETS + len(quality_fm._STATS)
    m = quality_fm.FactorisationMachine(0.1, rng.normal(size=wide).astype(np.float32), rng.normal(size=(wide, 3)).astype(np.float32), np.zeros(len(quality_fm._STATS)), np.ones(len(quality_fm._STATS)))
    buckets, weights, stats = quality_fm.features("a few words here, a few", 23)
    x = np.zeros(wide)
    np.add.at(x, buckets, weights)
    x[quality_fm.BUCKETS :] = m.dense(np.array(stats))
    want = m.bias + m.linear @ x + sum(float(m.factors[i] @ m.factors[j]) * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
    assert abs(m.logit(buckets, weights, stats) - want) < 1e-3


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (8, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality_fm.fit(odd, labels)
    rows = quality_fm.score_documents(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = {r.doc_id: r.held_out for r in rows}
    assert all(v == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, v in held.items())
    kept = quality_fm.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)
    prior = quality_fm.fit(empty, labels.where("false"))
    assert {round(r.score, 6) for r in quality_fm.score_documents(odd, prior).collect()} == {0.5}
    assert quality_fm.score_documents(empty, prior).count() == 0


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality_fm.score_documents(docs, quality_fm.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) / len(scored) > 0.95


def test_repeated_words_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randrange(40))]
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        assert quality_rules.repeated_words(words) == len(covered)
    wide = [str(i % 9000) for i in range(20_000)]
    assert quality_rules.repeated_words(wide) == 20_000


def test_rules_odd_rows(odd, empty):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.judge(odd).collect()}
    assert rows[2, 0].base_failed and not rows[2, 0].kept
    assert rows[8, 4].base_failed and rows[5, 30_000].n_repeat_words == 30_000
    assert quality_rules.judge(odd).count() == len(ODD)
    assert quality_rules.judge(empty).count() == 0


def test_adaptive_fences(spark):
    rows = [(i, "plain words make a text of more than ten words in all " + "extra " * (i % 7), "en", f"s{i % 3}", 1) for i in range(400)]
    rows += [(1000 + i, "noisy### words$$$ make*** a%%% text&&& of||| more### than$$$ ten%%% words### in$$$ all***", "en", "s0", 1) for i in range(12)]
    found = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(found[i].kept or found[i].base_failed for i in range(400))
    assert all("symbol_rate" in found[1000 + i].failed_rates for i in range(12))


def test_fences_belong_to_groups(spark, monkeypatch):
    """Sources of their own habits: what is usual in one is past the fence of another; junk sets no fence."""
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    marked = lambda n, k, mark: " ".join(f"w{rng.randrange(10**5)}{mark * (i < k)}" for i in range(n))
    rows = [(i, line(60), "en", "prose", 1) for i in range(1500)]
    rows += [(2000 + i, marked(60, rng.randrange(8, 13), "&"), "en", "code", 1) for i in range(700)]
    rows += [(3000 + i, marked(30, 30, "#$#$%"), "en", "prose" if i % 3 else "code", 1) for i in range(120)]
    rows += [(4000, marked(60, 30, "&"), "en", "prose", 1), (4001, line(60), None, None, 1), (4002, line(60), "en", "tiny", 1), (4003, line(60), "en", "tiny", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for limits in ((quality_rules.BROADCAST_GROUPS, quality_rules.ROWS_A_KEY), (0, 50)):
        for name, limit in zip(("BROADCAST_GROUPS", "ROWS_A_KEY"), limits, strict=True):
            monkeypatch.setattr(quality_rules, name, limit)
        found = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
        assert all(found[i].kept for i in [*range(1500), *range(2000, 2700), 4001, 4002])
        assert all("symbol_rate" in found[3000 + i].failed_rates for i in range(120)) and found[4000].failed_rates == "symbol_rate"
        symbol = {s: int(found[i].fences.split(",")[0]) for s, i in (("prose", 0), ("code", 2000), ("tiny", 4002))}
        assert symbol["prose"] < symbol["code"] and len(set(symbol.values())) == 3
        assert len(found) == len(rows)


def test_sketch_buckets(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 63, 64, 65, 127, 128, 1000, 123_456, 10**9]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(F.col("v")).alias("b")).select("v", "b", quality_rules.bucket_top(F.col("b")).alias("top")).collect()
    assert all(r.v <= r.top <= r.v * 1.04 for r in got)
    assert [r.b for r in got] == sorted(r.b for r in got)


def test_license_scan(odd, empty):
    rows = {r.doc_id: r for r in licenses.scan_documents(odd).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].base_labels) == (1, 6, "reserved")
    assert rows[7].base_labels == "cc-by" and rows[2].n_words == 0 and rows[2].first_word is None and rows[2].score == 0
    assert licenses.scan_documents(empty).count() == 0
    assert licenses.scan("Licensed under the Apache License, Version 2.0.")[5] == "apache-2.0"
    assert licenses.scan("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc-4.0")
    assert len(licenses.rules()) > 300


def test_license_suppression():
    assert licenses.suppressed([(0, 10, 5, 1), (2, 8, 3, 2), (2, 8, 7, 3), (9, 12, 1, 4)]) == [(0, 10, 5, 1), (2, 8, 7, 3), (9, 12, 1, 4)]
    assert licenses.suppressed([]) == []


def test_line_dedup_odd_rows(spark, odd, empty):
    out = line_dedup.drop_boilerplate(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert line_dedup.drop_boilerplate(empty).count() == 0
    pages = [(i, f"Menu home\nunique line {i}\nanother own line {i}\n \nmenu {i}", "en", "site", 9) for i in range(20)] + [(50, "Menu home", "en", "site", 9), (51, "Menu home", "en", "other", 9), (52, None, "en", "site", None)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "doc_id long, text string, lang string, source string, n_chars long"), report=True).collect()}
    assert got[3].text == "unique line 3\nanother own line 3\n \nmenu 3" and got[3].n_chars == len(got[3].text) and got[3].n_dropped == 1
    assert got[50].text == "" and got[51].text == "Menu home" and got[52].text is None and got[52].n_lines == 0
    copies = [(i, "shared one\nshared two\nshared three", "en", None, 9) for i in range(30)]
    whole = line_dedup.drop_boilerplate(spark.createDataFrame(copies, "doc_id long, text string, lang string, source string, n_chars long"), report=True).collect()
    assert all(r.n_dropped == 0 and r.text.startswith("shared one") for r in whole)  # one page, 30 times


def test_line_dedup_without_broadcast(spark, monkeypatch):
    rows = [(i, f"Menu home\nunique line {i}\nanother own line {i}", "en", f"site{i % 2}", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(map(str, line_dedup.drop_boilerplate(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(str, line_dedup.drop_boilerplate(docs).collect())) == want


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi"), (1, 2, "bob", "hi"), (1, 3, None, None), (2, 0, "system", "alone"), (None, None, "ann", "lost")]
    rows = chat_format.perspectives(spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, piece string")).collect()
    assert {(r.conv_id, r.perspective) for r in rows} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    for r in rows:
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",") if s]
        assert [r.text[a:b] for a, b in spans] == [t for c, _, s, t in dict.fromkeys(turns) if c == r.conv_id and (s or "unknown") == r.perspective and t]
        assert r.text.count("<|user name=") == r.n_turns - r.text.count("<|assistant|>") - r.text.count("<|system|>")
    assert chat_format.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversation_comes_in_pieces(spark):
    turns = [(9, k // 3, f"p{k % 2}", f"t{k}") for k in range(500)]
    rows = chat_format.perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).where("perspective = 'p0'").orderBy("piece").collect()
    assert [r.n_turns for r in rows] == [64] * 7 + [52]
    assert sorted(x for r in rows for x in r.text.split("\n") if x.startswith("t")) == sorted(f"t{k}" for k in range(500))


def _view(turns, speaker):
    """Text and mask of one speaker's view, by the definition."""
    text, mask = "", []
    order = sorted(set(turns), key=lambda t: (t[1], hashlib.md5(f"{t[2]}\x1f{t[3]}".encode()).hexdigest()))
    for _, _, who, said in order:
        text += "<|assistant|>\n" if who == speaker else "<|system|>\n" if who == "system" else f"<|user name={who}|>\n"
        if who == speaker and said:
            mask.append(f"{len(text)}-{len(text) + len(said)}")
        text += said + "\n<|end|>\n"
    return text, ",".join(mask)


@pytest.mark.parametrize("n", [3, 64, 65, 500])
def test_whole_dialogues_by_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(chat_format, "BAND", 3)
    monkeypatch.setattr(chat_format, "BLOCK", 128)
    turns = [(9, k // 3, ("ann", "bob", "system", "cy")[k * 7 % 4], f"t{k}" if k % 5 else "") for k in range(n)]
    turns += [(8, 0, "ann", "x" * 100_000), (8, 1, "bob", "short")]
    given = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    of = {c: [t for t in turns if t[0] == c] for c in (8, 9)}
    want = {(c, who): _view(rows, who) for c, rows in of.items() for who in {t[2] for t in rows} - {"system"}}
    assert {(r.conv_id, r.perspective): (r.text, r.mask) for r in chat_format.perspectives(given, whole=True).collect()} == want
    rows = sorted(chat_format.perspectives(given).collect(), key=lambda r: r.piece)
    for key, (text, mask) in want.items():
        own = [r for r in rows if (r.conv_id, r.perspective) == key]
        assert "".join(r.text for r in own) == text and ",".join(r.mask for r in own if r.mask) == mask
        assert [r.start for r in own] == [len("".join(x.text for x in own[:i])) for i in range(len(own))]


def test_bpe_equals_the_library_on_every_code_point():
    from spanforge.llm import bpe
    from spanforge.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    ours, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    for context in ("{}", "a{}b", "1{}{} {}x!"):
        texts = [context.replace("{}", chr(c)) for c in range(0x40000) if not 0xD800 <= c <= 0xDFFF]
        assert [ours.encode(x) for x in texts] == [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
