"""Cases that an operator once left out, each against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from spanforge.llm import licenses, line_dedup, minhash_dedup, quality_fm, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def _grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", minhash_dedup.ascii_lower(text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def _roots(rows, link):
    """The least id of each group of linked texts, over all pairs of whole sets."""
    sets, root = {i: _grams(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= link * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


def _edited(rng, words, places):
    out = list(words)
    for k in places:
        out[k] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_licence_texts_and_near_misses():
    """Recall 1 on sentences of licences as these write them, no label on texts that only resemble them."""
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or any later version."
    found = {
        gnu.format("", 3): "gpl-3", gnu.format("", 2): "gpl-2", gnu.format("Lesser ", "2.1"): "lgpl-2.1", gnu.format("Affero ", 3): "agpl-3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
        "for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"": "bsd-0.clause",
        "Neither the name of the copyright holder nor the names of its\n * contributors may be used to endorse or promote products": "bsd-3.clause",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-4.clause",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache-2.0",
        "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0", "https://opensource.org/licenses/MIT": "mit", "https://www.gnu.org/licenses/gpl-3.0.html": "gpl-3",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        "This is free and unencumbered software released into the public domain.": "unlicense", "The Software shall be used for Good, not Evil.": "json", "with the Classpath exception": "exception:classpath",
        "Llama 3.1 Community License Agreement": "llama", "Business Source License 1.1": "busl", "For academic use only.": "research-only", "Unauthorized copying of this file": "reserved",
        "Creative Commons Attribution-NonCommercial-NoDerivs": "cc-by-nc-nd", "the European Union Public Licence v1.2": "eupl-1.2",
    }
    missing = {t: licenses.scan(t)[5] for t, label in found.items() if label not in licenses.scan(t)[5].split(",")}
    assert not missing
    plain = (
        "the general opened the public library", "he has a driving license", "rights and reserved seats", "permission to leave was granted free of any charge", "a committee with a limit",
        "apache tribes of the west", "the mozilla foundation", "an eclipse in public", "zlib compresses", "we distribute software for any purpose", "the gnu is an antelope", "creative people in common rooms",
        "boost your software", "the isc meets today", "an artistic impression", "the source code of life", "python is a snake", "as published by the free press", "copied by hand", "a property of water",
    )
    assert [t for t in plain if licenses.scan(t)[5]] == []


def test_pipeline_links_copies_from_eighty_percent(spark):
    """Two edits far apart in 104 words leave 90 of 110 shingles: 0.82."""
    import corpus_pipeline

    rng, rows = random.Random(21), []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, _edited(rng, words, (30, 70))), (10 * k + 2, _edited(rng, words, (20, 50, 80)))]
    for link in (80, 85):
        got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(_docs(spark, rows), link).collect()}
        assert got == _roots(rows, link)
    kept = {r.doc_id for r in corpus_pipeline.near_deduplication(spark, _docs(spark, rows), "").collect()}
    assert kept == {i for i, r in _roots(rows, 80).items() if i == r} and len(kept) == 80
    assert (minhash_dedup.min_matches(85), minhash_dedup.min_matches(80)) == (39, 34)


def _sample(rng, parsed):
    """A random match of a parsed pattern, its edges left out."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "SUBPATTERN":
            out += _sample(rng, arg[3])
        elif op == "BRANCH":
            out += _sample(rng, rng.choice(arg[1]))
        elif op == "MAX_REPEAT":
            out += "".join(_sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        elif op == "IN":
            out += rng.choice(" -") if str(arg[0][0]) == "NEGATE" else chr(rng.randint(*arg[0][1]) if str(arg[0][0]) == "RANGE" else rng.choice(arg)[1])
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_every_rule_is_behind_a_keyword_and_a_gate_it_holds():
    rng = random.Random(2)
    for rule in licenses.rules()[: -len(licenses.SPDX)]:
        for _ in range(4):
            text = _sample(rng, re._parser.parse(rule.pattern.pattern.decode("latin-1")))
            low = text.encode()
            assert rule.pattern.search(low), (rule, text)
            assert rule.keyword in re.sub("[^0-9a-z]+", " ", text), (rule, text)
            assert any(g in text for g in licenses.gates()), (rule, text)


def _naive(low):
    """All rules without keyword or gate; a detection inside another of no lower priority goes."""
    found = [(m.start(), m.end(), r.priority, k) for k, r in enumerate(licenses.rules()[: -len(licenses.SPDX)]) for m in r.pattern.finditer(low)]
    found += [(a, b, licenses.rules()[k].priority, k) for a, b, k in licenses._operands(low)]
    beats = lambda t, s: t[0] <= s[0] and t[1] >= s[1] and t[2] >= s[2] and (t[:2] != s[:2] or t[2] > s[2] or t[3] < s[3])
    return sorted((a, b, licenses.rules()[k].label) for s in found for a, b, _, k in [s] if not any(beats(t, s) for t in found))


def test_detections_by_brute_force():
    """Random matches of random rules among other words, run together, cut short and overlapping."""
    rng, rules = random.Random(12), licenses.rules()[: -len(licenses.SPDX)]
    ids = sorted(licenses.SPDX)
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(6)):
            words = re.findall("[0-9a-z]+", _sample(rng, re._parser.parse(rng.choice(rules).pattern.pattern.decode("latin-1"))))
            words = words[rng.randrange(2) * rng.randrange(3) :]
            parts.append(rng.choice((" ", "-", "\n * ")).join(words))
            parts.append(rng.choice(("", "the", "plain words between", "gnu", "license", "é", f"spdx-license-identifier: {rng.choice(ids)} or {rng.choice(ids)}")))
        low = rng.choice((" ", ". ", "")).join(parts).encode()
        assert sorted((a, b, r.label) for a, b, r in licenses.detect(low)) == _naive(low), low


@pytest.mark.parametrize(
    "text, labels",
    [
        ("berkeley software distribution license", "bsd"),
        ("internet systems consortium license", "isc"),
        ("creative commons zero", "cc0"),
        ("confidential and confidential", "proprietary"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", "apache-2.0"),
        ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3.clause"),
        ("SPDX-License-Identifier: BSD-3-Clause-Clear", "bsd-3.clause-clear"),
        ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        ("<!-- SPDX-License-Identifier: (MIT-0 OR LGPL-2.1+) AND GPL-2.0-only WITH Classpath-exception-2.0 -->", "exception:classpath,gpl-2,lgpl-2.1,mit-0"),
        ("SPDX-License-Identifier: MIT\nisc is not named here", "mit"),
        ("BSD 3-Clause License", "bsd-3.clause"),
        ("under the 2-clause BSD license", "bsd-2.clause"),
        ("The GNU GPLv3, or LGPLv2.1, or AGPL-3.0", "agpl-3,gpl-3,lgpl-2.1"),
        ("GNU General Public License v3.0", "gpl,gpl-3"),
        ("Apache License v2.0", "apache-2.0"),
        ("mit is a German word, as isc is none", ""),
    ],
)
def test_licence_names(text, labels):
    assert licenses.scan(text)[5] == labels


def test_boilerplate_goes_from_every_page(spark):
    """A long template around one own line; a page of the template alone becomes empty."""
    import corpus_pipeline

    menu = ["Home and news and weather and sport and all the rest", "Copyright of this site by its owners and nobody else"]
    rows = [(k, "\n".join([menu[0], f"own {k}", menu[1]])) for k in range(30)] + [(100 + k, "\n".join([*menu, menu[0]])) for k in range(3)] + [(200, menu[0]), (201, None)]
    docs = _docs(spark, rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert got == {i: (f"own {i}", len(f"own {i}")) if i < 100 else (None, None) if t is None else ("", 0) for i, t in rows}


def test_copies_of_a_page_are_one_page(spark, monkeypatch):
    """40 rows repeat a text: its lines stand on one page, and no page is emptied."""
    copy = "a line of the copied text\nanother line of it\nand a third"
    rows = [(k, copy) for k in range(40)] + [(100 + k, f"own {k}\nshared line") for k in range(4)]
    assert {r.text for r in line_dedup.drop_boilerplate(_docs(spark, rows)).collect()} == {t for _, t in rows}
    rows += [(200, "own 4\nshared line ")]
    want = sorted([copy] * 40 + [f"own {k}" for k in range(5)])
    for limits in ((line_dedup.BROADCAST_LINES, line_dedup.ROWS_A_KEY), (0, 3)):
        for name, limit in zip(("BROADCAST_LINES", "ROWS_A_KEY"), limits, strict=True):
            monkeypatch.setattr(line_dedup, name, limit)
        assert sorted(r.text for r in line_dedup.drop_boilerplate(_docs(spark, rows)).collect()) == want


def test_url_models_read_query_and_fragment(spark):
    rows = [(k, f"http://good{k}.com/find?q=science-articles#{k}") for k in range(150)] + [(500 + k, f"http://bad{k}.net/es/find?q=casino-bonus#{k}") for k in range(150)]
    rows += [(2000, "http://u.org/find?q=science-articles"), (2001, "http://u.org/find?q=casino-bonus"), (2002, "u.org/find?q=casino-bonus"), (2003, "u.org/find#casino-bonus\n"), (2004, ""), (2005, None), (2006, "http://")]
    found = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(found) == len(rows) and [found[k].verdict for k in range(2000, 2007)] == ["allow", "block", "block", "block", "allow", "allow", "allow"]
    assert (found[2000].host, found[2000].path) == (found[2001].host, found[2001].path) and found[2002].score is not None
    assert [found[k].score for k in (2004, 2005, 2006)] == [None] * 3


def _without_template(rows):
    """``doc_id: text``; rows: ``doc_id, text, source``."""
    bare = lambda x: x.strip(" \t\r")
    texts = {(s, t) for _, t, s in rows}
    pages, held = Counter(s for s, _ in texts), Counter((s, x) for s, t in texts for x in {bare(y) for y in t.split("\n")} - {""})
    out = {}
    for i, t, s in rows:
        bad = {x for h, x in held if h == s and held[h, x] >= 5 and held[h, x] > 0.01 * pages[s]}
        out[i] = "\n".join(x for x in t.split("\n") if bare(x) not in bad)
    return out


def test_pipeline_rows_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from spanforge.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    menu, items = "menu of the site with many entries", [(k, " ".join(words(30))) for k in range(6)]
    rows = []
    for k in range(60):
        base = words(104)
        rows += [(10 * k, " ".join(base)), (10 * k + 1, f"{menu}\n" + " ".join(base)), (10 * k + 2, _edited(rng, base, (30, 70))), (10 * k + 3, _edited(rng, base, (20, 50, 80)))]
        rows.append((10 * k + 4, "#$% *** " * rng.randrange(20, 60)))
        rows.append((10 * k + 5, " ".join(words(40) + items[k % 6][1].split()[: 24 + k % 7] + words(40))))
    rows = [(i, t, f"s{i % 2}") for i, t in rows]
    labels = [(i, int("***" not in t), 0) for i, t, _ in rows]
    tables = {"documents": ([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (items, "item_id long, text string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_fm.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = [r for r in rows if model.score(r[1], len(r[1])) >= quality_fm.THRESHOLD]
    texts = _without_template(good)
    alone = {i: r for i, r in _roots(sorted(texts.items()), 80).items() if i == r}
    clean = {i: texts[i] for i in alone if not any(100 * len(_grams(t) & _grams(texts[i])) >= 80 * len(_grams(t)) for _, t in items)}
    assert len(rows) > len(good) > len(alone) > len(clean) > 0 and any(texts[i] != t for i, t, _ in good)
    lib, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}
    for i, t in clean.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(found) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256) for r in found} == want
