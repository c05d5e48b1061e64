"""License scan: ordered signature rules behind a keyword prefilter.

Rules are regular expressions over the lower-cased text, each with a keyword that any
match must hold, a label, a priority and a confidence. A text that holds no gate word is
done after a few substring searches; otherwise one automaton finds the keywords present
and only their rules run. Of overlapping detections, one whose interval lies inside
another's of the same or a higher priority goes (of equal intervals, the one of lower
priority, then the later rule); the labels of the rest, in order, are the result.

The rules, in order: names of licence families in hand-written phrases (tag, notice, grant),
hand-written short names (GPLv3, 3-clause BSD) in the same phrases, then the signatures of
``license_signatures``: texts and headers, further names, addresses, exceptions and statements
of rights. SPDX ids count only inside an SPDX expression, whose operands are found each at its
own place. A rule's keyword is derived from its name or pattern: the longest run of words that
every match holds.

Defined results: a null text is an empty text, with no words, no places and score 0.
Rows are kept one for one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import arrow_batches
from spanforge.llm.license_signatures import EXCEPTIONS, LINKS, NAMES, NOTICES, STATEMENTS, TEXTS


#: Base phrases of the contract and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_GAP = rb"[^0-9a-z\x80-\xff]+"
_EDGE = rb"(?<![0-9a-z\x80-\xff])%s(?![0-9a-z\x80-\xff])"

#: Families: label, names (words; a version follows where one is listed), versions.
FAMILIES = (
    ("apache", ("apache license", "apache software license", "apache licence"), ("2 0", "1 1", "1 0")),
    ("mit", ("mit license", "mit licence", "mit x11 license"), ()),
    ("bsd", ("bsd license", "bsd licence", "berkeley software distribution license"), ("4 clause", "3 clause", "2 clause", "0 clause")),
    ("agpl", ("affero general public license", "gnu affero general public license"), ("3", "1")),
    ("lgpl", ("lesser general public license", "gnu lesser general public license"), ("3", "2 1")),
    ("lgpl", ("library general public license",), ("2",)),
    ("gpl", ("gnu general public license", "general public license", "gnu general public licence"), ("3", "2", "1")),
    ("fdl", ("gnu free documentation license", "free documentation license"), ("1 3", "1 2", "1 1")),
    ("mpl", ("mozilla public license", "mozilla public licence"), ("2 0", "1 1", "1 0")),
    ("epl", ("eclipse public license",), ("2 0", "1 0")),
    ("cddl", ("common development and distribution license",), ("1 1", "1 0")),
    ("eupl", ("european union public licence", "european union public license"), ("1 2", "1 1")),
    ("cpl", ("common public license",), ("1 0",)),
    ("ipl", ("ibm public license",), ("1 0",)),
    ("artistic", ("artistic license", "perl artistic license"), ("2 0", "1 0")),
    ("boost", ("boost software license",), ("1 0",)),
    ("zlib", ("zlib license", "zlib libpng license"), ()),
    ("isc", ("isc license", "internet systems consortium license"), ()),
    ("ncsa", ("university of illinois ncsa open source license", "ncsa open source license"), ()),
    ("psf", ("python software foundation license",), ("2",)),
    ("php", ("php license",), ("3 01", "3 0")),
    ("ofl", ("sil open font license", "open font license"), ("1 1", "1 0")),
    ("unlicense", ("the unlicense",), ()),
    ("wtfpl", ("wtfpl",), ("2",)),
    ("odbl", ("open database license", "open data commons open database license"), ("1 0",)),
    ("pddl", ("public domain dedication and license",), ("1 0",)),
    ("ogl", ("open government licence", "open government license"), ("3 0", "2 0", "1 0")),
    ("ms-pl", ("microsoft public license",), ()),
    ("ms-rl", ("microsoft reciprocal license",), ()),
    ("openssl", ("openssl license",), ()),
    ("cecill", ("cecill free software license", "cecill license"), ("2 1", "2 0")),
    ("upl", ("universal permissive license",), ("1 0",)),
    ("afl", ("academic free license",), ("3 0", "2 1")),
    ("osl", ("open software license",), ("3 0", "2 1")),
    ("cc-by-nc-nd", ("cc by nc nd",), ("4 0", "3 0", "2 0")),
    ("cc-by-nc-sa", ("cc by nc sa",), ("4 0", "3 0", "2 0")),
    ("cc-by-nc", ("cc by nc",), ("4 0", "3 0", "2 0")),
    ("cc-by-nd", ("cc by nd",), ("4 0", "3 0", "2 0")),
    ("cc-by-sa", ("cc by sa",), ("4 0", "3 0", "2 0")),
    ("cc-by", ("cc by",), ("4 0", "3 0", "2 0")),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"), ("4 0", "3 0")),
    ("cc-by-nc", ("creative commons attribution noncommercial", "creative commons attribution non commercial"), ("4 0", "3 0")),
    ("cc-by-sa", ("creative commons attribution sharealike", "creative commons attribution share alike"), ("4 0", "3 0")),
    ("cc-by", ("creative commons attribution",), ("4 0", "3 0")),
    ("cc0", ("cc0", "creative commons zero"), ("1 0",)),
)
#: What may stand between a short name and its version: ``GPLv3``, ``GPL v3``, ``GPL-3``.
_V = "(?: version | v(?: )?|v| )?"
#: Signatures: label, keyword, pattern of a short name with its version.
SIGNATURES = (
    ("gpl-3", "gpl", f"(?:gnu )?gpl{_V}3(?: 0)?"),
    ("gpl-2", "gpl", f"(?:gnu )?gpl{_V}2(?: 0)?"),
    ("gpl-1", "gpl", f"(?:gnu )?gpl{_V}1(?: 0)?"),
    ("gpl", "gnu gpl", "gnu gpl"),
    ("lgpl-3", "lgpl", f"(?:gnu )?lgpl{_V}3(?: 0)?"),
    ("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl{_V}2 1"),
    ("lgpl-2", "lgpl", f"(?:gnu )?lgpl{_V}2(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl-3", "agpl", f"(?:gnu )?agpl{_V}3(?: 0)?"),
    ("agpl-1", "agpl", f"agpl{_V}1(?: 0)?"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("fdl-1.3", "gfdl", f"gfdl{_V}1 3"),
    ("fdl-1.2", "gfdl", f"gfdl{_V}1 2"),
    ("fdl-1.1", "gfdl", f"gfdl{_V}1 1"),
    ("fdl", "gfdl", "gfdl"),
    ("apache-2.0", "apache", f"apache{_V}2(?: 0)? licen[cs]e"),
    ("apache-2.0", "asl", f"asl{_V}2 0"),
    ("apache-1.1", "apache", f"apache{_V}1 1 licen[cs]e"),
    ("mpl-2.0", "mpl", f"mpl{_V}2 0"),
    ("mpl-1.1", "mpl", f"mpl{_V}1 1"),
    ("mpl-1.0", "mpl", f"mpl{_V}1 0"),
    ("epl-2.0", "epl", f"epl{_V}2 0"),
    ("epl-1.0", "epl", f"epl{_V}1 0"),
    ("cddl-1.1", "cddl", f"cddl{_V}1 1"),
    ("cddl-1.0", "cddl", f"cddl{_V}1 0"),
    ("eupl-1.2", "eupl", f"eupl{_V}1 2"),
    ("eupl-1.1", "eupl", f"eupl{_V}1 1"),
    ("ofl-1.1", "ofl", f"(?:sil )?ofl{_V}1 1"),
    ("bsd-4.clause", "bsd", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[cs]e)?"),
    ("bsd-3.clause", "bsd", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[cs]e)?"),
    ("bsd-2.clause", "bsd", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[cs]e)?"),
    ("bsd-0.clause", "bsd", "(?:bsd (?:0|zero) clause|(?:0|zero) clause bsd)(?: licen[cs]e)?"),
    ("bsd-4.clause", "original bsd", "original bsd licen[cs]e"),
    ("bsd-3.clause", "bsd", "(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-2.clause", "bsd", "(?:simplified bsd|freebsd) licen[cs]e"),
    ("mit", "expat", "expat licen[cs]e"),
    ("mit", "mit x11", "mit x11"),
    ("isc", "isc", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib licen[cs]e"),
    ("boost-1.0", "bsl", f"bsl{_V}1 0"),
)
#: SPDX short ids (lower case) and their labels.
SPDX = {
    "0bsd": "bsd-0.clause", "bsd-1-clause": "bsd-1.clause", "bsd-2-clause": "bsd-2.clause", "bsd-2-clause-patent": "bsd-2.clause-patent", "bsd-3-clause": "bsd-3.clause",
    "bsd-3-clause-clear": "bsd-3.clause-clear", "bsd-3-clause-lbnl": "bsd-3.clause-lbnl", "bsd-4-clause": "bsd-4.clause", "bsd-4-clause-uc": "bsd-4.clause", "bsd-source-code": "bsd",
    "mit": "mit", "mit-0": "mit-0", "x11": "mit", "isc": "isc", "ncsa": "ncsa", "zlib": "zlib", "libpng": "libpng", "libpng-2.0": "libpng-2.0",
    "apache-1.0": "apache-1.0", "apache-1.1": "apache-1.1", "apache-2.0": "apache-2.0",
    "gpl-1.0": "gpl-1", "gpl-1.0-only": "gpl-1", "gpl-1.0-or-later": "gpl-1", "gpl-1.0+": "gpl-1", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-2.0+": "gpl-2",
    "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-3.0+": "gpl-3",
    "lgpl-2.0": "lgpl-2", "lgpl-2.0-only": "lgpl-2", "lgpl-2.0-or-later": "lgpl-2", "lgpl-2.0+": "lgpl-2", "lgpl-2.1": "lgpl-2.1", "lgpl-2.1-only": "lgpl-2.1", "lgpl-2.1-or-later": "lgpl-2.1",
    "lgpl-2.1+": "lgpl-2.1", "lgpl-3.0": "lgpl-3", "lgpl-3.0-only": "lgpl-3", "lgpl-3.0-or-later": "lgpl-3", "lgpl-3.0+": "lgpl-3", "lgpllr": "lgpllr",
    "agpl-1.0": "agpl-1", "agpl-1.0-only": "agpl-1", "agpl-1.0-or-later": "agpl-1", "agpl-3.0": "agpl-3", "agpl-3.0-only": "agpl-3", "agpl-3.0-or-later": "agpl-3",
    "gfdl-1.1": "fdl-1.1", "gfdl-1.1-only": "fdl-1.1", "gfdl-1.1-or-later": "fdl-1.1", "gfdl-1.2": "fdl-1.2", "gfdl-1.2-only": "fdl-1.2", "gfdl-1.2-or-later": "fdl-1.2",
    "gfdl-1.3": "fdl-1.3", "gfdl-1.3-only": "fdl-1.3", "gfdl-1.3-or-later": "fdl-1.3",
    "mpl-1.0": "mpl-1.0", "mpl-1.1": "mpl-1.1", "mpl-2.0": "mpl-2.0", "mpl-2.0-no-copyleft-exception": "mpl-2.0", "epl-1.0": "epl-1.0", "epl-2.0": "epl-2.0",
    "cddl-1.0": "cddl-1.0", "cddl-1.1": "cddl-1.1", "eupl-1.0": "eupl-1.0", "eupl-1.1": "eupl-1.1", "eupl-1.2": "eupl-1.2", "cpl-1.0": "cpl-1.0", "ipl-1.0": "ipl-1.0",
    "artistic-1.0": "artistic-1.0", "artistic-1.0-perl": "artistic-1.0", "artistic-2.0": "artistic-2.0", "bsl-1.0": "boost-1.0", "busl-1.1": "busl-1.1",
    "psf-2.0": "psf-2", "python-2.0": "psf-2", "php-3.0": "php-3.0", "php-3.01": "php-3.01", "ofl-1.0": "ofl-1.0", "ofl-1.1": "ofl-1.1", "unlicense": "unlicense", "wtfpl": "wtfpl",
    "odbl-1.0": "odbl-1.0", "pddl-1.0": "pddl-1.0", "odc-by-1.0": "odc-by-1.0", "ogl-uk-1.0": "ogl-1.0", "ogl-uk-2.0": "ogl-2.0", "ogl-uk-3.0": "ogl-3.0",
    "ms-pl": "ms-pl", "ms-rl": "ms-rl", "openssl": "openssl", "cecill-2.0": "cecill-2.0", "cecill-2.1": "cecill-2.1", "cecill-b": "cecill-b", "cecill-c": "cecill-c",
    "upl-1.0": "upl-1.0", "afl-2.1": "afl-2.1", "afl-3.0": "afl-3.0", "osl-2.1": "osl-2.1", "osl-3.0": "osl-3.0", "ruby": "ruby", "tcl": "tcl", "vim": "vim", "curl": "curl",
    "postgresql": "postgresql", "hpnd": "hpnd", "ntp": "ntp", "w3c": "w3c", "unicode-dfs-2016": "unicode", "unicode-3.0": "unicode", "blueoak-1.0.0": "blueoak-1.0.0", "mulanpsl-2.0": "mulanpsl-2.0",
    "sleepycat": "sleepycat", "qpl-1.0": "qpl-1.0", "lppl-1.3c": "lppl-1.3c", "icu": "icu", "ijg": "ijg", "ftl": "ftl", "beerware": "beerware", "sspl-1.0": "sspl-1.0",
    "cc0-1.0": "cc0-1.0", "cc-pddc": "public-domain",
    **{f"cc-{k}-{v}": f"cc-{k}-{v}" for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
}
#: An SPDX expression after its tag, and one id of it.
_EXPRESSION = re.compile(rb"(?<![0-9a-z\x80-\xff])spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[^0-9a-z\x80-\xff\r\n]+([0-9a-z][0-9a-z.+\-]*(?:[ \t()]+(?:and|or|with)[ \t()]+[0-9a-z][0-9a-z.+\-]*)*)")
_OPERAND = re.compile(rb"[0-9a-z][0-9a-z.+\-]*")
#: Forms: pattern around a name, priority (higher first), confidence.
FORMS = (
    ("spdx license identifier {}", 6, 1.0),
    ("(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?{}", 5, 0.95),
    ("under the terms of the {}", 5, 0.95),
    ("(?:see|read) the {}", 3, 0.7),
    ("{}", 2, 0.6),
)
#: Priority (higher first) and confidence of each table of signatures.
RANKS = ((TEXTS, 6, 0.95), (NAMES, 3, 0.7), (LINKS, 5, 0.9), (EXCEPTIONS, 3, 0.6), (STATEMENTS, 2, 0.6), (NOTICES, 1, 0.4))


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern[bytes]
    keyword: str
    label: str
    priority: int
    confidence: float


def _compiled(words: str) -> re.Pattern[bytes]:
    return re.compile(_EDGE % (rb"(?:" + words.encode().replace(b" ", _GAP) + rb")"))


def keyword(pattern: str) -> str:
    """The longest run of words outside the groups of a pattern: any match holds it."""
    runs, depth, run = [], 0, ""
    for k, c in enumerate(pattern + "(", 0):
        optional = pattern[k + 1 : k + 2] == "?"
        if depth == 0 and (c.isalnum() or c == " ") and not optional:
            run += c
            continue
        runs.append(run.strip() if c in "(" else run.strip())
        run = ""
        depth += (c in "([") - (c in ")]")
    return max(runs, key=len)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order; a rule's place breaks ties."""
    found = []
    for label, names, versions in FAMILIES:
        for name in names:
            for version in (*versions, ""):
                full = name + (f"(?: version | v(?: )?| ){version}" if version else "")
                tag = label + (f"-{version.replace(' ', '.')}" if version else "")
                for form, priority, confidence in FORMS:
                    found.append(Rule(_compiled(form.format(full)), keyword(name), tag, priority + bool(version), confidence))
    found += [Rule(_compiled(form.format(p)), k, label, priority + 1, confidence) for label, k, p in SIGNATURES for form, priority, confidence in FORMS]
    found += [Rule(_compiled(p), keyword(p), label, priority, confidence) for table, priority, confidence in RANKS for label, p in table]
    found += [Rule(re.compile(re.escape(k.encode())), "spdx license identifier", label, 8, 1.0) for k, label in SPDX.items()]
    return tuple(found)


@lru_cache(maxsize=1)
def _spdx_rules() -> dict[bytes, int]:
    """Rule of each SPDX id: the last ones, in order."""
    return {k.encode(): len(rules()) - len(SPDX) + i for i, k in enumerate(SPDX)}


def _operands(low: bytes) -> list[tuple[int, int, int]]:
    """``start, end, rule`` of each known id in the SPDX expressions; the first starts at the tag."""
    found = []
    for m in _EXPRESSION.finditer(low):
        for x in _OPERAND.finditer(low, m.start(1), m.end(1)):
            name = x[0].rstrip(b".-")
            known = next((k for k in (name, name.rstrip(b"+")) if k in _spdx_rules()), None)
            if known is not None:
                found.append((m.start() if x.start() == m.start(1) else x.start(), x.start() + len(name), _spdx_rules()[known]))
    return found


def _automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, value in words.items():
        found.add_word(word, value)
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def _by_keyword() -> ahocorasick.Automaton:
    """Finds keywords in a text whose gaps are single spaces; gives the rules behind each."""
    places: dict[str, list[int]] = {}
    for k, rule in enumerate(rules()[: -len(SPDX)]):
        places.setdefault(rule.keyword, []).append(k)
    return _automaton(places)


@lru_cache(maxsize=1)
def gates() -> tuple[str, ...]:
    """The longest word of each keyword, and the SPDX tag: a text without any has no licence."""
    return tuple(sorted({max(rule.keyword.split(" "), key=len) for rule in rules()[: -len(SPDX)]} | {"spdx"}))


@lru_cache(maxsize=1)
def _gate() -> ahocorasick.Automaton:
    return _automaton(dict.fromkeys(gates(), True))


def suppressed(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Drop detections ``(start, end, priority, rule)`` inside one of no lower priority.

    Sorted by start, longest first, so that whatever holds a span stands before it; the
    spans still open form a stack no deeper than the overlaps at one place.
    """
    kept: list[tuple[int, int, int, int]] = []
    open_: list[tuple[int, int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1], -s[2], s[3])):
        open_ = [o for o in open_ if o[1] > span[0]]
        if not any(o[1] >= span[1] and o[2] >= span[2] for o in open_):
            # of the same interval the higher priority came first; a longer, weaker one stays too
            kept.append(span)
        open_.append(span)
    return kept


def detect(low: bytes) -> list[tuple[int, int, Rule]]:
    """Detections in a lower-cased text, overlaps resolved."""
    if next(_gate().iter(low.decode("latin-1")), None) is None:
        return []
    flat = re.sub(_GAP, b" ", low).decode("latin-1")
    wanted = sorted({k for _, places in _by_keyword().iter(flat) for k in places})
    spans = [(m.start(), m.end(), rules()[k].priority, k) for k in wanted for m in rules()[k].pattern.finditer(low)]
    if b"spdx" in low:
        spans += [(a, b, rules()[k].priority, k) for a, b, k in _operands(low)]
    return [(a, b, rules()[k]) for a, b, _, k in suppressed(spans)]


_IS_WORD = np.array([chr(b).isascii() and (chr(b).isdigit() or "a" <= chr(b) <= "z") or b > 127 for b in range(256)])
_BASE_RULES = tuple((p.split(" ")[-1].encode(), _compiled(p), label) for p, label in BASE)


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """Words, base places, first and last place, base labels, labels, score."""
    low = (text or "").encode("utf-8", "replace").lower()
    if not low:
        return 0, 0, None, None, "", "", 0.0
    inside = _IS_WORD[np.frombuffer(low, np.uint8)]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    n_words = int(np.count_nonzero(starts))
    places, base = [], set()
    for last, pattern, label in _BASE_RULES:
        if last in low:
            for m in pattern.finditer(low):
                places.append(int(np.count_nonzero(starts[: m.start()])))
                base.add(label)
    found = detect(low)
    labels = base | {r.label for _, _, r in found}
    miss = 1.0
    for _, _, r in found:
        miss *= 1 - r.confidence
    score = max(1 - miss, 0.6 if base else 0.0)
    return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    arrow_batches(docs.sparkSession)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
