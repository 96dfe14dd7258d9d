"""License scans: ordered signature rules behind a keyword prefilter.

A text in normal form (see decontam: lower-case words between single spaces) is first run through one Aho-Corasick
automaton of the rules' keywords; only the rules whose keyword occurs are tried, each one regular expression over the
normal form. Rules have priorities. Detections are taken by priority, then length, then place; one that lies inside a
detection already taken is suppressed, unless it is a base phrase: base phrases always stand.

The rules are hand-written signatures (see license_signatures): headers and grants first, then clauses of licence texts;
then licences' names, bare and in sentence forms; then notices. Base phrases come before all.

Defined results: null or wordless texts have no words, no places (first and last null), empty labels and score 0;
repeated texts are scanned each for itself; no other column is read.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import license_signatures as S
from .common import free_names, map_rows
from .decontam import normal_words

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Identifier: alternative names as regular expressions over normal-form words.
LICENCES = {
    "apache-1.1": ["apache (?:software )?license (?:version )?1 1"],
    "apache-2.0": ["apache (?:software )?license (?:version )?2(?: 0)?", "apache 2 0"],
    "mit": ["mit license", "mit x11 license", "expat license"],
    "bsd-2-clause": ["bsd 2 clause(?: license)?", "simplified bsd license", "freebsd license"],
    "bsd-3-clause": ["bsd 3 clause(?: license)?", "(?:new|modified|revised) bsd license"],
    "bsd-4-clause": ["bsd 4 clause(?: license)?", "original bsd license"],
    "gpl-1.0": ["gnu general public license (?:version |v)?1(?: 0)?", "gpl ?v1"],
    "gpl-2.0": ["gnu general public license (?:version |v)?2(?: 0)?", "gpl ?v2"],
    "gpl-3.0": ["gnu general public license (?:version |v)?3(?: 0)?", "gpl ?v3"],
    "gpl": ["gnu general public license", "gnu gpl"],
    "lgpl-2.1": ["gnu (?:lesser|library) general public license (?:version |v)?2(?: 1| 0)?", "lgpl ?v2(?: 1)?"],
    "lgpl-3.0": ["gnu lesser general public license (?:version |v)?3(?: 0)?", "lgpl ?v3"],
    "lgpl": ["gnu (?:lesser|library) general public license", "gnu lgpl"],
    "agpl-3.0": ["gnu affero general public license(?: (?:version |v)?3(?: 0)?)?", "agpl ?v3"],
    "gfdl": ["gnu free documentation license(?: (?:version |v)?1 [123])?"],
    "mpl-1.1": ["mozilla public license (?:version )?1 [01]"],
    "mpl-2.0": ["mozilla public license(?: (?:version )?2(?: 0)?)?"],
    "epl-1.0": ["eclipse public license (?:version )?1(?: 0)?"],
    "epl-2.0": ["eclipse public license(?: (?:version )?2(?: 0)?)?"],
    "cddl-1.0": ["common development and distribution license"],
    "cpl-1.0": ["common public license"],
    "isc": ["isc license"],
    "zlib": ["zlib(?: libpng)? license"],
    "bsl-1.0": ["boost software license"],
    "unlicense": ["the unlicense"],
    "wtfpl": ["do what the fuck you want to public license", "wtfpl"],
    "artistic-2.0": ["artistic license(?: 2 0)?"],
    "python-2.0": ["python software foundation license"],
    "postgresql": ["postgresql license"],
    "ofl-1.1": ["sil open font license"],
    "odbl-1.0": ["open database license"],
    "ogl-3.0": ["open government licence(?: v?3(?: 0)?)?"],
    "eupl-1.2": ["european union public licence"],
    "ms-pl": ["microsoft public license"],
    "public-domain": ["public domain"],
    "cc0-1.0": ["cc0", "creative commons zero"],
}

#: Creative Commons: element codes, their words, and versions; the product gives one identifier each.
CC_ELEMENTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s?", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0", ""]

#: Sentence forms: name of the form, pattern around {name}, keyword that must occur, confidence.
FORMS = [
    ("tag", "spdx license identifier {name}", "spdx", 1.0),
    ("grant", "(?:licensed|released|distributed|published|available|covered) (?:under|by) (?:the )?(?:terms of the )?(?:conditions of the )?{name}", None, 0.95),
    ("terms", "(?:terms|conditions) of (?:the )?{name}", None, 0.9),
    ("notice", "(?:see|read) (?:the )?{name}(?: file| text)?", None, 0.7),
    ("name", "{name}", None, 0.6),
]

@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern
    confidence: float
    base: bool = False


def _keyword(pattern: str) -> str:
    """The longest literal word, or start of a word, of a pattern that every match must hold."""
    before = ""
    while before != pattern:  # groups, from the innermost
        before, pattern = pattern, re.sub(r"\((?:\?:)?[^()]*\)(?:[?*]|\{[0-9,]+\})?", "\x00", pattern)
    found = [re.match(r"(?:[a-z0-9](?![?*{]))*", w)[0] for w in pattern.split(" ")]
    return max(found, key=len)


def _compiled(pattern: str) -> re.Pattern:
    """The words of pattern after a space and before one; the first space is part of the match, so that it can be sought."""
    return re.compile(f" (?:{pattern})(?= )")


def rules() -> list[Rule]:
    """All rules in order: base phrases, signatures, sentence forms of names from the most to the least specific, remarks."""
    names = [(key, n) for key, given in LICENCES.items() for n in given]
    for code, words in CC_ELEMENTS.items():
        for version in CC_VERSIONS:
            key = "-".join(["cc", *code.split()]) + (f"-{version.replace(' ', '.')}" if version else "")
            tail = f" {version}" if version else ""
            names += [(key, f"cc {code}{tail}"), (key, f"creative commons {words}{tail}(?: (?:international|unported))?(?: license)?")]
    out = [Rule(0, label, max(phrase.split(), key=len), _compiled(phrase), 0.8, True) for phrase, label in BASE.items()]

    def signatures(priority, section):
        return [Rule(priority, label, _keyword(pattern), _compiled(pattern), confidence) for label, confidence, pattern in S.parse(section)]

    out += signatures(1, S.HEADERS) + signatures(2, S.CLAUSES)
    for rank, (_, form, keyword, confidence) in enumerate(FORMS, 3):
        out += [Rule(rank, key, keyword or _keyword(name), _compiled(form.format(name=f"(?:{name})")), confidence) for key, name in names]
    return out + signatures(3 + len(FORMS), S.REMARKS)


def contained(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether an interval of taken holds this one; if not, it is taken. taken: by start, of intervals none of which holds
    another, so that ends rise too and the last one that starts early enough reaches farthest."""
    at = bisect_right(taken, (start, sys.maxsize))
    if at and taken[at - 1][1] >= end:
        return True
    at = bisect_left(taken, (start, 0))
    stop = at
    while stop < len(taken) and taken[stop][1] <= end:
        stop += 1
    taken[at:stop] = [(start, end)]
    return False


class Scanner:
    """The compiled rules and their keyword automaton."""

    def __init__(self, given: list[Rule] | None = None):
        self.rules = rules() if given is None else given
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by_keyword.setdefault(rule.keyword, []).append(i)
        self.always = by_keyword.pop("", [])
        self.keywords = ahocorasick.Automaton()
        for keyword, owners in by_keyword.items():
            # Whole words, but a name may run on into digits or "v2": only the word's start is held fast.
            self.keywords.add_word(f" {keyword}", owners)
        self.keywords.make_automaton()

    def detections(self, normal: str) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) after suppression, in order of place; offsets in the normal form."""
        owners = set(self.always)
        for _, found in self.keywords.iter(normal):
            owners.update(found)
        hits = [(m.start() + 1, m.end(), self.rules[i]) for i in sorted(owners) for m in self.rules[i].pattern.finditer(normal)]
        taken: list[tuple[int, int]] = []
        out = [h for h in hits if h[2].base]
        for hit in sorted((h for h in hits if not h[2].base), key=lambda h: (h[2].priority, h[0] - h[1], h[0], h[2].label)):
            if not contained(taken, hit[0], hit[1]):
                out.append(hit)
        return sorted(out, key=lambda h: (h[0], h[1], h[2].priority, h[2].label))


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("detections", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("confidence", T.DoubleType())])))]


def scan_licences(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default), n_words, and detections: word runs with label, base flag and confidence. The two new
    columns get underscores before a name that keep has."""
    keep = docs.columns if keep is None else keep
    place = docs.columns.index(text)
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("confidence", pa.float64())]))

    def make():
        scanner = Scanner()

        def one(value: str | None):
            found = normal_words((value or "").encode())
            normal = f" {b' '.join(found).decode('latin-1')} "
            hits = scanner.detections(normal) if found else []
            # Word i stands after space i.
            spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 0x20) if hits else np.zeros(0, np.int64)
            firsts, ends = np.searchsorted(spaces, [h[0] for h in hits]) - 1, np.searchsorted(spaces, [h[1] for h in hits])
            return len(found), [{"first_word": a, "end_word": b, "label": h[2].label, "base": h[2].base, "confidence": h[2].confidence} for a, b, h in zip(firsts.tolist(), ends.tolist(), hits)]

        def work(batch):
            results = [one(v.as_py()) for v in batch.column(place)]
            return [pa.array([n for n, _ in results], pa.int64()), pa.array([d for _, d in results], kind)]

        return work

    return map_rows(docs, keep, T.StructType([T.StructField(n, f.dataType) for n, f in zip(free_names(keep, "n_words", "detections"), FIELDS)]), make)


def digest(found: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    from pyspark.sql import functions as F

    base = F.filter("detections", lambda d: d["base"])
    places = F.transform(base, lambda d: d["first_word"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
