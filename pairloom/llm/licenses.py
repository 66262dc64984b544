"""Licence mentions by fixed phrases and ordered signature rules.

A-Z are lower-cased; words are runs of characters other than 00-2F, 3A-60 and 7B-7F. The base finds the places where
a phrase's words stand one after the other. The rules are regexes over whole texts, built from licence names and the
sentence forms in which they are stated, ordered by form (a tag before a grant before a bare name). A rule runs only
on texts that hold a keyword of its name and its form's, found by one automaton pass. Overlaps are settled by intervals: a detection inside
another one of the same or a higher priority is suppressed (the same interval: the earlier rule stays). ``labels`` are those
of the remaining detections and of the base; ``score`` is the highest priority among them, scaled to 1 (1 for a base
phrase, 0 without any).

Null texts are empty; texts without words give zero counts, null positions and empty label strings. Repeated rows are
scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.words import LOWER, text_runs

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Label, name as words (| between alternatives, ? after an optional word), keywords of which one must occur.
NAMES = (
    ("mit", "mit|expat", "mit|expat"),
    ("mit-0", "mit no attribution|mit 0", "mit"),
    ("isc", "isc|internet systems consortium", "isc|internet systems"),
    ("apache-1", "apache software? license? version? 1|apache 1", "apache"),
    ("apache-2", "apache software? license? version? v? 2|apache v2|apache2", "apache"),
    ("bsd-2-clause", "bsd 2 clause|simplified bsd|two clause bsd|freebsd", "bsd"),
    ("bsd-3-clause", "bsd 3 clause|new bsd|modified bsd|revised bsd|three clause bsd", "bsd"),
    ("bsd-4-clause", "bsd 4 clause|original bsd|old bsd|four clause bsd", "bsd"),
    ("0bsd", "zero clause bsd|0bsd|bsd zero clause", "bsd"),
    ("gpl-1", "gnu? general public license? version? v? 1|gnu? gpl v? 1|gplv1", "gpl|general public"),
    ("gpl-2", "gnu? general public license? version? v? 2|gnu? gpl version? v? 2|gplv2", "gpl|general public"),
    ("gpl-3", "gnu? general public license? version? v? 3|gnu? gpl version? v? 3|gplv3", "gpl|general public"),
    ("lgpl-2", "gnu? library general public license? version? 2|gnu? lgpl version? v? 2|lgplv2", "lgpl|general public"),
    ("lgpl-2.1", "gnu? lesser general public license? version? v? 2 1|gnu? lgpl version? v? 2 1|lgplv2 1", "lgpl|lesser general"),
    ("lgpl-3", "gnu? lesser general public license? version? v? 3|gnu? lgpl version? v? 3|lgplv3", "lgpl|lesser general"),
    ("agpl-3", "gnu? affero general public license? version? v? 3|gnu? agpl version? v? 3|agplv3", "agpl|affero"),
    ("gfdl", "gnu? free documentation|gfdl", "free documentation|gfdl"),
    ("mpl-1.1", "mozilla public license? version? 1 1|mpl v? 1 1", "mozilla|mpl"),
    ("mpl-2", "mozilla public license? version? v? 2|mpl version? v? 2", "mozilla|mpl"),
    ("epl-1", "eclipse public license? version? v? 1|epl v? 1", "eclipse|epl"),
    ("epl-2", "eclipse public license? version? v? 2|epl v? 2", "eclipse|epl"),
    ("cddl-1", "common development and distribution license? version? 1?|cddl 1?", "cddl|common development"),
    ("eupl", "european union public|eupl", "european union public|eupl"),
    ("osl-3", "open software license? version? 3|osl 3", "open software|osl"),
    ("afl-3", "academic free license? version? 3|afl 3", "academic free|afl"),
    ("artistic-1", "artistic license? version? 1", "artistic"),
    ("artistic-2", "artistic license? version? 2", "artistic"),
    ("bsl-1", "boost software license? version? 1?", "boost software"),
    ("zlib", "zlib libpng?", "zlib"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "wtfpl|what the fuck"),
    ("public-domain", "public domain", "public domain"),
    ("cc0", "cc0|creative commons zero|cc zero", "cc0|creative commons|cc zero"),
    ("cc-by", "cc by|creative commons attribution", "cc|creative commons"),
    ("cc-by-sa", "cc by sa|creative commons attribution share alike|creative commons attribution sharealike", "cc|creative commons"),
    ("cc-by-nd", "cc by nd|creative commons attribution no derivatives|creative commons attribution noderivatives", "cc|creative commons"),
    ("cc-by-nc", "cc by nc|creative commons attribution non commercial|creative commons attribution noncommercial", "cc|creative commons"),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution noncommercial share alike|creative commons attribution noncommercial sharealike", "cc|creative commons"),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution noncommercial no derivatives|creative commons attribution noncommercial noderivatives", "cc|creative commons"),
    ("odbl", "open data commons open database|odbl|open database", "open data|odbl|open database"),
    ("ofl-1.1", "sil open font|open font|ofl 1 1", "open font|ofl"),
    ("python-2", "python software foundation|psf", "python software|psf"),
    ("ruby", "ruby", "ruby"),
    ("php-3", "php license? version? 3|php", "php"),
    ("openssl", "openssl", "openssl"),
    ("ncsa", "university of illinois ncsa|ncsa", "ncsa"),
    ("postgresql", "postgresql", "postgresql"),
    ("ms-pl", "microsoft public|ms pl", "microsoft public|ms"),
    ("proprietary", "proprietary|commercial", "proprietary|commercial"),
)

W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(W + "+")

# Sentence forms, strongest first, each with a keyword of its own. %s is the name.
FORMS = (
    ("spdx", "spdx license identifier %s(?:-or-later|-only)?"),
    ("under", "(?:licensed|released|distributed|available|redistributed|published|provided) under (?:the )?(?:terms of (?:the )?)?%s(?: licen[sc]e)?"),
    ("licen", "(?:under|subject to|governed by|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?%s licen[sc]e"),
    ("licen", "licen[sc]e %s(?: licen[sc]e)?"),
    ("licen", "(?:the )?%s licen[sc]e"),
)
BARE = frozenset(label for label, name, _ in NAMES if any(c in name for c in ("public", "creative", "cc")) and label not in ("public-domain",))


def _pattern(phrase: str) -> str:
    return phrase.replace(" ", GAP)


def _name(words: str) -> str:
    """Regex of a name: each word brings the gap before it, so an optional word leaves none behind."""
    forms = []
    for form in words.split("|"):
        first, *rest = form.split()
        out = f"(?:{re.escape(first[:-1])}{GAP})?" if first.endswith("?") else re.escape(first)
        if first.endswith("?"):
            out += re.escape(rest.pop(0))
        for word in rest:
            out += f"(?:{GAP}{re.escape(word[:-1])})?" if word.endswith("?") else GAP + re.escape(word)
        forms.append(out)
    return "(?:" + "|".join(sorted(forms, key=len, reverse=True)) + ")"


class Rules:
    """Compiled rules with their priority, label and keywords; built once per Python worker."""

    def __init__(self):
        import ahocorasick

        self.rules = []
        for rank, (keyword, sentence) in enumerate(FORMS):
            for label, name, keys in NAMES:
                body = _pattern(sentence).replace("%s", _name(name))
                self.rules.append((len(FORMS) + 1 - rank, label, keyword, self.first_words(keys), self.compiled(body)))
        for label, name, keys in NAMES:  # names that say enough by themselves
            if label in BARE:
                self.rules.append((1, label, None, self.first_words(keys), self.compiled(_name(name))))
        self.base = [(label, phrase.split()[-2 if phrase[-1].isdigit() else -1 if "license" in phrase else 0], self.compiled(_pattern(phrase))) for phrase, label in BASE]
        self.automaton = ahocorasick.Automaton()
        for k in {k for r in self.rules for k in r[3]} | {k for k, _ in FORMS} | {b[1] for b in self.base}:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    @staticmethod
    def first_words(keys: str) -> frozenset[str]:
        """Words of a name may be parted by any characters, so only the first word of a keyword is looked for."""
        return frozenset(k.split()[0] for k in keys.split("|"))

    @staticmethod
    def compiled(body: str) -> re.Pattern:
        return re.compile(rf"(?<!{W})(?:{body})(?!{W})")

    def scan(self, text: str) -> tuple[list[int], set[str], set[str], float]:
        """Character starts of base places, base labels, all labels, score."""
        present = {k for _, k in self.automaton.iter(text)}
        starts, base = [], set()
        if not present:
            return starts, base, base, 0.0
        for label, key, pattern in self.base:
            if key in present:
                found = [m.start() for m in pattern.finditer(text)]
                if found:
                    starts += found
                    base.add(label)
        hits = []
        for order, (priority, label, keyword, keys, pattern) in enumerate(self.rules):
            if (keyword is None or keyword in present) and not keys.isdisjoint(present):
                hits += [(priority, m.start(), m.end(), order, label) for m in pattern.finditer(text)]
        kept = surviving(hits)
        score = 1.0 if base else max((h[0] for h in kept), default=0) / (len(FORMS) + 1)
        return starts, base, base | {h[4] for h in kept}, score


def surviving(hits: list[tuple]) -> list[tuple]:
    """Detections (priority, start, end, order, label) that lie in none of the same or a higher priority.

    By start, longest first: what contains a detection comes before it. For each priority the furthest end so far
    is kept, so the pass is linear in the detections.
    """
    furthest: dict[int, int] = {}
    out = []
    for h in sorted(hits, key=lambda h: (h[1], -h[2], -h[0], h[3])):
        if not any(p >= h[0] and end >= h[2] for p, end in furthest.items()):
            out.append(h)
        furthest[h[0]] = max(furthest.get(h[0], -1), h[2])
    return out


_rules: list[Rules] = []

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def word_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    inside = WORD_BYTE[LOWER[raw]]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = False
    return np.diff(np.searchsorted(np.flatnonzero(inside & ~before), offsets))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: word count, base places, labels and score."""

    def work(batches):
        if not _rules:
            _rules.append(Rules())
        for batch in batches:
            counts, rows = [], []
            for _, raw, offsets in text_runs(batch.column(1)):
                counts.append(word_counts(raw, offsets))
                low = raw.tobytes().lower()  # bytes: A-Z only
                for a, b in zip(offsets[:-1], offsets[1:]):
                    body = low[a:b].decode("utf-8", "replace")
                    starts, base, labels, score = _rules[0].scan(body)
                    first = last = None
                    if starts:
                        places = [m.start() for m in WORD.finditer(body)]
                        first, last = bisect_left(places, min(starts)), bisect_left(places, max(starts))
                    rows.append((len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            n_words = pa.array(np.concatenate(counts) if counts else [], pa.int64())
            arrays = [batch.column(0), n_words, *(pa.array(c, t) for c, t in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    source = docs.select(F.col(id_col), F.col(text).alias("__text"))
    kinds = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    fields = [source.schema[id_col], *(T.StructField(n, T._parse_datatype_string(t)) for n, t in kinds.items())]
    return source.mapInArrow(work, T.StructType(fields))
