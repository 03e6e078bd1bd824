"""License scans: fuzzy search for short notices.

Notices and texts are normalised to words (A-Z lower-cased, see ``words_bytes``) joined by
spaces. A notice found with at most k edits holds at least one of its k + 1 pieces
unchanged (pigeonhole), so one automaton over all pieces locates the places of a text where
it may stand, in one scan. A window of the notice's length and edits around each place holds
any such match, and the regex library's bounded-error matching decides it and reports the span
with its edits. The best match of all windows is taken first, and the windows it cuts are
searched again beside it, so work grows with the number of windows, however long the text. A
match begins and ends at word borders.

Base phrases are found exactly, by the same automaton, at every place where their words
stand consecutively.

Defined cases: a null or empty text has no words, labels or spans and score 0; repeated
rows give repeated results; a match is dropped where another notice's match with fewer edits
covers all its words; only the id and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from functools import lru_cache
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.llm.util import map_text, words_bytes, worker_state

# The contract's base phrases with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening or naming sentences of common licenses, normalised.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
]

# One edit for every so many characters of a notice, at most MAX_EDITS.
CHARS_PER_EDIT, MAX_EDITS = 12, 5

_SPACE = re.compile(" ")

FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double, "
          "spans array<struct<label:string,first_word:int,last_word:int,edits:int,similarity:double>>")


def edits_allowed(notice: str) -> int:
    return max(1, min(MAX_EDITS, len(notice) // CHARS_PER_EDIT))


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice cut into k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=None, base=None):
        import ahocorasick
        import regex

        self.notices = NOTICES if notices is None else notices
        self.base = BASE if base is None else base
        at: dict[str, list] = {}
        for i, (text, _) in enumerate(self.notices):
            for offset, piece in seeds(text, edits_allowed(text)):
                at.setdefault(piece, []).append((i, offset))
        for phrase, label in self.base.items():
            at.setdefault(f" {phrase} ", []).append((-1, label))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.patterns = [
            regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(t, special_only=True)}){{e<={edits_allowed(t)}}}(?![^ ])")
            for t, _ in self.notices]
        # Notices repeat across documents, and so do their surroundings. Windows are short.
        self.verify = lru_cache(50_000)(self._verify)

    def _verify(self, notice: int, window: str, lo: int, hi: int) -> tuple | None:
        """(edits, start, end) of the best match in a part of a window."""
        if hi - lo < len(self.notices[notice][0]) - edits_allowed(self.notices[notice][0]):
            return None
        m = self.patterns[notice].search(window, lo, hi)
        return (sum(m.fuzzy_counts), m.start(), m.end()) if m and m.end() > m.start() else None

    def _matches(self, notice: int, norm: str, windows) -> list[tuple[int, int, int]]:
        """(edits, start, end) of the matches that do not overlap, best first."""
        heap: list[tuple] = []

        def search(a: int, b: int, lo: int, hi: int) -> None:
            m = self.verify(notice, norm[a:b], lo - a, hi - a)
            if m:
                heappush(heap, (m[0], m[1] + a, m[2] + a, lo, hi, a, b))

        for a, b in windows:
            search(a, b, a, b)
        taken: list[tuple[int, int, int]] = []  # (start, end, edits), by start
        while heap:
            edits, start, end, lo, hi, a, b = heappop(heap)
            i = bisect_left(taken, (start,))
            near = next((taken[j] for j in (i - 1, i) if 0 <= j < len(taken) and taken[j][0] < end and start < taken[j][1]), None)
            if near is None:
                near = (start, end, edits)
                insort(taken, near)
            # What is left of the window beside a match; the part before ends ahead of the space.
            search(a, b, lo, max(lo, near[0] - 1))
            search(a, b, max(lo, near[1]), hi)
        return [(edits, s, e) for s, e, edits in taken]

    def scan(self, text: str | None) -> tuple:
        words = words_bytes(text)
        if not words:
            return 0, 0, None, None, [], [], 0.0, []
        norm = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        places, windows = [], {}
        for end, (size, uses) in self.automaton.iter(norm):
            for i, at in uses:
                start = end - size + 1
                if i < 0:
                    places.append((start + 1, at))
                else:
                    notice = self.notices[i][0]
                    k = edits_allowed(notice)
                    windows.setdefault(i, set()).add(
                        (max(0, start - at - k - 1), min(len(norm), start - at + len(notice) + k + 1)))
        if not places and not windows:
            return len(words), 0, None, None, [], [], 0.0, []
        starts_at = [m.start() + 1 for m in _SPACE.finditer(norm)]  # of every word, and the end
        word_at = lambda pos: bisect_left(starts_at, pos + 1) - 1
        spans = []
        for i, found in windows.items():
            notice, label = self.notices[i]
            for edits, s, e in self._matches(i, norm, sorted(found)):
                spans.append((label, word_at(s + (norm[s] == " ")), word_at(e), edits, 1 - edits / len(notice)))
        spans = _best(spans)
        starts = [word_at(p) for p, _ in places]
        base_labels = sorted({label for _, label in places})
        labels = sorted({*base_labels, *(s[0] for s in spans)})
        score = 1.0 if places else max((s[4] for s in spans), default=0.0)
        return (len(words), len(places), min(starts, default=None), max(starts, default=None),
                base_labels, labels, score, spans)


def _best(spans: list[tuple]) -> list[tuple]:
    """Without the spans that one with fewer edits covers (another version's notice).

    A shorter notice inside a longer one does not displace it, however few its edits.
    """
    longest = max((s[2] - s[1] for s in spans), default=0)
    kept: dict[int, list[tuple]] = {}  # by first word
    for s in sorted(spans, key=lambda s: (s[3], s[1])):
        near = (k for first in range(s[2] - longest, s[1] + 1) for k in kept.get(first, ()))
        if not any(k[3] < s[3] and s[2] <= k[2] for k in near):
            kept.setdefault(s[1], []).append(s)
    return sorted(s for own in kept.values() for s in own)


def scanner(notices=None, base=None) -> Scanner:
    own = (None if notices is None else tuple(notices), None if base is None else tuple(sorted(base.items())))
    return worker_state(("licenses", *own), lambda: Scanner(notices, base))


def scan(docs: DataFrame, keep: list[str], text: str = "text", notices: list[tuple[str, str]] | None = None,
         base: dict[str, str] | None = None) -> DataFrame:
    """``keep`` columns plus counts, labels, score and spans of each document row.

    ``notices`` (normalised text, label) and ``base`` (phrase -> label) replace the built-in ones.
    ``first_word`` and ``last_word`` of a span belong to it; ``score`` is the best similarity (1 - edits over
    notice length), 1 where a base phrase stands. A map over the rows: no shuffle.
    """
    return map_text(docs, text, keep, FIELDS, lambda: lambda texts: [scanner(notices, base).scan(t) for t in texts])


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Contract columns of ``scan``'s result."""
    return found.select(doc_id, "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")
