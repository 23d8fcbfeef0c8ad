"""Operator 5: license scans, with fuzzy search for short notices.

A text is folded (A-Z lower-cased, every ASCII character that is no letter or digit a space) and its words
are joined by single spaces. A notice of m characters with at most k edits allowed is cut into k + 1 seeds:
by the pigeonhole principle one of them stands unchanged in every match. All seeds are searched at once
by an Aho-Corasick automaton; from every word start that a hit allows, the regex library's bounded-error
matching decides over all runs of whole words and gives the span and its edits. The number of edits grows with the notice's
length. Of overlapping matches of a notice that with the fewest edits is reported, the earliest of equals.

Defined results: a null or empty text has no words, no spans and score 0. Every document is scanned
whole, in one pass over its row; nothing is shuffled. Rows that repeat are scanned one by one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import free_name, ready_python, text_of

#: Phrases told exactly, and their labels.
EXACT = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices searched with edits, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache license": "apache",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

#: Characters of a notice for each edit allowed.
CHARS_PER_EDIT = 12
FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256)
)

SPANS = pa.struct([("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("notice_chars", pa.int32())])
FOUND = pa.struct([("n_words", pa.int64()), ("exact", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), ("spans", pa.list_(SPANS))])
FOUND_SQL = (
    "struct<n_words:bigint,exact:array<struct<word:bigint,label:string>>,"
    "spans:array<struct<word:bigint,start:bigint,end:bigint,label:string,edits:int,notice_chars:int>>>"
)


@dataclass
class Notice:
    text: str
    label: str
    edits: int = field(init=False)
    seeds: list[tuple[str, int]] = field(init=False)
    #: The pattern for each number of edits, up to the bound.
    within: list[regex.Pattern] = field(init=False)

    def __post_init__(self):
        self.edits = len(self.text) // CHARS_PER_EDIT
        n = self.edits + 1
        cuts = [len(self.text) * k // n for k in range(n + 1)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]
        self.within = [regex.compile(f"(?:{regex.escape(self.text)}){{e<={e}}}") for e in range(n)]


class Scanner:
    """Seeds of all notices in one automaton."""

    def __init__(self, notices: dict[str, str], exact: dict[str, str]):
        self.notices = [Notice(t, label) for t, label in notices.items()]
        self.exact = exact
        self.seeds = ahocorasick.Automaton()
        for k, x in enumerate(self.notices):
            for seed, at in x.seeds:
                self.seeds.add_word(seed, [*self.seeds.get(seed, []), (k, at, len(seed))])
        self.seeds.make_automaton()

    @staticmethod
    def fold(text: str) -> tuple[str, int]:
        words = text.encode().translate(FOLD).split()
        return f" {b' '.join(words).decode()} ", len(words)

    def exact_places(self, folded: str) -> list[tuple[int, str]]:
        """(word, label) of every place where a phrase's words stand."""
        places = []
        for phrase, label in self.exact.items():
            at = folded.find(f" {phrase} ")
            while at >= 0:
                places.append((at, label))
                at = folded.find(f" {phrase} ", at + 1)
        spaces = spaces_of(folded) if places else []
        return sorted((bisect_left(spaces, at), label) for at, label in places)

    def spans(self, folded: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, length of the notice) of matches, which are whole words.

        Every hit is verified by itself, so no match hides another one of the same neighbourhood.
        """
        starts: dict[int, set[int]] = {}
        for end, hits in self.seeds.iter(folded):
            for k, at, size in hits:
                # a match that holds the seed unchanged begins at most `edits` off the place that the seed tells
                x, told = self.notices[k], end - size + 1 - at
                hi = told + x.edits
                space = folded.find(" ", max(told - x.edits - 1, 0), max(hi, 0))
                while space >= 0:
                    starts.setdefault(k, set()).add(space + 1)
                    space = folded.find(" ", space + 1, hi)
        found = []
        for k, own in starts.items():
            x = self.notices[k]
            matches = [(edits, first, last) for first in own for last, edits in ends(folded, first, x)]
            found += [(first, last, x.label, edits, len(x.text)) for edits, first, last in apart(matches)]
        return sorted(set(found))


def ends(folded: str, first: int, notice: Notice) -> list[tuple[int, int]]:
    """(end, edits) of all runs of whole words from `first` on that are within the notice's bound of edits.

    The regex library matches each run as a whole, so that no alignment can stop inside a word; the
    smallest bound that it meets is the number of edits.
    """
    size, out = len(notice.text), []
    last = first + size + notice.edits
    space = folded.find(" ", first + max(1, size - notice.edits), last + 1)
    while space >= 0:
        if notice.within[-1].fullmatch(folded, first, space):
            out.append((space, next(e for e, p in enumerate(notice.within) if p.fullmatch(folded, first, space))))
        space = folded.find(" ", space + 1, last + 1)
    return out


def apart(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end) those that no better one overlaps: fewest edits first, then the earliest."""
    kept: list[tuple[int, int, int]] = []  # (start, end, edits), in order
    for edits, same in groupby(sorted(matches), key=lambda x: x[0]):
        starts, new, free = [x[0] for x in kept], [], 0
        for _, first, last in same:
            at = bisect_right(starts, first)
            if first >= free and not (at and kept[at - 1][1] > first) and not (at < len(kept) and starts[at] < last):
                new.append((first, last, edits))
                free = last
        kept = sorted(kept + new)
    return [(edits, first, last) for first, last, edits in kept]


def spaces_of(folded: str) -> list[int]:
    return np.flatnonzero(np.frombuffer(folded.encode("utf-32-le"), np.uint32) == 32).tolist()


@lru_cache(maxsize=8)
def _scanner(notices: tuple[tuple[str, str], ...], exact: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(notices), dict(exact))


def scan(docs: DataFrame, text: str = "text", out: str = "found", notices: dict[str, str] | None = None, exact: dict[str, str] | None = None) -> DataFrame:
    """docs with the struct `out`: n_words; exact (word, label); spans (word, start and end in the folded text, label, edits)."""
    ready_python(docs.sparkSession)
    tables = tuple((notices or NOTICES).items()), tuple((exact or EXACT).items())

    @F.arrow_udf(FOUND_SQL)
    def of(texts: pa.Array) -> pa.Array:
        scanner, rows = _scanner(*tables), []
        for t in texts.to_pylist():
            folded, n = scanner.fold(t)
            spans = scanner.spans(folded)
            spaces = spaces_of(folded) if spans else []
            rows.append({
                "n_words": n,
                "exact": [{"word": w, "label": x} for w, x in scanner.exact_places(folded)],
                "spans": [
                    {"word": bisect_left(spaces, a) - 1, "start": a - 1, "end": b - 1, "label": x, "edits": e, "notice_chars": size}
                    for a, b, x, e, size in spans
                ],
            })
        return pa.array(rows, FOUND)

    return docs.withColumn(free_name(docs, out), of(text_of(F.col(f"`{text}`"))))
