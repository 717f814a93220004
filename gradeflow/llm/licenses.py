"""License scan: fixed phrases by exact words, notices of other wording by bounded-error search.

A notice with at most k edits, cut into k + 1 pieces, keeps one piece intact (the pigeonhole principle).
All pieces of all notices are sought at once by an Aho-Corasick automaton; only around its hits does the
bounded-error matcher run, which verifies the edits and gives the span.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table
from .words import LOWER, NON_WORD

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Public wordings of short notices, in lower case with single spaces.
NOTICES = (
    ("agpl-3", "licensed under the gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "licensed under the bsd 3 clause license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("epl-2", "licensed under the eclipse public license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("proprietary", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: One edit for each so many characters of a notice, and lengths of a window up to which windows are searched as one.
CHARS_PER_EDIT, MERGED = 10, 4
_FLAT = bytes(32 if NON_WORD[i] else int(LOWER[i]) for i in range(256))


def normalise(text: str) -> bytes:
    """Words in lower case (A-Z only) with one space between, before and after."""
    words = text.encode("utf-8", "surrogatepass").translate(_FLAT).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class Notices:
    """The automaton of all pieces, and a matcher for each notice."""

    def __init__(self, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.found = ahocorasick.Automaton()
        self.matchers = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (label, notice) in enumerate(notices):
            edits = len(notice) // chars_per_edit
            n = edits + 1
            for j in range(n):
                a, b = len(notice) * j // n, len(notice) * (j + 1) // n
                pieces.setdefault(notice[a:b], []).append((i, b))
            self.matchers.append((label, len(notice), edits, regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(notice)}){{e<={edits}}}(?![^ ])")))
        for piece, uses in pieces.items():
            self.found.add_word(piece, uses)
        self.found.make_automaton()

    def search(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, length of the notice) around each run of seeds; of matches that overlap, the closest."""
        windows: dict[int, list[list[int]]] = {}
        for end, uses in self.found.iter(text):
            for i, offset in uses:
                _, size, edits, _ = self.matchers[i]
                a = end + 1 - offset - edits - 1
                b = a + size + 2 * edits + 2
                runs = windows.setdefault(i, [])
                if runs and a <= runs[-1][1] and b - runs[-1][0] <= MERGED * (size + 2 * edits + 2):
                    runs[-1] = [min(a, runs[-1][0]), max(runs[-1][1], b)]
                else:
                    runs.append([a, b])
        out = set()
        for i, runs in windows.items():
            label, size, _, matcher = self.matchers[i]
            for a, b in runs:
                todo = [(max(0, a), min(len(text), b))]
                while todo:  # the best match of a part comes first; the others stand before or after it
                    a, b = todo.pop()
                    if m := matcher.search(text, a, b):
                        out.add((label, m.start(), m.end(), sum(m.fuzzy_counts), size))
                        todo += [(a, m.start()), (m.end(), b)]
        kept: list[tuple[str, int, int, int, int]] = []
        starts, ends = [], []  # of what is kept, in order
        for x in sorted(out, key=lambda x: (x[3] / x[4], x[1], x[0], x[2])):  # versions of one notice differ by few edits
            at = bisect.bisect_left(starts, x[2])
            if at == 0 or ends[at - 1] <= x[1]:
                kept.append(x)
                starts.insert(at, x[1])
                ends.insert(at, x[2])
        return kept


def base_places(flat: bytes, phrases=BASE) -> list[tuple[int, str]]:
    """(word number, label) of every place where a phrase's words stand in a row."""
    out = []
    for phrase, label in phrases:
        needle = f" {phrase} ".encode()
        word, last, at = 0, 0, flat.find(needle)
        while at >= 0:
            word, last = word + flat.count(b" ", last, at), at
            out.append((word, label))
            at = flat.find(needle, at + 1)
    return out


def blanks_before(text: str, places: set[int]) -> dict[int, int]:
    """The number of blanks before each place."""
    out, n, last = {}, 0, 0
    for at in sorted(places):
        n, last = n + text.count(" ", last, at), at
        out[at] = n
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """License labels of every whole text: base phrases exactly, further notices within bounded edits.

    ``spans`` lists label:first word:last word of the bounded-error matches. ``score`` is 1 if a base
    phrase stands in the text, else the best match's share of unedited characters, else 0. A null text
    counts as empty: no words, no labels, null first and last word. Rows are independent, repeated rows
    give repeated results, an empty table gives an empty one, and other columns are not read. A very long
    text is read whole; time grows with its length and its number of hits. Of matches that overlap the one
    with the smallest share of edits stays, on a tie the first.
    """
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = Notices()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                flat = normalise(text or "")
                base = base_places(flat)
                words = flat.count(b" ") - 1 if len(flat) > 1 else 0
                flat_text = flat.decode("utf-8", "surrogatepass")
                more = notices.search(flat_text)
                before = blanks_before(flat_text, {at for _, a, b, _, _ in more for at in (a, b)})
                spans = sorted((label, before[a] - 1, before[b] - 1) for label, a, b, _, _ in more)
                at, labels = [x for x, _ in base], {x for _, x in base}
                score = 1.0 if base else max((1.0 - e / size for _, _, _, e, size in more), default=0.0)
                rows.append((words, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in more})), score, ",".join(f"{k}:{a}:{b}" for k, a, b in spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr(f"cast({id_column} as long) doc_id", f"{text_column} text").mapInArrow(scan, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
