"""License notices: exact phrases, and fuzzy short notices by pigeonhole seeds and bounded-error matching."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts

#: Phrases of the contract and their labels; the word sequences must stand consecutively.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices for the fuzzy search: text in normalised words, label, and the most edits (characters).
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", 6),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("all rights reserved", "all-rights-reserved", 1),
    ("gnu affero general public license", "agpl", 3),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl-1", 2),
    ("creative commons attribution sharealike", "cc-by-sa", 4),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons zero", "cc0", 2),
    ("dedicated to the public domain", "public-domain", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("the software is provided as is without warranty of any kind", "mit", 6),
    ("european union public licence", "eupl", 3),
    ("sil open font license", "ofl", 2),
    ("under the isc license", "isc", 2),
)
#: Words that tell licenses apart though they are few letters away from others: these and all numbers must stand as they are
#: in the notice, edits are for the rest. Longer names are further from each other than any notice's edits.
NAMES = frozenset({"mit", "isc", "cc", "by", "nc", "sil"})
#: Bytes of words: digits, ASCII letters (lower-cased) and all of non-ASCII characters; any other byte separates.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def seeds(notice: str, edits: int) -> list[str]:
    """``edits`` + 1 consecutive pieces: a match with at most ``edits`` edits has one of them unchanged."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [notice[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Notice:
    text: str
    label: str
    edits: int

    def __post_init__(self):
        self.seeds = [(s, at) for s, at in zip(seeds(self.text, self.edits), [len(self.text) * k // (self.edits + 1) for k in range(self.edits + 1)], strict=True)]
        self.pattern = regex.compile(rf"(?b)(?:{regex.escape(self.text)}){{e<={self.edits}}}")

    def find(self, line: str) -> list[tuple[int, int, int]]:
        """Disjoint verified (start, end, edits) in ``line``: the best first, then what is left beside them.

        Each candidate place is searched by itself, so the work grows with the places. What overlaps a better match is
        cut off a place; the rest of it is searched again until no match is left.
        """
        places = set()
        for seed, at in self.seeds:
            k = line.find(seed)
            while k >= 0:
                places.add(max(0, k - at - self.edits))
                k = line.find(seed, k + 1)
        found: list[tuple[int, int, int]] = []
        parts = {(p, min(p + len(self.text) + 3 * self.edits, len(line))) for p in places}
        while parts:
            met = {part: m for part in parts if (m := self.pattern.search(line, *part))}
            for start, end, edits in sorted({(m.start(), m.end(), sum(m.fuzzy_counts)) for m in met.values()}, key=lambda x: (x[2], x)):
                k = bisect_left(found, (start,))
                if (k == 0 or found[k - 1][1] <= start) and (k == len(found) or end <= found[k][0]):
                    found.insert(k, (start, end, edits))
            parts = set()
            for low, high in met:
                k = max(0, bisect_left(found, (low,)) - 1)
                while low < high:
                    start, end = found[k][:2] if k < len(found) else (high, high)
                    if min(start, high) - low >= len(self.text) - self.edits:
                        parts.add((low, min(start, high)))
                    low, k = max(low, end), k + 1
        return found


def named(notice: str, found: list[str], names=NAMES) -> bool:
    """Whether the names and numbers of ``notice`` stand in order among the words that were found, and no other numbers among them."""
    exact = lambda words: [w for w in words if w in names or w.isdigit()]
    wanted, there = exact(notice.split()), iter(found)
    return all(w in there for w in wanted) and [w for w in wanted if w.isdigit()] == [w for w in found if w.isdigit()]


def scan(text: str, base=BASE, notices=NOTICES, names=NAMES) -> dict:
    """Words, exact places and verified fuzzy spans of one text."""
    own = words(text)
    line = b" " + b" ".join(own) + b" "
    places, labels = [], set()
    for phrase, label in base.items():
        needle = b" " + phrase.encode() + b" "
        k = line.find(needle)
        while k >= 0:
            places.append(line.count(b" ", 0, k))
            labels.add(label)
            k = line.find(needle, k + 1)
    spans = []
    plain = line.decode("utf-8", "surrogatepass")
    for notice in _compiled(tuple(notices)):
        for start, end, edits in notice.find(plain):
            first, last = plain.rfind(" ", 0, start + 1) + 1, plain.find(" ", max(start, end - 1))  # whole words
            if not named(notice.text, plain[first:last].split(), names):
                continue
            spans.append((notice.label, plain.count(" ", 0, start + 1) - 1 if plain[start] != " " else plain.count(" ", 0, start), start, end, edits, 1 - edits / len(notice.text)))
    return {"n_words": len(own), "places": sorted(places), "base": sorted(labels), "spans": spans}


@cache
def _compiled(notices: tuple[tuple[str, str, int], ...]) -> list[Notice]:
    return [Notice(*n) for n in notices]


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("score", T.DoubleType())])
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN)),
])


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices=NOTICES, names=NAMES) -> DataFrame:
    """One row for each row of ``docs``: exact base phrases, labels with the fuzzy search's, and its spans.

    Spans are character positions in the document's normalised line (words joined by one space, one space in
    front), with the word they start in, their edits and 1 - edits / length. Edits never change one of ``names`` or a
    number: "released under the bsd license" is no misspelt MIT notice, nor is version 2 a misspelt version 3. ``base`` and
    ``notices`` are lists like those above, for other phrases and notices. ``score`` is 1 with a base phrase,
    else the best span's, else 0. A null text is empty: no words, null places, empty labels, score 0. Repeated
    rows give repeated results; extra columns are ignored; an empty table gives an empty table. The job is one
    scan without a shuffle.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in SCHEMA.names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                got = scan(text.as_py(), base, notices, names)
                places, spans = got["places"], got["spans"]
                row = (
                    doc_id, got["n_words"], len(places), places[0] if places else None, places[-1] if places else None, ",".join(got["base"]), ",".join(sorted({*got["base"], *(s[0] for s in spans)})),
                    1.0 if places else max([0.0, *(s[5] for s in spans)]), [dict(zip(SPAN.names, s, strict=True)) for s in spans],
                )
                for name, value in zip(SCHEMA.names, row, strict=True):
                    out[name].append(value)
            types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": kind}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types[n]) for n in SCHEMA.names], names=SCHEMA.names)

    return texts(docs).mapInArrow(run, SCHEMA)
