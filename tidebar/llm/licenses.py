"""License scans: exact phrases, and fuzzy search for short notices.

A text is lower-cased (A-Z), cut into words, and joined by single spaces. A notice of the list with at most k edits is split
into k + 1 pieces; whatever matches it within k edits holds one piece exactly, so places of the pieces are the only
candidates. Pieces that would begin the notice at about the same character are one candidate; at each that has enough of the
notice's letter triples, the regex library's bounded-error matching finds the best place, counts the edits and gives the span, so
a place is found beside better ones. Exact places need no matching. Notices are looked for from word start to word end; of places of one notice that overlap, the one with fewest edits stays, then the first,
and a place goes where a notice with another label stands with fewer edits in at least half of its words.

Nulls and odd rows: a null text is an empty one: no words, no labels (empty strings), null places, score 0. Each row is judged
by itself, so null ids, ties and repeated rows give rows of their own; extra columns are left out of the result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidebar.llm.common import table

# Base phrases with their labels, and the notices of the method with theirs.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("all rights reserved", "reserved"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("distributed under the boost software license", "bsl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("licensed under the european union public licence", "eupl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons zero", "cc0"),
    ("dedicated to the public domain", "public-domain"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("subject to the common development and distribution license", "cddl"),
    ("under the terms of the artistic license", "artistic"),
    ("under the zlib license", "zlib"),
    ("server side public license", "sspl"),
    ("business source license", "busl"),
    ("licensed under the gnu free documentation license", "gfdl"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10

_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def edits_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def pieces_of(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """Offset and text of edits + 1 pieces, about equally long."""
    at = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(at, at[1:], strict=False)]


@lru_cache
def matcher(notice: str):
    import regex

    return regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits_of(notice)}}}(?![^ ])")


@lru_cache
def triples(notice: str) -> list[str]:
    return [notice[i : i + 3] for i in range(len(notice) - 2)]


def possible(notice: str, part: str) -> bool:
    """Whether part has as many of the notice's triples as its edits must leave: each edit touches at most three."""
    own = triples(notice)
    have = {part[i : i + 3] for i in range(len(part) - 2)}
    return sum(x in have for x in own) >= len(own) - 3 * edits_of(notice)


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """Word number and label of each place of each base phrase; joined starts and ends with a space."""
    found = []
    for phrase, label in BASE:
        whole = b" %b " % phrase.encode()
        at = joined.find(whole)
        while at >= 0:
            found.append((joined.count(b" ", 0, at), label))
            at = joined.find(whole, at + 1)
    return found


@lru_cache
def seeds():
    """An automaton that finds every piece of every notice in one pass; its values are lists of (notice, offset)."""
    import ahocorasick

    places: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _) in enumerate(NOTICES):
        for offset, piece in pieces_of(notice, edits_of(notice)):
            places.setdefault(piece.decode("latin-1"), []).append((i, offset))
    out = ahocorasick.Automaton()
    for piece, at in places.items():
        out.add_word(piece, (len(piece), at))
    out.make_automaton()
    return out


def candidates(joined: bytes) -> dict[int, list[tuple[int, int]]]:
    """For each notice by number, stretches of joined in each of which it can stand once, in order."""
    starts: dict[int, set[int]] = {}
    for end, (length, at) in seeds().iter(joined.decode("latin-1")):
        for i, offset in at:
            starts.setdefault(i, set()).add(end + 1 - length - offset)
    out = {}
    for i, own in starts.items():
        edits = edits_of(NOTICES[i][0])
        found: list[tuple[int, int]] = []
        for at in sorted(own):
            if found and at <= found[-1][0] + 2 * edits:
                found[-1] = (found[-1][0], at)
            else:
                found.append((at, at))
        # Bytes beside the piece: an edit can be a character of up to four bytes.
        slack = 4 * edits + 1
        out[i] = [(max(0, a - slack), b + len(NOTICES[i][0]) + slack) for a, b in found]
    return out


def fuzzy_places(joined: bytes) -> list[tuple[str, str, int, int, int]]:
    """Label, notice, first word, words and edits of each place of each notice."""
    places = []
    for i, stretches in sorted(candidates(joined).items()):
        (notice, label), found = NOTICES[i], set()
        for a, b in stretches:
            while a > 0 and joined[a : a + 1] != b" ":  # whole words, so that characters stay whole too
                a -= 1
            while b < len(joined) and joined[b : b + 1] != b" ":
                b += 1
            part = joined[a:b].decode("utf-8", "replace")
            at = f" {part} ".find(f" {notice} ")
            if at >= 0:
                edits, start, length = 0, at, len(notice)
            elif possible(notice, part) and (m := matcher(notice).search(part)) and m.group().strip():
                edits, start, length = sum(m.fuzzy_counts), m.start(), len(m.group())
            else:
                continue
            held = part[start : start + length]
            before = part[:start] + held[: len(held) - len(held.lstrip())]
            found.add((edits, joined.count(b" ", 0, a) + before.count(" ") - 1, len(held.split())))
        taken: list[tuple[int, int]] = []
        for edits, start, n in sorted(found):
            if all(start + n <= x or start >= y for x, y in taken):
                taken.append((start, start + n))
                places.append((label, notice, start, n, edits))
    shared = lambda x, y: min(x[2] + x[3], y[2] + y[3]) - max(x[2], y[2])
    return [x for x in places if not any(y[0] != x[0] and y[4] < x[4] and 2 * shared(x, y) >= x[3] for y in places)]


def scan_text(text: str) -> dict:
    words = normalised(text)
    joined = b" %b " % b" ".join(words)
    base = base_places(joined)
    fuzzy = fuzzy_places(joined)
    spans = []
    if fuzzy:
        at = [m.span() for m in _WORDS.finditer(text)]
        spans = [{"label": k, "notice": n, "start": at[i][0], "end": at[min(i + c, len(at)) - 1][1], "edits": e} for k, n, i, c, e in fuzzy]
    own = {k for _, k in base}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((i for i, _ in base), default=None),
        "last_word": max((i for i, _ in base), default=None),
        "base_labels": ",".join(sorted(own)),
        "labels": ",".join(sorted(own | {x[0] for x in fuzzy})),
        "score": 1.0 if base else max((1 - e / len(n) for _, n, _, _, e in fuzzy), default=0.0),
        "spans": spans,
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,notice:string,start:long,end:long,edits:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: the base places, all labels, a score, and the spans of the notices in the text's characters."""
    span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]

    def run(batches):
        for b in batches:
            rows = [scan_text(x.as_py() or "") for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[k] for r in rows], kind) for k, kind in fields]], names=["doc_id", *[k for k, _ in fields]])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
