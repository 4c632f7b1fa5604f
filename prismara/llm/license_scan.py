"""Licence scans: an automaton finds identifier tags and notice phrases, and expressions are parsed.

Texts are reduced to lower-case words with one space between them; the
automaton runs over that. Where it meets an identifier tag with a colon behind
it, the expression there is read from the text itself and evaluated with a
shunting-yard parser (WITH binds tighter than AND, AND tighter than OR).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.llm.text import alnum_words

#: The phrases that always count, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases: label and how sure they are.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "released under the mit license": ("mit", 0.9),
    "mit license": ("mit", 0.5),
    "licensed under the apache license": ("apache-2", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.5),
    "gnu general public license": ("gpl", 0.7),
    "gnu lesser general public license": ("lgpl", 0.7),
    "gnu affero general public license": ("agpl", 0.7),
    "mozilla public license": ("mpl", 0.7),
    "creative commons attribution": ("cc-by", 0.6),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "cc by sa": ("cc-by-sa", 0.6),
    "dedicated to the public domain": ("public-domain", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.6),
    "boost software license": ("boost", 0.8),
    "eclipse public license": ("epl", 0.7),
    "common development and distribution license": ("cddl", 0.8),
    "european union public licence": ("eupl", 0.8),
    "sil open font license": ("ofl", 0.8),
    "server side public license": ("sspl", 0.8),
    "business source license": ("busl", 0.8),
    "this is free and unencumbered software released into the public domain": ("public-domain", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.8),
}
BASE_WEIGHT, TAG_WEIGHT = 0.9, 0.95
TAG = "spdx license identifier"
TAG_WORDS = TAG.count(" ") + 1
_WORD = re.compile(r"[0-9a-z\x80-\xff]+")
_COLON = re.compile(r"\s*:")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")

#: Families of identifiers: label and how much they restrict use, 0 to 1. Other identifiers are labels of their own behind OTHER and restrict fully.
OTHER = "other:"
FAMILIES = [
    (r"mit(-0)?", "mit", 0.1), (r"0bsd|bsd-\d-clause(-.+)?", "bsd", 0.1), (r"isc", "isc", 0.1), (r"zlib", "zlib", 0.1), (r"unlicense", "public-domain", 0.0), (r"cc0-1\.0", "cc0", 0.0),
    (r"apache-2(\.0)?", "apache-2", 0.15), (r"apache-1\.[01]", "apache-1", 0.2), (r"mpl-\d\.\d.*", "mpl", 0.4), (r"epl-\d\.\d", "epl", 0.4), (r"lgpl-\d.*", "lgpl", 0.5), (r"agpl-\d.*", "agpl", 0.9), (r"gpl-\d.*", "gpl", 0.8),
    (r"cc-by-\d\.\d", "cc-by", 0.2), (r"cc-by-sa(-\d\.\d)?", "cc-by-sa", 0.6), (r"cc-by-nc(-\d\.\d)?", "cc-by-nc", 0.9), (r"cc-by-(nc-)?nd(-\d\.\d)?|cc-by-nc-sa(-\d\.\d)?", "cc-by-restricted", 0.9), (r"licenseref-[a-z0-9.-]+", "licenseref", 1.0),
    (r"afl-\d\.\d", "afl", 0.2), (r"artistic-[12]\.0.*", "artistic", 0.3), (r"blueoak-1\.0\.0", "blueoak", 0.1), (r"bsl-1\.0", "boost", 0.1), (r"busl-1\.1", "busl", 0.9), (r"cddl-1\.[01]", "cddl", 0.4), (r"cecill-.+", "cecill", 0.6),
    (r"ecl-[12]\.0", "ecl", 0.2), (r"elastic-2\.0", "elastic", 0.9), (r"eupl-1\.[0-2]", "eupl", 0.6), (r"gfdl-\d.*", "gfdl", 0.6), (r"ms-pl", "ms-pl", 0.3), (r"ms-rl", "ms-rl", 0.4), (r"mulanpsl-\d\.\d", "mulan", 0.2), (r"ncsa", "ncsa", 0.1),
    (r"odbl-1\.0", "odbl", 0.6), (r"ofl-1\.[01].*", "ofl", 0.3), (r"openssl", "openssl", 0.2), (r"osl-\d\.\d", "osl", 0.7), (r"php-3\.0.*", "php", 0.2), (r"postgresql", "postgresql", 0.1), (r"psf-2\.0|python-2\.0.*", "python", 0.1), (r"qpl-1\.0.*", "qpl", 0.6),
    (r"ruby", "ruby", 0.3), (r"sspl-1\.0", "sspl", 1.0), (r"unicode-.+", "unicode", 0.1), (r"upl-1\.0", "upl", 0.1), (r"vim", "vim", 0.3), (r"w3c.*", "w3c", 0.1), (r"wtfpl", "wtfpl", 0.0), (r"x11.*", "x11", 0.1), (r"zpl-\d\.\d", "zpl", 0.2),
]
_FAMILIES = [(re.compile(p), label, weight) for p, label, weight in FAMILIES]
_BINDS = {"or": 1, "and": 2, "with": 3}


class Terms(NamedTuple):
    """What an expression comes to: its labels in order and how much it restricts use."""

    labels: tuple[str, ...]
    restricts: float


def _terms(identifier: str) -> Terms | None:
    if identifier in _BINDS or identifier in ("(", ")"):
        return None
    for pattern, label, weight in _FAMILIES:
        if pattern.fullmatch(identifier.removesuffix("+")):
            return Terms((label,), weight)
    return Terms((OTHER + identifier,), 1.0)


def _flat(tree: tuple) -> tuple[str, ...]:
    """The distinct labels of nested tuples, in order. Operators nest what they join and copy nothing, so reading is linear."""
    out: dict[str, None] = {}
    left = [tree]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out[x] = None
        else:
            left.extend(reversed(x))
    return tuple(out)


def evaluate(expression: str, at: int = 0) -> Terms | None:
    """The terms of the lower-case licence expression at a place of a text, or None if no whole one begins there.

    Of OR the less restrictive side counts, of AND the more restrictive one;
    WITH halves what its left side restricts. Reading ends where no operator
    or operand can follow, as in a comment's end after the expression.
    """
    out: list[Terms] = []
    waiting: list[str] = []
    operand, open_ = True, 0

    def apply(op: str) -> None:
        right, left = out.pop(), out.pop()
        if op == "with":
            out.append(Terms(left.labels, left.restricts / 2))
        else:
            out.append(Terms((left.labels, right.labels), (min if op == "or" else max)(left.restricts, right.restricts)))

    whole: tuple[list[Terms], list[str]] | None = None
    while m := _TOKEN.match(expression, at):
        token, after_with = m[1], bool(waiting) and waiting[-1] == "with"
        if operand:
            if token == "(" and not after_with:
                waiting.append("(")
                open_ += 1
                at = m.end()
                continue
            found = Terms((), 0.0) if after_with and token not in _BINDS and token not in "()" else _terms(token)
            if found is None:
                break
            out.append(found)
            operand = False
        elif token == ")" and open_:
            while waiting[-1] != "(":
                apply(waiting.pop())
            waiting.pop()
            open_ -= 1
        elif token in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                apply(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            break
        at = m.end()
        if not operand and not open_:
            whole = [*out], [*waiting]
    if whole is None:
        return None
    out, waiting = whole
    while waiting:
        apply(waiting.pop())
    return Terms(_flat(out[0].labels), out[0].restricts)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        # Letters stand for bytes one by one; the spaces around make words whole.
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float, float | None]:
    """Of one text: words, base places, first and last word of those, base labels, labels, score, restriction."""
    words = alnum_words(text)
    if not words:
        return 0, 0, None, None, "", "", 0.0, None
    spaced = b" " + b" ".join(words) + b" "
    first = last = None
    places, tags, counted, at = 0, [], 0, 0
    base: set[str] = set()
    labels: set[str] = set()
    doubt = 1.0
    for end, phrase in _automaton().iter(spaced.decode("latin-1")):
        # Matches come in the order of their ends, so words are counted once.
        counted, at = counted + spaced.count(b" ", at, end), end
        start = counted - phrase.count(" ") - 1
        if phrase == TAG:
            tags.append(start + TAG_WORDS - 1)
            continue
        if phrase in BASE:
            places += 1
            first, last = start if first is None else min(first, start), start if last is None else max(last, start)
            base.add(BASE[phrase])
            doubt *= 1 - BASE_WEIGHT
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            doubt *= 1 - weight
    restricts = None
    if tags:
        whole, wanted = text.lower().decode("latin-1"), set(tags)
        for i, m in enumerate(_WORD.finditer(whole)):
            if i in wanted and (colon := _COLON.match(whole, m.end())) and (terms := evaluate(whole, colon.end())):
                labels.update(terms.labels)
                doubt *= 1 - TAG_WEIGHT
                restricts = max(restricts or 0.0, terms.restricts)
    return len(words), places, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - doubt, restricts


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices of every whole text.

    Columns: ``id_col``, ``n_words``, ``n_base`` (places of base phrases),
    ``first_word`` and ``last_word`` (their smallest and largest start),
    ``base_labels``, ``labels`` (with those of further notices and of tagged
    expressions; distinct, sorted, comma-joined), ``score`` (how sure it is
    that the text carries a licence: one minus the product of each sign's
    doubt) and ``restricts`` (the strictest tagged expression, null if none).

    One row for each input row, whatever its id. Null and empty texts have no
    words, empty labels and score 0. An expression that cannot be read adds
    nothing. Columns of other names are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "restricts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(work, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, restricts double")
