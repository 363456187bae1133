"""Licence scan: phrases and identifier tags by an Aho-Corasick automaton, expressions by a shunting yard.

One pass of the automaton over a text's words finds every phrase, also overlapping ones. Phrases in a
row that "and", "or" or "with" joins, and the expressions behind identifier tags, become postfix terms;
their value says how freely the text may be used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

# Phrases in words and their labels; the first four are the base.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc", "boost software license": "bsl", "the unlicense": "unlicense", "cc0": "cc0", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "public domain": "public-domain", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: How freely a text under a licence may be used, by the label's beginning; the longest that fits counts.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "cc-by-sa": 0.6, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "gpl": 0.5, "agpl": 0.4,
    "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.05,
}
UNKNOWN = 0.1
#: Words between two phrases up to which "and", "or" or "with" joins them.
JOINED = 3

_WORD_BYTES = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TAG = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_TERM = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def freedom(label: str) -> float:
    fits = [k for k in FREEDOM if label == k or label.startswith(k + "-")]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def postfix(terms: Iterable[str]) -> list[str]:
    """Infix terms in postfix order, by a shunting yard; what does not fit the grammar is left out."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether an operand has just ended
    for t in terms:
        if t == "(":
            if not operand:
                waiting.append(t)
        elif t == ")":
            if operand and "(" in waiting:
                while (top := waiting.pop()) != "(":
                    out.append(top)
        elif t in _RANK:
            if operand:
                while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[t]:
                    out.append(waiting.pop())
                waiting.append(t)
                operand = False
        elif not operand:
            out.append(t)
            operand = True
    if not operand:  # an operator without its right side
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    return out + [t for t in reversed(waiting) if t != "("]


def evaluate(terms: list[str]) -> float | None:
    """The freedom that a postfix expression grants: the better of "or", the worse of "and"; an exception ("with") halves what is missing."""
    stack: list[float] = []
    for t in terms:
        if t in _RANK:
            if len(stack) < 2:
                return None
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if t == "or" else min(a, b) if t == "and" else a + (1 - a) / 2)
        else:
            stack.append(freedom(t))
    return stack[-1] if len(stack) == 1 else None


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in [*BASE, *MORE, TAG]:
        found.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
    found.make_automaton()
    return found


def _words(text: str) -> list[bytes]:
    """The words of a text: split at spaces only, as a byte of a character beyond ASCII may look like one in Latin-1."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split(b" ")
    return [w for w in words if w] if b"" in words else words


def scan(text: str) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and (first word, phrase) of every place of a phrase, from left to right.

    Words are runs of ASCII digits, letters (in lower case) and characters beyond ASCII. Bytes are
    read as Latin-1, which keeps those beyond ASCII apart from all marks.
    """
    words = _words(text)
    row = " " + b" ".join(words).decode("latin-1") + " "
    out, counted, at = [], 0, 0
    for end, (phrase, size) in _automaton().iter(row):
        start = end - size + 1
        if start >= at:
            counted += row.count(" ", at, start)
            at = start
            out.append((counted, phrase))
        else:  # a phrase that ends later but begins earlier
            out.append((counted - row.count(" ", start, at), phrase))
    return len(words), sorted(out)


def notices(text: str, places: list[tuple[int, str]]) -> list[list[str]]:
    """The licence expressions of a text in postfix form: joined phrases, then tags."""
    out: list[list[str]] = []
    spans = [(at, at + phrase.count(" ") + 1, (BASE | MORE)[phrase]) for at, phrase in places if phrase != TAG]
    # of phrases that begin at the same word the longest counts
    longest = {at: (end, label) for at, end, label in sorted(spans)}
    words: list[bytes] | None = None
    infix: list[str] = []
    before = 0
    for at, (end, label) in sorted(longest.items()):
        if infix and at < before:
            continue
        joint = None
        if infix and at - before <= JOINED:
            if words is None:
                words = _words(text)
            joint = next((j for w in words[before:at] if (j := w.decode("latin-1")) in _RANK), None)
        if infix and joint is None:
            out.append(postfix(infix))
            infix = []
        infix += [joint, label] if joint else [label]
        before = end
    if infix:
        out.append(postfix(infix))
    if any(phrase == TAG for _, phrase in places):
        out += [e for m in _TAG.finditer(text) if (e := postfix(t.lower() for t in _TERM.findall(m[1])))]
    return out


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(pa.string())]
    for batch in slices(batches):
        rows = []
        for text in texts(batch):
            n, places = scan(text)
            base = [(at, BASE[p]) for at, p in places if p in BASE]
            terms = notices(text, places) if places else []
            labels = {x for _, x in base} | {t for e in terms for t in e if t not in _RANK}
            values = [v for e in terms if (v := evaluate(e)) is not None]
            starts = [at for at, _ in base]
            rows.append((n, len(base), min(starts, default=None), max(starts, default=None), sorted({x for _, x in base}), sorted(labels), min(values, default=0.0), [" ".join(e) for e in terms]))
        cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of each row.

    first_word and last_word are the least and greatest start of a base phrase, in words from 0; null
    without one. score is the freedom that the strictest notice leaves, 0 without any notice. Null and
    empty texts have no words. Repeated rows and rows without an id are scanned each; other columns
    are ignored. Rows stay in their partitions.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, expressions array<string>")
