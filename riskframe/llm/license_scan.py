"""Licence scan: identifier tags and notice phrases by Aho-Corasick, licence
expressions by a shunting-yard parser.

Every whole text becomes its words, joined by single spaces; one Aho-Corasick
pass over them finds all phrases, which therefore match whatever stands
between their words. Where the words of an identifier tag occur, the tag's
expression is read from the text itself: ``with`` binds tighter than ``and``,
``and`` than ``or``, parentheses nest to any depth on explicit stacks. An
expression ends before the first word that cannot continue it; it is valid if
it names an operand, its parentheses close and no operator lacks an operand.

Values of an expression: its labels (of every licence it names) and its
obligation, 0 public domain, 1 permissive, 2 weak copyleft, 3 strong copyleft,
4 network copyleft or non-commercial. ``or`` leaves the choice (the smaller
obligation), ``and`` binds to both (the larger), ``with`` a known exception lowers strong copyleft
to weak. Identifiers outside the table are their own label with obligation 4.

The score is the noisy-or of the evidence: each distinct base phrase 0.7, each
other notice phrase 0.6, a valid tag 0.95, an invalid tag 0.3.

Defined cases: a null or empty text has no words, places or labels (``labels``
and ``base_labels`` are empty texts, score 0); repeated rows and ids give their
own rows; null ids are carried through; an empty table gives an empty table;
other columns are ignored. Nothing is shuffled; memory is that of one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.words import utf8_of, words_of

# fixed values: the base phrases
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# further notice phrases
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
}
# identifiers: the longest of these that begins a licence identifier gives label and obligation
FAMILIES = {
    "mit": ("mit", 1), "x11": ("mit", 1), "isc": ("isc", 1), "zlib": ("zlib", 1), "apache": ("apache", 1),
    "bsd": ("bsd", 1), "bsl": ("bsl", 1), "0bsd": ("bsd", 0), "unlicense": ("unlicense", 0), "cc0": ("cc0", 0),
    "cc-by": ("cc-by", 1), "cc-by-sa": ("cc-by-sa", 3), "cc-by-nc": ("cc-by-nc", 4), "cc-by-nd": ("cc-by-nd", 4),
    "cc-by-nc-sa": ("cc-by-nc-sa", 4), "cc-by-nc-nd": ("cc-by-nc-nd", 4), "lgpl": ("lgpl", 2), "mpl": ("mpl", 2),
    "epl": ("epl", 2), "cddl": ("cddl", 2), "gpl": ("gpl", 3), "agpl": ("agpl", 4), "sspl": ("sspl", 4),
}
EXCEPTIONS = ("classpath-exception", "gcc-exception", "llvm-exception", "linux-syscall-note", "autoconf-exception",
              "bison-exception", "font-exception", "ocaml-lgpl-linking-exception", "openssl-exception")
TAG = "spdx license identifier"

_TAG_AT = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.:+-]*|\S")
_BINDS = {"or": 1, "and": 2, "with": 3}
_WORD = re.compile(r"[a-z0-9][a-z0-9.:+-]*")
UNKNOWN = 4


def _family(name: str) -> tuple[str, int]:
    name = name.rstrip("+")
    best = max((f for f in FAMILIES if name == f or name.startswith(f"{f}-")), key=len, default=None)
    return FAMILIES[best] if best else (name, UNKNOWN)


def _is_exception(name: str) -> bool:
    return any(name == e or name.startswith(f"{e}-") for e in EXCEPTIONS)


def postfix(text: str) -> tuple[list[str] | None, str]:
    """(tokens in postfix order, the text of the expression); None if it is not valid."""
    out: list[str] = []
    ops: list[str] = []
    told: list[str] = []
    depth, operand_next = 0, True
    for token in _TOKEN.findall(text.lower()):
        if operand_next:
            if token == "(":
                ops.append(token)
                depth += 1
            elif token not in _BINDS and _WORD.fullmatch(token):
                out.append(token)
                operand_next = False
            else:
                break
        elif token == ")" and depth:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif token in _BINDS:
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[token]:
                out.append(ops.pop())
            ops.append(token)
            operand_next = True
        else:
            break
        told.append(token)
    shown = " ".join(told)
    if operand_next or depth:
        return None, shown
    out += reversed(ops)
    return out, shown


def evaluate(tokens: list[str]) -> tuple[set[str], int] | None:
    """(labels, obligation) of a postfix expression; None where ``with`` is not followed
    by an exception or does not follow a single licence."""
    labels: set[str] = set()
    stack: list[tuple[int, str | None]] = []
    for token in tokens:
        if token not in _BINDS:
            stack.append((_family(token)[1], token))
            continue
        (right, r_name), (left, l_name) = stack.pop(), stack.pop()
        if token == "with":
            if l_name is None or r_name is None:
                return None
            labels.add(_family(l_name)[0])
            stack.append((2 if left == 3 and _is_exception(r_name) else left, None))
            continue
        labels.update(_family(name)[0] for name in (l_name, r_name) if name)
        stack.append(((min if token == "or" else max)(left, right), None))
    value, name = stack.pop()
    if name:
        labels.add(_family(name)[0])
    return labels, value


def expression(text: str) -> tuple[str, bool, set[str], int | None]:
    """(text read, valid, labels, obligation) of the expression that a text begins with."""
    tokens, shown = postfix(text)
    value = evaluate(tokens) if tokens else None
    return (shown, True, *value) if value else (shown, False, set(), None)


class Scanner:
    def __init__(self):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for phrase in {**BASE, **NOTICES, TAG: None}:
            self.trie.add_word(f" {phrase} ", (len(phrase) + 2, phrase))
        self.trie.make_automaton()

    def scan(self, utf8: bytes) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, obligation)"""
        words = words_of(utf8)
        # one character per byte: phrases are ASCII, so nothing else can look like one
        joined = f" {b' '.join(words).decode('latin-1')} "
        base: set[str] = set()
        other: set[str] = set()
        n_base, first, last = 0, None, None
        at = passed = 0
        tagged = False
        for end, (size, phrase) in self.trie.iter(joined):
            if phrase in BASE:
                # a word's number is the number of spaces before its own
                begin = end + 1 - size
                passed += joined.count(" ", at, begin) if begin >= at else -joined.count(" ", begin, at)
                at = begin
                n_base += 1
                first = passed if first is None else min(first, passed)
                last = passed if last is None else max(last, passed)
                base.add(phrase)
            elif phrase == TAG:
                tagged = True
            else:
                other.add(phrase)
        told = []
        if tagged:
            told = [expression(m.group(1).decode("utf-8", "replace")) for m in _TAG_AT.finditer(utf8)]
        base_labels = {BASE[p] for p in base}
        labels = base_labels.union((NOTICES[p] for p in other), *(t[2] for t in told))
        miss = 0.3 ** len(base) * 0.4 ** len(other)
        if told:
            miss *= 0.05 if any(t[1] for t in told) else 0.7
        bound = [t[3] for t in told if t[1]]
        return (len(words), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 - miss,
                [{"text": t[0], "valid": t[1], "obligation": t[3]} for t in told], max(bound) if bound else None)


_EXPRESSIONS = pa.list_(pa.struct([("text", pa.string()), ("valid", pa.bool_()), ("obligation", pa.int32())]))
_COLUMNS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("expressions", _EXPRESSIONS), ("obligation", pa.int32())]
_OUT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "expressions array<struct<text string, valid boolean, obligation int>>, obligation int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    expressions (text, valid, obligation of every identifier tag), obligation (the largest)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = batch.column(1)
            got = [scanner.scan(utf8_of(texts, i)) for i in range(batch.num_rows)]
            cols = list(zip(*got)) if got else [()] * len(_COLUMNS)
            yield pa.record_batch([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(cols, _COLUMNS))],
                                  ["doc_id", *(name for name, _ in _COLUMNS)])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}")
