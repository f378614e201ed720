"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``k`` character edits, k being
``error_share`` of its length. Cut into k + 1 pieces, at least one piece then
occurs exactly. One Aho-Corasick pass over each whole document finds all piece
hits; around every hit the item's possible window is verified with Myers'
bit-parallel edit distance, which also gives the best end; a backward pass gives
the start. Case and white space are folded on both sides.

Items are broadcast in blocks of at most ``BLOCK_CHARS`` characters, counted
first; a larger benchmark takes one pass over the documents per block.

Defined cases: null and empty items match nothing, null and empty texts are
matched by nothing; equal items each give their own rows; repeated documents
give repeated rows; null ids are carried through; empty tables give an empty
table; other columns are ignored. A document that holds an item several times
gives one row, for the smallest distance and then the first place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import parts_for, text_or_empty

ERROR_SHARE = 0.05
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\S+")


def folded(text: str) -> str:
    """Lower case, length kept, white space folded to single spaces."""
    return " ".join(_lower(text).split())


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def places(text: str) -> list[int]:
    """For every character of ``folded(text)``, its index in the text."""
    out: list[int] = []
    for m in _WORD.finditer(_lower(text)):
        if out:
            out.append(m.start() - 1)
        out += range(*m.span())
    return out


def pieces(length: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of k + 1 pieces of nearly equal length."""
    cuts = [length * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts, cuts[1:]))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(smallest distance, first end) over all substrings of ``text`` by Myers' (1999)
    bit vectors, Python integers holding one bit per pattern character."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """Items prepared for matching whole documents."""

    def __init__(self, items: list[tuple[int | None, str]], error_share: float):
        import ahocorasick

        self.items, where = [], {}
        for key, text in items:
            t = folded(text or "")
            if not t:
                continue
            k = int(error_share * len(t))
            for a, b in pieces(len(t), k):
                where.setdefault(t[a:b], []).append((len(self.items), a))
            self.items.append((key, t, k, masks(t), masks(t[::-1])))
        self.trie = ahocorasick.Automaton()
        for piece, at in where.items():
            self.trie.add_word(piece, (len(piece), at))
        if where:
            self.trie.make_automaton()
        self.empty = not where

    def match(self, text: str) -> list[tuple]:
        """(item key, distance, allowed, start, length in the text) per matching item."""
        low = folded(text)
        if self.empty or not low:
            return []
        found: dict[int, set[int]] = {}
        for end, (n, at) in self.trie.iter(low):
            for i, a in at:
                found.setdefault(i, set()).add(end + 1 - n - a)
        out, at = [], None
        for i, starts in sorted(found.items()):
            key, item, k, peq, back = self.items[i]
            best = None
            for a, b in _windows(sorted(starts), len(item), k, len(low)):
                d, end = myers(peq, len(item), low[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = d, a, a + end
            if best:
                d, a, end = best
                _, n = myers(back, len(item), low[a:end][::-1])
                if at is None:
                    at = places(text)
                first = at[end - n]
                out.append((key, d, k, first, at[end - 1] + 1 - first))
        return out


def _windows(starts: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
    """Merged windows of the text in which the item can lie, given where it would
    start if the piece that hit were in place."""
    a = b = None
    for s in starts:
        lo, hi = max(0, s - k), min(n, s + m + k)
        if a is not None and lo <= b:
            b = max(b, hi)
            continue
        if a is not None:
            yield a, b
        a, b = lo, hi
    if a is not None:
        yield a, b


_OUT = "item_id long, distance int, allowed int, start int, length int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, distance,
    allowed, start, length (code points of the text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        found = _scan(rows, items, error_share)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no test item is found."""
    def scan(told):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(told.value, error_share)
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                yield batch.filter(pa.array([not matcher.match(t or "") for t in texts], pa.bool_()))
        return run

    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        docs = docs.mapInArrow(scan(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str,
            block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The test items in blocks of bounded size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("k"), text_or_empty(item_text_col).alias("t"))
    blocks = parts_for(items.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0, block_chars)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()
        yield [(r["k"], r["t"]) for r in part]


def _scan(rows: DataFrame, items: list[tuple[int | None, str]], error_share: float) -> DataFrame:
    told = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(told.value, error_share)
        for batch in batches:
            got = [(i, *hit) for i, t in enumerate(batch.column(1).to_pylist()) for hit in matcher.match(t)]
            cols = list(zip(*got)) if got else [()] * 6
            yield pa.record_batch([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()),
                                   *(pa.array(c, pa.int32()) for c in cols[2:])],
                                  ["doc_id", "item_id", "distance", "allowed", "start", "length"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}")
