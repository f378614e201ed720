"""Ranked lexical search by pipelined term partitioning.

The terms of a bundle of items are dealt to term owners, rarest terms first, so
that every owner has about the same number of postings. A bundle meets one
block of documents at a time: it travels through the owners' stages, each a cogroup of the bundles with
that owner's postings on the block, carrying a sparse accumulator (document,
integer score) for every item; each stage adds the contributions of its own terms.
The last stage hands on the best documents of each block, and one ranking
takes the best of all blocks.

Accumulators stay small without losing a result: a document is left behind only
when its score plus the most that the later owners could add in this block
(the largest contribution of each term there) is below a bound that at least
``top`` documents already reach, in this block or in another. A document left
behind can only come back with a smaller score, which stays below that bound.

Documents are read once per benchmark block into an index of packed postings in the
shared folder: blocks of at most ``block_rows`` rows, ``block_bytes`` bytes
of text and ``block_postings`` postings (at least one document). Only terms
of the items are indexed. Benchmark blocks hold at most ``item_chars``
characters and bundles at most ``bundle_items`` items, so the vocabulary
that travels with the tasks is bounded.

Defined cases: null and empty texts have no terms: such documents are never ranked and do not
count in N, such items give no rows. Rows are ranked apart: repeated
documents each take a rank, repeated items are each ranked whole. Null ids are carried through
and come last among equal scores. Empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import parts_for, text_or_empty, written
from riskframe.llm.words import utf8_of, words_of

TOP = 50
ITEM_CHARS = 2_000_000
BUNDLE_ITEMS = 256
STAGES = 3
BLOCK_ROWS = 16_384
BLOCK_BYTES = 32 << 20
BLOCK_POSTINGS = 4_000_000

_INDEX = ("block long, ids array<long>, lengths binary, n_docs long, n_terms long, terms array<int>, dfs array<long>, "
          "docs binary, tfs binary")
_POSTINGS = "block long, ids array<long>, terms binary, ends binary, docs binary, parts binary"
_BUNDLES = "block long, rest binary, ends binary, docs binary, scores binary, reached array<long>"
_RESULT = "item int, doc_id long, score long"


@dataclass
class Item:
    key: int | None
    terms: list[int]


def _item_blocks(items: DataFrame, chars: int) -> Iterator[tuple[list[Item], dict[bytes, int]]]:
    """Benchmark items in blocks of bounded size, with the numbers of their terms."""
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = parts_for(size, chars)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == b).orderBy("key", "text").collect()
        vocabulary: dict[bytes, int] = {}
        out = []
        for r in part:
            terms = dict.fromkeys(words_of(r["text"].encode()))
            if terms:
                out.append(Item(r["key"], [vocabulary.setdefault(t, len(vocabulary)) for t in terms]))
        if out:
            yield out, vocabulary


class _Block:
    """Postings of the documents read so far."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.tfs, self.sizes = [], [], [], [], []
        self.bytes = self.postings = 0

    def add(self, key: int | None, utf8: bytes, vocabulary: dict[bytes, int]) -> None:
        words = words_of(utf8)
        found = Counter(map(vocabulary.get, words))
        found.pop(None, None)
        self.ids.append(key)
        self.lengths.append(len(words))
        self.terms.append(np.fromiter(found.keys(), np.int32, len(found)))
        self.tfs.append(np.fromiter(found.values(), np.int64, len(found)))
        self.sizes.append(len(found))
        self.bytes += len(utf8)
        self.postings += len(found)

    def row(self, number: int) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        term = np.concatenate([*self.terms, np.empty(0, np.int32)])
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint16), self.sizes)
        order = np.argsort(term, kind="stable")
        names, dfs = np.unique(term, return_counts=True)
        tfs = np.concatenate([*self.tfs, np.empty(0, np.int64)])[order]
        return pa.record_batch(
            [pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(pa.int64())),
             pa.array([lengths.tobytes()], pa.binary()), pa.array([int((lengths > 0).sum())], pa.int64()),
             pa.array([int(lengths.sum())], pa.int64()), pa.array([names], pa.list_(pa.int32())),
             pa.array([dfs], pa.list_(pa.int64())), pa.array([doc[order].tobytes()], pa.binary()),
             pa.array([tfs.tobytes()], pa.binary())],
            ["block", "ids", "lengths", "n_docs", "n_terms", "terms", "dfs", "docs", "tfs"])


def _index(docs: DataFrame, vocabulary: dict[bytes, int], rows: int, size: int, postings: int) -> DataFrame:
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            texts = batch.column(1)
            for i, key in enumerate(batch.column(0).to_pylist()):
                block.add(key, utf8_of(texts, i), told.value)
                if len(block.ids) >= rows or block.bytes >= size or block.postings >= postings:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.row(number)

    return written(docs.mapInArrow(run, _INDEX), "search-index")


@dataclass
class Plan:
    """What travels with a bundle: terms, weights and owners of its items, N and L."""
    items: list[Item]
    weight: np.ndarray        # per term of the vocabulary
    owner: np.ndarray         # per term; -1: not in this bundle, or in no document
    n_docs: int
    n_terms: int
    stages: int
    top: int

    def most(self, length: int) -> int:
        return 50 + (50 * length * self.n_docs) // self.n_terms

    def parts(self, tfs: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(10^9 tf) div (1000 tf + 20 m) of every posting."""
        names, where = np.unique(lengths, return_inverse=True)
        m = np.array([self.most(n) for n in names.tolist()], np.int64)[where]
        return 1_000_000_000 * tfs // (1000 * tfs + 20 * m[docs])


def _plan(items: list[Item], dfs: np.ndarray, n_docs: int, n_terms: int, stages: int, top: int) -> Plan:
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in dfs.tolist()], np.int64)
    owner = np.full(len(dfs), -1, np.int64)
    mine = np.array(sorted({t for i in items for t in i.terms if dfs[t] and weight[t] > 0}), np.int64)
    # rarest terms first; every owner has about the same number of postings
    mine = mine[np.argsort(dfs[mine], kind="stable")]
    before = np.cumsum(dfs[mine]) - dfs[mine]
    owner[mine] = np.minimum(before * stages // max(1, int(dfs[mine].sum())), stages - 1)
    return Plan(items, weight, owner, n_docs, n_terms, stages, top)


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    """(terms, ends, docs, tfs, lengths) of an index row."""
    return (np.array(row["terms"], np.int64), np.cumsum(np.array(row["dfs"], np.int64)),
            np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["tfs"], np.int64),
            np.frombuffer(row["lengths"], np.int64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _postings(index: DataFrame, told, stage: int) -> DataFrame:
    """The postings of one owner: per block its terms, the places of their documents and
    the part of their contribution that does not depend on the term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = told.value
        for row in _rows(batches):
            terms, ends, docs, tfs, lengths = _unpacked(row)
            mine = np.flatnonzero(plan.owner[terms] == stage)
            last = stage == plan.stages - 1
            if not len(mine) and not last:      # the last owner also names the documents
                continue
            sizes = np.diff(ends, prepend=0)[mine]
            at = np.repeat(ends[mine] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
            parts = plan.parts(tfs[at], docs[at], lengths).astype(np.int32)     # below 10^6
            yield _one(_POSTINGS, row["block"], row["ids"] if last else [], terms[mine].tobytes(),
                       np.cumsum(sizes).tobytes(), docs[at].tobytes(), parts.tobytes())

    return index.mapInArrow(run, _POSTINGS)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _one(schema: str, *values) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([v], _KINDS[kind]) for v, (_, kind) in zip(values, fields)],
                           [name for name, _ in fields])


def _bundles(index: DataFrame, told) -> DataFrame:
    """The bundle before its first stage, once per block: empty accumulators, and for every
    item the most that the owners after each stage can add in this block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = told.value
        for row in _rows(batches):
            terms, ends, docs, tfs, lengths = _unpacked(row)
            most = np.zeros(len(plan.weight), np.int64)
            if len(terms):
                most[terms] = np.maximum.reduceat(plan.parts(tfs, docs, lengths), ends - np.diff(ends, prepend=0))
            most *= plan.weight
            rest = np.zeros((plan.stages, len(plan.items)), np.int64)
            for i, item in enumerate(plan.items):
                t = np.array(item.terms)
                for s in range(plan.stages):
                    rest[s, i] = most[t[plan.owner[t] > s]].sum()
            yield _one(_BUNDLES, row["block"], rest.tobytes(), np.zeros(len(plan.items), np.int64).tobytes(), b"", b"", [])

    return index.mapInArrow(run, _BUNDLES)


def _advance(plan: Plan, stage: int, reached: np.ndarray, bundle: dict, owned: dict | None):
    """Adds one owner's contributions to the accumulators of a block. Yields per item
    (places kept, their scores, the score that ``top`` documents here reach or 0)."""
    rest = np.frombuffer(bundle["rest"], np.int64).reshape(plan.stages, len(plan.items))[stage]
    ends = np.frombuffer(bundle["ends"], np.int64)
    docs, scores = np.frombuffer(bundle["docs"], np.uint16), np.frombuffer(bundle["scores"], np.int64)
    at: dict[int, tuple[int, int]] = {}
    own = parts = np.empty(0, np.int64)
    if owned is not None:
        stop = np.frombuffer(owned["ends"], np.int64).tolist()
        at = dict(zip(np.frombuffer(owned["terms"], np.int64).tolist(), zip([0, *stop], stop)))
        own, parts = np.frombuffer(owned["docs"], np.uint16), np.frombuffer(owned["parts"], np.int32)
    n = 1 + int(max(docs.max(initial=0), own.max(initial=0)))
    begin = 0
    for i, item in enumerate(plan.items):
        total = np.zeros(n, np.int64)
        total[docs[begin:ends[i]]] = scores[begin:ends[i]]
        begin = ends[i]
        for t in item.terms:
            if t in at:
                a, b = at[t]
                total[own[a:b]] += plan.weight[t] * parts[a:b].astype(np.int64)
        places = np.flatnonzero(total)
        values = total[places]
        local = 0
        if len(values) >= plan.top:
            local = int(np.partition(values, len(values) - plan.top)[len(values) - plan.top])
        stay = values + rest[i] >= max(local, int(reached[i]))
        yield places[stay].astype(np.uint16), values[stay], local


def _stage(bundles: DataFrame, owned: DataFrame, told, stage: int, reached: np.ndarray) -> DataFrame:
    last = stage == told.value.stages - 1

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        plan: Plan = told.value
        if not left.num_rows:
            raise ValueError("postings of a block without its bundle")
        bundle = left.to_pylist()[0]
        here = right.to_pylist()[0] if right.num_rows else None
        got = list(_advance(plan, stage, reached, bundle, here))
        if last:
            return _best(plan, got, here)
        kept, scores, local = zip(*got)
        return pa.Table.from_batches([_one(
            _BUNDLES, bundle["block"], bundle["rest"], np.cumsum([len(k) for k in kept]).astype(np.int64).tobytes(),
            np.concatenate(kept).tobytes(), np.concatenate(scores).tobytes(), list(local))])

    return bundles.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(meet, _RESULT if last else _BUNDLES)


def _best(plan: Plan, got: list, here: dict | None) -> pa.Table:
    """The best ``top`` documents of a block for every item."""
    items, docs, scores = [], [], []
    ids = here["ids"] if here else []
    key = np.array([np.iinfo(np.int64).max if k is None else k for k in ids], np.int64)
    for i, (places, values, _) in enumerate(got):
        first = np.lexsort((key[places], -values))[:plan.top] if len(places) else []
        items += [i] * len(first)
        docs += [ids[p] for p in places[first].tolist()] if len(first) else []
        scores += values[first].tolist() if len(first) else []
    return pa.table([pa.array(items, pa.int32()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())],
                    ["item", "doc_id", "score"])


def _reached(bundles: DataFrame, known: np.ndarray) -> np.ndarray:
    """Per item the largest score that ``top`` documents of one block reach."""
    rows = (bundles.select(F.posexplode("reached").alias("item", "score")).groupBy("item")
            .agg(F.max("score").alias("score")).collect())
    out = known.copy()
    for r in rows:
        out[r["item"]] = max(out[r["item"]], r["score"])
    return out


def _bundle_hits(index: DataFrame, plan: Plan) -> DataFrame:
    """item, doc_id, score: at least the best documents of one bundle's items."""
    told = index.sparkSession.sparkContext.broadcast(plan)
    bundles, reached = _bundles(index, told), np.zeros(len(plan.items), np.int64)
    for stage in range(plan.stages - 1):
        bundles = written(_stage(bundles, _postings(index, told, stage), told, stage, reached), f"search-stage{stage}")
        reached = _reached(bundles, reached)
    hits = _stage(bundles, _postings(index, told, plan.stages - 1), told, plan.stages - 1, reached)
    name = F.element_at(F.array(*[F.lit(i.key).cast("long") for i in plan.items]), F.col("item") + 1)
    return hits.select(F.col("item"), name.alias("item_id"), "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, stages: int = STAGES, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_chars: int = ITEM_CHARS,
           bundle_items: int = BUNDLE_ITEMS, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES,
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Per item its ``top`` best documents with a score above 0: item_id, rank, doc_id, score."""
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("block_rows: 1 to 65536, places in a block have 16 bits")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("key"), text_or_empty(item_text_col).alias("text"))
    out = None
    for block, vocabulary in _item_blocks(items, item_chars):
        index = _index(rows, vocabulary, block_rows, block_bytes, block_postings)
        n_docs, n_terms, dfs = _statistics(index, len(vocabulary))
        if not n_docs:
            continue
        for at in range(0, len(block), bundle_items):
            hits = _bundle_hits(index, _plan(block[at:at + bundle_items], dfs, n_docs, n_terms, stages, top))
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
                      .select("item_id", "rank", "doc_id", "score"))
            out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else docs.sparkSession.createDataFrame(
        [], "item_id long, rank int, doc_id long, score long")


def _statistics(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of every term of the vocabulary."""
    told = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    dfs = np.zeros(size, np.int64)
    pairs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p"))
    for r in pairs.groupBy(F.col("p.terms").alias("t")).agg(F.sum("p.dfs").alias("df")).collect():
        dfs[r["t"]] = r["df"]
    return int(told["n"] or 0), int(told["l"] or 0), dfs
