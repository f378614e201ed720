"""N-gram Jaccard self-join by MinHash banding.

1. Tasks shingle every whole text (lower-cased words between white space, ``n``
   words; a text of fewer words is one shingle) and MinHash it; band and row
   counts are the steepest that reach the target recall at the threshold.
2. Equal texts are one class; the band rows of the classes are shuffled on
   (band, hash). Every class links to the smallest class of each bucket, which
   keeps a bucket of any size at one row per member.
3. Classes connected over buckets form candidate clusters. Clusters are cut into
   tiles (by rows and bytes); every two tiles of a cluster meet in one task,
   which compares the full shingle sets of all their texts by a blocked
   incidence product and returns link counts and a spanning forest of the
   verified links, never the pairs.
4. Components join the forests.

Defined cases: a null or empty text (no word) has no shingles, links with nothing
and is a component of its own; rows that repeat an id are documents of their
own with one id; a null id is a component's id only if all its ids are null; an
empty table gives an empty table; very long texts are compared whole; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import components, forest, runs_by, text_key, text_or_empty, written

N_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 160
TILE_DOCS = 256
TILE_BYTES = 4 << 20
_TEXTS = 1000
_MEMO = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, for
    which a pair at the threshold meets in some band with the target recall."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold ** rows)))
        if bands * rows > max_hashes:
            break
        best = bands, rows
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """64-bit shingle hashes of texts; words are hashed once per batch."""

    def __init__(self, n: int):
        self.n = n
        self.memo: dict[str, int] = {}

    def _word(self, w: str) -> int:
        h = self.memo.get(w)
        if h is None:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            h = self.memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes of all texts, ends): text i has ends[i]:ends[i + 1]."""
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        word = np.fromiter(map(self._word, names), np.uint64, len(names))[code]
        if "" in names:       # leading or trailing white space gives empty pieces
            full = code != names.index("")
            at = np.concatenate([[0], np.cumsum(full)])[at]
            word = word[full]
        n_words = np.diff(at)
        count = np.where(n_words >= self.n, n_words - self.n + 1, (n_words > 0).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(count)])
        first = np.repeat(at[:-1] - ends[:-1], count) + np.arange(ends[-1])
        width = np.repeat(np.minimum(n_words, self.n), count)
        h = width.astype(np.uint64)
        padded = np.concatenate([word, np.zeros(self.n, np.uint64)])
        for k in range(self.n):
            h = np.where(k < width, _mix(h * _GOLD + padded[first + k]), h)
        return h, ends


def signature_bands(h: np.ndarray, ends: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """Band hashes (texts x bands) of non-empty shingle runs."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    starts = ends[:-1]
    out = np.zeros((len(starts), bands), np.uint64)
    buf = np.empty_like(h)
    for b in range(bands):
        key = np.full(len(starts), b, np.uint64)
        for r in range(b * rows, b * rows + rows):
            np.bitwise_xor(h, add[r], out=buf)
            np.multiply(buf, odd[r], out=buf)
            key = _mix(key * _GOLD + np.minimum.reduceat(buf, starts))
        out[:, b] = key
    return out


def sign(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, key, n_bytes, bands) of every row; bands is empty without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for k in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(k, _TEXTS)
                h, ends = shingle(part.column("text").to_pylist())
                full = np.flatnonzero(np.diff(ends))
                size = np.zeros(part.num_rows, np.int64)
                flat = np.empty(0, np.int64)
                if len(full):
                    size[full] = bands
                    flat = signature_bands(h, np.append(ends[full], ends[-1]), bands, rows, seed).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()),
                                                 pa.array(flat))
                yield pa.record_batch([part.column("doc_id"), part.column("key"), part.column("n_bytes"), lists],
                                      ["doc_id", "key", "n_bytes", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key binary, n_bytes int, bands array<long>")


def verified_links(sets: list[np.ndarray], left: int, threshold: float, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sorted distinct shingle arrays with Jaccard similarity of
    at least the threshold. With ``left`` > 0 only pairs of one of the first ``left``
    sets with one of the others. Intersections are sums of incidence products
    over blocks of the shingles that at least two sets hold."""
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    code = np.cumsum(new) - 1
    shared = np.bincount(code) > 1
    keep = shared[code]
    code, owner = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
    a, b = (slice(0, left), slice(left, None)) if left else (slice(None), slice(None))
    n = len(sets)
    both = np.zeros((left or n, n - left), np.float32)
    cuts = np.searchsorted(code, np.arange(0, (code[-1] + 1 if len(code) else 0) + block, block))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if lo < hi:
            m = np.zeros((n, block), np.float32)
            m[owner[lo:hi], code[lo:hi] - k * block] = 1
            both += m[a] @ m[b].T
    union = size[a][:, None] + size[b][None, :] - both
    link = both >= threshold * union - 1e-9
    if not left:
        link &= np.triu(np.ones(link.shape, bool), 1)
    i, j = np.nonzero(link)
    return i, j + left


def _compare(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for (_, i, j), rows in runs_by(batches, ["cluster", "i", "j"]):
            # tile i first; a repeated row of one document is one text
            seen: dict[bytes, tuple] = {}
            for tile, key, copies, text in zip(*(rows.column(c).to_pylist() for c in ("tile", "key", "copies", "text"))):
                seen.setdefault(key, (tile != i, key, copies, text))
            members = sorted(seen.values(), key=lambda r: r[:2])
            left = sum(not r[0] for r in members) if i != j else 0
            if len(members) < 2 or i != j and not 0 < left < len(members):
                continue
            h, ends = shingle([r[3] for r in members])
            sets = [np.unique(h[a:b]) for a, b in zip(ends, ends[1:])]
            x, y = verified_links(sets, left, threshold)
            if not len(x):
                continue
            copies = np.array([r[2] for r in members], np.float64)
            links = np.bincount(x, copies[y], len(members)) + np.bincount(y, copies[x], len(members))
            low = forest(x, y, len(members))
            at = np.flatnonzero(links)
            yield pa.record_batch([pa.array([members[k][1] for k in at], pa.binary()),
                                   pa.array([members[k][1] for k in low[at]], pa.binary()),
                                   pa.array(links[at].astype(np.int64))], ["u", "v", "n"])
    return run


def jaccard_join(df: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, recall: float = RECALL,
                 max_hashes: int = MAX_HASHES, id_col: str = "doc_id", text_col: str = "text",
                 tile_docs: int = TILE_DOCS, tile_bytes: int = TILE_BYTES, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, key (of its text), class_id (smallest id with the
    same text), n_links (other documents linked directly, copies included),
    component_id (smallest id reachable), kept (it stands for its component)."""
    bands, rows = choose_bands(threshold, recall, max_hashes)
    text = text_or_empty(text_col)
    docs = df.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), F.octet_length(text).alias("n_bytes"),
                     text.alias("text"))
    signed = written(sign(docs, n, bands, rows, seed), "signatures")
    classes = written(signed.where(F.size("bands") > 0).groupBy("key").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"),
        F.first("bands").alias("bands")), "text-classes")
    banded = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    heads = (banded.groupBy("band", "hash").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("m"))
             .where("m > 1").select("band", "hash", "head"))
    meets = banded.join(heads, ["band", "hash"]).select(F.col("key").alias("u"), F.col("head").alias("v"))
    clusters = components(meets, "clusters")
    member = clusters.join(classes.select("key", "class_id", "copies", "n_bytes"), clusters["u"] == classes["key"]).select(
        "key", "class_id", "copies", "n_bytes", F.col("root").alias("cluster"))
    sizes = member.groupBy("cluster").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / tile_docs, F.sum(F.col("n_bytes").cast("double")) / tile_bytes)).cast("int").alias("tiles"))
    placed = member.join(sizes, "cluster").withColumn(
        "tile", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("tiles")).cast("int"))
    placed = written(placed.select("cluster", "tile", "tiles", "key", "class_id", "copies"), "cluster-members")
    # one text per class: the rows that carry the class's smallest id. The members grow with the
    # documents, so this join is by shuffle at every size
    texts = docs.select("doc_id", "key", "text").hint("merge").join(
        placed, (docs["key"] == placed["key"]) & docs["doc_id"].eqNullSafe(placed["class_id"])).select(
        "cluster", "tile", "tiles", placed["key"], "copies", "text")
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least("tile", t).alias("i"), F.greatest("tile", t).alias("j")))
    met = (texts.select("cluster", "tile", "key", "copies", "text", F.explode(others).alias("p"))
           .select("cluster", "p.i", "p.j", "tile", "key", "copies", "text")
           .repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"))
    found = written(met.mapInArrow(_compare(n, threshold), "u binary, v binary, n long"), "verified-links")
    links = found.groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    roots = components(found.select("u", "v"), "near-components").withColumnRenamed("u", "key")
    known = written(classes.select("key", "class_id", "copies").join(links, "key", "left").join(roots, "key", "left")
                    .select("key", "class_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                            F.coalesce("root", "key").alias("root")), "near-classes")
    # the document that stays is the smallest (id, key), null ids last
    heads = known.groupBy("root").agg(F.min(F.struct(F.col("class_id").isNull().alias("no_id"), F.col("class_id"),
                                                     F.col("key"))).alias("head"))
    done = known.join(heads, "root").select("key", "class_id", "n_links", F.col("head.class_id").alias("component_id"),
                                            F.col("head.key").alias("head_key"))
    return (signed.select("doc_id", "key").join(done, "key", "left")
            .select("doc_id", "key", F.when(F.col("head_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
                    .alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.when(F.col("head_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id"),
                    (F.col("head_key").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id"))
                                                   & (F.col("key") == F.col("head_key")))).alias("kept")))


#: the white space that parts words
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """The rows of ``df``, all columns, of the documents that stand for their
    component. Rows with one id and text are one document; rows without words all stay.
    Repeated rows are combined before the shuffle; the decisions join on the same keys."""
    names = [f"`{c}`" for c in df.columns]
    keys = ["__id", "__no_id", "__key"]

    def keyed(rows: DataFrame, id_: str, key) -> DataFrame:
        return rows.withColumns({"__id": F.coalesce(F.col(id_).cast("long"), F.lit(0)), "__no_id": F.col(id_).isNull(),
                                 "__key": key})

    wordless = text_or_empty(text_col).rlike(rf"\A[{SPACE}]*\z")
    empty, df = df.where(wordless), df.where(~wordless)
    kept = jaccard_join(df, id_col=id_col, text_col=text_col, **rule).where("kept").select("doc_id", "key")
    kept = keyed(kept, "doc_id", F.col("key")).select(*keys).distinct()
    rows = keyed(df, id_col, text_key(text_or_empty(text_col))).dropDuplicates(keys)
    return rows.join(kept, keys).select(*names).union(empty.select(*names))
