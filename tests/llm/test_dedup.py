import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from riskframe.llm import embedding_dedup as emb
from riskframe.llm import ngram_join, suffix_dedup
from riskframe.llm.common import components, key128
from tests.llm import SF, brute


def pairs_of(df, text="text"):
    return [(r["doc_id"], r[text]) for r in df.collect()]


def as_sorted(rows):
    return sorted(rows, key=lambda t: tuple((x is None, x) for x in t))


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_jaccard_join_equals_all_pairs(request, which):
    df = request.getfixturevalue(which)
    got = ngram_join.jaccard_join(df).collect()
    want = brute.jaccard(pairs_of(df))
    assert as_sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in got) == as_sorted(want)


def test_jaccard_join_many_tiles_of_one_group(spark):
    rng = random.Random(4)
    base = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_join(df, tile_docs=16).collect()
    assert sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in got) == sorted(brute.jaccard(rows))


def test_keep_one_of_each_group(odd_documents):
    got = ngram_join.keep_one(odd_documents)
    assert got.columns == odd_documents.columns
    rows = as_sorted((r["doc_id"], r["text"] or "") for r in got.collect())
    ids = [r[0] for r in rows]
    assert 1 in ids and 2 not in ids and 3 not in ids        # 1 stands for its copies
    assert {4, 5, 6, 7, 9, 13} <= set(ids) and 8 not in ids    # wordless rows stay
    assert (None, "solo row") in rows and len([i for i in ids if i is None]) == 1


def test_keep_one_keeps_all_rows_without_words(spark):
    rows = [(None, None), (None, None), (None, ""), (None, "  "), (4, ""), (4, ""), (4, "\u2003\n\u00a0"), (4, "\u2003\n\u00a0"),
            (5, "some words"), (5, "some words"), (6, "some words"), (None, "x"), (None, "x")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_sorted(pairs_of(got)) == as_sorted([*rows[:8], (5, "some words"), (None, "x")])
    # the white space of the filter is that of the words
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    _, ends = ngram_join.Shingler(5)(chars)
    assert [c for c, n in zip(chars, np.diff(ends)) if not n] == [c for c in chars if re.match(f"[{ngram_join.SPACE}]", c)]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.999, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8 ** rows) ** bands >= 0.999
    more = rows + 1
    assert math.ceil(math.log(0.001) / math.log1p(-(0.8 ** more))) * more > 160


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_suffix_dedup_equals_all_strings(request, which):
    df = request.getfixturevalue(which)
    got = suffix_dedup.remove_repeats(df, batch_bytes=20_000, bucket_bytes=5_000).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    want = brute.repeats(pairs_of(df))
    assert as_sorted(map(tuple, got)) == as_sorted(w[:5] for w in want)
    assert sum(w[2] for w in want) > 500


def test_suffix_dedup_overlaps_and_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(1)
    alphabet = "abcd "
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30, 160))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, batch_bytes=2_000, bucket_bytes=2_000).collect()
    want = brute.repeats(rows)
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(
        (w[0], w[2], w[3], w[5]) for w in want)
    # runs of a text read in small pieces hold the same suffixes
    text = np.frombuffer(" ".join(t for _, t in rows).encode(), np.uint8)
    whole = suffix_dedup.find_runs(text, np.array([len(text)]), 50)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 997)
    cut = suffix_dedup.find_runs(text, np.array([len(text)]), 50)
    expand = lambda r: dict((int(s) + k, int(h)) for s, n, h in zip(r.start, r.count, r.hash) for k in range(n))
    assert expand(whole) == expand(cut) and len(expand(whole)) == len(text) - 49


def test_suffix_dedup_spreads_a_hot_minimizer(spark):
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    line, passage = "All rights reserved, see terms.", "A passage that most documents share. " * 4
    rows = [(i, own(90) + line + own(90) + (passage if i % 2 else "") + own(60)) for i in range(120)]
    want = sorted((w[0], w[2], w[3], w[5]) for w in brute.repeats(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot_runs in (10, 10 ** 9):
        got = suffix_dedup.remove_repeats(df, batch_bytes=8_000, bucket_bytes=1_000, hot_runs=hot_runs).collect()
        assert sorted((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    # the line's surroundings differ in every document: no bucket gets them all
    bits = 6
    batches = [pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": [t for _, t in part]})
               for part in (rows[k::4] for k in range(4))]
    most = {}
    for hot_runs in (10, 10 ** 9):
        sent = pa.concat_tables([suffix_dedup._send_minimizers(bits, 50)((pa.scalar(k),), b) for k, b in enumerate(batches)])
        back = pa.concat_tables([suffix_dedup._shared_minimizers(hot_runs)(sent.filter(pc.equal(sent["bucket"], k)))
                                 for k in set(sent["bucket"].to_pylist())])
        load = {}
        for k, b in enumerate(batches):
            runs = suffix_dedup._send_runs(bits, 50)((pa.scalar(k),), b, back.filter(pc.equal(back["batch"], k)))
            for to, n in zip(runs["bucket"].to_pylist(), runs["counts"].to_pylist()):
                load[to] = load.get(to, 0) + sum(n)
        most[hot_runs] = max(load.values()) / sum(load.values())
    assert most[10] < 0.1 < most[10 ** 9]


def test_suffix_dedup_spreads_repeated_rows(spark):
    df = spark.createDataFrame([(1, "one row, many times")] * 80, "doc_id long, text string").repartition(8)
    assert df.select(suffix_dedup.batch_of(64)).distinct().count() > 2
    text = "one text of more than fifty bytes, which two ids have, many times. "
    rows = [(1 + i % 2, text) for i in range(40)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), batch_bytes=200)
    assert sorted((r["doc_id"], r["n_removed"]) for r in got.collect()) == [(1, 0)] * 20 + [(2, len(text))] * 20


@pytest.mark.parametrize("letters, docs, seed", [("ab", 3, 0), ("a", 40, 1), ("abc", 400, 2), ("a\0", 9, 3)])
def test_previous_factors_equal_all_pairs(letters, docs, seed):
    """Strings of 18 to 40 bytes against every string of a smaller document."""
    rng = random.Random(seed)
    strings = ["".join(rng.choice(letters) for _ in range(rng.randrange(18, 41))).encode() for _ in range(120)]
    strings += [x[:rng.randrange(18, len(x) + 1)] + (b"" if rng.random() < 0.5 else rng.choice(strings))[:40 - len(x)]
                for x in rng.choices(strings, k=240)]
    doc = np.array([rng.randrange(docs) for _ in strings], np.int64)
    size = np.array([len(x) for x in strings])
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    factor, source = suffix_dedup.previous_factors(
        np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, doc, 18)
    for i, x in enumerate(strings):
        best = max((common(x, y) for j, y in enumerate(strings) if doc[j] < doc[i]), default=0)
        assert factor[i] == (best if best >= 18 else 0)
        if factor[i]:
            assert source[i] < doc[i]
            assert any(common(x, y) == best for j, y in enumerate(strings) if doc[j] == source[i])
        else:
            assert source[i] == doc[i]


def test_no_batch_table_stays_in_the_catalog(spark):
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a" * 60), (2, "a" * 60)], "doc_id long, text string"))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("repeat_batches_")]
    assert sorted((r["doc_id"], r["n_removed"]) for r in got.collect()) == [(1, 0), (2, 60)]


def test_more_batches_than_buckets(spark):
    """Over 100,000 batches of two bytes in 4 buckets: as many as Spark's limit of buckets does not allow."""
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(40, 120))) for _ in range(9)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 7)))) for i in range(40)]
    rows.append((99, "".join(rng.choice("efgh") for _ in range(210_000)) + pool[0] + pool[1]))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=2,
                                      bucket_bytes=50_000, most_buckets=4).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(
        (w[0], w[2], w[3], w[5]) for w in brute.repeats(rows))


def test_cut_repeats_keeps_the_columns(odd_documents):
    got = suffix_dedup.cut_repeats(odd_documents.withColumn("n_chars", F.lit(0).cast("long")))
    assert got.columns == [*odd_documents.columns, "n_chars"]
    rows = got.collect()
    assert len(rows) == odd_documents.count()
    assert all(r["n_chars"] == len(r["text"]) and r["shard"] == 5 and r["key"] == "x" for r in rows)
    assert {r["doc_id"]: r["text"] for r in rows}[3] != ""


def brute_embeddings(rows, threshold):
    def usable(v, label):
        return (label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
                and any(v))
    unit = [None if not usable(v, lab) else np.array(v, float) for _, v, lab in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links.append((i, j))
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return [(r[0], k, c) for r, k, c in zip(rows, n, brute.reach([r[0] for r in rows], links))]


def test_embeddings_equal_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    for threshold in (0.98, 0.3):
        got = emb.near_duplicates(df, threshold, tile_rows=8).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(
            brute_embeddings(rows, threshold))
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.001], 1), (4, [1.0, 0.0], 2),
            (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1),
            (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (None, [5.0, 0.0], 1), (12, [1e-30, 0.0], 1),
            (13, [-1.0, 0.0], 1), (14, [], 1), (15, [3e38, 1e30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    got = emb.near_duplicates(df).collect()
    assert as_sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == as_sorted(
        brute_embeddings(rows, 0.98))


def test_quantisation_bound_holds():
    rng = np.random.default_rng(2)
    x = emb.unit_rows(rng.normal(size=(300, 48)) * rng.lognormal(size=(300, 1)))
    codes, scale, rest = emb.quantise(x)
    approx = (codes.astype(float) @ codes.astype(float).T) * scale[:, None] * scale[None, :]
    bound = (1 + rest)[:, None] * rest[None, :] + rest[:, None]
    assert (np.abs(approx - x @ x.T) <= bound + 1e-12).all() and bound.max() < 0.05


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    edges = spark.createDataFrame([*links, (5, 5), (None, 2)], "u long, v long")
    got = {r["u"]: r["root"] for r in components(edges).collect()}
    low = brute.reach(list(range(500)), [(a, b) for a, b in links])
    assert got == {i: low[i] for i in {x for e in links if e[0] != e[1] for x in e}}
    keyed = edges.select(key128("u").alias("u"), key128("v").alias("v"))
    assert components(keyed.where("u <> v")).groupBy("root").count().count() >= len(set(got.values()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_join(docs).count() == 0
    assert ngram_join.keep_one(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert emb.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
