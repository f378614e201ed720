import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.llm import license_scan, ranked_search, whitening
from riskframe.llm.spectral import polar, top_components
from tests.llm import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- licence scan ---------------------------------------------------------------------

def base_rows(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in license_scan.BASE.items() for k in [phrase.split()]
              for i in range(len(words) - len(k) + 1) if words[i:i + len(k)] == k]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({b for _, b in places})))


def other_notices(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {label for phrase, label in license_scan.NOTICES.items() for k in [phrase.split()]
            if any(words[i:i + len(k)] == k for i in range(len(words) - len(k) + 1))}


ODD = [(1, "Under the GNU\nGeneral  Public-License; gnu general public license gnu general public license"),
       (2, "cc by cc by CC BY-NC 4.0, ÄCC BY"), (3, "MIT license" * 3), (4, None), (5, ""), (6, " \x00\x7f "),
       (7, "x " * 200_000 + "the Apache License"), (None, "mit license"), (8, "ſpdx Kmit license İcc by ²cc by"),
       (9, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause */"),
       (9, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause */"),
       (10, "spdx-license-identifier: MIT AND\nSPDX-License-Identifier: " + "(" * 5000 + "mit" + ")" * 5000)]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_licence_places_and_labels(spark, documents, which):
    df = documents if which == "documents" else (
        spark.createDataFrame(ODD, "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("score", F.lit("x")))
    rows = license_scan.scan(df).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows],
                  key=repr) == sorted([(r["doc_id"], *base_rows(r["text"])) for r in df.collect()], key=repr)
    for r in rows:
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels or r["expressions"])


def test_notice_labels(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in license_scan.scan(documents).collect():
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == base | other_notices(texts[r["doc_id"]])


def test_licence_expressions(spark):
    rows = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(ODD, "doc_id long, text string")).collect()}
    assert rows[9]["labels"] == "bsd,gpl,mit" and rows[9]["obligation"] == 1
    assert [e["valid"] for e in rows[9]["expressions"]] == [True]
    assert [e["valid"] for e in rows[10]["expressions"]] == [False, True] and rows[10]["obligation"] == 1
    assert rows[2]["labels"] == "cc-by,cc-by-nc"


@pytest.mark.parametrize("text, valid, labels, obligation", [
    ("MIT", True, {"mit"}, 1), ("GPL-3.0-or-later AND MIT", True, {"gpl", "mit"}, 3),
    ("MIT AND GPL-2.0 OR 0BSD", True, {"mit", "gpl", "bsd"}, 0), ("MIT AND (GPL-2.0 OR 0BSD)", True, {"mit", "gpl", "bsd"}, 1),
    ("GPL-2.0 WITH GCC-exception-3.1", True, {"gpl"}, 2), ("GPL-2.0 with other-thing", True, {"gpl"}, 3),
    ("LicenseRef-Own", True, {"licenseref-own"}, 4), ("CC-BY-NC-4.0", True, {"cc-by-nc"}, 4), ("GPL-2.0+", True, {"gpl"}, 3),
    ("MIT this file is free", True, {"mit"}, 1), ("MIT OR", False, set(), None), ("(MIT", False, set(), None),
    ("", False, set(), None), ("OR MIT", False, set(), None), ("(MIT OR ISC) WITH GCC-exception-3.1", False, set(), None)])
def test_shunting_yard(text, valid, labels, obligation):
    assert license_scan.expression(text)[1:] == (valid, labels, obligation)


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.sampled_from(["mit", "gpl-2.0", "lgpl-2.1", "0bsd", "agpl-3.0"]),
                    lambda s: st.tuples(st.sampled_from(["and", "or"]), s, s), max_leaves=12))
def test_expressions_equal_their_trees(tree):
    def text(t):
        return t if isinstance(t, str) else f"({text(t[1])} {t[0]} {text(t[2])})"

    def value(t):
        if isinstance(t, str):
            return {"mit": 1, "gpl-2.0": 3, "lgpl-2.1": 2, "0bsd": 0, "agpl-3.0": 4}[t]
        return (max if t[0] == "and" else min)(value(t[1]), value(t[2]))
    assert license_scan.expression(text(tree))[3] == value(tree)


# --- whitening ------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["random", "flat", "clustered", "rank"])
def test_spectral_against_eigh(kind):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    vals = {"random": rng.random(40) * 100, "flat": np.full(40, 7.0), "clustered": np.repeat([9.0, 9.0 - 1e-9, 1.0, 1e-6], 10),
            "rank": np.r_[rng.random(10), np.zeros(30)]}[kind]
    a = (q * vals) @ q.T
    e, v = top_components(a, 16)
    assert np.allclose(e, np.sort(vals)[::-1][:16], atol=1e-12 * max(vals) * 40)
    assert np.allclose(v.T @ v, np.eye(16), atol=1e-12)
    assert np.linalg.norm(a @ v - v * e) < 1e-11 * max(vals)
    u = polar(a + np.eye(40))
    assert np.allclose(u @ u, np.eye(40), atol=1e-12)


def whiten_plain(rows, count=16):
    good = [(i, np.array(e, float)) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    x = {i: [math.floor(64 * c) + 1000000 for c in e] for i, e in good}
    fit = np.array(sorted(set(map(tuple, x.values()))), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, c in x.items():
        c = np.array(c, object)
        y = (((n * c - sums) / n).astype(float) @ v) / np.sqrt(e)
        out[i] = (n, int(((n * c - sums) ** 2).sum()), y[:count], (e / e.sum())[:count])
    return out


def test_whitening_equals_plain(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = whiten_plain(rows)
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(want)
    whole = np.array([[got[i][c + 1]["whitened"] for c in range(16)] for i in want])
    plain = np.array([want[i][2] for i in want])
    sign = np.sign((whole * plain).sum(axis=0))
    assert np.allclose(whole * sign, plain, atol=1e-9)
    for i, parts in got.items():
        assert sorted(parts) == list(range(1, 17))
        assert all(p["n"] == want[i][0] and int(p["deviation"]) == want[i][1] and p["identity_error"] < 1e-9 for p in parts.values())
        assert np.allclose([parts[c + 1]["explained"] for c in range(16)], want[i][3], rtol=1e-9)


def test_whitening_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    own = [(i, rng.standard_normal(3).tolist()) for i in range(40)]
    rows = own + [own[0], (None, own[1][1]), (90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 1.0]), (93, [1.0, -inf, 1.0]),
                  (94, []), (95, [1e300, 0.0, 0.0]), (96, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("x", F.lit(1))
    got = whitening.whiten(df).collect()
    want = whiten_plain(own, 3)
    assert sorted((r["vec_id"] for r in got if r["vec_id"] is not None)) == sorted([i for i in want for _ in range(3)] + [0] * 3)
    assert sum(r["vec_id"] is None for r in got) == 3
    assert {(r["vec_id"], int(r["deviation"])) for r in got if r["vec_id"] is not None} == {(i, v[1]) for i, v in want.items()}
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 94 or vec_id = 96")).count() == 0
    # far values: sums beyond 64 bits stay exact
    far = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 5.0])], "vec_id long, embedding array<double>")
    assert {(r["vec_id"], int(r["deviation"])) for r in whitening.whiten(far).collect()} == {
        (i, v[1]) for i, v in whiten_plain([(1, [1e12, 0.0]), (2, [-1e12, 5.0])], 1).items()}


# --- ranked search --------------------------------------------------------------------

def search_plain(docs, items, top):
    bags = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    n, total = len(bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for key, text in items:
        scores = []
        for i, w in bags:
            m = 100 - 50 + (50 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * w.count(t) // (1000 * w.count(t) + 20 * m))
                    for t in set(TERM.findall((text or "").translate(LOWER))) if t in df and t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(key, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("top, stages, block_rows, bundle", [(5, 3, 7, 4), (2, 1, 65536, 256), (50, 4, 3, 1)])
def test_search_equals_all_scores(spark, odd_documents, top, stages, block_rows, bundle):
    items = [(1, "quick fox0 over lazy3"), (2, "river cold"), (2, "river cold"), (None, "w1 w2 w976 the"), (3, None), (4, ""),
             (5, "absent"), (6, "THE the The solo ROW words"), (7, "ÜÄ é Zz q")]
    bench = (spark.createDataFrame(items, "item_id long, text string")
             .withColumn("score", F.lit(1)).withColumn("block", F.lit("x")))
    got = ranked_search.search(odd_documents.repartition(3), bench, top=top, stages=stages, block_rows=block_rows, bundle_items=bundle)
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == search_plain(docs, items, top)


def test_search_blocks_and_empty_tables(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = search_plain([(r["doc_id"], r["text"]) for r in documents.collect()],
                        [(r["item_id"], r["text"]) for r in bench.collect()], 50)
    assert sorted(map(tuple, ranked_search.search(documents, bench).collect()), key=repr) == want
    small = ranked_search.search(documents, bench, item_chars=3000, block_bytes=5000, block_postings=300, bundle_items=9)
    assert sorted(map(tuple, small.collect()), key=repr) == want
    assert ranked_search.search(documents.limit(0), bench).count() == 0
    assert ranked_search.search(documents, bench.limit(0)).count() == 0
