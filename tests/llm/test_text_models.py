import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import decontaminate, dom, html_extract, packing, queries, toxicity
from riskframe.llm.common import read_table
from tests.llm import SF, brute

SF_FIT = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1.0
    y = np.array(labels) == 1
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_toxicity_held_out_accuracy(spark):
    got = queries.op8_multiple_instance_toxicity(spark, SF_FIT)
    known = got.join(read_table(spark, SF_FIT, "labels"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in known)
    assert auc([r["score"] for r in known], [r["toxic"] for r in known]) > 0.95
    hits = [(r["predicted"], r["toxic"]) for r in known]
    assert sum(p == t for p, t in hits) / len(hits) > 0.95
    assert sum(p for p, t in hits if not t) <= 0.01 * len(hits)
    assert got.count() == read_table(spark, SF_FIT, "documents").count()
    assert got.where("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.7)").count() == 0


def test_noisy_or_learns_the_sentence_from_document_labels():
    rng = random.Random(0)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]

    def sentence(bad):
        s = [rng.choice(words) for _ in range(8)]
        if bad:
            s[rng.randrange(8)] = rng.choice(["vile", "nasty", "foulest"])
        return " ".join(s)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        at = rng.randrange(12)
        texts.append(". ".join(sentence(bad and k == at) for k in range(12)))
        labels.append(int(bad))
    model = toxicity.fit_bags(texts, labels)
    for text, label in zip(texts, labels):
        score, found = model.score(text)
        assert (score >= 0.7) == bool(label)
        assert len(found) == label
        for start, n, p in found:
            assert re.search("vile|nasty|foulest", text[start:start + n]) and p >= 0.5
    assert model.score("vile")[0] > 0.7 and model.score("foul foulest foulesty")[0] > 0.7


def test_toxicity_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1), (5, 0), (7, 5)], "doc_id long, toxic int")
    model = toxicity.fit(odd_documents, labels)
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.fit(odd_documents, labels.where("false"))
    assert none.weights == {} and none.score("")[0] < 0.01
    assert toxicity.score(odd_documents.where("false"), model).count() == 0
    assert toxicity.reject(odd_documents, none, 0.7).columns == odd_documents.columns


def test_toxicity_sample_of_repeated_and_long_rows(spark):
    docs, labels = read_table(spark, SF, "documents").select("doc_id", "text"), read_table(spark, SF, "labels")
    plain = toxicity.fit(docs, labels, fit_docs=60)
    # rows that repeat a sampled id teach once, by their smallest text
    again = docs.unionByName(docs).unionByName(docs.select("doc_id", F.concat("text", F.lit(" worse")).alias("text")))
    assert toxicity.fit(again.repartition(5), labels, fit_docs=60) == plain
    # one text reaches the bound: one class only, so nothing is learnt
    assert toxicity.fit(docs, labels, fit_docs=60, fit_bytes=1) == toxicity.Model()
    assert toxicity.fit(docs, labels, fit_docs=60, fit_bytes=1 << 40) == plain


def test_toxicity_fits_on_the_bound(spark):
    docs, labels = (read_table(spark, SF, t) for t in ("documents", "labels"))
    a, b = (toxicity.fit(docs.repartition(n), labels, fit_docs=60) for n in (1, 5))
    assert a.weights == b.weights and a.bias == b.bias


def plain(text):
    return " ".join(text.lower().split())


def test_myers_equals_the_table_of_distances():
    rng = random.Random(5)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))
        assert decontaminate.myers(decontaminate.masks(p), len(p), t)[0] == brute.edit_in(p, t)


def test_matcher_finds_all_within_the_budget():
    rng = random.Random(6)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 90)))) for i in range(40)]
    matcher = decontaminate.Matcher(items, 0.08)
    for _ in range(60):
        text = []
        for _ in range(3):
            item = list(rng.choice(items)[1])
            for _ in range(rng.randrange(6)):
                k = rng.randrange(len(item) + 1)
                item[k:k + rng.randrange(2)] = rng.choice(["", "x", "a"])
            text += ["".join(rng.choice("abcdefgh ") for _ in range(20)), "".join(item)]
        text = "".join(text)
        low = plain(text)
        want = {i: brute.edit_in(plain(t), low) for i, t in items if plain(t) and low}
        want = {i: d for i, d in want.items() if d <= int(0.08 * len(plain(items[i][1])))}
        got = matcher.match(text)
        assert {g[0]: g[1] for g in got} == want
        for key, d, _, start, n in got:
            assert brute.edit_in(plain(items[key][1]), re.sub(r"\s+", " ", text[start:start + n].lower())) == d


def test_leaks_of_the_table(spark, documents):
    bench = read_table(spark, SF, "benchmark")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(documents, bench).collect()}
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    exact = {(r["doc_id"], i) for r in documents.collect() for i, t in items if t in plain(r["text"] or "")}
    assert exact and exact == {k for k, d in got.items() if d == 0}
    blocks = decontaminate.find_leaks(documents, bench, block_chars=900).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in blocks} == got
    kept = decontaminate.without_leaks(documents, bench)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in documents.collect()} - {k[0] for k in got}


def test_leaks_odd_rows(spark, odd_documents):
    bench = spark.createDataFrame([(1, "TWO   words"), (2, None), (3, ""), (None, "solo row"), (4, "two words")],
                                  "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["distance"]) for r in decontaminate.find_leaks(
        odd_documents, bench).collect())
    assert got == sorted([("7", "1", 0), ("8", "1", 0), ("7", "4", 0), ("8", "4", 0), ("None", "None", 0)])
    assert decontaminate.find_leaks(odd_documents, bench.where("false")).count() == 0
    assert decontaminate.find_leaks(odd_documents.where("false"), bench).count() == 0
    assert decontaminate.without_leaks(odd_documents, bench).where("doc_id in (7, 8)").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header class="site-header">Site</header><nav><ul><li><a>One</a><li>Two</ul></nav><!-- <p>no</p> -->
<script>var t="</p><p>code";</script><div class="cookie-notice">We use cookies</div><aside>side</aside>
<div id="ad-1" class="ad">Buy</div>
<article><h1>{title}</h1><p>{a} &amp; b&nbsp;c<br>d<b>bo</b>ld<p>{b}<form>mail <input></form>
<p class="line">Always the same line</p></article>
<section class="comments"><article><p>first!</p></article></section><footer>&copy; me</footer></body></html>"""


def test_main_text_by_names_and_template(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(title=f"Title {i}", a=f"alpha{i}", b=f"beta{i % 3}")) for i in range(9)]
    pages += [(20, "http://lonely.example/", PAGE.format(title="L", a="x", b="y")), (21, None, None), (22, "no url", ""),
              (23, "http://h.example/23", "<div class='content'>plain <i>te</i>xt &lt;&am"), (20, "http://lonely.example/", "<p>a<p>b")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn(
        "template", F.lit("x"))
    got = html_extract.extract(df).collect()
    texts = {(r["page_id"], r["text"]) for r in got}
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    for i in range(9):      # the line that all pages of the host have is template
        assert (i, f"Title {i} alpha{i} & b c dbold beta{i % 3}") in texts
    assert (20, "L x & b c dbold y Always the same line") in texts and (20, "a b") in texts
    assert (21, "") in texts and (22, "") in texts and (23, "plain text <&am") in texts
    assert html_extract.extract(df.where("false")).count() == 0


def test_copies_of_a_page_are_not_template(spark):
    html = PAGE.format(title="same", a="x", b="y")
    pages = [(i, "http://h.example/", html) for i in range(4)] + [
        (10 + i, "http://h.example/", PAGE.format(title=f"t{i}", a=f"a{i}", b=f"b{i}")) for i in range(8)]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got if r["page_id"] < 4} == {"same x & b c dbold y"}


def test_every_layout_of_a_host_has_its_template(spark):
    news = "<body><div><h1>News {i}</h1><p>story {i}</p>{more}<p>Read the magazine every day</p></div></body>"
    shop = "<body><div><h1>Thing {i}</h1><table><tr><td>price {i}<td>Taxes included</table></div></body>"
    game = "<body><div><div><p>game {i}</p><p>Play with friends</p></div></div></body>"
    rows = [(i, f"http://mix.example/{i}", page.format(i=i, more="<ul><li>point</ul>" * (i % 7 == 0)))
            for i, page in enumerate([news] * 20 + [shop] * 20 + [game] * 6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(46):     # of the news, three pages with a list are no layout of their own
        more = " point" if i % 7 == 0 else ""
        assert got[i] == (f"News {i} story {i}{more}" if i < 20 else f"Thing {i} price {i}" if i < 40 else f"game {i}")


def test_tree_matching_counts_and_pairs():
    a = ["r", [["x", [], ["1"]], ["y", [["z", [], []]], []]], []]
    b = ["r", [["y", [["z", [], []], ["w", [], []]], []], ["x", [], ["1"]]], []]
    pairs = []
    assert html_extract.tree_match(a, b, pairs) == 3 and [p[0][0] for p in pairs] == ["r", "y", "z"]
    assert html_extract.tree_match(a, ["q", [], []]) == 0 and html_extract.tree_size(a) == 4


def test_tree_matching_equals_the_plain_recursion():
    def plain(a, b):
        if a[0] != b[0]:
            return 0
        m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1], 1):
            for j, y in enumerate(b[1], 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain(x, y))
        return 1 + m[-1][-1]

    rng = random.Random(2)

    def tree(depth):
        return [rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)], []]
    for _ in range(200):
        a, b, pairs = tree(4), tree(4), []
        n = html_extract.tree_match(a, b, pairs)
        assert n == plain(a, b) == len(pairs) and all(x[0] == y[0] for x, y in pairs)


def test_deep_and_long_pages(spark):
    """5,000 nested elements, 50,000 alternating and 20,000 mixed ones, in seconds."""
    rng = random.Random(3)
    deep = "<body>" + "<div>" * 5000 + "<p>deep {i}</p>" + "</div>" * 5000 + "<p>Imprint</p></body>"
    long = "<body>" + "".join(f"<h2>head {k} {{i}}</h2><p>text {k} {{i}}</p>" for k in range(25_000)) + "<p>Imprint</p></body>"
    tags = [rng.choice(["p", "h2", "ul", "pre", "table", "blockquote", "h3"]) for _ in range(20_000)]
    mixed = "<body>" + "".join(f"<{t}>x {k} {{i}}</{t}>" for k, t in enumerate(tags)) + "<p>Imprint</p></body>"
    pages = [(7 * g + i, f"http://{name}.example/{i}", page.replace("{i}", str(i)))
             for g, (name, page) in enumerate((("deep", deep), ("long", long), ("mixed", mixed))) for i in range(6)]
    started = time.time()
    got = {r["page_id"]: r for r in html_extract.extract(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert time.time() - started < 120
    for i in range(6):
        assert got[i]["text"] == f"deep {i}" and got[i]["n_template"] == 1
        assert got[7 + i]["text"] == " ".join(f"head {k} {i} text {k} {i}" for k in range(25_000))
        assert got[14 + i]["text"] == " ".join(f"x {k} {i}" for k in range(20_000))


def test_wrapper_learns_the_noise_elements(spark):
    rows = [(i, f"http://one.example/{i}", f"<body><nav>Home News</nav><article><p>story {i}</p><p>Read on</p></article>"
             "<footer>Imprint</footer></body>") for i in range(8)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"story {r['page_id']}" and r["n_template"] == 3 for r in got)


def test_pages_of_the_table(spark):
    got = {r["page_id"]: r["text"] for r in queries.op2_wrapper_induction(spark, SF).collect()}
    import html
    for r in read_table(spark, SF, "pages").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        parts = re.split(r"<(?!/?b>)[^>]*>", body)
        assert got[r["page_id"]] == " ".join(" ".join(html.unescape(re.sub("<[^>]*>", "", p)) for p in parts).split())


def test_names_of_noise():
    for name in ("ad", "ad-1", "ad-slot-top", "post-ad", "sponsored", "cookie-notice", "site-footer", "sidebar", "comment-list",
                 "comments", "newsletter-signup", "share", "breadcrumbs", "main-nav", "notice", "banner"):
        assert dom.NOISE_NAMES.match(name), name
    for name in ("article", "article-body", "article-header", "content", "entry-content", "headline", "address", "lead",
                 "adventure", "text", "page", "main", "post", "story", "commentary", "shareholder"):
        assert not dom.NOISE_NAMES.match(name), name


def test_reader_survives_any_markup():
    rng = random.Random(8)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<b", ">", "<!--", "-->", "<script>", "</script>", "text ", "&amp",
            "<li>", "</ul>", "<table><tr><td>", "</article>", "<article>", "\"", "'", "<", "<br/>", "<a href='x'>"]
    for _ in range(500):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        html_extract.main_blocks(page, ())
        dom.folded(dom.parse(page))


def test_pipeline_equals_its_stages_in_plain_python(spark):
    docs = read_table(spark, SF, "documents")
    bench = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    cur, rows = docs, [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.fit(docs, read_table(spark, SF, "labels"), ~queries.held_out("doc_id"))
    for name, stage in corpus_pipeline.STAGES:
        if name == "toxicity":
            rows = [r for r in rows if model.score(r[1] or "")[0] < 0.7]
        elif name == "ngram_jaccard_join":
            rows = [r for r, w in zip(rows, brute.jaccard(rows)) if w[2] == r[0]]
        elif name == "suffix_array_dedup":
            rows = [(w[0], w[5].decode("utf-8", "ignore")) for w in brute.repeats(rows)]
        elif name == "benchmark_decontamination":
            matcher = decontaminate.Matcher(bench, decontaminate.ERROR_SHARE)
            rows = [r for r in rows if not matcher.match(r[1])]
        else:
            break
        cur = stage(spark, cur, SF)
        assert cur.columns == docs.columns and cur.dtypes == docs.dtypes
        cur = spark.createDataFrame(cur.collect(), cur.schema)
        assert sorted((r["doc_id"], r["text"]) for r in cur.collect()) == sorted(rows)
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in rows}
    want = packing.pack(cur, queries.TOKENIZER)
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want.select(keys).collect()))
