"""Main-text extraction by wrapper induction over the pages of a host.

1. Tasks parse every page once into its folded DOM tree (repeated steps of sibling
   names are one) and write the tree, noise elements included, and its layout:
   the set of its paths of containers, then that of all its paths of names.
2. Every group of pages (a host, its pages with the same containers, those with the
   same paths) of at least ``least_pages`` pages gets up to ``references`` reference
   trees, those of the smallest seeded hash in each of as many hash classes (a
   grouped ``min_by``, combined before the shuffle). So every layout of a host has
   references of its own. A group of all pages of the next larger one is that one.
3. Every page's tree is aligned with the references of its groups by simple tree
   matching (Yang, 1991). Block texts that equal a text of the matched node of
   the best reference count as constant there. Texts constant on at least
   ``constant_share`` of a group's other pages are template for all pages of the host
   with the same containers (texts count with their path).
4. Tasks parse every page again and give the block texts of the content root
   (article, else main part, else body) that are neither noise elements (menus,
   footers, forms, adverts, comments, ...) nor template, in page order.

The alignment works on pages x references, so a host of any size is spread over
tasks; the template table holds a row per host and containers that have constant texts at all,
is written first, and Spark broadcasts it only when its written size is below
the session's broadcast threshold (otherwise it joins by shuffle).

Defined cases: null or empty html gives an empty text; pages without a host are
one host of their own; elements may be nested to any depth; repeated rows are extracted each; unclosed or truncated
markup is closed at the end of the page; an empty table gives an empty table;
other columns are ignored. If all texts of a page were template, they are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import dom
from riskframe.llm.common import byte_slices, text_or_empty, written


def host_of(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(url), r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Shapes:
    """Shapes of folded trees (names and children's shapes), numbered, with the scores of their
    matches. A pair of shapes is scored once, however often its trees occur."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.names: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, tree: list) -> dict[int, int]:
        """The shape of every node, by ``id``."""
        nodes, found = [tree], {}
        for n in nodes:             # grows: parents come before their children
            nodes += n[1]
        for n in reversed(nodes):
            key = (n[0], tuple(found[id(c)] for c in n[1]))
            if key not in self.ids:
                self.ids[key] = len(self.names)
                self.names.append(key[0])
                self.kids.append(key[1])
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1]))
            found[id(n)] = self.ids[key]
        return found

    def _known(self, a: int, b: int) -> int | None:
        if self.names[a] != self.names[b]:
            return 0
        return self.sizes[a] if a == b else self.scores.get((a, b))

    def score(self, a: int, b: int) -> int:
        """Nodes in the largest order-keeping match of equal names."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is None:
                xs, ys = self.kids[x], self.kids[y]
                open_ = [(i, j) for i in set(xs) for j in set(ys) if self._known(i, j) is None]
                if open_:
                    todo += open_
                    continue
                self.scores[x, y] = 1 + int(self.table(xs, ys)[0][-1, -1])
            todo.pop()
        return self._known(a, b)

    def table(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of all prefixes, scores of the pairs) of two lists of siblings."""
        inner = {x: np.array([self._known(x, y) for y in ys], np.int64) for x in set(xs)}
        m = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
        for i, x in enumerate(xs):
            np.maximum.accumulate(np.maximum(m[i, 1:], m[i, :-1] + inner[x]), out=m[i + 1, 1:])
        return m, np.array([inner[x] for x in xs]).reshape(len(xs), len(ys))


def tree_match(a: list, b: list, pairs: list | None = None, shapes: Shapes | None = None) -> int:
    """Simple tree matching of two folded trees: the nodes in the largest
    order-keeping match of equal names. ``pairs`` receives the matched nodes."""
    shapes = shapes or Shapes()
    of = {**shapes.of(a), **shapes.of(b)}
    score = shapes.score(of[id(a)], of[id(b)])
    todo = [(a, b)] if pairs is not None and score else []
    while todo:
        a, b = todo.pop()
        pairs.append((a, b))
        if of[id(a)] == of[id(b)]:
            todo += zip(a[1], b[1])
            continue
        m, inner = shapes.table(tuple(of[id(c)] for c in a[1]), tuple(of[id(c)] for c in b[1]))
        i, j = len(a[1]), len(b[1])
        while i and j:
            if inner[i - 1, j - 1] and m[i, j] == m[i - 1, j - 1] + inner[i - 1, j - 1]:
                todo.append((a[1][i - 1], b[1][j - 1]))
                i, j = i - 1, j - 1
            elif m[i, j] == m[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return score


def tree_size(a: list) -> int:
    nodes = [a]
    for n in nodes:
        nodes += n[1]
    return len(nodes)


def constant_texts(tree: list, references: list[list]) -> set[str]:
    """Block texts of the page that equal a text of the matched node in the
    reference that matches best."""
    best: tuple[float, list] = (0.0, [])
    shapes = Shapes()
    for ref in references:
        pairs: list = []
        score = 2 * tree_match(tree, ref, pairs, shapes) / (tree_size(tree) + tree_size(ref))
        if score > best[0]:
            best = (score, pairs)
    return {t for a, b in best[1] for t in set(a[2]).intersection(b[2])}


def page_trees(pages: DataFrame, url_col: str, html_col: str, seed: int) -> DataFrame:
    """(host, h, tree, layout) of every page; h is a seeded hash of the page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, 2):
                trees, layouts = [], []
                for page in batch.column(2):
                    root = dom.parse(page.as_py())
                    trees.append(json.dumps(dom.folded(root)))
                    layouts.append(dom.layout(root))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(trees, pa.string()),
                                       pa.array(layouts, pa.string())], ["host", "h", "tree", "layout"])

    rows = pages.select(host_of(url_col).alias("host"),
                        F.xxhash64(F.lit(seed), F.col(url_col), F.col(html_col)).alias("h"),
                        text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(run, "host string, h long, tree string, layout string")


def groups_of(layout: str) -> Column:
    """The groups of a page within its host: all pages, same containers, same paths."""
    return F.array(F.lit(""), F.substring_index(layout, "/", 1), F.col(layout))


def induce(pages: DataFrame, references: int = 3, least_pages: int = 5, constant_share: float = 0.8,
           url_col: str = "url", html_col: str = "html", seed: int = 5) -> DataFrame:
    """The wrapper table: host, outer (containers of the layout), template (array of constant block-text keys)."""
    trees = written(page_trees(pages, url_col, html_col, seed), "page-trees")
    of = trees.select("host", "h", "tree", F.explode(groups_of("layout")).alias("part"))
    refs = (of.groupBy("host", "part", F.pmod("h", F.lit(references)).alias("class"))
            .agg(F.min_by("tree", "h").alias("ref"), F.min("h").alias("ref_h"), F.count(F.lit(1)).alias("n"))
            .groupBy("host", "part").agg(F.collect_list("ref").alias("refs"), F.collect_list("ref_h").alias("ref_hs"),
                                         F.sum("n").alias("n")).where(F.col("n") >= least_pages))
    refs = written(refs, "references")
    # a group of all pages of the next larger one has the same template
    up = F.when(F.col("part").contains("/"), F.substring_index("part", "/", 1)).when(F.col("part") != "", F.lit(""))
    whole = refs.select("host", F.col("part").alias("up"), F.col("n").alias("n_up"))
    refs = (refs.withColumn("up", up).join(whole, ["host", "up"], "left")
            .where("up is null or n < n_up").select("host", "part", "refs", "ref_hs", "n"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, parts, keys = [], [], []
            for host, part, tree, own, rs in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "tree", "h", "both"))):
                others = [dom.unfolded(json.loads(r["ref"])) for r in rs if r["h"] != own]
                for t in constant_texts(dom.unfolded(json.loads(tree)), others):
                    hosts.append(host)
                    parts.append(part)
                    keys.append(t)
            yield pa.record_batch([pa.array(x, pa.string()) for x in (hosts, parts, keys)], ["host", "part", "key"])

    both = F.arrays_zip(F.col("refs").alias("ref"), F.col("ref_hs").alias("h"))
    found = (of.join(refs.select("host", "part", both.cast("array<struct<ref:string,h:bigint>>").alias("both")), ["host", "part"])
             .mapInArrow(align, "host string, part string, key string")
             .groupBy("host", "part", "key").agg(F.count(F.lit(1)).alias("k")))
    constant = (found.join(refs.select("host", "part", "n"), ["host", "part"])
                .where(F.col("k") >= constant_share * (F.col("n") - 1)).select("host", "part", "key"))
    # every page with these containers: the texts of its host and of the groups within
    outer = F.substring_index("layout", "/", 1).alias("outer")
    layouts = trees.select("host", outer).distinct().select("host", "outer", F.explode(F.array(F.lit(""), "outer")).alias("of"))
    constant = constant.select("host", F.substring_index("part", "/", 1).alias("of"), "key")
    return layouts.join(constant, ["host", "of"]).groupBy("host", "outer").agg(F.collect_set("key").alias("template"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id",
            **rule) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks (in the text), n_template (blocks
    of the whole page, noise elements included, that the wrapper knows as template)."""
    wrapper = written(induce(pages, url_col=url_col, html_col=html_col, **rule), "wrappers")
    id_type = pages.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, 2):
                outer, keys, texts, every = [], [], [], []
                for page in batch.column(2):
                    root = dom.parse(page.as_py())
                    found = content_blocks(root)
                    outer.append(dom.layout(root).split("/")[0])
                    keys.append([k for k, _ in found])
                    texts.append([t for _, t in found])
                    every.append([dom.text_key(*b) for b in dom.blocks(root, noise=True)])
                lists = (pa.array(x, pa.list_(pa.string())) for x in (keys, texts, every))
                yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(outer, pa.string()), *lists],
                                      ["page_id", "url", "host", "outer", "keys", "texts", "every"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept_n, template_n = [], [], []
            for keys, page, every, template in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                kept = outside(list(zip(keys, page)), template or ())
                texts.append(" ".join(kept))
                kept_n.append(len(kept))
                constant = set(template or ())
                template_n.append(sum(k in constant for k in every))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64()), pa.array(kept_n, pa.int32()),
                 pa.array(template_n, pa.int32())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_template"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        text_or_empty(html_col).alias("html"), host_of(url_col).alias("host"))
    found = rows.mapInArrow(read, f"page_id {id_type}, url string, host string, outer string, keys array<string>, "
                                  "texts array<string>, every array<string>")
    return found.join(wrapper, ["host", "outer"], "left").select("page_id", "url", "keys", "texts", "every", "template").mapInArrow(
        run, f"page_id {id_type}, url string, text string, n_chars long, n_blocks int, n_template int")


def content_blocks(page: dom.Node) -> list[tuple[str, str]]:
    """(key, text) of the blocks of the page's content, in page order."""
    found = []
    for root in dom.content_roots(page):
        names, n, path = [], root, ""
        while n.up is not None:
            n = n.up
            names.append(n.tag)
        for name in reversed(names):
            path = dom.step(path, name)
        found += dom.blocks(root, path)
    return [(dom.text_key(path, t), t) for path, t in found]


def outside(found: list[tuple[str, str]], template: list[str] | tuple) -> list[str]:
    """The texts outside the template; all, if there are none."""
    constant = set(template)
    return [t for key, t in found if key not in constant] or [t for _, t in found]


def main_blocks(page: str, template: list[str] | tuple) -> tuple[list[str], int]:
    """The block texts of the page's content outside the template, and how many
    blocks the content has."""
    found = content_blocks(dom.parse(page))
    return outside(found, template), len(found)
