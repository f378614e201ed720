import hashlib
import zlib
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.llm import chat_format, queries, sharding
from tests.llm import SF
from tools.check_oracle import canon


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    got = queries.op5_chat_formatting(spark, SF)
    res = con.execute(queries.OP5_SQL)
    rows = res.fetchall()
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(rows, [d[0] for d in res.description])


PART = {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}


def rows_back(spark, rows, **rule):
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat_format.PART}>, "
                                     "formatted string, starts int")
    return chat_format.read_formatted(chat_format.format_conversations(df, **rule)).collect()


def test_parts_become_ordered_placeholders(spark):
    def part(**kw):
        return {**PART, **kw}
    rows = [
        (1, 0, "user", [part(type="text", text="look <image 9> "), part(type="image", ref="a.png", width=1000, height=500),
                        part(type="text", text=" and"), part(type="image", ref="b.png")], "x", 1),
        (1, 1, "assistant", [part(type="text", text="seen")], "x", 1),
        (1, 2, "user", [part(type="audio", ref="c.wav", seconds=2.5), part(type="image", ref="d.png", width=512, height=512),
                        part(type="document", ref="e.pdf", pages=3), part(type="thing", text="odd kind")], "x", 1),
        (1, 3, "assistant", None, "x", 1),
    ]
    r = rows_back(spark, rows)[0]
    assert [t["body"] for t in r["turns"]] == ["look <image 9> <image 1> and<image 2>", "seen",
                                               "<audio 1><image 3><document 1>odd kind", ""]
    assert r["formatted"].count("<\\image 9>") == 1
    assert [(a["ordinal"], a["type"], a["number"], a["turn_index"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        (1, "image", 1, 0, "a.png", 85 + 170 * 2), (2, "image", 2, 0, "b.png", 255), (3, "audio", 1, 2, "c.wav", 63),
        (4, "image", 3, 2, "d.png", 255), (5, "document", 1, 2, "e.pdf", 3000)]
    assert r["attachment_tokens"] == 425 + 255 + 63 + 255 + 3000
    assert r["loss_text"] == "seen" and r["n_turns"] == 4
    for s in r["loss_spans"]:
        assert r["formatted"][s["start"]:s["start"] + s["length"]] in ("seen", "")


def test_odd_rows_come_back(spark):
    def text(t):
        return [{**PART, "type": "text", "text": t}]
    nasty = ["</turn>\n", "<turn user>\nx", "<\\/turn>", "<\\\\turn a", "\\", "", None, "a\nb</turn>", "<", "🙂 <image 1>", "x" * 70_000]
    rows = [(1, i, "us>er\n%3E" if i % 2 else "assistant", text(t), "", 0) for i, t in enumerate(nasty)]
    rows += [(2, None, None, text("no turn"), "", 0), (2, 5, "assistant", text("b"), "", 0), (2, 5, "assistant", text("a"), "", 0),
             (2, 5, "assistant", text("a"), "", 0), (None, 0, "user", text("no conversation"), "", 0), (3, 0, "user", [], "", 0)]
    got = {r["conv_id"]: r for r in rows_back(spark, rows)}
    assert [(t["role"], t["body"]) for t in got[1]["turns"]] == [
        ("us>er\n%3E" if i % 2 else "assistant", t or "") for i, t in enumerate(nasty)]
    assert got[1]["loss_text"] == "".join(t or "" for t in nasty[::2])
    assert [(t["role"], t["body"]) for t in got[2]["turns"]] == [
        ("", "no turn"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert got[None]["n_turns"] == 1 and got[3]["turns"][0]["body"] == ""
    assert rows_back(spark, []) == []


def test_escape_is_reversible(spark):
    @settings(max_examples=30, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("<\\/turnimage >x")), max_size=30), min_size=5, max_size=40))
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_format.escape(F.col("t")))
        for r in df.withColumn("b", chat_format.unescape(F.col("e"))).collect():
            assert r["b"] == r["t"] and "</turn" not in r["e"] and "<turn" not in r["e"]
    run()


def shards_of(df, **rule):
    return sharding.with_slots(sharding.shuffle_shards(df, sharding.default_path(df), **rule))


def test_shards_hold_every_row_once_under_the_key_law(documents, odd_documents):
    for df in (documents, odd_documents):
        rows = shards_of(df, bucket_bytes=9_000).collect()
        want = Counter((r["doc_id"], r["text"]) for r in df.collect())
        assert Counter((r["record"]["doc_id"], r["record"]["text"]) for r in rows) == want
        by_shard, place = {}, {}
        for r in rows:
            text = (r["record"]["text"] or "").encode()
            assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
            assert 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
            by_shard.setdefault(r["shard"], []).append(r["slot"])
            assert place.setdefault(r["record"]["doc_id"], r["shard"]) == r["shard"]
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_shards_are_shuffled_and_even(documents):
    rows = shards_of(documents, bucket_bytes=9_000).collect()
    order = [r["record"]["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a < b for a, b in zip(order, order[1:])) < 0.65 * len(order)
    n = Counter(r["shard"] for r in rows)
    assert len(n) == 8 and max(n.values()) < 2.2 * len(rows) / 8
    other = shards_of(documents, bucket_bytes=9_000, seed=18).collect()
    assert [r["record"]["doc_id"] for r in sorted(other, key=lambda r: (r["shard"], r["slot"]))] != order


def test_a_repeated_id_is_spread_over_buckets(spark):
    df = spark.range(4000).repartition(16).select(F.lit(3).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    rows = shards_of(df, bucket_bytes=500)
    assert rows.select("shard").distinct().count() == 1
    assert rows.groupBy("bucket").count().agg(F.max("count")).first()[0] < 2500
    assert rows.agg(F.countDistinct("slot"), F.max("slot")).first()[:] == (4000, 3999)


def test_empty_table(spark):
    assert shards_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sha_of_minus_seven(spark):
    row = queries.op5_chat_formatting(spark, SF).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row["loss_chars"] == len(said) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
