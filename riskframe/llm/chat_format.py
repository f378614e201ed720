"""Chat formatting with typed content parts (DataFrame functions only).

A conversation row is (conversation, turn, role, content); content is an array
of parts ``struct<type, text, ref, width, height, seconds, pages>``. The
visitor flattens the parts of a turn in order: text parts are escaped and kept,
an image, audio or document part becomes the placeholder ``<image 1>``,
``<audio 1>`` or ``<document 1>`` (numbered over the whole conversation per
type), its reference is recorded and its expanded token count is worked out.

A turn is written as ``<turn ROLE>\\n`` + body + ``</turn>\\n``. Inside texts, the
``<`` of a control string (``<turn``, ``</turn``, ``<image``, ``<audio``,
``<document``) is followed by one more backslash than before, so that
``unescape`` gives the text back whatever backslashes it held. In role names
``%``, ``>`` and new lines are percent-coded.

Defined cases: a null text is empty; a null role is the empty role; a null or
empty content gives an empty body; a part of unknown or null type is taken as
text; turns are ordered by turn (null first), ties by role, then body, so
repeated rows are kept and stand side by side; rows with a null conversation
form one conversation of their own; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")
END = "</turn>\n"
_CONTROL = r"(/?turn|image|audio|document)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)" + _CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)" + _CONTROL, r"<$1$2")


def _role_code(role: Column) -> Column:
    for a, b in (("%", "%25"), (">", "%3E"), ("\n", "%0A")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_text(role: Column) -> Column:
    for a, b in (("%3E", ">"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def text_part(text: Column) -> Column:
    """Content of a plain-text turn: one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin(*KINDS), part["type"]).otherwise(F.lit("text"))


def part_tokens(part: Column, tile: int = 512, tile_tokens: int = 170, base_tokens: int = 85,
                tokens_a_second: float = 25.0, tokens_a_page: int = 1000) -> Column:
    """Tokens into which an attachment's placeholder expands: an image by its
    tiles, audio by its seconds, a document by its pages (unknown sizes count
    as one tile, second or page). Text has none here."""
    tiles = (F.ceil(F.coalesce(part["width"], F.lit(tile)) / tile)
             * F.ceil(F.coalesce(part["height"], F.lit(tile)) / tile))
    return (F.when(part["type"] == "image", base_tokens + tile_tokens * tiles)
            .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * tokens_a_second))
            .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * tokens_a_page)
            .otherwise(F.lit(0)).cast("long"))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         content_col: str = "content", loss_role: str = "assistant", **token_rule) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans,
    attachments, attachment_tokens.

    loss_spans holds (turn_index, turn_start, start, length) in code points,
    turn_start and start from the beginning of ``formatted``; it covers the
    bodies of the turns of ``loss_role``. attachments holds (ordinal, type,
    number, turn_index, ref, tokens) in the order of the placeholders.
    """
    parts = F.coalesce(F.col(content_col), F.array().cast(f"array<{PART}>"))
    rows = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.transform(parts, lambda p: F.struct(
            _kind(p).alias("kind"), F.when(_kind(p) == "text", F.coalesce(p["text"], F.lit(""))).alias("text"),
            p["ref"].alias("ref"), part_tokens(p, **token_rule).alias("tokens"))).alias("parts"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "parts"))).alias("t"))
    # every attachment with its place, then its number among its kind
    flat = F.flatten(F.transform("t", lambda t, i: F.transform(
        F.filter(t["parts"], lambda p: p["kind"] != "text"),
        lambda p: F.struct(p["kind"].alias("type"), i.alias("turn_index"), p["ref"].alias("ref"),
                           p["tokens"].alias("tokens")))))
    convs = convs.withColumn("flat", flat)
    for k in KINDS:    # the number that the first part of this kind gets in every turn
        convs = convs.withColumn(f"{k}s", _before(F.transform("t", _count_of(k))))

    def body(t: Column, i: Column) -> Column:
        def piece(p: Column, j: Column) -> Column:
            out = escape(p["text"])
            for k in KINDS:
                number = (F.get(F.col(f"{k}s"), i) + F.size(F.filter(F.slice(t["parts"], 1, j + 1),
                                                                    lambda q: q["kind"] == k)))
                out = F.when(p["kind"] == k, F.concat(F.lit(f"<{k} "), number.cast("string"), F.lit(">"))).otherwise(out)
            return out
        return F.array_join(F.transform(t["parts"], piece), "")

    turns = F.transform("t", lambda t, i: F.struct(
        F.concat(F.lit("<turn "), _role_code(t["role"]), F.lit(">\n")).alias("head"), body(t, i).alias("body"),
        (t["role"] == loss_role).alias("loss")))
    convs = convs.select("conv_id", "flat", turns.alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    convs = convs.withColumn("starts", _before(F.transform(pieces, F.length)))
    spans = F.filter(F.transform("turns", lambda t, i: F.struct(
        i.alias("turn_index"), F.get(F.col("starts"), i).alias("turn_start"),
        (F.get(F.col("starts"), i) + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"),
        t["loss"].alias("loss"))), lambda s: s["loss"])
    number = F.transform("flat", lambda a, i: F.struct(
        (i + 1).alias("ordinal"), a["type"].alias("type"),
        F.size(F.filter(F.slice(F.col("flat"), 1, i + 1), lambda b: b["type"] == a["type"])).alias("number"),
        a["turn_index"].alias("turn_index"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(pieces, "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["turn_index"], s["turn_start"], s["start"], s["length"]))
        .alias("loss_spans"),
        number.alias("attachments"),
        F.aggregate("flat", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"))


def _count_of(kind: str):
    return lambda t: F.size(F.filter(t["parts"], lambda p: p["kind"] == kind))


def _before(sizes: Column) -> Column:
    """Sums of the entries before each entry of an int array."""
    return F.aggregate(
        sizes, F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, n: F.struct(F.concat(acc["at"], F.array(acc["n"])).alias("at"), (acc["n"] + n).alias("n")),
        lambda acc: acc["at"])


def read_formatted(df: DataFrame) -> DataFrame:
    """Read ``formatted`` back: adds turns (array of role, body with placeholders,
    unescaped) and loss_text (the unescaped text under the loss spans, in order).
    Escaped texts hold no ``</turn``, so the end mark alone splits the turns."""
    cut = F.split(F.col("formatted"), END, -1)
    pieces = F.slice(cut, 1, F.size(cut) - 1)
    df = df.withColumn("pieces", pieces)
    turns = F.transform("pieces", lambda p: F.struct(
        _role_text(F.substring_index(F.substr(p, F.lit(7)), ">\n", 1)).alias("role"),
        unescape(F.substr(p, F.locate(">\n", p) + 2)).alias("body")))
    # a span is cut out of its own turn: its start there is start - turn_start
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(
        F.get(F.col("pieces"), s["turn_index"]), (s["start"] - s["turn_start"] + 1).cast("int"), s["length"])))
    return df.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, "")).drop("pieces")
