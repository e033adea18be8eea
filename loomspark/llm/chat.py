"""Chat formatting with relational expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role merge into a block. A block is
`### role:` and a line break, the turns' texts, each closed by `</turn>`, and a line break. In roles and texts the
signs that control strings begin with are escaped: backslash as two, `<` as backslash l, `#` as backslash h; in roles
also `:` as backslash c. So a control string in a text never reads as one, and unescaping gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    """Between double backslashes every backslash begins a code."""
    plain = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))
    return F.when(~text.contains("\\"), text).otherwise(F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def format_chats(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation.

    loss_spans are code point ranges (start, length) of formatted, in order: the texts of the trained role, without
    their marks. Null texts and roles count as empty; turns with equal numbers stand in order of role and text; null
    turn numbers come first; a null conv_id is a conversation of its own; repeated rows are turns of their own. A
    conversation is one string, so its turns meet in one row. Other columns are ignored."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # blocks: adjacent turns of one role, as (role, escaped texts)
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def merge(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        grown = F.struct(last["role"].alias("role"), F.array_append(last["texts"], escape(t["text"])).alias("texts"))
        fresh = F.struct(t["role"].alias("role"), F.array(escape(t["text"])).alias("texts"))
        same = (F.size(blocks) > 0) & (last["role"] == t["role"])
        return F.when(same, F.array_append(F.slice(blocks, 1, F.size(blocks) - 1), grown)).otherwise(F.array_append(blocks, fresh))

    d = convs.withColumn("blocks", F.aggregate("turns", empty, merge))
    head = lambda b: F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit(MIDDLE))
    # segments: marks (loss false) and trained texts (loss true), in order
    seg = lambda s, loss: F.struct(s.alias("s"), F.lit(loss).alias("loss"))

    def pieces(b: Column) -> Column:
        body = F.transform(b["texts"], lambda x: F.array(F.struct(x.alias("s"), (b["role"] == trained).alias("loss")), seg(F.lit(CLOSE), False)))
        return F.concat(F.array(seg(head(b), False)), F.flatten(body), F.array(seg(F.lit("\n"), False)))

    d = d.withColumn("segments", F.flatten(F.transform("blocks", pieces)))
    d = d.withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["s"]), ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(acc: Column, x: Column) -> Column:
        n = F.length(x["s"])
        span = F.struct(acc["at"].alias("start"), n.alias("length"))
        return F.struct((acc["at"] + n).alias("at"), F.when(x["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return d.select("conv_id", "formatted", F.aggregate("segments", start, walk)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, texts and roles unescaped."""
    blocks = F.filter(F.split(formatted, OPEN, -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(b, ":", 1))
        body = F.substr(b, F.instr(b, F.lit(":")) + F.length(F.lit(MIDDLE)))
        texts = F.split(body, CLOSE, -1)
        return F.transform(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digest(chats: DataFrame) -> DataFrame:
    """conv_id and what reading formatted and loss_spans back gives."""
    d = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
