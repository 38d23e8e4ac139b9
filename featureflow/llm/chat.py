r"""Chat formatting with typed content parts (DataFrame operations only).

Every turn has an ordered array of parts (type, text, ref, tokens). A visitor
renders each part: a text is escaped, an image, audio, document or other
attachment becomes the placeholder `<type turn.part>` (both counted from 1) and leaves a record of
its reference and of the tokens it expands to. A turn is rendered as
`<turn role>parts</turn>` and a line feed; the loss mask covers the bodies of
assistant turns.

Escaping is reversible and keeps `<`, `>` and `#` out of texts and roles, so no
control string (turn mark, placeholder, `### Assistant:`) can come from a text:
`\` becomes `\b`, `<` `\l`, `>` `\g`, `#` `\h`.

Turns are ordered by turn, role and text, nulls last. Null roles, types and texts: empty
role, text part, empty text; a turn without parts has an empty body.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("#", "\\h")]
OPEN, CLOSE = "<turn ", "</turn>\n"


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.coalesce(text, F.lit("")))


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), ESCAPES[::-1], text)


def text_parts(text: Column) -> Column:
    """A plain text as an array of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("tokens")))


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def placeholder(part: Column, turn_no: Column, i: Column) -> Column:
    return F.concat(F.lit("<"), escape(part["type"]), F.lit(" "), turn_no.cast("string"), F.lit("."), (i + 1).cast("string"), F.lit(">"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, per-turn loss flags and character spans, attachments, token count."""
    parts = F.coalesce(F.col("parts"), F.array().cast("array<struct<type:string,text:string,ref:string,tokens:int>>"))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.col(parts_col).cast("array<struct<type:string,text:string,ref:string,tokens:int>>").alias("parts"))
    rows = rows.withColumn("parts", parts)
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_last("turn"), "role", F.to_json("parts"))
    rows = rows.withColumn("no", F.row_number().over(order))
    no = F.col("no")
    body = F.array_join(F.transform("parts", lambda p, i: F.when(is_text(p), escape(p["text"])).otherwise(
        placeholder(p, no, i))), "")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">"))
    files = F.transform(F.filter(F.transform("parts", lambda p, i: F.struct(p.alias("p"), placeholder(p, no, i).alias("at"))),
                                 lambda x: ~is_text(x["p"])),
                        lambda x: F.struct(x["at"].alias("placeholder"), x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"),
                                           F.coalesce(x["p"]["tokens"], F.lit(0)).alias("tokens")))
    words = F.aggregate("parts", F.lit(0), lambda n, p: n + F.when(is_text(p), word_count(p["text"])).otherwise(
        F.coalesce(p["tokens"], F.lit(0))))
    rows = rows.select("conv", "no", "role", head.alias("head"), body.alias("body"), files.alias("files"), words.alias("tokens"))
    whole = F.length("head") + F.length("body") + len(CLOSE)
    rows = rows.withColumn("from", F.sum(whole).over(order_by_no()) - whole + F.length("head"))
    turn = F.struct("no", F.concat("head", "body", F.lit(CLOSE)).alias("text"), (F.col("role") == loss_role).alias("loss"),
                    "from", (F.col("from") + F.length("body")).alias("to"), "files")
    out = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"), F.sum("tokens").alias("expanded_tokens"))
    return out.select(
        F.col("conv").alias(conv_col), F.array_join(F.col("t.text"), "").alias("formatted"), F.col("t.loss").alias("loss"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["from"], x["to"])).alias("loss_spans"),
        F.flatten("t.files").alias("attachments"), F.col("expanded_tokens").cast("long").alias("expanded_tokens"))


def order_by_no():
    return Window.partitionBy("conv").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)


def read_back(formatted: Column, loss: Column) -> Column:
    """Array of (role, text, loss) from a formatted conversation; placeholders stay in the text as written."""
    marked = F.split(formatted, CLOSE)
    turns = F.slice(marked, 1, F.greatest(F.size(marked) - 1, F.lit(0)))
    end = lambda x: F.instr(x, ">")
    return F.zip_with(turns, loss, lambda x, on: F.struct(
        unescape(F.substring(x, F.lit(len(OPEN) + 1), end(x) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(x, end(x) + 1, F.length(x))).alias("text"), on.alias("loss")))
