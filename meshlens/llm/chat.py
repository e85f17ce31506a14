"""Chat formatting with typed content parts (operator 5), with built-in functions only.

A turn is a list of typed parts. The visitor flattens them in order: text is escaped and put in
place; an image, audio or document part becomes a placeholder, numbered through the conversation,
its reference (and text, if any) goes to the attachment list, and its expanded token count to the
count of the conversation. Turns are marked by
``### role:`` and ``</turn>``; those control strings, placeholders and the escape sign itself are
escaped inside texts, so a formatted conversation reads back exactly.

Defined results: parts of a kind unknown here are placeholders too, of no tokens unless they say so,
if they refer to something, and texts if not; null texts, roles and part lists count as empty; turns are ordered by turn, then
role and text, so ties and repeated rows are kept in a fixed order; a null turn comes first; a null
conversation id is a conversation of its own; other columns are not read. A conversation is one
output row, so its turns meet in one task: that follows from the result, not from the method.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Control strings and what stands for them inside texts. The escape sign comes first; decoding runs backwards.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), ("<|", "\\p"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\w"))
OPEN, AFTER_ROLE, CLOSE = "### ", ":\n", "</turn>\n"
PART = "struct<type:string,text:string,ref:string,tokens:int>"
#: Tokens that one part of a kind expands to where the part does not say.
EXPANDED = {"image": 256, "audio": 128, "document": 512}


def escape(c: Column, table=ESCAPES) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), table, c)


def unescape(c: Column, table=ESCAPES) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), tuple(table)[::-1], c)


def _is_media(p: Column) -> Column:
    """Parts of a known kind, and those of any other kind that refer to something; the rest is text."""
    kind = F.coalesce(p["type"], F.lit("text"))
    return kind.isin(*EXPANDED) | ((kind != "text") & p["ref"].isNotNull())


def visit(parts: Column) -> Column:
    """Parts to struct<segs, refs, tokens>: escaped texts and the kinds of placeholders between them, their attachments in order, expanded tokens."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))

    def seg(p: Column) -> Column:
        media = _is_media(p)
        return F.struct(F.when(media, F.lit("")).otherwise(escape(F.coalesce(p["text"], F.lit("")))).alias("text"), F.when(media, F.regexp_replace(p["type"], "[^A-Za-z0-9_-]", "_")).alias("mark"))

    def ref(p: Column) -> Column:
        tokens = F.coalesce(p["tokens"], *(F.when(p["type"] == k, F.lit(n)) for k, n in EXPANDED.items()), F.lit(0))
        return F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens.alias("tokens"), p["text"].alias("text"))

    refs = F.transform(F.filter(parts, _is_media), ref)
    return F.struct(F.transform(parts, seg).alias("segs"), refs.alias("refs"), F.aggregate(refs, F.lit(0), lambda a, r: a + r["tokens"]).alias("tokens"))


def render(segs: Column, first: Column) -> Column:
    """Segments as text; placeholders are numbered from ``first``."""
    marks = F.filter(F.transform(segs, lambda s, i: F.when(s["mark"].isNotNull(), i)), lambda i: i.isNotNull())

    def one(s: Column, i: Column) -> Column:
        number = first + F.array_position(marks, i).cast("int") - 1
        return F.when(s["mark"].isNull(), s["text"]).otherwise(F.concat(F.lit("<|"), s["mark"], F.lit(":"), number.cast("string"), F.lit("|>")))

    return F.when(F.size(marks) == 0, F.array_join(F.transform(segs, lambda s: s["text"]), "")).otherwise(F.array_join(F.transform(segs, one), ""))


def text_parts(text: Column) -> Column:
    """A plain text as a part list."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans (start and length in code points), attachments, media_tokens, n_turns.

    The placeholder ``<|kind:k|>`` stands for attachment k of the conversation.
    """
    parts = F.col(parts_col) if parts_col else text_parts(F.col(text_col))
    role = F.coalesce(F.col(role_col), F.lit(""))
    one = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), visit(parts).alias("v")).select("conv", "turn", "role", "v.segs", "v.refs", "v.tokens")
    # what precedes a turn is a running sum, so that a long conversation is no quadratic fold
    by = Window.partitionBy("conv").orderBy("turn", "role", "segs", "refs")
    before = lambda c: F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    one = one.select("conv", F.row_number().over(by).alias("no"), "turn", "role", "segs", "refs", "tokens", before(F.size("refs")).alias("first"))
    one = one.select("conv", "no", "turn", "role", "segs", "refs", "tokens", F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(AFTER_ROLE)).alias("head"), render(F.col("segs"), F.col("first")).alias("body"))
    at = before(F.length("head") + F.length("body") + len(CLOSE)) + F.length("head")
    span = F.when(F.col("role").isin(*loss_roles), F.struct(at.alias("start"), F.length("body").alias("length")))
    t = F.struct("no", F.concat("head", "body", F.lit(CLOSE)).alias("said"), span.alias("span"), "refs", "tokens")
    whole = one.select("conv", t.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"),
        F.array_compact(F.transform("turns", lambda t: t["span"])).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["refs"])).alias("attachments"),
        F.aggregate("turns", F.lit(0), lambda a, t: a + t["tokens"]).alias("media_tokens"),
        F.size("turns").cast("long").alias("n_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """A formatted conversation back to array<struct<role, text>>."""
    pieces = F.split(formatted, CLOSE, -1)
    body = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(p: Column) -> Column:
        at = F.locate(AFTER_ROLE, p)
        role = F.substring(p, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substring(p, at + len(AFTER_ROLE), F.length(p))).alias("text"))

    return F.transform(body, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))))
