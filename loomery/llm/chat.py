"""Chat formatting, in DataFrame expressions only.

A conversation's turns are collected as structs, sorted by turn, merged where
neighbours share a role, and concatenated.  A block is opened by its role's
mark, holds its turns' texts with ``[SEP]`` between them, and is closed:

    <<SYS>>...<</SYS>>  [INST]...[/INST]  <s>...</s>  [ROLE name]...[/ROLE]

Every mark begins with ``<`` or ``[``; in texts these two and ``&`` are written
``&lt;``, ``&lsqb;`` and ``&amp;``, so no text can hold or complete a mark and
the way back is unique.  The loss mask is a list of spans of the output, one
for each assistant text.

Defined results: a null text or role counts as empty; turns are taken by turn
(null first), then role, then text, so ties and repeated rows have one order;
rows with a null conv_id form one conversation; an empty table gives no rows;
further columns are ignored.  A conversation is one value by contract, so its
turns meet in one row; nothing larger is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the template.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_CLOSE, SEPARATOR = "[ROLE ", "[/ROLE]", "[SEP]"
_OPENED = r"^(<<SYS>>|\[INST\]|<s>|\[ROLE [^\]]*\])"
_CHUNK = 128
_CLOSED = r"<</SYS>>|\[/INST\]|</s>|\[/ROLE\]"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&lsqb;"), F.lit("["))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit("&rsqb;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&rsqb;"), F.lit("]")))


def _mark(role: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for name, mark in table.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(turns: Column) -> Column:
    """Sorted turns with neighbours of one role merged: ``array<struct<role, texts>>``.

    A run begins where the role changes; each run's texts are aggregated from
    its slice of the turns, so the work is linear in the turns.
    """
    places = F.transform(turns, lambda t, i: F.struct(i.alias("at"), ((i == 0) | (F.get(turns, i - 1)["role"] != t["role"])).alias("first")))
    starts = F.transform(F.filter(places, lambda p: p["first"]), lambda p: p["at"])
    return _let(starts, lambda s: F.transform(s, lambda at, k: _run(turns, at, F.coalesce(F.get(s, k + 1), F.size(turns)))))


def _run(turns: Column, start: Column, end: Column) -> Column:
    texts = F.transform(F.slice(turns, start + 1, end - start), lambda t: escape(t["text"]))
    return F.struct(F.get(turns, start)["role"].alias("role"), texts.alias("texts"))


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_spans)`` from rows ``(conv_id, turn, role, text)``.

    ``loss_spans`` are ``struct<start,length>`` in code points from 0, one for each assistant text.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def marked(b: Column) -> Column:
        """A merged block and the marks of its role."""
        other = F.concat(F.lit(OTHER_OPEN), _escape_role(b["role"]), F.lit("]"))
        return F.struct(b["role"].alias("role"), _mark(b["role"], OPEN, other).alias("opened"), b["texts"].alias("texts"), _mark(b["role"], CLOSE, F.lit(OTHER_CLOSE)).alias("closed"))

    parts = chats.select("conv_id", F.transform(_blocks(F.col("turns")), marked).alias("parts"))

    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["opened"], F.array_join(p["texts"], SEPARATOR), p["closed"])), "")
    return parts.select("conv_id", whole.alias("formatted"), _loss_spans(F.col("parts")).alias("loss_spans"))


def _loss_spans(parts: Column) -> Column:
    """Where the texts of assistants are in the output.

    Appending to an array copies it, so places are summed up in chunks: the
    chunks' widths first, then the places within each chunk.
    """

    def measured(p: Column) -> Column:
        def one(t: Column, k: Column) -> Column:
            before = F.when(k == 0, F.length(p["opened"])).otherwise(len(SEPARATOR))
            after = F.when(k == F.size(p["texts"]) - 1, F.length(p["closed"])).otherwise(0)
            return F.struct(before.alias("before"), F.length(t).alias("n"), after.alias("after"), (p["role"] == "assistant").alias("loss"))

        return F.transform(p["texts"], one)

    def chunked(pieces: Column) -> Column:
        count = F.ceil(F.size(pieces) / F.lit(float(_CHUNK))).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(pieces, c * _CHUNK + 1, F.lit(_CHUNK)))

    def past(at: Column, x: Column) -> Column:
        return at + x["before"] + x["n"] + x["after"]

    def starts(chunks: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            return F.struct((s["at"] + F.aggregate(c, F.lit(0), past)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))

        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda s: s["all"])

    def within(start: Column, c: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            one = F.array(F.struct((s["at"] + x["before"]).alias("start"), x["n"].alias("length")))
            return F.struct(past(s["at"], x).alias("at"), F.when(x["loss"], F.concat(s["spans"], one)).otherwise(s["spans"]).alias("spans"))

        none = F.array().cast("array<struct<start:int,length:int>>")
        return F.aggregate(c, F.struct(start.alias("at"), none.alias("spans")), step, lambda s: s["spans"])

    def placed(chunks: Column) -> Column:
        return _let(starts(chunks), lambda at: F.flatten(F.transform(chunks, lambda c, i: within(F.get(at, i), c))))

    return _let(F.flatten(F.transform(parts, measured)), lambda pieces: _let(chunked(pieces), placed))


def parse_chats(formatted: DataFrame, *carried: str) -> DataFrame:
    """``(conv_id, turns array<struct<role,text>>)`` back from the output alone, with ``carried`` columns."""
    blocks = F.slice(F.split("formatted", _CLOSED), 1, F.size(F.split("formatted", _CLOSED)) - 1)

    def role_of(mark: Column) -> Column:
        out = _unescape_role(F.substring(mark, len(OTHER_OPEN) + 1, F.length(mark) - len(OTHER_OPEN) - 1))
        for role, sign in OPEN.items():
            out = F.when(mark == sign, F.lit(role)).otherwise(out)
        return out

    def opened(block: Column) -> Column:
        mark = F.regexp_extract(block, _OPENED, 1)
        texts = F.split(F.substring(block, F.length(mark) + 1, F.length(block)), r"\[SEP\]")
        return F.transform(texts, lambda t: F.struct(role_of(mark).alias("role"), unescape(t).alias("text")))

    return formatted.select("conv_id", F.flatten(F.transform(blocks, opened)).alias("turns"), *carried)


def loss_text(formatted: DataFrame) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), ""
    )
