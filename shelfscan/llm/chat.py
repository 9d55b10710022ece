"""Chat formatting with Spark expressions.

A conversation's rows are collected as structs (map tasks collect first),
sorted by turn, adjacent rows of one role are merged into one block, and the
pieces are joined. A block is

    ### <role>:
    <text><next/><text></turn>

In texts and roles a backslash goes before every backslash and ``#`` and
inside ``</turn>`` and ``<next/>``, in roles also before ``:``. So none of the
template's marks occurs in a text, and taking the backslashes out again gives
the text back. A conversation is one output value, so it has to fit in a row.

Defined results: null text and null role are empty; a null turn sorts first;
rows with the same turn sort by role, then text, and repeated rows stay;
conversations without an id are one conversation; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
#: rows whose lengths are summed in one step of the running totals
STEP = 512
#: code points of the pieces that spans are cut from
CUT = 4096

HEAD, HEAD_END, NEXT, END = "### ", ":\n", "<next/>", "</turn>\n"


def _escaped(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>"), ("<next/>", "<\\next/>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once per row.

    A column used inside a lambda would otherwise be merged into it by the
    optimizer and computed for every element; a generator is not merged.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _running(values: Column) -> Column:
    """Totals before each value of an array of longs, in steps of ``STEP`` so that long arrays aren't copied once per value."""
    size = F.size(values)
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(size / STEP).cast("int") - F.lit(1), F.lit(0)))
    zero = F.array(F.lit(0).cast("long"))

    def totals(array: Column) -> Column:
        return F.aggregate(array, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    parts = F.transform(steps, lambda k: totals(F.slice(values, k * STEP + 1, STEP)))
    before = totals(F.transform(parts, lambda p: F.element_at(p, -1)))
    shifted = F.zip_with(parts, F.slice(before, 1, F.size(before) - 1), lambda p, n: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + n))
    return F.flatten(shifted)


def format_conversations(rows: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_mask) per conversation.

    ``loss_mask`` is an array of struct(turn, start, length): the turn's number
    from 0, and where its escaped text lies in ``formatted``, in code points
    from 0. Only texts of ``loss_role`` are in it, no header and no mark.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        role = F.replace(_escaped(t["role"]), F.lit(":"), F.lit("\\:"))
        return F.struct(
            F.when(before.eqNullSafe(t["role"]), F.lit(NEXT)).otherwise(F.concat(F.lit(HEAD), role, F.lit(HEAD_END))).alias("head"),
            _escaped(t["text"]).alias("body"),
            F.when(after.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END)).alias("tail"),
        )

    pieces = _held(turns, pieces=F.transform("turns", piece))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    sizes = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long"))
    placed = _held(_held(pieces, formatted=text, sizes=sizes), starts=_running(F.col("sizes")))
    spans = F.transform(
        "turns",
        lambda t, i: F.struct(
            i.alias("turn"), (F.get("starts", i) + F.length(F.get("pieces", i)["head"])).alias("start"),
            F.length(F.get("pieces", i)["body"]).cast("long").alias("length"), t["role"].alias("role"),
        ),
    )
    mask = F.transform(F.filter(spans, lambda s: s["role"] == loss_role), lambda s: F.struct(s["turn"], s["start"], s["length"]))
    return placed.select("conv_id", "formatted", mask.alias("loss_mask"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``: array of struct(role, text), read from the formatted text alone."""
    blocks = F.split("formatted", END)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def read(block: Column) -> Column:
        role = F.regexp_extract(block, r"(?s)^### ((?:[^\\:]++|\\.)*+):\n", 1)
        texts = F.split(F.substring(block, F.length(role) + len(HEAD) + len(HEAD_END) + 1, F.length(block)), NEXT)
        return F.struct(_unescaped(role).alias("role"), texts.alias("texts"))

    def turns(block: Column) -> Column:
        return F.transform(block["texts"], lambda x: F.struct(block["role"].alias("role"), _unescaped(x).alias("text")))

    return _held(formatted, turns=F.flatten(F.transform(F.transform(blocks, read), turns)))


def with_masked_text(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``masked``: all text under the loss mask, cut out by its spans, unescaped, in order.

    The formatted text is first cut into pieces of ``CUT`` code points, so that
    a span is looked for in its own pieces and not from the beginning.
    """
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("formatted") / CUT).cast("int") - F.lit(1), F.lit(0)))
    held = _held(formatted, cut_pieces=F.transform(cuts, lambda k: F.substring(F.col("formatted"), k * CUT + 1, F.lit(CUT))))

    def under(m: Column) -> Column:
        first, offset = F.floor(m["start"] / CUT).cast("int"), (m["start"] % CUT).cast("int")
        n = F.floor((offset + m["length"]) / CUT).cast("int") + 1
        return _unescaped(F.substring(F.array_join(F.slice("cut_pieces", first + 1, n), ""), offset + 1, m["length"].cast("int")))

    return held.withColumn("masked", F.array_join(F.transform("loss_mask", under), "")).drop("cut_pieces")
