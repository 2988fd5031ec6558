"""Chat formatting by relational expressions only (operator 8).

The template, with one block for each run of turns of one role::

    ### <role>: <text><+><text></turn>\n

``### ``, ``: ``, ``<+>`` (between merged turns) and ``</turn>`` are control strings. In roles
and texts ``\\``, ``#``, ``<`` and ``:`` (in roles) become ``\\b``, ``\\h``, ``\\l`` and ``\\c``,
so no text can hold a control string and the formatted text can be read back without loss.

Turns are ordered by (turn, role, text), nulls first; repeated rows are repeated turns. Null
roles and texts count as empty. Rows without conv_id are one conversation whose conv_id is null.
An empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, JOIN, END = "### ", "<+>", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(F.replace(out, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(F.replace(out, F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, n: a + n)


def _before(sizes: Column, step: int = 64) -> Column:
    """For each element the sum of those before it: of whole steps, and of what is left in its own. So a
    long array is not summed anew for each of its elements."""
    step_of = lambda i: F.floor(i / step).cast("int")
    sums = F.transform(F.sequence(F.lit(0), step_of(F.size(sizes))), lambda b: _sum(F.slice(sizes, b * step + 1, F.lit(step))))
    steps = _let(sums, lambda s: F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b))))
    rest = lambda i: F.slice(sizes, i - i % step + 1, i % step)
    return _let(steps, lambda s: F.transform(sizes, lambda _, i: F.get(s, step_of(i)) + _sum(rest(i))))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row for each conv_id: conv_id, formatted, loss_spans array<struct<start,stop>>.

    A span is half-open, in code points of ``formatted``; it covers one text of ``trained_role``
    as escaped there, without the control strings around it.
    """
    one = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    turns = turns.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"]).alias("roles"),
        F.transform("ts", lambda t: escape(t["text"])).alias("texts"),
    )
    # The places where another role begins; a run goes from one to before the next.
    at = F.sequence(F.lit(1), F.size("roles"))
    starts = F.filter(at, lambda i: (i == 1) | (F.get("roles", i - 1) != F.get("roles", i - 2)))
    turns = turns.withColumn("starts", starts)
    runs = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("roles", s - 1).alias("role"),
            F.slice("texts", s, F.coalesce(F.get("starts", k + 1), F.size("texts") + 1) - s).alias("texts"),
        ),
    )
    turns = turns.select("conv_id", runs.alias("runs"))
    blocks = F.transform("runs", lambda r: F.concat(F.lit(TURN), escape(r["role"], role=True), F.lit(": "), F.array_join(r["texts"], JOIN), F.lit(END)))
    turns = turns.withColumn("blocks", blocks)

    def spans(r: Column, head: Column) -> Column:
        start = head + len(TURN) + F.length(escape(r["role"], role=True)) + 2
        sizes = F.transform(r["texts"], lambda x: F.length(x) + len(JOIN))
        found = _let(_before(sizes), lambda before: F.transform(r["texts"], lambda t, j: F.struct((start + F.get(before, j)).alias("start"), (start + F.get(before, j) + F.length(t)).alias("stop"))))
        return F.when(r["role"] == trained_role, found).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))

    heads = _let(F.transform("blocks", lambda b: F.length(b)), lambda sizes: _before(sizes))
    all_ = _let(heads, lambda h: F.transform("runs", lambda r, k: spans(r, F.get(h, k))))
    return turns.select("conv_id", F.array_join("blocks", "").alias("formatted"), F.flatten(all_).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns, merged ones apart, as they were before escaping."""
    blocks = F.slice(F.split(formatted, END, -1), 1, F.size(F.split(formatted, END, -1)) - 1)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, ": ", 1)
        body = F.substring(block, F.length(role) + 3, F.length(block))
        role = unescape(F.substring(role, len(TURN) + 1, F.length(role)))
        return F.transform(F.split(body, r"<\+>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def text_under(formatted: Column, spans: Column) -> Column:
    """The unescaped texts that the spans cover, one after another."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
