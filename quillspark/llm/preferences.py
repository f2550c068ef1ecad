"""Preference pairs: the longest common turn prefix of a chosen and a rejected conversation is the prompt, the rest two completions.

Only DataFrame functions. A turn is rendered as `<|role|>` newline text `<|end|>` newline. Loss falls on what an assistant turn
says and on its end mark, not on headers nor on other turns; it is given as spans of characters of each completion.

Defined cases: turns are compared by role and text, null equal to null; a null role renders as `unknown`, a null text as
empty; turns come in order of turn number (null first), then role, then text, and identical rows count once; rows without a
conversation id are left out; equal conversations have empty completions without spans; a conversation is one row, so its
own turns are held together, and nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
MADE = ("prefix_turns", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans")


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): one row for each conversation, its turns in order as an array of (role, text)."""
    one = F.struct(F.col(turn_col).cast("long").alias("at"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = turns.select(F.col(id_col).cast("long").alias("id"), one.alias("one")).where("id IS NOT NULL")
    return rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.collect_list("one"))).alias("all")).select("id", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns two conversations share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_spans(turns: Column, speaker: str = "assistant") -> Column:
    """Spans (start, end) of characters of the rendered turns on which loss falls."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        lo = state["at"] + F.length(_head(turn))
        hi = lo + F.length(_body(turn))
        span = F.array(F.struct(lo.alias("start"), hi.alias("end")))
        return F.struct(hi.alias("at"), F.when(turn["role"] == speaker, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs, two columns of which are arrays of (role, text), with prefix_turns, prompt, and text and spans of both completions."""
    cut = "_cut"
    while cut in {c.lower() for c in pairs.columns}:
        cut += "_"
    n, kept = F.col(f"{cut}.n"), [c for c in pairs.columns if c not in (chosen, rejected) and c.lower() not in MADE]
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    counted = pairs.withColumn(cut, F.struct(common_turns(F.col(chosen), F.col(rejected)).alias("n")))
    parted = counted.withColumn(cut, F.struct(n.alias("n"), F.slice(chosen, 1, n).alias("prompt"), rest(chosen).alias("chosen"), rest(rejected).alias("rejected")))
    part = lambda name: F.col(f"{cut}.{name}")
    made = (n, render(part("prompt")), render(part("chosen")), loss_spans(part("chosen")), render(part("rejected")), loss_spans(part("rejected")))
    return parted.select(*kept, *[c.alias(name) for name, c in zip(MADE, made)])


def swapped_answers(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pairs (id, chosen, rejected) from the turns of plain conversations: chosen is the conversation, rejected the same up to its last
    assistant turn, which it takes from its neighbour (ids 2n and 2n + 1). Without a neighbour, or one that has no answer, the answer is
    left out. Turns shuffle once: neighbours meet in one row."""
    one = F.struct(F.col(turn_col).cast("long").alias("at"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = turns.select(F.col(id_col).cast("long").alias("id"), one.alias("one")).where("id IS NOT NULL")
    odd = F.col("id") % 2 != 0
    ordered = lambda c: F.array_sort(F.array_distinct(F.collect_list(c)))
    met = rows.groupBy(F.shiftright("id", 1).alias("half")).agg(ordered(F.when(~odd, F.col("one"))).alias("even"), ordered(F.when(odd, F.col("one"))).alias("odd"))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    two = met.select(F.shiftleft("half", 1).alias("id"), plain("even").alias("even"), plain("odd").alias("odd"))
    own = lambda i, a, b: F.struct((F.col("id") + i).alias("id"), F.col(a).alias("turns"), F.col(b).alias("beside"))
    each = two.select(F.explode(F.array(own(0, "even", "odd"), own(1, "odd", "even"))).alias("x")).select("x.*").where(F.size("turns") > 0)
    last = each.withColumns({"at": _last_answer("turns"), "other": _last_answer("beside")})
    answer = F.when(F.col("other") > 0, F.slice("beside", F.greatest("other", F.lit(1)), 1)).otherwise(F.slice("turns", 1, 0))
    before = F.when(F.col("at") > 0, F.slice("turns", 1, F.greatest(F.col("at") - 1, F.lit(0)))).otherwise(F.col("turns"))
    return last.select("id", F.col("turns").alias("chosen"), F.concat(before, answer).alias("rejected"))


def _last_answer(turns: str) -> Column:
    """Place of the last assistant turn, from 1; 0 without one."""
    spoke = F.transform(turns, lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
    return F.when(F.array_contains(spoke, True), F.size(turns) - F.array_position(F.reverse(spoke), True) + 1).otherwise(0).cast("int")
