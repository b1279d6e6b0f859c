"""Chat formatting by a finite-state machine over roles and a declarative template.  Built-in functions only.

`TEMPLATE` maps a role to its opening and closing control strings and says whether its text is trained on; `ORDER` has the moves
of the machine.  A conversation's turns, in order of (turn, role, text), are written as segments (text, loss): opening, escaped
text, closing.  Only the text between the control strings of a trained role carries loss.  A control string inside a text gets
a backslash after its first character, one more if it has some already; reading back takes one away, so the way is reversible
and no text can forge a turn.

Edge cases: null text and null role count as empty; other roles are written with their name in control strings of their own and
never carry loss; a turn that the machine does not allow leaves its state as it is and makes the conversation invalid (`valid`
false, `first_error` its index), yet it is still written; a null conv_id is a conversation of its own; repeated rows are
repeated turns; texts of any length are written whole; turns that tie in all of turn, role and text are equal, so their order does not matter; an empty table gives an empty result; other columns are not read.  A conversation is one row of output, so its
turns meet in one task, as its digests need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
#: state -> role -> state; a conversation may end in a state of ENDS
ORDER = {"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
ENDS = ("answered",)

#: The first character of a control string, and what follows it.
TAILS = r"/?s>|/?INST\]|<SYS>>|</SYS>>|/?ROLE\]|/TURN\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({TAILS})", "$1$2$3")


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def segments(turn: Column) -> Column:
    """The segments of one turn (role, text)."""
    body = escape(turn["text"])
    out = F.array(_segment(F.concat(F.lit(OTHER[0]), escape(turn["role"]), F.lit(OTHER[1])), False), _segment(body, False), _segment(F.lit(OTHER[2]), False))
    for role, (opening, closing, loss) in TEMPLATE.items():
        out = F.when(turn["role"] == role, F.array(_segment(F.lit(opening), False), _segment(body, loss), _segment(F.lit(closing), False))).otherwise(out)
    return out


def _step(acc: Column, turn: Column) -> Column:
    after = F.lit(None).cast("string")
    for state, moves in ORDER.items():
        for role, to in moves.items():
            after = F.when((acc["state"] == state) & (turn["role"] == role), F.lit(to)).otherwise(after)
    return F.struct(F.coalesce(after, acc["state"]).alias("state"), (acc["seen"] + 1).alias("seen"), F.coalesce(acc["error"], F.when(after.isNull(), acc["seen"])).alias("error"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, segments, formatted, valid, first_error) of rows (conv_id, turn, role, text)."""
    own = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("turn"))
    chats = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("error"))
    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", segments)).alias("segments"), F.aggregate("turns", start, _step).alias("_end"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    error = F.coalesce(F.col("_end.error"), F.when(~F.col("_end.state").isin(*ENDS), F.col("_end.seen")))
    return chats.select("conv_id", "n_turns", "segments", text.alias("formatted"), error.isNull().alias("valid"), error.alias("first_error"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds `turns` (role, text), read back from the formatted text alone."""
    shapes = [rf"{_quoted(a)}.*?{_quoted(b)}" for a, b, _ in TEMPLATE.values()] + [rf"{_quoted(OTHER[0])}.*?{_quoted(OTHER[1])}.*?{_quoted(OTHER[2])}"]
    parts = F.regexp_extract_all("formatted", F.lit("(?s)" + "|".join(shapes)), F.lit(0))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, OTHER[1], 1)
        rest = F.substring(part, F.length(role) + len(OTHER[1]) + 1, F.length(part) - F.length(role) - len(OTHER[1]) - len(OTHER[2]))
        out = F.struct(unescape(F.substring(role, F.lit(len(OTHER[0]) + 1), F.length(role))).alias("role"), unescape(rest).alias("text"))
        for name, (opening, closing, _) in TEMPLATE.items():
            body = F.substring(part, F.lit(len(opening) + 1), F.length(part) - len(opening) - len(closing))
            out = F.when(F.startswith(part, F.lit(opening)), F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return formatted.withColumn("turns", F.transform(parts, turn))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in "[]" else c for c in text)
