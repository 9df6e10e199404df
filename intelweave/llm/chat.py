"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything runs on DataFrame functions.  The template is data: for each turn a
list of pieces, each a constant, the role or the text, with a flag that says
whether the loss covers it.  Control strings inside roles and texts are escaped
with a backslash, so the only unescaped ``<|`` in the output are the
template's own, and reading the output back gives the turns exactly.

Defined results: a null text or role counts as empty; turns are ordered by
(turn, role, text), nulls first, so ties and repeated rows have one order; a
null conv_id is a conversation of its own; an empty table gives no rows;
columns other than conv_id, turn, role and text are ignored.

A conversation is one row of the result, so its turns meet in one task: the
digests of a conversation are over its whole text in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (piece, loss): "{role}" and "{text}" stand for the turn's own.
TURN_PIECES = (("<|im_start|>", False), ("{role}", False), ("\n", False), ("{text}", True), ("<|im_end|>\n", False))
LOSS_ROLES = ("assistant",)
#: state and role -> next state; what is missing is an error, which stays.
TRANSITIONS = {
    "start": ("system", "user"), "system": ("user",), "user": ("assistant",),
    "assistant": ("user", "tool"), "tool": ("assistant", "tool"),
}
FINAL_STATES = ("assistant",)

START, END = TURN_PIECES[0][0], TURN_PIECES[-1][0]


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    """A role ends at the first line feed, so one inside it is escaped as well."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\\n"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def final_state(roles: Column) -> Column:
    """The state after all roles; 'error' once a role is not allowed."""
    moves = F.create_map(*(F.lit(x) for s, rs in TRANSITIONS.items() for r in rs for x in (f"{s}>{r}", r)))
    step = lambda state, role: F.coalesce(F.element_at(moves, F.concat_ws(">", state, role)), F.lit("error"))
    return F.aggregate(roles, F.lit("start"), step)


def segments_of(turn: Column) -> Column:
    """The template applied to one turn: an array of (segment, loss)."""
    fill = {"{role}": escape_role(turn["role"]), "{text}": escape(turn["text"])}
    parts = [
        F.struct(
            fill.get(piece, F.lit(piece)).alias("segment"),
            (turn["role"].isin(*LOSS_ROLES) if loss else F.lit(False)).alias("loss"),
        )
        for piece, loss in TURN_PIECES
    ]
    return F.array(*parts)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, segments (array of segment and loss), formatted, n_turns, valid."""
    empty = F.lit("")
    one = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        final_state(F.transform("turns", lambda t: t["role"])).isin(*FINAL_STATES).alias("valid"),
        F.flatten(F.transform("turns", segments_of)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["segment"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    head = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"  # up to the first line feed that is not escaped
    parts = F.split(formatted, r"<\|im_start\|>")
    bodies = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turn(body):
        inner = F.substring(body, F.lit(1), F.length(body) - F.lit(len(END)))
        role = F.regexp_extract(inner, head, 1)
        text = F.substring(inner, F.length(role) + F.lit(2), F.length(inner))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def chat_digest(chats: DataFrame) -> DataFrame:
    """Counts and digests, all taken from the formatted output."""
    said = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["segment"]))
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        "valid",
        F.size(F.split("formatted", r"<\|im_start\|>")).cast("long").alias("parts"),
        F.array_join(turns, "").alias("all_turns"),
        F.array_join(said, "").alias("said"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        (F.col("parts") - 1).alias("n_turns"),
        F.sha2(F.encode("all_turns", "UTF-8"), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2(F.encode("said", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
