"""Chat formatting with loss flags from a declarative template (operator 4, DataFrame functions only).

A conversation's turns are ordered by turn, role and text.  A finite-state machine over the roles, given as a table
of transitions, says whether the order is valid.  Every turn becomes three segments (opening mark, escaped text,
closing mark); only the text of roles under ``loss`` carries the loss flag.  Control strings inside texts are escaped
as ``\\`` and their number, and ``\\`` as ``\\0``, so a formatted text holds control strings only where the template put
them, and the escape is undone exactly.

Offsets come from a running sum over the turns of a conversation, so no array grows turn by turn.  Reading splits a
formatted text behind its closing marks, which stand nowhere else, and cuts each turn from its own piece: time grows
with the text, not with text times turns.

Edge cases: a null text is empty, a null role is the empty role; roles that the template doesn't know are marked as
``other`` and have no transition, so the conversation is invalid but is still formatted; repeated turns are kept;
all rows of null conv_id are one conversation; very long texts are formatted whole; of equal turns the role and then the
text decide the order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks by role, roles under loss, and the machine: (state, role) -> state, with the states that may end."""

    marks: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": ("<s>[INST] ", " [/INST]"),
        "assistant": (" ", " </s>"),
        "other": ("<<TURN>>\n", "\n<</TURN>>\n"),
    })
    #: every closing mark holds a control string that no opening mark holds
    controls: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN>>", "<</TURN>>")
    loss: tuple = ("assistant",)
    start: str = "start"
    accept: tuple = ("answered",)
    transitions: dict = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })

    def __post_init__(self):
        opens = [o for o, _ in self.marks.values()]
        for role, (_, close) in self.marks.items():
            if not any(c in close and not any(c in o for o in opens) for c in self.controls):
                raise ValueError(f"the closing mark of {role} holds no control string of its own")


def escape(text, controls):
    return reduce(lambda c, k: F.replace(c, F.lit(k[1]), F.lit(f"\\{k[0]}")), enumerate(("\\", *controls)), text)


def unescape(text, controls):
    found = list(enumerate(("\\", *controls)))
    return reduce(lambda c, k: F.replace(c, F.lit(f"\\{k[0]}"), F.lit(k[1])), found[:0:-1] + found[:1], text)


def _by_role(role, template: Template, pick):
    known = [r for r in template.marks if r != "other"]
    return reduce(lambda c, r: F.when(role == r, F.lit(pick(r))).otherwise(c), known, F.lit(pick("other")))


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation: conv_id, formatted, valid, segments (role, loss, start, len of each turn's text, in
    code points of ``formatted``, in order)."""
    t = template or Template()
    if len(t.controls) > 9:
        raise ValueError("at most nine control strings")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("raw"))
    rows = rows.select("conv_id", "turn", "role", "raw", _by_role(F.col("role"), t, lambda r: t.marks[r][0]).alias("open"), escape(F.col("raw"), t.controls).alias("body"), _by_role(F.col("role"), t, lambda r: t.marks[r][1]).alias("close"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    size = F.length("open") + F.length("body") + F.length("close")
    rows = rows.select("conv_id", F.row_number().over(order).alias("n"), "role", F.concat("open", "body", "close").alias("piece"),
                       (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("close") - F.length("body")).cast("int").alias("start"), F.length("body").alias("len"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "role", "piece", "start", "len"))).alias("turns"))
    table = F.create_map(*(F.lit(x) for (a, b), c in t.transitions.items() for x in (f"{a} {b}", c)))
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.element_at(table, F.concat_ws(" ", s, x["role"])), F.lit("invalid")))
    segments = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["role"].isin(*t.loss).alias("loss"), x["start"].alias("start"), x["len"].alias("len")))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), state.isin(*t.accept).alias("valid"), segments.alias("segments"))


def read_segments(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """The turns of formatted chats, read from the formatted text: conv_id, formatted, valid, turns (role, loss, text)."""
    t = template or Template()
    ends = sorted({close for _, close in t.marks.values()}, key=lambda c: (-len(c), c))
    pieces = F.split("formatted", "|".join(f"(?<=\\Q{c}\\E)" for c in ends), -1)
    def turn(s, piece):
        text = F.substr(piece, _by_role(s["role"], t, lambda r: len(t.marks[r][0])) + 1, s["len"])
        return F.struct(s["role"].alias("role"), s["loss"].alias("loss"), unescape(text, t.controls).alias("text"))

    cut = F.zip_with("segments", F.slice(pieces, F.lit(1), F.size("segments")), turn)
    return chats.select("conv_id", "formatted", "valid", cut.alias("turns"))


def chat_digests(chats: DataFrame, template: Template | None = None) -> DataFrame:
    read = read_segments(chats, template)
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    same = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(same).alias("text"))
    return chat_digests(format_chats(rows.unionAll(extra)))


_T = Template()


def _sql_escape(column: str) -> str:
    return reduce(lambda c, k: f"replace({c}, '{k[1]}', '\\{k[0]}')", enumerate(("\\", *_T.controls)), column)


def _sql_marks() -> str:
    cases = " ".join(f"WHEN '{r}' THEN {len(o) + len(c)}" for r, (o, c) in _T.marks.items() if r != "other")
    return f"CASE role {cases} ELSE {sum(map(len, _T.marks['other']))} END"


OP4_SQL = f"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), steps AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length({_sql_escape("text")}) + {_sql_marks()})::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' AND n = 2
           WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END)
    AND arg_max(role, n) = 'assistant' AS valid
FROM steps GROUP BY conv_id
"""
