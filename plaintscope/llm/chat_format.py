"""Chat formatting with a grammar round trip, in built-in expressions only.

Grammar of a conversation: turns one after another, each one of

    [INST] text [/INST]               user
    <s> text </s>                     assistant
    [ROLE] role [TEXT] text [/ROLE]   any other role

(no blanks around the texts). The parser cuts after every closing mark and takes the parts of
each turn by length, then removes one backslash from every mark that has one. A turn whose
reparsed role and text differ from its source is escaped: every mark inside its text, plain or
already holding backslashes, gets one backslash more ("[\\INST]"). That step is reversible for
any text, so a second parse returns the source. The joined conversation is parsed and compared
again; should it still differ, all its turns are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed marks of the template.
USER = ("[INST]", "[/INST]")
ASSISTANT = ("<s>", "</s>")
OTHER = ("[ROLE]", "[/ROLE]")
TEXT = "[TEXT]"

MARK = r"(\[/?|</?)(\\*)(INST\]|ROLE\]|TEXT\]|s>)"
ESCAPED_MARK = r"(\[/?|</?)\\(\\*)(INST\]|ROLE\]|TEXT\]|s>)"
AFTER_CLOSING = r"(?<=\[/INST\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, MARK, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED_MARK, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    """One turn as the grammar has it."""
    return (
        F.when(role == "user", F.concat(F.lit(USER[0]), text, F.lit(USER[1])))
        .when(role == "assistant", F.concat(F.lit(ASSISTANT[0]), text, F.lit(ASSISTANT[1])))
        .otherwise(F.concat(F.lit(OTHER[0]), role, F.lit(TEXT), text, F.lit(OTHER[1])))
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text; a part that is no turn gives nulls."""
    parts = F.filter(F.split(formatted, AFTER_CLOSING, -1), lambda p: p != "")

    def between(part: Column, marks: tuple[str, str]) -> Column:
        return F.substring(part, F.lit(len(marks[0]) + 1), F.length(part) - len(marks[0]) - len(marks[1]))

    def turn(part: Column) -> Column:
        is_ = lambda marks: part.startswith(marks[0]) & part.endswith(marks[1])
        inner = between(part, OTHER)
        split_at = F.locate(TEXT, inner)
        role = (F.when(is_(USER), "user").when(is_(ASSISTANT), "assistant")
                .when(is_(OTHER) & (split_at > 0), unescape(F.substring(inner, F.lit(1), split_at - 1))))
        text = (F.when(is_(USER), between(part, USER)).when(is_(ASSISTANT), between(part, ASSISTANT))
                .when(is_(OTHER) & (split_at > 0), F.substring(inner, split_at + len(TEXT), F.length(inner))))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: the key, n_turns, formatted, turns (reparsed from `formatted`),
    loss_mask (start and stop code points of assistant texts in `formatted`), exact.

    Null roles and texts count as empty. Turns are ordered by (turn, role, text), null first;
    repeated rows are repeated turns. Rows with a null key form one conversation; an empty
    table gives an empty one; other columns are not used. Rendering and the check of each turn
    happen on the rows before the one shuffle by conversation; a conversation, like a text, is
    one row of the result.
    """
    said = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = F.struct("role", "text")
    raw, escaped = render(F.col("role"), F.col("text")), render(escape(F.col("role")), escape(F.col("text")))
    said = said.withColumn("raw", raw)
    said = said.withColumn("rendered", F.when(parse(F.col("raw")) == F.array(source), F.col("raw")).otherwise(escaped)).drop("raw")

    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda size: F.coalesce(F.sum(size).over(before), F.lit(0))
    placed = said.withColumns({"size": F.length("rendered"), "escaped_size": F.length(escaped)}).withColumns({
        "at": F.row_number().over(order), "start": ahead("size"), "escaped_start": ahead("escaped_size")})
    kept = ("at", "role", "text", "rendered", "size", "start", "escaped_size", "escaped_start")
    whole = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("said"))

    sources = F.transform("said", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text")))
    joined = F.array_join(F.transform("said", lambda s: s["rendered"]), "")
    all_escaped = F.array_join(F.transform("said", lambda s: render(escape(s["role"]), escape(s["text"]))), "")
    whole = whole.withColumn("formatted", joined).withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns") == sources
    whole = whole.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(all_escaped))
    whole = whole.withColumn("turns", F.when(same, F.col("turns")).otherwise(parse(F.col("formatted"))))
    assistant = F.filter("said", lambda s: s["role"] == "assistant")

    def spans(start: str, size: str) -> Column:
        return F.transform(assistant, lambda s: F.struct(
            (s[start] + len(ASSISTANT[0])).alias("start"), (s[start] + s[size] - len(ASSISTANT[1])).alias("stop")))

    return whole.select(
        F.col("conv").alias(conv), F.size("turns").cast("bigint").alias("n_turns"), "formatted", "turns",
        F.when(same, spans("start", "size")).otherwise(spans("escaped_start", "escaped_size")).alias("loss_mask"),
        (F.col("turns") == sources).alias("exact"))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted text says, read back: counts and digests. Turns come from the parser; the
    text that is learned from is cut out of `formatted` at the spans of the loss mask, and unescaped."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    cut = F.transform("loss_mask", lambda m: F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int")))
    learned = F.array_join(F.transform(cut, unescape), "")
    return formatted.select(
        conv, "n_turns", F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "exact")
