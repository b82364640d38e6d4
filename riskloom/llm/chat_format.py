r"""Chat rendering with a grammar round trip. DataFrame functions only.

A conversation is rendered as turns `<s>role[INST]text</s>`. The parser is deterministic: it cuts at `<s>`, then at `[INST]` and at
`</s>`, and takes escapes back. Rendering starts without escapes; the result is parsed again and compared with the source, turn by
turn. Turns that don't come back are escaped: first the escape character and whole control strings, then every character that can
begin one. The last level leaves no such character in the content, so it always comes back; a conversation whose turns come back
alone but not together is rendered at that level throughout.

Escapes: `\b` for `\`, `\l` for `<`, `\k` for `[`. After escaping, each `\` is followed by one of these, so taking back is exact.

Rows of a conversation are ordered by turn, then role and text (nulls first); null role or text is empty, a null turn comes first,
rows with a null conv_id are one conversation, repeated rows are turns of their own. A conversation is one row and stays whole,
so its texts together must fit a row; a very long text is escaped and read whole. An empty table gives no rows. Further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<s>", "[INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column, level: int) -> Column:
    if level == 0:
        return c
    c = _replace(c, "\\", "\\b")
    if level == 1:
        for s in CONTROL:
            c = _replace(c, s, ("\\l" if s[0] == "<" else "\\k") + s[1:])
        return c
    return _replace(_replace(c, "<", "\\l"), "[", "\\k")


def unescape(c: Column) -> Column:
    return _replace(_replace(_replace(c, "\\l", "<"), "\\k", "["), "\\b", "\\")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(BODY), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation, escapes taken back."""
    pieces = F.filter(F.split(formatted, "<s>"), lambda _, i: i > 0)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, BODY, 1)
        rest = F.substr(piece, F.char_length(role) + F.lit(len(BODY) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(rest, END, 1)).alias("text"))

    return F.transform(pieces, turn)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, turns (the source), formatted, spans (start and length in code points of each assistant text inside formatted)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    levels = []
    for level in range(3):
        r, t = escape(F.col("t.role"), level), escape(F.col("t.text"), level)
        back = parse(render_turn(r, t))
        same = back == F.array(F.struct(F.col("t.role").alias("role"), F.col("t.text").alias("text")))
        levels.append((r, t, same))
    pick = lambda i: F.when(levels[0][2], levels[0][i]).when(levels[1][2], levels[1][i]).otherwise(levels[2][i])
    turns = turns.withColumn("x", F.struct(F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"), pick(0).alias("r"), pick(1).alias("b"), levels[2][0].alias("r2"), levels[2][1].alias("b2")))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    joined = lambda r, b: F.array_join(F.transform("xs", lambda x: render_turn(x[r], x[b])), "")
    source = F.transform("xs", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    chats = chats.withColumn("turns", source).withColumn("formatted", joined("r", "b"))
    chats = chats.withColumn("whole", parse(F.col("formatted")) == F.col("turns")).withColumn("formatted", F.when(F.col("whole"), F.col("formatted")).otherwise(joined("r2", "b2")))
    return chats.select("conv_id", "turns", "formatted", loss_spans(F.col("formatted")).alias("spans"))


def loss_spans(formatted: Column) -> Column:
    """array<struct<start, length>>: where the assistant texts stand in formatted, start from 1."""
    pieces = F.filter(F.split(formatted, "<s>"), lambda _, i: i > 0)

    def step(acc: Column, piece: Column) -> Column:
        role = F.substring_index(piece, BODY, 1)
        body = F.substring_index(F.substr(piece, F.char_length(role) + F.lit(len(BODY) + 1)), END, 1)
        start = (acc["at"] + F.lit(len(TURN)) + F.char_length(role) + F.lit(len(BODY))).cast("int")
        more = F.when(role == "assistant", F.array(F.struct(start.alias("start"), F.char_length(body).cast("int").alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((acc["at"] + F.lit(len(TURN)) + F.char_length(piece)).cast("int").alias("at"), F.concat(acc["out"], more).alias("out"))

    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def chat_digests(rows: DataFrame) -> DataFrame:
    """Digests read back from the rendered text: by parsing it, and by cutting its loss spans out."""
    out = format_chats(rows).select("conv_id", "formatted", "spans", parse(F.col("formatted")).alias("back"))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"], s["length"]))), "")
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
