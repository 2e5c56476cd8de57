"""Chat formatting by a grammar round trip, in DataFrame functions only.

A conversation becomes `<|im_start|>role NEWLINE text<|im_end|>NEWLINE` for each turn. Every rendered turn is parsed
again by the grammar below and compared to its source; a turn whose text conflicts with the grammar is escaped, and
parsed and compared once more. Escaping puts one backslash more between a `<` and the `|` that follows it (with any
backslashes between), so it is one to one, and after it no control string can occur inside a text.

Turns are checked one by one, before they are grouped: the grammar is a plain sequence of turns and no checked turn
holds a control string, so the parse of a conversation is the sequence of its turns' parses. As escaping is one to one and
leaves no control string, a turn that was escaped always survives; the error for one that doesn't is a safeguard that
no input reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
STOP = r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def pieces(formatted: Column) -> Column:
    """The rendered turns, each without its end mark; what follows the last end mark is left out."""
    parts = F.split(formatted, STOP)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def parse_piece(piece: Column) -> Column:
    """struct(valid, role, text) of one rendered turn."""
    rest = F.substr(piece, F.lit(len(START) + 1))
    role, body = F.substring_index(rest, "\n", 1), F.substr(rest, F.instr(rest, "\n") + 1)
    valid = F.startswith(piece, F.lit(START)) & F.contains(rest, F.lit("\n")) & ~F.contains(rest, F.lit("<|"))
    return F.struct(valid.alias("valid"), unescape_role(role).alias("role"), unescape(body).alias("text"))


def same(rendered: Column, role: Column, text: Column) -> Column:
    """Whether the rendered turn parses to exactly this one turn."""
    turn = parse_piece(F.get(pieces(rendered), F.lit(0)))
    return (F.size(F.split(rendered, STOP)) == 2) & turn["valid"] & (turn["role"] == role) & (turn["text"] == text)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: conv_id, n_turns, formatted, loss_mask.

    Reads conv_id, turn, role and text and ignores other columns. Turns go by turn (null first), then role, then text,
    so ties and repeated rows have one order. A null role or text is empty; a null conv_id is a conversation of its
    own; no rows give no rows. loss_mask has a struct(turn, start, length) for each assistant turn: its place from 0 in
    the conversation and the code points of its text, from 0, in that rendered turn.

    SHA-256 and the formatted text need one conversation's turns in one task; rendering, parsing and escaping, which
    cost most, run before that on single rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain, safe = render(F.col("role"), F.col("text")), render(escape_role(F.col("role")), escape(F.col("text")))
    chosen = (
        F.when(same(plain, F.col("role"), F.col("text")), plain)
        .when(same(safe, F.col("role"), F.col("text")), safe)
        .otherwise(F.raise_error(F.lit("a chat turn does not survive the round trip")))
    )
    rows = rows.withColumn("chunk", chosen)
    start = F.instr("chunk", "\n")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("at"),
        (F.col("role") == TRAINED).alias("trained"),
        start.alias("start"),
        (F.length("chunk") - start - len(END) - 1).alias("length"),
        "chunk",
    )
    both = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "trained", "start", "length", "chunk"))).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["trained"]), lambda x: F.struct(x["at"].alias("turn"), x["start"].alias("start"), x["length"].alias("length")))
    return both.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["chunk"]), "").alias("formatted"),
        mask.alias("loss_mask"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """The digests of what the formatted text and the loss mask hold."""
    parsed = chats.select("conv_id", "formatted", "loss_mask", pieces(F.col("formatted")).alias("p"))
    parsed = parsed.withColumn("turns", F.transform("p", parse_piece))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substr(F.get("p", m["turn"]), m["start"] + 1, m["length"]))), "")
    return parsed.select("conv_id", "formatted", "turns", said.alias("said"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
