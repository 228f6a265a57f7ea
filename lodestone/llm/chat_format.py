r"""Chat formatting with a grammar round trip.

The template::

    conversation := turn*
    turn         := "[INST] " body " [/INST]"                role user
                  | "<s> " body " </s>"                      role assistant
                  | "<<SYS>> " role "\n" body " <</SYS>>"    any other role

A body holds no control string. The parser cuts the text after each closing string, takes
the opening string off each piece, rejects a piece whose body still holds a control string,
and undoes the escapes in the body: ``\l`` is ``<``, ``\k`` is ``[``, ``\n`` a line feed in
a role and ``\b`` is ``\``. Escaping writes ``\`` as ``\b`` and the first character of each
control string as ``\l`` or ``\k``, so an escaped body holds no control string and reads
back as it was.

Each turn is first rendered as it is and parsed again. If the parsed turn is not the source
turn, its content is rendered escaped and must then be identical. The whole conversation is
parsed once more; what the caller gets is what that parser read.

Everything is DataFrame expressions. Null text and null role count as empty, so a null role
is rendered as a turn with an empty role name. Turns stand in the order of turn, then role
and text; null turn numbers come first. A null conversation id is one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
_CONTROL = r"\[/?INST\]|<</?SYS>>|</?s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.regexp_replace(out, r"\[(?=/?INST\])", r"\\k")
    return F.regexp_replace(out, r"<(?=</?SYS>>|/?s>)", r"\\l")


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("["))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def render(role: Column, body: Column) -> Column:
    """One turn; the body is written as it is."""
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s> "), body, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("<<SYS>> "), _role_out(role), F.lit("\n"), body, F.lit(" <</SYS>>")))
    )


def _pieces(text: Column) -> Column:
    """The text cut after each closing string; the last piece is what follows the last one."""
    return F.split(text, r"(?<=\[/INST\]|<</SYS>>|</s>)", -1)


def _between(piece: Column, opening: str, closing: str) -> Column:
    return F.when(
        piece.startswith(opening) & piece.endswith(closing) & (F.length(piece) >= len(opening) + len(closing)),
        F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - (len(opening) + len(closing))),
    )


def _turn(piece: Column) -> Column:
    """(role, text) of one piece, null where the grammar has no such turn. What is read is bound to a name, so it is read once."""
    user, assistant, other = _between(piece, "[INST] ", " [/INST]"), _between(piece, "<s> ", " </s>"), _between(piece, "<<SYS>> ", " <</SYS>>")
    place = F.instr(other, "\n")
    kind = F.when(piece.startswith("[INST] "), F.lit("user")).when(piece.startswith("<s> "), F.lit("assistant"))
    body = F.coalesce(user, assistant, F.when(place > 0, F.substring(other, place + 1, F.length(other))))
    read = F.struct(kind.alias("kind"), F.when(kind.isNull(), F.substring_index(other, "\n", 1)).alias("name"), body.alias("body"))

    def judged(t: Column) -> Column:
        legal = t["body"].isNotNull() & ~t["body"].rlike(_CONTROL) & ~F.coalesce(t["name"], F.lit("")).rlike(_CONTROL)
        return F.when(legal, F.struct(F.coalesce(t["kind"], _role_in(t["name"])).alias("role"), unescape(t["body"]).alias("text")))

    return F.get(F.transform(F.array(read), judged), F.lit(0))


def parse(text: Column) -> Column:
    """Array of (role, text) that the grammar reads from a rendered conversation; a null element is no legal turn."""

    def read(pieces: Column) -> Column:
        # a text that ends in a closing string has an empty last piece
        turns = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), _turn)
        return F.when(F.element_at(pieces, -1) == "", turns).otherwise(F.concat(turns, F.array(F.lit(None).cast("struct<role:string,text:string>"))))

    return F.get(F.transform(F.array(_pieces(text)), read), F.lit(0))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: id, formatted, turns (read back), escaped (how many turns needed it), identical."""
    rows = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.coalesce(F.col(role), F.lit("")).alias("_r"), F.coalesce(F.col(text), F.lit("")).alias("_x"))
    source = F.array(F.struct(F.col("_r").alias("role"), F.col("_x").alias("text")))
    raw = rows.withColumn("_raw", render(F.col("_r"), F.col("_x"))).withColumn("_esc", ~F.coalesce(parse(F.col("_raw")) == source, F.lit(False)))
    done = raw.withColumn("_out", F.when(F.col("_esc"), render(F.col("_r"), escape(F.col("_x")))).otherwise(F.col("_raw")))
    convs = done.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_t", "_r", "_x", "_out", "_esc"))).alias("_a"))
    convs = convs.withColumn("formatted", F.array_join(F.col("_a._out"), "")).withColumn("_back", parse(F.col("formatted")))
    source = F.transform("_a", lambda t: F.struct(t["_r"].alias("role"), t["_x"].alias("text")))
    return convs.select(
        F.col("_c").alias(conv),
        "formatted",
        F.col("_back").alias("turns"),
        F.size(F.filter("_a", lambda t: t["_esc"])).alias("escaped"),
        F.coalesce(F.col("_back") == source, F.lit(False)).alias("identical"),
    )


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: the assistant turns in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
