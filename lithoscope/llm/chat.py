"""Chat formatting as a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "[INST]" role "\\n" text "[/INST]"     a turn that is read
                  | "<s>"    role "\\n" text "</s>"        a turn that is learned

The parser takes the first closing mark after an opening one, so it is
deterministic.  Each turn is first written as it is and parsed again; where the
parser does not give back exactly that turn, its text is written with every
control string escaped, one backslash more after its first character.  Reading
takes one backslash from every escaped control string, so text that merely looks
escaped is itself a conflict and gains one.  Conversations are then parsed as a
whole and compared turn by turn with their source.

Defined results: a null text or role counts as empty; a null turn sorts first;
rows with the same turn go by role, then text; repeated rows are turns of their
own; a null conv_id is a conversation; further columns are ignored; an empty
table gives no rows.  A conversation is one value of the result, so its turns
meet in one task; its length is the only bound on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNED = ("assistant",)
#: Control strings after their first character, and with the first one.
_TAIL = r"(/?INST\]|/?s>)"
_ESCAPABLE = rf"([\[<])(\\*){_TAIL}"
_ESCAPED = rf"([\[<])\\(\\*){_TAIL}"
_TURN = r"(?s)\[INST\]([^\n]*)\n(.*?)\[/INST\]|<s>([^\n]*)\n(.*?)</s>"
#: Characters of a role that would break its line or open a mark, and what stands for them.
_ROLE = (("%", "%25"), ("\n", "%0A"), ("[", "%5B"), ("<", "%3C"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_line(role: Column) -> Column:
    for plain, code in _ROLE:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_from(line: Column) -> Column:
    for plain, code in reversed(_ROLE):
        line = F.replace(line, F.lit(code), F.lit(plain))
    return line


def render(role: Column, body: Column, learned: Column) -> Column:
    head = F.concat(_role_line(role), F.lit("\n"))
    return F.when(learned, F.concat(F.lit("<s>"), head, body, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), head, body, F.lit("[/INST]")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text in order: array of role, text, learned."""
    pieces = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))

    def turn(piece: Column) -> Column:
        learned = piece.startswith("<s>")
        inner = F.when(learned, F.substring(piece, F.lit(4), F.length(piece) - 7)).otherwise(F.substring(piece, F.lit(7), F.length(piece) - 13))
        cut = F.locate("\n", inner)
        return F.struct(
            _role_from(F.substring(inner, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"),
            learned.alias("learned"),
        )

    return F.transform(pieces, turn)


def format_conversations(turns: DataFrame, learned_roles: tuple[str, ...] = LEARNED) -> DataFrame:
    """conv_id, formatted, mask (begin, length of what is learned, in characters from 0), n_escaped, round_trip.

    ``turns``: conv_id, turn, role, text.  ``round_trip``: the parser gives back
    all turns of the source and reads all of ``formatted``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = ("turn", "role", "text", "piece")
    rows = (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumn("learned", F.col("role").isin(*learned_roles))
        .withColumn("plain", render(F.col("role"), F.col("text"), F.col("learned")))
        .withColumn("plain_ok", parse(F.col("plain")) == F.array(F.struct("role", "text", "learned")))
        .withColumn("body", F.when(F.col("plain_ok"), F.col("text")).otherwise(escape(F.col("text"))))
        .withColumn("piece", F.when(F.col("plain_ok"), F.col("plain")).otherwise(render(F.col("role"), F.col("body"), F.col("learned"))))
        .withColumn("body_length", F.length("body"))
        .withColumn("head_length", F.length("piece") - F.col("body_length") - F.when(F.col("learned"), 4).otherwise(7))
    )
    so_far = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("k", F.row_number().over(so_far)).withColumn("begin", F.sum(F.length("piece").cast("long")).over(so_far) - F.length("piece"))
    span = F.struct((F.col("begin") + F.col("head_length")).alias("begin"), F.col("body_length").cast("long").alias("length"))
    packed = numbered.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "piece", "role", "text", "learned", span.alias("span")))).alias("t"),
        F.count_if(~F.col("plain_ok")).alias("n_escaped"),
    )
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["learned"].alias("learned")))
    return (
        packed.withColumn("formatted", F.array_join(F.transform("t", lambda x: x["piece"]), ""))
        .withColumn("mask", F.transform(F.filter("t", lambda x: x["learned"]), lambda x: x["span"]))
        .withColumn("round_trip", parse(F.col("formatted")) == source)
        .select("conv_id", "formatted", "mask", "n_escaped", "round_trip")
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """Everything under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["begin"] + 1).cast("int"), m["length"].cast("int")))), "")
