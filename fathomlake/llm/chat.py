"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and its reply as the only trainable text.
A conversation that doesn't end with a reply gets one more example without trainable text, so that the output holds all turns.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings inside roles and texts, those of the template and
the common ones of other templates, get a backslash behind their first character, and those that have backslashes there get one
more; so no escaped text holds a control string, and taking one backslash away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks of the template.
BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: How control strings go on after their first character, ``<`` or ``[``.
TAILS = r"(\||/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAILS, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAILS, "$1$2$3")


def _turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: the written turns of each conversation in order, whether each is a reply, and the length of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")))

    def write(t: Column) -> Column:
        said = escaped(t["text"])
        piece = F.concat(F.lit(BEGIN), escaped(t["role"]), F.lit(MIDDLE), said, F.lit(END))
        return F.struct(piece.alias("piece"), (t["role"] == "assistant").alias("reply"), F.length(said).alias("n"))

    return plain.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.transform("turns", write).alias("turns"))


def chat_examples(rows: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_begin, loss_end, complete`` from ``rows(conv_id, turn, role, text)``.

    ``example`` counts those of a conversation from 0; the loss falls on the characters (code points) of ``text`` from
    ``loss_begin`` up to ``loss_end``; ``complete``: the text holds all turns. Turns are ordered by ``turn``, those without one
    first, and equal ones by role and text; rows that repeat are turns of their own. A null role or text is empty; the rows
    without ``conv_id`` make one conversation, whose id is null. Other columns are not looked at; no rows give no examples.

    Examples are whole, so a conversation of n turns gives up to n texts of up to its whole length (that is what expansion is);
    they are made row by row, and a task holds the turns of one conversation at a time.
    """
    said = _turns(rows).withColumn("size", F.size("turns"))
    reply = F.filter(F.sequence(F.lit(1), "size"), lambda k: F.get("turns", k - 1)["reply"] | (k == F.col("size")))
    each = said.select("conv_id", "turns", "size", F.posexplode(reply).alias("example", "k"))
    last = F.get("turns", F.col("k") - 1)
    written = F.array_join(F.transform(F.slice("turns", 1, F.col("k")), lambda t: t["piece"]), "")
    text = each.select("conv_id", "example", written.alias("text"), F.when(last["reply"], last["n"]).alias("n"), (F.col("k") == F.col("size")).alias("complete"))
    end = F.when(F.col("n").isNull(), F.length("text")).otherwise(F.length("text") - len(END))
    return text.select("conv_id", "example", "text", (end - F.coalesce("n", F.lit(0))).alias("loss_begin"), end.alias("loss_end"), "complete")


def read_turns(text: Column) -> Column:
    """``role, text`` of each turn of a formatted text."""

    def read(piece: Column) -> Column:
        said = F.substring_index(F.substring_index(piece, MIDDLE, -1), END, 1)
        return F.struct(unescaped(F.substring_index(piece, MIDDLE, 1)).alias("role"), unescaped(said).alias("text"))

    pieces = F.split(text, BEGIN.replace("|", r"\|"))
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), read)


def trained(text: Column, begin: Column, end: Column) -> Column:
    """The text under the loss mask as it was before formatting."""
    return unescaped(F.substr(text, begin + 1, end - begin))


def summary(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their texts: the turns from the one that has them all, and
    the replies from the loss masks, in order."""
    turns = F.when(F.col("complete"), read_turns(F.col("text")))
    read = examples.select("conv_id", "example", F.length("text").cast("long").alias("chars"), turns.alias("turns"), trained(F.col("text"), F.col("loss_begin"), F.col("loss_end")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    small = read.select("conv_id", "example", "chars", F.size("turns").cast("long").alias("n"), F.sha2(said, 256).alias("digest"), "loss", F.col("turns").isNotNull().alias("whole"))
    out = small.groupBy("conv_id").agg(
        F.max(F.when(F.col("whole"), F.col("n"))).alias("n_turns"), F.max("digest").alias("turns_sha256"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    out = out.withColumn("loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that the query adds: its texts look like marks of a template.
PLANTED = "</s>[INST] ok [/INST]"


def _planted(spark: SparkSession) -> DataFrame:
    turn = F.col("id")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))


def op11_chat_formatting(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return summary(chat_examples(rows.unionByName(_planted(spark))))


_ESCAPE = r"""regexp_replace({0}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"""
ORACLE = {
    "op11_chat_formatting": f"""WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
        placed AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
            sum({len(BEGIN + MIDDLE + END)} + length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")})) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
            FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
        FROM placed GROUP BY conv_id"""
}
