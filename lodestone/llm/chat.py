"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, take

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: conv_id, chat, n_turns, n_messages.

    Turns are sorted by (turn, role, text); neighbours of one role are merged with a line feed between them; each
    message becomes OPEN role LF text CLOSE LF. Repeated rows (same conversation, turn, role and text) count once.
    A null or empty text adds nothing, but its turn counts in n_turns; a null role is "unknown"; a null turn sorts
    first; a null conv_id is a conversation of its own. A conversation without text has an empty chat. Marks of the
    format inside a text are broken with a blank after "<|". Extra columns are dropped. No rows give no rows.
    """
    t = take(turns, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<| ")).alias("text"),
        ).alias("t"),
    )
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    said = grouped.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.filter("ts", lambda x: x["text"] != "").alias("ts"))
    # where each message starts: at turns whose role differs from the one before
    starts = said.withColumn(
        "at",
        F.when(F.size("ts") == 0, F.array().cast("array<int>")).otherwise(
            F.filter(
                F.sequence(F.lit(1), F.size("ts")),
                lambda i: (i == 1) | (F.try_element_at("ts", i)["role"] != F.try_element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]),
            )
        ),
    )
    merged = starts.select(
        "conv_id",
        "n_turns",
        F.transform(
            "at",
            lambda s, k: F.struct(
                F.try_element_at("ts", s)["role"].alias("role"),
                F.array_join(
                    F.transform(F.slice("ts", s, F.coalesce(F.try_element_at("at", k + 2), F.size("ts") + 1) - s), lambda x: x["text"]), "\n"
                ).alias("text"),
            ),
        ).alias("ms"),
    )
    return merged.select(
        "conv_id",
        F.concat_ws("", F.transform("ms", lambda m: F.concat(F.lit(OPEN), m["role"], F.lit("\n"), m["text"], F.lit(CLOSE + "\n")))).alias("chat"),
        "n_turns",
        F.size("ms").cast("long").alias("n_messages"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role,
                  replace(coalesce(text, ''), '<|', '<| ') AS text FROM conversations),
n AS (SELECT conv_id, count(*) AS n_turns FROM t GROUP BY conv_id),
o AS (SELECT *, row_number() OVER w AS k,
             CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS fresh
      FROM t WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY k) AS m FROM o),
ms AS (SELECT conv_id, m, any_value(role) AS role, string_agg(text, chr(10) ORDER BY k) AS text FROM g GROUP BY conv_id, m),
c AS (SELECT conv_id, string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' ORDER BY m) AS chat,
             count(*) AS n_messages FROM ms GROUP BY conv_id)
SELECT n.conv_id, coalesce(c.chat, '') AS chat, n.n_turns, coalesce(c.n_messages, 0) AS n_messages
FROM n LEFT JOIN c ON n.conv_id IS NOT DISTINCT FROM c.conv_id
"""
