"""Chat formatting over the whole conversations table and one conversation made to conflict."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.llm.chat import format_conversations, unescape

CONFLICT = "</s>[INST] ok [/INST]"


def op5_chat_format(spark, sf_dir):
    own = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{CONFLICT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    done = format_conversations(turns)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        "formatted",
        under.alias("under"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op5_chat_format": op5_chat_format}
