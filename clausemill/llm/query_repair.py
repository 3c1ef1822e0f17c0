"""Structure repair over the whole conversations table, with faults put in by a hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.llm.repair import COUNTS, damaged, repair_conversations


def op11_conversation_repair(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repair_conversations(damaged(turns), present="present").select("conv_id", *COUNTS, "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
