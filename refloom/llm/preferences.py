"""Chat formatting for preference training, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The role whose words are trained on.
TRAINED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of struct(turn, role, text) in order) from one row per turn.

    A null role reads "unknown", a null text is empty, a null turn number comes last; equal turn numbers are ordered by
    role and text and exact repetitions count once.  Rows without conv_id belong to no conversation and are left out.
    """
    t = turns.filter(F.col("conv_id").isNotNull())
    one = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_set(one)).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Turns at the start that two conversations share, by role and text."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"]))
    return F.coalesce(F.get(differ, 0), n)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n"))), "")


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def loss_spans(turns: Column, role: str = TRAINED) -> Column:
    """array<struct<start,end>>: code-point spans of render(turns) that are trained on: the texts of the role's turns.
    All else is masked."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(_head(t))
        end = start + F.char_length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], F.when(t["role"] == role, span).otherwise(empty)).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen_id, chosen, rejected_id, rejected (arrays of turns).

    The longest common turn prefix is rendered once as the prompt; what follows in each is a completion with the spans
    that carry loss.  usable: both completions have a trained turn and they differ.  A missing side is an empty
    conversation, so such a pair, like two equal conversations, is kept as not usable.
    """
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    a, b = F.coalesce("chosen", empty), F.coalesce("rejected", empty)
    p = pairs.withColumn("_a", a).withColumn("_b", b).withColumn("n_prompt_turns", common_prefix(F.col("_a"), F.col("_b")))
    n = F.col("n_prompt_turns")
    p = p.withColumn("_head", F.slice("_a", F.lit(1), n)).withColumn("_a", F.slice("_a", n + 1, F.size("_a"))).withColumn("_b", F.slice("_b", n + 1, F.size("_b")))
    p = p.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", render(F.col("_head")).alias("prompt"), render(F.col("_a")).alias("chosen"), loss_spans(F.col("_a")).alias("chosen_loss"), render(F.col("_b")).alias("rejected"), loss_spans(F.col("_b")).alias("rejected_loss"))
    return p.withColumn("usable", (F.size("chosen_loss") > 0) & (F.size("rejected_loss") > 0) & (F.col("chosen") != F.col("rejected")))


def neighbour_pairs(convs: DataFrame) -> DataFrame:
    """Pairs of a table without preference marks: conversation 2k is chosen over 2k + 1.  One equi-join key per pair:
    a hot conversation text or opening meets no one but its neighbour."""
    side = F.pmod(F.col("conv_id"), F.lit(2))
    c = convs.withColumn("pair_id", F.expr("(conv_id - pmod(conv_id, 2)) div 2"))
    pick = lambda s, c: F.max(F.when(side == s, F.col(c)))
    first = lambda s: F.first(F.when(side == s, F.col("turns")), ignorenulls=True)
    return c.groupBy("pair_id").agg(pick(0, "conv_id").alias("chosen_id"), first(0).alias("chosen"), pick(1, "conv_id").alias("rejected_id"), first(1).alias("rejected"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of neighbouring conversations; loss spans as "start-end,..."."""
    p = format_preferences(neighbour_pairs(conversations(table(spark, sf_dir, "conversations"))))
    return p.withColumn("chosen_loss", spans_text(F.col("chosen_loss"))).withColumn("rejected_loss", spans_text(F.col("rejected_loss")))
