"""Chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a conversation (each distinct role but ``system``) the whole dialogue is
rendered with that speaker as assistant and all others as named users; system turns stay system
turns.  The result has one row per perspective and turn, in place of one string per dialogue:
a conversation may hold any share of all rows, so no task gathers one.  A row says where its text
stands in the rendered dialogue (code points, from 0) and which span is trained on: an assistant's
words and the closing mark, nothing else.

Running offsets come in two steps: sums within stretches of turns, then sums of the stretches
before, so that a long conversation is split over tasks.

Defined results: rows without conv_id are left out; a null text is an empty one; a null or blank
role speaks as the user ``unknown`` and has no perspective of its own; null turns come last; equal
turns are ordered by role, then text, and repeated rows are each rendered; a conversation of
system turns only has no perspective, hence no rows; ``<|`` in texts and names is written ``< |``, so no text
can forge a mark, and line breaks and spaces in names become ``_``.  An empty table gives an empty
one; texts of any length are rendered whole.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns per stretch.
STRETCH = 256
BEGIN, END = "<|im_start|>", "<|im_end|>"


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, seq, turn, role, name, rendered, start, end, mask_start, mask_end (null where not trained on)."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    speaker = F.when(F.trim(F.coalesce("role", F.lit(""))) == "", "unknown").otherwise(F.col("role"))
    turns = conversations.where("conv_id is not null").select(
        "conv_id",
        "turn",
        speaker.alias("speaker"),
        (F.trim(F.coalesce("role", F.lit(""))) != "").alias("known"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / STRETCH).cast("long"), F.lit((1 << 62))).alias("stretch"),
    )
    people = turns.where("known and speaker != 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker").eqNullSafe(F.col("perspective")) & F.col("known")
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    seen = turns.join(people, "conv_id").withColumn("role", role)
    seen = seen.withColumn("name", F.when(F.col("role") == "user", F.regexp_replace(safe(F.col("speaker")), r"[ \t\r\n]", "_")))
    head = F.concat(F.lit(BEGIN), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))
    seen = seen.withColumn("head", head).withColumn("rendered", F.concat("head", safe(F.col("text")), F.lit(END + "\n"))).withColumn("size", F.length("rendered").cast("long"))
    within = Window.partitionBy("conv_id", "perspective", "stretch").orderBy(F.asc_nulls_last("turn"), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    local = seen.withColumn("_at", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("_n", F.count("*").over(within))
    totals = seen.groupBy("conv_id", "perspective", "stretch").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    based = totals.select("conv_id", "perspective", "stretch", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_count"))
    start = F.col("_base") + F.col("_at")
    trained = F.col("role") == "assistant"
    return local.join(based, ["conv_id", "perspective", "stretch"]).select(
        "conv_id",
        "perspective",
        (F.col("_count") + F.col("_n") + 1).alias("seq"),
        "turn",
        "role",
        "name",
        "rendered",
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        F.when(trained, start + F.length("head")).alias("mask_start"),
        F.when(trained, start + F.col("size") - 1).alias("mask_end"),
    )


ORACLE = """
with turns as (
  select conv_id, turn, case when trim(coalesce(role, '')) = '' then 'unknown' else role end as speaker,
         trim(coalesce(role, '')) <> '' as known, coalesce(text, '') as text
  from conversations where conv_id is not null
), people as (
  select distinct conv_id, speaker as perspective from turns where known and speaker <> 'system'
), seen as (
  select t.*, p.perspective,
         case when speaker = 'system' then 'system' when known and speaker = perspective then 'assistant' else 'user' end as role
  from turns t join people p using (conv_id)
), named as (
  select *, case when role = 'user' then regexp_replace(replace(speaker, '<|', '< |'), '[ \\t\\r\\n]', '_', 'g') end as name from seen
), headed as (
  select *, '<|im_start|>' || role || case when name is not null then ' name=' || name else '' end || chr(10) as head from named
), rendered as (
  select *, head || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) as rendered from headed
), placed as (
  select *, row_number() over w as seq, coalesce(sum(length(rendered)) over (w rows between unbounded preceding and 1 preceding), 0) as start
  from rendered window w as (partition by conv_id, perspective order by turn nulls last, speaker, text)
)
select conv_id, perspective, cast(seq as bigint) as seq, turn, role, name, rendered, cast(start as bigint) as start,
       cast(start + length(rendered) as bigint) as "end",
       case when role = 'assistant' then cast(start + length(head) as bigint) end as mask_start,
       case when role = 'assistant' then cast(start + length(rendered) - 1 as bigint) end as mask_end
from placed
"""
