"""Views that many queries start from, as DataFrames and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENS_SQL = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_'']+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next turn of its conversation as hypothesis."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("requested"), nxt.alias("hypothesis")).where("hypothesis is not null")


TURNS_SQL = f"""turns as (select conv_id, turn, role, {TOKENS_SQL.format("requested")} r, {TOKENS_SQL.format("hypothesis")} h from
  (select conv_id, turn, role, text requested, lead(text) over (partition by conv_id order by turn) hypothesis from conversations) where hypothesis is not null)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as objective observations: the first event of each (type, user, day)."""
    e = table(spark, sf_dir, "events")
    day = F.dayofyear("ts")
    first = e.groupBy("event_type", "user_id", day.alias("seed")).agg(F.min(F.struct("event_id", "value", "props")).alias("e"))
    k = F.get_json_object("e.props", "$.k").cast("long")
    prompt = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return first.select(
        F.concat_ws("--", "event_type", prompt, F.col("seed").cast("string")).alias("sample_id"), F.col("event_type").alias("candidate_id"), prompt.alias("prompt_id"), "seed",
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("category"), (F.col("e.value") > 20).alias("valid"), F.col("e.event_id").alias("ord"),
        (F.col("e.value") / 100).alias("generation_seconds"), (F.col("e.value") * 1e6).alias("peak_memory_bytes"), F.when(k > 0, k.cast("double")).alias("audio_duration_seconds"), k.alias("k"),
    )


OBS_SQL = """obs as (select event_type || '--user-' || user_id || '--' || seed sample_id, event_type candidate_id, 'user-' || user_id prompt_id, seed, 'c' || (user_id % 3) category, value > 20 as valid, event_id ord,
    value / 100 generation_seconds, value * 1e6 peak_memory_bytes, case when k > 0 then cast(k as double) end audio_duration_seconds, k
  from (select event_type, user_id, cast(dayofyear(ts) as int) seed, event_id, value, cast(json_extract_string(props, '$.k') as bigint) k,
      row_number() over (partition by event_type, user_id, dayofyear(ts) order by event_id) n from events) where n = 1)"""

METRICS = ["generation_seconds", "peak_memory_bytes", "audio_duration_seconds", "real_time_factor"]

LONG_SQL = f"""{OBS_SQL},
rtf as (select *, case when valid and audio_duration_seconds > 0 then generation_seconds / audio_duration_seconds end real_time_factor from obs),
long as (select sample_id, candidate_id, prompt_id, seed, category, valid, 'generation_seconds' metric, generation_seconds as value from rtf
  union all select sample_id, candidate_id, prompt_id, seed, category, valid, 'peak_memory_bytes', peak_memory_bytes from rtf
  union all select sample_id, candidate_id, prompt_id, seed, category, valid, 'audio_duration_seconds', case when valid then audio_duration_seconds end from rtf
  union all select sample_id, candidate_id, prompt_id, seed, category, valid, 'real_time_factor', real_time_factor from rtf)"""


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.score import long_form, real_time_factor

    return long_form(real_time_factor(observations(spark, sf_dir)), METRICS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a corpus split by id."""
    d = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 10 == 8, "validation").when(F.col("doc_id") % 10 == 9, "test").otherwise("train")
    return d.withColumn("split", split)


DOCS_SQL = "docs as (select *, case doc_id % 10 when 8 then 'validation' when 9 then 'test' else 'train' end split from documents)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of each user, in order, as a signal around zero."""
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("signal"), i.alias("i"), ((F.col("value") - 50) / 250).alias("x"))


SIGNAL_SQL = "sig as (select user_id signal, row_number() over (partition by user_id order by event_id) - 1 i, (value - 50) / 250 x from events)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
