"""Usage, cost and error roll-ups over speech and language-model records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.fixed import ERROR_RULES, FREE_CHARACTERS, MODELS, PRICES, TIER_TOKENS, VOICES

MONEY = 100_000_000  # cost_units are hundredths of a millionth


def totals(costs: str = "cost_units") -> list[Column]:
    return [F.coalesce(F.sum(costs), F.lit(0)).alias("cost"), F.count("*").alias("requests"), F.coalesce(F.sum("text_length"), F.lit(0)).alias("characters"), F.coalesce(F.sum("audio_tenths"), F.lit(0)).alias("audio")]


def rollup(usage: DataFrame) -> DataFrame:
    """All grains of a dashboard in one scan: everything, provider, provider and voice type, day."""
    days = usage.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    sets = days.groupingSets([[], [days["provider"]], [days["provider"], days["voice_type"]], [days["day"]]], days["provider"], days["voice_type"], days["day"])
    out = sets.agg(F.grouping_id().alias("_g"), *totals())
    grain = F.when(F.col("_g") == 7, "all").when(F.col("_g") == 3, "provider").when(F.col("_g") == 1, "voice").otherwise("day")
    return out.select(grain.alias("grain"), "provider", "voice_type", "day", "cost", "requests", "characters", "audio")


def nested_by_provider(usage: DataFrame) -> DataFrame:
    """A row for each provider with a map of its voice types."""
    flat = usage.groupBy("provider", "voice_type").agg(*totals())
    entry = F.struct("voice_type", F.struct("cost", "requests").alias("v"))
    return flat.groupBy("provider").agg(F.sum("cost").alias("cost"), F.sum("requests").alias("requests"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("voices"))


def month_by_tier(usage: DataFrame, month: str) -> DataFrame:
    """Characters of one month, a column for each tier."""
    part = usage.where(F.date_format("ts", "yyyy-MM") == month)
    tiers = [F.coalesce(F.sum(F.when(F.col("voice_type") == t, F.col("text_length"))), F.lit(0)).alias(t.replace("-", "_")) for t in ("standard", "neural", "long-form")]
    return part.groupBy("provider").agg(*tiers, F.sum("text_length").alias("characters"))


def free_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FREE_CHARACTERS, "provider string, voice_type string, free long")


def beyond_free(usage: DataFrame, month: str) -> DataFrame:
    """What a tier costs once its free characters of the month are taken off, at its mean price a character.

    A provider with one limit for all its tiers shares what is beyond it by the tiers' characters.
    """
    monthly = F.sum(F.when(F.date_format("ts", "yyyy-MM") == month, F.col("text_length")).otherwise(0))
    # the second provider prices all but its standard voices as one tier
    tier = F.when((F.col("provider") == "google") & (F.col("voice_type") != "standard"), "neural").when(F.col("provider") == "elevenlabs", F.lit(None)).otherwise(F.col("voice_type"))
    flat = usage.groupBy("provider", "voice_type").agg(F.sum("cost_units").alias("cost"), F.sum("text_length").alias("characters"), monthly.alias("month_characters")).withColumn("tier", tier)
    w = Window.partitionBy("provider", "tier")
    limits = free_limits(usage.sparkSession).withColumnRenamed("voice_type", "limit_tier").withColumnRenamed("provider", "limit_provider")
    joined = flat.withColumn("tier_characters", F.sum("month_characters").over(w)).join(F.broadcast(limits), (F.col("provider") == F.col("limit_provider")) & F.col("tier").eqNullSafe(F.col("limit_tier")), "left")
    over = F.greatest(F.col("tier_characters") - F.coalesce("free", F.lit(0)), F.lit(0))
    share = F.coalesce(F.try_divide("month_characters", "tier_characters"), F.lit(0.0))
    return joined.select("provider", "voice_type", "month_characters", over.alias("over"), F.round(over * share * F.coalesce(F.try_divide("cost", "characters"), F.lit(0.0)) / MONEY, 6).alias("adjusted"))


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, *v) for p, vs in VOICES.items() for v in vs], "provider string, voice_id string, name string, gender string, tier string")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model_id string, name string, provider string, max_tokens long")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model_id string, input double, output double, input_over double, output_over double")


def with_voice_tier(df: DataFrame) -> DataFrame:
    """provider, voice_id to tier; what is not known is standard."""
    return df.join(F.broadcast(voices(df.sparkSession).select("provider", "voice_id", "tier")), ["provider", "voice_id"], "left").withColumn("tier", F.coalesce("tier", F.lit("standard")))


def with_model_cost(df: DataFrame) -> DataFrame:
    """Cost of each call. Each side's price tier is chosen by its own tokens; a model without a price is an error."""
    joined = df.join(F.broadcast(prices(df.sparkSession)), "model_id", "left")
    side = lambda tokens, low, high: F.col(tokens) / 1000 * F.when(F.col(tokens) <= TIER_TOKENS, F.col(low)).otherwise(F.col(high))
    known = F.when(F.col("input").isNull(), F.raise_error(F.concat(F.lit("no price for model "), F.col("model_id"))).cast("double"))
    return joined.withColumn("cost", known.otherwise(side("prompt_tokens", "input", "input_over") + side("completion_tokens", "output", "output_over"))).drop("input", "output", "input_over", "output_over")


def estimated_cost(df: DataFrame) -> DataFrame:
    """Calls (model_id, prompt_tokens, expected_tokens) with ``completion_tokens``, half of the prompt's where none are expected, and ``cost``."""
    expected = F.coalesce(F.nullif("expected_tokens", F.lit(0)), F.ceil(F.col("prompt_tokens") / 2))
    return with_model_cost(df.withColumn("completion_tokens", expected))


def voice_class(provider: Column, voice_id: Column) -> Column:
    """A voice's tier by its name: of one provider by lists, of another by a part of the name; standard where nothing else is known."""
    out = None
    for tier in ("long-form", "neural", "standard"):
        test = (provider == "polly") & voice_id.isin([i for i, _, _, t in VOICES["polly"] if t == tier])
        out = F.when(test, tier) if out is None else out.when(test, tier)
    return out.when((provider == "google") & voice_id.contains("Neural2"), "neural").otherwise("standard")


def character_price(provider: Column, tier: Column) -> Column:
    """Price of a character of speech."""
    polly = F.when(tier == "neural", 0.000025).when(tier == "long-form", 0.0001).when(tier == "generative", 0.0002).otherwise(0.000004)
    return F.when(provider == "polly", polly).when(provider == "google", F.when(tier == "neural", 0.000016).otherwise(0.000004)).when(provider == "elevenlabs", F.lit(0.00018))


def error_code(message: Column) -> Column:
    """The first rule that an error's text fits."""
    low = F.lower(message)
    out = None
    for code, any_of, and_any in ERROR_RULES:
        fits = low.rlike("|".join(any_of))
        if and_any:
            fits = fits & low.rlike("|".join(and_any))
        out = F.when(fits, code) if out is None else out.when(fits, code)
    return out.otherwise("UNKNOWN_ERROR")


def latest_by_code(errors: DataFrame) -> DataFrame:
    """Count, and message and time of the newest error of each provider and code; of equal times the highest id."""
    return errors.groupBy("provider", "code").agg(F.count("*").alias("n"), F.max_by("original_error", F.struct("ts", "error_id")).alias("latest"), F.max("ts").alias("latest_at"))


def bars(df: DataFrame, value: str, least: float = 5.0, least_top: float = 0.0) -> DataFrame:
    """Height of each row's bar in percent of the highest. The highest is one row, joined, so no window takes all rows."""
    top = df.agg(F.greatest(F.max(value), F.lit(least_top)).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("height", F.round(F.greatest(F.lit(least), F.coalesce(F.try_divide(F.col(value) * 100, F.col("_top")), F.lit(0.0))), 4)).drop("_top")
