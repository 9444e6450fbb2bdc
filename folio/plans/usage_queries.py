"""Queries of usage, costs and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.fixed import ERROR_RULES, FREE_CHARACTERS, MODELS, PRICES, VOICES
from folio.functions import bpe
from folio.operators import usage as U
from folio.plans.base import cte, frame
from folio.plans.registry import query

TOTALS = "CAST(coalesce(sum(cost_units), 0) AS BIGINT) AS cost, count(*) AS requests, CAST(coalesce(sum(text_length), 0) AS BIGINT) AS characters, CAST(coalesce(sum(audio_tenths), 0) AS BIGINT) AS audio"
DAY = "strftime(ts, '%Y-%m-%d')"
MONTH = "2000-04"


def values(rows, names: str) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


@query("s01_usage_newest_first", cte("tts_usage") + "SELECT usage_id, usage_line, provider, cost_units, ts FROM tts_usage ORDER BY ts DESC, usage_id, usage_line")
def s01(spark, folder):
    return frame(spark, folder, "tts_usage").select("usage_id", "usage_line", "provider", "cost_units", "ts").orderBy(F.desc("ts"), "usage_id", "usage_line")


@query("s02_errors_newest_first", cte("tts_errors") + "SELECT error_id, provider, ts FROM tts_errors ORDER BY ts DESC, error_id")
def s02(spark, folder):
    return frame(spark, folder, "tts_errors").select("error_id", "provider", "ts").orderBy(F.desc("ts"), "error_id")


@query("a01_usage_totals", cte("tts_usage") + f"SELECT {TOTALS} FROM tts_usage")
def a01(spark, folder):
    return frame(spark, folder, "tts_usage").agg(*U.totals())


@query("a01_usage_totals_of_nothing", cte("tts_usage") + f"SELECT {TOTALS} FROM tts_usage WHERE provider = 'none'")
def a01_none(spark, folder):
    return frame(spark, folder, "tts_usage").where("provider = 'none'").agg(*U.totals())


@query("a02_usage_by_provider", cte("tts_usage") + f"SELECT provider, {TOTALS} FROM tts_usage GROUP BY provider")
def a02(spark, folder):
    return frame(spark, folder, "tts_usage").groupBy("provider").agg(*U.totals())


@query("a03_usage_by_voice_type", cte("tts_usage") + f"SELECT provider, voice_type, {TOTALS} FROM tts_usage GROUP BY ALL")
def a03(spark, folder):
    return frame(spark, folder, "tts_usage").groupBy("provider", "voice_type").agg(*U.totals())


@query("a03_usage_nested", cte("tts_usage") + """, flat AS (SELECT provider, voice_type, sum(cost_units) c, count(*) n FROM tts_usage GROUP BY ALL)
 SELECT provider, CAST(sum(c) AS BIGINT) AS cost, CAST(sum(n) AS BIGINT) AS requests, string_agg(voice_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY voice_type) AS voices FROM flat GROUP BY provider""")
def a03_nested(spark, folder):
    nested = U.nested_by_provider(frame(spark, folder, "tts_usage"))
    shown = F.array_join(F.transform(F.map_entries("voices"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["requests"].cast("string"))), ",")
    return nested.select("provider", "cost", "requests", shown.alias("voices"))


@query("a04_usage_by_day", cte("tts_usage") + f"SELECT {DAY} AS day, CAST(sum(cost_units) AS BIGINT) AS cost, count(*) AS requests FROM tts_usage GROUP BY 1")
def a04(spark, folder):
    return frame(spark, folder, "tts_usage").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("cost_units").alias("cost"), F.count("*").alias("requests"))


@query("a01_a04_rollup", cte("tts_usage") + f""", d AS (SELECT *, {DAY} AS day FROM tts_usage)
 SELECT 'all' AS grain, NULL AS provider, NULL AS voice_type, NULL AS day, {TOTALS} FROM d UNION ALL SELECT 'provider', provider, NULL, NULL, {TOTALS} FROM d GROUP BY provider
 UNION ALL SELECT 'voice', provider, voice_type, NULL, {TOTALS} FROM d GROUP BY provider, voice_type UNION ALL SELECT 'day', NULL, NULL, day, {TOTALS} FROM d GROUP BY day""")
def a01_a04(spark, folder):
    return U.rollup(frame(spark, folder, "tts_usage"))


@query("a05_errors_by_provider", cte("tts_errors") + "SELECT provider, count(*) AS n FROM tts_errors GROUP BY provider")
def a05(spark, folder):
    return frame(spark, folder, "tts_errors").groupBy("provider").agg(F.count("*").alias("n"))


def code_sql(x: str = "lower(original_error)") -> str:
    any_ = lambda ws: "(" + " OR ".join(f"contains({x}, '{w}')" for w in ws) + ")"
    return "CASE " + " ".join(f"WHEN {any_(a)}{' AND ' + any_(b) if b else ''} THEN '{c}'" for c, a, b in ERROR_RULES) + " ELSE 'UNKNOWN_ERROR' END"


@query("a06_latest_error_by_code", cte("tts_errors") + f", c AS (SELECT *, {code_sql()} AS code FROM tts_errors) SELECT provider, code, count(*) AS n, arg_max(original_error, (ts, error_id)) AS latest, max(ts) AS latest_at FROM c GROUP BY ALL")
def a06(spark, folder):
    return U.latest_by_code(frame(spark, folder, "tts_errors").withColumn("code", U.error_code(F.col("original_error"))))


@query("f34_error_codes", cte("tts_errors") + f"SELECT DISTINCT original_error, {code_sql()} AS code FROM tts_errors")
def f34(spark, folder):
    return frame(spark, folder, "tts_errors").select("original_error", U.error_code(F.col("original_error")).alias("code")).distinct()


@query("a07_errors_by_day", cte("tts_errors") + f"SELECT {DAY} AS day, count(*) AS n FROM tts_errors GROUP BY 1")
def a07(spark, folder):
    return frame(spark, folder, "tts_errors").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


PRICED = f""", p AS (SELECT * FROM {values(PRICES, 'model_id, i, o, ih, oh')}), c AS (SELECT a.*, prompt_tokens / 1000 * CASE WHEN prompt_tokens <= 128000 THEN i ELSE ih END + completion_tokens / 1000 * CASE WHEN completion_tokens <= 128000 THEN o ELSE oh END AS cost FROM ai_usage a JOIN p USING (model_id)) """


@query("f30_call_costs", cte("ai_usage") + PRICED + "SELECT usage_id, model_id, round(cost + 0.0000000001, 6) AS cost FROM c")
def f30(spark, folder):
    return U.with_model_cost(frame(spark, folder, "ai_usage")).select("usage_id", "model_id", F.round(F.col("cost") + 1e-10, 6).alias("cost"))


@query("a08_model_usage_totals", cte("ai_usage") + PRICED + "SELECT round(sum(cost), 3) AS cost, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion FROM c")
def a08(spark, folder):
    return U.with_model_cost(frame(spark, folder, "ai_usage")).agg(F.round(F.sum("cost"), 3).alias("cost"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))


@query("a09_usage_by_model", cte("ai_usage") + PRICED + "SELECT model_id, round(sum(cost), 3) AS cost, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion, count(*) AS calls FROM c GROUP BY 1")
def a09(spark, folder):
    return U.with_model_cost(frame(spark, folder, "ai_usage")).groupBy("model_id").agg(F.round(F.sum("cost"), 3).alias("cost"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.count("*").alias("calls"))


@query("a10_model_usage_by_day", cte("ai_usage") + ", s AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM ai_usage) SELECT split_part(stamp, 'T', 1) AS day, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM s GROUP BY 1")
def a10(spark, folder):
    stamped = frame(spark, folder, "ai_usage").withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return stamped.groupBy(F.substring_index("stamp", "T", 1).alias("day")).agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count("*").alias("calls"))


@query("a11_counts", cte("tts_usage", "tts_errors", "reading_logs") + "SELECT 'usage' AS what, count(*) AS n FROM tts_usage WHERE provider = 'polly' UNION ALL SELECT 'errors', count(*) FROM tts_errors WHERE provider = 'polly' UNION ALL SELECT 'logs', count(*) FROM reading_logs WHERE user_id = 7")
def a11(spark, folder):
    count = lambda name, where, what: frame(spark, folder, name).where(where).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count("tts_usage", "provider = 'polly'", "usage").unionAll(count("tts_errors", "provider = 'polly'", "errors")).unionAll(count("reading_logs", "user_id = 7", "logs"))


@query("a14_month_by_tier", cte("tts_usage") + f"SELECT provider, " + ", ".join(f"CAST(coalesce(sum(text_length) FILTER (voice_type = '{t}'), 0) AS BIGINT) AS {t.replace('-', '_')}" for t in ("standard", "neural", "long-form")) + f", CAST(sum(text_length) AS BIGINT) AS characters FROM tts_usage WHERE strftime(ts, '%Y-%m') = '{MONTH}' GROUP BY provider")
def a14(spark, folder):
    return U.month_by_tier(frame(spark, folder, "tts_usage"), MONTH)


@query("a15_beyond_free_tier", cte("tts_usage") + f""", f AS (SELECT provider, voice_type, sum(cost_units) c, sum(text_length) n, CAST(sum(CASE WHEN strftime(ts, '%Y-%m') = '{MONTH}' THEN text_length ELSE 0 END) AS BIGINT) m,
 CASE WHEN provider = 'google' AND voice_type <> 'standard' THEN 'neural' WHEN provider = 'elevenlabs' THEN NULL ELSE voice_type END AS tier FROM tts_usage GROUP BY ALL),
 l AS (SELECT * FROM {values(FREE_CHARACTERS, 'lp, lt, free')}), w AS (SELECT f.*, CAST(sum(m) OVER (PARTITION BY provider, tier) AS BIGINT) AS tm FROM f)
 SELECT provider, voice_type, m AS month_characters, greatest(tm - coalesce(free, 0), 0) AS "over", round(greatest(tm - coalesce(free, 0), 0) * coalesce(m / nullif(tm, 0), 0) * coalesce(c / nullif(n, 0), 0) / 100000000, 6) AS adjusted FROM w LEFT JOIN l ON provider = lp AND tier IS NOT DISTINCT FROM lt""")
def a15(spark, folder):
    return U.beyond_free(frame(spark, folder, "tts_usage"), MONTH)


@query("a25_cost_bars", cte("tts_usage") + f", d AS (SELECT {DAY} AS day, CAST(sum(cost_units) AS BIGINT) AS cost FROM tts_usage GROUP BY 1) SELECT day, cost, round(greatest(5, cost * 100 / greatest(max(cost) OVER (), 0.001)), 4) AS height FROM d")
def a25(spark, folder):
    return U.bars(a04(spark, folder).select("day", "cost"), "cost", 5.0, 0.001)


@query("o08_newest_errors", cte("tts_errors") + "SELECT error_id, provider, original_error, ts FROM tts_errors ORDER BY ts DESC, error_id DESC LIMIT 10")
def o08(spark, folder):
    return frame(spark, folder, "tts_errors").select("error_id", "provider", "original_error", "ts").orderBy(F.desc("ts"), F.desc("error_id")).limit(10)


@query("o09_last_days", cte("tts_usage") + f", d AS (SELECT {DAY} AS day, CAST(sum(cost_units) AS BIGINT) AS cost FROM tts_usage GROUP BY 1 ORDER BY 1 DESC LIMIT 7) SELECT * FROM d ORDER BY day")
def o09(spark, folder):
    return a04(spark, folder).select("day", "cost").orderBy(F.desc("day")).limit(7).orderBy("day")


@query("p04_equality_filter", cte("tts_usage") + "SELECT usage_id, usage_line, cost_units FROM tts_usage WHERE provider = 'polly' AND user_id = 77")
def p04(spark, folder):
    return frame(spark, folder, "tts_usage").where((F.col("provider") == "polly") & (F.col("user_id") == 77)).select("usage_id", "usage_line", "cost_units")


@query("p05_closed_time_range", cte("tts_usage") + "SELECT usage_id, usage_line, ts FROM tts_usage WHERE ts BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-01-31'")
def p05(spark, folder):
    return frame(spark, folder, "tts_usage").where(F.col("ts").between(F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("2000-01-31").cast("timestamp_ntz"))).select("usage_id", "usage_line", "ts")


@query("p12_last_day", cte("tts_errors") + "SELECT error_id, ts FROM tts_errors WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00'")
def p12(spark, folder):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return frame(spark, folder, "tts_errors").where((F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= now)).select("error_id", "ts")


@query("p13_month_filter", cte("tts_usage") + f"SELECT provider, count(*) AS n FROM tts_usage WHERE strftime(ts, '%Y-%m') = '{MONTH}' GROUP BY provider")
def p13(spark, folder):
    return frame(spark, folder, "tts_usage").where(F.date_format("ts", "yyyy-MM") == MONTH).groupBy("provider").agg(F.count("*").alias("n"))


@query("p19_voice_membership", f"SELECT provider, voice_id, tier FROM {values([(p, *v) for p, vs in VOICES.items() for v in vs], 'provider, voice_id, name, gender, tier')} WHERE tier = 'neural'")
def p19(spark, folder):
    return U.voices(spark).where("tier = 'neural'").select("provider", "voice_id", "tier")


@query("p23_cost_threshold", cte("ai_usage") + PRICED + "SELECT usage_id, round(cost, 6) AS cost FROM c WHERE round(cost, 6) > 1.25")
def p23(spark, folder):
    return U.with_model_cost(frame(spark, folder, "ai_usage")).select("usage_id", F.round("cost", 6).alias("cost")).where("cost > 1.25")


@query("j15_price_join", cte("ai_usage") + f", p AS (SELECT * FROM {values(PRICES, 'model_id, i, o, ih, oh')}), m AS (SELECT * FROM {values(MODELS, 'model_id, name, provider, most')}) SELECT name, provider, i AS input, count(*) AS calls FROM ai_usage JOIN p USING (model_id) JOIN m USING (model_id) GROUP BY ALL")
def j15(spark, folder):
    priced = frame(spark, folder, "ai_usage").join(F.broadcast(U.prices(spark)), "model_id").join(F.broadcast(U.models(spark)), "model_id")
    return priced.groupBy("name", "provider", "input").agg(F.count("*").alias("calls"))


VOICE_OF = "CASE usage_line WHEN 1 THEN 'Joanna' WHEN 2 THEN 'Danielle' WHEN 3 THEN 'Emma' WHEN 4 THEN 'en-US-Neural2-A' WHEN 5 THEN 'pNInz6obpgDQGcFmaJgB' ELSE 'Nobody' END"


@query("j16_voice_tiers", cte("tts_usage") + f", v AS (SELECT * FROM {values([(p, *v) for p, vs in VOICES.items() for v in vs], 'provider, voice_id, name, gender, tier')}), u AS (SELECT *, {VOICE_OF} AS voice_id FROM tts_usage) SELECT u.provider, u.voice_id, coalesce(v.tier, 'standard') AS tier, count(*) AS n FROM u LEFT JOIN v ON u.provider = v.provider AND u.voice_id = v.voice_id GROUP BY ALL")
def j16(spark, folder):
    return U.with_voice_tier(frame(spark, folder, "tts_usage").withColumn("voice_id", F.expr(VOICE_OF))).groupBy("provider", "voice_id", "tier").agg(F.count("*").alias("n"))


PRICE_OF = "CASE provider WHEN 'polly' THEN CASE voice_type WHEN 'neural' THEN 0.000025 WHEN 'long-form' THEN 0.0001 WHEN 'generative' THEN 0.0002 ELSE 0.000004 END WHEN 'google' THEN CASE voice_type WHEN 'neural' THEN 0.000016 ELSE 0.000004 END ELSE 0.00018 END"


@query("f29_speech_costs", cte("tts_usage") + f", f AS (SELECT provider, voice_type, CAST(sum(text_length) AS DOUBLE) AS n FROM tts_usage GROUP BY ALL) SELECT provider, voice_type, round(n * CAST({PRICE_OF} AS DOUBLE), 4) AS cost FROM f")
def f29(spark, folder):
    flat = frame(spark, folder, "tts_usage").groupBy("provider", "voice_type").agg(F.sum("text_length").alias("n"))
    return flat.select("provider", "voice_type", F.round(F.col("n").cast("double") * U.character_price(F.col("provider"), F.col("voice_type")), 4).alias("cost"))


@query("f31_estimated_costs", cte("ai_usage") + f", p AS (SELECT * FROM {values(PRICES, 'model_id, i, o, ih, oh')}), e AS (SELECT *, CAST(CASE WHEN usage_id % 5 < 2 THEN ceil(prompt_tokens / 2) ELSE completion_tokens END AS BIGINT) AS expected FROM ai_usage) SELECT usage_id, expected, round(prompt_tokens / 1000 * CASE WHEN prompt_tokens <= 128000 THEN i ELSE ih END + expected / 1000 * CASE WHEN expected <= 128000 THEN o ELSE oh END + 0.0000000001, 6) AS cost FROM e JOIN p USING (model_id)")
def f31(spark, folder):
    expected = F.when(F.col("usage_id") % 5 == 0, 0).when(F.col("usage_id") % 5 != 1, F.col("completion_tokens"))
    done = U.estimated_cost(frame(spark, folder, "ai_usage").withColumn("expected_tokens", expected).drop("completion_tokens"))
    return done.select("usage_id", F.col("completion_tokens").alias("expected"), F.round(F.col("cost") + 1e-10, 6).alias("cost"))


@query("f32_token_counts", "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS by_four, CAST(ceil(length(text) / 3.5) AS BIGINT) AS by_three_and_half FROM documents")
def f32(spark, folder):
    n = F.char_length("text")
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.ceil(n / 4).alias("by_four"), F.ceil(n / 3.5).alias("by_three_and_half"))


#: A vocabulary of byte-pair encoding; any file of this kind will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("f32_bpe_counts")
def f32_bpe(spark, folder):
    return bpe.token_counts(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", VOCABULARY)
