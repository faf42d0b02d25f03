"""Fixed dimensions: crawlers, the crawler that gates each engine, and what each metric means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (user agent, operator, tier, respects robots.txt, engine it feeds)
CRAWLERS = (
    ("OAI-SearchBot", "OpenAI", "search", True, "chatgpt_search"),
    ("ChatGPT-User", "OpenAI", "user", True, "chatgpt_search"),
    ("GPTBot", "OpenAI", "training", True, None),
    ("Claude-SearchBot", "Anthropic", "search", True, "claude_search"),
    ("Claude-User", "Anthropic", "user", True, "claude_search"),
    ("ClaudeBot", "Anthropic", "training", True, None),
    ("PerplexityBot", "Perplexity", "search", True, "perplexity"),
    ("Perplexity-User", "Perplexity", "user", False, "perplexity"),
    ("Googlebot", "Google", "search", True, "google"),
    ("Google-Extended", "Google", "training", True, None),
    ("Bingbot", "Microsoft", "search", True, None),
    ("YandexBot", "Yandex", "search", True, "yandex_neuro"),
    ("Applebot-Extended", "Apple", "training", True, None),
    ("CCBot", "Common Crawl", "training", True, None),
    ("Amazonbot", "Amazon", "training", True, None),
    ("Meta-ExternalAgent", "Meta", "training", True, None),
    ("Bytespider", "ByteDance", "training", False, None),
    ("DuckAssistBot", "DuckDuckGo", "user", True, None),
    ("MistralAI-User", "Mistral", "user", True, None),
)
# Engine and the search crawler whose access decides
GATING = (
    ("google", "Googlebot"),
    ("gemini", "Googlebot"),
    ("chatgpt_search", "OAI-SearchBot"),
    ("claude_search", "Claude-SearchBot"),
    ("yandex_neuro", "YandexBot"),
    ("perplexity", "PerplexityBot"),
)
DEFAULT_GATE = "Googlebot"
# Fixed values: (metric, is a ratio, higher is better, change below which it is flat)
METRIC_DEFS = (
    ("overview_coverage", True, True, 0.005),
    ("visibility_in_sources", True, True, 0.005),
    ("visibility_in_citations", True, True, 0.005),
    ("relative_citation", True, True, 0.005),
    ("brand_mention_rate", True, True, 0.005),
    ("avg_source_position", False, False, 0.05),
    ("avg_citation_position", False, False, 0.05),
)


def bot_registry(spark: SparkSession, tier: str | None = None) -> DataFrame:
    """The crawlers, of one tier if asked; a lookup by name is a plain ``where``."""
    rows = spark.createDataFrame(
        [(i, *bot) for i, bot in enumerate(CRAWLERS)],
        "bot_no INT, ua STRING, operator STRING, tier STRING, respects_robots BOOLEAN, engine STRING",
    )
    return rows if tier is None else rows.where(F.col("tier") == tier)


def bot_array() -> Column:
    """The crawlers as one literal array, for work inside the row."""
    rows = ", ".join(
        f"named_struct('ua', '{ua}', 'operator', '{operator}', 'tier', '{tier}')"
        for ua, operator, tier, _, _ in CRAWLERS
    )
    return F.expr(f"array({rows})")


def engine_gating(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GATING), "engine STRING, gating_ua STRING")


def gating_ua(engine: Column) -> Column:
    """Crawler that decides for an engine; no engine means the default, an unmapped one NULL."""
    known = F.coalesce(*[F.when(engine == name, F.lit(ua)) for name, ua in GATING])
    return F.when(engine.isNull(), F.lit(DEFAULT_GATE)).otherwise(known)


def metric_polarity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(METRIC_DEFS), "metric STRING, is_ratio BOOLEAN, higher_is_better BOOLEAN, flat_below DOUBLE"
    )


def metric_defs_array() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"), F.lit(is_ratio).alias("is_ratio"),
                F.lit(higher).alias("higher_is_better"), F.lit(flat).alias("flat_below"),
            )
            for name, is_ratio, higher, flat in METRIC_DEFS
        ]
    )
