"""Research articles: relevance per actor, filters, rankings, feed health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import dates
from ..functions.labels import article_key
from . import BY
from .merge import article_identity
from .mentions import term_hits, text_mentions
from .ordering import keep_first, top_n


def has_article_identity(df: DataFrame) -> DataFrame:
    return df.filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != ""))


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    """A feed without the flag is enabled."""
    return feeds.filter(F.coalesce("enabled", F.lit(True)))


def relevance_score(title_terms: Column, body_hits: Column, apt_focus: Column) -> Column:
    """0-100 from distinct terms in the title and all occurrences in the body."""
    title = F.when(title_terms >= 2, 55).when(title_terms == 1, 40).otherwise(0)
    body = (
        F.when(body_hits >= 5, 35).when(body_hits >= 3, 25).when(body_hits >= 2, 18)
        .when(body_hits >= 1, 10).otherwise(0)
    )
    focus = F.when(F.coalesce(apt_focus, F.lit(False)) & ((title_terms > 0) | (body_hits > 0)), 10).otherwise(0)
    return F.least(title + body + focus, F.lit(100))


def score_articles(
    articles: DataFrame, terms: DataFrame, key: str = "article_id", settings: Settings = DEFAULTS, strategy=None
) -> DataFrame:
    """(key, actor, title_terms, body_hits): one row per article and actor it mentions."""
    body = F.coalesce("summary", F.lit(""))
    if settings.score_chars:
        body = F.left(body, F.lit(settings.score_chars))
    fields = articles.select(
        key,
        F.inline(
            F.array(
                F.struct(F.lit("title").alias("field"), F.coalesce("title", F.lit("")).alias("txt")),
                F.struct(F.lit("body").alias("field"), body.alias("txt")),
            )
        ),
    )
    hits = term_hits(fields, [key, "field"], "txt", terms, strategy=strategy)
    owners = terms.select("actor", F.lower("term").alias("term")).distinct()
    # all hits of one article leave the same task, so they collapse before the shuffle
    return hits.join(owners, "term").groupBy(key, "actor").agg(
        F.count_if(F.col("field") == "title").cast("int").alias("title_terms"),
        F.coalesce(F.sum(F.when(F.col("field") == "body", F.col("n"))), F.lit(0)).cast("int").alias("body_hits"),
    )


#: columns that no ranking needs
TEXTS = ("title", "summary", "content", "body")


def relevant_ids(
    articles: DataFrame, feeds: DataFrame, terms: DataFrame, as_of, settings: Settings = DEFAULTS, key="article_id"
) -> DataFrame:
    """Articles of enabled feeds inside the window that are relevant to an actor, without their texts.

    Adds actor, relevance, source_tier, tags and a hash of the article's identity; not yet capped.
    """
    dims = enabled_feeds(feeds).select(
        F.col("name").alias("source"), F.coalesce("tier", F.lit(3)).alias("source_tier"), "apt_focus", "tags"
    )
    recent = articles.filter(dates.within_lookback(F.col("date"), as_of, settings.lookback_days))
    recent = recent.join(dims, "source")
    scored = score_articles(recent, terms, key, settings)
    # what ranks and identifies an article, not its text, is copied to the actors it concerns
    light = recent.withColumn("identity", F.md5(article_identity())).drop(*TEXTS)
    return (
        scored.join(light.drop(*[x for x in ("actor",) if x in light.columns]), key)
        .withColumn("relevance", relevance_score(F.col("title_terms"), F.col("body_hits"), F.col("apt_focus")))
        .filter(F.col("relevance") >= settings.min_relevance)
    )


def with_texts(ranked: DataFrame, articles: DataFrame, key="article_id") -> DataFrame:
    """Title and body for rows that are already ranked and cut."""
    return ranked.join(articles.select(key, *[x for x in TEXTS if x in articles.columns]), key)


def relevant_articles(
    articles: DataFrame, feeds: DataFrame, terms: DataFrame, as_of, settings: Settings = DEFAULTS, key="article_id"
) -> DataFrame:
    """:func:`relevant_ids` with the texts."""
    return with_texts(relevant_ids(articles, feeds, terms, as_of, settings, key), articles, key)


def top_per_feed(articles: DataFrame, n: int | None = DEFAULTS.articles_per_feed, *, by=BY) -> DataFrame:
    """The n most relevant articles of a feed, ties by position."""
    return top_n(articles, n, [*by, "source"], [F.desc("relevance"), F.asc("pos")])


def unique_articles(articles: DataFrame, *, by=BY) -> DataFrame:
    """First article per url (title where there is no url), feeds in registry order."""
    identity = F.col("identity") if "identity" in articles.columns else article_identity()
    return keep_first(articles, [*by, identity], ["feed_pos", F.negative("relevance"), "pos"])


def article_order(recency: bool = False) -> list[Column]:
    """Relevance first, then the date: oldest first, newest first with ``recency``."""
    return [F.desc("relevance"), F.desc("date") if recency else F.asc("date")]


def with_history(articles: DataFrame, reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Articles plus historical reports, which get a default relevance and rank last."""
    relevance = F.lit(settings.historical_relevance)
    if "relevance" in reports.columns:
        relevance = F.coalesce("relevance", relevance)
    return articles.withColumn("historical", F.lit(False)).unionByName(
        reports.withColumn("relevance", relevance).withColumn("historical", F.lit(True)),
        allowMissingColumns=True,
    )


def historical_reports(reports: DataFrame, terms: DataFrame) -> DataFrame:
    """Reports of the folders whose name holds a name of an actor: (actor, folder, path, title, ...).

    terms: (actor, term) as :func:`~.aliases.search_terms` gives them by the
    ``folder`` rule.  Only folder names are searched; reports join last.
    """
    folders = reports.select("folder").distinct()
    return text_mentions(folders, "folder", "folder", terms).join(reports, "folder")


def evidence_queue(articles: DataFrame, n: int = DEFAULTS.evidence_articles, *, by=BY) -> DataFrame:
    """The n articles worth reading first: relevance, then feed tier."""
    tier = F.coalesce("source_tier", F.lit(3))
    return top_n(articles, n, by, [F.desc("relevance"), tier.asc(), F.asc("pos")])


def article_count(articles: DataFrame, *, by=BY) -> DataFrame:
    return articles.groupBy(*by).agg(F.count("*").alias("article_count"))


def feed_health(feeds: DataFrame, kept: DataFrame, failed: DataFrame | None = None, key="article_id") -> DataFrame:
    """Per feed: kept articles (each once, however many actors it concerns), and one of hits / zero / failed."""
    counts = kept.groupBy(F.col("source").alias("name")).agg(F.count_distinct(key).alias("articles"))
    out = enabled_feeds(feeds).select("name").join(counts, "name", "left")
    out = out.withColumn("articles", F.coalesce("articles", F.lit(0)))
    if failed is not None:
        bad = failed.select("name").distinct().withColumn("_bad", F.lit(True))
        out = out.join(bad, "name", "left")
    else:
        out = out.withColumn("_bad", F.lit(False))
    status = F.when(F.coalesce("_bad", F.lit(False)), "failed").when(F.col("articles") > 0, "hits").otherwise("zero")
    return out.withColumn("status", status).drop("_bad")


def feed_health_totals(health: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return health.agg(
        F.count("*").alias("feeds"), n("hits").alias("hits"), n("zero").alias("zero"), n("failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "hits", F.col("articles"))), F.lit(0)).alias("articles"),
    )


def with_article_key(articles: DataFrame, per_actor: bool = False) -> DataFrame:
    more = [F.col("actor")] if per_actor else []
    return articles.withColumn("article_key", article_key(F.col("url"), F.col("title"), *more))


def reports_per_folder(reports: DataFrame, n: int | None = DEFAULTS.reports_per_folder) -> DataFrame:
    """First n report files of a folder by path."""
    return top_n(reports, n, ["folder"], ["path"])
