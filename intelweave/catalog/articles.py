"""Article relevance and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import articles as art
from ..sources.tables import with_custom_feeds
from .common import NOW
from .registry import query

c = F.col
USES = ["articles", "feeds", "terms"]

SCORED = """
live AS (SELECT name, coalesce(tier, 3) AS tier, apt_focus, feed_pos FROM feeds WHERE coalesce(enabled, true)),
recent AS (SELECT a.*, f.tier AS source_tier, f.apt_focus, f.feed_pos FROM articles a JOIN live f ON a.source = f.name
  WHERE date IN ('', 'soon') OR TRY_CAST(date AS DATE) >= date '2024-05-01' - 365),
counted AS (SELECT a.article_id, w.actor, count(*) FILTER (WHERE contains(lower(a.title), w.term)) AS tt,
     sum((length(lower(a.summary)) - length(replace(lower(a.summary), w.term, ''))) // length(w.term)) AS bh
  FROM recent a JOIN terms w ON contains(lower(a.summary), w.term) OR contains(lower(a.title), w.term) GROUP BY a.article_id, w.actor),
scored AS (SELECT a.*, c.actor, c.tt, c.bh, least(100, CASE WHEN tt >= 2 THEN 55 WHEN tt = 1 THEN 40 ELSE 0 END
     + CASE WHEN bh >= 5 THEN 35 WHEN bh >= 3 THEN 25 WHEN bh >= 2 THEN 18 WHEN bh >= 1 THEN 10 ELSE 0 END
     + CASE WHEN coalesce(apt_focus, false) THEN 10 ELSE 0 END) AS relevance FROM recent a JOIN counted c USING (article_id)),
relevant AS (SELECT * FROM scored WHERE relevance >= 15)"""


def relevant_ids(t):
    """Article and actor with what ranks them; no texts."""
    rows = art.relevant_ids(t.articles, t.feeds, t.terms, NOW)
    return rows.join(t.feeds.select(c("name").alias("source"), "feed_pos"), "source")


def relevant(t):
    return art.with_texts(relevant_ids(t), t.articles)


@query(
    "score_articles",
    f", {SCORED} SELECT article_id, actor, CAST(tt AS INT) AS title_terms, CAST(bh AS INT) AS body_hits FROM counted",
    uses=USES,
)
def _(t):
    feeds = art.enabled_feeds(t.feeds).select(c("name").alias("source"))
    from ..functions.dates import within_lookback

    recent = t.articles.filter(within_lookback(c("date"), NOW, 365)).join(feeds, "source")
    return art.score_articles(recent, t.terms)


@query(
    "relevant_articles",
    f", {SCORED} SELECT article_id, actor, CAST(relevance AS INT) AS relevance, source_tier FROM relevant",
    uses=USES,
)
def _(t):
    return art.relevant_articles(t.articles, t.feeds, t.terms, NOW).select("article_id", "actor", "relevance", "source_tier")


@query(
    "top_per_feed",
    f", {SCORED} SELECT actor, source, article_id FROM relevant QUALIFY row_number() OVER (PARTITION BY actor, source ORDER BY relevance DESC, pos) <= 8",
    uses=USES,
)
def _(t):
    return art.top_per_feed(relevant_ids(t), 8).select("actor", "source", "article_id")


@query(
    "unique_articles",
    f""", {SCORED} SELECT actor, article_id FROM relevant QUALIFY row_number() OVER (PARTITION BY actor, coalesce(nullif(url, ''), title) ORDER BY feed_pos, relevance DESC, pos) = 1""",
    uses=USES,
)
def _(t):
    # a pick carries whole rows through a sort, so only what it decides by and returns goes in
    rows = relevant_ids(t).select("actor", "article_id", "identity", "feed_pos", "relevance", "pos")
    return art.unique_articles(rows).select("actor", "article_id")


@query(
    "article_order",
    f""", {SCORED} SELECT actor, article_id, row_number() OVER (PARTITION BY actor ORDER BY relevance DESC, date, article_id) AS place FROM relevant""",
    uses=USES,
)
def _(t):
    from ..operators.ordering import top_n

    return top_n(relevant_ids(t), None, ["actor"], [*art.article_order(), c("article_id")], rank="place").select(
        "actor", "article_id", "place"
    )


@query(
    "evidence_queue",
    f""", {SCORED} SELECT actor, article_id FROM relevant QUALIFY row_number() OVER (PARTITION BY actor ORDER BY relevance DESC, source_tier, pos) <= 15""",
    uses=USES,
)
def _(t):
    return art.evidence_queue(relevant_ids(t)).select("actor", "article_id")


@query(
    "article_count",
    f", {SCORED} SELECT actor, count(*) AS article_count FROM relevant GROUP BY actor",
    uses=USES,
)
def _(t):
    return art.article_count(relevant_ids(t))


@query(
    "with_history",
    f""", {SCORED} SELECT actor, historical, relevance, count(*) AS n FROM (
         SELECT actor, false AS historical, CAST(relevance AS INT) AS relevance FROM relevant
         UNION ALL SELECT lang, true, 50 FROM documents) x GROUP BY ALL""",
    uses=USES,
)
def _(t):
    reports = t.documents.select(c("lang").alias("actor"), c("text").alias("summary"))
    rows = art.with_history(relevant_ids(t).select("actor", "relevance"), reports.drop("summary"))
    return rows.groupBy("actor", "historical", "relevance").agg(F.count("*").alias("n"))


@query(
    "feed_health",
    f""", {SCORED}, kept AS (SELECT source, count(DISTINCT article_id) AS n FROM relevant GROUP BY source)
    SELECT l.name, coalesce(k.n, 0) AS articles, CASE WHEN l.name LIKE '%7' THEN 'failed' WHEN coalesce(k.n, 0) > 0 THEN 'hits' ELSE 'zero' END AS status FROM live l LEFT JOIN kept k ON l.name = k.source""",
    uses=USES,
)
def _(t):
    return art.feed_health(t.feeds, relevant_ids(t), t.feeds.filter("name like '%7'"))


@query(
    "feed_health_totals",
    f""", {SCORED}, kept AS (SELECT source, count(DISTINCT article_id) AS n FROM relevant GROUP BY source),
    h AS (SELECT l.name, coalesce(k.n, 0) AS articles, CASE WHEN l.name LIKE '%7' THEN 'failed' WHEN coalesce(k.n, 0) > 0 THEN 'hits' ELSE 'zero' END AS status FROM live l LEFT JOIN kept k ON l.name = k.source)
    SELECT count(*) AS feeds, count(*) FILTER (WHERE status = 'hits') AS hits, count(*) FILTER (WHERE status = 'zero') AS zero, count(*) FILTER (WHERE status = 'failed') AS failed,
       CAST(coalesce(sum(articles) FILTER (WHERE status = 'hits'), 0) AS BIGINT) AS articles FROM h""",
    uses=USES,
)
def _(t):
    return art.feed_health_totals(art.feed_health(t.feeds, relevant_ids(t), t.feeds.filter("name like '%7'")))


@query(
    "enabled_feeds",
    "SELECT name FROM feeds WHERE coalesce(enabled, true)",
    uses=["feeds"],
)
def _(t):
    return art.enabled_feeds(t.feeds).select("name")


@query(
    "custom_feeds",
    "SELECT name, 0 AS origin FROM feeds UNION ALL SELECT s_name, 1 FROM supplier",
    uses=["feeds"],
)
def _(t):
    own = t.supplier.select(c("s_name").alias("name"))
    return with_custom_feeds(t.feeds, own).select("name", "origin")
