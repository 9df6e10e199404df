"""Parsing landed payload texts (JSON, XML, rule files) into rows.

Each ``parse_*`` works on a DataFrame with one payload per row, so it runs the
same over files, tables or a stream; the ``read_*`` functions below only add
the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, labels, text
from ..operators.ordering import latest_by
from . import rulefiles

EMPTY_STRINGS = "array<string>"


def _payloads(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """(path, content) of whole small files."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _text(c) -> Column:
    """Element text, '' when missing."""
    return F.coalesce(text.strip(F.col(c) if isinstance(c, str) else c), F.lit(""))


# --- object graph ------------------------------------------------------------


def parse_graph(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) from one row per raw object with ``bundle`` and ``pos``; last id wins."""
    unique = latest_by(objects, ["id"], ["bundle", "pos"])
    edges = unique.filter("type = 'relationship'").select(
        "bundle", "pos", "id", "relationship_type", "source_ref", "target_ref"
    )
    nodes = unique.filter("type <> 'relationship'").drop("relationship_type", "source_ref", "target_ref")
    return nodes, edges


def read_graph_bundle(spark: SparkSession, path, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bundles with an ``objects`` list, or with ``lines`` one object per line.

    A bundle file is one task's work; land very large graphs as lines.
    """
    if lines:
        raw = spark.read.schema(schemas.GRAPH_OBJECT).json(path)
        # file, then place of the split in it, then row of the split
        split = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
        rows = raw.select(
            F.concat_ws("#", "_metadata.file_path", split).alias("bundle"),
            F.monotonically_increasing_id().alias("pos"),
            *raw.columns,
        )
    else:
        raw = spark.read.schema(schemas.GRAPH_BUNDLE).option("multiLine", True).json(path)
        rows = raw.select(F.col("_metadata.file_path").alias("bundle"), F.posexplode("objects").alias("pos", "o"))
        rows = rows.select("bundle", "pos", "o.*")
    return parse_graph(rows)


# --- vulnerabilities -----------------------------------------------------------


def kev_rows(v: DataFrame) -> DataFrame:
    """CVE rows plus the text that actors are searched in."""
    blank = lambda n: F.coalesce(F.col(n), F.lit(""))
    return v.select(
        *[c for c in v.columns if c not in {
            "cveID", "vendorProject", "product", "vulnerabilityName", "shortDescription", "notes", "dateAdded", "dueDate"
        }],
        blank("cveID").alias("cve_id"), blank("product").alias("product"), blank("vendorProject").alias("vendor"),
        blank("shortDescription").alias("description"), blank("dueDate").alias("due_date"),
        blank("dateAdded").alias("date_added"),
        F.lower(F.concat(blank("notes"), F.lit(" "), blank("vulnerabilityName"))).alias("search_text"),
    )


def read_kev(spark: SparkSession, path) -> DataFrame:
    raw = spark.read.schema(schemas.VULNERABILITIES).option("multiLine", True).json(path)
    return kev_rows(raw.select(F.posexplode("vulnerabilities").alias("pos", "v")).select("pos", "v.*"))


# --- feeds -----------------------------------------------------------------------


def _feed(df: DataFrame) -> DataFrame:
    return df.withColumn("_doc", F.from_xml("content", schemas.FEED_DOCUMENT))


def _items() -> Column:
    inside, beside = F.col("_doc.channel.item"), F.col("_doc.item")
    return F.coalesce(F.concat(inside, beside), inside, beside)


def _either(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(_text(a), F.lit("")), _text(b))


def _link(entry: Column) -> Column:
    """Address of the first link of an Atom entry."""
    return F.coalesce(F.try_element_at(entry["link"], F.lit(1))["_href"], F.lit(""))


def parse_articles(df: DataFrame, keep=("feed",), summary_chars: int | None = None) -> DataFrame:
    """Articles of RSS items followed by Atom entries.

    Unreadable XML gives no rows.  ``summary_chars`` cuts the raw summary
    before the tags go; by default whole bodies are kept.
    """
    cut = (lambda c: F.left(c, F.lit(summary_chars))) if summary_chars else (lambda c: c)
    row = lambda kind, title, url, date, summary: F.struct(
        F.lit(kind).alias("kind"), title.alias("title"), url.alias("url"), date.alias("date"), summary.alias("summary")
    )
    rss = F.transform(
        _items(),
        lambda i: row(
            "rss", _text(i["title"]), _either(i["link"], i["guid"]), _either(i["pubDate"], i["dc:date"]),
            _either(i["content:encoded"], i["description"]),
        ),
    )
    atom = F.transform(
        "_doc.entry",
        lambda e: row(
            "atom", _text(e["title"]), _link(e), _either(e["published"], e["updated"]), _either(e["content"], e["summary"])
        ),
    )
    # one pass over the parsed document for both forms
    entries = F.coalesce(F.concat(rss, atom), rss, atom)
    rows = _feed(df).select(*keep, F.posexplode(entries).alias("item_pos", "a")).select(*keep, "item_pos", "a.*")
    return rows.filter("title <> '' or url <> ''").withColumns(
        {
            "title": text.strip_html(F.col("title")),
            "date": dates.article_date(F.col("date")),
            "summary": text.strip_html(cut(F.col("summary"))),
        }
    )


def read_articles(spark: SparkSession, path, **opts) -> DataFrame:
    files = _payloads(spark, path, "*.xml")
    feed = F.regexp_extract("path", r"([^/]+)\.xml$", 1)
    return parse_articles(files.withColumn("feed", feed), **opts)


def parse_advisories(df: DataFrame, keep=("feed",)) -> DataFrame:
    """Advisories of RSS items; of Atom entries only where there is no item."""
    row = lambda title, url, date, summary, body, tags: F.struct(
        title.alias("title"), url.alias("url"), date.alias("date"), summary.alias("summary"),
        summary.alias("description"), body.alias("body"), tags.alias("tags"),
    )
    rss = F.transform(
        _items(),
        lambda i: row(
            _text(i["title"]), _text(i["link"]), _text(i["pubDate"]), _text(i["description"]), _text(i["description"]),
            _text(F.try_element_at(i["category"], F.lit(1))),
        ),
    )
    atom = F.transform(
        "_doc.entry",
        lambda e: row(_text(e["title"]), _link(e), _text(e["updated"]), _text(e["summary"]), _text(e["content"]), F.lit("")),
    )
    entries = F.when(F.coalesce(F.size(rss), F.lit(0)) > 0, rss).otherwise(atom)
    return _feed(df).select(*keep, F.posexplode(entries).alias("item_pos", "a")).select(*keep, "item_pos", "a.*")


def read_advisory_feed(spark: SparkSession, path) -> DataFrame:
    return parse_advisories(_payloads(spark, path, "*.xml").withColumnRenamed("path", "feed"))


# --- pulses, families, indicator feeds ---------------------------------------------


def read_pulses(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.PULSE).json(path)


def parse_actor_families(df: DataFrame, keep=("actor",)) -> DataFrame:
    """(keep..., pos, slug) from an actor payload whose ``families`` is a map or a list.

    A not-found payload gives no rows.
    """
    raw = df.select(*keep, F.get_json_object("payload", "$.families").alias("_f"))
    first = F.left(F.ltrim("_f"), F.lit(1))
    slugs = F.when(first == "{", F.map_keys(F.from_json("_f", "map<string,string>"))).when(
        first == "[", F.from_json("_f", EMPTY_STRINGS)
    )
    return raw.select(*keep, F.posexplode(slugs).alias("pos", "slug"))


def actor_meta(df: DataFrame, keep=("actor",)) -> DataFrame:
    """Aliases, origin, motivations, sectors and first year of an actor payload."""
    get = lambda p: F.get_json_object("payload", p)
    listed = lambda p: text.string_or_list(_json_value(F.col("payload"), p))
    targets = listed("cfr-target-category")
    return df.filter(get("$.families").isNotNull()).select(
        *keep,
        listed("synonyms").alias("aliases"),
        labels.country_name(F.coalesce(get("$.meta.country"), F.lit(""))).alias("origin"),
        listed("motivation").alias("motivations"),
        F.when(F.size(targets) > 0, targets).otherwise(listed("cfr_target_category")).alias("sectors"),
        F.coalesce(get("$.meta.since"), F.lit("")).alias("first_seen"),
    )


def _json_value(payload: Column, name: str) -> Column:
    """Raw JSON of a field of ``meta`` (strings keep their quotes)."""
    meta = F.from_json(F.get_json_object(payload, "$.meta"), "map<string,variant>")
    return F.to_json(F.try_element_at(meta, F.lit(name)))


def parse_family_feed(df: DataFrame, keep=("family",)) -> DataFrame:
    """Raw indicator rows of a family payload; ``no_results`` and non-lists give none."""
    doc = df.withColumn("_d", F.from_json("payload", schemas.FAMILY_FEED))
    found = doc.filter(F.coalesce("_d.query_status", F.lit("")) != "no_results")
    return found.select(*keep, F.posexplode("_d.data").alias("pos", "d")).select(*keep, "pos", "d.*")


# --- rules -------------------------------------------------------------------------


def parse_rules(df: DataFrame, base_url: str = "") -> DataFrame:
    """Rule rows from (path, content) of rule files; those of :func:`unread_rules` are left out."""
    return _rule_rows(df, base_url).filter("reason is null").drop("reason")


def unread_rules(df: DataFrame) -> DataFrame:
    """(path, reason) of the rule files that give no rule."""
    return _rule_rows(df, "").filter("reason is not null").select("path", "reason")


def _rule_rows(df: DataFrame, base_url: str) -> DataFrame:
    """Rule fields and the reason a file gives no rule; each file is read once, line by line (see ``rulefiles``).

    A table of rule files is small beside the time it takes to read them, so the
    files are dealt out first, however few splits the table has.
    """
    c = F.col
    files = df.select(c("path").cast("string"), c("content").cast("string")).repartition(F.xxhash64("path", "content"))
    rows = files.mapInArrow(rulefiles.read_batches, rulefiles.COLUMNS)
    return rows.select(
        "path",
        "title",
        F.lower("level").alias("level"),
        F.lower("status").alias("status"),
        F.filter(F.transform("tags", F.lower), lambda t: t != "").alias("tags"),
        logsource_text(c("parts")).alias("logsource"),
        text.condition_summary(c("condition")).alias("condition_summary"),
        F.concat(F.lit(base_url), c("path")).alias("url"),
        "reason",
    )


def logsource_text(parts: Column) -> Column:
    """Category, product and service in file order, ``unknown`` when none is given."""
    given = F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != "")
    return F.when(F.size(given) > 0, F.array_join(given, " / ")).otherwise(F.lit("unknown"))


def _relative(files: DataFrame, root: str) -> DataFrame:
    folder = root.rstrip("/").rsplit("/", 1)[-1]
    return files.withColumn("path", F.regexp_replace("path", rf"^.*?/{folder}/", ""))


def read_rules(spark: SparkSession, path: str, base_url: str = "") -> DataFrame:
    return parse_rules(_relative(_payloads(spark, path, "*.yml"), path), base_url)


def read_rule_corpus(spark: SparkSession, path: str, glob: str = "*.{yml,yaml}") -> DataFrame:
    """(path, content) of every rule file, for coverage."""
    return _payloads(spark, path, glob)


# --- report folders ------------------------------------------------------------------


def parse_reports(df: DataFrame, summary_chars: int | None = None) -> DataFrame:
    """(folder, path, title, summary) of markdown reports.

    The title is the first heading in the first five lines, else the file name;
    the summary is the report's text, or its first ``summary_chars`` characters.
    """
    head = F.array_join(F.slice(F.split("content", "\n"), 1, 5), "\n")
    heading = F.regexp_extract(head, r"(?m)^#+(.*)$", 1)
    stem = F.translate(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "_-", "  ")
    return df.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
        "path",
        F.when(head.rlike(r"(?m)^#"), text.strip(heading)).otherwise(stem).alias("title"),
        text.strip(F.left("content", F.lit(summary_chars)) if summary_chars else F.col("content")).alias("summary"),
    )


def read_campaign_reports(spark: SparkSession, path: str) -> DataFrame:
    return parse_reports(_payloads(spark, path, "*.md"))
