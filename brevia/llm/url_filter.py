"""URL filters as a temporal list join.

A list is a table of dated events (key, day, action, verdict, category): at day a key is added to or
removed from the list. A key is a domain (example.com, with all its subdomains) or a host and path
prefix (www.example.com/ads). The events of a key become validity intervals: an addition holds from
its day to the next event of that key and category. Of events of one day the removal counts.

A capture is judged by the entries active on the day it was fetched: every domain above its host and
every path prefix of its URL is looked up as of that day. The longest active key decides, allow before
block, then the category's name; without one the verdict is none.

Captures ask only for keys as deep as the list has some. Equal captures are counted first and given back
after; the lookups of one capture stay in its partition, so a hot host costs no shuffle. The intervals are
broadcast up to MAX_BROADCAST rows, and beyond that joined over keys that are salted by how often they are asked
for: none brings more than about KEY_ROWS rows to a task.

Null or unparsable URLs and null days match nothing. Hosts are compared in lower case. An empty list or
table is fine. Extra columns are left out. Paths of URLs and of keys keep their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.llm.shared import cut, tables

MAX_BROADCAST = 200_000
MAX_DEPTHS = 64
KEY_ROWS = 100_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
FOREVER = "9999-12-31"

#: The list of op4: (key, day, action, verdict, category).
EVENTS = (
    ("cheap-pills.example.com", "2024-01-01", "add", "block", "spam"),
    ("cheap-pills.example.com", "2024-07-01", "remove", "block", "spam"),
    ("cheap-pills.example.com", "2024-09-15", "add", "block", "spam"),
    ("casino-win.example.com", "2024-03-01", "add", "block", "gambling"),
    ("free-bets.example.com", "2024-02-10", "add", "block", "gambling"),
    ("free-bets.example.com", "2024-11-01", "remove", "block", "gambling"),
    ("m.free-bets.example.com", "2024-05-01", "add", "allow", "reviewed"),
    ("ads-track.example.com", "2023-06-01", "add", "block", "tracking"),
    ("ads-track.example.com", "2024-04-01", "remove", "block", "tracking"),
    ("ads-track.example.com", "2024-04-01", "add", "block", "tracking"),
    ("ads-track.example.com", "2024-08-01", "add", "block", "tracking"),
    ("tionsh.example.net", "2024-06-01", "add", "block", "copyright"),
    ("blog.tionsh.example.net/en", "2024-06-15", "add", "allow", "reviewed"),
    ("tionsh.example.net/de", "2024-01-01", "add", "block", "adult"),
    ("example.org", "2024-10-01", "add", "block", "outage"),
    ("example.org", "2024-10-20", "remove", "block", "outage"),
    ("thther.example.org", "2024-10-05", "add", "allow", "reviewed"),
)
EVENT_SCHEMA = "key string, day string, action string, verdict string, category string"


def intervals(events: DataFrame) -> DataFrame:
    """(key, verdict, category, since, until): days on which an entry is active, until excluded."""
    host = F.substring_index("key", "/", 1)
    dated = events.select(F.concat(F.lower(host), F.substring("key", F.length(host) + 1, F.length("key"))).alias("key"), F.col("day").cast("date").alias("since"), "action", "verdict", "category").filter("key is not null and since is not null")
    last = dated.groupBy("key", "category", "since").agg(F.max("action").alias("action"), F.min("verdict").alias("verdict"))  # remove comes after add
    following = F.lead("since").over(Window.partitionBy("key", "category").orderBy("since"))
    spans = last.withColumn("until", F.coalesce(following, F.lit(FOREVER).cast("date")))
    return spans.filter("action = 'add'").select("key", "verdict", "category", "since", "until")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def keys_of(url: Column, labels: list[int], segments: list[int]) -> Column:
    """All keys that may concern a URL: domains of so many labels, prefixes of so many segments."""
    host = host_of(url)
    parts = F.split(host, r"\.")
    path = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    counts = lambda some, most: F.filter(F.array(*map(F.lit, some)).cast("array<int>"), lambda k: k <= most)
    names = F.transform(counts(labels, F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(counts(segments, F.size(path)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, k), "/")))
    return F.when(host != "", F.concat(names, prefixes)).otherwise(F.array().cast("array<string>"))


def _depths(active: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of labels of the list's domains, and of segments of its prefixes. A host has 127 labels at most; more
    than MAX_DEPTHS different numbers of segments are taken as all up to the largest."""
    prefix = F.col("key").contains("/")
    found = active.groupBy(prefix.alias("prefix"), F.when(prefix, F.size(F.split("key", "/")) - 1).otherwise(F.size(F.split("key", r"\."))).alias("n")).count()
    many = found.groupBy("prefix").agg(F.collect_set("n").alias("n"), F.max("n").alias("most"))
    rows = {r.prefix: sorted(r.n) if len(r.n) <= MAX_DEPTHS else list(range(1, r.most + 1)) for r in many.collect()}
    return rows.get(False, []), rows.get(True, [])


def judge(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(key, url, fetched, host, verdict, category, matched, n_active) of every capture."""
    active = cut(intervals(events))
    n = active.count()
    who = ["id", "u", "day"]
    equal = captures.select(F.col(key).alias("id"), F.col(url).alias("u"), F.col(fetched).cast("date").alias("day")).groupBy(*who).agg(F.count(F.lit(1)).alias("copies"))
    asked = equal.withColumn("key", F.explode_outer(keys_of(F.col("u"), *_depths(active))))
    found = _as_of(asked, F.broadcast(active)) if n <= MAX_BROADCAST else _large_list(asked, active)
    entry = F.when(F.col("since").isNotNull(), F.struct((-F.length("key")).alias("n"), F.col("verdict"), F.col("category"), F.col("key").alias("matched")))
    judged = found.groupBy(*who, "copies").agg(F.min(entry).alias("best"), F.count("since").alias("n_active"))
    rows = judged.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(
        F.col("id").alias(key), F.col("u").alias(url), F.col("day").alias(fetched), host_of(F.col("u")).alias("host"),
        F.coalesce(F.col("best.verdict"), F.lit("none")).alias("verdict"), F.col("best.category").alias("category"), F.col("best.matched").alias("matched"), "n_active",
    )


def _as_of(asked: DataFrame, active: DataFrame) -> DataFrame:
    """asked with the entries active on each capture's day."""
    entries = active.withColumnRenamed("key", "__key")
    return asked.join(entries, (F.col("key") == F.col("__key")) & (F.col("day") >= F.col("since")) & (F.col("day") < F.col("until")), "left").drop("__key")


def _large_list(asked: DataFrame, active: DataFrame) -> DataFrame:
    """_as_of() without a broadcast of the list. Only keys that the list has are shuffled; those that many captures ask for
    are dealt over as many salts as they take, counted beforehand, and their entries repeated for each."""
    asked = cut(asked)
    listed = active.select("key").distinct()
    counts = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(listed, "key", "left_semi")
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / KEY_ROWS)).cast("int")
    hot = cut(counts.filter(F.col("n") > KEY_ROWS).select("key", salts.alias("salts")))
    small = hot.count() <= MAX_BROADCAST  # there is at most one such key for KEY_ROWS rows
    marked = lambda df: df.join(F.broadcast(hot) if small else hot, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salted = marked(asked).withColumn("salt", F.pmod(F.xxhash64("id", "u", "day"), F.col("salts")).cast("int")).drop("salts")
    entries = marked(active).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumnsRenamed({"key": "__key", "salt": "__salt"})
    on = (F.col("key") == F.col("__key")) & (F.col("salt") == F.col("__salt")) & (F.col("day") >= F.col("since")) & (F.col("day") < F.col("until"))
    return salted.join(entries, on, "left").drop("__key", "__salt", "salt")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """pages hold no fetch day: it is taken as a day of 2024 that depends on page_id."""
    pages = tables(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 366) as int))").alias("fetched"))
    return judge(pages, spark.createDataFrame(EVENTS, EVENT_SCHEMA))


def oracle() -> str:
    values = ", ".join(f"({', '.join(repr(x) for x in event)})" for event in EVENTS)
    return rf"""WITH events(key, day, action, verdict, category) AS (VALUES {values}),
    last AS (SELECT key, category, day::DATE AS since, max(action) AS action, min(verdict) AS verdict FROM events GROUP BY ALL),
    spans AS (SELECT * FROM (SELECT *, coalesce(lead(since) OVER (PARTITION BY key, category ORDER BY since), DATE '{FOREVER}') AS until FROM last) WHERE action = 'add'),
    captures AS (SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INTEGER AS fetched,
        lower(regexp_extract(url, '{HOST}', 1)) AS host, list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') AS path FROM pages),
    found AS (SELECT c.page_id, c.url, c.fetched, s.key, s.verdict, s.category FROM captures c JOIN spans s ON c.fetched >= s.since AND c.fetched < s.until
        AND CASE WHEN contains(s.key, '/') THEN starts_with(host || '/' || array_to_string(path, '/') || '/', s.key || '/')
            ELSE host = s.key OR ends_with(host, '.' || s.key) END),
    best AS (SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY length(key) DESC, verdict, category) AS place,
        count(*) OVER (PARTITION BY page_id, url, fetched) AS n_active FROM found)
    SELECT c.page_id, c.url, c.fetched, c.host, coalesce(b.verdict, 'none') AS verdict, b.category, b.key AS matched, coalesce(b.n_active, 0) AS n_active
    FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND c.url = b.url AND c.fetched = b.fetched AND b.place = 1"""
