"""URL lists that change over time: every capture is judged by the entries active when it was fetched.

Dated entries of a list (added, removed) become validity intervals of their key. The intervals of a key do not
overlap, so the as-of join (equal keys, the fetch inside the interval) finds at most one for each key of a
capture and multiplies nothing; hot hosts are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.llm.shared import written

_URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port and final dot; '' where there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, _URL, 1), r"\.$", ""))


def keys_of(url: Column) -> Column:
    """The list keys that cover a URL, (rank, key): the host and its parent domains, then path prefixes.

    A larger rank is more specific. A domain key is ``d:example.org``, a path key ``p:example.org/a/b``.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda x: x != "")
    n, m = F.size(labels), F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((n - i + 1).alias("rank"), F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")).alias("key")))
    paths = F.transform(parts, lambda x, i: F.struct((i + 1001).alias("rank"), F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")).alias("key")))
    return F.when(host != "", F.concat(domains, F.when(m > 0, paths).otherwise(F.slice(paths, 1, 0))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to, category): when each key is listed; valid_to is null while it still is.

    entries: key, dated, action ('add' or 'remove'), category. On one date a removal comes last. A second
    addition takes the category over. Entries without key or date are left out.
    """
    remove = F.col("action") == "remove"
    changes = entries.where("key is not null and dated is not null").select("key", "dated", F.coalesce(remove, F.lit(False)).alias("remove"), F.coalesce("category", F.lit("")).alias("category"))
    until = F.lead("dated").over(Window.partitionBy("key").orderBy("dated", "remove", "category"))
    out = changes.distinct().withColumn("valid_to", until).where("not remove and not (dated <=> valid_to)")
    return out.select("key", F.col("dated").alias("valid_from"), "valid_to", "category")


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(id, url, fetched, blocked, key, category, since): a row for each capture.

    Of the active entries that cover the URL the most specific is named. A null or hostless URL, a null fetch
    time and an empty list block nothing. Repeated captures each keep a row. Other columns are not read. A URL of
    m path segments asks for m prefixes, whose total length grows as m times the URL's.
    """
    cap = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched"))
    asked = cap.distinct().select("id", "url", "fetched", F.explode(keys_of(F.col("url"))).alias("k")).select("id", "url", "fetched", "k.rank", "k.key")
    listed = written(intervals(entries), "intervals")
    during = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    met = asked.join(listed.withColumnRenamed("key", "listed"), (F.col("key") == F.col("listed")) & during)
    best = met.groupBy("id", "url", "fetched").agg(F.max_by(F.struct("key", "category", F.col("valid_from").alias("since")), "rank").alias("b"))
    b = best.select(*(F.col(c).alias(f"__{c}") for c in ("id", "url", "fetched")), "b")
    both = cap.join(b, F.col("id").eqNullSafe(F.col("__id")) & (F.col("url") == F.col("__url")) & (F.col("fetched") == F.col("__fetched")), "left")
    return both.select("id", "url", "fetched", F.col("b").isNotNull().alias("blocked"), "b.key", "b.category", "b.since")


def example_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of ``pages`` by arithmetic on their names, and two fixed entries.

    It stands for a list that is read: it grows with the hosts and has additions, removals, returns, whole
    domains and paths.
    """
    n = F.length("host") * 31 + F.ascii("host") + F.ascii(F.reverse("host"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("n", n)
    day = lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d)
    row = lambda key, d, action, category: F.struct(key.alias("key"), day(d).alias("dated"), F.lit(action).alias("action"), F.lit(category).alias("category"))
    d, p = F.concat(F.lit("d:"), F.col("host")), F.concat(F.lit("p:"), F.col("host"), F.lit("/en"))
    made = F.concat(
        F.when(F.expr("n % 4 = 0"), F.array(row(d, F.expr("n % 200"), "add", "spam"), row(d, F.expr("n % 200 + 60"), "remove", "spam"))).otherwise(F.array()),
        F.when(F.expr("n % 8 = 0"), F.array(row(d, F.expr("n % 200 + 120"), "add", "malware"))).otherwise(F.array()),
        F.when(F.expr("n % 5 = 0"), F.array(row(p, F.expr("n % 100"), "add", "adult"))).otherwise(F.array()),
    )
    fixed = pages.sparkSession.createDataFrame([("d:spam-farm.example.org", 10, "add", "spam"), ("d:example.net", 100, "add", "test"), ("d:example.net", 130, "remove", "test")], "key string, n int, action string, category string")
    fixed = fixed.select("key", day(F.col("n")).alias("dated"), "action", "category")
    return hosts.select(F.explode(made).alias("e")).select("e.*").unionAll(fixed)


def op8_urls(pages: DataFrame) -> DataFrame:
    """Whole ``pages``, each taken as fetched on a day of 2024 by its id, against the example list."""
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int"))
    return judged(pages.select("page_id", "url", fetched.alias("fetched")), example_list(pages)).withColumnRenamed("id", "page_id")


SQL = rf"""
WITH u AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 365)::INT AS fetched,
    lower(regexp_replace(regexp_extract(url, '{_URL}', 1), '\.$', '')) AS host, list_filter(string_split(regexp_extract(url, '{_URL}', 2), '/'), lambda x: x <> '') AS parts FROM pages),
h AS (SELECT host, length(host) * 31 + ascii(host) + ascii(reverse(host)) AS n FROM (SELECT DISTINCT host FROM u WHERE host <> '')),
e AS (SELECT 'd:' || host AS key, n % 200 AS d, 'add' AS a, 'spam' AS c FROM h WHERE n % 4 = 0 UNION SELECT 'd:' || host, n % 200 + 60, 'remove', 'spam' FROM h WHERE n % 4 = 0
  UNION SELECT 'd:' || host, n % 200 + 120, 'add', 'malware' FROM h WHERE n % 8 = 0 UNION SELECT 'p:' || host || '/en', n % 100, 'add', 'adult' FROM h WHERE n % 5 = 0
  UNION VALUES ('d:spam-farm.example.org', 10, 'add', 'spam'), ('d:example.net', 100, 'add', 'test'), ('d:example.net', 130, 'remove', 'test')),
l AS (SELECT key, DATE '2024-01-01' + d::INT AS dated, a, c FROM e QUALIFY row_number() OVER (PARTITION BY key, d ORDER BY a DESC, c DESC) = 1),
k AS (SELECT page_id, url, fetched, len(labels) - i + 1 AS rank, 'd:' || array_to_string(labels[i:], '.') AS key FROM (SELECT *, string_split(host, '.') AS labels, unnest(generate_series(1, len(string_split(host, '.')))) AS i FROM u WHERE host <> '')
  UNION SELECT page_id, url, fetched, 1000 + i, 'p:' || host || '/' || array_to_string(parts[:i], '/') FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM u WHERE host <> '')),
j AS (SELECT page_id, url, fetched, rank, k.key, c, dated, a FROM k ASOF JOIN l ON k.key = l.key AND k.fetched >= l.dated),
b AS (SELECT * FROM j WHERE a = 'add' QUALIFY row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY rank DESC) = 1)
SELECT u.page_id, u.url, u.fetched, b.key IS NOT NULL AS blocked, b.key, b.c AS category, b.dated AS since FROM u LEFT JOIN b ON b.page_id = u.page_id AND b.url = u.url
"""
