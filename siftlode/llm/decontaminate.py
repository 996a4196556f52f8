"""Benchmark decontamination by templates, with built-in expressions only.

Numbers, names and units become typed placeholders. Windows of eight template tokens are hashed by doubling
(pairs, pairs of pairs, ...), and the documents' windows meet the benchmark's in a hash join, so only rows
that match leave a scan. Matches on one diagonal of a document and an item are one occurrence: there every
filler of the item must stand for one filler of the document. What passes counts towards the share of the
item's windows that the document has, so an item with other numbers or names is found like a verbatim one.

An item without any such window has no template to tell it from chance: too few words, or placeholders nearly
throughout. It is found by its literal words: in windows of eight, or, of four to seven words, as a whole. Items of
fewer words are no evidence in any document and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import unused, written

#: Template tokens of a window; a power of two.
WINDOW = 8
#: Words of the literal windows of short items; a power of two.
SHORT = 4
#: Share of an item's windows that a document must have.
COVERAGE = 0.3
#: Benchmark windows up to which the benchmark is broadcast (about 100 MB); more are joined by a shuffle.
MAX_BROADCAST = 500_000
#: Units that follow numbers (a parameter of the templates, lower case).
UNITS = tuple(
    "% ° am bytes cent cents cm cm2 cm3 days day degrees dollars euros eur feet foot ft g gallons gb grams h hour hours hz inches j kb kg khz kilograms kilometers km km/h "
    "kmh kw l lb lbs liters litres m m/s m2 m3 mb meters metres mg mhz mi miles min minutes mm ml months mph n oz pa percent pm pounds s seconds sec tons usd v w weeks yards years year".split()
)
_SEP = r"[\x20\x09-\x0D]"
#: Ends of sentences and lines become a mark on the next word, whose capital then names nothing.
_STARTS = rf"[.!?:…]*{_SEP}*\n{_SEP}*|[.!?:…]+(?:{_SEP}+|$)"
_DROPPED = ",;\"()[]{}«»“”„"
_NUMBER = r"^\x01?[-+$€£#]*[0-9]"
_NAME = r"^\p{Lu}"


def raw_tokens(text: Column) -> Column:
    """The words of a text, first words of sentences and lines behind a mark, without outer punctuation."""
    t = F.concat(F.lit("\x01"), F.coalesce(text, F.lit("")))
    t = F.translate(F.regexp_replace(t, _STARTS, " \x01"), _DROPPED, "")
    return F.filter(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), lambda x: ~x.isin("", "\x01"))


def kind(x: Column, before: Column) -> Column:
    """The placeholder of a word after another, null for a literal. Words in a-z are tested for units only."""
    unit = F.lower(x).isin(*UNITS) & F.coalesce(before.rlike(_NUMBER), F.lit(False))
    plain = (x >= "a") & (x < "{")
    return F.when(unit, F.lit("<unit>")).when(plain, F.lit(None).cast("string")).when(x.rlike(_NAME), F.lit("<name>")).when(x.rlike(_NUMBER), F.lit("<number>"))


def literal(x: Column) -> Column:
    return F.lower(F.when(x.startswith("\x01"), F.substr(x, F.lit(2))).otherwise(x))


def with_windows(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with __w (raw words) and __h (window hashes).

    The last WINDOW - 1 hashes cover fewer words and equal no whole window's.
    """
    df = df.withColumn("__w", raw_tokens(F.col(text_col).cast("string")))
    df = df.withColumn("__h", F.transform("__w", lambda x, i: F.xxhash64(F.coalesce(kind(x, F.get(F.col("__w"), i - 1)), literal(x)))))
    step = 1
    while step < WINDOW:
        df = df.withColumn("__h", F.zip_with("__h", F.slice("__h", step + 1, F.greatest(F.size("__h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    return df


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, ipos, h, n, fill): the windows of each item, at least half of literals; n counts them.

    fill holds the item's own words at placeholders and null at literals. Items of fewer than WINDOW words have
    no window, nor have items with placeholders nearly throughout: ``literal_windows`` are for them.
    """
    b = with_windows(benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("__t")), "__t")
    b = b.withColumn("__f", F.transform("__w", lambda x, i: F.concat(kind(x, F.get(F.col("__w"), i - 1)), literal(x))))
    whole = F.slice("__h", F.lit(1), F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0)))
    b = b.select("item", "__f", F.posexplode_outer(whole).alias("ipos", "h")).where("h is not null").withColumn("fill", F.slice("__f", F.col("ipos") + 1, F.lit(WINDOW))).drop("__f")
    b = b.where(F.size(F.filter("fill", lambda x: x.isNotNull())) <= WINDOW // 2)
    n = b.groupBy("item").agg(F.count("*").alias("n"))
    return b.join(n, "item")


def with_literals(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with l1, l4 and l8: hashes of each word as a literal and of the SHORT and WINDOW words from each place.

    Hashes near the end cover fewer words and equal no whole window's.
    """
    df = df.withColumn("l1", F.transform(raw_tokens(F.col(text_col).cast("string")), lambda x: F.xxhash64(F.lit("literal"), literal(x))))
    last, step = "l1", 1
    while step < WINDOW:
        name = {SHORT // 2: "l4", WINDOW // 2: "l8"}.get(step, f"l{step}_")
        df = df.withColumn(name, F.zip_with(last, F.slice(last, step + 1, F.greatest(F.size(last), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        last, step = name, step * 2
    return df


def literal_windows(benchmark: DataFrame, templates: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, kind, ipos, h, n): the literal windows of items that have none in ``templates``.

    kind 'part': windows of WINDOW words; 'whole': of SHORT words, all of which a document must have in a row. n counts an
    item's windows. Items of fewer than SHORT words have none.
    """
    own = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("t")).join(templates.select("item").distinct(), "item", "left_anti")
    b = with_literals(own, "t").withColumn("size", F.size("l1")).where(F.col("size") >= SHORT)
    kind = F.when(F.col("size") >= WINDOW, "part").otherwise("whole")
    whole = lambda c, n: F.slice(c, F.lit(1), F.col("size") - (n - 1))
    h = F.when(kind == "part", F.slice("l8", F.lit(1), F.greatest(F.col("size") - (WINDOW - 1), F.lit(0)))).otherwise(whole("l4", SHORT))
    return b.select("item", kind.alias("kind"), F.size(h).alias("n"), F.posexplode(h).alias("ipos", "h"))


def literal_hits(src: DataFrame, windows: DataFrame, small: bool, coverage: float) -> DataFrame:
    """(key, item, n, n_hits): the items of ``literal_windows`` that rows (key, __t) have."""
    d = with_literals(src, "__t")
    of = lambda kind, c: F.transform(c, lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("dpos"), h.alias("h")))
    d = d.select("key", F.explode(F.concat(of("part", "l8"), of("whole", "l4"))).alias("x")).select("key", "x.*")
    met = d.join(F.broadcast(windows) if small else windows, ["kind", "h"]).select("key", "item", "kind", "n", "ipos", (F.col("dpos") - F.col("ipos")).alias("diagonal"))
    lines = met.distinct().groupBy("key", "item", "kind", "n", F.when(F.col("kind") != "part", F.col("diagonal")).alias("diagonal")).agg(F.count_distinct("ipos").alias("n_hits"))
    enough = F.col("n_hits") >= F.when(F.col("kind") == "part", coverage * F.col("n")).otherwise(F.col("n"))
    return lines.where(enough).groupBy("key", "item", "n").agg(F.max("n_hits").alias("n_hits"))


def row_key(id_col: str, text_col: str) -> Column:
    """Rows equal in id and text share a key and a verdict."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.col(text_col).cast("string"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(key, item, n_hits, coverage): the items that each row of docs has, by ``row_key``."""
    b = benchmark_windows(benchmark)
    small = b.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    src = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("__t"))
    # the outer form: for the inner one the optimizer infers a filter on the array and evaluates it again below
    d = with_windows(src, "__t").select("key", F.posexplode_outer("__h").alias("dpos", "h"))
    b = b.withColumn("slots", F.exists("fill", lambda x: x.isNotNull()))
    met = d.join(F.broadcast(b) if small else b, "h")
    met = written(met.select("key", "item", "n", "ipos", "dpos", (F.col("dpos") - F.col("ipos")).alias("diagonal"), F.when(F.col("slots"), F.col("fill")).alias("fill")), "matches")
    # only rows with placeholders in a match are read again for what fills them
    slotted = met.where("fill is not null")
    words = src.join(slotted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", raw_tokens(F.col("__t").cast("string")).alias("__w"))
    pair = F.zip_with("fill", F.slice("__w", F.col("dpos") + 1, F.lit(WINDOW)), lambda a, x: F.struct(a.alias("a"), literal(x).alias("b")))
    fillers = slotted.join(words, "key").select("key", "item", "diagonal", F.explode(F.filter(pair, lambda p: p["a"].isNotNull())).alias("p"))
    loose = fillers.groupBy("key", "item", "diagonal", "p.a").agg(F.min("p.b").alias("lo"), F.max("p.b").alias("hi")).where("lo <> hi")
    one = met.join(loose.select("key", "item", "diagonal").distinct(), ["key", "item", "diagonal"], "left_anti")
    hit = one.select("key", "item", "n", "ipos").distinct().groupBy("key", "item", "n").agg(F.count("*").alias("n_hits"))
    hit = hit.where(F.col("n_hits") >= coverage * F.col("n"))
    rest = written(literal_windows(benchmark, b), "literals")
    number = rest.limit(MAX_BROADCAST + 1).count()
    if number:  # most benchmarks have no such item, and then the texts are not read again
        hit = hit.unionByName(literal_hits(src, rest, number <= MAX_BROADCAST, coverage))
    return hit.select("key", "item", "n_hits", F.round(F.col("n_hits") / F.col("n"), 6).alias("coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The columns of ``docs`` and ``contaminated``, ``item_ids``, ``coverage`` (replacing columns of these names).

    One row for each row. A null or empty text, or an empty benchmark, leaves a row clean, with no items and
    coverage 0. Rows with one id are judged by their own texts. A very long text is one array of words in its
    task. Of an item with a template window (WINDOW words, at most half of them placeholders) the share of those windows
    counts; other items are found by their literal words alone, so not with other fillers.
    """
    found = leaks(docs, benchmark, id_col, text_col, coverage).groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("__i"), F.max("coverage").alias("__c"))
    rest = [c for c in docs.columns if c.lower() not in ("contaminated", "item_ids", "coverage")]
    key, items, most = unused(docs, "key", "items", "most")
    found = found.select(F.col("key").alias(key), F.col("__i").alias(items), F.col("__c").alias(most))
    both = docs.select(*rest, row_key(id_col, text_col).alias(key)).join(found, key, "left")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return both.select(
        *rest, F.col(items).isNotNull().alias("contaminated"), F.coalesce(items, F.array().cast(f"array<{kind}>")).alias("item_ids"), F.coalesce(most, F.lit(0.0)).alias("coverage")
    )


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """(doc_id, contaminated, item_ids, coverage) for whole ``documents`` against ``benchmark``."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs.select("doc_id", "text"), bench).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item, with their own columns."""
    (key,) = unused(docs, "key")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key("doc_id", "text")).join(found, key, "left_anti").select(*docs.columns)


def _tokens_sql(table: str, id_col: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    t = f"regexp_replace(chr(1) || coalesce(text, ''), '[.!?:…]*[\\x20\\x09-\\x0D]*\\n[\\x20\\x09-\\x0D]*|[.!?:…]+(?:[\\x20\\x09-\\x0D]+|$)', ' ' || chr(1), 'g')"
    return f"""
SELECT id, p, CASE WHEN u AND coalesce(regexp_matches(lag(x) OVER (PARTITION BY id ORDER BY p), '^\\x01?[-+$€£#]*[0-9]'), false) THEN '<unit>'
    WHEN regexp_matches(x, '^\\p{{Lu}}') THEN '<name>' WHEN regexp_matches(x, '^\\x01?[-+$€£#]*[0-9]') THEN '<number>' END AS k, lower(replace(x, chr(1), '')) AS l
FROM (SELECT id, p, x, lower(x) IN ({units}) AS u FROM (SELECT id, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM (
  SELECT {id_col} AS id, list_filter(regexp_extract_all(translate({t}, '{_DROPPED}', ''), '[^\\x20\\x09-\\x0D]+'), lambda y: y <> chr(1)) AS w FROM {table})))
"""


SQL = f"""
WITH bt AS ({_tokens_sql("benchmark", "item_id")}), dt AS ({_tokens_sql("documents", "doc_id")}),
bw AS (SELECT id AS item, p, list(coalesce(k, l)) OVER w AS g, list(CASE WHEN k IS NOT NULL THEN k || l END) OVER w AS f FROM bt
       WINDOW w AS (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
b AS (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM bw WHERE len(g) = {WINDOW} AND len(list_filter(f, lambda y: y IS NOT NULL)) <= {WINDOW // 2}),
d AS (SELECT id, p, list(coalesce(k, l)) OVER w AS g, list(l) OVER w AS r FROM dt
      WINDOW w AS (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
m AS (SELECT d.id, item, n, b.p AS ip, d.p - b.p AS diagonal, f, r FROM d JOIN b ON d.g = b.g),
s AS (SELECT id, item, diagonal, a, count(DISTINCT v) AS c FROM (SELECT id, item, diagonal, unnest(f) AS a, unnest(r) AS v FROM m) WHERE a IS NOT NULL GROUP BY ALL HAVING c > 1),
h AS (SELECT id, item, n, count(DISTINCT ip) AS hits FROM m ANTI JOIN s USING (id, item, diagonal) GROUP BY ALL),
bl AS (SELECT id AS item, list(l ORDER BY p) AS ls FROM bt WHERE id NOT IN (SELECT item FROM b) GROUP BY id),
dl AS (SELECT id, list(l ORDER BY p) AS ls FROM dt GROUP BY id),
k AS (SELECT item, CASE WHEN len(ls) >= {WINDOW} THEN {WINDOW} ELSE {SHORT} END AS size, ls FROM bl WHERE len(ls) >= {SHORT}),
kw AS (SELECT item, size, p AS ip, ls[p:p + size - 1] AS g, len(ls) - size + 1 AS n FROM (SELECT *, unnest(range(1, len(ls) - size + 2)) AS p FROM k)),
kd AS (SELECT id, size, p AS dp, ls[p:p + size - 1] AS g FROM (SELECT id, size, ls, unnest(range(1, len(ls) - size + 2)) AS p FROM dl, (SELECT DISTINCT size FROM k))),
km AS (SELECT DISTINCT id, item, kw.size, n, ip, CASE WHEN kw.size = {SHORT} THEN dp - ip END AS diagonal FROM kd JOIN kw ON kd.size = kw.size AND kd.g = kw.g),
kh AS (SELECT id, item, any_value(n) AS n, count(DISTINCT ip) AS hits FROM km GROUP BY id, item, size, diagonal HAVING hits >= CASE WHEN size = {SHORT} THEN any_value(n) ELSE {COVERAGE} * any_value(n) END),
q AS (SELECT id, list_sort(list(DISTINCT item)) AS items, max(round(hits / n, 6)) AS c FROM (SELECT * FROM h WHERE hits >= {COVERAGE} * n UNION ALL SELECT * FROM kh) GROUP BY id)
SELECT doc_id, q.id IS NOT NULL AS contaminated, coalesce(items, []) AS item_ids, coalesce(c, 0.0) AS coverage FROM documents LEFT JOIN q ON q.id = doc_id
"""
