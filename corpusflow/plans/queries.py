"""Queries that apply the operators to whole test tables, each with the same result in DuckDB's SQL where SQL can say it.

Bindings: organisation = nation, mission = customer, chain = orders, record = lineitem; web pages = pages; full texts = documents; chat
messages = conversations; arriving records = events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import FIELDS
from ..operators import acquire, discover, generate, prepare, relational, samples, split, structure
from ..operators.numbering import number, shared_folder
from ..sources import html
from ..sources.keyed import KeyedStore
from ..streaming import retry
from ..streaming.resume import process_new

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Splits

CHAINS_SQL = "SELECT printf('C%09d', o_orderkey) AS chain_id, n_name AS org, c_name AS mission_name, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"
ASSIGN_SQL = f"""
chains AS ({CHAINS_SQL}),
marked AS (SELECT *, row_number() OVER (PARTITION BY mission_name ORDER BY chain_id) = 1 AS reserved FROM chains),
ranked AS (SELECT *, row_number() OVER (PARTITION BY org, reserved ORDER BY chain_id) - 1 AS r, count(*) OVER (PARTITION BY org, reserved) AS n FROM marked),
cut AS (SELECT *, round_even(n * 0.1, 0) AS v, greatest(0, n - round_even(n * 0.85, 0) - round_even(n * 0.1, 0)) AS t FROM ranked),
assigned AS (SELECT chain_id, org, mission_name, o_orderkey, CASE WHEN reserved OR r < n - v - t THEN 'train' WHEN r < n - t THEN 'validation' ELSE 'test' END AS split FROM cut)"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(nation.select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(F.format_string("C%09d", "o_orderkey").alias("chain_id"), F.col("n_name").alias("org"), F.col("c_name").alias("mission_name"), "o_orderkey")


@query(f"WITH {ASSIGN_SQL} SELECT chain_id, org, split FROM assigned")
def split_assign(spark, sf_dir):
    return split.assign(chains(spark, sf_dir)).select("chain_id", "org", "split")


@query(f"WITH {ASSIGN_SQL} SELECT split, count(*) AS n_chains, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM assigned GROUP BY split")
def split_counts(spark, sf_dir):
    return split.counts(split.assign(chains(spark, sf_dir)))


def split_records(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("difficulty"))
    assigned = split.assign(chains(spark, sf_dir)).withColumnRenamed("o_orderkey", "l_orderkey")
    return lines.join(assigned, "l_orderkey")


@query(f"""WITH {ASSIGN_SQL}, r AS (SELECT split, org, l_returnflag AS difficulty FROM lineitem JOIN assigned ON l_orderkey = o_orderkey)
SELECT split, 'org' AS dim, org AS value, count(*) AS n FROM r GROUP BY split, org UNION ALL SELECT split, 'difficulty', difficulty, count(*) FROM r GROUP BY split, difficulty""")
def split_distribution(spark, sf_dir):
    return split.distribution(split_records(spark, sf_dir), ["org", "difficulty"])


@query(f"WITH {ASSIGN_SQL} SELECT split, count(DISTINCT mission_name) AS n_missions FROM assigned GROUP BY split")
def split_missions(spark, sf_dir):
    return split.assign(chains(spark, sf_dir)).groupBy("split").agg(F.count_distinct("mission_name").alias("n_missions"))


@query("SELECT count(*) AS n_in, count(*) AS n_out FROM lineitem")
def split_conservation(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey")
    assigned = split.assign(chains(spark, sf_dir)).select(F.col("o_orderkey").alias("l_orderkey"), "split")
    return split.conservation(lines, split.attach(lines, assigned, "l_orderkey"))


@query(f"""WITH {ASSIGN_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(split, 'train') AS split,
CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 99 END AS place FROM lineitem LEFT JOIN (SELECT * FROM assigned WHERE split <> 'train') a ON l_orderkey = o_orderkey""")
def split_collect(spark, sf_dir):
    assigned = split.assign(chains(spark, sf_dir)).where("split <> 'train'").select(F.col("o_orderkey").alias("l_orderkey"), "split")
    level = F.try_element_at(F.array(*map(F.lit, ("basic", "intermediate", "advanced"))), F.col("l_linenumber"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return split.attach(lines, assigned, "l_orderkey").withColumn("place", split.difficulty_order(level))


@query("SELECT size, count(*) AS n_chains, size <> 3 AS incomplete FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size")
def chain_size_histogram(spark, sf_dir):
    return split.size_histogram(read(spark, sf_dir, "lineitem"), "l_orderkey")


@query(f"SELECT org, count(DISTINCT chain_id) AS n_chains FROM ({CHAINS_SQL}) GROUP BY org")
def chains_per_org(spark, sf_dir):
    return chains(spark, sf_dir).groupBy("org").agg(F.count_distinct("chain_id").alias("n_chains"))


@query(f"SELECT mission_name, count(DISTINCT chain_id) AS n_chains FROM ({CHAINS_SQL}) GROUP BY mission_name")
def chains_per_mission(spark, sf_dir):
    return chains(spark, sf_dir).groupBy("mission_name").agg(F.count_distinct("chain_id").alias("n_chains"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, n AS size FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r,
count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE r = 1""")
def first_record_per_chain(spark, sf_dir):
    return split.chains(read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).drop("first")


@query(f"SELECT mission_name, min(chain_id) AS chain_id FROM ({CHAINS_SQL}) GROUP BY mission_name")
def reserved_chains(spark, sf_dir):
    return split.reserved(chains(spark, sf_dir), "chain_id", "mission_name")


# Entries


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1")
def dedup_keep_first(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.lower("text"), 256).alias("key"))
    return relational.keep_first(docs, [F.col("key")], ["doc_id"]).drop("key")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text), source ORDER BY doc_id) = 1")
def dedup_by_category(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.lower("text"), 256).alias("key"))
    return relational.keep_first(docs, [F.col("key"), F.col("source")], ["doc_id"]).drop("key")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') ORDER BY p_partkey LIMIT 50 OFFSET 10")
def name_filter_skip_limit(spark, sf_dir):
    return relational.pick(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", like="E", skip=10, limit=50)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_brand), '1') AND contains(lower(p_name), 'a')")
def category_name_filter(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_brand").alias("category"))
    return relational.pick(parts, "p_partkey", "p_name", like="A", category="1").drop("category")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey")
def anti_join_done(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return relational.not_done(orders.select("o_custkey", "o_orderkey"), orders.where("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderkey"])


@query("SELECT l_linestatus || '::' || l_orderkey AS key, l_linenumber FROM lineitem WHERE l_linestatus || '::' || l_orderkey IN (SELECT o_orderstatus || '::' || o_orderkey FROM orders WHERE o_totalprice > 100000)")
def saved_records(spark, sf_dir):
    price = F.when(F.col("o_totalprice") > 100000, "ok").otherwise("failed")
    status = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("category"), price.alias("status"))
    store = read(spark, sf_dir, "lineitem").select(F.concat_ws("::", "l_linestatus", "l_orderkey").alias("key"), "l_linenumber")
    return relational.saved(status, store, category="category")


TOTAL = 1_000_000


@query(f"""
WITH d AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS seconds, row_number() OVER (ORDER BY c_custkey) AS index FROM customer),
e AS (SELECT *, sum(seconds) OVER w AS s, count(seconds) OVER w AS n FROM d WINDOW w AS (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT c_custkey, seconds, index, CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / CAST(n AS DOUBLE) * ({TOTAL} - index + 1) END AS eta FROM e""")
def progress_eta(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").cast("long").alias("seconds"))
    return relational.progress(rows, "c_custkey", "seconds", TOTAL)


LINKS_SQL = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)))) AS rank FROM pages"


RESULTS_SQL = f"SELECT page_id, rank, 'http://h' || href || CASE rank % 3 WHEN 0 THEN '.pdf' ELSE '' END AS url FROM ({LINKS_SQL})"


def _results(spark, sf_dir) -> DataFrame:
    """Search results made of a page's links: each third is a document."""
    found = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("rank", "href"))
    return found.select("page_id", "rank", F.concat(F.lit("http://h"), "href", F.when(F.col("rank") % 3 == 0, ".pdf").otherwise("")).alias("url"))


@query(f"""WITH r AS ({RESULTS_SQL}), s AS (SELECT page_id, rank, url || '.pdf' AS url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS n FROM r WHERE rank < 15 AND rank % 3 <> 0) WHERE n <= 6),
d AS (SELECT page_id, 0 AS late, rank, url FROM r WHERE rank < 15 AND rank % 3 = 0)
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY late, rank, url) AS place FROM (
SELECT * FROM d UNION ALL SELECT page_id, 1, rank, url FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.page_id = s.page_id AND d.url = s.url))""")
def candidate_order(spark, sf_dir):
    results_ = _results(spark, sf_dir)
    sniffed = acquire.to_sniff(results_, "page_id").select("page_id", "rank", F.concat("url", F.lit(".pdf")).alias("url"))
    found = acquire.candidates(results_, sniffed, "page_id")
    return found.select("page_id", F.posexplode("urls").alias("p", "url")).select("page_id", "url", (F.col("p") + 1).cast("long").alias("place"))


URL_SQL = "url || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '/pdf/' WHEN 2 THEN '?format=pdf' WHEN 3 THEN '?a=1&type=PDF' ELSE '/pdf' END"


@query(f"""SELECT page_id, ends_with(p, '.pdf') OR (contains(p, '/pdf') AND ends_with(p, '/')) OR contains(q, 'format=pdf') OR contains(q, 'type=pdf') AS flag FROM (
SELECT page_id, lower(regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) AS p, lower(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1)) AS q FROM (SELECT page_id, {URL_SQL} AS u FROM pages))""")
def pdf_url_predicate(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.expr(URL_SQL).alias("u"))
    return pages.select("page_id", T.is_document_url(F.col("u")).alias("flag"))


@query("SELECT org, name, size, extra FROM (SELECT 'A' AS org, c_name AS name, CAST(NULL AS INTEGER) AS size, c_mktsegment AS extra FROM customer UNION ALL SELECT 'B', s_name, NULL, NULL FROM supplier UNION ALL SELECT 'C', p_name, p_size, NULL FROM part)")
def union_sources(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("extra"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    c = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return relational.union_sources([("A", a), ("B", b), ("C", c)]).select("org", "name", "size", "extra")


@query("SELECT c_name AS name, coalesce(s_name, 'none') AS value, CASE WHEN s_name IS NULL THEN 'no_data' ELSE 'first' END AS tier FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def tiered_fallback(spark, sf_dir):
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    found = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("value"))
    return acquire.tiers(names, [("first", found)], "k").select("name", F.coalesce("value", F.lit("none")).alias("value"), "tier")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return relational.upsert(events.where("event_id % 2 = 0"), events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""SELECT user_id, arg_max(CASE WHEN event_id % 3 = 0 THEN value END, ts) FILTER (event_id % 3 = 0) AS value, arg_max(event_type, ts) FILTER (event_id % 2 = 0) AS event_type FROM events GROUP BY user_id""")
def upsert_merge_fields(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("event_type"))
    return relational.merge_fields(events, ["user_id"], ["ts"], ["value", "event_type"])


# Texts to records


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<h2[^>]*>(.*?)</h2>') THEN left(trim(regexp_replace(regexp_extract(html, '(?is)<h2[^>]*>(.*?)</h2>', 1), '\\s+', ' ', 'g')), 300)
WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>') THEN left(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), 300) ELSE '' END AS value FROM pages""")
def first_match_fields(spark, sf_dir):
    patterns = [r"(?isdU)<h2[^>]*>(.*?)</h2>", r"(?isdU)<title[^>]*>(.*?)</title>"]
    return read(spark, sf_dir, "pages").select("page_id", T.first_match(F.col("html"), patterns).alias("value"))


DATED_SQL = "'Launch date: ' || (doc_id % 28 + 1) || ' May ' || (1960 + doc_id % 60) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Managed by: Centre ' || doc_id || '.' || chr(10) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN 'Goals: go   far ' || doc_id || chr(10) || chr(10) ELSE '' END || 'Orbit type: ' || CASE doc_id % 2 WHEN 0 THEN 'polar' ELSE 'low' END || '. Payload: camera ' || doc_id"


def _field_sql(field: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(t, {p}) THEN left(trim(regexp_replace(regexp_extract(t, {p}, 1), '\\s+', ' ', 'g')), 300)" for p in (sql_text(x.replace("(?isdU)", "(?is)")) for x in FIELDS["list"][field])
    )
    return f"CASE {cases} ELSE '' END AS {field}"


@query(f"SELECT doc_id, {', '.join(map(_field_sql, FIELDS['list']))} FROM (SELECT doc_id, {DATED_SQL} AS t FROM documents)")
def field_patterns_doc(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.expr(DATED_SQL.replace("chr(10)", "char(10)")).alias("t"))
    return rows.select("doc_id", *[v.alias(k) for k, v in structure.fields(F.col("t"), "list").items()])


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'table ' || doc_id ELSE launch_date END AS launch_date FROM (SELECT doc_id, {_field_sql('launch_date')} FROM (SELECT doc_id, {DATED_SQL} AS t FROM documents))")
def override_or_find(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.expr(DATED_SQL.replace("chr(10)", "char(10)")).alias("t"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'table ' || doc_id ELSE '' END").alias("known"))
    return rows.select("doc_id", structure.fields(F.col("t"), "tables", {"launch_date": F.col("known")})["launch_date"].alias("launch_date"))


@query("SELECT doc_id, coalesce(left(list_filter(string_split(text, chr(10)), lambda p: length(p) >= 100)[1], 500), '') AS summary FROM documents")
def summary_first_long_block(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", structure.summary(F.split("text", "\n")).alias("summary"))


def _method_sql(blank: str) -> str:
    return f"""SELECT doc_id, CASE len(k) WHEN 0 THEN 'none' WHEN 1 THEN k[1] ELSE 'mixed' END AS method, n AS page_count FROM (
SELECT doc_id, len(string_split(text, chr(10))) AS n, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda p, i: CASE WHEN length(p) >= 50 THEN 'text' WHEN i % 2 = 1 THEN 'ocr' ELSE {blank} END), lambda x: x IS NOT NULL)) AS k FROM documents)"""


def _methods(spark, sf_dir, label_blank):
    pages = F.split("text", "\n")
    labels = F.transform(pages, lambda p, i: structure.page_method(p, F.when(i % 2 == 0, p), label_blank=label_blank))
    return read(spark, sf_dir, "documents").select("doc_id", structure.method(labels).alias("method"), F.size(pages).cast("long").alias("page_count"))


@query(_method_sql("'text'"))
def method_reduce(spark, sf_dir):
    return _methods(spark, sf_dir, True)


@query(_method_sql("NULL"))
def method_reduce_unlabelled(spark, sf_dir):
    return _methods(spark, sf_dir, False)


@query("SELECT conv_id, count(*) AS n_blocks, left(string_agg(text, chr(10) ORDER BY turn), 60000) AS text FROM conversations GROUP BY conv_id")
def full_text_join(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pages"))
    return turns.select("conv_id", F.size("pages").cast("long").alias("n_blocks"), T.head(structure.full_text(F.col("pages")), structure.STORED).alias("text"))


@query("""SELECT c_custkey AS key, ctx AS context, length(ctx) >= 50 AS kept FROM (SELECT c_custkey, concat_ws(chr(10), 'Mission: ' || c_name, 'Objective: ' || nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''),
'Launch Date: ' || nullif(CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE '' END, ''), CASE WHEN length(repeat(c_name, (c_custkey % 7)::BIGINT)) > 50 THEN 'Details:' || chr(10) || repeat(c_name, (c_custkey % 7)::BIGINT) END) AS ctx FROM customer JOIN nation ON n_nationkey = c_nationkey)""")
def context_build(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    parts = {"objective": F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), "launch_date": F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).otherwise("")}
    context = structure.context(F.col("c_name"), parts, F.expr("repeat(c_name, cast(c_custkey % 7 as int))"))
    return rows.select(F.col("c_custkey").alias("key"), context.alias("context")).withColumn("kept", F.length("context") >= generate.LEAST_CONTEXT)


@query("SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '_' || regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') AS source_id, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '_' || regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') || '_' || printf('%03d', p_size * 40 + 1) AS chain_id, printf('SPC_%06d', p_partkey * 999) AS sample_id FROM part")
def slug_ids(spark, sf_dir):
    source = T.slug(F.col("p_brand"), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", source.alias("source_id"), T.chain_id(source, F.col("p_size") * 40).alias("chain_id"), T.sample_id(F.col("p_partkey") * 999).alias("sample_id"))


@query("SELECT doc_id, md5(text) AS checksum, CASE doc_id % 4 WHEN 0 THEN trim(text, ' ' || chr(10)) WHEN 3 THEN trim(text, ' ' || chr(10)) ELSE text END AS text FROM documents")
def think_strip(spark, sf_dir):
    whole = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    wrapped = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<think>a\n b</think> "), "t")).when(F.col("doc_id") % 4 == 3, F.concat(F.lit("x<think></think>"), "t")).otherwise(F.col("t"))
    return whole.select("doc_id", F.md5("t").alias("checksum"), T.after_reasoning(wrapped).alias("text"))


# Chains and samples


@query("""SELECT c_name AS mission_name, count(*) AS total_chains, string_agg(lpad(CAST(i AS VARCHAR), 2, '0'), ',' ORDER BY i) AS aspects FROM customer, range(10) t(i) WHERE (c_custkey + i) % 4 <> 0 GROUP BY c_name""")
def crossjoin_aspects(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("mission_name"), F.posexplode(F.array(*map(F.lit, generate.ASPECTS))).alias("i", "aspect"))
    rows = rows.where((F.col("c_custkey") + F.col("i")) % 4 != 0).groupBy("mission_name").agg(F.array_sort(F.collect_list("i")).alias("x"))
    return rows.select("mission_name", F.size("x").cast("long").alias("total_chains"), F.array_join(F.transform("x", lambda i: F.lpad(i.cast("string"), 2, "0")), ",").alias("aspects"))


@query("SELECT event_id, event_type AS k, event_id % 3 <> 0 AS is_chain FROM events")
def lenient_json(spark, sf_dir):
    raw = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.col("event_type").alias("level_1"), F.lit(1).alias("level_2"), *[F.when(F.col("event_id") % 3 != 0, F.lit("x")).alias("level_3")])), F.lit(" done"))
    rows = read(spark, sf_dir, "events").select("event_id", generate.parsed(raw).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.level_1").alias("k"), generate.is_chain(F.col("j")).alias("is_chain"))


def results(spark, sf_dir) -> DataFrame:
    """Nested results made of customers and their orders, with gaps of every kind."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    level = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    q = F.concat(F.lit(" q "), F.col("o_orderkey").cast("string"))
    chain = F.struct(
        F.col("o_orderpriority").alias("aspect"), level(q, F.lit("a1 ")).alias("level_1"), level(q, F.when(F.col("o_orderstatus") == "F", " ").otherwise("a2")).alias("level_2"),
        F.when(F.col("o_orderkey") % 3 != 0, level(q, F.lit("a3"))).alias("level_3"),
    )
    chains_ = orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", chain.alias("c")))), lambda x: x["c"]).alias("qa_chains"))
    customer = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    org = F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.col("n_name"))
    return customer.join(chains_, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("pos"), org.alias("organisation"), F.col("c_name").alias("mission_name"), F.lit(None).cast("string").alias("source_url"), "qa_chains")


LEVELS_SQL = """
o AS (SELECT c_custkey AS m, regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g') || '_' || regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS source_id, n_name, c_name, o_orderkey, o_orderpriority, o_orderstatus,
  row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS c FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 11 <> 0),
l AS (SELECT o.*, v.i, v.difficulty, CASE v.i WHEN 1 THEN 'a1' WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'a2' END ELSE CASE WHEN o_orderkey % 3 <> 0 THEN 'a3' ELSE '' END END AS answer
  FROM o, (VALUES (1, 'basic'), (2, 'intermediate'), (3, 'advanced')) v(i, difficulty)),
s AS (SELECT printf('SPC_%06d', row_number() OVER (ORDER BY m, c, i)) AS sample_id, source_id || '_' || printf('%03d', c) AS chain_id, o_orderpriority AS aspect, difficulty, 'q ' || o_orderkey AS question, answer FROM l WHERE answer <> '')"""


@query(f"WITH {LEVELS_SQL} SELECT * FROM s")
def sample_numbering(spark, sf_dir):
    rows = samples.flatten(results(spark, sf_dir), "pos")
    return rows.select("sample_id", "chain_id", "aspect", "difficulty", F.get("messages", F.lit(1))["content"].alias("question"), F.get("messages", F.lit(2))["content"].alias("answer"))


@query(f"WITH {LEVELS_SQL} SELECT difficulty, count(*) AS n, count(*) FILTER (answer = '') AS n_empty FROM l GROUP BY difficulty")
def explode_levels(spark, sf_dir):
    return samples.exploded(results(spark, sf_dir), "pos").groupBy("difficulty").agg(F.count("*").alias("n"), F.count_if(F.col("answer") == "").alias("n_empty"))


@query(f"""WITH {LEVELS_SQL} SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS missions_in, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 11 = 0) AS missions_skipped,
(SELECT count(*) FROM l WHERE answer = '') AS qa_skipped, (SELECT count(*) FROM s) AS samples""")
def skip_accounting(spark, sf_dir):
    return samples.accounting(results(spark, sf_dir), "pos")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_quantity > 10")
def dense_numbers(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return number(read(spark, sf_dir, "lineitem").where("l_quantity > 10").select(*keys), keys)


# Reports


@query("""SELECT dim, value, n, row_number() OVER (PARTITION BY dim ORDER BY n DESC, first) AS rank FROM (
SELECT 'lang' AS dim, lang AS value, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), min(doc_id) FROM documents GROUP BY source)""")
def report_counts(spark, sf_dir):
    return relational.report(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of a run: those finished went well, the most urgent by a document."""
    ok, source = F.col("o_orderstatus") == "F", F.when(F.startswith("o_orderpriority", F.lit("1")), "pdf").otherwise("webpage")
    return read(spark, sf_dir, "orders").select(F.when(ok, "ok").otherwise("failed").alias("status"), source.alias("source"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("name"))


@query("""WITH s AS (SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AS ok_document, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority NOT LIKE '1%') AS ok_other, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders),
f AS (SELECT row_number() OVER (ORDER BY name) AS n, name AS failed_name FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS name FROM orders WHERE o_orderstatus <> 'F'))
SELECT total, ok_document, ok_other, failed, n, failed_name FROM s LEFT JOIN f ON true""")
def run_summary(spark, sf_dir):
    return relational.run_report(run_status(spark, sf_dir))


@query("SELECT row_number() OVER (ORDER BY name) AS n, name FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS name FROM orders WHERE o_orderstatus <> 'F')")
def run_failures(spark, sf_dir):
    return relational.failures(run_status(spark, sf_dir))


@query("SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_name FROM part")
def category_listing(spark, sf_dir):
    return relational.listing(read(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@query("SELECT DISTINCT l_linenumber AS n, CASE WHEN l_linenumber < 2 THEN 2 WHEN l_linenumber > 6 THEN 6 ELSE l_linenumber END AS layout FROM lineitem")
def table_arity_map(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n")).distinct().select("n", discover.layout(F.col("n")).alias("layout"))


# Preparation


def conversations(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return rows.select("conv_id", F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pair_no, text AS question, answer FROM (
SELECT *, lead(role) OVER w AS next, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant'""")
def qa_pairs(spark, sf_dir):
    m = conversations(spark, sf_dir)
    after = F.concat(F.slice("messages", 2, F.greatest(F.size("messages") - 1, F.lit(0))), F.array(F.lit(None).cast("struct<role:string,content:string>")))
    pairs = F.filter(F.zip_with("messages", after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: (x["a"]["role"] == "user") & (x["b"]["role"] == "assistant"))
    return m.select("conv_id", F.posexplode(pairs).alias("p", "x")).select("conv_id", (F.col("p") + 1).cast("long").alias("pair_no"), F.col("x.a.content").alias("question"), F.col("x.b.content").alias("answer"))


@query("""SELECT count(*) FILTER (conv_id % 5 = 0) AS issues, count(*) FILTER (a = 0) AS no_assistant, count(DISTINCT CAST(conv_id AS VARCHAR)) AS n_chains FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)""")
def conv_sanity(spark, sf_dir):
    m = conversations(spark, sf_dir)
    line = F.to_json(F.struct(*[F.lit("x").alias(c) for c in prepare.REQUIRED[:-1]], F.when(F.col("conv_id") % 5 != 0, F.lit("y")).alias("messages")))
    return prepare.sanity(m.select(prepare.missing_field(line).alias("issue"), "messages", F.col("conv_id").cast("string").alias("chain_id")))


_TOKENS = """
m AS (SELECT conv_id, turn, CASE role WHEN 'developer' THEN 'system' ELSE role END AS role, trim(text) AS text FROM conversations WHERE trim(text) <> ''),
t AS (SELECT conv_id, sum(len(string_split('<|' || role || '|> ' || text || ' <|end|>', ' '))) AS n, coalesce(sum(len(string_split('<|' || role || '|> ' || text || ' <|end|>', ' '))) FILTER (role <> 'assistant'), 0) + 1 AS p FROM m GROUP BY conv_id),
x AS (SELECT conv_id, CAST(least(n, 2048) AS BIGINT) AS n_tokens, CAST(least(p, n, 2048) AS BIGINT) AS n_masked FROM t WHERE n >= 4)"""


@query(f"WITH {_TOKENS} SELECT conv_id, n_tokens, n_masked, n_tokens - n_masked AS n_kept FROM x WHERE n_masked < n_tokens")
def loss_mask(spark, sf_dir):
    rows = prepare.examples(conversations(spark, sf_dir), "conv_id")
    hidden = F.size(F.filter("labels", lambda x: x == prepare.IGNORED)).cast("long")
    return rows.select("conv_id", F.size("input_ids").cast("long").alias("n_tokens"), hidden.alias("n_masked"), (F.size("labels") - hidden).alias("n_kept"))


@query(f"WITH {_TOKENS} SELECT CAST(min(n_tokens) AS INTEGER) AS min_tokens, CAST(max(n_tokens) AS INTEGER) AS max_tokens, round(avg(n_tokens), 0) AS mean_tokens FROM x WHERE n_masked < n_tokens")
def seq_len_stats(spark, sf_dir):
    return prepare.lengths(prepare.examples(conversations(spark, sf_dir), "conv_id"))


@query(f"WITH {_TOKENS}, b AS (SELECT *, (row_number() OVER (ORDER BY n_tokens, conv_id) - 1) // 16 AS batch FROM x WHERE n_masked < n_tokens) SELECT batch, CAST(ceil(max(n_tokens) / 8) * 8 AS INTEGER) AS padded_len, count(*) AS n, CAST(count(*) * ceil(max(n_tokens) / 8) * 8 - sum(n_tokens) AS BIGINT) AS n_pad FROM b GROUP BY batch")
def pad_batches(spark, sf_dir):
    rows = prepare.padded(prepare.batched(prepare.examples(conversations(spark, sf_dir), "conv_id"), "conv_id"), "batch")
    pads = F.size(F.filter("attention_mask", lambda x: x == 0)).cast("long")
    return rows.groupBy("batch").agg(F.max(F.size("input_ids")).alias("padded_len"), F.count("*").alias("n"), F.sum(pads).alias("n_pad"))


# Pages, generation and incremental runs


_ANCHORS = """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS pos FROM pages"""


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href, trim(text) AS text FROM ({_ANCHORS})")
def html_links(spark, sf_dir):
    return html.html_links(read(spark, sf_dir, "pages"), "page_id")


#: The pages' elements in SQL: tokens by one pattern, then a walk over all pages at once, a token a step, with the open elements as a stack.
_WALK = r"""
tok AS (SELECT page_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|<[^>]*$|[^<]+') AS ts FROM pages)),
part AS MATERIALIZED (SELECT page_id, i, t, lower(regexp_extract(t, '^</?([A-Za-z0-9]+)', 1)) AS tag,
  CASE WHEN regexp_matches(t, '(?i)^<(!|script|style)') OR regexp_matches(t, '^<[^>]*$') THEN 'none' WHEN starts_with(t, '</') THEN 'end' WHEN starts_with(t, '<') THEN 'start' ELSE 'text' END AS kind FROM tok),
walk(page_id, i, tags, places) AS (
  SELECT DISTINCT page_id, CAST(-1 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM part
  UNION ALL
  SELECT p.page_id, p.i,
    CASE WHEN p.kind = 'start' AND p.tag NOT IN ('br', 'meta', 'img', 'hr', 'input', 'link') THEN list_append(w.tags, p.tag) WHEN p.kind = 'end' AND list_contains(w.tags, p.tag) THEN w.tags[:len(w.tags) - list_position(list_reverse(w.tags), p.tag)] ELSE w.tags END,
    CASE WHEN p.kind = 'start' AND p.tag NOT IN ('br', 'meta', 'img', 'hr', 'input', 'link') THEN list_append(w.places, p.i) WHEN p.kind = 'end' AND list_contains(w.tags, p.tag) THEN w.places[:len(w.tags) - list_position(list_reverse(w.tags), p.tag)] ELSE w.places END
  FROM walk w JOIN part p ON p.page_id = w.page_id AND p.i = w.i + 1),
said AS (SELECT w.page_id, w.i, w.tags, w.places, regexp_replace(replace(replace(replace(replace(p.t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS piece
  FROM walk w JOIN part p USING (page_id, i) WHERE p.kind = 'text'),
held AS (SELECT page_id, i, tags, piece, unnest(places) AS of FROM said WHERE piece <> ''),
begun AS (SELECT w.page_id, w.i, p.tag, w.tags[:len(w.tags) - 1] AS above FROM walk w JOIN part p USING (page_id, i) WHERE p.kind = 'start')"""
_CHROME = "['nav', 'header', 'footer', 'script', 'style', 'noscript', 'aside', 'form']"


@query(f"""WITH RECURSIVE {_WALK},
b AS (SELECT page_id, i, tag, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM begun WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'p', 'li', 'td') AND NOT list_has_any(above, {_CHROME}))
SELECT b.page_id, CAST(b.pos AS INTEGER) AS pos, b.tag, string_agg(h.piece, ' ' ORDER BY h.i) AS text FROM b JOIN held h ON h.page_id = b.page_id AND h.of = b.i WHERE NOT list_has_any(h.tags, {_CHROME}) GROUP BY ALL HAVING length(text) > 30""")
def html_blocks(spark, sf_dir):
    return html.html_blocks(read(spark, sf_dir, "pages"), "page_id").where(F.length("text") > 30)


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(text) AS name, href FROM ({_ANCHORS}) WHERE starts_with(href, '/') AND length(trim(text)) >= 3 QUALIFY row_number() OVER (PARTITION BY page_id, lower(trim(text)) ORDER BY pos) = 1")
def page_entries(spark, sf_dir):
    """The pages' lists as paragraphs, which is where entries are looked for."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<(/?)li>", "<$1p>").alias("html"))
    return discover.listed(pages, "page_id", r"^/")


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(text) AS name, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://example.org' || href END AS source_url, '' AS description, '' AS pillar FROM ({_ANCHORS}) WHERE (contains(href, '/') OR contains(lower(href), 'http')) AND length(trim(text)) >= 2 QUALIFY row_number() OVER (PARTITION BY page_id, lower(trim(text)) ORDER BY pos) = 1")
def page_cards(spark, sf_dir):
    return discover.carded(read(spark, sf_dir, "pages"), "page_id", "https://example.org", sections=r"(?i)http|/")


@query(f"""WITH RECURSIVE {_WALK},
h AS (SELECT b.page_id, b.i, b.pos, coalesce(string_agg(h.piece, '' ORDER BY h.i), '') AS name FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM begun WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'strong', 'b')) b
  LEFT JOIN held h ON h.page_id = b.page_id AND h.of = b.i GROUP BY ALL),
l AS (SELECT page_id, pos, trim(text) AS name, href FROM ({_ANCHORS}) WHERE regexp_matches(href, '(?i)mission|satellite|spacecraft|launch') AND length(trim(text)) >= 3),
f AS (SELECT page_id, pos, name, href FROM l UNION ALL SELECT page_id, pos, name, '' FROM h WHERE length(name) BETWEEN 4 AND 120 AND page_id NOT IN (SELECT page_id FROM l)),
c AS (SELECT f.*, 'c' || f.page_id % 7 AS category, CASE WHEN href = '' THEN '' WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/]+') || href ELSE href END AS source_url FROM f JOIN pages USING (page_id))
SELECT page_id, CAST(pos AS INTEGER) AS pos, name, category, source_url FROM c QUALIFY row_number() OVER (PARTITION BY lower(name), category ORDER BY page_id, pos) = 1""")
def page_categories(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").withColumn("category", F.concat(F.lit("c"), (F.col("page_id") % 7).cast("string")))
    return discover.in_categories(pages, "page_id", "category", "url").select("page_id", F.col("at.row").alias("pos"), "name", "category", "source_url")


@query(f"""SELECT source AS organisation, 'M' || doc_id AS mission_name, CAST(10 AS INTEGER) AS total_chains, {sql_text(generate.ASPECTS[0])} AS first_aspect, {sql_text(generate.ASPECTS[9])} AS last_aspect
FROM documents WHERE length('Mission: ' || coalesce(source, 'Unknown') || CASE WHEN length(text) > 50 THEN chr(10) || 'Details:' || chr(10) || trim(left(text, 2000), ' ' || chr(10)) ELSE '' END) >= 50""")
def generate_stub(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("organisation"), F.concat(F.lit("M"), F.col("doc_id").cast("string")).alias("mission_name"), F.lit("").alias("source_url"), F.lit("").alias("scraped_at"), structure.context(F.col("source"), {}, F.col("text")).alias("context"))
    aspect = lambda i: F.get("qa_chains", F.lit(i))["aspect"]
    return generate.chains(docs).select("organisation", "mission_name", "total_chains", aspect(0).alias("first_aspect"), aspect(9).alias("last_aspect"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def resume_stream(spark, sf_dir):
    """New events by two incremental runs, of which the second finds nothing."""
    base = shared_folder(spark)
    source = read(spark, sf_dir, "events")
    source.write.parquet(f"{base}/in")
    for _ in range(2):
        process_new(spark, f"{base}/in", source.schema, f"{base}/state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    return spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.count("*").alias("n"))


def thirds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All events, as three parts one after the other in time, as they would arrive."""
    events = read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(ms), F.max(ms)).first()
    at = F.floor((ms - F.lit(low)) * 3 / F.lit((high or 0) - (low or 0) + 1))
    return [events.where(F.coalesce(at, F.lit(2)) == i) for i in range(3)]


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts IS NOT NULL GROUP BY user_id")
def keyed_store(spark, sf_dir):
    """Events upserted by user into a store of snapshots, in three writes and a compaction between them."""
    store = KeyedStore(spark, f"{shared_folder(spark)}/store", ["user_id"])
    for i, part in enumerate(thirds(spark, sf_dir)):
        store.upsert(part.where("ts is not null"), ["ts", "event_id"])
        if i == 1:
            store.compact(1)
    return store.read().select("user_id", "event_id", "event_type", "value")


@query(f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type = 'error' AS bad FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
o AS (SELECT *, count(*) FILTER (NOT bad) OVER w AS run, lead(ms) OVER w AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY user_id, run ORDER BY ms, event_id) - 1) % 3 + 1 AS INTEGER) AS n FROM o WHERE bad),
d AS (SELECT *, ms + CAST({retry.WAIT * 1000} * 2 ** (n - 1) AS BIGINT) AS due FROM f)
SELECT user_id, 'dead' AS kind, make_timestamp(ms * 1000) AS at, n AS failures FROM d WHERE n = 3
UNION ALL SELECT user_id, 'retry', make_timestamp(due * 1000), n FROM d WHERE n < 3 AND due < coalesce(next, (SELECT max(ms) FROM e))""")
def retry_attempts(spark, sf_dir):
    """Errors as failed attempts: when users are due again and when they are dead, by three incremental runs over the log as it grows."""
    base = shared_folder(spark)
    for part in thirds(spark, sf_dir):
        log = part.select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
        log.write.mode("append").parquet(f"{base}/in")
        retry.follow(spark, f"{base}/in", log.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), f"{base}/state", lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), ["user_id"], "ts", "ok", "event_id")
    return spark.read.parquet(f"{base}/out").select("user_id", "kind", F.col("at").cast("timestamp_ntz").alias("at"), "failures")
