"""The registered queries of the engine's own operators over the driver's tables, and the same results in DuckDB SQL.

Inputs that the tables do not hold are derived from whole tables by fixed rules: titles are sources, terms are seasons of
order dates, attributes and slots follow languages, lengths and roles, chunks stand for lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions.privacy import pii_remaining, redacted
from ..functions.rules import is_current
from ..operators import checks, chunk, crawl, dialog, embed, html, pdf_layout, privacy, store, vector
from . import search

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectors ------------------------------------------------------------------------------------------------------------


@_query("""
SELECT vec_id, label, round(list_cosine_distance(embedding::DOUBLE[], q), 6) + 0.0 AS distance
FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
ORDER BY list_cosine_distance(embedding::DOUBLE[], q), vec_id LIMIT 5
""")
def vector_topk(spark, sf_dir):
    """The five vectors nearest to vector 0."""
    items = _table(spark, sf_dir, "embeddings")
    query = items.filter("vec_id = 0").select("embedding").head()
    return vector.top_k(items.filter(F.lit(query is not None)), list(query["embedding"]) if query else [], 5).select("vec_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))


@_query("""
SELECT query_id, vec_id, distance, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0 AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), e.vec_id)::INT AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5
""")
def vector_topk_batch(spark, sf_dir):
    """The five nearest to each query vector; the query set is every 50th vector, against all."""
    items = _table(spark, sf_dir, "embeddings")
    queries = items.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.top_k_each(items, queries, 5).withColumn("distance", F.round("distance", 6) + 0.0)


_DIM = embed.EMBEDDING_DIM


def _bucket_sql(word: str) -> str:
    digit = lambda k: f"('0x' || substr(sha256({word}), {8 * k + 1}, 8))::BIGINT"
    out = f"({digit(0)} % {_DIM})"
    for k in range(1, 8):
        out = f"(({out} * 4294967296 + {digit(k)}) % {_DIM})"
    return f"{out}::INT"


_SPARSE = f"""
SELECT doc_id, bucket, sum(n)::BIGINT AS n FROM (
  SELECT doc_id, {_bucket_sql("word")} AS bucket, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY doc_id, word)
GROUP BY doc_id, bucket
"""
_ASK = "the report on the station and its nation"


@_query(_SPARSE)
def hash_embed_sparse(spark, sf_dir):
    """Every document's hashed word counts."""
    return embed.hash_embed_sparse(_table(spark, sf_dir, "documents"), "doc_id")


@_query(f"""
WITH s AS ({_SPARSE}),
q AS (SELECT bucket, count(*) AS qn FROM (SELECT {_bucket_sql("word")} AS bucket FROM (SELECT unnest(regexp_extract_all(lower('{_ASK}'), '[a-z0-9]+')) AS word)) GROUP BY bucket),
d AS (SELECT doc_id, sum(n * qn)::DOUBLE AS dot FROM s JOIN q USING (bucket) GROUP BY doc_id),
l AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM s GROUP BY doc_id)
SELECT doc_id, round(1 - dot / (norm * (SELECT sqrt(sum(qn * qn)::DOUBLE) FROM q)), 6) AS distance
FROM d JOIN l USING (doc_id) ORDER BY 1 - dot / (norm * (SELECT sqrt(sum(qn * qn)::DOUBLE) FROM q)), doc_id LIMIT 10
""")
def retrieve_text(spark, sf_dir):
    """The ten documents nearest to a question, by hashed words."""
    question = embed.hash_embed_sparse(spark.createDataFrame([(0, _ASK)], "id long, text string"), "id")
    sparse = embed.hash_embed_sparse(_table(spark, sf_dir, "documents"), "doc_id")
    return vector.search_text(sparse, question, 10).withColumn("distance", F.round("distance", 6))


# --- URLs and pages -----------------------------------------------------------------------------------------------------


@_query(r"""
SELECT page_id, CASE WHEN q = '' THEN base ELSE base || '?' || q END AS normal, site, is_pdf FROM (
  SELECT page_id, split_part(u, '?', 1) AS base,
         array_to_string(list_transform(list_filter(string_split(CASE WHEN contains(u, '?') THEN substr(u, instr(u, '?') + 1) ELSE '' END, '&'),
             lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|fbclid|gclid|mc_)')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') AS q,
         regexp_extract(lower(u), '^https?://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+)', 1) AS site, regexp_matches(lower(split_part(u, '?', 1)), '\.pdf$') AS is_pdf
  FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages))
""")
def url_normalize(spark, sf_dir):
    """Every page's URL in normal form, its site, and whether it is a PDF."""
    a = _table(spark, sf_dir, "pages").select("page_id", urls.normalize_absolute(F.col("url")).alias("normal"))
    return a.select("page_id", "normal", urls.site_of(F.col("normal")).alias("site"), urls.is_pdf_url(F.col("normal")).alias("is_pdf"))


_HREFS = r"""
SELECT page_id, url, unnest(h) AS href, (unnest(generate_series(1, len(h))) - 1)::INT AS pos
FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
"""


@_query(f"SELECT page_id, pos, href FROM ({_HREFS})")
def link_extract(spark, sf_dir):
    """Every link below a page's body, in order."""
    return html.page_links(_table(spark, sf_dir, "pages"), ["page_id"])


@_query(rf"""
WITH n AS (SELECT page_id AS page, pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS u, regexp_replace(split_part(url, '#', 1), '\?.*', '') AS own FROM ({_HREFS}) WHERE href LIKE '/%'),
f AS (SELECT page, CASE WHEN regexp_matches(lower(u), '\.pdf$') THEN 'pdf' ELSE 'page' END AS kind, u AS url, min(pos) AS pos FROM n WHERE u <> own GROUP BY ALL)
SELECT page, kind, (row_number() OVER (PARTITION BY page, kind ORDER BY pos) - 1)::INT AS ordinal, url FROM f
""")
def link_classify(spark, sf_dir):
    """The links of every page: same-site pages and PDFs, in normal form, each once."""
    links = html.page_links(_table(spark, sf_dir, "pages"), ["page_id", "url"]).select(F.col("page_id").alias("page"), F.col("url").alias("base"), "pos", "href")
    return urls.classify_links(links)


_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@_query(f"""
WITH a AS (SELECT page_id, {_PLAIN.format("regexp_extract(html, '<article><h1>((?s).*?)</h1>', 1)")} AS title, {_PLAIN.format("regexp_extract(html, '</h1>((?s).*?)</article>', 1)")} AS body FROM pages)
SELECT page_id, title, array_to_string(list_filter(['# ' || title, body], lambda x: x <> ''), chr(10) || chr(10)) || chr(10) AS markdown FROM a
""")
def html_to_markdown(spark, sf_dir):
    """Every page's title and main area."""
    return html.extract_pages(_table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "title", "markdown")


# --- text and chunks ----------------------------------------------------------------------------------------------------


_CHUNKS = r"""
SELECT doc_id, (unnest(generate_series(1, len(p))) - 1)::INT AS chunk_index, title || chr(10) || chr(10) || unnest(p) AS chunk_text FROM (
  SELECT doc_id, title, CASE WHEN t = '' THEN [] WHEN length(t) <= budget THEN [t] ELSE
    list_reduce(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: [x]),
      lambda a, x: CASE WHEN length(a[-1]) + 1 + length(x[1]) > budget THEN list_append(a, x[1]) ELSE list_append(a[:-2], a[-1] || ' ' || x[1]) END) END AS p
  FROM (SELECT doc_id, source AS title, greatest(1200 - length(source) - 2, 200) AS budget, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM documents))
"""


@_query(_CHUNKS)
def chunk_text(spark, sf_dir):
    """Every document's chunks under its source's name."""
    return chunk.chunks(_table(spark, sf_dir, "documents"), ["doc_id"], "source", "text").select("doc_id", "chunk_index", "chunk_text")


_RENDER = """
SELECT r.r_regionkey, '| Key | Nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) ORDER BY n_nationkey) AS markdown
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey
"""


def _nation_tables(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    rows = _table(spark, sf_dir, "region").join(rows, "r_regionkey")
    return rows.select("r_regionkey", "r_name", tx.markdown_table(F.array(F.lit("Key"), F.lit("Nation")), F.transform("x", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))).alias("markdown"))


@_query(_RENDER)
def table_render(spark, sf_dir):
    """Each region's nations as a Markdown table."""
    return _nation_tables(spark, sf_dir).select("r_regionkey", "markdown")


@_query("""
WITH n AS (SELECT n_regionkey AS r_regionkey, n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |' AS line FROM nation),
c AS (SELECT r_regionkey, r_name, line, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k FROM n JOIN region USING (r_regionkey)),
g AS (SELECT r_regionkey, r_name, list(line ORDER BY n_nationkey) AS lines FROM c GROUP BY ALL),
f AS (SELECT r_regionkey, r_name, lines, list_reduce(list_transform(lines, lambda x: [x]), lambda a, x: CASE WHEN 30 + 1 + length(a[-1]) + 1 + length(x[1]) > 200 THEN list_append(a, x[1]) ELSE list_append(a[:-2], a[-1] || chr(10) || x[1]) END) AS p FROM g)
SELECT r_regionkey, (unnest(generate_series(1, len(p))) - 1)::INT AS chunk_index, r_name || chr(10) || chr(10) || '| Key | Nation |' || chr(10) || '| --- | --- |' || chr(10) || unnest(p) AS chunk_text,
       r_name || chr(10) || chr(10) || '| Key | Nation |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(lines, chr(10)) AS context_text FROM f
""")
def chunk_tables(spark, sf_dir):
    """Tables that are too long for one chunk, dealt out by rows."""
    return chunk.chunks(_nation_tables(spark, sf_dir), ["r_regionkey"], "r_name", "markdown", max_chars=200)


@_query("SELECT doc_id, sha256(coalesce(source, '') || chr(10) || coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    """What tells whether a document has changed."""
    return _table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"


@_query(rf"""
SELECT doc_id, md5({_CLEAN}) AS clean_md5, substr({_CLEAN}, 1, 220) AS snippet, len(regexp_extract_all(text, '[.!?]\s+')) + 1 AS n_sentences, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens FROM documents
""")
def text_scalars(spark, sf_dir):
    """Cleaned text, snippet, sentences and tokens of every document."""
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_text(t).cast("binary")).alias("clean_md5"), tx.snippet(t).alias("snippet"), F.size(tx.sentences(t)).cast("long").alias("n_sentences"), F.size(tx.tokens(t)).cast("long").alias("n_tokens"))


# --- the store ----------------------------------------------------------------------------------------------------------


_STORED = ["doc_id", "title", "content_hash", "status"]


def _two_versions(spark, sf_dir):
    """What is stored lacks one language; what comes in lacks another and has new texts in a third."""
    a = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"), F.col("source").alias("title"), "text", "lang")
    hashed = lambda d: d.withColumn("content_hash", tx.content_hash(F.col("title"), F.col("text"))).drop("text", "lang")
    changed = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return hashed(a.filter("lang is distinct from 'de'")), hashed(a.filter("lang is distinct from 'es'").withColumn("text", changed))


_VERSIONS = """
WITH a AS (SELECT doc_id::VARCHAR AS doc_id, source AS title, lang, text FROM documents),
o AS (SELECT doc_id, title, sha256(title || chr(10) || text) AS h FROM a WHERE lang IS DISTINCT FROM 'de'),
n AS (SELECT doc_id, title, sha256(title || chr(10) || CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS h FROM a WHERE lang IS DISTINCT FROM 'es'),
u AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.title, o.title) AS title, coalesce(n.h, o.h) AS content_hash,
             CASE WHEN n.doc_id IS NULL THEN 'kept' WHEN o.doc_id IS NULL THEN 'new' WHEN o.h <> n.h THEN 'changed' ELSE 'touched' END AS status
      FROM o FULL JOIN n ON o.doc_id = n.doc_id)
"""


@_query(f"{_VERSIONS} SELECT * FROM u")
def upsert_documents(spark, sf_dir):
    """The store after a run: new, changed, touched and kept documents."""
    old, new = _two_versions(spark, sf_dir)
    return store.upsert_documents(old, new, overwritten=["title", "content_hash"]).select(_STORED)


@_query(f"{_VERSIONS} SELECT * FROM u WHERE status IN ('new', 'changed')")
def changed_documents(spark, sf_dir):
    """What a run has to embed again."""
    return upsert_documents(spark, sf_dir).filter("status in ('new', 'changed')")


@_query("""
SELECT source AS title, 'https://example.org/' || doc_id AS source_url, len(string_split(text, chr(10))) AS n_chunks, NULL::INT AS dims FROM documents
""")
def document_inventory(spark, sf_dir):
    """Every document with its chunks counted; lines stand for chunks."""
    a = _table(spark, sf_dir, "documents")
    none = F.lit(None)
    docs = a.select("doc_id", F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"), F.col("source").alias("title"), F.lit("html").alias("content_type"), F.lit("N/A").alias("campus"), F.lit("evergreen").alias("term"), none.cast("string").alias("parent_doc_id"), none.cast("timestamp").alias("last_ingested_at"))
    lines = a.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text")).withColumn("embedding", none.cast("array<float>"))
    return store.inventory(docs, lines.drop("chunk_text")).select("title", "source_url", "n_chunks", "dims")


@_query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(len(string_split(text, chr(10)))) FROM documents)::BIGINT AS chunks")
def store_totals(spark, sf_dir):
    """Documents and chunks in all."""
    a = _table(spark, sf_dir, "documents")
    return store.totals(a, a.select(F.explode(F.split("text", "\n"))))


@_query("""
WITH c AS (SELECT l_orderkey AS topic, l_returnflag AS value, l_shipdate, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC) AS k FROM lineitem WHERE l_linestatus = 'O')
SELECT topic, arg_min(value, l_linenumber) AS value, count(DISTINCT value) > 1 AS conflict FROM c WHERE k = 1 GROUP BY topic
""")
def resolve_conflicts(spark, sf_dir):
    """The most recently verified current value of each topic."""
    a = _table(spark, sf_dir, "lineitem")
    return store.resolve_conflicts(a.select(F.col("l_orderkey").alias("topic"), F.col("l_returnflag").alias("value"), F.col("l_shipdate").alias("last_verified_at"), (F.col("l_linestatus") == "O").alias("is_current"), F.col("l_linenumber").alias("doc_id")))


@_query("""
WITH d AS (SELECT 'unique source_documents' AS rule, count(*) AS n FROM (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT 'values source_documents', count(*) FROM documents WHERE lang NOT IN ('en', 'fr')
UNION ALL SELECT 'term source_documents', count(*) FROM documents WHERE length(source) % 2 = 1
UNION ALL SELECT 'reference document_chunks.doc_id', count(*) FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'dimension document_chunks', count(*) FROM benchmark WHERE len(string_split(text, ' ')) <> 768
UNION ALL SELECT 'unique document_chunks', 0
UNION ALL SELECT 'reference source_documents.parent_doc_id', count(*) FROM documents WHERE n_chars NOT IN (SELECT doc_id FROM documents))
SELECT rule, n::BIGINT AS n FROM d
""")
def store_violations(spark, sf_dir):
    """How many rows break each rule of a store made out of the documents and benchmark items."""
    d = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("source_url"), F.when(F.col("lang").isin("en", "fr"), "Both").otherwise("?").alias("campus"), F.lit("N/A").alias("academic_level"),
        F.lit("html").alias("content_type"), F.when(F.length("source") % 2 == 1, "Autumn 26").otherwise("Fall 2026").alias("term"), F.col("n_chars").cast("string").alias("parent_doc_id"),
    )
    c = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), F.split("text", " ").alias("embedding"))
    return checks.violations({"source_documents": d, "document_chunks": c})


# --- rules --------------------------------------------------------------------------------------------------------------


_TERMS = "CASE WHEN month(o_orderdate) <= 3 THEN 'Winter' WHEN month(o_orderdate) <= 6 THEN 'Spring' WHEN month(o_orderdate) <= 9 THEN 'Summer' ELSE 'Fall' END"


@_query(f"""
SELECT o_orderkey, {_TERMS} || ' ' || year(o_orderdate) AS term, year(o_orderdate) > 1998 OR (year(o_orderdate) = 1998 AND month(o_orderdate) > 6) AS is_current FROM orders
""")
def term_current(spark, sf_dir):
    """Whether the term of an order's date has not passed in Summer 1998."""
    season = F.element_at(F.array(*map(F.lit, ["Winter", "Spring", "Summer", "Fall"])), F.quarter("o_orderdate"))
    a = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(season, F.lit(" "), F.year("o_orderdate").cast("string")).alias("term"))
    return a.withColumn("is_current", is_current(F.col("term"), F.lit("Summer 1998")))


@_query("""
SELECT doc_id, campus, academic_level, term FROM (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'Hammond' WHEN 'fr' THEN 'Westville' WHEN 'de' THEN 'Both' ELSE 'N/A' END AS campus,
         CASE WHEN n_chars % 3 = 0 THEN 'Graduate' WHEN n_chars % 3 = 1 THEN 'Undergraduate' ELSE 'Both' END AS academic_level,
         CASE WHEN n_chars % 5 = 0 THEN 'evergreen' ELSE 'Fall ' || (2024 + n_chars % 5) END AS term FROM documents)
WHERE campus IN ('Hammond', 'Both', 'N/A') AND academic_level IN ('Graduate', 'Both') AND (term = 'evergreen' OR term >= 'Fall 2026')
""")
def eligible_documents(spark, sf_dir):
    """Documents that a search for one campus, level and current term may return."""
    n = F.col("n_chars")
    campus = F.when(F.col("lang") == "en", "Hammond").when(F.col("lang") == "fr", "Westville").when(F.col("lang") == "de", "Both").otherwise("N/A")
    level = F.when(n % 3 == 0, "Graduate").when(n % 3 == 1, "Undergraduate").otherwise("Both")
    term = F.when(n % 5 == 0, "evergreen").otherwise(F.concat(F.lit("Fall "), (2024 + n % 5).cast("string")))
    return search.eligible(_table(spark, sf_dir, "documents").select("doc_id", campus.alias("campus"), level.alias("academic_level"), term.alias("term")), "Fall 2026", "Hammond", "Graduate")


@_query("""
WITH RECURSIVE e AS (SELECT page_id AS doc_id, CASE WHEN page_id % 5 <> 0 THEN page_id - 1 END AS parent FROM pages),
t AS (SELECT doc_id, doc_id AS top FROM e WHERE parent IS NULL UNION ALL SELECT e.doc_id, t.top FROM e JOIN t ON e.parent = t.doc_id)
SELECT a.doc_id AS hit, b.doc_id FROM t a JOIN t b USING (top)
""")
def family_chain(spark, sf_dir):
    """Every page's family, in chains of five pages."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 5 != 0, F.col("page_id") - 1).alias("parent_doc_id"))
    return search.with_family(pages, pages)


# --- conversations ------------------------------------------------------------------------------------------------------


@_query("SELECT conv_id AS conversation_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS nth FROM conversations")
def conversation_messages(spark, sf_dir):
    """Messages in order."""
    return dialog.ordered(_table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "conversation_id"), ("turn",))


def _events(spark, sf_dir):
    n = F.length("text")
    campus = F.when((F.col("role") == "user") & (n % 3 == 0), "Hammond").when((F.col("role") == "user") & (n % 3 == 1), "Westville")
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", campus.alias("campus"), F.when(n % 4 == 0, "Graduate").alias("academic_level"), F.when(n % 2 == 0, F.substring("text", 1, 20)).alias("pending_question"), F.when(n % 7 == 0, "ended").otherwise("active").alias("status"))


_EVENTS = """SELECT conv_id AS conversation_id, turn, CASE WHEN role = 'user' AND length(text) % 3 = 0 THEN 'Hammond' WHEN role = 'user' AND length(text) % 3 = 1 THEN 'Westville' END AS campus,
CASE WHEN length(text) % 4 = 0 THEN 'Graduate' END AS academic_level, CASE WHEN length(text) % 2 = 0 THEN substr(text, 1, 20) END AS pending_question, CASE WHEN length(text) % 7 = 0 THEN 'ended' ELSE 'active' END AS status FROM conversations"""
_SO_FAR = "OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@_query(f"SELECT conversation_id, turn, last_value(campus IGNORE NULLS) {_SO_FAR} AS campus, last_value(academic_level IGNORE NULLS) {_SO_FAR} AS academic_level FROM ({_EVENTS})")
def conversation_slots(spark, sf_dir):
    """What is known of a conversation after each turn."""
    return dialog.slots(_events(spark, sf_dir)).select("conversation_id", "turn", "campus", "academic_level")


@_query(f"""SELECT conversation_id, min(turn) AS first_turn, arg_max(campus, turn) FILTER (campus IS NOT NULL) AS campus, arg_max(academic_level, turn) FILTER (academic_level IS NOT NULL) AS academic_level,
arg_max(status, turn) AS status, list(pending_question ORDER BY turn)[-1] AS pending_question FROM ({_EVENTS}) GROUP BY conversation_id""")
def conversation_state(spark, sf_dir):
    """Every conversation as it stands now."""
    return dialog.current(_events(spark, sf_dir))


@_query("SELECT conv_id AS conversation_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def transcripts(spark, sf_dir):
    """Every conversation as one text."""
    return dialog.transcript(_table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "conversation_id"))


@_query("""
SELECT doc_id, violation FROM (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN quality <> 1 AND toxic <> 1 THEN 'neither' END AS violation FROM labels) WHERE violation IS NOT NULL
""")
def answer_invariant(spark, sf_dir):
    """Answers that neither cite nor escalate, or do both: good documents cite, toxic ones escalate."""
    cite = F.when(F.col("quality") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    a = _table(spark, sf_dir, "labels").select("doc_id", cite.alias("citations"), (F.col("toxic") == 1).alias("escalated"), F.when(F.col("toxic") == 1, "office").alias("department"))
    return checks.answer_violations(a).select("doc_id", "violation")


@_query(r"""
WITH u AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text || ' [' || (n_chars % 7 + 1) || '] [' || (n_chars % 5 + 1) || ']', '\[([0-9]+)\]', 1))) AS m FROM documents),
c AS (SELECT doc_id, m::INT AS n FROM u WHERE TRY_CAST(m AS INT) BETWEEN 1 AND 4)
SELECT d.doc_id AS answer_id, coalesce((SELECT string_agg('s' || n, ',' ORDER BY n) FROM c WHERE c.doc_id = d.doc_id), '') AS cited FROM documents d
""")
def citation_map(spark, sf_dir):
    """The excerpts that each answer cites, of four supplied; numbers that were never supplied go."""
    docs = _table(spark, sf_dir, "documents")
    mark = lambda n: F.concat(F.lit(" ["), (F.col("n_chars") % n + 1).cast("string"), F.lit("]"))
    answers = docs.select(F.col("doc_id").alias("answer_id"), F.concat("text", mark(7), mark(5)).alias("text"))
    excerpts = docs.select(F.col("doc_id").alias("answer_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    excerpts = excerpts.select("answer_id", "n", F.concat(F.lit("s"), F.col("n").cast("string")).alias("source_document_id"), F.lit("t").alias("title"), F.lit("u").alias("url"))
    return dialog.cited(answers, excerpts).select("answer_id", F.array_join("citations.source_document_id", ",").alias("cited"))


_CONTACTS = [("Office A", ["the", "and the"], "a@example.org", "Hammond"), ("Office B", ["of the", "des"], "b@example.org", None), ("Office C", ["und", "the"], "c@example.org", "Westville")]


@_query(r"""
WITH q AS (SELECT conv_id * 1000 + turn AS question_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}/]+', ' ', 'g') || ' ' AS w FROM conversations),
t AS (SELECT * FROM (VALUES ('Office A', true, 'the'), ('Office A', true, 'and the'), ('Office B', false, 'of the'), ('Office B', false, 'des'), ('Office C', false, 'und'), ('Office C', false, 'the')) v(name, near, topic)),
s AS (SELECT question_id, name, near, count(*) AS n FROM q JOIN t ON contains(w, ' ' || topic || ' ') GROUP BY ALL),
b AS (SELECT question_id, name, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, near DESC, name) AS k FROM s)
SELECT q.question_id, coalesce(b.name, 'Dean of Students Office') AS department FROM q LEFT JOIN b ON b.question_id = q.question_id AND k = 1
""")
def department_routing(spark, sf_dir):
    """The office that each message's words point to."""
    questions = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text", F.lit("Hammond").alias("campus"))
    return dialog.route(questions, spark.createDataFrame(_CONTACTS, "name string, topics array<string>, contact_method string, campus string"))


@_query("""
WITH h AS (SELECT c_nationkey AS query_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Hammond' WHEN c_acctbal > 9000 THEN 'Westville' ELSE 'Both' END AS campus, CASE WHEN c_acctbal < 0 THEN 'Graduate' ELSE 'N/A' END AS level FROM customer)
SELECT query_id, CASE WHEN count(DISTINCT campus) FILTER (campus <> 'Both') > 1 THEN 'campus' ELSE '' END AS slots FROM h GROUP BY query_id
""")
def required_slots(spark, sf_dir):
    """The slots in which each query's hits differ."""
    campus = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Hammond").when(F.col("c_acctbal") > 9000, "Westville").otherwise("Both")
    hits = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), campus.alias("campus"), F.when(F.col("c_acctbal") < 0, "Graduate").otherwise("N/A").alias("academic_level"))
    return dialog.required_slots(hits).select("query_id", F.array_join("slots", ",").alias("slots"))


@_query("""
SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'escalation' WHEN doc_id % 3 = 0 THEN 'clarifying_question' ELSE 'answer' END AS kind FROM labels
""")
def reply_kind(spark, sf_dir):
    """What kind of reply each answer is: good hits stand for similarity, toxic ones for none cited."""
    escalate = dialog.must_escalate(F.col("quality").cast("double"), F.lit("text"), F.when(F.col("toxic") == 1, 0).otherwise(1))
    return _table(spark, sf_dir, "labels").select("doc_id", dialog.reply(F.lit("text"), escalate, F.when(F.col("doc_id") % 3 == 0, "campus")).alias("kind"))


@_query("""
SELECT s_suppkey, '{"sSuppkey":' || s_suppkey || ',"sName":' || to_json(s_name)::VARCHAR || ',"sNationkey":' || s_nationkey || '}' AS record FROM supplier
""")
def api_records(spark, sf_dir):
    """Suppliers as JSON records with camel-case names."""
    return _table(spark, sf_dir, "supplier").select("s_suppkey", tx.api_json(["s_suppkey", "s_name", "s_nationkey"]).alias("record"))


# --- privacy ------------------------------------------------------------------------------------------------------------


_MASKED = r"""regexp_replace(regexp_replace(regexp_replace({}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'),
'(\+?[0-9]{{1,2}}[ .-]?)?\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}', '[PHONE]', 'g'), '\b[0-9]{{7,9}}\b', '[ID]', 'g')"""


@_query(rf"SELECT doc_id, md5(m) AS masked_md5, regexp_matches(m, '@[A-Za-z0-9-]+\.|[0-9]{{7,}}') AS remains FROM (SELECT doc_id, {_MASKED.format('text')} AS m FROM documents)")
def redact_documents(spark, sf_dir):
    """Every document masked, and whether anything is left."""
    a = _table(spark, sf_dir, "documents").select("doc_id", redacted(F.col("text")).alias("m"))
    return a.select("doc_id", F.md5(F.col("m").cast("binary")).alias("masked_md5"), pii_remaining(F.col("m")).alias("remains"))


@_query(rf"""
WITH t AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
m AS (SELECT sha256('salt:' || conv_id) AS conversation_ref, {_MASKED.format('text')} AS deidentified_text FROM t)
SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 90 DAY AS purge_after FROM m WHERE NOT regexp_matches(deidentified_text, '@[A-Za-z0-9-]+\.|[0-9]{{7,}}')
""")
def transcript_retain(spark, sf_dir):
    """The transcripts that may be kept."""
    t = transcripts(spark, sf_dir).withColumn("created_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    return privacy.retained(t, "salt")[0].drop("created_at")


@_query("SELECT event_id, ts + INTERVAL 90 DAY AS purge_after FROM events WHERE ts + INTERVAL 90 DAY > TIMESTAMP '2024-04-15'")
def retention_purge(spark, sf_dir):
    """What a purge leaves."""
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL '90' DAY")).alias("purge_after"))
    return privacy.purged(rows, F.expr("TIMESTAMP_NTZ '2024-04-15 00:00:00'"))


# --- more of the batch run, over derived inputs --------------------------------------------------------------------------


_HEADED = _CHUNKS.replace("SELECT doc_id, source AS title, greatest(1200 - length(source) - 2, 200) AS budget", "SELECT doc_id, 'Corpus > ' || source || ' > ' || lang AS title, greatest(1200 - length('Corpus > ' || source || ' > ' || lang) - 2, 200) AS budget")


@_query(_HEADED)
def chunk_headed(spark, sf_dir):
    """Every document's chunks below two headings and a title."""
    a = _table(spark, sf_dir, "documents")
    markdown = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## Nothing here\n\n# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n\n"), F.col("text"))
    return chunk.chunks(a.select("doc_id", F.lit("Corpus").alias("title"), markdown.alias("markdown")), ["doc_id"], "title", "markdown").select("doc_id", "chunk_index", "chunk_text")


@_query("""
WITH n AS (SELECT n_regionkey AS k, count(*) AS n, string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS items, string_agg('**' || n_nationkey || '**' || chr(10) || ': ' || n_name, chr(10) ORDER BY n_nationkey) AS terms,
                  string_agg(chr(10) || '  ' || nth || '. ' || n_name, '' ORDER BY n_nationkey) AS nested, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS cells
           FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nth FROM nation) GROUP BY n_regionkey)
SELECT r_regionkey, r_name AS title, '# ' || r_name || chr(10) || chr(10) || '## Nations' || chr(10) || chr(10) || items || chr(10) || chr(10) || '### By number' || chr(10) || chr(10) || '| Key | Nation |' || chr(10) || '| --- | --- |' || chr(10) || cells
  || chr(10) || chr(10) || terms || chr(10) || chr(10) || '- all' || nested || chr(10) || chr(10) || '> ' || r_name || chr(10) || '>' || chr(10) || '> of ' || n || chr(10) || chr(10) || '```' || chr(10) || 'key  ' || r_regionkey || chr(10) || '```' || chr(10) || chr(10) || '#### End' || chr(10) AS markdown
FROM region JOIN n ON k = r_regionkey
""")
def html_blocks(spark, sf_dir):
    """A page for each region: headings, lists, nested lists, tables, terms, a quote, preformatted text, a toggle."""
    row = lambda c, f: F.array_join(F.transform(c, f), "")
    a = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x")).join(_table(spark, sf_dir, "region"), "r_regionkey")
    key = lambda x: x["n_nationkey"].cast("string")
    wrap = lambda tag, *c: F.concat(F.lit(f"<{tag}>"), *c, F.lit(f"</{tag}>"))
    body = F.concat(
        wrap("h1", F.col("r_name")), F.lit("<nav>menu</nav><h2>Nations</h2>"), wrap("ul", row("x", lambda x: wrap("li", x["n_name"]))), F.lit("<details><summary>By number</summary>"),
        wrap("table", F.lit("<tr><th>Key</th><th>Nation</th></tr>"), row("x", lambda x: wrap("tr", wrap("td", key(x)), wrap("td", x["n_name"])))), F.lit("</details>"), wrap("dl", row("x", lambda x: F.concat(wrap("dt", key(x)), wrap("dd", x["n_name"])))),
        wrap("ul", wrap("li", F.lit("all"), wrap("ol", row("x", lambda x: wrap("li", x["n_name"]))))), wrap("blockquote", wrap("p", F.col("r_name")), wrap("p", F.lit("of "), F.size("x").cast("string"))),
        wrap("pre", F.lit("key  "), F.col("r_regionkey").cast("string")), F.lit('<script>x</script><div class="h4">End</div>'),
    )
    return html.extract_pages(a.select("r_regionkey", F.lit("https://example.org/").alias("url"), wrap("main", body).alias("html")), ["r_regionkey"]).select("r_regionkey", "title", "markdown")


@_query("""
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
c AS (SELECT vec_id, d.doc_id, source AS title, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 10) AS head, list_cosine_distance(embedding::DOUBLE[], q) AS distance FROM embeddings JOIN documents d ON d.doc_id = vec_id, q WHERE lang IN ('en', 'de'))
SELECT doc_id, title, head, round(distance, 6) + 0.0 AS distance FROM c ORDER BY c.distance, doc_id LIMIT 7
""")
def search_documents(spark, sf_dir):
    """The nearest chunks of the documents that hold for one campus, with their documents; vectors stand for chunks."""
    d = _table(spark, sf_dir, "documents")
    campus = F.when(F.col("lang") == "en", "Hammond").when(F.col("lang") == "de", "Both").otherwise("Westville")
    docs = d.select("doc_id", F.col("source").alias("title"), F.lit("https://example.org/").alias("source_url"), campus.alias("campus"), F.lit("Both").alias("academic_level"), F.lit("evergreen").alias("term"))
    items = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id").select("doc_id", F.lit(0).alias("chunk_index"), "embedding").join(d.select("doc_id", F.col("text").alias("chunk_text")), "doc_id")
    first = items.orderBy("doc_id").select("embedding").head()
    return search.search(docs, items, list(first["embedding"]) if first else [], 7, campus="Hammond", current_term="Fall 2026").select("doc_id", "title", F.substring("snippet", 1, 10).alias("head"), (F.round("distance", 6) + 0.0).alias("distance"))


@_query("""
WITH o AS (SELECT doc_id::VARCHAR AS doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) - 1 AS k FROM documents WHERE lang <> 'de' AND NOT (lang = 'en' AND doc_id % 3 = 0)),
n AS (SELECT doc_id::VARCHAR AS doc_id, unnest(string_split(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) - 1 AS k FROM documents WHERE lang <> 'es')
SELECT doc_id, k::INT AS chunk_index, md5(line) AS line_md5, true AS embedded FROM n WHERE doc_id IN (SELECT doc_id::VARCHAR FROM documents WHERE lang IN ('fr', 'de') OR (lang = 'en' AND doc_id % 3 = 0))
UNION ALL SELECT doc_id, k::INT, md5(line), false FROM o WHERE doc_id NOT IN (SELECT doc_id::VARCHAR FROM documents WHERE lang IN ('fr', 'de') OR (lang = 'en' AND doc_id % 3 = 0))
""")
def chunk_replacement(spark, sf_dir):
    """The chunk table after a run that embeds what is new, changed, or stored with another number of chunks: lines stand
    for chunks, and those of every third English document had been lost."""
    old, new = _two_versions(spark, sf_dir)
    status = store.upsert_documents(old, new, overwritten=["title", "content_hash"])
    a = _table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    lines = lambda d, text, made: d.select("doc_id", F.posexplode(F.split(text, "\n")).alias("chunk_index", "line"), F.lit(made).alias("embedded"))
    stored = lines(a.filter("lang <> 'de' and not (lang = 'en' and doc_id % 3 = 0)"), F.col("text"), False)
    made = lines(a.filter("lang <> 'es'"), F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")), True)
    return store.replace_chunks(stored, store.to_embed(status, made, stored)).select("doc_id", "chunk_index", F.md5(F.col("line").cast("binary")).alias("line_md5"), "embedded")


@_query("""
WITH o AS (SELECT c_nationkey || '-' || c_mktsegment AS name, max(c_name) AS contact_method FROM customer WHERE c_nationkey < 15 GROUP BY 1),
n AS (SELECT c_nationkey || '-' || c_mktsegment AS name, arg_max(c_name, c_custkey) AS contact_method FROM customer WHERE c_nationkey >= 10 GROUP BY 1)
SELECT coalesce(n.name, o.name) AS name, coalesce(n.contact_method, o.contact_method) AS contact_method FROM o FULL JOIN n ON o.name = n.name
""")
def contact_upsert(spark, sf_dir):
    """Contacts after a seed list with repeated names: the last row of each name holds."""
    a = _table(spark, sf_dir, "customer").select(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("name"), F.col("c_name").alias("contact_method"), F.col("c_custkey").alias("place"), "c_nationkey")
    old = a.filter("c_nationkey < 15").groupBy("name").agg(F.max("contact_method").alias("contact_method"))
    return store.upsert_rows(old, a.filter("c_nationkey >= 10").drop("c_nationkey"), "name")


@_query(f"""
SELECT d.doc_id, {_DIM} AS dims, coalesce(n, 0)::INT AS filled, coalesce(spot, -1)::INT AS fullest FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, min(bucket) FILTER (n = top) AS spot FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top FROM ({_SPARSE})) GROUP BY doc_id) s ON s.doc_id = d.doc_id
""")
def dense_vectors(spark, sf_dir):
    """Every document's dense vector of length one: its dimension, its buckets that are not empty, and the fullest."""
    v = embed.hash_vectors(_table(spark, sf_dir, "documents"), "doc_id")
    top = F.array_max("embedding")
    return v.select("doc_id", F.size("embedding").alias("dims"), F.size(F.filter("embedding", lambda x: x > 0)).alias("filled"), F.when(top > 0, F.array_position("embedding", top) - 1).otherwise(-1).cast("int").alias("fullest"))


@_query("""
WITH RECURSIVE e AS (SELECT page_id AS doc_id, CASE WHEN page_id % 150 <> 0 THEN page_id - 1 END AS parent FROM pages),
t AS (SELECT doc_id, doc_id AS top FROM e WHERE parent IS NULL UNION ALL SELECT e.doc_id, t.top FROM e JOIN t ON e.parent = t.doc_id)
SELECT doc_id, top FROM t
""")
def family_tops(spark, sf_dir):
    """Every page's family by its top, in chains of 150 pages."""
    return crawl.family(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 150 != 0, F.col("page_id") - 1).alias("parent")))


@_query("""
SELECT conv_id AS conversation_id, turn FROM conversations
WHERE trim(coalesce(CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END, '')) = '' OR turn % 3 = 2 OR (role = 'assistant' AND turn % 4 = 3)
""")
def invalid_messages(spark, sf_dir):
    """Messages with blank text, an unknown campus or an unknown level."""
    turn = F.col("turn")
    a = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", F.when(turn % 5 == 4, " ").otherwise(F.col("text")).alias("text"), F.when(turn % 3 == 2, "Nowhere").otherwise("Hammond").alias("stated_campus"), F.when((F.col("role") == "assistant") & (turn % 4 == 3), "Doctor").alias("stated_academic_level"))
    return dialog.invalid_messages(a).select("conversation_id", "turn")


_SITE = "https://a.example.org/p/"


@_query(f"""
WITH p AS (SELECT page_id, {_PLAIN.format("regexp_extract(html, '<article><h1>((?s).*?)</h1>', 1)")} AS title FROM pages),
f AS (SELECT page_id AS place, page_id AS id, floor(log2(page_id + 1))::INT AS depth, CASE WHEN page_id > 0 THEN (page_id - 1) // 2 END AS up FROM pages WHERE page_id < 12
      UNION ALL SELECT 12 + k, id, d, up FROM (VALUES (0, 12, 0, NULL), (1, 25, 1, 12), (2, 26, 1, 12)) v(k, id, d, up))
SELECT place::INT AS place, '{_SITE}' || id AS url, depth, '{_SITE}' || up AS parent_url, title FROM f JOIN p ON p.page_id = f.id
""")
def crawl_bfs(spark, sf_dir):
    """Two seeds over a site of all pages, each of which links to two more: the first stops at its cap, the second leaves
    out what the first has visited; robots.txt forbids a page that no result may hold."""
    a = _table(spark, sf_dir, "pages")
    link = lambda k: F.concat(F.lit(f'<a href="{_SITE}'), (2 * F.col("page_id") + k).cast("string"), F.lit('">x</a>'))
    page = F.replace(F.col("html"), F.lit("</article>"), F.concat(link(1), link(2), F.lit('<a href="/p/0">up</a><a href="/secret">no</a></article>')))
    at = F.concat(F.lit(_SITE), F.col("page_id").cast("string"))
    fetched = a.select(at.alias("url"), at.alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), page.cast("binary").alias("content"), F.lit(None).cast("map<string,string>").alias("headers"))
    rows = [("https://a.example.org/robots.txt", None, 200, "text/plain", b"User-agent: *\nDisallow: /secret\n", None), ("https://a.example.org/secret", None, 200, "text/html", b"<main>secret</main>", None)]
    fetched = fetched.unionByName(spark.createDataFrame(rows, fetched.schema))
    rules = crawl.robots_rules(fetched)
    seeds = [{"name": "a", "url": f"{_SITE}0", "max_depth": 4, "follow": ["/p/", "/secret"], "max_pages": 12}, {"name": "b", "url": f"{_SITE}12", "max_depth": 1, "follow": ["/p/"], "max_pages": 9}]
    return crawl.crawl(spark, seeds, fetched, lambda reached: crawl.pages_of(reached, None, rules)).select(F.col("place").cast("int").alias("place"), "url", "depth", "parent_url", "title")


@_query("""
SELECT r_regionkey::VARCHAR AS doc, '## Region ' || r_regionkey || chr(10) || chr(10) || 'The nations of this region are named below in the order of their keys.' || chr(10) || chr(10)
  || string_agg('1. Nation ' || n_nationkey, chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || '| Key | Nation |' || chr(10) || '| --- | --- |' || chr(10)
  || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
""")
def pdf_layout_blocks(spark, sf_dir):
    """A page for each region: a heading, a wrapped paragraph, list items, and a table whose lines are not text."""
    a = _table(spark, sf_dir, "nation").withColumn("nth", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).select(F.col("n_regionkey").cast("string").alias("doc"), "nth", "n_nationkey", "n_name")
    r = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("doc"))
    fixed = F.array(*(F.struct(F.lit(i).alias("line"), (F.concat(F.lit(t), "doc") if i == 0 else F.lit(t)).alias("text"), F.lit(b).alias("all_bold"), F.lit(72.0 + 14 * i).alias("top")) for i, (t, b) in enumerate([("Region ", True), ("The nations of this region are named be-", False), ("low in the order of their keys.", False)])))
    lines = r.select("doc", F.explode(fixed).alias("l")).select("doc", "l.*")
    item = lambda n, text, top: a.select("doc", (F.lit(n) + F.col("nth")).cast("int").alias("line"), text.alias("text"), F.lit(False).alias("all_bold"), (F.lit(top) + 14 * F.col("nth")).cast("double").alias("top"))
    lines = lines.unionByName(item(100, F.concat(F.lit("1. Nation "), F.col("n_nationkey").cast("string")), 100.0)).unionByName(item(1000, F.col("n_name"), 2000.0))
    lines = lines.select("doc", F.lit(1).alias("page"), "line", "top", (F.col("top") + 11).alias("bottom"), "text", F.lit(11.0).alias("size"), "all_bold", F.length("text").alias("n_chars"))
    cells = F.concat(F.array(F.array(F.lit("Key"), F.lit("Nation"))), F.transform("x", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    tables = a.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x")).select("doc", F.lit(1).alias("page"), F.lit(2000.0).alias("top"), F.lit(9000.0).alias("bottom"), cells.alias("rows"))
    return pdf_layout.pdf_markdown(lines, tables)
