"""The library's queries over the driver tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as tx
from ..operators import briefing, chunking, dialogue, layout, sections, service, state, vectors
from ..sources import tables
from ..sources.tables import read, search_catalogue
from . import flows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return STRIP.format(x)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# vectors

SCORES = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id, e.label, q.ql,
             round(list_dot_product(CAST(q.qe AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
                   / sqrt(list_dot_product(CAST(q.qe AS DOUBLE[]), CAST(q.qe AS DOUBLE[])))
                   / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS score
      FROM q CROSS JOIN embeddings e)
"""


def probes(emb: DataFrame, every: int = 100, with_label: bool = False) -> list[tuple]:
    """The stated query set: vectors whose id is divisible by ``every``."""
    rows = emb.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", "label").orderBy("vec_id").collect()
    return [(r[0], r[1], r[2]) if with_label else (r[0], r[1]) for r in rows]


def hits(spark: SparkSession, sf_dir: str, k: int, **options) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return vectors.search(emb, probes(emb, with_label="collection_col" in options), k, id_col="vec_id", **options)


@query(SCORES + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s WHERE query_id = 0)
SELECT vec_id, score, row_number() OVER (ORDER BY vec_id) AS passage FROM r WHERE rank <= 5 AND score >= 0.3""")
def vec_topk_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to vector 0, those over the floor, in document order."""
    emb = read(spark, sf_dir, "embeddings")
    found = vectors.search(emb, probes(emb.where("vec_id = 0")), Settings().top_k, id_col="vec_id")
    kept = vectors.floor_and_dedupe(found, Settings().min_similarity, F.col("vec_id").cast("string"), order_col="vec_id")
    return kept.select("vec_id", "score", F.col("passage").cast("long").alias("passage"))


@query(SCORES + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def vec_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, 5).withColumn("rank", F.col("rank").cast("long"))


@query(SCORES + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label IN (1, 3))
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def vec_topk_where_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, 5, where=F.col("label").isin(1, 3)).withColumn("rank", F.col("rank").cast("long"))


@query(SCORES + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label = ql)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def vec_topk_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query searches the collection it belongs to."""
    return hits(spark, sf_dir, 5, collection_col="label").withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id AS id, round(list_dot_product(CAST(q.qe AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
      FROM q CROSS JOIN embeddings e WHERE e.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, CASE WHEN max(score) FILTER (rank = 1) >= 0.35 THEN max(id) FILTER (rank = 1) END AS selected,
       max(score) FILTER (rank = 1) AS score,
       CASE WHEN max(score) FILTER (rank = 1) < 0.35 THEN 'confirm_with_user' ELSE 'proceed' END AS action,
       CASE WHEN max(score) FILTER (rank = 1) < 0.35 THEN array_to_string(list(id ORDER BY rank) FILTER (rank <= 3), ',') END AS candidates
FROM r WHERE rank <= 5 GROUP BY query_id""")
def rank_select_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other vectors ranked by raw products; below the confidence the best three are listed instead."""
    emb = read(spark, sf_dir, "embeddings")
    # one more than asked for, since a query may find itself
    found = vectors.search(emb, probes(emb), Settings().rerank_pool + 1, id_col="vec_id", metric="dot").withColumnRenamed("vec_id", "id").where("id <> query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    out = vectors.choose(found, confidence=Settings().confidence, pool=Settings().rerank_pool)
    return out.withColumn("candidates", F.array_join("candidates", ","))


@query("SELECT label, count(*) AS n, min(vec_id) AS first_id, max(len(embedding)) AS dim FROM embeddings GROUP BY label")
def vec_collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return emb.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max(F.size("embedding")).cast("long").alias("dim"))


@query("""
WITH c AS (SELECT doc_id % 10 AS paper_id, count(*) AS n_chunks FROM documents GROUP BY 1), v AS (SELECT label AS paper_id, count(*) AS n_vectors FROM embeddings GROUP BY 1)
SELECT c.paper_id, n_chunks, coalesce(n_vectors, 0) AS n_vectors FROM c LEFT JOIN v USING (paper_id) WHERE n_chunks <> coalesce(n_vectors, 0)""")
def stale_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("paper_id"))
    return vectors.stale_collections(chunks, read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("paper_id")))


# names, identifiers, queries


@query(r"""SELECT page_id, regexp_replace(substr('paper_' || regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 63), '[^A-Za-z0-9]+$', '') AS name,
coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug, replace(url, '/', '_') || '.pdf' AS file FROM pages""")
def collection_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", tx.collection_name(u).alias("name"), tx.slug(u).alias("slug"), tx.file_name(u).alias("file"))


MENTIONS = """CASE doc_id % 5 WHEN 0 THEN 'see 2' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '.12345v2 there' WHEN 1 THEN 'math.GT/0' || lpad(CAST(doc_id AS VARCHAR), 6, '0')
WHEN 2 THEN 'https://arxiv.org/abs/2301.0' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || 'v3' WHEN 3 THEN 'value 3.14159 and more' ELSE '' END"""


def mentions(docs: DataFrame) -> DataFrame:
    """Documents with an identifier of some form made from their id."""
    n = F.col("doc_id")
    pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
    made = (
        F.when(n % 5 == 0, F.concat(F.lit("see 2"), pad(n % 1000, 3), F.lit(".12345v2 there")))
        .when(n % 5 == 1, F.concat(F.lit("math.GT/0"), pad(n, 6)))
        .when(n % 5 == 2, F.concat(F.lit("https://arxiv.org/abs/2301.0"), pad(n % 10000, 4), F.lit("v3")))
        .when(n % 5 == 3, "value 3.14159 and more")
        .otherwise("")
    )
    return docs.select("doc_id", made.alias("said"))


ID_SQL = f"""WITH m AS (SELECT doc_id, {MENTIONS} AS said FROM documents),
f AS (SELECT doc_id, said, coalesce(nullif(regexp_extract(said, '(?i)(?:https?://)?(?:www\\.)?(?:export\\.)?arxiv\\.org/(?:abs|pdf)/([^\\s?#]+)', 1), ''),
  nullif(regexp_extract(said, '(?:^|[^\\w./])([a-zA-Z-]+(?:\\.[a-zA-Z]{{2,3}})?/\\d{{7}}(?:v\\d+)?)(?:$|[^\\w])', 1), ''),
  nullif(regexp_extract(said, '(?:^|[^\\w.])(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)(?:$|[^\\w.])', 1), '')) AS raw FROM m),
n AS (SELECT doc_id, said, regexp_replace(raw, 'v\\d+$', '') AS bare FROM f),
i AS (SELECT doc_id, said, CASE WHEN bare LIKE '%/%' THEN lower(split_part(bare, '/', 1)) || substr(bare, strpos(bare, '/')) ELSE bare END AS paper_id FROM n)
"""


@query(ID_SQL + "SELECT doc_id, said, paper_id FROM i")
def extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(read(spark, sf_dir, "documents")).withColumn("paper_id", tx.paper_id(F.col("said")))


@query(ID_SQL + "SELECT doc_id, CASE WHEN said = '' THEN 'unknown' WHEN paper_id IS NOT NULL THEN 'paper_lookup' ELSE 'topic_search' END AS intent FROM i")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(read(spark, sf_dir, "documents")).select("doc_id", tx.intent(F.col("said")).alias("intent"))


WORDS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
REWRITE = f"""WITH t AS (SELECT item_id, text, list_filter(list_transform(string_split({COLLAPSE.format('text')}, ' '), lambda w: lower(trim(w, '.,;:!?"''()'))), lambda w: w <> '' AND w NOT IN ({WORDS})) AS terms FROM benchmark),
q AS (SELECT item_id, CASE WHEN len(terms) = 0 THEN 'all:"' || {strip_sql('text')} || '"' ELSE array_to_string(list_transform(range(1, len(terms) + 1, 2),
  lambda i: CASE WHEN i < len(terms) THEN 'all:"' || terms[i] || ' ' || terms[i + 1] || '"' ELSE 'all:' || terms[i] END), ' AND ') END AS query FROM t),
b AS (SELECT item_id, query, string_split(query, ' AND ') AS parts FROM q),
w AS (SELECT item_id, query, replace(array_to_string(CASE WHEN len(parts) > 1 THEN parts[1:len(parts) - 1] ELSE parts END, ' AND '), '"', '') AS broader FROM b)
"""


@query(REWRITE + "SELECT item_id, query, broader FROM w")
def rewrite_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "benchmark").select("item_id", tx.boolean_query(F.col("text")).alias("query"))
    return out.withColumn("broader", tx.broaden(F.col("query")))


TOPICS = (("q0", "all:trash"), ("q1", 'all:"the inst" AND all:of'), ("q2", "all:license AND all:public"), ("q3", 'all:"no such phrase" AND all:license'))
TOPIC_VALUES = ", ".join(f"('{n}', '{q}')" for n, q in TOPICS)
SEARCH = """
WITH q(query_id, query) AS (VALUES {values}),
first AS (SELECT query_id, list_transform(string_split(query, ' AND '), lambda t: lower(replace(regexp_replace(t, '^all:', ''), '"', ''))) AS terms FROM q),
d AS (SELECT doc_id AS paper_id, lower(source || ' ' || text) AS text FROM documents),
hit AS (SELECT query_id, paper_id, CAST(list_sum(list_transform(terms, lambda t: (length(text) - length(replace(text, t, ''))) // length(t))) AS BIGINT) AS score
        FROM first CROSS JOIN d WHERE len(list_filter(terms, lambda t: NOT contains(text, t))) = 0)
"""


def catalogue_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), F.col("text").alias("abstract"))


def topics(spark: SparkSession) -> DataFrame:
    asked = spark.createDataFrame([list(t) for t in TOPICS], "query_id string, query string")
    return asked.withColumn("terms", tx.search_terms(F.col("query")))


@query(SEARCH.format(values=TOPIC_VALUES) + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM hit)
SELECT query_id, paper_id, score, rank FROM r WHERE rank <= 20""")
def term_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_catalogue(catalogue_papers(spark, sf_dir), topics(spark), Settings().max_results).withColumn("rank", F.col("rank").cast("long"))


@query(SEARCH.format(values=TOPIC_VALUES) + r""", missed AS (SELECT query_id, query FROM q WHERE query_id NOT IN (SELECT query_id FROM hit)),
parts AS (SELECT query_id, string_split(query, ' AND ') AS p FROM missed),
again AS (SELECT query_id, list_transform(CASE WHEN len(p) > 1 THEN p[1:len(p) - 1] ELSE p END, lambda t: lower(replace(regexp_replace(t, '^all:', ''), '"', ''))) AS terms FROM parts),
hit2 AS (SELECT a.query_id, d.paper_id FROM again a CROSS JOIN d WHERE len(list_filter(terms, lambda t: NOT contains(text, t))) = 0)
SELECT q.query_id, (SELECT count(*) FROM hit h WHERE h.query_id = q.query_id) AS hits, (SELECT count(*) FROM hit2 h WHERE h.query_id = q.query_id) AS retry_hits FROM q""")
def zero_hit_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics without any hit are broadened once and searched again."""
    papers, asked = catalogue_papers(spark, sf_dir), topics(spark)
    every = 2**31 - 1
    first = search_catalogue(papers, asked, every).groupBy("query_id").agg(F.count("*").alias("hits"))
    missed = asked.join(first, "query_id", "left_anti").select("query_id", tx.search_terms(tx.broaden(F.col("query"))).alias("terms"))
    second = search_catalogue(papers, missed, every).groupBy("query_id").agg(F.count("*").alias("retry_hits"))
    return asked.select("query_id").join(first, "query_id", "left").join(second, "query_id", "left").na.fill(0, ["hits", "retry_hits"])


# cleaning and quality


@query(rf"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
c AS (SELECT *, {strip_sql('line')} AS bare, count(*) OVER (PARTITION BY doc_id, {strip_sql('line')}) AS n FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (bare = '' OR NOT ((n >= 3 AND length(bare) BETWEEN 3 AND 120) OR regexp_full_match(bare, '\d{{1,4}}'))) AS t FROM c GROUP BY doc_id)
SELECT doc_id, {strip_sql("regexp_replace(regexp_replace(coalesce(t, ''), '[ ' || chr(9) || ']+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM k""")
def drop_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


SICK = "'demon-' || chr(10) || 'stration of con' || chr(64257) || 'guration  ' || chr(10) || chr(10) || chr(10) || chr(10) || text"
FIXED = rf"regexp_replace(replace(replace({SICK}, chr(64257), 'fi'), chr(64258), 'fl'), '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"


@query(f"""SELECT doc_id, {strip_sql(f"regexp_replace(regexp_replace({FIXED}, '[ ' || chr(9) || ']+', ' ', 'g'), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS text FROM documents""")
def repair_and_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sick = F.concat(F.lit("demon-\nstration of conﬁguration  \n\n\n\n"), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", tx.tidy(tx.repair(sick)).alias("text"))


QUALITY = r"""CASE WHEN regexp_replace(text, '\s', '', 'g') = '' THEN 0.0 ELSE round(0.35 * least(length(text) / 1500.0::DOUBLE, 1.0) + 0.35 * (length(regexp_replace(text, '[^\pL]', '', 'g')) / length(text)::DOUBLE)
 + 0.15 * (CASE WHEN regexp_matches(text, '(?i)\babstract\b') THEN 1.0 ELSE 0.0 END)
 + 0.15 * greatest(0.0, 1.0 - abs((length(text) - length(regexp_replace(text, '\s', '', 'g'))) / length(text)::DOUBLE - 0.18::DOUBLE) / 0.18::DOUBLE), 4) END"""


@query(f"SELECT doc_id, CAST({QUALITY} AS DOUBLE) AS quality FROM documents")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.quality(F.col("text"), F.lit(1)).alias("quality"))


@query(f"""WITH s AS (SELECT l.quality AS label, CAST({QUALITY.replace('text', 'd.text')} AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id))
SELECT label, count(*) AS n, round(avg(score), 3) AS mean_score, count(*) FILTER (score < 0.4) AS poor FROM s GROUP BY label""")
def quality_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", tx.quality(F.col("text"), F.lit(1)).alias("score"))
    both = docs.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return both.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean_score"), F.count_if(F.col("score") < Settings().min_quality).alias("poor"))


# pages, sections, references: made from documents, whose lines are dealt to pages of six

PAGES = """p AS (SELECT doc_id AS paper_id, CAST((pos - 1) // 6 AS INTEGER) AS page_no, string_agg(CASE WHEN (pos - 1) % 4 = 0 THEN CAST((pos - 1) // 4 + 1 AS VARCHAR) || ' Results ' || line ELSE line END, chr(10) ORDER BY pos) AS text
FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) GROUP BY ALL)"""


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    headed = F.when(F.col("pos") % 4 == 0, F.concat(F.floor(F.col("pos") / 4) + 1, F.lit(" Results "), F.col("line"))).otherwise(F.col("line"))
    paged = lines.groupBy("paper_id", F.floor(F.col("pos") / 6).cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("pos", headed.alias("line")))).alias("all"))
    return paged.select("paper_id", "page_no", F.array_join(F.transform("all", lambda s: s["line"]), "\n").alias("text"))


@query(f"""WITH {PAGES} SELECT paper_id, page_no FROM p WHERE page_no < 1 OR regexp_matches(substr(text, 1, 200), '(?i)^\\s*(?:\\d+(?:\\.\\d+)*\\s+)?(conclusion|conclusions|discussion|results)\\b')""")
def truncate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.truncate_pages(made_pages(spark, sf_dir), 1).select("paper_id", "page_no")


OFFSETS = "o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY paper_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p)"


@query(f"""WITH {PAGES}, {OFFSETS}, asked AS (SELECT doc_id AS paper_id, k AS mark, CAST(k * 700 AS BIGINT) AS pos FROM documents, generate_series(0, 3) AS g(k))
SELECT a.paper_id, a.mark, a.pos, max(o.page_no) AS page_no FROM asked a JOIN o ON a.paper_id = o.paper_id AND o.off <= a.pos GROUP BY ALL""")
def offset_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)]))
    asked = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), marks.alias("mark")).withColumn("pos", F.col("mark") * 700)
    return sections.page_of(asked, made_pages(spark, sf_dir))


LINES = """ls AS (SELECT paper_id, page_no, off, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT paper_id, page_no, off, string_split(text, chr(10)) AS l FROM o)),
ln AS (SELECT paper_id, page_no, line, CAST(off + coalesce(sum(length(line) + 1) OVER (PARTITION BY paper_id, page_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM ls),
hd AS (SELECT paper_id, page_no, pos, regexp_extract(line, '^(\\d+(?:\\.\\d+)*)\\s+([A-Z].{0,100})$', 1) AS num, regexp_extract(line, '^(\\d+(?:\\.\\d+)*)\\s+([A-Z].{0,100})$', 2) AS rest FROM ln
       WHERE regexp_matches(line, '^(\\d+(?:\\.\\d+)*)\\s+([A-Z].{0,100})$')),
ok AS (SELECT *, num || ' ' || trim(rest) AS title FROM hd WHERE CAST(split_part(num, '.', 1) AS BIGINT) <= 20 AND NOT regexp_matches(num, '\\.0\\d') AND NOT regexp_matches(rest, '\\bet al\\.|\\(\\d{4}[a-z]?\\)|\\[\\d+\\]\\s*$'))"""


@query(f"WITH {PAGES}, {OFFSETS}, {LINES} SELECT paper_id, page_no, pos, title, CAST(len(string_split(num, '.')) AS INTEGER) AS level FROM ok")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.heading_candidates(sections.text_lines(made_pages(spark, sf_dir)))
    return found.where("priority = 0").select("paper_id", "page_no", "pos", "title", "level")


@query(f"""WITH {PAGES}, {OFFSETS}, {LINES}, f AS (SELECT paper_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS full_text, min(page_no) AS first_page FROM p GROUP BY 1),
s AS (SELECT *, lead(pos) OVER (PARTITION BY paper_id ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1 AS sp, count(*) OVER (PARTITION BY paper_id) AS n FROM ok),
j AS (SELECT f.paper_id, f.full_text, f.first_page, s.* EXCLUDE (paper_id), substr(f.full_text, CAST(s.pos AS BIGINT) + 1, CAST(coalesce(s.nxt, length(f.full_text)) - s.pos AS BIGINT)) AS piece FROM f LEFT JOIN (SELECT * FROM s WHERE n >= 3) s ON f.paper_id = s.paper_id)
SELECT paper_id, CAST(coalesce(sp, 0) AS INTEGER) AS section_pos, CASE WHEN pos IS NULL THEN 'Full Text' ELSE title END AS title,
md5(CASE WHEN pos IS NULL THEN {strip_sql('full_text')} WHEN strpos(piece, chr(10)) > 0 THEN {strip_sql('substr(piece, strpos(piece, chr(10)) + 1)')} ELSE '' END) AS text_md5, CAST(coalesce(page_no, first_page) AS INTEGER) AS start_page FROM j""")
def build_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.detect_sections(made_pages(spark, sf_dir))
    return found.select("paper_id", F.col("section_pos").cast("int").alias("section_pos"), "title", F.md5("text").alias("text_md5"), F.col("start_page").cast("int").alias("start_page"))


@query(f"""WITH t AS (SELECT doc_id, {strip_sql("list_reduce(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 2 = 1 THEN '[' || CAST(i AS VARCHAR) || '] ' || l ELSE l END), lambda a, b: a || chr(10) || b)")} AS t FROM documents),
e AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '(?m)^\\s*\\[\\d+\\]\\s*')[2:], lambda x: {COLLAPSE.format('x')}), lambda x: x <> '') AS es FROM t)
SELECT doc_id, CAST(len(es) AS INTEGER) AS n, md5(array_to_string(es, '|')) AS entries FROM e""")
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("["), i + 1, F.lit("] "), x)).otherwise(x)), "\n")
    found = read(spark, sf_dir, "documents").select("doc_id", sections.reference_entries(marked).alias("es"))
    return found.select("doc_id", F.size("es").alias("n"), F.md5(F.array_join("es", "|")).alias("entries"))


@query("""WITH s AS (SELECT doc_id // 10 AS paper_id, doc_id % 10 AS section_pos, CASE WHEN doc_id % 10 = 6 AND (doc_id // 10) % 3 = 0 THEN '7 References' WHEN doc_id % 10 = 8 THEN 'Appendix' ELSE source END AS title FROM documents),
c AS (SELECT *, min(section_pos) FILTER (title IN ('7 References', 'Appendix')) OVER (PARTITION BY paper_id) AS cut FROM s)
SELECT paper_id, count(*) FILTER (cut IS NULL OR section_pos < cut) AS body, count(*) FILTER (section_pos >= cut AND title = '7 References') AS refs FROM c GROUP BY 1""")
def split_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    paper, pos = F.floor(n / 10).alias("paper_id"), n % 10
    title = F.when((pos == 6) & (F.floor(n / 10) % 3 == 0), "7 References").when(pos == 8, "Appendix").otherwise(F.col("source"))
    made = read(spark, sf_dir, "documents").select(paper, pos.alias("section_pos"), title.alias("title"), "text")
    body, refs = sections.split_references(made)
    count = lambda df, name: df.groupBy("paper_id").agg(F.count("*").alias(name))
    every = made.select("paper_id").distinct()
    return every.join(count(body, "body"), "paper_id", "left").join(count(refs, "refs"), "paper_id", "left").na.fill(0, ["body", "refs"])


# layout: a block a line, at places made from its number and length

BLOCKS = """b AS (SELECT doc_id AS paper_id, CAST(0 AS INTEGER) AS page_no, line AS text, k, CAST(CASE WHEN doc_id % 2 = 0 AND k % 2 = 0 THEN 300 ELSE 40 END + length(line) % 3 AS DOUBLE) AS x0, CAST((k // 2) * 12 + doc_id % 7 AS DOUBLE) AS y0
FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE regexp_replace(line, '\\s', '', 'g') <> ''),
g AS (SELECT *, lead(x0) OVER (PARTITION BY paper_id ORDER BY x0, k) - x0 AS gap, row_number() OVER (PARTITION BY paper_id ORDER BY x0, k) AS r FROM b),
w AS (SELECT paper_id, max(gap) AS mg, arg_max(x0 + gap / 2, (gap, -r)) FILTER (gap IS NOT NULL) AS mid, arg_max(r, (gap, -r)) FILTER (gap IS NOT NULL) AS nl, count(*) AS n, max(x0) - min(x0) AS span FROM g GROUP BY 1),
sp AS (SELECT paper_id, CASE WHEN n >= 4 AND span > 0 AND mg >= span * 0.25 AND nl >= 2 AND n - nl >= 2 THEN mid END AS split FROM w)"""


def made_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.regexp_replace("line", r"\s", "") != "").withColumn("k", F.col("p") + 1)
    x0 = F.when((F.col("doc_id") % 2 == 0) & (F.col("k") % 2 == 0), 300).otherwise(40) + F.length("line") % 3
    return lines.select(F.col("doc_id").alias("paper_id"), F.lit(0).alias("page_no"), x0.cast("double").alias("x0"), (F.floor(F.col("k") / 2) * 12 + F.col("doc_id") % 7).cast("double").alias("y0"), F.col("line").alias("text"), F.lit(0).alias("block_type"), "k")


@query(f"WITH {BLOCKS} SELECT paper_id, split FROM sp")
def bimodal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_split(made_blocks(spark, sf_dir)).select("paper_id", "split")


@query(f"""WITH {BLOCKS}, o AS (SELECT b.paper_id, k, row_number() OVER (PARTITION BY b.paper_id ORDER BY CASE WHEN x0 >= split THEN 1 ELSE 0 END, y0, x0, k) AS ord FROM b JOIN sp USING (paper_id))
SELECT paper_id, md5(string_agg(CAST(x0 AS INTEGER) || ',' || CAST(y0 AS INTEGER), ' ' ORDER BY ord)) AS places FROM o JOIN b USING (paper_id, k) GROUP BY 1""")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = layout.reading_order(made_blocks(spark, sf_dir))
    place = F.concat_ws(",", F.col("x0").cast("int").cast("string"), F.col("y0").cast("int").cast("string"))
    return ordered.groupBy("paper_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", place.alias("at")))), lambda s: s["at"]), " ")).alias("places"))


@query(r"""WITH l AS (SELECT doc_id AS paper_id, line AS text, k - 1 AS line_no, CAST(9 + (k * 7 + doc_id) % 11 AS DOUBLE) AS size FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
m AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS title, median(size) OVER (PARTITION BY paper_id) AS med FROM l WHERE regexp_replace(text, '\s', '', 'g') <> '')
SELECT paper_id, title, CAST(min(line_no) AS INTEGER) AS line_no FROM m WHERE size >= med * 1.25 AND length(title) BETWEEN 3 AND 100 GROUP BY ALL""")
def font_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return layout.font_headings(lines.withColumn("size", (9 + ((F.col("line_no") + 1) * 7 + F.col("paper_id")) % 11).cast("double")))


@query(f"""WITH v AS (SELECT page_id, 0 AS engine, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages UNION ALL SELECT page_id, 1, regexp_replace(regexp_replace(html, '(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', '', 'g'), '<[^>]*>', '', 'g') FROM pages),
s AS (SELECT page_id, engine, text, CAST({QUALITY} AS DOUBLE) AS quality FROM v), f AS (SELECT *, max(quality) FILTER (engine = 0) OVER (PARTITION BY page_id) AS q0 FROM s)
SELECT page_id, arg_max(engine, (CASE WHEN engine = 1 AND q0 >= 0.7 THEN -1.0 ELSE quality END, -engine)) AS engine, arg_max(quality, (CASE WHEN engine = 1 AND q0 >= 0.7 THEN -1.0 ELSE quality END, -engine)) AS quality FROM f GROUP BY page_id""")
def best_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to take the text from a page; the second counts where the first is poor."""
    html = F.col("html")
    bare = F.regexp_replace(html, "<[^>]*>", " ")
    main = F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", ""), "<[^>]*>", "")
    both = read(spark, sf_dir, "pages").select("page_id", F.explode(F.array(F.struct(F.lit(0).alias("engine"), bare.alias("text")), F.struct(F.lit(1).alias("engine"), main.alias("text")))).alias("v")).select("page_id", "v.engine", "v.text")
    scored = both.withColumn("quality", tx.quality(F.col("text"), F.lit(1)))
    return layout.better_extraction(scored, 0.7).select("page_id", "engine", "quality")


# chunks

PIECES = rf"""a AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p1, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p2 FROM documents),
pc AS (SELECT doc_id, text, flatten(list_transform(CASE WHEN len(p1) > 1 THEN p1 ELSE p2 END, lambda p: CASE WHEN length(p) <= 1000 THEN [p] ELSE
  flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip_sql('s')}), lambda s: s <> ''), lambda s: list_transform(range(0, length(s), 1000), lambda i: substr(s, i + 1, 1000)))) END)) AS ps FROM a),
sp AS (SELECT doc_id, text, list_reduce(ps, lambda acc, x: {{'cur': acc.cur + strpos(substr(text, acc.cur + 1), x) - 1 + length(x), 'spans': list_append(acc.spans, {{'s': acc.cur + strpos(substr(text, acc.cur + 1), x) - 1, 'e': acc.cur + strpos(substr(text, acc.cur + 1), x) - 1 + length(x)}})}},
  {{'cur': CAST(0 AS BIGINT), 'spans': CAST([] AS STRUCT(s BIGINT, e BIGINT)[])}}).spans AS spans FROM pc WHERE len(ps) > 0),
fo AS (SELECT doc_id, text, list_reduce(spans, lambda acc, x: CASE WHEN acc.e > acc.s AND x.e - acc.s > 1000 THEN {{'s': greatest(acc.e - 150, 0), 'e': x.e, 'out': list_append(acc.out, {{'s': acc.s, 'e': acc.e}})}} ELSE {{'s': acc.s, 'e': x.e, 'out': acc.out}} END,
  {{'s': spans[1].s, 'e': spans[1].s, 'out': CAST([] AS STRUCT(s BIGINT, e BIGINT)[])}}) AS st FROM sp),
ch AS (SELECT doc_id, text, unnest(o) AS c, generate_subscripts(o, 1) - 1 AS pos FROM (SELECT doc_id, text, list_append(st.out, {{'s': st.s, 'e': st.e}}) AS o FROM fo))"""


@query(f"WITH {PIECES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(c.s AS INTEGER) AS char_start, CAST(c.e AS INTEGER) AS char_end FROM ch WHERE regexp_replace(substr(text, c.s + 1, c.e - c.s), '\\s', '', 'g') <> ''")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.chunk_spans(F.col("text"), 1000, 150)).alias("pos", "s"))
    return found.select("doc_id", "pos", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"))


@query(f"""WITH {PIECES}, k AS (SELECT ch.doc_id // 10 AS paper_id, ch.doc_id, pos, c, d.source AS title, {strip_sql('substr(ch.text, c.s + 1, c.e - c.s)')} AS body FROM ch JOIN documents d USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id, pos) - 1 AS i FROM k WHERE length('[' || title || '] ' || body) >= 50)
SELECT paper_id, title || '-' || CAST(i AS VARCHAR) AS chunk_id, md5('[' || title || '] ' || body) AS text_md5, CAST(i AS INTEGER) AS chunk_index, CAST(greatest(length(body) // 4, 1) AS INTEGER) AS token_estimate FROM n""")
def chunk_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents make a paper, its sections titled by their sources."""
    made = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("paper_id"), F.col("doc_id").alias("section_pos"), F.col("source").alias("title"), "text")
    return chunking.chunk_sections(made).select("paper_id", "chunk_id", F.md5("text").alias("text_md5"), "chunk_index", "token_estimate")


@query("""WITH few AS (SELECT doc_id AS paper_id, text FROM documents), c AS (SELECT paper_id FROM few WHERE length(text) >= 500)
SELECT paper_id, '[Abstract] ' || text AS text, CAST(greatest(length('[Abstract] ' || text) // 4, 1) AS INTEGER) AS token_estimate FROM few WHERE paper_id NOT IN (SELECT paper_id FROM c)""")
def chunk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers without chunks (here: texts under 500 characters) get one of their whole text."""
    docs = read(spark, sf_dir, "documents")
    made = docs.where(F.length("text") >= 500).select(F.col("doc_id").alias("paper_id"), F.lit(0).cast("long").alias("section_pos"), F.col("source").alias("title"), "text")
    out = chunking.with_abstract_fallback(chunking.chunk_sections(made), docs.select(F.col("doc_id").alias("paper_id"), F.col("text").alias("full_text")))
    return out.where("degraded").select("paper_id", "text", "token_estimate")


@query(r"""WITH k AS (SELECT doc_id, n_chars, substr(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 1, 120) AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) AS nth FROM k) SELECT doc_id, n_chars FROM r WHERE nth = 1""")
def prefix_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", tx.prefix_key(F.col("text")).alias("key"))
    best = docs.groupBy("key").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("first"))).alias("b"))
    return best.select((-F.col("b.first")).alias("doc_id"), F.col("b.n_chars").alias("n_chars"))


# dialogue

TURNS = """n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id AS session_id, turn AS turn_no, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM n WHERE role = 'user')"""


def made_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.turns(read(spark, sf_dir, "conversations"))


@query(f"""WITH {TURNS}, l AS (SELECT *, lag(question) OVER (PARTITION BY session_id ORDER BY turn_no) AS prev, 'And it? ' || left(question, 9) || '.' AS q FROM t)
SELECT session_id, turn_no, CASE WHEN prev IS NOT NULL AND len(string_split({COLLAPSE.format('q')}, ' ')) < 8 AND regexp_matches(q, '(?i)\\b(it|this|that|they)\\b') THEN regexp_replace(q, '[?.! ]+$', '') || ' - referring to: ' || prev ELSE q END AS resolved FROM l""")
def pronoun_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's questions, shortened to a follow-up with a pronoun."""
    before = F.lag("question").over(Window.partitionBy("session_id").orderBy("turn_no"))
    short = F.concat(F.lit("And it? "), F.substring("question", 1, 9), F.lit("."))
    return made_turns(spark, sf_dir).select("session_id", "turn_no", tx.pronoun_question(short, before).alias("resolved"))


@query(f"""WITH {TURNS}, h AS (SELECT session_id, turn_no, list('Q: ' || question || chr(10) || 'A: ' || coalesce(answer, '')) OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS past FROM t)
SELECT session_id, turn_no, coalesce(array_to_string(past, chr(10) || chr(10)), '(no prior questions)') AS history FROM h""")
def history_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.with_history(made_turns(spark, sf_dir)).select("session_id", "turn_no", "history")


@query(f"WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS nth FROM t) SELECT session_id, turn_no FROM r WHERE nth <= 2")
def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.last_turns(made_turns(spark, sf_dir), 2).select("session_id", "turn_no")


PASSAGES = SCORES + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
ps AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS passage, 'part ' || label AS section_title, 'vector ' || vec_id AS text, vec_id FROM r WHERE rank <= 5 AND score >= 0.25)
"""


def made_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    kept = vectors.floor_and_dedupe(hits(spark, sf_dir, 5), 0.25, F.col("vec_id").cast("string"), order_col="vec_id")
    named = kept.join(emb.select("vec_id", "label"), "vec_id")
    return named.select("query_id", "passage", F.concat(F.lit("part "), F.col("label")).alias("section_title"), F.concat(F.lit("vector "), F.col("vec_id")).alias("text"), "vec_id")


@query(PASSAGES + "SELECT query_id, CAST(count(*) AS INTEGER) AS n_passages, string_agg('[' || passage || '] (' || section_title || ') ' || text, chr(10) || chr(10) ORDER BY passage) AS passages FROM ps GROUP BY 1")
def passages_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.format_passages(made_passages(spark, sf_dir)).select("query_id", "n_passages", "passages")


@query(PASSAGES + ", c AS (SELECT DISTINCT query_id, unnest([2, 1, query_id % 7, 2]) AS passage FROM ps) SELECT query_id, CAST(passage AS INTEGER) AS passage, section_title, vec_id FROM c JOIN ps USING (query_id, passage)")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = made_passages(spark, sf_dir)
    said = F.concat(F.lit("First [2] and [1], then ["), F.col("query_id") % 7, F.lit("] and [2]."))
    answers = found.select("query_id").distinct().withColumn("answer", said)
    return dialogue.cited_sources(answers, found).select("query_id", F.col("passage").cast("int").alias("passage"), "section_title", "vec_id")


@query(PASSAGES + """, g AS (SELECT query_id, string_agg('[' || passage || '] (' || section_title || ') ' || text, chr(10) || chr(10) ORDER BY passage) AS passages, list(section_title ORDER BY passage) AS st FROM ps WHERE query_id % 500 <> 0 GROUP BY 1),
u AS (SELECT q.query_id, g.passages, g.st, (q.query_id // 100) % 4 AS k FROM q LEFT JOIN g USING (query_id))
SELECT query_id, CASE WHEN passages IS NULL THEN 'I couldn''t find that in this paper.' WHEN k = 0 THEN 'No LLM configured — showing the most relevant passages from the paper.' || chr(10) || chr(10) || passages WHEN k = 1 THEN 'Could not get an answer right now: busy'
 WHEN k = 2 THEN 'I couldn''t find that in this paper. Closest sections checked: ' || array_to_string(list_reduce(st, lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, CAST([] AS VARCHAR[])), ', ') || '.' ELSE 'It is so [1].' END AS answer,
 passages IS NOT NULL AND k IN (0, 3) AS grounded FROM u""")
def answer_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outcomes of a question, by the query's number."""
    every = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    shown = dialogue.format_passages(made_passages(spark, sf_dir).where("query_id % 500 <> 0"))
    k = F.floor(F.col("query_id") / 100) % 4
    told = dialogue.answer_ladder(F.col("n_passages"), F.when(k == 0, "none").otherwise("model"), F.when(k == 2, "So NOT_IN_PAPER.").otherwise("It is so [1]."), F.when(k == 1, "busy"), F.col("passages"), F.col("sections"))
    return every.join(shown, "query_id", "left").select("query_id", told.alias("t")).select("query_id", "t.answer", "t.grounded")


# briefings: ten documents make a paper, with titles by their place

TITLES = "['Abstract', '1 Introduction', 'Related Work', 'Methods and Results', 'Experiments', 'Discussion', 'Notes', 'Conclusion', 'Data', 'References']"
SECTIONS = f"sc AS (SELECT doc_id // 10 AS paper_id, CAST(doc_id % 10 AS INTEGER) AS section_pos, CASE WHEN (doc_id // 10) % 5 = 0 THEN 'Part ' || (doc_id % 10) ELSE {TITLES}[doc_id % 10 + 1] END AS title, text FROM documents)"


def made_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    names = F.array(*[F.lit(t) for t in ("Abstract", "1 Introduction", "Related Work", "Methods and Results", "Experiments", "Discussion", "Notes", "Conclusion", "Data", "References")])
    pos, paper = (n % 10).cast("int"), F.floor(n / 10)
    return read(spark, sf_dir, "documents").select(paper.alias("paper_id"), pos.alias("section_pos"), F.when(paper % 5 == 0, F.concat(F.lit("Part "), pos)).otherwise(F.get(names, pos)).alias("title"), "text")


PICKED = SECTIONS + """, pk AS (SELECT paper_id, section_pos, CASE WHEN title LIKE 'Part%' THEN section_pos ELSE list_position([0, 1, 3, 4, 5], section_pos) - 1 END AS priority, title, text FROM sc
WHERE title LIKE 'Part%' OR section_pos IN (0, 1, 3, 4, 5))"""


@query(f"WITH {PICKED} SELECT paper_id, section_pos, CAST(priority AS INTEGER) AS priority, title FROM pk")
def section_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods and Results serves the methods only: results are those of the next section that fits."""
    return briefing.priority_sections(made_sections(spark, sf_dir)).select("paper_id", "section_pos", "priority", "title")


ENDS = """CASE WHEN length({t}) <= {b} THEN {t} WHEN length({t}) - length(replace({t}, chr(10) || chr(10), '')) = 0 THEN left({t}, ({b} - 19) // 2) || chr(10) || '...[truncated]...' || chr(10) || right({t}, ({b} - 19) // 2) END"""


@query(f"SELECT doc_id, {ENDS.format(t='text', b='400')} AS text FROM documents")
def truncate_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.keep_ends(F.col("text"), F.lit(400)).alias("text"))


@query(f"""WITH {PICKED}, c AS (SELECT *, count(*) OVER (PARTITION BY paper_id) AS n FROM pk), d AS (SELECT *, CAST(greatest(4000 // n, 200) AS BIGINT) AS b FROM c)
SELECT paper_id, count(*) AS n_sections, CAST(sum(length(text)) AS BIGINT) AS raw_chars, CASE WHEN count(*) > 1 AND sum(length(text)) > 8000 THEN 'map_reduce' ELSE 'single_pass' END AS strategy,
md5(string_agg('[' || title || ']' || chr(10) || {ENDS.format(t='text', b='b')}, chr(10) || chr(10) ORDER BY priority)) AS context_md5 FROM d GROUP BY 1""")
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = briefing.build_context(briefing.priority_sections(made_sections(spark, sf_dir)), Settings().budget_chars(5000))
    return out.select("paper_id", "n_sections", "raw_chars", "strategy", F.md5("context").alias("context_md5"))


def made_briefing() -> dict:
    """A briefing's fields, taken from a document's lines."""
    lines = F.split("text", "\n")
    first = lambda k: F.slice(lines, 1, k)
    return {
        "title": F.concat(F.lit("Paper "), F.col("doc_id")), "authors": F.array(F.col("source"), F.col("lang")), "paper_id": F.col("doc_id").cast("string"), "published": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")),
        "link": F.concat(F.lit("https://example.org/"), F.col("doc_id")), "why_it_matters": F.substring("text", 1, 600), "problem_statement": F.substring("text", 1, 80), "method": first(5), "key_results": first(2), "limitations": first(1), "followup_questions": first(4),
        "confidence_notes": F.when(F.col("doc_id") % 3 == 0, "Partial text."),
    }


BRIEF = rf"""b AS (SELECT doc_id, source, lang, substr(text, 1, 600) AS why, substr(text, 1, 80) AS problem, string_split(text, chr(10)) AS ls FROM documents),
v AS (SELECT *, len(list_filter(string_split_regex({strip_sql('why')}, '\s+'), lambda w: w <> '')) AS words, len(ls[1:5]) AS nm, len(ls[1:2]) AS nk, len(ls[1:4]) AS nf FROM b)"""


@query(f"""WITH {BRIEF} SELECT doc_id, array_to_string(list_filter([CASE WHEN words NOT BETWEEN 40 AND 200 THEN 'why_it_matters' END, CASE WHEN nm NOT BETWEEN 3 AND 8 THEN 'method' END, CASE WHEN nk < 2 THEN 'key_results' END, CASE WHEN nf NOT BETWEEN 3 AND 5 THEN 'followup_questions' END], lambda x: x IS NOT NULL), ',') AS violations FROM v""")
def briefing_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(briefing.violations(made_briefing()), ",").alias("violations"))


def _list_sql(k: int) -> str:
    return f"array_to_string(list_transform(ls[1:{k}], lambda x: '- ' || x), chr(10))"


NL = "chr(10)"
MARKDOWN = " || ".join([
    "'# Paper ' || doc_id", NL, NL, "'**Authors:** ' || source || ', ' || lang || '  '", NL, "'**arXiv ID:** ' || doc_id || '  '", NL, "'**Published:** ' || strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') || '  '", NL,
    "'**Link:** https://example.org/' || doc_id", NL, NL, f"CASE WHEN doc_id % 3 = 0 THEN '> **Note:** Partial text.' || {NL} || {NL} ELSE '' END",
    *[x for name, c in (("Why It Matters", "why"), ("Problem Statement", "problem"), ("Method", _list_sql(5)), ("Key Results", _list_sql(2)), ("Limitations", _list_sql(1)), ("Suggested Follow-up Questions", _list_sql(4))) for x in (f"'## {name}'", NL, NL, c, NL, NL)],
])


@query(f"WITH {BRIEF}, m AS (SELECT doc_id, {MARKDOWN} AS md FROM v) SELECT doc_id, left(md, length(md) - 1) AS markdown FROM m")
def render_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", briefing.render_markdown(made_briefing()).alias("markdown"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE props END AS object FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in responses: fenced, in prose, bare, or cut off."""
    k, p = F.col("event_id") % 4, F.col("props")
    said = F.when(k == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), p, F.lit(" as asked"))).when(k == 2, p).otherwise(F.concat(F.lit("So: "), F.substring(p, F.lit(1), F.length(p) - 1)))
    return read(spark, sf_dir, "events").select("event_id", tx.json_candidate(said).alias("object"))


# services and state


@query("""WITH r AS (SELECT event_id, sha256('model' || chr(0) || event_type || chr(0) || CAST(user_id AS VARCHAR)) AS key FROM events), c AS (SELECT DISTINCT key FROM r WHERE event_id % 10 = 0)
SELECT DISTINCT key FROM r WHERE key NOT IN (SELECT key FROM c)""")
def llm_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are not among every tenth event's."""
    asked = read(spark, sf_dir, "events").select("event_id", F.lit("model").alias("model"), F.col("event_type").alias("system"), F.col("user_id").cast("string").alias("user"))
    cache = asked.where("event_id % 10 = 0").select(service.cache_key(F.col("model"), F.col("system"), F.col("user")).alias("key")).distinct()
    return service.cache_misses(asked, cache).select("key")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS DOUBLE) / 1e10 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT user_id, event_id, k, t AS fin, 4.0::DOUBLE AS tokens, 0.0::DOUBLE AS wait FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, x.now_ + x.pause, CASE WHEN x.tk < 1 THEN 0.0::DOUBLE ELSE x.tk - 1 END, x.now_ + x.pause - e.t
FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1,
LATERAL (SELECT greatest(e.t, b.fin) AS now_, least(5.0::DOUBLE, b.tokens + (greatest(e.t, b.fin) - b.fin) * (5.0::DOUBLE / 60.0::DOUBLE)) AS tk) y,
LATERAL (SELECT y.now_, y.tk, CASE WHEN y.tk < 1 THEN (1 - y.tk) / (5.0::DOUBLE / 60.0::DOUBLE) ELSE 0.0::DOUBLE END AS pause) x)
SELECT user_id, event_id, round(wait, 3) AS wait FROM b""")
def token_bucket_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user under five requests a minute; the clock runs 10,000 times as fast."""
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e10
    calls = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), t.alias("t"))
    out = service.token_bucket(calls, Settings().requests_per_minute, key_col="user_id")
    return out.select("user_id", F.col("seq").alias("event_id"), F.round("wait", 3).alias("wait"))


@query("SELECT * FROM (VALUES (1, 0.0::DOUBLE, 0.0::DOUBLE), (2, 1.0, 1.0), (3, 2.0, 3.0), (4, 4.0, 7.0)) t(attempt, delay, elapsed)")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(service.retry_schedule(Settings().retry_delays), "attempt int, delay double, elapsed double")


UPDATES = """u AS (SELECT user_id AS thread_id, event_id AS seq, event_type = 'click' OR event_id % 3 = 0 AS has_a, event_id % 2 = 0 AS has_b, CASE WHEN event_id % 6 <> 0 THEN value END AS a, event_type AS b FROM events)"""


def made_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    named = F.array_compact(F.array(F.when((F.col("event_type") == "click") | (n % 3 == 0), F.lit("a")), F.when(n % 2 == 0, F.lit("b"))))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), n.alias("seq"), named.alias("set_fields"), F.when(n % 6 != 0, F.col("value")).alias("a"), F.col("event_type").alias("b"))


@query(f"""WITH {UPDATES} SELECT thread_id, max(seq) AS seq, max_by(CASE WHEN a IS NULL THEN NULL ELSE a END, CASE WHEN has_a THEN seq END) AS a, max_by(b, CASE WHEN has_b THEN seq END) AS b FROM
(SELECT thread_id, seq, has_a, has_b, a, b FROM u) GROUP BY thread_id""".replace("max_by(CASE WHEN a IS NULL THEN NULL ELSE a END, CASE WHEN has_a THEN seq END)", "list(a ORDER BY seq) FILTER (has_a)[-1]").replace("max_by(b, CASE WHEN has_b THEN seq END)", "list(b ORDER BY seq) FILTER (has_b)[-1]"))
def state_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each thread: fields that an update omits keep their values, explicit nulls don't."""
    return state.restore(state.merge_updates(made_updates(spark, sf_dir), ["a", "b"]))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'handle_error' ELSE 'search' END AS after_understand, CASE WHEN event_id % 3 = 0 THEN 'fetch_parse' WHEN event_id % 5 > 0 THEN 'select_paper' ELSE 'end' END AS after_search,
CASE WHEN event_id % 4 = 0 THEN 'end' ELSE 'fetch_parse' END AS after_select, CASE WHEN event_id % 4 = 1 THEN 'handle_error' ELSE 'summarize' END AS after_embed,
CASE WHEN event_id % 7 = 0 THEN 'e' || event_id WHEN event_type = 'click' THEN 'I couldn''t understand that as an arXiv ID, URL, or topic. Please provide a paper to look up or a topic to search for.' ELSE 'The agent could not complete this request.' END AS message FROM events""")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    intent = F.when(F.col("event_type") == "click", "unknown").otherwise("topic_search")
    action = F.when(n % 4 == 0, "confirm_with_user").when(n % 4 == 1, "error")
    next_ = state.route(intent, F.when(n % 3 == 0, n), n % 5, F.coalesce(action, F.lit("")))
    errors = F.when(n % 7 == 0, F.array(F.concat(F.lit("e"), n))).otherwise(F.array().cast("array<string>"))
    out = read(spark, sf_dir, "events").select("event_id", next_.alias("r"), F.element_at(state.with_error(errors, intent), -1).alias("message"))
    return out.select("event_id", "r.*", "message")


# queries that reach the operators which the ones above leave out


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, ' ', ' ' || chr(9)), '[ ' || chr(9) || ']+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def normalise_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.tidy(F.replace("text", F.lit(" "), F.lit(" \t"))).alias("text"))



@query("SELECT doc_id, text FROM documents")
def ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ligatures are put in place of their letters, and repaired to what was there."""
    sick = F.col("text")
    for sign, letters in tx.LIGATURES.items():
        sick = F.replace(sick, F.lit(letters), F.lit(sign))
    # a hyphen at a line's end would be repaired too, in the original
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.contains("text", F.lit("-\n")), F.col("text")).otherwise(tx.repair(sick)).alias("text"))


CLEAN = """text || chr(10) || 'Running Head' || chr(10) || '17' || chr(10) || 'of the de-' || chr(10) || 'sign' || chr(10) || ' Running Head' || chr(10) || 'con' || chr(64257) || 'ned' || chr(10) || 'Running Head ' || chr(10) || '2024' || chr(10) || '20245'"""


@query(rf"""WITH f AS (SELECT doc_id, regexp_replace(replace(replace({CLEAN}, chr(64257), 'fi'), chr(64258), 'fl'), '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS text FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM f)),
c AS (SELECT *, {strip_sql('line')} AS bare, count(*) OVER (PARTITION BY doc_id, {strip_sql('line')}) AS n FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (bare = '' OR NOT ((n >= 3 AND length(bare) BETWEEN 3 AND 120) OR regexp_full_match(bare, '\d{{1,4}}'))) AS t FROM c GROUP BY doc_id)
SELECT doc_id, {strip_sql("regexp_replace(regexp_replace(coalesce(t, ''), '[ ' || chr(9) || ']+', ' ', 'g'), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS text FROM k""")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning of texts with a running head, page numbers, a broken word and a ligature."""
    sick = F.concat("text", F.lit("\nRunning Head\n17\nof the de-\nsign\n Running Head\nconﬁned\nRunning Head \n2024\n20245"))
    return sections.clean_text(read(spark, sf_dir, "documents").select("doc_id", sick.alias("text")), "doc_id")


@query(f"WITH {PAGES}, {OFFSETS} SELECT paper_id, page_no, CAST(off AS BIGINT) AS start FROM o")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.page_offsets(made_pages(spark, sf_dir)).select("paper_id", "page_no", F.col("offset").cast("long").alias("start"))


# every fourth line is a numbered heading, every line after it a keyword, every line after that a large line

HEADED = """hp AS (SELECT doc_id AS paper_id, CAST(0 AS INTEGER) AS page_no, string_agg(CASE (pos - 1) % 4 WHEN 0 THEN CAST((pos - 1) // 4 + 1 AS VARCHAR) || ' Results ' || line WHEN 1 THEN ' related WORK : ' WHEN 2 THEN 'Large ' || CAST(pos % 3 AS VARCHAR) ELSE line END, chr(10) ORDER BY pos) AS text
FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) GROUP BY ALL),
hl AS (SELECT paper_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT paper_id, string_split(text, chr(10)) AS l FROM hp)),
hn AS (SELECT paper_id, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY paper_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM hl),
hc AS (SELECT paper_id, pos, regexp_extract(line, '^(\\d+)\\s+([A-Z].{0,100})$', 1) || ' ' || trim(regexp_extract(line, '^(\\d+)\\s+([A-Z].{0,100})$', 2)) AS title, 0 AS prio FROM hn
  WHERE regexp_matches(line, '^\\d+\\s+[A-Z].{0,100}$') AND CAST(regexp_extract(line, '^(\\d+)', 1) AS BIGINT) <= 20 AND NOT regexp_matches(line, '\\bet al\\.|\\(\\d{4}[a-z]?\\)|\\[\\d+\\]\\s*$')
  UNION ALL SELECT paper_id, pos, 'Related Work', 1 FROM hn WHERE line = ' related WORK : '
  UNION ALL SELECT paper_id, pos, 'Abstract', 1 FROM hn WHERE lower(trim(line)) = 'abstract'
  UNION ALL SELECT paper_id, min(pos), title, 2 FROM (SELECT paper_id, pos, trim(line) AS title FROM hn WHERE trim(line) IN ('Large 0', 'Large 1', 'related WORK :')) GROUP BY paper_id, title),
hm AS (SELECT *, row_number() OVER (PARTITION BY paper_id, pos ORDER BY prio) AS nth FROM hc)"""


@query(f"WITH {HEADED} SELECT paper_id, pos, title FROM hm WHERE nth = 1")
def heading_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered, keyword and font headings, merged: a font heading where a keyword stands is dropped."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    k = F.col("pos") % 4
    said = F.when(k == 0, F.concat(F.floor(F.col("pos") / 4) + 1, F.lit(" Results "), F.col("line"))).when(k == 1, " related WORK : ").when(k == 2, F.concat(F.lit("Large "), (F.col("pos") + 1) % 3)).otherwise(F.col("line"))
    gathered = lines.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("line")))).alias("all"))
    pages = gathered.select("paper_id", F.lit(0).alias("page_no"), F.array_join(F.transform("all", lambda s: s["line"]), "\n").alias("text"))
    fonts = pages.select("paper_id", F.explode(F.array(*map(F.lit, ("Large 0", "Large 1", "related WORK :", "Not there")))).alias("title"))
    return sections.merge_candidates(sections.heading_candidates(sections.text_lines(pages), fonts)).select("paper_id", "pos", "title")


SPLITS = r"""a AS (SELECT doc_id, t AS text, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {s}), lambda x: x <> '') AS p1, list_filter(list_transform(string_split(t, chr(10)), lambda x: {s}), lambda x: x <> '') AS p2
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) ELSE text END AS t FROM documents)),
p AS (SELECT doc_id, text, CASE WHEN len(p1) > 1 THEN p1 ELSE p2 END AS ps FROM a)""".format(s=strip_sql("x"))
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: {1}), lambda z: z <> '')"


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every other one with its lines as paragraphs."""
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n \n"))).otherwise(F.col("text")).alias("text"))


def told_pieces(made: DataFrame, found) -> DataFrame:
    return made.select("doc_id", found.alias("found")).select("doc_id", F.size("found").cast("long").alias("n"), F.md5(F.array_join("found", "|")).alias("pieces"))


@query(f"WITH {SPLITS} SELECT doc_id, len(ps) AS n, md5(array_to_string(ps, '|')) AS pieces FROM p")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_pieces(spaced(spark, sf_dir), chunking.paragraphs(F.col("text")))


@query(f"WITH {SPLITS}, s AS (SELECT doc_id, {SENTENCES.format('text', strip_sql('z'))} AS ss FROM a) SELECT doc_id, len(ss) AS n, md5(array_to_string(ss, '|')) AS pieces FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_pieces(spaced(spark, sf_dir), chunking.sentences(F.col("text")))


@query("WITH h AS (SELECT doc_id, list_transform(range(0, length(text), 70), lambda i: substr(text, i + 1, 70)) AS hs FROM documents) SELECT doc_id, len(hs) AS n, md5(array_to_string(hs, '|')) AS pieces FROM h")
def hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_pieces(read(spark, sf_dir, "documents"), chunking.hard_cuts(F.col("text"), 70))


@query(f"""WITH {SPLITS}, q AS (SELECT doc_id, flatten(list_transform(ps, lambda y: CASE WHEN length(y) <= 90 THEN [y] ELSE
  flatten(list_transform({SENTENCES.format('y', strip_sql('z'))}, lambda w: CASE WHEN length(w) <= 90 THEN [w] ELSE list_transform(range(0, length(w), 90), lambda i: substr(w, i + 1, 90)) END)) END)) AS qs FROM p)
SELECT doc_id, len(qs) AS n, md5(array_to_string(qs, '|')) AS pieces FROM q""")
def atomic_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_pieces(spaced(spark, sf_dir), chunking.atomic_pieces(F.col("text"), 90))


# vectors of texts: an embedder that counts words in places by their MD5, so that SQL can do the same


def md5_embedding(texts: list[str]) -> list[list[float]]:
    import hashlib

    out = []
    for text in texts:
        row = [0.0] * 64
        for word in text.split(" "):
            if word:
                row[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1.0
        out.append(row)
    return out


MD5_VECTORS = """w AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS place, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM w GROUP BY doc_id), e AS (SELECT doc_id, place, n / norm AS v FROM w JOIN l USING (doc_id))"""


@query(f"WITH {MD5_VECTORS} SELECT doc_id, CAST(place AS INTEGER) AS place, round(v, 4) AS v FROM e")
def hashed_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors from an embedder in the workers, a row a place that isn't zero."""
    made = vectors.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), embed_fn=md5_embedding)
    return made.select("doc_id", F.posexplode("embedding").alias("place", "v")).where("v > 0").select("doc_id", "place", F.round(F.col("v").cast("double"), 4).alias("v"))


@query(f"""WITH {MD5_VECTORS}, s AS (SELECT q.doc_id AS query_id, e.doc_id, sum(q.v * e.v) AS score FROM e q JOIN e ON q.place = e.place WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, count(*) FILTER (score >= 0.8) AS near, round(max(score), 3) AS best FROM s GROUP BY query_id""")
def embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents are near to each hundredth, and how near the nearest is: queries are embedded as a table.

    A query without words meets nothing, and isn't in the result.
    """
    made = vectors.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), embed_fn=md5_embedding, exact=True)
    asked = made.where("doc_id % 100 = 0").where(F.exists("embedding", lambda x: x != 0)).select("doc_id", "embedding")
    found = vectors.near_counts(made, asked, 0.8)
    return found.select("query_id", "near", F.round("best", 3).alias("best"))


@query("""WITH d AS (SELECT doc_id, source, n_chars, substr(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 120) AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY n_chars DESC, doc_id) AS nth FROM d WHERE n_chars >= 200)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS passage FROM r WHERE nth = 1""")
def passage_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor and the dedupe of retrieval, over documents: a query a source, lengths as scores."""
    hits = read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", F.col("n_chars").alias("score"), F.col("doc_id").alias("rank"), "text")
    out = vectors.floor_and_dedupe(hits, 200, tx.prefix_key(F.col("text")), order_col="doc_id")
    return out.select(F.col("query_id").alias("source"), "doc_id", F.col("passage").cast("long").alias("passage"))


@query("SELECT label, vec_id, CASE WHEN label IN (2, 5) THEN 'new' ELSE 'old' END AS state FROM embeddings WHERE label NOT IN (2, 5) OR vec_id % 2 = 0")
def upsert_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections are replaced by half of their vectors; the others stay."""
    old = read(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.lit("old").alias("state"))
    fresh = old.where("label IN (2, 5) AND vec_id % 2 = 0").withColumn("state", F.lit("new"))
    return vectors.upsert(old, fresh, "label").select("label", "vec_id", "state")


@query("SELECT DISTINCT doc_id // 10 AS paper_id, (doc_id // 10) % 3 <> 0 AS fresh FROM documents")
def index_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexing with two thirds of the papers new: those whose chunks are stored already aren't embedded again."""
    body = made_sections(spark, sf_dir)
    shape = "paper_id long, chunk_id string, text string, section_title string, chunk_index int, embedding array<float>"
    whole = flows.index(body.where("paper_id % 3 = 0"), spark.createDataFrame([], shape), md5_embedding)
    out = flows.index(body, whole.withColumn("embedding", F.array(F.lit(2.0).cast("float"))), md5_embedding)
    return out.groupBy("paper_id").agg((F.max(F.get("embedding", F.lit(0))) < 2).alias("fresh"))


# the catalogue of papers, and requests to it


@query(r"""SELECT '23' || lpad(CAST(doc_id // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS paper_id, trim(regexp_replace(source || '  ' || lang, '\s+', ' ', 'g')) AS title,
trim(regexp_replace(text, '\s+', ' ', 'g')) AS abstract, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS published, CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id ELSE
'https://arxiv.org/pdf/23' || lpad(CAST(doc_id // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') END AS pdf_url, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '10.1/' || doc_id END AS doi FROM documents""")
def map_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results made from documents, as papers."""
    n = F.col("doc_id")
    entry = F.concat(F.lit("http://arxiv.org/abs/23"), F.lpad(F.floor(n / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad((n % 100000).cast("string"), 5, "0"), F.lit("v2"))
    raw = read(spark, sf_dir, "documents").select(
        entry.alias("entry_id"), F.concat("source", F.lit(" \n "), "lang").alias("title"), F.array("source").alias("authors"), F.col("text").alias("summary"),
        F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int"))).alias("published"), F.lit(None).cast("timestamp").alias("updated"), F.array("lang").alias("categories"),
        F.when(n % 2 == 0, F.concat(F.lit("https://example.org/"), n)).alias("pdf_url"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("10.1/"), n)).alias("doi"))
    return tables.map_results(raw).select("paper_id", "title", "abstract", "published", "pdf_url", "doi")


@query("""SELECT event_id, d.doc_id IS NOT NULL AS found, d.source AS title, CASE WHEN d.doc_id IS NULL THEN 'No paper has the ID ' || (event_id * 7) || '.' END AS error
FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id * 7""")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("title"))
    asked = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7).cast("string").alias("paper_id"))
    return tables.lookup(papers, asked).select("event_id", F.col("paper").isNotNull().alias("found"), "paper.title", "error")


@query("""WITH p AS (SELECT doc_id // 10 AS paper_id, min(CASE WHEN doc_id % 10 = 0 THEN trim(source) END) AS abstract, min(CASE WHEN doc_id % 10 = 1 AND (doc_id // 10) % 3 <> 1 THEN text END) AS found FROM documents GROUP BY 1)
SELECT paper_id, md5(coalesce(CASE WHEN paper_id % 3 = 0 THEN abstract END, regexp_replace(found, '^\\s+|\\s+$', '', 'g'), '')) AS abstract FROM p""")
def abstract_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's abstract, else the section's, else none."""
    docs = read(spark, sf_dir, "documents")
    paper, pos = F.floor(F.col("doc_id") / 10), F.col("doc_id") % 10
    known = docs.groupBy(paper.alias("paper_id")).agg(F.min(F.when(pos == 0, F.concat(F.lit(" "), F.col("source")))).alias("own"))
    papers = known.select("paper_id", F.when(F.col("paper_id") % 3 == 0, F.col("own")).otherwise(" \n").alias("abstract"))
    made = docs.where(pos == 1).select(paper.alias("paper_id"), pos.alias("section_pos"), F.when(paper % 3 == 1, "Notes").otherwise(" ABSTRACT ").alias("title"), "text")
    return sections.resolve_abstract(papers, made).select("paper_id", F.md5("abstract").alias("abstract"))


@query("""WITH q AS (SELECT event_id AS request_id, CASE event_id % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'missing' WHEN 2 THEN 'blank' ELSE 'topic' END AS kind FROM events),
d AS (SELECT min(doc_id) AS id FROM documents)
SELECT request_id, CASE kind WHEN 'blank' THEN 'unknown' WHEN 'topic' THEN 'topic_search' ELSE 'paper_lookup' END AS intent,
CASE kind WHEN 'lookup' THEN '2301.' || lpad(CAST(id AS VARCHAR), 5, '0') WHEN 'topic' THEN CASE WHEN request_id % 8 = 3 THEN '2301.' || lpad(CAST(id AS VARCHAR), 5, '0') END END AS paper_id,
CASE kind WHEN 'missing' THEN 'ask_user_to_rephrase' WHEN 'blank' THEN 'error' WHEN 'topic' THEN CASE WHEN request_id % 8 = 3 THEN NULL ELSE 'confirm_with_user' END END AS next_action,
CASE kind WHEN 'lookup' THEN 'understand_query > search_arxiv > fetch_parse > chunk_embed > summarize' WHEN 'missing' THEN 'understand_query > search_arxiv' WHEN 'blank' THEN 'understand_query > handle_error'
  ELSE CASE WHEN request_id % 8 = 3 THEN 'understand_query > search_arxiv > select_paper > fetch_parse > chunk_embed > summarize' ELSE 'understand_query > search_arxiv > select_paper' END END AS route,
CASE kind WHEN 'missing' THEN 'No paper has the ID 9999.99999.' WHEN 'blank' THEN 'I couldn''t understand that as an arXiv ID, URL, or topic. Please provide a paper to look up or a topic to search for.' ELSE '' END AS errors,
CASE WHEN kind = 'lookup' OR (kind = 'topic' AND request_id % 8 = 3) THEN 'No language model is configured.' ELSE '' END AS warnings FROM q, d""")
def run_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of requests of every kind: ids that are there or not, blank ones, topics that are found clearly or to be confirmed."""
    docs = read(spark, sf_dir, "documents")
    pid = F.concat(F.lit("2301."), F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    first = docs.agg(F.min("doc_id").alias("doc_id")).join(docs, "doc_id")
    papers = first.select(pid.alias("paper_id"), F.lit("Clear Zebra Topic").alias("title"), F.array("source").alias("authors"), F.lit("of zebras").alias("abstract"), F.lit("2024-01-01").cast("date").alias("published"), F.lit("u").alias("abs_url"))
    pages = first.select(pid.alias("paper_id"), F.lit(0).alias("page_no"), F.concat(F.lit("Abstract\n"), F.col("text")).alias("text"))
    n = F.col("event_id")
    said = F.when(n % 4 == 0, papers_id(first)).when(n % 4 == 1, "see 9999.99999").when(n % 4 == 2, " \n").when(n % 8 == 3, "the zebra topic").otherwise("zebras")
    asked = read(spark, sf_dir, "events").select(n.alias("request_id"), said.alias("text"))
    shape = "paper_id string, chunk_id string, text string, section_title string, chunk_index int, embedding array<float>"
    done = flows.run(asked, papers, pages, spark.createDataFrame([], shape), tables.scratch(spark), embed_fn=zebra_embedding)
    return done.sessions.select("request_id", "intent", "paper_id", "next_action", "route", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


def papers_id(first: DataFrame):
    return F.lit("2301." + str(first.first()["doc_id"]).zfill(5))


def zebra_embedding(texts: list[str]) -> list[list[float]]:
    """Topics of one word point away from everything else."""
    return [[0.0, 1.0] if t == "all:zebras" else [1.0, 0.0] for t in texts]


@query(PASSAGES + """, u AS (SELECT query_id, (query_id // 100) % 4 AS k, passage, section_title, vec_id, count(*) OVER (PARTITION BY query_id) AS n FROM ps WHERE query_id % 500 <> 0)
SELECT query_id, CAST(passage AS INTEGER) AS passage, section_title, vec_id FROM u WHERE k <> 3 OR passage IN (2, 1)""")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of all outcomes of a question: a model's answer has those that it cites, any other all."""
    found = made_passages(spark, sf_dir).where("query_id % 500 <> 0").withColumnRenamed("vec_id", "chunk_index")
    k = F.floor(F.col("query_id") / 100) % 4
    said = F.when(k == 2, "So NOT_IN_PAPER.").otherwise("It is so [2], see [1] and [99].")
    told = dialogue.answer_sources(F.col("n_passages"), F.when(k == 0, "none").otherwise("model"), said, F.when(k == 1, "busy"), F.col("listed"))
    return dialogue.format_passages(found).select("query_id", F.explode(told).alias("s")).select("query_id", F.col("s.passage").cast("int").alias("passage"), "s.section_title", F.col("s.chunk_index").alias("vec_id"))


# briefings


@query(f"""WITH {PICKED}, c AS (SELECT paper_id, count(*) AS n, sum(length(text)) AS raw FROM pk GROUP BY 1) SELECT paper_id, CASE WHEN n > 1 AND raw > 8000 THEN 'map_reduce' ELSE 'single_pass' END AS strategy, CASE WHEN n > 1 AND raw > 8000 THEN n ELSE 0 END AS calls FROM c""")
def map_reduce_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which papers are listed section by section first, and how many requests that makes."""
    body = made_sections(spark, sf_dir)
    found = flows.contexts(body, 5000)
    calls = flows.map_requests(body, found).groupBy("paper_id").agg(F.count("*").alias("calls"))
    return found.join(calls, "paper_id", "left").select("paper_id", "strategy", F.coalesce("calls", F.lit(0).cast("long")).alias("calls"))


@query(r"""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE list_reduce(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 2 = 1 THEN ' - ' || l ELSE l END), lambda a, b: a || chr(10) || b) END AS r FROM documents),
b AS (SELECT doc_id, r, list_transform(list_filter(string_split(r, chr(10)), lambda l: regexp_matches(l, '^\s*[-•]')), lambda l: regexp_replace(regexp_replace(l, '^[-• ]+', ''), '^\s+|\s+$', '', 'g')) AS bs FROM m)
SELECT doc_id, md5(array_to_string(CASE WHEN doc_id % 5 = 0 THEN ['Raw text'] WHEN len(bs) > 0 THEN bs ELSE [substr(regexp_replace(r, '^\s+|\s+$', '', 'g'), 1, 300)] END, '|')) AS facts FROM b""")
def map_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of responses with and without lists, and of failed ones."""
    listed = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.lit(" - "), x)).otherwise(x)), "\n")
    n = F.col("doc_id")
    facts = briefing.bullets(F.when(n % 3 == 0, F.col("text")).otherwise(listed), F.lit(" Raw text "), n % 5 == 0)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(facts, "|")).alias("facts"))


@query(f"""WITH {BRIEF} SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'Paper ' || doc_id AS title, source || ', ' || lang AS authors, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS published, 'https://example.org/' || doc_id AS link, md5(why) AS why_md5,
array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'Long paper: summarized via map-reduce over 4 sections before final synthesis.' END, CASE WHEN doc_id % 5 = 0 THEN 'This briefing is based on degraded or partial paper text (low-quality PDF extraction or an abstract-only fallback); some fields may be less reliable.' END,
CASE WHEN doc_id % 3 = 0 THEN 'Partial text.' END], lambda x: x IS NOT NULL), ' ') AS notes FROM v WHERE doc_id % 4 <> 1 AND words BETWEEN 40 AND 200 AND nm BETWEEN 3 AND 8 AND nk >= 2 AND nf BETWEEN 3 AND 5""")
def summary_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with wrong facts, with too little in them, or that are no JSON: the facts of briefings are the catalogue's."""
    docs = read(spark, sf_dir, "documents")
    n, own = F.col("doc_id"), made_briefing()
    names = [f.split()[0] for f in briefing.FIELDS.split(", ")]
    wrong = F.to_json(F.struct(F.lit("A wrong title").alias("title"), F.array(F.lit("Nobody")).alias("authors"), *[own[f].alias(f) for f in names]))
    said = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), wrong, F.lit("\n```"))).when(n % 4 == 1, "I can't do that.").otherwise(wrong)
    checked = docs.select(n.cast("string").alias("paper_id"), briefing.checked(said).alias("c")).select("paper_id", "c.object", "c.problems")
    papers = docs.select(own["paper_id"].alias("paper_id"), own["title"].alias("title"), own["authors"].alias("authors"), own["published"].alias("published"), own["link"].alias("abs_url"))
    found = docs.select(n.cast("string").alias("paper_id"), F.when(n % 2 == 0, "map_reduce").otherwise("single_pass").alias("strategy"), F.lit(4).cast("long").alias("n_sections"))
    report = docs.select(n.cast("string").alias("paper_id"), F.lit(0.9).alias("quality"), F.when(n % 5 == 0, "abstract_only").otherwise("text").alias("parse_method"))
    out = flows.finish_briefings(checked, papers, found, report)
    return out.select("paper_id", "title", F.array_join("authors", ", ").alias("authors"), "published", "link", F.md5("why_it_matters").alias("why_md5"), F.coalesce("confidence_notes", F.lit("")).alias("notes"))


@query(f"WITH {BRIEF} SELECT doc_id, 'Paper ' || doc_id AS title, lang AS second_author, CASE WHEN doc_id % 3 = 0 THEN 'Partial text.' END AS notes, md5(problem) AS problem_md5, CAST(doc_id % 3 <> 0 AS BOOLEAN) AS says_null FROM v")
def render_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from rendered JSON; a null field is written as one."""
    made = read(spark, sf_dir, "documents").select("doc_id", briefing.render_json(made_briefing()).alias("j"))
    field = lambda path: F.get_json_object("j", path)
    return made.select("doc_id", field("$.title").alias("title"), field("$.authors[1]").alias("second_author"), field("$.confidence_notes").alias("notes"), F.md5(field("$.problem_statement")).alias("problem_md5"), F.regexp_like("j", F.lit('"confidence_notes" : null')).alias("says_null"))


# services and state


@query("""SELECT event_id, least(event_id % 6, 3) + 1 AS calls, CASE least(event_id % 6, 4) WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 3.0 ELSE 7.0 END AS waited, event_id % 6 > 3 AS failed FROM events""")
def retry_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client that fails as often as an event's number says, behind retries whose waits are counted, not slept."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for event in frame["event_id"]:
                client, waits = FailingFirst(int(event) % 6), []
                try:
                    service.Retrying(client, Settings().retry_delays, waits.append).complete("", "")
                    failed = False
                except service.ServiceError:
                    failed = True
                out.append((event, client.calls, sum(waits, 0.0), failed))
            yield pd.DataFrame(out, columns=["event_id", "calls", "waited", "failed"])

    return read(spark, sf_dir, "events").select("event_id").mapInPandas(run, "event_id long, calls long, waited double, failed boolean")


class FailingFirst:
    """A client whose first ``n`` calls fail for now."""

    name, max_context_tokens = "failing", 0

    def __init__(self, n: int):
        self.left, self.calls = n, 0

    def complete(self, system: str, user: str, temperature: float = 0.2) -> str:
        self.calls += 1
        self.left -= 1
        if self.left >= 0:
            raise service.ServiceError("busy", retryable=True)
        return "done"


@query("WITH t AS (SELECT user_id AS session_id, event_id AS turn_no, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) SELECT session_id, turn_no FROM t WHERE nth <= 20")
def history_cap20(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_no"))
    return dialogue.last_turns(turns, Settings().stored_turns)


@query(f"""WITH {UPDATES}, s AS (SELECT *, max(CASE WHEN has_a THEN seq END) OVER w AS at_a, max(CASE WHEN has_b THEN seq END) OVER w AS at_b FROM u WINDOW w AS (PARTITION BY thread_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT s.thread_id, s.seq, x.a, y.b FROM s LEFT JOIN u x ON x.seq = s.at_a LEFT JOIN u y ON y.seq = s.at_b""")
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after each update."""
    return state.merge_updates(made_updates(spark, sf_dir), ["a", "b"])
