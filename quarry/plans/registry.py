"""Named queries of the engine over the test tables, with their DuckDB equivalents.

Documents stand for chunks: file_path is source/doc_id.md and line_start 1. The manifest is made from
the labelled documents (those of quality 0 with another time) and the benchmark items, which are no
files any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import vectors
from quarry.operators import chunks as ch
from quarry.operators import fts, markdown, ranking, store
from quarry.operators import manifest as m
from quarry.plans import response
from quarry.sources import ignore
from quarry.sources import settings as st

Query = Callable[[SparkSession, str], DataFrame]

QUERY = "licensed under the apache license version"
LIMIT = 20
NOW = 1_700_000_000
DAY = 86_400
IGNORES = ["build/", "*.generated.rs", "# none", "", "lib/*"]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path() -> Column:
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


_PATH = "concat(coalesce(source, ''), '/', CAST(doc_id AS VARCHAR), '.md')"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    content = F.coalesce("text", F.lit(""))
    return _read(spark, d, "documents").select("doc_id", _path().alias("file_path"), F.lit(1).alias("line_start"), F.size(tx.lines(content)).alias("line_end"), content.alias("content"), F.lit("section").alias("chunk_type"), F.coalesce("lang", F.lit("")).alias("name"))


_CHUNKS = f"chunks AS (SELECT doc_id, {_PATH} AS file_path, 1 AS line_start, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS line_end, coalesce(text, '') AS content, 'section' AS chunk_type, coalesce(lang, '') AS name FROM documents)"


# Change detection


def _current(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select(_path().alias("file_path"), F.col("n_chars").cast("double").alias("mtime"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    labels = _read(spark, d, "labels").select("doc_id", "quality")
    known = _read(spark, d, "documents").join(labels, "doc_id").select(_path().alias("file_path"), (F.col("n_chars") + 1 - F.col("quality")).cast("double").alias("mtime"))
    gone = _read(spark, d, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit(0.0).alias("mtime"))
    return known.unionByName(gone)


_FILES = f"""cur AS (SELECT {_PATH} AS file_path, CAST(n_chars AS DOUBLE) AS mtime FROM documents),
man AS (SELECT {_PATH} AS file_path, CAST(n_chars + 1 - quality AS DOUBLE) AS mtime FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT concat('bench/', CAST(item_id AS VARCHAR), '.md'), 0.0 FROM benchmark),
chg AS (SELECT coalesce(cur.file_path, man.file_path) AS file_path,
  CASE WHEN man.file_path IS NULL THEN 'new' WHEN cur.file_path IS NULL THEN 'deleted' WHEN cur.mtime <> man.mtime THEN 'modified' END AS change
  FROM cur FULL OUTER JOIN man ON cur.file_path = man.file_path)"""


@_query(f"WITH {_FILES} SELECT * FROM chg WHERE change IS NOT NULL")
def change_detect(spark: SparkSession, d: str) -> DataFrame:
    return m.changes(_current(spark, d), _manifest(spark, d))


@_query(f"WITH {_FILES} SELECT file_path FROM cur WHERE file_path NOT IN (SELECT file_path FROM man)")
def new_files(spark: SparkSession, d: str) -> DataFrame:
    return m.new_files(_current(spark, d), _manifest(spark, d))


@_query(f"WITH {_FILES} SELECT cur.file_path FROM cur JOIN man ON cur.file_path = man.file_path WHERE cur.mtime <> man.mtime")
def modified_files(spark: SparkSession, d: str) -> DataFrame:
    return m.modified_files(_current(spark, d), _manifest(spark, d))


@_query(f"WITH {_FILES} SELECT file_path FROM man WHERE file_path NOT IN (SELECT file_path FROM cur)")
def deleted_files(spark: SparkSession, d: str) -> DataFrame:
    return m.deleted_files(_current(spark, d), _manifest(spark, d))


@_query(f"WITH {_FILES} SELECT * FROM chg WHERE change IN ('new', 'modified')")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    return m.stale_files(_current(spark, d), _manifest(spark, d))


@_query(f"WITH {_FILES} SELECT count(*) > 0 AS has_changes, count(*) > 0 AS has_work FROM chg WHERE change IS NOT NULL")
def has_changes(spark: SparkSession, d: str) -> DataFrame:
    return m.has_changes(_current(spark, d), _manifest(spark, d))


@_query(f"WITH {_FILES} SELECT file_path, CASE WHEN change = 'deleted' THEN 'delete' ELSE 'index' END AS action FROM chg WHERE change IS NOT NULL")
def scan_plan(spark: SparkSession, d: str) -> DataFrame:
    return m.scan_plan(_current(spark, d), _manifest(spark, d))


@_query(f"WITH {_FILES} SELECT file_path, 'index' AS action FROM cur")
def scan_plan_force(spark: SparkSession, d: str) -> DataFrame:
    return m.scan_plan(_current(spark, d), _manifest(spark, d), force=True)


@_query(f"WITH {_FILES} SELECT * FROM cur UNION ALL SELECT * FROM man WHERE file_path NOT IN (SELECT file_path FROM cur)")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    return m.upsert(_manifest(spark, d), _current(spark, d))


@_query(f"WITH {_FILES} SELECT * FROM man WHERE file_path NOT IN (SELECT file_path FROM chg WHERE change = 'deleted')")
def manifest_remove(spark: SparkSession, d: str) -> DataFrame:
    current, manifest = _current(spark, d), _manifest(spark, d)
    return m.remove(manifest, m.deleted_files(current, manifest))


@_query(f"WITH {_FILES} SELECT file_path FROM man")
def tracked_files(spark: SparkSession, d: str) -> DataFrame:
    return m.tracked(_manifest(spark, d))


# Sources

_PATHS = """paths AS (SELECT concat(CASE p_size % 7 WHEN 0 THEN 'build/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'src/.venv/' WHEN 3 THEN 'lib/' ELSE 'src/' END,
  'part_', CAST(p_partkey AS VARCHAR), CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.md' WHEN 3 THEN '.generated.rs' ELSE '.json' END) AS rel_path FROM part)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    n, e = F.col("p_size") % 7, F.col("p_size") % 5
    folder = F.when(n == 0, "build/").when(n == 1, "node_modules/").when(n == 2, "src/.venv/").when(n == 3, "lib/").otherwise("src/")
    suffix = F.when(e == 0, ".py").when(e == 1, ".rs").when(e == 2, ".md").when(e == 3, ".generated.rs").otherwise(".json")
    return _read(spark, d, "part").select(F.concat(folder, F.lit("part_"), F.col("p_partkey").cast("string"), suffix).alias("rel_path"))


_PRUNED = r"NOT regexp_matches(rel_path, '(^|/)(\.venv|\.git|node_modules|__pycache__|\.pytest_cache|venv)/')"
_EXT = r"regexp_matches(rel_path, '\.(py|rs|md)$')"
_IGNORED = r"(regexp_matches(rel_path, '(^|/)build(/|$)') OR regexp_matches(rel_path, '\.generated\.rs$') OR regexp_matches(rel_path, '(^|/)lib/'))"


@_query(f"WITH {_PATHS} SELECT rel_path FROM paths WHERE {_PRUNED}")
def prune_dirs(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).where(~ignore.pruned(F.col("rel_path")))


@_query(f"WITH {_PATHS} SELECT rel_path FROM paths WHERE {_EXT}")
def ext_filter(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).where(ignore.has_extension(F.col("rel_path"), ch.default_registry().extensions))


@_query(f"WITH {_PATHS} SELECT rel_path, {_IGNORED} AS ignored FROM paths")
def ignore_match(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("rel_path", ignore.ignored(F.col("rel_path"), ignore.expand_gitignore(IGNORES)).alias("ignored"))


@_query(f"WITH {_PATHS} SELECT rel_path FROM paths WHERE {_PRUNED} AND {_EXT} AND NOT {_IGNORED}")
def scan_walk(spark: SparkSession, d: str) -> DataFrame:
    return ignore.kept(_paths(spark, d), ch.default_registry().extensions, ignore.expand_gitignore(IGNORES))


@_query("""WITH l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat(url, '/') WHEN 1 THEN concat('# ', url) WHEN 2 THEN concat('  ', url) ELSE '' END AS line FROM pages),
t AS (SELECT page_id, trim(line) AS r FROM l)
SELECT page_id, unnest(CASE WHEN r = '' OR r LIKE '#%' THEN [] WHEN r LIKE '%/' THEN [concat(r[:-2], '/**'), r[:-2]] ELSE [r, concat('**/', r)] END) AS pattern FROM t""")
def gitignore_expand(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    line = F.when(k == 0, F.concat("url", F.lit("/"))).when(k == 1, F.concat(F.lit("# "), "url")).when(k == 2, F.concat(F.lit("  "), "url")).otherwise("")
    return _read(spark, d, "pages").select("page_id", F.explode(ignore.expanded(line)).alias("pattern"))


@_query("SELECT page_id, substr(sha256(url), 1, 16) AS project_id FROM pages")
def project_hash(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", st.project_hash(F.col("url")).alias("project_id"))


@_query(f"SELECT {_PATH} AS file_path, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL")
def read_text(spark: SparkSession, d: str) -> DataFrame:
    raw = _read(spark, d, "documents").where("text IS NOT NULL").select(_path().alias("file_path"), F.lit(0.0).alias("mtime"), F.col("text").cast("binary").alias("raw"))
    from quarry.sources import files

    return files.readable(raw).select("file_path", F.length("content").cast("long").alias("chars"))


# Chunkers


@_query(f"SELECT {_PATH} AS file_path FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')")
def blank_guard(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").where(tx.not_blank(F.col("text"))).select(_path().alias("file_path"))


@_query("SELECT doc_id, array_to_string(list_slice(string_split(coalesce(text, ''), chr(10)), 2, 4), chr(10)) AS content FROM documents")
def line_slice(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", tx.line_slice(F.coalesce("text", F.lit("")), F.lit(2), F.lit(4)).alias("content"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    made = F.concat(F.lit("---\ntitle: t\n---\nIntro "), F.col("doc_id").cast("string"), F.lit("\n\n# T"), F.col("doc_id").cast("string"), F.lit("\n\n"), text, F.lit("\n\n## S ##\n\n"), text, F.lit("\n"))
    return _read(spark, d, "documents").select(_path().alias("file_path"), made.alias("content"))


_MARKDOWN = rf"""src AS (SELECT {_PATH} AS file_path, string_split(concat('---', chr(10), 'title: t', chr(10), '---', chr(10), 'Intro ', doc_id, chr(10), chr(10), '# T', doc_id, chr(10), chr(10), coalesce(text, ''), chr(10), chr(10), '## S ##', chr(10), chr(10), coalesce(text, ''), chr(10)), chr(10)) AS l FROM documents),
lines AS (SELECT file_path, l, generate_subscripts(l, 1) AS n FROM src),
marked AS (SELECT file_path, n, len(l) AS size, l[n] AS line, n > 3 AND regexp_matches(l[n], '^ {{0,3}}#{{1,6}}([ \t]|$)') AS head FROM lines),
sec AS (SELECT *, sum(head::INT) OVER (PARTITION BY file_path ORDER BY n) AS s FROM marked WHERE n > 3),
grouped AS (SELECT file_path, s, min(n) AS line_start, CASE WHEN s = max(s) OVER (PARTITION BY file_path) THEN max(size) ELSE max(n) END AS line_end,
  regexp_replace(string_agg(line, chr(10) ORDER BY n), '\n+$', '') AS content, arg_min(line, n) AS first FROM sec GROUP BY file_path, s)"""
_MD_NAME = r"trim(regexp_replace(regexp_replace(first, '^\s*#{1,6}[ \t]*', ''), '(^|[ \t]+)#+[ \t]*$', ''))"
_MD_STEM = r"regexp_extract(file_path, '([^/]*)\.md$', 1)"


@_query(rf"""WITH {_MARKDOWN} SELECT file_path, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, content,
CASE WHEN s = 0 THEN 'module' ELSE 'section' END AS chunk_type, CASE WHEN s = 0 THEN {_MD_STEM} ELSE {_MD_NAME} END AS name FROM grouped WHERE regexp_matches(content, '\S')""")
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return markdown.chunk_markdown(_markdown(spark, d))


@_query(rf"WITH {_MARKDOWN} SELECT file_path, CAST(line_start AS INTEGER) AS line_start, {_MD_NAME} AS name FROM grouped WHERE s > 0")
def md_headings(spark: SparkSession, d: str) -> DataFrame:
    return markdown.chunk_markdown(_markdown(spark, d)).where("chunk_type = 'section'").select("file_path", "line_start", "name")


@_query(rf"WITH {_MARKDOWN} SELECT file_path, {_MD_STEM} AS name, content FROM grouped WHERE s = 0")
def md_preamble(spark: SparkSession, d: str) -> DataFrame:
    return markdown.chunk_markdown(_markdown(spark, d)).where("chunk_type = 'module'").select("file_path", "name", "content")


@_query(f"WITH {_MARKDOWN} SELECT DISTINCT file_path, 3 AS frontmatter_end FROM src")
def md_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).select("file_path", markdown.frontmatter_end(tx.lines(F.col("content"))).alias("frontmatter_end"))


_CODE_SQL = """SELECT concat('src/part_', CAST(p_partkey AS VARCHAR), '.{ext}') AS file_path, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, chunk_type, CASE WHEN named THEN concat(name, CAST(p_partkey AS VARCHAR)) ELSE name END AS name
FROM part, (VALUES {rows}) AS t(line_start, line_end, chunk_type, name, named)"""
_PY_SQL = _CODE_SQL.format(ext="py", rows="(4, 5, 'function', 'part_', true), (8, 10, 'class', 'P', true), (9, 10, 'method', 'run', false)") + " UNION ALL SELECT concat('src/part_', CAST(p_partkey AS VARCHAR), '.py'), 1, 1, 'module', concat('part_', CAST(p_partkey AS VARCHAR)) FROM part"
_RS_SQL = _CODE_SQL.format(ext="rs", rows="(1, 2, 'class', 'P', true), (4, 6, 'class', 'P', true), (5, 5, 'method', 'run', false), (8, 8, 'function', 'part_', true)")


def _python(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit('"""'), "p_name", F.lit('"""\n\n\ndef part_'), k, F.lit("():\n    return "), F.col("p_size").cast("string"), F.lit("\n\n\nclass P"), k, F.lit(":\n    def run(self):\n        return 1\n"))
    return _read(spark, d, "part").select(F.concat(F.lit("src/part_"), k, F.lit(".py")).alias("file_path"), body.alias("content"))


def _rust(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("#[derive(Debug)]\nstruct P"), k, F.lit(" { a: u8 }\n\nimpl P"), k, F.lit(' {\n    fn run(&self) -> &str { "}" }\n}\n\nfn part_'), k, F.lit("() { loop {} }\n"))
    return _read(spark, d, "part").select(F.concat(F.lit("src/part_"), k, F.lit(".rs")).alias("file_path"), body.alias("content"))


@_query(_PY_SQL)
def chunk_python(spark: SparkSession, d: str) -> DataFrame:
    return ch.chunk_python(_python(spark, d)).drop("content")


@_query(_RS_SQL)
def chunk_rust(spark: SparkSession, d: str) -> DataFrame:
    return ch.chunk_rust(_rust(spark, d)).drop("content")


@_query(f"""WITH {_MARKDOWN}, all_chunks AS (SELECT file_path, CASE WHEN s = 0 THEN 'module' ELSE 'section' END AS chunk_type FROM grouped
UNION ALL SELECT file_path, chunk_type FROM ({_PY_SQL}) UNION ALL SELECT file_path, chunk_type FROM ({_RS_SQL}))
SELECT chunk_type, count(*) AS n, count(DISTINCT file_path) AS files FROM all_chunks GROUP BY chunk_type""")
def chunk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    files = _markdown(spark, d).unionByName(_python(spark, d)).unionByName(_rust(spark, d)).unionByName(_python(spark, d).withColumn("file_path", F.lit("data/x.json")))
    return ch.default_registry().chunk(files).groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


# Vectors and keywords

_TERMS = r"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 0)"
_BUCKET = "CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 384 AS BIGINT)"
_SIGN = "(1 - 2 * (('0x' || substr(md5(t), 9, 2))::BIGINT % 2))"
_HASHED = f"""words AS (SELECT doc_id, unnest({_TERMS.format(x="coalesce(text, '')")}) AS t FROM documents),
cells AS (SELECT doc_id, {_BUCKET} AS bucket, sum({_SIGN}) AS v FROM words GROUP BY ALL HAVING sum({_SIGN}) <> 0),
norms AS (SELECT doc_id, sqrt(sum(v::DOUBLE * v)) AS norm FROM cells GROUP BY doc_id)"""
_ASKED = f"""qw AS (SELECT unnest({_TERMS.format(x="'" + QUERY + "'")}) AS t),
qc AS (SELECT {_BUCKET} AS bucket, sum({_SIGN}) AS v FROM qw GROUP BY ALL HAVING sum({_SIGN}) <> 0),
q AS (SELECT bucket, v / sqrt((SELECT sum(v::DOUBLE * v) FROM qc)) AS w FROM qc)"""


def _asked(spark: SparkSession) -> DataFrame:
    return vectors.hashed(spark.range(1).select(F.col("id"), F.lit(QUERY).alias("text")), "id", "text").select("bucket", "w")


@_query(f"WITH {_ASKED} SELECT bucket, round_even(w, 9) AS w FROM q")
def embed_query(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark).select("bucket", tx.rounded(F.col("w"), 9).alias("w"))


@_query(f"WITH {_HASHED} SELECT doc_id, bucket, round_even(v / norm, 9) AS w FROM cells JOIN norms USING (doc_id)")
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hashed(_read(spark, d, "documents"), "doc_id", "text").select("doc_id", "bucket", tx.rounded(F.col("w"), 9).alias("w"))


_COSINE = """e AS (SELECT v.vec_id, CASE WHEN q.embedding IS NULL OR list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) = 0 THEN 0.0
ELSE round_even(greatest(0.0, least(1.0, 1 - (1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2)), 9) END AS score
FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def _cosines(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings")
    asked = e.where("vec_id = 0").select(F.col("embedding").alias("asked")).limit(1)  # the query's vector: one row
    return e.crossJoin(F.broadcast(asked)).select("vec_id", tx.rounded(vectors.cosine_score(F.col("embedding"), F.col("asked")), 9).alias("score"))


@_query(f"WITH {_COSINE} SELECT vec_id, score FROM e")
def cosine_score(spark: SparkSession, d: str) -> DataFrame:
    return _cosines(spark, d)


@_query(f"WITH {_COSINE} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM e ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(_cosines(spark, d), 10, F.desc("score"), "vec_id")


@_query(f"WITH {_HASHED.split(',' + chr(10) + 'cells')[0]} SELECT t AS term, doc_id, count(*) AS tf FROM words GROUP BY ALL")
def fts_postings(spark: SparkSession, d: str) -> DataFrame:
    return fts.postings(_chunks(spark, d), "doc_id")


@_query(f"WITH l AS (SELECT len({_TERMS.format(x=chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS dl FROM documents) SELECT count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_terms, round_even(avg(dl), 9) AS avgdl FROM l")
def fts_doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return fts.corpus_stats(fts.doc_lengths(_chunks(spark, d), "doc_id")).withColumn("avgdl", tx.rounded(F.col("avgdl"), 9))


_BM25 = f"""dl AS (SELECT doc_id, len({_TERMS.format(x="coalesce(text, '')")}) AS dl FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format(x="coalesce(text, '')")}) AS t FROM documents) WHERE t IN ({', '.join(f"'{t}'" for t in fts.query_terms(QUERY))}) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS raw FROM tf JOIN df USING (t) JOIN dl USING (doc_id), cs GROUP BY doc_id),
ks AS (SELECT doc_id, round_even(raw, 9) AS raw, round_even(least(1.0, raw / 10), 9) AS score FROM bm)"""


def _keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    raw = fts.bm25(_chunks(spark, d).select("doc_id", "content"), QUERY, "doc_id")
    return raw.select("doc_id", tx.rounded(F.col("raw"), 9).alias("raw"), tx.rounded(fts.keyword_score("raw"), 9).alias("score"))


@_query(f"WITH {_BM25} SELECT *, CAST(row_number() OVER (ORDER BY raw DESC, doc_id) AS INTEGER) AS rank FROM ks ORDER BY raw DESC, doc_id LIMIT {LIMIT}")
def fts_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(_keyword_scores(spark, d), LIMIT, F.desc("raw"), "doc_id")


def _leg(scores: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    return ranking.top(scores, limit, *order)


def _legs(spark: SparkSession, d: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Both legs, joined with their chunks after the cut."""
    docs = _read(spark, d, "documents").select("doc_id", "text")
    by_vector = vectors.hashed_scores(docs, _asked(spark), "doc_id", "text").withColumn("score", tx.rounded(F.col("score"), 9))
    chunks = _chunks(spark, d)
    located = lambda leg: chunks.join(F.broadcast(leg.select("doc_id", "score", "rank")), "doc_id")  # noqa: E731  at most ``limit`` rows
    return located(_leg(by_vector, limit, F.desc("score"), "doc_id")), located(_leg(_keyword_scores(spark, d), limit, F.desc("raw"), "doc_id"))


_LEGS = f"""{_HASHED}, {_ASKED}, {_BM25}, {_CHUNKS},
vs AS (SELECT c.doc_id, round_even(greatest(0.0, least(1.0, 1 - (1 - sum(c.v * coalesce(q.w, 0.0)) / any_value(n.norm)) / 2)), 9) AS score FROM cells c JOIN norms n USING (doc_id) LEFT JOIN q ON q.bucket = c.bucket GROUP BY c.doc_id),
legs AS (SELECT 0 AS leg, doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= {2 * LIMIT}
  UNION ALL SELECT 1, doc_id, score, row_number() OVER (ORDER BY raw DESC, doc_id) AS rank FROM ks QUALIFY rank <= {2 * LIMIT}),
fused AS (SELECT doc_id, least(1.0, coalesce(max(0.5 * score) FILTER (leg = 0), 0.0) + coalesce(sum(0.5 * score) FILTER (leg = 1), 0.0)) AS score, min(leg * 1000000 + rank) AS position FROM legs GROUP BY doc_id),
merged AS (SELECT file_path, line_start, doc_id, f.score, position FROM fused f JOIN chunks USING (doc_id)),
hyb AS (SELECT file_path, line_start, doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, position) AS INTEGER) AS rank FROM merged QUALIFY rank <= {2 * LIMIT}),
kept AS (SELECT * FROM hyb WHERE score >= 0.3),
boost AS (SELECT *, least(1.0, score + CASE WHEN (doc_id % 14) * {DAY} < 604800 THEN 0.05 * (1 - (doc_id % 14) * {DAY} / 604800.0) ELSE 0 END) AS boosted FROM kept),
best AS (SELECT file_path, line_start, doc_id, score, place AS rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY round_even(boosted, 9) DESC, rank) AS INTEGER) AS place FROM boost) WHERE place <= {LIMIT}),
byfile AS (SELECT *, max(score) OVER (PARTITION BY file_path) AS m, min(rank) OVER (PARTITION BY file_path) AS f FROM best),
found AS (SELECT file_path, line_start, doc_id, score, rank, CAST(row_number() OVER (ORDER BY m DESC, f, rank) AS INTEGER) AS place FROM byfile)"""
_OUT = "file_path, line_start, doc_id, round_even(score, 9) AS score"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select(_path().alias("file_path"), (NOW - F.col("doc_id") % 14 * DAY).cast("double").alias("mtime"))


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("file_path", "line_start", "doc_id", tx.rounded(F.col("score"), 9).alias("score"), *more)


@_query(f"WITH {_LEGS} SELECT {_OUT} FROM merged")
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    return _out(ranking.merge(*_legs(spark, d, 2 * LIMIT), payload=["doc_id"]))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hybrid(*_legs(spark, d, 2 * LIMIT), 2 * LIMIT, payload=["doc_id"])


@_query(f"WITH {_LEGS} SELECT {_OUT}, rank FROM hyb")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _out(_hybrid(spark, d), "rank")


@_query(f"WITH {_LEGS} SELECT {_OUT}, rank FROM kept")
def min_score_filter(spark: SparkSession, d: str) -> DataFrame:
    return _out(ranking.above(_hybrid(spark, d)), "rank")


def _boosted(spark: SparkSession, d: str) -> DataFrame:
    return ranking.recency(ranking.above(_hybrid(spark, d)), _files(spark, d), NOW).withColumn("boosted", tx.rounded(F.col("boosted"), 9))


@_query(f"WITH {_LEGS} SELECT {_OUT}, rank, round_even(boosted, 9) AS boosted FROM boost")
def recency_boost(spark: SparkSession, d: str) -> DataFrame:
    return _out(_boosted(spark, d), "rank", "boosted")


@_query(f"WITH {_LEGS} SELECT {_OUT}, rank FROM best")
def boosted_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(ranking.boosted_top(_boosted(spark, d), LIMIT), "rank")


@_query(f"WITH {_LEGS} SELECT {_OUT}, rank, place FROM found")
def group_by_file(spark: SparkSession, d: str) -> DataFrame:
    return _out(ranking.by_file(ranking.boosted_top(_boosted(spark, d), LIMIT)), "rank", "place")


def _search(spark: SparkSession, d: str) -> DataFrame:
    payload = ["doc_id", "line_end", "content", "chunk_type", "name"]
    fused = ranking.hybrid(*_legs(spark, d, ranking.OVERFETCH * LIMIT), ranking.OVERFETCH * LIMIT, payload=payload)
    boosted = ranking.recency(ranking.above(fused), _files(spark, d), NOW).withColumn("boosted", tx.rounded(F.col("boosted"), 9))
    return ranking.by_file(ranking.boosted_top(boosted, LIMIT))


@_query(f"WITH {_LEGS} SELECT f.file_path, f.line_start, c.line_end, f.doc_id, c.chunk_type, c.name, CAST(length(c.content) AS INTEGER) AS chars, round_even(f.score, 9) AS score, f.rank, f.place FROM found f JOIN chunks c USING (doc_id)")
def search(spark: SparkSession, d: str) -> DataFrame:
    found = _search(spark, d)
    return found.select("file_path", "line_start", "line_end", "doc_id", "chunk_type", "name", F.length("content").alias("chars"), tx.rounded(F.col("score"), 9).alias("score"), "rank", "place")


@_query()
def search_response(spark: SparkSession, d: str) -> DataFrame:
    return response.search_response(_search(spark, d))


# Store and aggregates


def _new_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit(1).alias("line_start"), F.coalesce("text", F.lit("")).alias("content"))


def _old_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("doc_id", "file_path", "line_start", "content")


_STORED = f"{_CHUNKS}, old AS (SELECT doc_id, file_path, line_start, content FROM chunks), fresh AS (SELECT item_id AS doc_id, concat('bench/', CAST(item_id AS VARCHAR), '.md') AS file_path, 1 AS line_start, coalesce(text, '') AS content FROM benchmark)"


@_query(f"WITH {_STORED} SELECT * FROM old UNION ALL SELECT * FROM fresh")
def append_chunks(spark: SparkSession, d: str) -> DataFrame:
    return store.append(_old_chunks(spark, d), _new_chunks(spark, d))


@_query(f"WITH {_STORED}, {_FILES} SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM man)")
def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    return store.delete_by_file(_old_chunks(spark, d), _manifest(spark, d))


@_query(f"WITH {_STORED}, {_FILES} SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM man) UNION ALL SELECT * FROM fresh")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    return store.replace_by_file(_old_chunks(spark, d), _new_chunks(spark, d), _manifest(spark, d))


@_query(f"WITH {_CHUNKS} SELECT DISTINCT file_path FROM chunks")
def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    return store.indexed_files(_chunks(spark, d))


@_query("SELECT count(*) AS chunks_count FROM documents")
def chunk_count(spark: SparkSession, d: str) -> DataFrame:
    return store.stats(_chunks(spark, d)).select("chunks_count")


@_query(f"WITH {_CHUNKS} SELECT count(DISTINCT file_path) AS files_count, count(*) AS chunks_count FROM chunks")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.stats(_chunks(spark, d))


@_query(f"WITH {_CHUNKS}, {_FILES} SELECT count(DISTINCT file_path) > 0 AS is_indexed, count(DISTINCT file_path) AS files_count, count(*) AS chunks_count, (SELECT count(*) FROM chg WHERE change IN ('new', 'modified')) AS stale_count FROM chunks")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return store.status(_chunks(spark, d), _current(spark, d), _manifest(spark, d)).drop("last_updated")


@_query(f"WITH {_CHUNKS} SELECT count(*) AS results_count, CAST(0 AS BIGINT) AS filtered_out, count(DISTINCT file_path) AS unique_files, CAST(greatest(0, (sum(length(content)) + count(*) - 1) // 4) AS BIGINT) AS tokens_estimate FROM chunks")
def result_stats(spark: SparkSession, d: str) -> DataFrame:
    return response.result_stats(_chunks(spark, d))


@_query(f"""WITH {_CHUNKS}, l AS (SELECT doc_id, content, string_split(content, chr(10)) AS l FROM chunks)
SELECT doc_id, CASE WHEN len(l) > 50 THEN concat(array_to_string(l[1:50], chr(10)), chr(10), '... (truncated)') ELSE content END AS content, len(l) > 50 AS truncated FROM l""")
def truncate_content(spark: SparkSession, d: str) -> DataFrame:
    text, cut = tx.truncated(F.col("content"))
    return _chunks(spark, d).select("doc_id", text.alias("content"), cut.alias("truncated"))


FLAGSHIP = search
