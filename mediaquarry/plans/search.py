from pyspark.sql import functions as F

from ..operators import search as S
from ..registry import query
from ..sources.tables import table

TOK = "regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')"
TERMS = ["idiot", "the"]
BM25 = f"""t AS (SELECT doc_id, {TOK} AS w FROM documents), p AS (SELECT doc_id, term, len(w) AS dl, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM t) WHERE term IN ('idiot', 'the') GROUP BY ALL),
    s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    r AS (SELECT doc_id, count(*) AS k, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM p JOIN f USING (term), s GROUP BY doc_id)"""


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("fts01_assemble", "SELECT page_id, array_to_string(list_filter([url, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'tag' END, ' ', CAST(page_id AS VARCHAR)], lambda x: trim(x) <> ''), ' ') AS body FROM pages")
def fts01(spark, d):
    body = S.assemble(F.array("url"), F.array(F.when(F.col("page_id") % 2 == 0, "").otherwise("tag"), F.lit(" ")), F.array(F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", body.alias("body"))


@query("fts02_postings", f"SELECT term, doc_id, CAST(len(w) AS INTEGER) AS dl, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM (SELECT doc_id, {TOK} AS w FROM documents)) GROUP BY ALL")
def fts02(spark, d):
    return S.postings(docs(spark, d))


@query("fts03_search", f"WITH {BM25} SELECT doc_id, score FROM r WHERE k = 2 ORDER BY score DESC, doc_id LIMIT 50")
def fts03(spark, d):
    return S.match(docs(spark, d), " ".join(TERMS), ["text"], 50)


BOOLEAN = f"""t AS (SELECT doc_id, {TOK} AS w, regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}]+') AS u FROM documents), c AS (SELECT doc_id, len(w) + len(u) AS dl, len(list_filter(list_concat(w, u), lambda x: x = 'idiot')) AS n0, len(list_filter(list_concat(w, u), lambda x: starts_with(x, 'thei'))) AS n1,
    len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS n2, len(list_filter(u, lambda x: x = 'src1')) AS n3 FROM t),
    s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (n0 > 0) AS d0, count(*) FILTER (n1 > 0) AS d1, count(*) FILTER (n2 > 0) AS d2, count(*) FILTER (n3 > 0) AS d3 FROM c)"""
WEIGHED = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in range(4))


@query("fts03_boolean", f"WITH {BOOLEAN} SELECT doc_id, round({WEIGHED}, 6) AS score FROM c, s WHERE (n0 > 0 OR (n1 > 0 AND NOT n2 > 0) OR n3 > 0) AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 ORDER BY score DESC, doc_id LIMIT 100")
def fts03_boolean(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "text", "source", "doc_id % 7 = 0 AS hidden", "doc_id % 11 = 0 AS excluded")
    return S.match(rows, 'idiot OR thei* NOT "of the" OR source:src1', ["text", "source"], 100)


@query("fts03_phrase", f"SELECT doc_id FROM (SELECT doc_id, {TOK} AS w FROM documents) WHERE array_to_string(w, ' ') = 'of the' OR (' ' || array_to_string(w, ' ') || ' ') LIKE '% of the %'")
def fts03_phrase(spark, d):
    return S.phrase_match(docs(spark, d), ["of", "the"])


@query("fts03_prefix", f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) WHERE starts_with(term, 'idi')")
def fts03_prefix(spark, d):
    return S.prefix_match(S.postings(docs(spark, d)), "idi")


@query("fts04_reindex", f"SELECT term, doc_id, CAST(len(w) AS INTEGER) AS dl, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM (SELECT doc_id, {TOK} AS w FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang || ' ' || source ELSE text END AS text FROM documents))) GROUP BY ALL")
def fts04(spark, d):
    changed = table(spark, d, "documents").filter("doc_id % 5 = 0").select("doc_id", F.concat_ws(" ", "lang", "source").alias("text"))
    return S.reindex(S.postings(docs(spark, d)), changed).select("term", "doc_id", "dl", "tf")


@query("jn03_search_with_media", f"WITH {BM25} SELECT r.doc_id, score, lang FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE k = 2 AND source <> 'src0' ORDER BY score DESC, r.doc_id LIMIT 20")
def jn03(spark, d):
    hits = S.match(docs(spark, d), " ".join(TERMS), ["text"], 1 << 30)
    meta = table(spark, d, "documents").filter("source <> 'src0'").select("doc_id", "lang")
    return hits.join(meta, "doc_id").orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score", "lang")
