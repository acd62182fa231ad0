"""Queries of text retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators import textsearch as X
from lodestrand.plans.registry import query

#: The stated set of text queries.
TEXT_QUERIES = [(1, "the threing of tion"), (2, "license general public"), (3, "password token"), (4, "der und lichen"), (5, "que ción mente")]


def asked(t) -> DataFrame:
    return t.spark.createDataFrame(TEXT_QUERIES, "query_id long, query string")


_indexes: dict[tuple, X.Postings] = {}


def index_of(t, words: bool = True, grams: bool = False) -> X.TextIndex:
    """The index of the documents of a folder, each part of it built once for each state of the folder's table."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/documents.parquet")
    status = path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path)
    state = (t.spark.sparkContext.applicationId, t.sf_dir, status.getModificationTime(), status.getLen())

    def part(build):
        if (*state, build.__name__) not in _indexes:
            _indexes[*state, build.__name__] = build(t.documents)
        return _indexes[*state, build.__name__]

    return X.TextIndex(part(X.build_words) if words else None, part(X.build_grams) if grams else None)


_VALUES = ", ".join(f"({i}, '{q}')" for i, q in TEXT_QUERIES)
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
TOKENS = f"""qs AS (SELECT query_id::BIGINT AS query_id, query FROM (VALUES {_VALUES}) v(query_id, query)),
tk AS (SELECT doc_id, list_filter(regexp_extract_all(replace(translate(lower(coalesce(text, '')), '{X.ACCENTED}', '{X.PLAIN}'), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_STOP}, w)) AS ws FROM documents),
qt AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(replace(translate(lower(query), '{X.ACCENTED}', '{X.PLAIN}'), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_STOP}, w))) AS term FROM qs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM tk) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM tk),
bm AS (SELECT query_id, doc_id, count(*) AS matched, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ws) / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term) JOIN tk USING (doc_id), st GROUP BY query_id, doc_id)"""


@query(f"WITH {TOKENS} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm) WHERE rank <= 20")
def bm25_topk(t) -> DataFrame:
    from lodestrand.operators.ranking import limit_each

    # Sums of the same terms differ in the last bits with their order; ranks follow nine places.
    top = limit_each(X.bm25(t.documents, asked(t), index=index_of(t)).withColumn("score", F.round("score", 9)), 20, ["doc_id"])
    return top.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


PHRASES = [(1, " General Public License "), (2, "the that"), (3, "  ")]


@query("""SELECT p.query_id, doc_id FROM documents JOIN (VALUES (1, 'general public license'), (2, 'the that')) p(query_id, q) ON contains(lower(text), q)""", longs="query_id")
def phrase_search(t) -> DataFrame:
    p = t.spark.createDataFrame(PHRASES, "query_id long, query string")
    return X.phrase_hits(t.documents, p, index=index_of(t))


#: Phrases of whole words; the last has a word that no text has.
WORD_PHRASES = [(1, "general public license"), (2, "Public-License"), (3, "the threing"), (4, "license"), (5, "und lichen und"), (6, "general xqzt")]
_WORDS = ", ".join(f"({i}, '{q.lower()}')" for i, q in WORD_PHRASES)


@query(f"""WITH raw AS (SELECT doc_id, regexp_extract_all(replace(translate(lower(coalesce(text, '')), '{X.ACCENTED}', '{X.PLAIN}'), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS p FROM raw),
qr AS (SELECT query_id, regexp_extract_all(q, '[\\p{{L}}\\p{{N}}]+') AS ws FROM (VALUES {_WORDS}) v(query_id, q)),
qp AS (SELECT * FROM (SELECT query_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS o FROM qr) WHERE NOT list_contains({_STOP}, term)),
need AS (SELECT query_id, count(*) AS need FROM qp GROUP BY query_id),
run AS (SELECT query_id, doc_id, p - o AS s, count(DISTINCT o) AS c FROM qp JOIN pos USING (term) GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, doc_id, count(*) AS freq FROM run JOIN need USING (query_id) WHERE c = need GROUP BY ALL""")
def match_phrase(t) -> DataFrame:
    """How often documents have a phrase's words side by side, from the positions in the index."""
    p = t.spark.createDataFrame(WORD_PHRASES, "query_id long, query string")
    return X.match_phrase(index_of(t), p)


@query(f"""WITH {TOKENS}, w AS (SELECT DISTINCT term AS wanted FROM qt), v AS (SELECT DISTINCT term FROM tf),
e AS (SELECT wanted, term, levenshtein(wanted, term) AS edits, CASE WHEN length(wanted) <= 2 THEN 0 WHEN length(wanted) <= 5 THEN 1 ELSE 2 END AS most FROM w JOIN v ON wanted[1] = term[1] AND abs(length(wanted) - length(term)) <= 2)
SELECT wanted, term, edits FROM e WHERE edits <= most""")
def fuzzy_terms(t) -> DataFrame:
    terms = asked(t).select(F.explode(X.tokens(F.col("query"))).alias("term"))
    return X.near_terms(index_of(t).vocabulary, terms)


@query(f"""WITH {TOKENS}, w AS (SELECT DISTINCT term AS wanted FROM qt), v AS (SELECT DISTINCT term FROM tf),
e AS (SELECT wanted, term, levenshtein(wanted, term) AS edits, CASE WHEN length(wanted) <= 2 THEN 0 WHEN length(wanted) <= 5 THEN 1 ELSE 2 END AS most FROM w JOIN v ON wanted[1] = term[1] AND abs(length(wanted) - length(term)) <= 2),
nt AS (SELECT wanted, term, edits FROM e WHERE edits <= most),
many AS (SELECT query_id, count(*) AS terms FROM qt GROUP BY query_id),
ph AS (SELECT query_id, doc_id FROM documents JOIN qs ON contains(lower(text), lower(trim(query)))),
cl AS (SELECT query_id, doc_id, score * (CASE WHEN matched = terms THEN 5 ELSE 0 END + CASE WHEN matched >= greatest(1, floor(terms * 0.6)) THEN 3 ELSE 0 END) AS s FROM bm JOIN many USING (query_id)
  UNION ALL SELECT query_id, doc_id, score * 8 FROM bm SEMI JOIN ph USING (query_id, doc_id)
  UNION ALL SELECT query_id, doc_id, 1 FROM ph
  UNION ALL SELECT query_id, doc_id, sum(s) * 2 FROM (SELECT query_id, doc_id, wanted, max(1.0::DOUBLE / (1 + edits)) AS s FROM qt JOIN nt ON qt.term = wanted JOIN tf ON tf.term = nt.term GROUP BY ALL) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(s) AS score FROM cl GROUP BY ALL HAVING sum(s) >= 0.1)) WHERE rank <= 20""")
def relevance_search(t) -> DataFrame:
    """All clauses together: phrase, all terms, most terms, near terms, wildcard."""
    from lodestrand.operators.ranking import limit_each

    return limit_each(X.relevance(t.documents.select("doc_id", "text"), asked(t), index=index_of(t)).withColumn("score", F.round("score", 9)), 20, ["doc_id"]).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {TOKENS}, w AS (SELECT DISTINCT term AS wanted FROM qt), v AS (SELECT DISTINCT term FROM tf),
e AS (SELECT wanted, term, levenshtein(wanted, term) AS edits, CASE WHEN length(wanted) <= 2 THEN 0 WHEN length(wanted) <= 5 THEN 1 ELSE 2 END AS most FROM w JOIN v ON wanted[1] = term[1] AND abs(length(wanted) - length(term)) <= 2),
nt AS (SELECT wanted, term, edits FROM e WHERE edits <= most),
many AS (SELECT query_id, count(*) AS terms FROM qt GROUP BY query_id),
ph AS (SELECT query_id, doc_id FROM documents JOIN qs ON contains(lower(text), lower(trim(query)))),
low AS (SELECT doc_id, string_split(lower(text), '') AS t FROM documents WHERE text <> '' UNION ALL SELECT doc_id, [] FROM documents WHERE coalesce(text, '') = ''),
gr AS (SELECT doc_id, list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2]) AS gs FROM low),
gf AS (SELECT doc_id, g, count(*) AS tf FROM (SELECT doc_id, unnest(gs) AS g FROM gr) GROUP BY ALL),
gst AS (SELECT count(*) AS n, avg(len(gs)) AS avgdl FROM gr),
qg AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, length(q) - 1), lambda i: q[i:i + 2])) AS g FROM (SELECT query_id, lower(trim(query)) AS q FROM qs)),
gneed AS (SELECT query_id, count(*) AS need FROM qg GROUP BY query_id),
gb AS (SELECT query_id, doc_id, count(*) AS c, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(gs) / avgdl))) AS score
  FROM qg JOIN gf USING (g) JOIN (SELECT g, count(*) AS df FROM gf GROUP BY g) USING (g) JOIN gr USING (doc_id), gst GROUP BY query_id, doc_id),
cl AS (SELECT query_id, doc_id, score * (CASE WHEN matched = terms THEN 5 ELSE 0 END + CASE WHEN matched >= greatest(1, floor(terms * 0.6)) THEN 3 ELSE 0 END) AS s FROM bm JOIN many USING (query_id)
  UNION ALL SELECT query_id, doc_id, score * 8 FROM bm SEMI JOIN ph USING (query_id, doc_id)
  UNION ALL SELECT query_id, doc_id, score * 2.5 FROM gb JOIN gneed USING (query_id) WHERE c = need
  UNION ALL SELECT query_id, doc_id, sum(s) * 2 FROM (SELECT query_id, doc_id, wanted, max(1.0::DOUBLE / (1 + edits)) AS s FROM qt JOIN nt ON qt.term = wanted JOIN tf ON tf.term = nt.term GROUP BY ALL) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(s) AS score FROM cl GROUP BY ALL HAVING sum(s) >= 0.1)) WHERE rank <= 20""")
def relevance_ngrams(t) -> DataFrame:
    """All clauses over an index with n-grams, whose clause takes the wildcard's place."""
    from lodestrand.operators.ranking import limit_each

    found = X.relevance(t.documents.select("doc_id", "text"), asked(t), index=index_of(t, grams=True)).withColumn("score", F.round("score", 9))
    return limit_each(found, 20, ["doc_id"]).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def highlight(t) -> DataFrame:
    marked = X.highlight(F.col("text"), ["license", "password", "token"])
    return t.documents.select("doc_id", marked.alias("h")).where(F.size("h") > 0).select("doc_id", F.size("h").alias("n"), F.array_join("h", "\n").alias("fragments"))
