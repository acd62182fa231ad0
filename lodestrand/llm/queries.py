"""The registered queries of the training-data operators and their SQL.

Each query reads its whole table, calls its operator with production parameters and derives the columns of
its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import chat, decontaminate, exact, fim, langid, lines, mixing, neardup, negatives, quality, secret_scan, substrings, token_files
from lodestrand.shipping import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: The conversation that the contract adds: its texts hold the template's own control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = chat.format_conversations(turns.unionByName(probe))
    out = out.select("conv_id", chat.formatted().alias("f"), chat.loss_spans().alias("spans"))
    out = out.select("conv_id", "f", chat.masked_text(F.col("f"), F.col("spans")).alias("l"), chat.parse(F.col("f")).alias("turns"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"),
        F.sha2("l", 256).alias("loss_sha256"),
        F.length("f").cast("long").alias("formatted_chars"),
    )


OP1_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (
  SELECT *, length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS te,
    length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n')) AS re,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(te + CASE WHEN opens THEN 12 + re + 1 + 11 ELSE 11 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT md5(k) AS h FROM win GROUP BY md5(k) HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM win JOIN rep ON md5(k) = h), (SELECT unnest(range(0, 35)) AS j)),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w WHERE len(ws) > 0),
kept AS (SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.group_copies(read(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_items(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("item_ids"))


OP4_SQL = """
WITH fold AS (SELECT doc_id AS d, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\\x00-\\x7F])+'), lambda x: x <> '') AS ws FROM documents),
item AS (SELECT item_id AS i, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\\x00-\\x7F])+'), lambda x: x <> '') AS ws FROM benchmark),
dt AS (SELECT d, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM fold),
bt AS (SELECT i, least(13, len(ws)) AS size, unnest(ws) AS x, generate_subscripts(ws, 1) AS q FROM item WHERE len(ws) >= 4),
m AS (SELECT d, i, size, p - q AS shift, q FROM dt JOIN bt USING (x)),
big AS (SELECT d, i, shift FROM m GROUP BY ALL HAVING count(*) >= min(size) - CASE WHEN min(size) >= 10 THEN min(size) // 5 ELSE 0 END),
near AS (SELECT d, i, size, count(*) OVER (PARTITION BY d, i, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c13,
  count(*) OVER (PARTITION BY d, i, shift) AS c FROM m JOIN big USING (d, i, shift)),
hit AS (SELECT DISTINCT d, i FROM near WHERE CASE WHEN size < 13 THEN c ELSE c13 END >= size - CASE WHEN size >= 10 THEN size // 5 ELSE 0 END)
SELECT d AS doc_id, count(i) > 0 AS contaminated, count(i) AS n_items, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i), '') AS item_ids
FROM fold LEFT JOIN hit USING (d) GROUP BY d"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", "mix_block", "mix_slot", "mix_place", "in_mix")


#: From the definition: target weights are the square roots' whole parts over their sum; windows and deadlines by slot.
OP7_SQL = """
WITH RECURSIVE cnt AS (SELECT source AS src, count(*) AS n, greatest(1, floor(sqrt(count(*))))::BIGINT AS a FROM documents GROUP BY source),
goal AS (SELECT *, row_number() OVER (ORDER BY src NULLS FIRST) AS i, sum(a) OVER ()::BIGINT AS total FROM cnt),
given AS (SELECT list(a ORDER BY i) AS a, max(total) AS total FROM goal),
sim AS (
  SELECT -1::BIGINT AS t, a, total, list_transform(a, lambda x: 0::BIGINT) AS had, 0::BIGINT AS i FROM given WHERE total > 0
  UNION ALL
  SELECT t + 1, a, total, list_transform(range(1, len(a) + 1), lambda j: had[j] + (j = pick)::BIGINT), pick FROM (
    SELECT *, list_reduce(list_filter(range(1, len(a) + 1), lambda j: had[j] * total // a[j] <= t + 1),
      lambda x, y: CASE WHEN ((had[y] + 1) * total + a[y] - 1) // a[y] < ((had[x] + 1) * total + a[x] - 1) // a[x] THEN y ELSE x END) AS pick
    FROM sim WHERE t + 1 < total)),
slot AS (SELECT i, had[i] - 1 AS k, t AS s FROM sim WHERE t >= 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents),
b AS (SELECT r.*, r // 64 AS b, i, a, total FROM r JOIN goal ON source IS NOT DISTINCT FROM src),
z AS (SELECT min((n + 63) // 64 // a * total + s) AS z FROM goal JOIN slot ON slot.i = goal.i AND slot.k = ((n + 63) // 64) % a)
SELECT doc_id, source, b::BIGINT AS mix_block, (b // a * total + s)::BIGINT AS mix_slot, (r % 64)::BIGINT AS mix_place,
  b // a * total + s < (SELECT z FROM z) AS in_mix
FROM b JOIN slot ON slot.i = b.i AND slot.k = b.b % b.a"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINES_CTE = """
line AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs})),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
owner AS (SELECT k, min(doc_id) AS o FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT keyed.*, coalesce(o = doc_id, true) AS stays FROM keyed LEFT JOIN owner USING (k))"""

OP5_SQL = f"""
WITH {LINES_CTE.format(docs="documents")}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


def _bucket(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, _bucket(4) != 2)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(_bucket(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"), _bucket(5) != 0)
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(_bucket(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["rank"] < len(secret_scan.BASE))
    return out.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"))


#: Kind, pattern, measured group and its least length: the contract's own text first, then the added rules.
OP8_PATTERNS = (
    ("assign", """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN ([A-Z0-9]{1,16} ){0,3}PRIVATE KEY-----", 0, 0),
    ("git_token", "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat_token", "xox[abprs]-[-A-Za-z0-9]{10,}", 0, 0),
    ("map_key", "AIza[-_A-Za-z0-9]{35}", 0, 0),
    ("pay_key", "(rk|sk)_(live|test)_[A-Za-z0-9]{16,}", 0, 0),
    ("signed_token", "eyJ[-_A-Za-z0-9]{8,}[.]eyJ[-_A-Za-z0-9]{8,}[.][-_A-Za-z0-9]{8,}", 0, 0),
    ("url_login", "[a-z][-+.a-z0-9]{1,15}://[^\\x20\\x09-\\x0D:/@]{1,64}:[^\\x20\\x09-\\x0D:/@]{1,64}@", 0, 0),
)


def _op8_sql() -> str:
    part = """SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, $re${p}$re$, 0) AS hit,
    regexp_extract_all(t, $re${p}$re$, {group}) AS held, string_split_regex(t, $re${p}$re$) AS gap FROM d"""
    parts = " UNION ALL ".join(part.format(rank=i, kind=kind, least=least, p=p, group=group) for i, (kind, p, group, least) in enumerate(OP8_PATTERNS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
e AS (SELECT doc_id, rank, kind, least, generate_subscripts(hit, 1) AS i, unnest(hit) AS h, unnest(held) AS v, unnest(gap[1:len(hit)]) AS g FROM m WHERE len(hit) > 0),
p AS (SELECT *, sum(length(g)) OVER w + sum(length(h)) OVER w - length(h) AS s FROM e WINDOW w AS (PARTITION BY doc_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING)),
k AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || (s + length(h)) AS x FROM p WHERE length(v) >= least)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256(coalesce(string_agg(x, ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def near_ctes(docs: str, k: int, percent: int) -> str:
    """CTEs (for WITH RECURSIVE) ending in near_set(doc_id, n) and near_comp(doc_id, component_id) over ``docs``."""
    return f"""
near_words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {docs}),
near_sh AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
  WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' ')) END) AS sh FROM near_words)),
near_set AS (SELECT w.doc_id, count(sh) AS n FROM near_words w LEFT JOIN near_sh USING (doc_id) GROUP BY w.doc_id),
near_both AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM near_sh a JOIN near_sh b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
near_link AS (SELECT a, b FROM near_both JOIN near_set x ON x.doc_id = a JOIN near_set y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
near_side AS (SELECT a, b FROM near_link UNION ALL SELECT b, a FROM near_link),
near_reach AS (SELECT doc_id, doc_id AS r FROM near_set UNION SELECT near_side.b, near_reach.r FROM near_reach JOIN near_side ON near_side.a = near_reach.doc_id),
near_comp AS (SELECT doc_id, min(r) AS component_id FROM near_reach GROUP BY doc_id)"""


OP10_SQL = f"""
WITH RECURSIVE {near_ctes("documents", 3, 85)}
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM near_set JOIN near_comp USING (doc_id)"""


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = read(spark, sf_dir, "documents").select("doc_id", "text"), token_files.new_folder(spark)
    token_files.write_tokens(docs, path, str(public_tokenizers.path("word_bpe_49k.json")), end=2)
    return token_files.token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.restore(fim.fim(read(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, rate=100, spm_rate=50).drop("text"))
    digest = lambda c: F.sha2(F.col(c), 256)
    return out.select("doc_id", F.col("n_lines").alias("n"), "form", "prefix_chars", "middle_chars", digest("fim_text").alias("output_sha256"), digest("restored_text").alias("restored_sha256"))


#: Lines are counted and cut by list functions; the text is taken back from the cuts, not from the output.
OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls, list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i:i + 7])::BIGINT) AS hs FROM d),
c AS (SELECT *, len(ls) AS n, least(hs[1] % (len(ls) + 1), hs[2] % (len(ls) + 1)) AS a, greatest(hs[1] % (len(ls) + 1), hs[2] % (len(ls) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a + 1:b], '') AS mid, array_to_string(ls[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=10, window=(30, 90), scale=256)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.a, p.b AS pos, p.s AS ps, s.b, s.s, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s QUALIFY r <= 10)
SELECT a AS anchor_id, pos AS positive_id, r::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_mix_sources": op7_mix_sources,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_near_dedup": op10_near_dedup,
    "op11_token_files": op11_token_files,
    "op12_fim": op12_fim,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_mix_sources": OP7_SQL,
    "op8_secret_scan": _op8_sql(),
    "op10_near_dedup": OP10_SQL,
    "op12_fim": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
