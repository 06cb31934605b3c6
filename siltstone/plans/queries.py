"""The registered search and ranking queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import files, scoring, text, vocabulary as V
from siltstone.operators import bm25, results, selection
from siltstone.plans.records import DOCUMENTS_SQL, PARTS_SQL, documents, parts, table

WORDS = ["the", "worthless", "reresh"]
#: A query for names of parts.
NAMES = text.Query("small ring photo")
LOCAL = text.Query("the best")

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TOKENS = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{Co}]+') AS tok FROM documents)"
COUNTS = TOKENS + ", c AS (SELECT doc_id, len(tok)::BIGINT AS len, " + ", ".join(f"len(list_filter(tok, lambda x: x = '{w}'))::BIGINT AS tf{k}" for k, w in enumerate(WORDS)) + " FROM t)"
STATS = COUNTS + ", s AS (SELECT count(*) AS docs, avg(len) AS avg_len, " + ", ".join(f"count_if(tf{k} > 0)::BIGINT AS df{k}" for k in range(3)) + " FROM c)"
_IDF = lambda k: f"(CASE WHEN ln((docs - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((docs - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) END)"
SCORE = " + ".join(f"{_IDF(k)} * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))" for k in range(3))
BM25 = STATS + f", b AS (SELECT doc_id, round({SCORE}, 6) AS score FROM c, s WHERE tf0 + tf1 + tf2 > 0)"


def _counts(spark, sf_dir):
    return bm25.term_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), WORDS)


@query()
def stemmed_freq(spark, sf_dir):
    """Length and counts of words by stems and without accents, as folders are ranked; SQL has no stemmer."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = [p[0] for p in text.Query("running licenses worthless").terms]
    counts = bm25.term_counts(d, words, tokens=text.stemmed_tokens(F.col("text")))
    return counts.select("doc_id", "len", *[F.get("tf", F.lit(k)).alias(f"tf{k}") for k in range(len(words))])


@query(f"WITH {BM25} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 500")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.top(table(spark, sf_dir, "documents"), WORDS)


@query(f"WITH {STATS} SELECT docs, round(avg_len, 6) AS avg_len, df0, df1, df2 FROM s")
def bm25_stats(spark, sf_dir):
    s = bm25.statistics(_counts(spark, sf_dir), 3)
    return s.select("docs", F.round("avg_len", 6).alias("avg_len"), *[F.get("df", F.lit(k)).alias(f"df{k}") for k in range(3)])


@query(f"WITH {COUNTS} SELECT doc_id, len FROM c")
def doc_lengths(spark, sf_dir):
    return _counts(spark, sf_dir).select("doc_id", "len")


@query(f"WITH {COUNTS} SELECT doc_id, tf0, tf1, tf2 FROM c WHERE tf0 + tf1 + tf2 > 0")
def term_freq(spark, sf_dir):
    return _counts(spark, sf_dir).where(F.exists("tf", lambda x: x > 0)).select("doc_id", *[F.get("tf", F.lit(k)).alias(f"tf{k}") for k in range(3)])


@query(f"WITH {TOKENS} SELECT w AS word, count(*) AS df FROM (SELECT unnest(list_distinct(tok)) AS w FROM t) GROUP BY w")
def doc_freq(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.ranked_tokens(F.col("text")))).alias("word"))
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {STATS} SELECT round({_IDF(0)}, 6) AS idf0, round({_IDF(1)}, 6) AS idf1, round({_IDF(2)}, 6) AS idf2 FROM s")
def idf(spark, sf_dir):
    s = bm25.statistics(_counts(spark, sf_dir), 3)
    return s.select(*[F.round(bm25.idf(F.col("docs"), F.get("df", F.lit(k))), 6).alias(f"idf{k}") for k in range(3)])


PHRASES = f"WITH {TOKENS} SELECT doc_id, len(list_filter(range(1, len(tok)), lambda i: tok[i] = 'of' AND tok[i + 1] = 'the'))::BIGINT AS n FROM t"


@query(f"SELECT * FROM ({PHRASES}) WHERE n > 0")
def phrase_freq(spark, sf_dir):
    return bm25.phrase_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), ["of", "the"]).where("n > 0")



def _folded(x: str) -> str:
    """SQL for a text cut at camel-case boundaries, in lower case and without accents (of letters with marks; other
    compatibility forms than the sharp s are not in the tables)."""
    cut = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"strip_accents(replace(lower({cut}), 'ß', 'ss'))"


NAME_TOKENS = "regexp_extract_all(lower(name), '[\\p{L}\\p{Nl}\\p{No}]+|\\p{Nd}+')"
PATH_TOKENS = NAME_TOKENS.replace("name", "path")


@query(f"WITH {PARTS_SQL} SELECT path, array_to_string({NAME_TOKENS}, ' ') AS words FROM s")
def word_tokens_names(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.select("path", F.array_join(text.word_tokens(F.col("name")), " ").alias("words"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all({_folded("coalesce(text, '')")}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+|\\p{{Nd}}+'), lambda x: NOT list_contains({_list(V.STOP_WORDS)}, x)), ' ') AS terms FROM conversations")
def query_term_filter(spark, sf_dir):
    terms = text.without_stop_words(text.word_tokens(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(terms, " ").alias("terms"))


_KIND = "CASE " + " ".join(f"WHEN list_contains({_list(e)}, ltrim(ext, '.')) THEN '{k}'" for k, e in V.KINDS.items()) + " ELSE 'other' END"


@query(f"WITH {PARTS_SQL} SELECT path, {_KIND} AS kind, CASE WHEN {_KIND} = 'code' OR list_contains({_list(V.TEXT_EXTENSIONS)}, ext) THEN true ELSE false END AS is_text FROM s")
def kind_of(spark, sf_dir):
    return parts(spark, sf_dir).select("path", files.kind_of(F.col("name")).alias("kind"), files.is_text(F.col("name")).alias("is_text"))


@query(f"WITH {PARTS_SQL} SELECT path, list_contains({_list(V.SECRET_NAMES)}, lower(name)) OR starts_with(lower(name), '.env.') OR list_contains({_list(V.SECRET_EXTENSIONS)}, ext) AS sensitive FROM s")
def sensitive_flag(spark, sf_dir):
    return parts(spark, sf_dir).select("path", files.sensitive(F.col("name")).alias("sensitive"))


@query("SELECT page_id, (len(url) - len(replace(url, '/', '')))::INT AS depth, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent FROM pages")
def path_depth(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.depth(F.col("url")).alias("depth"), files.parent(F.col("url")).alias("parent"))


@query(f"WITH {PARTS_SQL} SELECT parent, count(*) AS entries, sum(size)::BIGINT AS bytes, max(modified) AS newest FROM s GROUP BY parent")
def parent_rollup(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("parent").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"), F.max("modified").alias("newest"))


@query(f"WITH {PARTS_SQL} SELECT parent, array_to_string(list_sort(list(name))[1:24], ', ') AS listing FROM s WHERE NOT (list_contains({_list(V.SECRET_EXTENSIONS)}, ext)) AND NOT starts_with(name, '.') GROUP BY parent")
def folder_listing(spark, sf_dir):
    p = parts(spark, sf_dir).where(~files.sensitive(F.col("name")) & ~F.col("name").startswith("."))
    first = selection.numbered(p.select("parent", "name", "path"), ["parent"], [F.col("name")], "nth", 24)
    return first.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("listing"))


def _sql_name_score(q: text.Query) -> str:
    n, w = len(q.words), _list(q.words)
    exact = f"(lower(name) = '{q.normalized}' OR lower(name[1:len(name) - len(ext)]) = '{q.normalized}')"
    here, there = f"len(list_intersect({w}, {NAME_TOKENS}))", f"len(list_intersect({w}, {PATH_TOKENS}))"
    return f"(CASE WHEN {exact} THEN 1.0::DOUBLE WHEN {here} = {n} THEN 0.91::DOUBLE WHEN {here} > 0 THEN 0.45::DOUBLE + 0.25::DOUBLE * {here} / {n} WHEN {there} = {n} THEN 0.72::DOUBLE ELSE 0.0::DOUBLE END)"


def _sql_groups(q: text.Query, tokens: str) -> str:
    return "(" + " + ".join(f"list_has_any({_list(g)}, {tokens})::INT" for g in q.groups) + ")"


@query(f"WITH {PARTS_SQL} SELECT path, round({_sql_name_score(NAMES)}, 6) AS score FROM s")
def name_score(spark, sf_dir):
    return parts(spark, sf_dir).select("path", F.round(scoring.name_score(F.col("path"), NAMES), 6).alias("score"))


_ALIAS = f"CASE WHEN b >= 0.72 THEN b WHEN {_sql_groups(NAMES, NAME_TOKENS)} = {len(NAMES.groups)} THEN greatest(b, 0.82::DOUBLE) WHEN {_sql_groups(NAMES, PATH_TOKENS)} = {len(NAMES.groups)} THEN greatest(b, 0.72::DOUBLE) ELSE b END"


@query(f"WITH {PARTS_SQL} SELECT path, round({_ALIAS}, 6) AS score FROM (SELECT *, {_sql_name_score(NAMES)} AS b FROM s)")
def alias_score(spark, sf_dir):
    return parts(spark, sf_dir).select("path", F.round(scoring.alias_score(F.col("path"), NAMES), 6).alias("score"))


_TEXT_TOKENS = NAME_TOKENS.replace("lower(name)", _folded("coalesce(text, '')"))


@query(f"SELECT doc_id, round(CASE WHEN m > 0 THEN 0.48::DOUBLE + 0.38::DOUBLE * m / {len(LOCAL.groups)} ELSE 0.0::DOUBLE END, 6) AS score FROM (SELECT doc_id, {_sql_groups(LOCAL, _TEXT_TOKENS)} AS m FROM documents)")
def content_score(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(scoring.content_score(F.col("text"), LOCAL), 6).alias("score"))


_KEPT = f"' ' || array_to_string(list_filter({_TEXT_TOKENS}, lambda x: NOT list_contains({_list(V.STOP_WORDS)}, x)), ' ') || ' '"


@query(f"SELECT doc_id, CASE WHEN contains({_KEPT}, ' {LOCAL.phrase} ') THEN 0.86::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN contains({_KEPT}, ' {LOCAL.phrase} ') THEN 'content' ELSE 'semantic' END AS source FROM documents")
def local_visibility(spark, sf_dir):
    v = scoring.visibility(F.col("path"), F.col("text"), LOCAL)
    return documents(spark, sf_dir).select("doc_id", v.alias("v")).select("doc_id", "v.score", "v.source")


_DESKTOP_TOKENS = "t AS (SELECT path, text, doc_id, regexp_extract_all(lower(path), '[\\p{L}\\p{N}\\p{Co}]+') || regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{Co}]+') AS tok FROM d)"
_DESKTOP = f"{DOCUMENTS_SQL}, {_DESKTOP_TOKENS}" + STATS[len(TOKENS):].replace("SELECT doc_id, len(tok)", "SELECT doc_id, path, len(tok)")


@query(f"WITH {_DESKTOP} SELECT path, round({SCORE}, 6) AS score, 2 AS priority FROM c, s WHERE tf0 + tf1 + tf2 > 0 ORDER BY priority, score DESC, path LIMIT 500")
def desktop_rank(spark, sf_dir):
    """Path and content are tokenized apart and counted together; full name matches come first."""
    q = text.Query(" ".join(WORDS))
    d = documents(spark, sf_dir)
    tokens = F.concat(text.ranked_tokens(F.col("path")), text.ranked_tokens(F.coalesce("text", F.lit(""))))
    counts = bm25.shared(bm25.term_counts(d.select("path", "text"), WORDS, tokens=tokens), "path")
    name = scoring.name_score(F.col("path"), q, ascii_only=True)
    kept = counts.crossJoin(F.broadcast(bm25.statistics(counts, 3))).withColumns({"name_score": name, "raw": bm25.score(3)}).where("raw > 0 or name_score >= 0.91")
    priority = F.when(F.col("name_score") == 1, 0).when(F.col("name_score") >= 0.91, 1).otherwise(2)
    return kept.select("path", F.round("raw", 6).alias("score"), priority.alias("priority")).orderBy("priority", F.desc("score"), "path").limit(500)


_COVER = f"CASE WHEN list_contains({_list(V.SECRET_EXTENSIONS)}, ext) THEN 'protected' WHEN list_contains({_list(V.SAMPLED_EXTENSIONS)}, ext) THEN 'sampled' WHEN {_KIND} = 'code' OR list_contains({_list(V.TEXT_EXTENSIONS)}, ext) THEN 'text' ELSE 'name_only' END"


@query(f"WITH {PARTS_SQL} SELECT count(*) AS scanned, " + ", ".join(f"count_if(c = '{x}')::BIGINT AS {x}" for x in ("text", "sampled", "unavailable", "name_only", "protected")) + f" FROM (SELECT {_COVER} AS c FROM s)")
def coverage_counts(spark, sf_dir):
    name = F.col("name")
    cover = F.when(files.sensitive(name), "protected").when(files.suffix(name).isin(V.SAMPLED_EXTENSIONS), "sampled").when(files.is_text(name), "text").otherwise("name_only")
    return results.coverage_counts(parts(spark, sf_dir).select(cover.alias("coverage")))


_ROBIN = f"{PARTS_SQL}, r AS (SELECT path, parent, p_partkey AS seq, row_number() OVER (PARTITION BY parent ORDER BY p_partkey)::INT AS turn, min(p_partkey) OVER (PARTITION BY parent) AS f FROM s)"


@query(f"WITH {_ROBIN} SELECT path, parent, seq, turn FROM r WHERE turn <= 8 ORDER BY turn, f, seq LIMIT 384")
def probe_round_robin(spark, sf_dir):
    p = parts(spark, sf_dir).select("path", "parent", F.col("p_partkey").alias("seq"))
    return selection.round_robin(p, per_folder=8, total=384)


_SCORED = f"{PARTS_SQL}, n AS (SELECT path, parent, name, ext, {_sql_name_score(NAMES)} AS name_score, (size % 10) / 10.0::DOUBLE AS content_score FROM s)"


def _candidates(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.select("path", "parent", scoring.name_score(F.col("path"), NAMES).alias("name_score"), ((F.col("size") % 10) / 10.0).alias("content_score"), F.when(F.col("size") % 3 == 0, "x").otherwise("").alias("text"))


@query(f"WITH {_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY name_score DESC, path) AS nth FROM n) SELECT path, (nth > 4 AND name_score < 0.96) AS late FROM k WHERE name_score >= 0.45")
def dir_diversity_cap(spark, sf_dir):
    p = selection.diverse(_candidates(spark, sf_dir), [F.desc("name_score"), F.col("path")])
    return p.where("name_score >= 0.45").select("path", "late")


def _quota_sql() -> str:
    """The choice, route by route: what is left is ranked, late rows last, and the share taken; explore goes by CRC-32."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    codes = "list_transform(regexp_extract_all(hex(encode(path)), '..'), lambda h: ('0x' || h)::BIGINT)"
    parts = [
        f"bits(i, c, k) AS (SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, {step}, k + 1 FROM bits WHERE k < 8)",
        "crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)",
        _SCORED + ", z AS (SELECT path, (size % 3 = 0) AS has_text FROM s)",
        f"given AS (SELECT path, parent, name_score, content_score, has_text, xor(list_reduce({codes}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM n JOIN z USING (path), crc)",
        "t0 AS (SELECT NULL::VARCHAR AS path, NULL::VARCHAR AS route, 0 AS step WHERE false)",
    ]
    where = {"name": "name_score >= 0.45 AND name_score <> 0.72", "content": "content_score >= 0.45", "context": "name_score = 0.72", "preview": "has_text AND content_score < 0.45", "explore": "true"}
    by = {"explore": "crc", "content": "content_score DESC"}
    for k, (route, quota) in enumerate([*V.QUOTAS.items(), ("explore", V.JUDGED)]):
        order = f"{by.get(route, 'name_score DESC')}, path"
        parts.append(f"l{k} AS (SELECT path, name_score, {'crc, ' if route == 'explore' else ''}content_score, row_number() OVER (PARTITION BY parent ORDER BY {order}) AS nth FROM given WHERE {where[route]} AND path NOT IN (SELECT path FROM t{k}))")
        parts.append(f"o{k} AS (SELECT path, row_number() OVER (ORDER BY nth > {selection.CAP} AND name_score < {selection.EXEMPT}, {order}) AS place FROM l{k})")
        parts.append(f"t{k + 1} AS (SELECT * FROM t{k} UNION ALL SELECT path, '{route}', {k} FROM o{k} WHERE place <= least({quota}, {V.JUDGED} - (SELECT count(*) FROM t{k})))")
    return "WITH RECURSIVE " + ",\n".join(parts) + f" SELECT path, route FROM t{len(V.QUOTAS) + 1}"


@query(_quota_sql())
def route_quota_select(spark, sf_dir):
    return selection.select_candidates(_candidates(spark, sf_dir)).select("path", "route")


@query(f"SELECT route, count(*) AS n FROM ({_quota_sql()}) GROUP BY route")
def routes_used(spark, sf_dir):
    return results.route_counts(selection.select_candidates(_candidates(spark, sf_dir)))


@query(f"WITH {BM25}, t2 AS (SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 128), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS pos FROM t2) SELECT doc_id, score, (pos // 32)::BIGINT AS batch, (pos % 32)::INT AS idx FROM r")
def batch_assign(spark, sf_dir):
    top = bm25.top(table(spark, sf_dir, "documents"), WORDS, limit=V.JUDGED)
    return selection.batches(top, [F.desc("score"), F.col("doc_id")])


_TOP = f"{BM25}, t2 AS (SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 128), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS pos FROM t2)"


@query(f"WITH {_TOP} SELECT doc_id, 'f' || (pos % 32)::VARCHAR AS key, (pos // 32)::BIGINT AS batch, (quality + 0.5::DOUBLE) / 2 AS probability FROM r JOIN labels USING (doc_id)")
def keyed_answers(spark, sf_dir):
    """Judged rows with the answers to their keys; the labels of documents stand for a judge's answers."""
    batched = batch_assign(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") + 0.5) / 2).alias("probability"))
    given = batched.join(labels, "doc_id").select("batch", F.concat(F.lit("f"), F.col("idx").cast("string")).alias("key"), "probability")
    return selection.answered(batched, given).select("doc_id", "key", "batch", "probability")


@query(f"WITH {_TOP} SELECT doc_id, (count(*) OVER () - pos)::INT AS rank FROM r")
def reverse_rank(spark, sf_dir):
    top = bm25.top(table(spark, sf_dir, "documents"), WORDS, limit=V.JUDGED)
    return selection.reverse_rank(top, [F.desc("score"), F.col("doc_id")]).select("doc_id", "rank")


@query(f"WITH {_TOP} SELECT doc_id, score FROM b ANTI JOIN t2 USING (doc_id) ORDER BY score DESC, doc_id LIMIT 128")
def next_candidates(spark, sf_dir):
    """The rows after those that were judged already."""
    counts = bm25.shared(_counts(spark, sf_dir), "doc_id")
    every = bm25.scored(counts, 3).select("doc_id", "score")
    judged = every.orderBy(F.desc("score"), "doc_id").limit(V.JUDGED)
    return every.join(F.broadcast(judged), "doc_id", "left_anti").orderBy(F.desc("score"), "doc_id").limit(V.JUDGED)


@query(f"WITH {PARTS_SQL} SELECT path, {_KIND} AS kind FROM s WHERE {_KIND} = 'document'")
def kind_filter(spark, sf_dir):
    p = parts(spark, sf_dir).select("path", files.kind_of(F.col("name")).alias("kind"))
    return p.where(files.of_kind(F.col("kind"), "document"))


@query("SELECT p_partkey, strftime(make_timestamp((p_retailprice * 1000000 * 1000000)::BIGINT), '%Y-%m-%d') AS day FROM part")
def day_labels(spark, sf_dir):
    """Days of made times, in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("p_retailprice") * 1000000 / 86400).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, CASE WHEN t < 1 THEN floor(t * 1000 + 0.5)::BIGINT::VARCHAR || ' ms' ELSE t::DECIMAL(18,1)::VARCHAR || ' s' END AS label FROM (SELECT event_id, (event_id % 4000) / 1000.0::DOUBLE AS t FROM events)")
def duration_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.duration_label((F.col("event_id") % 4000) / 1000.0).alias("label"))


_PHASES = ["starting", "scanning", "thinking", "complete", "partial", "stopped", "error"]


@query(f"""SELECT event_id, CASE WHEN u > 0 AND r = 0 THEN 'Cost unavailable' WHEN u > 0 OR phase IN ('partial', 'stopped', 'error') THEN 'Reported cost' WHEN phase IN ('starting', 'scanning', 'thinking') THEN 'Cost so far' ELSE 'Search cost' END AS label,
CASE WHEN u > 0 AND r = 0 THEN '—' WHEN cost > 0 AND cost < 0.0001 THEN '<$0.0001' ELSE '$' || format('{{:.4f}}', cost) END AS value
FROM (SELECT event_id, list_extract({_PHASES!r}, (event_id % 7)::INT + 1) AS phase, (event_id % 3)::INT AS u, (event_id % 2)::INT AS r, CASE WHEN event_id % 11 = 0 THEN 0.00005::DOUBLE ELSE (event_id % 16) / 16.0::DOUBLE END AS cost FROM events)""")
def cost_labels(spark, sf_dir):
    n = F.col("event_id")
    phase = F.get(F.array(*map(F.lit, _PHASES)), (n % 7).cast("int"))
    cost = F.when(n % 11 == 0, 0.00005).otherwise((n % 16) / 16.0)
    return table(spark, sf_dir, "events").select("event_id", results.cost_label(cost, n % 2, n % 3, phase).alias("c")).select("event_id", "c.label", "c.value")


@query("SELECT coalesce(sum(n), 0)::BIGINT AS bytes, coalesce(max(n), 0)::BIGINT AS largest, coalesce(sum(n), 0) <= 340000 AS within FROM (SELECT octet_length(encode(coalesce(text, ''))) AS n FROM documents)")
def byte_counts(spark, sf_dir):
    return results.byte_counts(table(spark, sf_dir, "documents"), budget=340_000)


@query(f"WITH {BM25}, h AS (SELECT doc_id FROM b ORDER BY score DESC, doc_id LIMIT 500) SELECT d.doc_id AS path FROM documents d SEMI JOIN h USING (doc_id)")
def allowed_actions(spark, sf_dir):
    """Actions (one on each document) that name one of the latest hits."""
    hits = bm25.top(table(spark, sf_dir, "documents"), WORDS).select(F.col("doc_id").alias("path"))
    return files.allowed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path")), hits)


_KEY = "'key ' || 'AKIA' || 'ABCDEFGHIJKLMNOP' || ' password=' || p_partkey::VARCHAR || 'secretvalue ' || p_name"


@query(f"SELECT p_partkey, regexp_replace(regexp_replace({_KEY}, 'AKIA[A-Z0-9]{{16}}', '{V.REDACTED}', 'g'), '(?i)(?:password)\\s*[=:]\\s*[\"'']?[^\\s\"'',;]{{6,}}', '{V.REDACTED}', 'g') AS redacted FROM part")
def redact_text(spark, sf_dir):
    given = F.concat(F.lit("key AKIA"), F.lit("ABCDEFGHIJKLMNOP password="), F.col("p_partkey").cast("string"), F.lit("secretvalue "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.redacted(given).alias("redacted"))


_EVIDENCE = """e AS (SELECT 'u' || (user_id % 500)::VARCHAR AS path, event_id AS seq, CASE WHEN event_type = 'purchase' OR event_id % 3 = 0 THEN round((event_id % 97) / 96.0::DOUBLE, 6) END AS probability, round((event_id % 53) / 52.0::DOUBLE, 6) AS score FROM events),
m AS (SELECT path, arg_max(probability, CASE WHEN probability IS NOT NULL THEN 1000000000000 ELSE 0 END + seq) AS p0, max(CASE WHEN probability IS NOT NULL THEN 1000000000000 ELSE 0 END + seq) AS best FROM e GROUP BY path),
h AS (SELECT m.path, e.probability, e.score FROM m JOIN e ON e.path = m.path AND e.seq = m.best % 1000000000000)"""


def _evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    verdict = F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 3 == 0), F.round((F.col("event_id") % 97) / 96.0, 6))
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 500).cast("string")).alias("path"), F.col("event_id").alias("seq"), verdict.alias("probability"), F.round((F.col("event_id") % 53) / 52.0, 6).alias("score"))


@query(f"WITH {_EVIDENCE} SELECT path, probability, score FROM h WHERE probability IS NULL OR probability >= 0")
def verdict_merge(spark, sf_dir):
    return results.merge_evidence(_evidence(spark, sf_dir), 0.0)


@query(f"WITH {_EVIDENCE} SELECT path, probability, score FROM h WHERE probability IS NULL OR probability >= 0.6")
def reject_threshold(spark, sf_dir):
    return results.merge_evidence(_evidence(spark, sf_dir))


@query(f"WITH {_EVIDENCE} SELECT count_if(probability IS NOT NULL)::BIGINT AS verified, count_if(probability IS NULL)::BIGINT AS unverified FROM h WHERE probability IS NULL OR probability >= 0.6")
def verified_counts(spark, sf_dir):
    return results.verified_counts(results.merge_evidence(_evidence(spark, sf_dir)))


@query(f"WITH {PARTS_SQL} SELECT path, probability, rank FROM (SELECT path, modified, CASE WHEN p_partkey % 2 = 0 THEN round((p_partkey % 89) / 88.0::DOUBLE, 6) END AS probability, round((p_partkey % 31) / 30.0::DOUBLE, 6) AS rank, len(path) - len(replace(path, '/', '')) AS depth FROM s) ORDER BY (probability IS NOT NULL) DESC, rank DESC, depth, modified DESC, path LIMIT 500")
def result_order(spark, sf_dir):
    p = parts(spark, sf_dir)
    hits = p.select("path", "modified", F.when(F.col("p_partkey") % 2 == 0, F.round((F.col("p_partkey") % 89) / 88.0, 6)).alias("probability"), F.round((F.col("p_partkey") % 31) / 30.0, 6).alias("rank"), files.depth(F.col("path")).alias("depth"))
    return results.ordered(hits).select("path", "probability", "rank")


_COST = "CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '-1' WHEN 2 THEN 'true' ELSE (event_id % 7)::VARCHAR END"


@query(f"SELECT coalesce(round(sum(v), 6), 0.0::DOUBLE) AS cost, count(*) AS requests, count(v) AS reports, count_if(v IS NULL)::BIGINT AS unreported FROM (SELECT CASE WHEN x IS NOT NULL AND NOT isnan(x) AND x >= 0 AND NOT isinf(x) THEN x END AS v FROM (SELECT CASE WHEN c = 'true' THEN NULL ELSE try_cast(c AS DOUBLE) END AS x FROM (SELECT {_COST} AS c FROM events)))")
def cost_rollup(spark, sf_dir):
    case = F.when(F.col("event_id") % 5 == 0, "nan").when(F.col("event_id") % 5 == 1, "-1").when(F.col("event_id") % 5 == 2, "true").otherwise((F.col("event_id") % 7).cast("string"))
    return results.cost_rollup(table(spark, sf_dir, "events").select(case.alias("cost")))


@query("SELECT p_partkey, CASE WHEN b < 1024 THEN b::VARCHAR || ' B' WHEN b < 1048576 THEN format('{:.1f}', b / 1024.0::DOUBLE) || ' KB' ELSE format('{:.1f}', b / 1048576.0::DOUBLE) || ' MB' END AS label FROM (SELECT p_partkey, (p_size * 1000)::BIGINT AS b FROM part)")
def size_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", files.size_label((F.col("p_size") * 1000).cast("long")).alias("label"))


@query("SELECT path, size FROM (SELECT l.p_partkey, 'f' || l.p_partkey::VARCHAR AS path, l.p_size::BIGINT AS size, r.p_size AS other FROM part l JOIN (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part) r USING (p_partkey)) WHERE size = other")
def unchanged_signatures(spark, sf_dir):
    """Records whose signature is the same before and after reading."""
    p = table(spark, sf_dir, "part")
    before = p.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("size"))
    after = p.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("long").alias("size"))
    return before.join(after, ["path", "size"], "left_semi")


def ranked_items(spark, sf_dir) -> DataFrame:
    """For every benchmark item: documents ranked by how many of the item's distinct words (four letters or more) they
    have, at least half of them; one join of postings with the items' words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0)))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    wanted = items.select("query", "n", F.explode("w").alias("word"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(words(F.col("text"))).alias("word"))
    return docs.join(wanted, "word").groupBy("query", "n", "doc").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") * 2 >= F.col("n"))


_WORDS4 = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{4,}'))"
_METRICS = f"""WITH i AS (SELECT item_id AS query, {_WORDS4} AS w FROM benchmark), iw AS (SELECT query, len(w) AS n, unnest(w) AS word FROM i),
dw AS (SELECT doc_id AS doc, unnest({_WORDS4}) AS word FROM documents), m AS (SELECT query, n, doc, count(*) AS met FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) * 2 >= n),
r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY met DESC, doc) AS rank FROM m),
q AS (SELECT DISTINCT b.item_id AS query, d.doc_id AS doc FROM benchmark b, documents d WHERE contains(d.text, b.text)), per AS (SELECT query, count(*) AS n FROM q GROUP BY query),
g AS (SELECT query, sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg, max((rank <= 5)::INT) AS hit, count_if(rank <= 100) AS found FROM r SEMI JOIN q USING (query, doc) GROUP BY query),
j AS (SELECT per.query, n, coalesce(dcg, 0) AS dcg, coalesce(hit, 0) AS hit, coalesce(found, 0) AS found, list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1.0::DOUBLE / log2(k + 1.0::DOUBLE))) AS ideal FROM per LEFT JOIN g USING (query))
SELECT count(*) AS queries, round(avg(dcg / ideal), 6) AS ndcg_10, round(avg(hit::DOUBLE), 6) AS hit_5, round(avg(found / n::DOUBLE), 6) AS recall_100 FROM j"""


@query(_METRICS)
def ndcg_recall(spark, sf_dir):
    from pyspark.sql import Window

    r = ranked_items(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("met"), "doc"))).where("rank <= 100")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    near = ranked_items(spark, sf_dir).where("met = n").select("query", "doc")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    relevant = near.join(items, "query").join(docs, "doc").where(F.contains("text", "passage")).select("query", "doc")
    return results.retrieval_metrics(r, relevant)


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
