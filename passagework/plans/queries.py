"""Registered queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.constants import MAX_PASSAGE_CHARS, SPACE_CLASS_RE2, STOP_WORDS
from passagework.functions import text as T
from passagework.functions.identity import score_hash
from passagework.functions.spec import Criteria, QuerySpec
from passagework.operators import evaluate, inclusions, judge, ranges, ranking, report, score_store
from passagework.operators.answer import answer, retrieve
from passagework.operators.index import Index, prepare
from passagework.operators.markdown import parse_notes
from passagework.sources.notes import difference, searchable
from passagework.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage for each line of a document with something on it."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("line"), "text").filter(F.col("text").rlike(r"\S"))


_INDEXES: dict[tuple, Index] = {}


def indexed(spark: SparkSession, sf_dir: str, what: str = "lines") -> Index:
    """The prepared index of a folder's lines or documents, built once for a state of its
    files. Timing the build is ``bench.py``'s first entry."""
    make, state = spark._jvm.org.apache.hadoop.fs.Path, []
    for name in load(spark, sf_dir, "documents").inputFiles():
        status = make(name).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(make(name))
        state.append((name, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, sf_dir, what, tuple(sorted(state)))
    if key not in _INDEXES:
        docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text") if what == "documents" else lines(spark, sf_dir)
        _INDEXES[key] = prepare(docs, ["id"] if what == "documents" else ["doc_id", "line"])
    return _INDEXES[key]


QUESTION = "what is the erhe of on thnt and le des than thre"
QUESTIONS = [
    "the erhe than thre", "what is on thnt", "le des les oire", "der die und schen", "que del los ado", "inea oring ation", "thor ondth entre", "eau ment tre", "ung heit keit", "ción mente osa",
    "erst and here", "reed ones ting", "aux elle pour", "nicht auf sich", "con una las", "hath ness stou", "edor ions with", "vi ch par", "ver ge be", "the and of",
]
WS = SPACE_CLASS_RE2
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(column: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains([{STOP}], w))"


def sql_print(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'))"


LINES = r"lines AS (SELECT doc_id, i::BIGINT AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(l, '\S'))"


def sql_bm25(source: str, keys: str, questions: str) -> str:
    """CTEs that end in ``scored`` (qid, keys, fp, s), scores of 9 digits."""
    return f"""
    asked AS ({questions}),
    terms AS (SELECT DISTINCT qid, unnest({sql_tokens("question")}) AS term FROM asked),
    tok AS (SELECT {keys}, {sql_print("text")} AS fp, {sql_tokens("text")} AS words FROM {source}),
    st AS (SELECT count(*)::DOUBLE AS n, greatest(1.0::DOUBLE, coalesce(sum(len(words)), 0)::DOUBLE / greatest(1, count(*))) AS avg_len FROM tok),
    tf AS (SELECT {keys}, fp, len, term, count(*)::DOUBLE AS tf FROM (SELECT {keys}, fp, len(words) AS len, unnest(words) AS term FROM tok) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
    df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
    scored AS (SELECT qid, {keys}, fp, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.75::DOUBLE + 0.25::DOUBLE * len / avg_len))) * (1 + ln(count(*)::DOUBLE)), 9) AS s
               FROM tf JOIN df USING (term) JOIN terms USING (term) CROSS JOIN st GROUP BY qid, {keys}, fp)"""


def one_question(spark: SparkSession, text: str = QUESTION) -> DataFrame:
    return spark.createDataFrame([(0, text)], "qid long, question string")


@query(rf"SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, coalesce(w[1], '') AS first_token FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)")
def f1_tokens(spark, sf_dir):
    w = load(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first_token"))


@query(rf"WITH {LINES}, tok AS (SELECT {sql_tokens('text')} AS w FROM lines) SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS total, round(sum(len(w))::DOUBLE / count(*), 9) AS avg_len FROM tok")
def a2_corpus_stats(spark, sf_dir):
    t = lines(spark, sf_dir).select(F.size(T.tokens("text")).cast("long").alias("n"))
    return t.agg(F.count("*").alias("n"), F.sum("n").alias("total"), F.round(F.sum("n").cast("double") / F.count("*"), 9).alias("avg_len"))


@query(rf"WITH {LINES}, tok AS (SELECT DISTINCT doc_id, line, unnest({sql_tokens('text')}) AS term FROM lines) SELECT term, count(*)::BIGINT AS df FROM tok GROUP BY term")
def a3_document_frequency(spark, sf_dir):
    return indexed(spark, sf_dir).terms


@query(rf"WITH {LINES}, {sql_bm25('lines', 'doc_id, line', f'SELECT 0 AS qid, {chr(39)}{QUESTION}{chr(39)} AS question')} SELECT doc_id, line, s AS lexical_score FROM scored ORDER BY s DESC, doc_id, line LIMIT 100")
def a4_bm25(spark, sf_dir):
    scored = indexed(spark, sf_dir).bm25(ranking.question_terms(one_question(spark)))
    return scored.select("doc_id", "line", F.round("lexical_score", 9).alias("lexical_score")).orderBy(F.desc("lexical_score"), "doc_id", "line").limit(100)


COPIES = "copies AS (SELECT *, row_number() OVER (PARTITION BY qid, fp ORDER BY s DESC, {keys}) > 1 AS is_copy FROM scored), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY is_copy, s DESC, {keys})::BIGINT AS rank FROM copies)"


@query(rf"WITH {LINES}, {sql_bm25('lines', 'doc_id, line', 'SELECT 0 AS qid, ' + chr(39) + 'the and inea thanedble' + chr(39) + ' AS question')}, {COPIES.format(keys='doc_id, line')} SELECT doc_id, line, s AS lexical_score, is_copy, rank FROM ranked WHERE rank <= 400")
def d1_copy_demotion(spark, sf_dir):
    terms = ranking.question_terms(one_question(spark, "the and inea thanedble"))
    return ranking.lexical(indexed(spark, sf_dir), terms, 400, digits=9).select("doc_id", "line", "lexical_score", "is_copy", "rank")


MANY = " UNION ALL ".join(f"SELECT {k} AS qid, '{q}' AS question" for k, q in enumerate(QUESTIONS))


@query(rf"WITH {LINES}, {sql_bm25('lines', 'doc_id, line', MANY)}, {COPIES.format(keys='doc_id, line')} SELECT qid::BIGINT AS qid, doc_id, line, s AS lexical_score, rank FROM ranked WHERE rank <= 20")
def m_many_questions(spark, sf_dir):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid long, question string")
    return ranking.lexical(indexed(spark, sf_dir), ranking.question_terms(asked), 20, digits=9).select("qid", "doc_id", "line", "lexical_score", "rank")


@query(rf"SELECT fp_hash, n, first_doc FROM (SELECT sha256(fp) AS fp_hash, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {sql_print('text')} AS fp FROM documents) GROUP BY fp)")
def a5_duplicate_groups(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(T.fingerprint("text"), 256).alias("fp_hash"))
    return docs.groupBy("fp_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def _vectors(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v, v.filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query_vector"))


DOT = "round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(rf"WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, {DOT} AS semantic_score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY semantic_score DESC, id)::BIGINT AS rank FROM s WHERE semantic_score >= 0.15) SELECT * FROM r WHERE rank <= 32")
def t3_vector_topk(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all."""
    v, q = _vectors(spark, sf_dir)
    return ranking.vector_topk(v, q, 32, digits=6)


FUSED = rf"""WITH {sql_bm25('documents', 'doc_id', 'SELECT 0 AS qid, ' + chr(39) + 'than thre conflict ation' + chr(39) + ' AS question')}, {COPIES.format(keys='doc_id')},
lex AS (SELECT doc_id AS id, rank AS lr FROM ranked WHERE rank <= 200),
sem AS (SELECT id, row_number() OVER (ORDER BY sc DESC, id)::BIGINT AS sr FROM (SELECT v.vec_id AS id, {DOT} AS sc FROM embeddings v, embeddings q WHERE q.vec_id = 0) WHERE sc >= 0.15 QUALIFY sr <= 200),
f AS (SELECT id, round(coalesce(0.65::DOUBLE / (60 + lr), 0.0::DOUBLE) + coalesce(0.35::DOUBLE / (60 + sr), 0.0::DOUBLE), 9) AS s FROM lex FULL JOIN sem USING (id)),
g AS (SELECT id, s, {sql_print('text')} AS fp FROM f JOIN documents ON id = doc_id),
h AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY s DESC, id) > 1 AS is_copy FROM g)
SELECT id, s AS retrieval_score, is_copy, row_number() OVER (ORDER BY is_copy, s DESC, id)::BIGINT AS rank FROM h QUALIFY rank <= 51"""


@query(FUSED)
def j2_rrf_fusion(spark, sf_dir):
    docs = indexed(spark, sf_dir, "documents")
    lex = ranking.lexical(docs, ranking.question_terms(one_question(spark, "than thre conflict ation")), 200, digits=9)
    v, q = _vectors(spark, sf_dir)
    sem = ranking.vector_topk(v, q.filter("qid = 0"), 200, digits=6)
    return ranking.fuse(lex, sem, docs.passages, "id", 51, digits=9).select("id", "retrieval_score", "is_copy", "rank")


def _windows(spark, sf_dir) -> DataFrame:
    """Overlapping ranges with made-up scores: three lines from each line on."""
    df = lines(spark, sf_dir)
    return df.select("doc_id", F.col("line").alias("line_start"), (F.col("line") + F.col("line") % 3).alias("line_end"), ((F.col("doc_id") * 31 + F.col("line") * 17) % 101).cast("double").alias("score"))


WINDOWS = LINES + ", win AS (SELECT doc_id, line AS s, line + line % 3 AS e, ((doc_id * 31 + line * 17) % 101)::DOUBLE AS score FROM lines)"


def sql_fold(order: str, step: str) -> str:
    return f"""WITH {WINDOWS}, l AS (SELECT doc_id, list({{'s': s, 'e': e, 'score': score}} ORDER BY {order}) AS xs FROM win GROUP BY doc_id),
    k AS (SELECT doc_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, y: {step})) AS r FROM l)
    SELECT doc_id, r.s AS line_start, r.e AS line_end, r.score AS score FROM k"""


@query(sql_fold("score DESC, e - s, s", "CASE WHEN len(list_filter(acc, lambda k: k.s <= y[1].e AND y[1].s <= k.e)) > 0 THEN acc ELSE list_concat(acc, y) END"))
def d2_overlap(spark, sf_dir):
    return ranges.drop_overlaps(_windows(spark, sf_dir), [-F.col("score"), T.span(), F.col("line_start")], ["doc_id"])


@query(sql_fold("s, e", "CASE WHEN NOT (acc[-1].s <= y[1].e AND y[1].s <= acc[-1].e) THEN list_concat(acc, y) WHEN y[1].e - y[1].s > acc[-1].e - acc[-1].s THEN list_concat(acc[1:len(acc) - 1], y) ELSE acc END"))
def d3_context_ranges(spark, sf_dir):
    return ranges.context_ranges(_windows(spark, sf_dir), ["doc_id"])


@query(sql_fold("score DESC, s", "CASE WHEN y[1].s % 7 <> 0 AND len(list_filter(acc, lambda k: k.s <= y[1].s AND k.e >= y[1].e)) > 0 THEN acc ELSE list_concat(acc, y) END"))
def d4_coverage(spark, sf_dir):
    w = _windows(spark, sf_dir).withColumn("manual", F.col("line_start") % 7 == 0)
    w = w.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_start")))
    return ranges.drop_covered(w, ["doc_id"]).select("doc_id", "line_start", "line_end", "score")


@query(rf"WITH {LINES} SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY line)) AS context_hash FROM lines GROUP BY doc_id")
def a12_context(spark, sf_dir):
    return ranges.assembled(lines(spark, sf_dir), ["doc_id"], ["line"]).select("doc_id", F.sha2("context", 256).alias("context_hash"))


@query(rf"WITH {LINES} SELECT doc_id, line, min(line) OVER w AS from_line, max(line) OVER w AS to_line, sha256(string_agg(text, chr(10) || chr(10)) OVER w) AS widened_hash FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def j7_neighbours(spark, sf_dir):
    df = lines(spark, sf_dir).withColumns({"line_start": F.col("line"), "line_end": F.col("line")})
    return ranges.neighbours(df, ["doc_id"], "line", 1).select("doc_id", "line", "from_line", "to_line", F.sha2("widened", 256).alias("widened_hash"))


def _store(spark, sf_dir) -> DataFrame:
    """Scores of the labelled documents' texts."""
    labelled = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    score = (F.col("quality") * 0.5 + F.col("toxic") * 0.25).cast("double")
    rows = labelled.groupBy(F.sha2("text", 256).alias("hash")).agg(F.max(score).alias("score"), F.max("doc_id").alias("accessed"))
    return rows.select("hash", "score", F.lit("other").alias("contribution"), F.create_map(F.lit("relevant"), "score").alias("scores"), "accessed")


@query("WITH st AS (SELECT sha256(text) AS hash, max(quality * 0.5 + toxic * 0.25)::DOUBLE AS score FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT doc_id, sha256(text) AS hash, score, score IS NOT NULL AS hit FROM documents LEFT JOIN st ON sha256(text) = hash")
def j3_cache_hit_miss(spark, sf_dir):
    wanted = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    hits, pending = score_store.lookup(wanted, _store(spark, sf_dir))
    cached = hits.select("doc_id", "hash", "score", F.lit(True).alias("hit"))
    return cached.unionByName(pending.select("doc_id", "hash", F.lit(None).cast("double").alias("score"), F.lit(False).alias("hit")))


@query("WITH u AS (SELECT user_id::VARCHAR AS hash, value AS score, event_id AS accessed, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT hash, score, accessed FROM u WHERE k = 1 ORDER BY accessed DESC, hash LIMIT 100")
def k1_lru(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("string").alias("hash"), F.col("value").alias("score"), F.lit("other").alias("contribution"), F.create_map(F.lit("relevant"), "value").alias("scores"), F.col("event_id").alias("accessed"))
    return score_store.upsert(rows.filter("accessed % 2 = 0"), rows.filter("accessed % 2 = 1"), 100).select("hash", "score", "accessed")


@query("WITH d AS (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang, text), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM d) SELECT lang, doc_id, (k // 10)::BIGINT AS batch_id, (k % 10)::BIGINT AS slot FROM n")
def u3_batches(spark, sf_dir):
    once = load(spark, sf_dir, "documents").groupBy("lang", "text").agg(F.min("doc_id").alias("doc_id")).drop("text")
    return judge.batched(once, 10, ["lang"], ["doc_id"])


WORDS = ("the", "of", "de", "la", "und", "der", "que", "and")


def _judged(spark, sf_dir) -> DataFrame:
    """Documents by the share of eight words that they have; contributions by id."""
    found = F.size(F.array_intersect(F.split(F.lower("text"), r"[\s.,]+"), F.array(*map(F.lit, WORDS))))
    names = F.array(*map(F.lit, ("definition", "condition", "distinction", "other")))
    return load(spark, sf_dir, "documents").select("doc_id", (found / F.lit(float(len(WORDS)))).alias("score"), F.get(names, (F.col("doc_id") % 4).cast("int")).alias("contribution"))


JUDGED = "judged AS (SELECT doc_id, len(list_intersect(regexp_split_to_array(lower(text), '[\\s.,]+'), [" + ", ".join(f"'{w}'" for w in WORDS) + "]))::DOUBLE / 8 AS score, ['definition', 'condition', 'distinction', 'other'][doc_id % 4 + 1] AS contribution FROM documents)"


@query(f"WITH {JUDGED} SELECT doc_id, score, score >= 0.45 AS passed FROM judged")
def p6_threshold_split(spark, sf_dir):
    passed, below = judge.threshold_split(_judged(spark, sf_dir), 0.45)
    return passed.select("doc_id", "score", F.lit(True).alias("passed")).unionByName(below.select("doc_id", "score", F.lit(False).alias("passed")))


@query(f"WITH {JUDGED} SELECT doc_id, score, contribution FROM judged WHERE score >= 0.45 ORDER BY list_position(['definition', 'condition', 'distinction', 'other'], contribution), score DESC, doc_id LIMIT 40")
def t7_order_limit(spark, sf_dir):
    return judge.select(_judged(spark, sf_dir), 0.45, "default", ["doc_id"], 40)[0]


@query(f"WITH {JUDGED} SELECT doc_id, score FROM judged WHERE score < 0.45 ORDER BY score DESC, doc_id LIMIT 25 OFFSET 25")
def t8_paging(spark, sf_dir):
    below = judge.select(_judged(spark, sf_dir), 0.45, "generic", ["doc_id"], 40)[1]
    return judge.page(below, ["doc_id"], 25).select("doc_id", "score")


@query(f"WITH {JUDGED} SELECT doc_id, score, 'other' AS contribution FROM judged ORDER BY score DESC, doc_id LIMIT 30")
def t9_unjudged(spark, sf_dir):
    c = _judged(spark, sf_dir).select("doc_id", F.lit(None).cast("double").alias("retrieval_score"), F.col("score").alias("lexical_score"))
    return judge.unjudged(c, ["doc_id"], 30).select("doc_id", "score", "contribution")


@query(f"WITH {JUDGED}, f AS (SELECT score, length(text) > 2000 AS skipped, doc_id IN (SELECT doc_id FROM labels) AS cached FROM judged JOIN documents USING (doc_id)) SELECT count(*)::BIGINT AS shortlisted, count(*) FILTER (skipped)::BIGINT AS skipped, count(*) FILTER (NOT skipped)::BIGINT AS checked, count(*) FILTER (NOT skipped AND cached)::BIGINT AS cached, count(*) FILTER (NOT skipped AND NOT cached)::BIGINT AS requested, count(*) FILTER (NOT skipped AND score >= 0.45)::BIGINT AS passed FROM f")
def a7_stats(spark, sf_dir):
    long = load(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 2000).alias("skipped"))
    known = load(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("cached", F.lit(True))
    rows = _judged(spark, sf_dir).join(long, "doc_id").join(known, "doc_id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    return judge.run_statistics(rows, 0.45)


@query("SELECT doc_id, greatest(quality * 0.5, toxic * 0.25, 0.125)::DOUBLE AS score, CASE WHEN quality = 1 THEN 'definition' ELSE 'other' END AS contribution FROM labels")
def p8_validate(spark, sf_dir):
    part = lambda c: F.struct(c.cast("double").alias("score"), F.lit(None).cast("string").alias("choice"))
    choice = F.struct(F.lit(None).cast("double").alias("score"), F.when(F.col("quality") == 1, "definition").otherwise("other").alias("choice"))
    answers = F.create_map(F.lit("definition"), part(F.col("quality") * 0.5), F.lit("condition"), part(F.col("toxic") * 0.25), F.lit("distinction"), part(F.lit(0.125)), F.lit("contribution"), choice)
    return judge.validated(load(spark, sf_dir, "labels").select("doc_id", answers.alias("answers")), "default").select("doc_id", "score", "contribution")


@query("SELECT user_id::VARCHAR AS hash, event_id, CASE WHEN event_id % 5 = 0 THEN 'nan' WHEN event_id % 7 = 0 THEN 'contribution' ELSE 'ok' END AS why, NOT (event_id % 5 = 0 OR event_id % 7 = 0) AS valid FROM events")
def p9_score_guard(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    score = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = e.select("event_id", F.col("user_id").cast("string").alias("hash"), score.alias("score"), F.when(F.col("event_id") % 7 == 0, "unknown").otherwise("other").alias("contribution"), F.create_map(F.lit("relevant"), F.lit(0.5)).alias("scores"))
    why = F.when(F.isnan("score"), "nan").when(F.col("contribution") == "unknown", "contribution").otherwise("ok")
    return rows.select("hash", "event_id", why.alias("why"), score_store.is_valid().alias("valid"))


@query("SELECT doc_id::VARCHAR AS id, quality * 0.5::DOUBLE AS score FROM labels")
def j5_split_answers(spark, sf_dir):
    """Answers of batches of ten, keyed ``id.name`` with a stray key each, back to their passages."""
    labels = load(spark, sf_dir, "labels").withColumn("id", F.col("doc_id").cast("string"))
    answer = F.struct((F.col("quality") * 0.5).cast("double").alias("score"), F.lit(None).cast("string").alias("choice"))
    batches = labels.groupBy(F.floor(F.col("doc_id") / 10)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("id", F.lit(".relevant")).alias("k"), answer.alias("v")))).alias("answers"))
    stray = F.create_map(F.concat(F.lit("relevant"), F.map_keys("answers")[0]), F.map_values("answers")[0])
    split = judge.split_answers(batches.select(F.map_concat("answers", stray).alias("answers")), labels.select("id"))
    return judge.validated(split, "generic").select("id", "score")


STRIPPED = r"regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)[ \t]+\^[A-Za-z0-9-]+[ \t]*$', '', 'g'), '(?m)^\^[A-Za-z0-9-]+[ \t]*$', '', 'g')"
INCLUSION = f"sha256(regexp_replace({STRIPPED}, '^{WS}+|{WS}+$', '', 'g'))"


@query(f"WITH d AS (SELECT doc_id, lang AS path, {INCLUSION} AS fingerprint FROM documents), c AS (SELECT path, fingerprint, count(*) AS n, min(doc_id) AS id FROM d GROUP BY ALL) SELECT doc_id, path, fingerprint, CASE WHEN n = 1 THEN id END AS id FROM d JOIN c USING (path, fingerprint) WHERE doc_id % 10 = 0")
def j6_inclusions(spark, sf_dir):
    """Every tenth document as an entry, against all."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("path"), T.inclusion_fingerprint("text").alias("fingerprint"))
    matched, missing = inclusions.match(docs.filter("doc_id % 10 = 0"), docs.withColumnRenamed("doc_id", "id"))
    return matched.select("doc_id", "path", "fingerprint", "id").unionByName(missing.withColumn("id", F.lit(None).cast("long")))


@query(f"""WITH {JUDGED}, sel AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS position FROM judged WHERE score >= 0.45 QUALIFY position <= 50),
m AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS nth FROM judged WHERE doc_id % 97 = 0)
SELECT doc_id AS id, coalesce(position, (SELECT max(position) FROM sel) + 1 + nth)::BIGINT AS position, coalesce(sel.score, judged.score) AS score, nth IS NOT NULL AS manual
FROM sel FULL JOIN m USING (doc_id) LEFT JOIN judged USING (doc_id)""")
def o2_manual_union(spark, sf_dir):
    judged = _judged(spark, sf_dir).select(F.col("doc_id").alias("id"), "score", "contribution", F.create_map(F.lit("relevant"), "score").alias("scores"))
    top = judged.filter("score >= 0.45").orderBy(F.desc("score"), "id").limit(50)
    selected = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))
    entries = judged.filter("id % 97 = 0").withColumn("nth", (F.row_number().over(Window.orderBy("id")) - 1).cast("long"))
    shown, _ = inclusions.apply(selected, judged.join(selected.select("id"), "id", "left_anti"), entries)
    return shown.select("id", "position", "score", "manual")


@query("WITH o AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0) SELECT id, CASE WHEN n.h IS NULL THEN 'removed' WHEN o.h IS NULL THEN 'added' ELSE 'changed' END AS change FROM o FULL JOIN n USING (id) WHERE o.h IS DISTINCT FROM n.h")
def j10_snapshot_diff(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"))
    new = docs.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return difference(old, new)


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def r2_debounce(spark, sf_dir):
    events = live.event_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))
    bursts = live.collect_table(live.debounced(events, "user_id", "ts", "6 hours"), "complete")
    return bursts.select("user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "n")


@query("WITH l AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id, value FROM l WHERE k = 1 AND event_id % 4 <> 0")
def r4_latest_version(spark, sf_dir):
    """A snapshot of users by their last event, those deleted by it left out, kept from a stream."""
    snapshot = live.LiveSnapshot(spark, "user_id", ["event_id"])
    op = F.when(F.col("event_id") % 4 == 0, "delete").otherwise("upsert").alias("op")
    snapshot.follow(live.event_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "value", op))
    return snapshot.rows()


def _two_scores(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).cast("double").alias("a"), (((F.col("n_chars") + F.col("doc_id") * 7) % 1000) / 1000.0).cast("double").alias("b"))


TWO = "p AS (SELECT doc_id, (n_chars % 1000)::DOUBLE / 1000 AS a, ((n_chars + doc_id * 7) % 1000)::DOUBLE / 1000 AS b FROM documents)"


@query(f"WITH {TWO}, r AS (SELECT row_number() OVER (ORDER BY a, doc_id)::DOUBLE AS x, row_number() OVER (ORDER BY b, doc_id)::DOUBLE AS y FROM p) SELECT round(1 - 6 * sum((x - y) * (x - y)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*)::DOUBLE - 1)), 9) AS rho FROM r")
def a11_spearman(spark, sf_dir):
    return evaluate.spearman(_two_scores(spark, sf_dir), "a", "b", "doc_id").select(F.round("rho", 9).alias("rho"))


@query(f"WITH {TWO}, k AS (SELECT count(*)::BIGINT AS kept FROM (SELECT doc_id FROM (SELECT doc_id FROM p ORDER BY a DESC, doc_id LIMIT 100) INTERSECT SELECT doc_id FROM (SELECT doc_id FROM p ORDER BY b DESC, doc_id LIMIT 100))) SELECT round(avg(abs(a - b)), 9) AS mean_drift, round(max(abs(a - b)), 9) AS max_drift, count(*) FILTER ((a >= 0.45) <> (b >= 0.45))::BIGINT AS crossed, any_value(kept) AS kept FROM p, k")
def a10_drift(spark, sf_dir):
    d = evaluate.drift(_two_scores(spark, sf_dir), "a", "b", "doc_id", 0.45, 100)
    return d.select(F.round("mean_drift", 9).alias("mean_drift"), F.round("max_drift", 9).alias("max_drift"), "crossed", "kept")


TITLE = r"trim(substr(trim(regexp_replace(regexp_replace(t, '[\x00-\x1f\\/:*?\"<>|#\[\]^]', ' ', 'g'), '" + WS + r"+', ' ', 'g')), 1, 100))"


@query(f"SELECT doc_id, CASE WHEN {TITLE} = '' THEN 'Query' ELSE {TITLE} END AS title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents)")
def f15_safe_title(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.safe_title(F.split("text", "\n")[0]).alias("title"))


LINKED = "'see [[' || source || '|an alias]] and ![[' || lang || '.md#^b1]] or [[x' || doc_id::VARCHAR || ']] ' || text"


@query(rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all({LINKED}, '!?\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1), lambda x: trim(x)), ';') AS targets FROM documents")
def f12_links(spark, sf_dir):
    text = F.concat(F.lit("see [["), "source", F.lit("|an alias]] and ![["), "lang", F.lit(".md#^b1]] or [[x"), F.col("doc_id").cast("string"), F.lit("]] "), "text")
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(T.links(text), ";").alias("targets"))


@query("WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, path FROM p WHERE NOT (path = 'blog.tionsh.example.com' OR starts_with(path, 'blog.tionsh.example.com/') OR path = 'tionble.example.org/en' OR starts_with(path, 'tionble.example.org/en/'))")
def s5_exclusion_filter(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return p.filter(~T.excluded("path", [" blog.tionsh.example.com/ ", "/tionble.example.org/en", "", " "]))


FENCED = "CASE doc_id % 4 WHEN 0 THEN text || chr(10) || '```pq' || chr(10) || 'x' WHEN 1 THEN '  ~~~~passage-question  ' || chr(10) || text WHEN 2 THEN '```python' || chr(10) || text ELSE '    ```pq' || chr(10) || text END"


@query(rf"SELECT doc_id, sha256(t) AS text_hash FROM (SELECT doc_id, {FENCED} AS t FROM documents) WHERE NOT regexp_matches(t, '(?m)^ {{0,3}}(?:`{{3,}}|~{{3,}})(?:passage-question|pq)[ \t\r]*$')")
def s7_fence_filter(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = F.when(k == 0, F.concat("text", F.lit("\n```pq\nx"))).when(k == 1, F.concat(F.lit("  ~~~~passage-question  \n"), "text")).when(k == 2, F.concat(F.lit("```python\n"), "text")).otherwise(F.concat(F.lit("    ```pq\n"), "text"))
    return searchable(load(spark, sf_dir, "documents").select("doc_id", t.alias("text"))).select("doc_id", F.sha2("text", 256).alias("text_hash"))


NATIONS = "WITH n AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""{NATIONS} SELECT r_name || '.md:3-3' AS id, 'paragraph' AS kind, 3 AS line_start, 'Nations of ' || r_name AS text, r_name AS headings, r_name || '.md:1' AS section_id FROM region
UNION ALL SELECT r_name || '.md:' || (4 + k) || '-' || (4 + k), 'list', (4 + k)::INTEGER, '- ' || n_name, r_name, r_name || '.md:1' FROM n""")
def p1_markdown_blocks(spark, sf_dir):
    """A note for each region: its name as the heading, a sentence, its nations as a list."""
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    notes = n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names")).select(
        F.concat("r_name", F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), "r_name", F.lit("\n\nNations of "), "r_name", F.lit("\n\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n")).alias("text"),
    )
    return parse_notes(notes).select("id", "kind", "line_start", "text", F.array_join("heading_path", " > ").alias("headings"), "section_id")


@query("SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE '[Headings: ' || role || ' > turn ' || turn::VARCHAR || ']' || chr(10) END || text AS shown FROM conversations")
def p2_model_text(spark, sf_dir):
    path = F.when(F.col("turn") == 0, F.array().cast("array<string>")).otherwise(F.array("role", F.concat(F.lit("turn "), F.col("turn").cast("string"))))
    c = load(spark, sf_dir, "conversations").withColumn("render_text", F.lit(None).cast("string")).withColumn("path", path)
    return c.select("conv_id", "turn", T.model_text("path").alias("shown"))


@query(f"SELECT doc_id, length(text)::BIGINT AS units, length(text) > {MAX_PASSAGE_CHARS} AS skipped FROM documents")
def p4_oversize(spark, sf_dir):
    keep, skip = judge.split_oversize(load(spark, sf_dir, "documents"), "text")
    rows = lambda df, s: df.select("doc_id", T.utf16_length("text").alias("units"), F.lit(s).alias("skipped"))
    return rows(keep, False).unionByName(rows(skip, True))


SPEC = QuerySpec("what is it", criteria=Criteria("generic", "look"))


@query("""SELECT doc_id, sha256('{"context":"","criteria":{"instructions":"look","mode":"generic"},"keyVersion":2,"namespace":"n:1","passage":' || to_json(text)::VARCHAR || ',"question":"what is it"}') AS hash FROM documents""")
def f7_score_hash(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", score_hash(SPEC, F.col("text"), "n:1").alias("hash"))


ASKED = "the and inea thanedble of"


def _passages(spark, sf_dir) -> DataFrame:
    """The lines as passages of one line each, all in one section."""
    rows = lines(spark, sf_dir).withColumns({"line_start": F.col("line"), "line_end": F.col("line"), "path": F.col("doc_id").cast("string")})
    return rows.withColumn("id", F.concat("path", F.lit(":"), "line")).withColumns({"render_text": F.lit(None).cast("string"), "heading_path": F.array().cast("array<string>"), "kind": F.lit("paragraph"), "parent_id": F.lit(None).cast("string"), "section_id": F.lit("")})


def _answer(spark, sf_dir, scorer=judge.overlap_scorer, limit=25, **fields):
    """One question with the offline scorer; texts of every third document's lines were scored before."""
    spec = QuerySpec(ASKED, criteria=Criteria("generic"), limit=limit, **fields)
    known = _passages(spark, sf_dir).filter("doc_id % 3 = 0").select(score_hash(spec, F.col("text"), "offline").alias("hash")).distinct()
    store = known.select("hash", F.lit(0.75).alias("score"), F.lit("other").alias("contribution"), F.create_map(F.lit("relevant"), F.lit(0.75)).alias("scores"), F.lit(0).cast("long").alias("accessed"))
    return answer(_passages(spark, sf_dir), indexed(spark, sf_dir), spec, scorer, store, candidates=60, clock=7)


RETRIEVED = rf"""WITH {LINES}, {sql_bm25('lines', 'doc_id, line', f"SELECT 0 AS qid, '{ASKED}' AS question")}, {COPIES.format(keys='doc_id, line')}, cand AS (SELECT doc_id, line, s, rank, (SELECT max(rank) FROM ranked) > 60 AS truncated FROM ranked WHERE rank <= 60)"""
ASKED_WORDS = "[" + ", ".join(f"'{w}'" for w in ASKED.split()) + "]"
SCORED = rf"""{RETRIEVED}, known AS (SELECT DISTINCT text FROM lines WHERE doc_id % 3 = 0),
sc AS (SELECT c.doc_id, c.line, l.text, l.text IN (SELECT text FROM known) AS cached, CASE WHEN l.text IN (SELECT text FROM known) THEN 0.75::DOUBLE ELSE round(len(list_intersect(list_distinct(regexp_split_to_array(lower(l.text), '\s+')), {ASKED_WORDS}))::DOUBLE / 5, 6) END AS score FROM cand c JOIN lines l USING (doc_id, line))"""


@query(rf"{SCORED}, p AS (SELECT doc_id::VARCHAR || ':' || line::VARCHAR AS id, score FROM sc WHERE score >= 0.45) SELECT id, score, (row_number() OVER (ORDER BY score DESC, id) - 1)::BIGINT AS position FROM p QUALIFY position < 25")
def e1_answer(spark, sf_dir):
    """Retrieval, cache, scorer, threshold, order and limit, composed."""
    return _answer(spark, sf_dir).shown.select("id", "score", "position")


@query(rf"{SCORED} SELECT count(*)::BIGINT AS retrieved, bool_or(truncated) AS truncated, count(*)::BIGINT AS shortlisted, 0::BIGINT AS overlap_removed, count(*)::BIGINT AS checked, count(*) FILTER (cached)::BIGINT AS cached, count(*) FILTER (NOT cached)::BIGINT AS requested, count(DISTINCT text)::BIGINT AS hashes, count(*) FILTER (score >= 0.45)::BIGINT AS passed FROM sc JOIN cand USING (doc_id, line)")
def e2_answer_statistics(spark, sf_dir):
    return _answer(spark, sf_dir).statistics.select("retrieved", "truncated", "shortlisted", "overlap_removed", "checked", "cached", "requested", "hashes", "passed")


@query(rf"{RETRIEVED}, p AS (SELECT doc_id::VARCHAR || ':' || line::VARCHAR AS id, s FROM cand) SELECT id, s AS score, (row_number() OVER (ORDER BY s DESC, id) - 1)::BIGINT AS position, (SELECT count(*) FROM cand)::BIGINT AS shortlisted, 0::BIGINT AS checked FROM p QUALIFY position < 8")
def e3_answer_unjudged(spark, sf_dir):
    """Without a scorer: retrieval order, as many as the question says, nothing checked."""
    found = _answer(spark, sf_dir, None, 8)
    shown = found.shown.select("id", F.round("score", 9).alias("score"), "position")
    return shown.crossJoin(found.statistics.select("shortlisted", "checked"))  # a row


@query(rf"""{SCORED}, p AS (SELECT doc_id, line, score, row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR || ':' || line::VARCHAR) - 1 AS position FROM sc WHERE score >= 0.45 QUALIFY position < 25),
n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k, text FROM lines),
w AS (SELECT p.doc_id, p.line, position, min(b.line) AS a, max(b.line) AS z, string_agg(b.text, chr(10) || chr(10) ORDER BY b.line) AS text FROM p JOIN n x ON x.doc_id = p.doc_id AND x.line = p.line JOIN n b ON b.doc_id = p.doc_id AND b.k BETWEEN x.k - 2 AND x.k + 2 GROUP BY p.doc_id, p.line, position)
SELECT doc_id::VARCHAR || ':' || line::VARCHAR AS id, position::BIGINT AS position, a::INTEGER AS line_start, z::INTEGER AS line_end, sha256(text) AS text_hash FROM w WHERE NOT EXISTS (SELECT 1 FROM w e WHERE e.doc_id = w.doc_id AND e.position < w.position AND e.a <= w.a AND e.z >= w.z)""")
def e4_answer_widened(spark, sf_dir):
    """Each shown passage with two neighbours on each side, without what an earlier one has."""
    shown = _answer(spark, sf_dir, adjacent=2).shown
    return shown.select("id", "position", "line_start", "line_end", F.sha2("text", 256).alias("text_hash"))


def counting_scorer(question: str, criteria: Criteria, context: str, texts: list[str]) -> judge.Reply:
    """The offline scorer; a character is a token."""
    return judge.Reply(judge.overlap_scorer(question, criteria, context, texts), len(question) + sum(map(len, texts)))


@query(rf"{SCORED}, once AS (SELECT DISTINCT text FROM sc WHERE NOT cached) SELECT (SELECT count(*) FROM lines)::BIGINT AS searchable, count(*)::BIGINT AS shortlisted, 0::BIGINT AS overlap_removed, 60::BIGINT AS window_limit, bool_or(truncated) AS truncated, count(*)::BIGINT AS checked, count(*) FILTER (cached)::BIGINT AS cached, (count(*) FILTER (NOT cached) - (SELECT count(*) FROM once))::BIGINT AS shared, (SELECT count(*) FROM once)::BIGINT AS requested, (SELECT ceil(count(*) / 10.0) FROM once)::BIGINT AS requests, (SELECT sum(length(text)) + ceil(count(*) / 10.0) * {len(ASKED)} FROM once)::BIGINT AS input_tokens, true AS took_time, 0::BIGINT AS retries, 0::BIGINT AS skipped, count(*) FILTER (score >= 0.45)::BIGINT AS passed, 0::BIGINT AS context_chars, 0.45::DOUBLE AS threshold FROM sc JOIN cand USING (doc_id, line)")
def a7_run(spark, sf_dir):
    """All that a run tells of itself; what several passages share was requested once."""
    s = _answer(spark, sf_dir, counting_scorer).statistics
    names = ("searchable", "shortlisted", "overlap_removed", "window_limit", "truncated", "checked", "cached", "shared", "requests", "input_tokens", "retries", "skipped", "passed", "context_chars", "threshold")
    return s.select(*names, (F.col("requested") - F.col("shared")).alias("requested"), (F.col("request_ms") > 0).alias("took_time"))


@query(rf"""{SCORED}, p AS (SELECT doc_id::VARCHAR || ':' || line::VARCHAR AS id, doc_id, line, text, score FROM sc WHERE score >= 0.45), f AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::BIGINT AS k FROM p QUALIFY k <= 25)
SELECT 'passage' AS part, k - 1 AS nth, sha256(k::VARCHAR || '. ' || doc_id::VARCHAR || ':' || line::VARCHAR || '-' || line::VARCHAR || ' · ' || printf('%.3f', score) || chr(10) || '    ' || text) AS line_hash FROM f
UNION ALL SELECT 'statistics', 0, sha256(count(*)::VARCHAR || ' passages of ' || (SELECT count(*) FROM lines)::VARCHAR || ' after 0 overlaps' || CASE WHEN bool_or(truncated) THEN ' at the limit of 60, there were more' ELSE '' END) FROM cand""")
def k9_report(spark, sf_dir):
    """The lines of a run's report: what was found, and each passage that is shown."""
    found = _answer(spark, sf_dir)
    shown = report.passage_lines(found.shown).select(F.lit("passage").alias("part"), F.col("position").alias("nth"), F.sha2("line", 256).alias("line_hash"))
    told = report.statistics_lines(found.statistics).filter("nth = 0").select(F.lit("statistics").alias("part"), F.col("nth").cast("long").alias("nth"), F.sha2("line", 256).alias("line_hash"))
    return shown.unionByName(told)


@query(rf"""{SCORED}, p AS (SELECT doc_id::VARCHAR || ':' || line::VARCHAR AS id, score FROM sc) SELECT 'candidate' AS kind, rank AS nth, doc_id::VARCHAR || ':' || line::VARCHAR AS id, NULL::DOUBLE AS score FROM cand
UNION ALL SELECT 'shown', (row_number() OVER (ORDER BY score DESC, id) - 1)::BIGINT AS k, id, score FROM p WHERE score >= 0.45 QUALIFY k < 25
UNION ALL SELECT 'below', cand.rank, p.id, score FROM p JOIN cand ON p.id = cand.doc_id::VARCHAR || ':' || cand.line::VARCHAR WHERE score < 0.45""")
def k8_capture(spark, sf_dir):
    """All that a run looked at, read back from its JSON records."""
    records = report.capture(_answer(spark, sf_dir), QuerySpec(ASKED, criteria=Criteria("generic")))
    return records.filter("kind IN ('candidate', 'shown', 'below')").select("kind", "nth", F.get_json_object("record", "$.id").alias("id"), F.get_json_object("record", "$.score").cast("double").alias("score"))


@query(rf"{SCORED} SELECT doc_id::VARCHAR || ':' || line::VARCHAR AS id, score FROM sc WHERE score < 0.45")
def u1_judged_below(spark, sf_dir):
    """What was judged and didn't pass."""
    return _answer(spark, sf_dir).below.select("id", "score")


@query(rf"{SCORED} SELECT score, count(DISTINCT text)::BIGINT AS n FROM sc WHERE NOT cached GROUP BY score")
def u5_store_after_a_run(spark, sf_dir):
    """Equal texts are asked once; the store has what was asked and counts it as used now."""
    spec = QuerySpec(ASKED, criteria=Criteria("generic"))
    known = _passages(spark, sf_dir).filter("doc_id % 3 = 0").select(score_hash(spec, F.col("text"), "offline").alias("hash")).distinct()
    return _answer(spark, sf_dir).store.filter("accessed = 7").join(known, "hash", "left_anti").groupBy("score").agg(F.count("*").alias("n"))


@query(rf"{RETRIEVED} SELECT doc_id, line, s AS lexical_score, rank, truncated FROM cand")
def t6_keyword_only(spark, sf_dir):
    """No vectors: keyword ranks alone, as wide as asked, and whether there was more."""
    return retrieve(indexed(spark, sf_dir), one_question(spark, ASKED), 60, digits=9).select("doc_id", "line", "lexical_score", "rank", "truncated")


@query(FUSED.replace("rank <= 200", "rank <= 204").replace("sr <= 200", "sr <= 204").replace("SELECT id, s AS retrieval_score, is_copy, row_number()", "SELECT id, s AS retrieval_score, (SELECT count(*) FROM h) > 51 AS truncated, row_number()"))
def t5_truncated(spark, sf_dir):
    """Both lists as wide as the pool (4 x 51), fused, cut at 51, and whether there was more."""
    v, q = _vectors(spark, sf_dir)
    found = retrieve(indexed(spark, sf_dir, "documents"), one_question(spark, "than thre conflict ation"), 51, v, q.filter("qid = 0"), digits=9)
    return found.select("id", "retrieval_score", "rank", "truncated")


@query(f"""WITH {JUDGED}, sel AS (SELECT doc_id FROM judged WHERE score >= 0.45 ORDER BY score DESC, doc_id LIMIT 50) SELECT doc_id AS id, score FROM judged WHERE doc_id NOT IN (SELECT doc_id FROM sel) AND doc_id % 97 <> 0""")
def o6_below_without_included(spark, sf_dir):
    """What isn't shown, without what a reader included."""
    judged = _judged(spark, sf_dir).select(F.col("doc_id").alias("id"), "score", "contribution", F.create_map(F.lit("relevant"), "score").alias("scores"))
    top = judged.filter("score >= 0.45").orderBy(F.desc("score"), "id").limit(50)
    selected = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))
    entries = judged.filter("id % 97 = 0").withColumn("nth", F.col("id"))
    return inclusions.apply(selected, judged.join(selected.select("id"), "id", "left_anti"), entries)[1].select("id", "score")


@query("SELECT DISTINCT sha256(text || '!') AS hash, 0.5::DOUBLE * max(quality) OVER (PARTITION BY text) AS score FROM documents JOIN labels USING (doc_id)")
def j4_promote(spark, sf_dir):
    """Scores under an older key of a text become rows under its new key."""
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    store = docs.groupBy(F.sha2("text", 256).alias("hash")).agg((F.max("quality") * 0.5).cast("double").alias("score")).select("hash", "score", F.lit("other").alias("contribution"), F.create_map(F.lit("relevant"), "score").alias("scores"), F.lit(0).cast("long").alias("accessed"))
    missing = docs.select(F.sha2(F.concat("text", F.lit("!")), 256).alias("hash"), F.sha2("text", 256).alias("old_hash")).distinct()
    return score_store.promote(missing, store).select("hash", "score")


@query("SELECT sha256(doc_id::VARCHAR) AS hash, CASE WHEN doc_id % 5 = 0 THEN 0.125 ELSE quality * 0.5 END::DOUBLE AS score FROM labels WHERE doc_id % 5 = 0 OR doc_id % 7 <> 0")
def s11_import_records(spark, sf_dir):
    """Old records, one JSON text each, some of another version; those that the store has stay as they are."""
    labels = load(spark, sf_dir, "labels").withColumn("hash", F.sha2(F.col("doc_id").cast("string"), 256))
    store = labels.filter("doc_id % 5 = 0").select("hash", F.lit(0.125).alias("score"), F.lit("other").alias("contribution"), F.create_map(F.lit("relevant"), F.lit(0.125)).alias("scores"), F.lit(1).cast("long").alias("accessed"))
    score = (F.col("quality") * 0.5).cast("double")
    value = F.struct(score.alias("score"), F.lit("other").alias("contribution"), F.create_map(F.lit("relevant"), score).alias("scores"))
    record = F.struct(F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).alias("version"), F.array(F.struct("hash", value.alias("value"))).alias("entries"))
    return score_store.import_records(labels.select(F.to_json(record).alias("value")), store).select("hash", "score")


@query(rf"SELECT doc_id, sha256(regexp_replace({FENCED}, '(?m)^( {{0,3}}(?:`{{3,}}|~{{3,}}))(?:passage-question|pq)([ \t\r]*)$', '\1text\2', 'g')) AS text_hash FROM documents")
def p11_inert_fences(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = F.when(k == 0, F.concat("text", F.lit("\n```pq\nx"))).when(k == 1, F.concat(F.lit("  ~~~~passage-question  \n"), "text")).when(k == 2, F.concat(F.lit("```python\n"), "text")).otherwise(F.concat(F.lit("    ```pq\n"), "text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(T.inert_fences(t), 256).alias("text_hash"))


@query("""WITH t AS (SELECT conv_id, role, 'Said ' || replace(text, chr(10), ' ') || '.' AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations)
SELECT 'conv' || conv_id::VARCHAR || '.md:' || (5 + 4 * k) || '-' || (5 + 4 * k) AS id, 'paragraph' AS kind, (5 + 4 * k)::INTEGER AS line_start, sha256(said) AS text_hash, 'Conv ' || conv_id::VARCHAR || ' > ' || role || ' ' || k AS headings, 'conv' || conv_id::VARCHAR || '.md:' || (3 + 4 * k) AS section_id FROM t""")
def p1_conversation_blocks(spark, sf_dir):
    """A note for each conversation: its number as the title, a section with a paragraph for each turn."""
    c = load(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    part = lambda x, k: F.concat(F.lit("## "), x["role"], F.lit(" "), k.cast("string"), F.lit("\n\nSaid "), F.replace(x["text"], F.lit("\n"), F.lit(" ")), F.lit(".\n\n"))
    notes = c.groupBy("conv_id").agg(turns.alias("turns")).select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# Conv "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("turns", part), "")).alias("text"),
    )
    return parse_notes(notes).select("id", "kind", "line_start", F.sha2("text", 256).alias("text_hash"), F.array_join("heading_path", " > ").alias("headings"), "section_id")
