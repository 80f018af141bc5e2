"""Registered queries over notes that are made from conversations, and over changes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators import context, ranking, saving, widening
from passagework.operators.markdown import outline_notes, parse_notes
from passagework.operators.partial import PartialSelection
from passagework.operators.segments import SegmentedIndex
from passagework.operators.vector_store import VectorStore
from passagework.plans.queries import JUDGED, MANY, QUESTIONS, _judged, load, one_question, query, sql_bm25, sql_tokens
from passagework.sources.notes import NoteFolder, remove_notes, write_notes
from passagework.storage import fresh_path, written
from passagework.streaming.live import LiveSnapshot
from passagework.streaming.standing import StandingQuestions

DEPTHS = (0, 1, 1, 2, 0, 1, 2)


def list_notes(spark, sf_dir) -> DataFrame:
    """A note for each conversation: a paragraph, its turns as a nested list, a paragraph,
    and another under a heading of its own."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    depth = F.array(*map(F.lit, DEPTHS))
    item = lambda x, k: F.concat(F.repeat(F.lit("  "), F.get(depth, k % len(DEPTHS))), F.lit("- "), x["role"], F.lit(" said "), F.replace(x["text"], F.lit("\n"), F.lit(" ")))
    name = F.col("conv_id").cast("string")
    text = F.concat(F.lit("# Conv "), name, F.lit("\n\nIntro of "), name, F.lit(".\n\n"), F.array_join(F.transform("turns", item), "\n"), F.lit("\n\nEnd of "), name, F.lit(".\n\n## More\n\nLast of "), name, F.lit(".\n"))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(F.concat(F.lit("lists"), name, F.lit(".md")).alias("path"), text.alias("text"))


#: The same passages by rules of their own: parents, ends and outermost items from depths.
LISTS = f"""it AS (SELECT conv_id, 'lists' || conv_id::VARCHAR || '.md' AS path, k, 5 + k AS line, {list(DEPTHS)}[k % {len(DEPTHS)} + 1] AS depth, repeat('  ', {list(DEPTHS)}[k % {len(DEPTHS)} + 1]) || '- ' || role || ' said ' || replace(text, chr(10), ' ') AS own, count(*) OVER (PARTITION BY conv_id) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations)),
ends AS (SELECT a.*, coalesce((SELECT min(b.k) FROM it b WHERE b.conv_id = a.conv_id AND b.k > a.k AND b.depth <= a.depth), n) - 1 AS last, (SELECT max(b.k) FROM it b WHERE b.conv_id = a.conv_id AND b.k < a.k AND b.depth < a.depth) AS up FROM it a),
items AS (SELECT *, path || ':' || line || '-' || (5 + last) AS id, (SELECT string_agg(b.own, chr(10) ORDER BY b.k) FROM it b WHERE b.conv_id = ends.conv_id AND b.k BETWEEN ends.k AND ends.last) AS text FROM ends),
tops AS (WITH RECURSIVE t AS (SELECT conv_id, k AS of, k, up, 0 AS hops, '' AS above FROM ends UNION ALL SELECT t.conv_id, t.of, e.k, e.up, hops + 1, e.own || chr(10) || above FROM t JOIN ends e ON e.conv_id = t.conv_id AND e.k = t.up) SELECT * FROM t WHERE up IS NULL),
paras AS (SELECT path, path || ':3-3' AS id, 3 AS a, 'Intro of ' || conv_id::VARCHAR || '.' AS text, path || ':1' AS section, conv_id FROM it WHERE k = 0
    UNION ALL SELECT path, path || ':' || (6 + n) || '-' || (6 + n), 6 + n, 'End of ' || conv_id::VARCHAR || '.', path || ':1', conv_id FROM it WHERE k = 0
    UNION ALL SELECT path, path || ':' || (10 + n) || '-' || (10 + n), 10 + n, 'Last of ' || conv_id::VARCHAR || '.', path || ':' || (8 + n), conv_id FROM it WHERE k = 0)"""


@query(f"""WITH {LISTS} SELECT i.id, 'list' AS kind, i.line::INTEGER AS line_start, (5 + i.last)::INTEGER AS line_end, p.id AS parent_id, sha256(i.text) AS text_hash, sha256(above || i.text) AS shown_hash
FROM (SELECT items.*, above FROM items JOIN tops ON tops.conv_id = items.conv_id AND tops.of = items.k) i LEFT JOIN items p ON p.conv_id = i.conv_id AND p.k = i.up
UNION ALL SELECT id, 'paragraph', a::INTEGER, a::INTEGER, NULL, sha256(text), sha256(text) FROM paras""")
def p1_nested(spark, sf_dir):
    """Passages of nested lists: an item's text has all below it, its display all above it, too."""
    p = parse_notes(list_notes(spark, sf_dir))
    return p.select("id", "kind", "line_start", "line_end", "parent_id", F.sha2("text", 256).alias("text_hash"), F.sha2(F.coalesce("render_text", "text"), 256).alias("shown_hash"))


@query(f"""WITH {LISTS} SELECT i.id, t.id AS outer_id, hops::BIGINT AS depth FROM items i JOIN tops ON tops.conv_id = i.conv_id AND tops.of = i.k JOIN items t ON t.conv_id = tops.conv_id AND t.k = tops.k
UNION ALL SELECT id, id, 0 FROM paras""")
def j8_outer_unit(spark, sf_dir):
    return widening.outermost(outline_notes(list_notes(spark, sf_dir)))


@query(f"""WITH {LISTS}, sib AS (SELECT items.*, above, row_number() OVER (PARTITION BY items.conv_id, items.up ORDER BY line) AS nth FROM items JOIN tops ON tops.conv_id = items.conv_id AND tops.of = items.k),
near AS (SELECT a.id, a.path, b.line AS s, 5 + b.last AS e, b.text, row_number() OVER (PARTITION BY a.id ORDER BY b.line) = 1 AS first, b.above FROM sib a JOIN sib b ON a.conv_id = b.conv_id AND a.up IS NOT DISTINCT FROM b.up AND b.nth BETWEEN a.nth - 2 AND a.nth + 2),
units AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY s) AS nth FROM (SELECT id, path, a AS s, a AS e, text, section, true AS target FROM paras UNION ALL SELECT id, path, line, 5 + last, text, path || ':1', false FROM items WHERE up IS NULL)),
all_of AS (SELECT id, path, s, e, CASE WHEN first THEN above || text ELSE text END AS text FROM near UNION ALL SELECT a.id, a.path, b.s, b.e, b.text FROM units a JOIN units b ON a.section = b.section AND b.nth BETWEEN a.nth - 2 AND a.nth + 2 WHERE a.target)
SELECT id, path, min(s)::INTEGER AS line_start, max(e)::INTEGER AS line_end, sha256(string_agg(text, chr(10) || chr(10) ORDER BY s)) AS text_hash FROM all_of GROUP BY id, path""")
def j7_expand(spark, sf_dir):
    """Every passage, widened by two neighbours on each side; texts are cut for what is shown."""
    notes = list_notes(spark, sf_dir)
    outline = outline_notes(notes)
    wide = widening.expand(outline, outline, 2, notes)
    return wide.select("id", "path", "line_start", "line_end", F.sha2("text", 256).alias("text_hash"))


LINKS = ("lists{c}#More", "#Conv {c}", "lists{c}.md", "lists{c}#Gone", "nowhere{c}")


@query(f"""WITH {LISTS}, whole AS (SELECT conv_id, path, any_value(n) AS n, '# Conv ' || conv_id::VARCHAR || chr(10) || chr(10) || 'Intro of ' || conv_id::VARCHAR || '.' || chr(10) || chr(10) || string_agg(own, chr(10) ORDER BY k) || chr(10) || chr(10) || 'End of ' || conv_id::VARCHAR || '.' || chr(10) || chr(10) || '## More' || chr(10) || chr(10) || 'Last of ' || conv_id::VARCHAR || '.' || chr(10) AS text FROM it GROUP BY conv_id, path)
SELECT path AS source, nth::INTEGER AS nth, replace({list(LINKS)}[nth + 1], '{{c}}', conv_id::VARCHAR) AS link, CASE nth WHEN 0 THEN 8 + n WHEN 1 THEN 1 WHEN 2 THEN 1 END::INTEGER AS line_start, CASE WHEN nth < 3 THEN 11 + n END::INTEGER AS line_end,
CASE nth WHEN 0 THEN sha256('## More' || chr(10) || chr(10) || 'Last of ' || conv_id::VARCHAR || '.' || chr(10)) WHEN 1 THEN sha256(text) WHEN 2 THEN sha256(text) END AS text_hash, ['ok', 'ok', 'ok', 'no such section or block', 'no such note'][nth + 1] AS status FROM whole, range(5) r(nth)""")
def s8_context(spark, sf_dir):
    """What five links of every note name: sections, a note, one that is stale and one that leads nowhere."""
    notes = list_notes(spark, sf_dir)
    asked = F.array(*(F.lit(x) for x in LINKS))
    links = notes.select(F.col("path").alias("source"), F.posexplode(asked).alias("nth", "link"))
    links = links.withColumn("link", F.replace("link", F.lit("{c}"), F.regexp_extract("source", r"^lists(-?\d+)\.md$", 1)))
    return context.read(links, notes).select("source", "nth", "link", "line_start", "line_end", F.sha2("text", 256).alias("text_hash"), "status")


def _apart(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Notes, and those passages of theirs that are in no other: paragraphs and outermost items."""
    notes = written(list_notes(spark, sf_dir), "notes")
    return notes, parse_notes(notes).filter("parent_id IS NULL")


MADE = "'pw-' || substr(sha256('0' || chr(10) || path || chr(10) || a::VARCHAR || chr(10) || text), 1, 16)"
CHOSEN = f"{LISTS}, chosen AS (SELECT id, path, conv_id, a, a AS z, text, a AS spot FROM paras UNION ALL SELECT id, path, conv_id, line, 5 + last, text, line FROM items WHERE up IS NULL), named AS (SELECT *, {MADE} AS block_id FROM chosen)"
NEW_LINES = "lines_of AS (SELECT conv_id, path, 5 + k AS line, own AS l FROM it UNION ALL SELECT conv_id, path, a, text FROM paras UNION ALL SELECT conv_id, path, unnest([1, 2, 4, 5 + n, 7 + n, 8 + n, 9 + n, 11 + n]), unnest(['# Conv ' || conv_id::VARCHAR, '', '', '', '', '## More', '', '']) FROM it WHERE k = 0)"


@query(f"WITH {CHOSEN}, {NEW_LINES}, whole AS (SELECT l.path, sha256(string_agg(l || coalesce(' ^' || block_id, ''), chr(10) ORDER BY line)) AS after_hash FROM lines_of l LEFT JOIN named ON named.path = l.path AND spot = line GROUP BY l.path) SELECT id, path, block_id, spot::INTEGER AS line, 'append' AS op, 'ok' AS status, after_hash FROM named JOIN whole USING (path)")
def k2_block_ids(spark, sf_dir):
    """The plan of ids for all passages that stand apart, and what its notes become."""
    notes, chosen = _apart(spark, sf_dir)
    plan = saving.plan_block_ids(chosen, notes)
    after = saving.edited(notes, plan).select("path", F.sha2("after", 256).alias("after_hash"))
    return plan.join(after, "path").select("id", "path", "block_id", "line", "op", "status", "after_hash")


@query(f"WITH {CHOSEN} SELECT 'saved of ' || path AS source, (row_number() OVER (PARTITION BY path ORDER BY id) - 1)::INTEGER AS nth, id, a::INTEGER AS line_start, z::INTEGER AS line_end, 'ok' AS status FROM named UNION ALL SELECT 'saved of ' || path, count(*)::INTEGER, NULL, NULL, NULL, 'no such section or block' FROM named GROUP BY path")
def j11_saved_embeds(spark, sf_dir):
    """Saved notes with an embed for each planned id, and a stale one, joined to the passages of the edited notes."""
    notes, chosen = _apart(spark, sf_dir)
    plan = written(saving.plan_block_ids(chosen, notes), "plan")
    after = written(saving.edited(notes, plan).select("path", F.col("after").alias("text")), "after")
    saved = plan.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "block_id"))).alias("rows"))
    text = F.concat(F.array_join(F.transform("rows", lambda x: F.concat(F.lit("![["), F.col("path"), F.lit("#^"), x["block_id"], F.lit("]]"))), "\n\n"), F.lit("\n\n![["), F.col("path"), F.lit("#^gone]]\n"))
    saved = saved.withColumn("text", text).select(F.concat(F.lit("saved of "), "path").alias("path"), "text")
    joined = saving.saved_embeds(saved, after, outline_notes(after))
    return joined.select("source", "nth", "id", "line_start", "line_end", "status")


EDITED = "than thre conflict ation peace"
#: Three versions of the documents: a part, edits with deletes and additions, more edits.
FINAL = """final AS (SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'than ' || text WHEN doc_id % 33 = 0 THEN text WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN text || ' erhe than peace' WHEN doc_id % 5 <> 0 OR doc_id % 2 = 0 THEN text END AS text FROM documents) WHERE text IS NOT NULL)"""


def versions(spark, sf_dir) -> list[DataFrame]:
    """Batches of (id, version, op, text) that end in ``FINAL``."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    i = F.col("id")
    first = d.filter(i % 5 != 0).withColumn("op", F.lit("upsert"))
    edited = F.when(i % 7 == 0, F.concat("text", F.lit(" erhe than peace"))).otherwise(F.col("text"))
    second = d.filter((i % 7 == 0) | (i % 11 == 0) | (i % 10 == 0)).select("id", edited.alias("text"), F.when(i % 11 == 0, "delete").otherwise("upsert").alias("op"))
    third = d.filter((i % 13 == 0) | (i % 33 == 0)).select("id", F.when(i % 13 == 0, F.concat(F.lit("than "), "text")).otherwise(F.col("text")).alias("text"), F.lit("upsert").alias("op"))
    return [df.withColumn("version", F.lit(k)).select("id", "version", "op", "text") for k, df in enumerate((first, second, third))]


@query(f"WITH {FINAL}, {sql_bm25('final', 'doc_id', f'SELECT 0 AS qid, {chr(39)}{EDITED}{chr(39)} AS question')} SELECT doc_id AS id, s AS lexical_score FROM scored")
def r8_index_after_edits(spark, sf_dir):
    """Scores after three batches of edits, from segments and tombstones."""
    index = SegmentedIndex(spark, fresh_path(spark, "segments"), ["id"], ["version"])
    for batch in versions(spark, sf_dir):
        index.apply(batch)
    return index.index().bm25(ranking.question_terms(one_question(spark, EDITED))).select("id", F.round("lexical_score", 9).alias("lexical_score"))


def follow_versions(spark, sf_dir, follow: Callable[[DataFrame], None]) -> None:
    """Hand ``follow`` the versions as a stream, a batch each, in as many files as Spark makes
    of a version: the stream has no more than one new version whenever it is followed."""
    path = fresh_path(spark, "versions")
    for batch in versions(spark, sf_dir):
        batch.write.mode("append").parquet(path)
        follow(spark.readStream.schema(batch.schema).parquet(path))


#: Statistics of the first version, scores of the last.
STANDING = sql_bm25("final", "doc_id", MANY).replace(
    "st AS (SELECT count(*)::DOUBLE AS n, greatest(1.0::DOUBLE, coalesce(sum(len(words)), 0)::DOUBLE / greatest(1, count(*))) AS avg_len FROM tok)",
    "tok0 AS (SELECT {w} AS words FROM documents WHERE doc_id % 5 <> 0), st AS (SELECT count(*)::DOUBLE AS n, greatest(1.0::DOUBLE, coalesce(sum(len(words)), 0)::DOUBLE / greatest(1, count(*))) AS avg_len FROM tok0), df0 AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS term FROM tok0) GROUP BY term)",
).replace("df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term)", "df AS (SELECT term, coalesce(any_value(df0.df), 0)::DOUBLE AS df FROM terms LEFT JOIN df0 USING (term) GROUP BY term)")


@query(f"WITH {FINAL}, {STANDING.replace('{w}', sql_tokens('text'))} SELECT qid::BIGINT AS qid, doc_id AS id, s AS lexical_score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id)::BIGINT AS rank FROM scored QUALIFY rank <= 10")
def r5_standing_questions(spark, sf_dir):
    """The first ten documents of twenty questions, kept over a stream of three versions."""
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid long, question string")
    standing = StandingQuestions(spark, fresh_path(spark, "standing"), asked, 10, ["id"], ["version"])
    follow_versions(spark, sf_dir, standing.follow)
    return standing.results().select("qid", "id", F.round("lexical_score", 9).alias("lexical_score"), "rank")


WIDTH = 4


def word_lengths(text: str) -> list[int]:
    return [2 + len(w) % 61 for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def made_weights() -> np.ndarray:
    """Rows by a rule, so that SQL has them, too."""
    i, j = np.mgrid[0:63, 0:WIDTH]
    return ((i * 31 + j * 17) % 101 - 50) / 100.0


MEANS = ", ".join(f"avg(((id * 31 + {17 * j}) % 101 - 50) / 100.0::DOUBLE) AS m{j}" for j in range(WIDTH))
LENGTH = "sqrt(" + " + ".join(f"m{j} * m{j}" for j in range(WIDTH)) + ")"


@query(rf"""WITH {FINAL}, sent AS (SELECT text FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT CASE WHEN doc_id % 7 = 0 THEN text || ' erhe than peace' ELSE text END FROM documents WHERE doc_id % 11 <> 0 AND (doc_id % 7 = 0 OR doc_id % 10 = 0) UNION ALL SELECT CASE WHEN doc_id % 13 = 0 THEN 'than ' || text ELSE text END FROM documents WHERE doc_id % 13 = 0 OR doc_id % 33 = 0),
w AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[^ 	-
]+'), lambda x: 2 + len(x) % 61)) AS id FROM final), m AS (SELECT doc_id, {MEANS} FROM w GROUP BY doc_id)
SELECT f.doc_id AS id, {", ".join(f"round(coalesce(CASE WHEN {LENGTH} > 0 THEN m{j} / {LENGTH} ELSE m{j} END, 0), 9) AS v{j}" for j in range(WIDTH))}, (SELECT count(DISTINCT text) FROM sent)::BIGINT AS encoded FROM final f LEFT JOIN m ON m.doc_id = f.doc_id""")
def r7_delta_vectors(spark, sf_dir):
    """Vectors after three versions, and how many texts were encoded for them: each once."""
    store = VectorStore(spark, fresh_path(spark, "vectors"), "id", ["version"], word_lengths, made_weights())
    follow_versions(spark, sf_dir, store.follow)
    encoded = sum(store.encoded(k) for k in range(3))
    return store.rows().select("id", *(F.round(F.get("vector", F.lit(j)) + 0.0, 9).alias(f"v{j}") for j in range(WIDTH)), F.lit(encoded).cast("long").alias("encoded"))


#: Notes are dealt out to folders, so that tasks can list them.
FOLDERS = 256


@query("SELECT CASE WHEN doc_id % 101 = 0 THEN 'r' ELSE 'n' END || doc_id::VARCHAR || '.md' AS path, sha256(replace(CASE WHEN doc_id % 7 = 0 THEN 'edited ' || text ELSE text END, chr(13), '') || chr(10)) AS text_hash, CASE WHEN doc_id % 101 = 0 OR doc_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS version FROM documents WHERE doc_id % 97 <> 0 OR doc_id % 101 = 0")
def s1_note_changes(spark, sf_dir):
    """Documents as notes in a folder: some edited, some renamed, some gone before a second look."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    root, i = fresh_path(spark, "notes"), F.col("doc_id")
    tasks = 4 * spark.sparkContext.defaultParallelism  # a note costs a file whatever its size, so notes are dealt by number
    at = lambda letter: F.concat(F.pmod(i, F.lit(FOLDERS)), F.lit(f"/{letter}"), i, F.lit(".md")).alias("path")
    text = F.concat(F.when(i % 7 == 0, "edited ").otherwise(""), "text")
    put = lambda rows, letter, text: write_notes(rows.select(at(letter), F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).alias("text")).repartition(tasks, "path"), root)
    put(docs, "n", F.col("text"))
    folder = NoteFolder(spark, root, fresh_path(spark, "note-state"), name=lambda below: F.substring_index(below, "/", -1))
    live = LiveSnapshot(spark, "path", ["version"])
    folder.poll(live.merge)
    put(docs.filter(i % 7 == 0), "n", text)
    put(docs.filter(i % 101 == 0), "r", text)
    remove_notes(docs.filter((i % 97 == 0) | (i % 101 == 0)).select(at("n")).repartition(tasks, "path"), root)
    folder.poll(live.merge)
    return live.rows().select("path", F.sha2("text", 256).alias("text_hash"), "version")


ORDERED = "list_position(['definition', 'condition', 'distinction', 'other'], contribution), score DESC, doc_id"


@query(f"WITH {JUDGED}, upto AS (SELECT judged.*, b, sum(1) OVER (PARTITION BY b) AS seen, count(*) FILTER (score >= 0.45) OVER (PARTITION BY b) AS good FROM judged, range(4) r(b) WHERE doc_id % 4 <= b) SELECT b::BIGINT AS batch, doc_id, (row_number() OVER (PARTITION BY b ORDER BY {ORDERED}) - 1)::BIGINT AS position, seen::BIGINT AS judged, good::BIGINT AS passed FROM upto WHERE score >= 0.45 QUALIFY position < 20")
def r6_partial_results(spark, sf_dir):
    """What is first after each of four batches of scores, of all that were there by then."""
    judged, states = _judged(spark, sf_dir), []
    told = lambda rows, seen, good: states.append(written(rows.select(F.lit(len(states)).cast("long").alias("batch"), "doc_id", "position", F.lit(seen).alias("judged"), F.lit(good).alias("passed")), "state"))
    selection = PartialSelection(spark, fresh_path(spark, "partial"), ["doc_id"], 0.45, "default", 20, told)
    for k in range(4):
        selection.merge(judged.filter(F.col("doc_id") % 4 == k), k)
    return reduce(DataFrame.unionByName, states)
