"""Registered queries over the driver's tables: name -> Spark plan, and the same question in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, dates, embed, text
from ..functions.vectors import normalised
from ..functions.text import overlap, r6
from ..operators import classify, collection, context, derived, entities as naming, fulltext, graph, halls, haystack, incremental, ingest, inverted, kg, lexical, locales, memories, metrics, near_dup, registry, search, summary, transcript, zettel
from ..session import shared_folder
from ..sources import chats, projects, records, rooms
from .tables import D, K, Q, V, drawers, entities, fulltext_index, lexical_index, questions, read, triples, vector_lists, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LATER: dict[str, Callable[[], str]] = {}


def query(sql: str | Callable[[], str] | None = None):
    """Registers a query with its oracle; one whose text needs names from further down is made when all are known."""

    def put(f):
        QUERIES[f.__name__] = f
        if callable(sql):
            LATER[f.__name__] = sql
        elif sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _before(i: str, x: str, texts: list[str]) -> str:
    q = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"CASE {i} % {len(texts)} " + " ".join(f"WHEN {k} THEN {q(t)}" for k, t in enumerate(texts)) + f" END || {x}"


def _put_before(i, x, texts: list[str]):
    return F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.col(i) % len(texts) + 1).cast("int")), F.col(x))


SIX = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
WORDS = ["thereonti", "with", "ertion", "that"]
QUESTION = ["thnt", "with", "die", "elle", "ertion"]

# --- collections and filters -----------------------------------------------------------------------------------------


@query(f"WITH {D} SELECT id, wing, room, occurred_at FROM d WHERE wing = 'en' ORDER BY id LIMIT 50 OFFSET 20")
def scan_get_paginated(s, d):
    return collection.get(drawers(s, d), where={"wing": "en"}, limit=50, offset=20).select("id", "wing", "room", "occurred_at")


@query(f"WITH {D} SELECT id, wing, room, document FROM d WHERE id IN (1, 5, 9, 77, 123456789)")
def scan_get_by_ids(s, d):
    return collection.get(drawers(s, d), ids=[1, 5, 9, 77, 123456789]).select("id", "wing", "room", "document")


@query("SELECT count(*) AS n FROM documents")
def count_collection(s, d):
    return read(s, d, "documents").agg(F.count("*").alias("n"))


@query(f"WITH {D} SELECT id FROM d WHERE wing = 'en' AND room <> 'src1' AND chunk_index = 3")
def where_eq_ne(s, d):
    return collection.get(drawers(s, d), where={"wing": "en", "room": {"$ne": "src1"}, "chunk_index": {"$eq": 3}}).select("id")


@query(f"WITH {D} SELECT id FROM d WHERE wing IN ('de', 'fr') AND chunk_index IN (1, 4) AND room NOT IN ('src2', 'src3')")
def where_in_nin(s, d):
    return collection.get(drawers(s, d), where={"wing": {"$in": ["de", "fr"]}, "chunk_index": {"$in": [1, 4]}, "room": {"$nin": ["src2", "src3"]}}).select("id")


@query(f"WITH {D} SELECT id, occurred_at FROM d WHERE occurred_at >= '2024-03-01' AND occurred_at < '2024-04-15'")
def where_range_text(s, d):
    return collection.get(drawers(s, d), where={"occurred_at": {"$gte": "2024-03-01", "$lt": "2024-04-15"}}).select("id", "occurred_at")


@query("SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 40 AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 60")
def where_range_numeric(s, d):
    e = read(s, d, "events").select("event_id", F.lit("").alias("document"), F.col("props").alias("metadata"))
    return collection.get(e, where={"k": {"$gt": 40, "$lte": 60}}).select("event_id")


@query(f"WITH {D} SELECT id FROM d WHERE (wing = 'es' AND chunk_index > 2) OR (room = 'src4' AND n_chars < 900)")
def where_and_or(s, d):
    return collection.get(drawers(s, d), where={"$or": [{"$and": [{"wing": "es"}, {"chunk_index": {"$gt": 2}}]}, {"room": "src4", "n_chars": {"$lt": 900}}]}).select("id")


@query(f"WITH {D} SELECT id FROM d WHERE contains(document, 'License') OR (contains(document, 'the') AND contains(document, 'ertion'))")
def where_contains(s, d):
    return collection.get(drawers(s, d), where_document={"$or": [{"$contains": "License"}, {"$and": [{"$contains": "the"}, {"$contains": "ertion"}]}]}).select("id")


@query("""SELECT event_id, 1 AS form FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND json_type(json_extract(props, '$.k')) <> 'NULL'
 UNION ALL SELECT event_id, 2 FROM events WHERE json_exists(props, '$.missing') AND json_type(json_extract(props, '$.missing')) = 'NULL'""")
def where_null_key(s, d):
    e = read(s, d, "events").select("event_id", F.lit("").alias("document"), F.col("props").alias("metadata"))
    one = collection.get(e, where={"k": {"$ne": None}}).select("event_id", F.lit(1).alias("form"))
    return one.union(collection.get(e, where={"missing": None}).select("event_id", F.lit(2).alias("form")))


@query(f"""WITH {D} SELECT id, wing, document FROM d WHERE id % 3 <> 0 UNION ALL SELECT id, 'new' AS wing, document FROM d WHERE id % 3 = 0""")
def upsert_merge(s, d):
    rows = drawers(s, d).select("id", "wing", "document")
    return collection.upsert(rows, rows.where("id % 3 = 0").withColumn("wing", F.lit("new")))


@query(f"WITH {D} SELECT id, CASE WHEN id % 4 = 0 THEN 'moved' ELSE room END AS room, wing FROM d")
def update_merge_metadata(s, d):
    rows = drawers(s, d).select("id", "room", "wing")
    return collection.update(rows, rows.where("id % 4 = 0").select("id", F.lit("moved").alias("room")), ["room"])


@query(f"WITH {D} SELECT id, wing FROM d WHERE NOT (wing = 'de' AND chunk_index >= 2)")
def delete_where(s, d):
    return collection.delete(drawers(s, d), where={"wing": "de", "chunk_index": {"$gte": 2}}).select("id", "wing")


# --- vectors ---------------------------------------------------------------------------------------------------------

# Questions are all vectors whose id is divisible by 50, against all rows, if a query says nothing else.


def _queries(rows: DataFrame, some: str = "id % 50 = 0") -> DataFrame:
    return rows.where(some).select(F.col("id").alias("qid"), "embedding")


KNN = f"""WITH {V}, {Q}, r AS (SELECT qid, id, label, list_cosine_distance(e, qe) AS x FROM v, q WHERE {{cond}}),
 k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, id) AS rank FROM r)"""


@query(KNN.replace("FROM v, q", "FROM v, (SELECT 0 AS qid, e AS qe FROM v WHERE id = 0)").format(cond="label IN (1, 2, 3) AND id <> 0") + f" SELECT id AS vec_id, label, {SIX('x')} AS distance FROM k WHERE rank <= 10")
def knn_cosine(s, d):
    v = vectors(s, d)
    return search.knn(v, _queries(v, "id = 0"), 10, others=True, where={"label": {"$in": [1, 2, 3]}}).select(F.col("id").alias("vec_id"), "label", r6(F.col("distance")).alias("distance"))


@query(KNN.format(cond="true") + f" SELECT qid, id, CAST(rank AS INTEGER) AS rank, {SIX('x')} AS distance FROM k WHERE rank <= 5")
def knn_multi_query(s, d):
    v = vectors(s, d)
    return search.knn(v, _queries(v), 5).select("qid", "id", "rank", r6(F.col("distance")).alias("distance"))


@query(KNN.format(cond="id <> qid") + f" SELECT qid, id, CAST(rank AS INTEGER) AS rank, {SIX('x')} AS distance FROM k WHERE rank <= 10")
def knn_pruned(s, d):
    """Exact nearest rows by inverted lists."""
    found, _ = inverted.knn(vector_lists(s, d), _queries(vectors(s, d)), 10, others=True)
    return found.select("qid", "id", "rank", r6(F.col("distance")).alias("distance"))


@query(KNN.format(cond="label = 5") + f" SELECT qid, id, {SIX('x')} AS distance FROM k WHERE rank <= 8 AND x <= 1.1")
def knn_filtered(s, d):
    v = vectors(s, d)
    return search.knn(v, _queries(v), 8, max_distance=1.1, where={"label": 5}).select("qid", "id", r6(F.col("distance")).alias("distance"))


@query(f"""WITH {V}, {D}, {Q}, r AS (SELECT qid, id, wing, document, list_cosine_distance(e, qe) AS x FROM v JOIN d USING (id), q WHERE wing = 'en' AND contains(document, 'the') AND id % 5 >= 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, id) AS rank FROM r) SELECT qid, id, wing, document, CAST(rank AS INTEGER) AS rank, {SIX('x')} AS distance FROM k WHERE rank <= 6""")
def query_collection(s, d):
    """The collection's query in one call: metadata and document filters, several questions, chosen parts."""
    rows = drawers(s, d).join(vectors(s, d).select("id", "embedding"), "id")
    found = search.knn(rows, questions(s, d), 6, where={"wing": "en", "chunk_index": {"$gte": 2}}, where_document={"$contains": "the"})
    return collection.include(found, ("documents", "metadatas", "distances")).select("qid", "id", "wing", "document", "rank", r6(F.col("distance")).alias("distance"))


@query(KNN.format(cond="label = 1 AND list_cosine_distance(e, qe) < 1 - 0.1") + f" SELECT qid, id, {SIX('1 - x')} AS similarity FROM k WHERE rank <= 200")
def match_threshold(s, d):
    v = vectors(s, d)
    return search.match(v, _queries(v), 500, 0.1, {"label": 1}).select("qid", "id", r6(F.col("similarity")).alias("similarity"))


@query(KNN.format(cond="id <> qid") + " SELECT qid, id, floor((1 - x) * 1000 + 0.5) / 1000 AS similarity FROM k WHERE rank <= 5 AND round(1 - x, 3) >= 0.3")
def check_duplicate(s, d):
    v = vectors(s, d)
    return search.duplicates(v, _queries(v), 0.3, others=True).select("qid", "id", "similarity")


@query(KNN.format(cond="true") + f", n AS (SELECT * FROM k WHERE rank <= 10 AND 1 - x >= 0.35) SELECT qid, id, 'Entity ' || id AS name, CASE WHEN label < 5 THEN 'person' ELSE 'project' END AS type, {SIX('1 - x')} AS similarity FROM n")
def entity_resolve(s, d):
    v = vectors(s, d)
    known = v.select("id", F.concat(F.lit("Entity "), F.col("id")).alias("name"), F.when(F.col("label") < 5, "person").otherwise("project").alias("type"), "embedding")
    return search.resolve(known, _queries(v), 0.35).select("qid", "id", "name", "type", r6(F.col("similarity")).alias("similarity"))


@query(KNN.format(cond="true") + f" SELECT qid, id, {SIX('x')} AS distance FROM k WHERE rank <= 20 AND x <= 1 - 0.4")
def knn_min_similarity(s, d):
    v = vectors(s, d)
    return search.knn(v, _queries(v), 20, max_distance=search.max_distance(0.4)).select("qid", "id", r6(F.col("distance")).alias("distance"))


@query(f"""WITH {V}, u AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2),
 c AS (SELECT label AS wing, list(m ORDER BY i) AS ce FROM m GROUP BY 1), r AS (SELECT id, wing, 1 - list_cosine_distance(e, ce) AS s FROM v, c),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY floor(s * 1e9) DESC, wing) AS n FROM r)
 SELECT id, CASE WHEN s >= 0.3 THEN wing END AS wing, {SIX('s')} AS similarity FROM k WHERE n = 1""")
def centroid_classify(s, d):
    return search.nearest_centroid(vectors(s, d)).select("id", "wing", r6(F.col("similarity")).alias("similarity"))


@query(f"""WITH {V} SELECT a.label AS g, a.id AS a, b.id AS b, {SIX('list_cosine_distance(a.e, b.e)')} AS distance FROM v a JOIN v b ON a.label = b.label AND a.id < b.id
 WHERE list_cosine_distance(a.e, b.e) < 0.6""")
def near_dup_pairs(s, d):
    return search.near_pairs(vectors(s, d), 0.6).withColumn("distance", r6(F.col("distance")))


@query(f"""WITH RECURSIVE {D}, {V}, r AS (SELECT source_file, id, len(document) AS size, e, row_number() OVER (PARTITION BY source_file ORDER BY len(document) DESC, id) AS n FROM d JOIN v USING (id)),
 w AS (SELECT source_file, id, size >= {near_dup.SHORTEST} AS kept, n, CASE WHEN size >= {near_dup.SHORTEST} THEN [e] ELSE [] END AS held FROM r WHERE n = 1
 UNION ALL SELECT source_file, id, good, n, CASE WHEN good THEN list_append(held, e) ELSE held END FROM (SELECT r.source_file, r.id, r.n, held, r.e, size >= {near_dup.SHORTEST} AND NOT coalesce(list_bool_or([list_cosine_distance(h, r.e) < 0.6 FOR h IN held]), FALSE) AS good FROM w JOIN r ON r.source_file = w.source_file AND r.n = w.n + 1))
 SELECT source_file, id, kept FROM w""")
def near_dup_greedy(s, d):
    v = vectors(s, d)
    return near_dup.greedy(drawers(s, d).join(v.select("id", "embedding"), "id"), distance=0.6)


# --- lexical and fused ranking ---------------------------------------------------------------------------------------

BM = f"""tk AS (SELECT id, regexp_extract_all(lower(document), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}') AS w FROM {{base}}),
 ln_ AS (SELECT id, len(w) AS dl FROM tk), av AS (SELECT count(*) AS n, avg(dl) AS a FROM ln_), u AS (SELECT id, unnest(w) AS t FROM tk),
 tf AS (SELECT id, t, count(*) AS f FROM u WHERE t IN ({{terms}}) GROUP BY 1, 2), df AS (SELECT t, count(*) AS c FROM tf GROUP BY 1),
 bm AS (SELECT id, sum(ln((n - c + 0.5) / (c + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / a))) AS s FROM tf JOIN df USING (t) JOIN ln_ USING (id), av GROUP BY id)"""
TERMS = ", ".join(f"'{w}'" for w in WORDS)
SPLIT = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
#: BM25 of each question's terms tq(qid, t): over all of d, and within the question's own rows c0(qid, id, document).
BMALL = f"""tk AS (SELECT id, {SPLIT.format(x='document')} AS w FROM d), ln_ AS (SELECT id, len(w) AS dl FROM tk), av AS (SELECT count(*) AS n, avg(dl) AS a FROM ln_), u AS (SELECT id, unnest(w) AS t FROM tk),
 tf AS (SELECT id, t, count(*) AS f FROM u WHERE t IN (SELECT t FROM tq) GROUP BY 1, 2), df AS (SELECT t, count(*) AS c FROM tf GROUP BY 1),
 bm AS (SELECT qid, id, sum(ln((n - c + 0.5) / (c + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / a))) AS s FROM tf JOIN df USING (t) JOIN ln_ USING (id) JOIN tq USING (t), av GROUP BY 1, 2)"""
BMOWN = f"""tk AS (SELECT qid, id, {SPLIT.format(x='document')} AS w FROM c0), ln_ AS (SELECT qid, id, len(w) AS dl FROM tk), av AS (SELECT qid, count(*) AS n, avg(dl) AS a FROM ln_ GROUP BY 1), u AS (SELECT qid, id, unnest(w) AS t FROM tk),
 tf AS (SELECT qid, id, t, count(*) AS f FROM u JOIN tq USING (qid, t) GROUP BY 1, 2, 3), df AS (SELECT qid, t, count(*) AS c FROM tf GROUP BY 1, 2),
 bm AS (SELECT qid, id, sum(ln((n - c + 0.5) / (c + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / a))) AS s FROM tf JOIN df USING (qid, t) JOIN ln_ USING (qid, id) JOIN av USING (qid) GROUP BY 1, 2)"""
ASKS = f"tq AS (SELECT DISTINCT qid, unnest({SPLIT.format(x='question')}) AS t FROM q)"


@query(f"WITH {D}, {BM.format(base='d', terms=TERMS)} SELECT id, {SIX('s')} AS bm25 FROM bm ORDER BY {SIX('s')} DESC, id LIMIT 20")
def bm25_topk(s, d):
    asked = s.createDataFrame([(0, WORDS)], "qid long, terms array<string>")
    return lexical.search(lexical_index(s, d), asked, 20).select("id", r6(F.col("bm25")).alias("bm25"))


@query(f"WITH {D}, {Q}, {ASKS}, {BMALL}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(s * 1e6 + 0.5) DESC, id) AS rank FROM bm) SELECT qid, id, CAST(rank AS INTEGER) AS rank, {SIX('s')} AS bm25 FROM k WHERE rank <= 10")
def bm25_questions(s, d):
    asked = questions(s, d).select("qid", search.terms_of(F.col("question")).alias("terms"))
    return lexical.search(lexical_index(s, d), asked, 10).select("qid", "id", "rank", r6(F.col("bm25")).alias("bm25"))


@query(f"WITH {D}, c0 AS (SELECT * FROM d WHERE wing = 'en' AND room IN ('src1', 'src2')), {BM.format(base='c0', terms=TERMS)} SELECT c0.id, {SIX('coalesce(s, 0)')} AS bm25 FROM c0 LEFT JOIN bm USING (id)")
def bm25_candidates(s, d):
    some = drawers(s, d).where("wing = 'en' and room in ('src1', 'src2')")
    return search.bm25(some, WORDS).select("id", r6(F.col("bm25")).alias("bm25"))


def _candidates(s, d, k=40):
    v = vectors(s, d)
    return search.nearest(v, _queries(v), k, others=True).join(drawers(s, d), "id")


CAND = KNN.format(cond="id <> qid").replace("WITH ", f"WITH {D}, ", 1) + ", c0 AS (SELECT d.*, k.qid, k.x, k.rank FROM k JOIN d USING (id) WHERE rank <= {k})"


def _best_sql(score: str, order: str, name: str, k: int, source: str = "c0") -> str:
    """The k best rows of each question by a rounded score, then by id."""
    return f" SELECT qid, id, {name} FROM (SELECT qid, id, {SIX(score)} AS {name}, row_number() OVER (PARTITION BY qid ORDER BY {SIX(score)} {order}, id) AS n FROM {source}) WHERE n <= {k}"


@query(CAND.format(k=40) + f", tq AS (SELECT qid, unnest({_list(WORDS)}) AS t FROM q), {BMOWN}, mx AS (SELECT qid, max(s) AS m FROM bm GROUP BY 1), h AS (SELECT c0.qid, c0.id, 0.6 * greatest(0, 1 - x) + 0.4 * coalesce(s / m, 0) AS z FROM c0 LEFT JOIN bm USING (qid, id) LEFT JOIN mx USING (qid))" + _best_sql("z", "DESC", "score", 10, "h"))
def hybrid_rank(s, d):
    rows = _candidates(s, d).withColumn("terms", F.array(*map(F.lit, WORDS)))
    ranked = search.hybrid(search.bm25_within(rows, text="document")).withColumn("score", r6(F.col("score")))
    return collection.top(ranked, 10, [F.col("score").desc(), F.col("id")], ["qid"], "n").select("qid", "id", "score")


FUSE = f""", lx AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY floor(s * 1e6 + 0.5) DESC, id) AS r FROM bm JOIN d USING (id) WHERE {{cond}}),
 f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + r)) AS z FROM (SELECT qid, id, rank AS r FROM k WHERE rank <= 50 UNION ALL SELECT qid, id, r FROM lx WHERE r <= 50) GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(z, 9) DESC, id) AS n FROM f) SELECT qid, id, CAST(n AS INTEGER) AS rank, {SIX('z')} AS rrf, {SIX('1 - least(z / (2.0::DOUBLE / 61), 1)')} AS distance, wing, document FROM o JOIN d USING (id) WHERE n <= 10"""


def _embedded(s, d):
    return drawers(s, d).join(vectors(s, d).select("id", "embedding"), "id", "left")


def _fused(found):
    return found.select("qid", "id", "rank", r6(F.col("rrf")).alias("rrf"), r6(F.col("distance")).alias("distance"), "wing", "document")


@query(KNN.format(cond="id IN (SELECT id FROM d)").replace("WITH ", f"WITH {D}, ", 1) + f", {ASKS}, {BMALL}" + FUSE.format(cond="true"))
def rrf_fusion(s, d):
    return _fused(search.hybrid_query(_embedded(s, d), questions(s, d), lexical_index(s, d)))


SOME = "wing = 'en' AND contains(document, 'on')"


@query(KNN.format(cond=f"id IN (SELECT id FROM d WHERE {SOME})").replace("WITH ", f"WITH {D}, ", 1) + f", {ASKS}, {BMALL}" + FUSE.format(cond=SOME))
def rrf_filtered(s, d):
    return _fused(search.hybrid_query(_embedded(s, d), questions(s, d), lexical_index(s, d), where={"wing": "en"}, where_document={"$contains": "on"}))


@query(KNN.format(cond=f"id IN (SELECT id FROM d WHERE wing = 'en')").replace("WITH ", f"WITH {D}, ", 1) + f", {ASKS}, {BMALL}" + FUSE.format(cond="wing = 'en'").replace(", wing, document", ", 'hybrid' AS search_method") + " AND 1 - least(z / (2.0::DOUBLE / 61), 1) <= 0.6")
def search_routed(s, d):
    found = search.routed_search(_embedded(s, d), questions(s, d), lexical_index(s, d), 10, 0.6, where={"wing": "en"})
    return found.select("qid", "id", "rank", r6(F.col("rrf")).alias("rrf"), r6(F.col("distance")).alias("distance"), "search_method")


#: Questions in the forms that full text knows, by the question's number; w are the words of its passage.
FORMS = ["{1} {2}", '"{2} {3}"', "{1} {4} or {6}", "{1} -{3}", '{5} or "{1} {2}" -{6}']


def _phrased(s, d):
    w = F.regexp_extract_all("question", F.lit(fulltext.WORD), F.lit(0))

    def form(f: str):
        parts = f.replace("{", "\0{").replace("}", "\0").split("\0")
        return F.concat(*[F.coalesce(F.get(w, int(p[1:]) - 1), F.lit("")) if p.startswith("{") else F.lit(p) for p in parts if p])

    return questions(s, d).select("qid", F.element_at(F.array(*map(form, FORMS)), (F.expr("qid div 50") % len(FORMS) + 1).cast("int")).alias("question"), "embedding")


def _fulltext_sql() -> str:
    """Parses, matches, and enumerates all stretches from an occurrence's start to one's end."""
    word = f"'{fulltext.WORD}'"
    form = lambda f: " || ".join(f"coalesce(w[{p[1:]}], '')" if p.startswith("{") else f"'{p}'" for p in f.replace("{", "\0{").replace("}", "\0").split("\0") if p)
    stems = "w"
    for pattern, put in fulltext.stem_rules("\\{}"):
        stems = f"regexp_replace({stems}, '{pattern}', '{put}')"
    stems = f"CASE WHEN regexp_matches(w, '^[a-z]{{3,}}$') THEN {stems} ELSE w END"
    stop = ", ".join(f"'{x}'" for x in fulltext.STOP)
    return f"""{D}, {Q}, fw AS (SELECT qid, regexp_extract_all(question, {word}) AS w FROM q), fq AS (SELECT qid, CASE qid // 50 % {len(FORMS)} {' '.join(f'WHEN {i} THEN {form(f)}' for i, f in enumerate(FORMS))} END AS question FROM fw),
 p0 AS (SELECT qid, regexp_extract_all(lower(question), '-?"[^"]*"?|[^\\s"]+') AS ps FROM fq), p1 AS (SELECT qid, unnest(ps) AS part, generate_subscripts(ps, 1) AS item FROM p0),
 p2 AS (SELECT *, count_if(part = 'or') OVER (PARTITION BY qid ORDER BY item) AS grp FROM p1), p3 AS (SELECT qid, grp, item, regexp_matches(part, '^-.') AS neg, regexp_extract_all(part, {word}) AS ws FROM p2 WHERE part <> 'or'),
 p4 AS (SELECT qid, grp, item, neg, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM p3), p5 AS (SELECT *, min(pos) OVER i AS low, max(pos) OVER i AS high, count(*) OVER i AS size FROM p4 WHERE w NOT IN ({stop}) WINDOW i AS (PARTITION BY qid, item)),
 ask AS (SELECT qid, grp, item, neg, pos - low AS off, high - low AS span, size, {stems} AS term FROM p5),
 t0 AS (SELECT id, regexp_extract_all(lower(document), {word}) AS ws FROM d), t1 AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM t0), t2 AS (SELECT w, {stems} AS term FROM (SELECT DISTINCT w FROM t1 WHERE w NOT IN ({stop}))),
 lex AS (SELECT id, pos, term FROM t1 JOIN t2 USING (w) WHERE term IN (SELECT term FROM ask)),
 hit AS (SELECT qid, grp, item, neg, off, span, size, id, pos, pos - off AS s FROM ask JOIN lex USING (term)),
 occ AS (SELECT qid, grp, item, neg, id, s, s + span AS e FROM hit GROUP BY qid, grp, item, neg, id, s, span, size HAVING count(DISTINCT off) = size),
 want AS (SELECT qid, grp, count(DISTINCT item) AS n FROM ask WHERE NOT neg GROUP BY 1, 2),
 gm AS (SELECT qid, grp, id, n FROM occ JOIN want USING (qid, grp) GROUP BY ALL HAVING count(DISTINCT item) FILTER (NOT neg) = n AND count_if(neg) = 0),
 oc AS (SELECT occ.*, n FROM occ JOIN gm USING (qid, grp, id)),
 ca AS (SELECT DISTINCT a.qid, a.grp, a.id, a.n, a.s AS p, b.e AS q FROM oc a JOIN oc b ON a.qid = b.qid AND a.grp = b.grp AND a.id = b.id AND a.s <= b.e AND (a.n > 1 OR a.e = b.e)),
 cv AS (SELECT ca.qid, ca.id, p, q FROM ca JOIN oc o ON o.qid = ca.qid AND o.grp = ca.grp AND o.id = ca.id AND o.s >= p AND o.e <= q GROUP BY ca.qid, ca.grp, ca.id, ca.n, p, q HAVING count(DISTINCT o.item) = ca.n),
 mn AS (SELECT DISTINCT * FROM cv WHERE NOT EXISTS (SELECT 1 FROM cv x WHERE x.qid = cv.qid AND x.id = cv.id AND x.p >= cv.p AND x.q <= cv.q AND (x.p > cv.p OR x.q < cv.q))),
 ps AS (SELECT DISTINCT qid, id, pos FROM hit JOIN (SELECT DISTINCT qid, grp, item, id FROM occ WHERE NOT neg) USING (qid, grp, item, id)),
 cw AS (SELECT mn.qid, mn.id, p, q, 0.1::DOUBLE / (2 + q - p - count(pos)) AS z FROM mn JOIN ps ON ps.qid = mn.qid AND ps.id = mn.id AND pos BETWEEN p AND q GROUP BY 1, 2, 3, 4),
 ft AS (SELECT qid, id, count(*) AS covers, sum(z) AS s FROM cw GROUP BY 1, 2)"""


@query(lambda: f"WITH {_fulltext_sql()} SELECT qid, id, covers, {SIX('s')} AS density FROM ft")
def fulltext_match(s, d):
    """All texts that match a question, for every question."""
    return fulltext.match(fulltext_index(s, d), _phrased(s, d)).withColumn("density", r6(F.col("density")))


@query(lambda: f"WITH {_fulltext_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(s * 1e6 + 0.5) DESC, id) AS rank FROM ft) SELECT qid, id, CAST(rank AS INTEGER) AS rank, {SIX('s')} AS density FROM k WHERE rank <= 20")
def fulltext_rank(s, d):
    return fulltext.search(fulltext_index(s, d), _phrased(s, d), 20).select("qid", "id", "rank", r6(F.col("density")).alias("density"))


@query(lambda: KNN.format(cond="id IN (SELECT id FROM d WHERE wing = 'en')").replace(f"{V}, {Q}", f"{V}, {_fulltext_sql()}", 1) + ", bm AS (SELECT * FROM ft)" + FUSE.format(cond="wing = 'en'").replace(", wing, document", ""))
def rrf_fulltext(s, d):
    """Fusion with full text in place of BM25."""
    return search.hybrid_query(_embedded(s, d), _phrased(s, d), fulltext_index(s, d), where={"wing": "en"}, exact=True).select("qid", "id", "rank", r6(F.col("rrf")).alias("rrf"), r6(F.col("distance")).alias("distance"))


@query(lambda: KNN.format(cond="id IN (SELECT id FROM d WHERE wing = 'en')").replace("WITH ", f"WITH {D}, ", 1) + f", {ASKS}, {BMALL}" + FUSE.format(cond="wing = 'en'").replace("SELECT qid, id, CAST(n AS INTEGER) AS rank", ", g AS (SELECT qid, id, n, document FROM o JOIN d USING (id) WHERE n <= 30), "
 f"gt AS (SELECT DISTINCT qid, id, unnest({SPLIT.format(x='document')}) AS t FROM g), gh AS (SELECT qid, id, t, count(*) OVER (PARTITION BY qid, t) AS c FROM gt JOIN tq USING (qid, t)), gn AS (SELECT qid, count(*) AS n_all FROM g GROUP BY 1), "
 "gs AS (SELECT qid, id, sum(ln(1 + n_all / CAST(c AS DOUBLE))) AS s FROM gh JOIN gn USING (qid) GROUP BY 1, 2) SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(s, 0), 9) DESC, n) AS INTEGER) AS rank, TRUE AS reranked FROM g LEFT JOIN gs USING (qid, id) --"))
def reranked(s, d):
    """Fused hits of every question, put in order by a scorer that sees a question's candidates together."""
    asked = questions(s, d)
    hits = search.hybrid_query(_embedded(s, d), asked, lexical_index(s, d), 30, where={"wing": "en"})
    return search.rerank(hits, asked).select("qid", "id", "rank", "reranked")


SRC = "'f' || CAST({id} // 5 AS VARCHAR)"
#: Index rows point to a source in no relation to their vector.
LINE = "'f' || CAST(({id} * 3) % (SELECT greatest(count(*) // 5, 1) FROM documents) AS VARCHAR)"


def _index(s, d):
    sources = max(1, read(s, d, "documents").count() // 5)  # rows point to all of them
    return vectors(s, d).withColumn("source_file", F.concat(F.lit("f"), (F.col("id") * 3) % sources))


BOOST = f"""i0 AS (SELECT qid, {LINE.format(id='id')} AS sf, list_cosine_distance(e, qe) AS x, row_number() OVER (PARTITION BY qid ORDER BY list_cosine_distance(e, qe), id) AS r FROM v, q),
 i2 AS (SELECT qid, sf, arg_min(x, r) AS x, min(r) AS r FROM i0 WHERE r <= 10 GROUP BY 1, 2),
 z AS (SELECT k.*, {SRC.format(id='k.id')} AS source_file, CASE WHEN i2.x <= 1.5 THEN coalesce(([0.40, 0.25, 0.15, 0.08, 0.04]::DOUBLE[])[i2.r], 0) ELSE 0 END AS boost FROM k LEFT JOIN i2 ON i2.qid = k.qid AND i2.sf = {SRC.format(id='k.id')} WHERE rank <= 15)"""


@query(KNN.format(cond="true") + f", {BOOST} SELECT qid, id, source_file, {SIX('x - boost')} AS effective, boost FROM z")
def closet_boost(s, d):
    v = vectors(s, d).withColumn("source_file", F.concat(F.lit("f"), F.expr("id div 5")))
    q = _queries(v)
    out = search.boost(search.knn(v, q, 15), search.knn(_index(s, d), q, 10))
    return out.select("qid", "id", "source_file", r6(F.col("effective")).alias("effective"), "boost")


def _end_to_end(where: str = "true", k: int = 5, bound: float = 1.2, asked: str = Q) -> str:
    """The whole search in SQL: 3k and 2k fetched, boosted, cut to k, hydrated, ranked."""
    boost = BOOST.replace("r <= 10", f"r <= {2 * k}").replace("rank <= 15", f"rank <= {3 * k}")
    return f"""WITH {D}, {V}, {asked}, dr AS (SELECT d.*, label, e FROM d JOIN v USING (id)), r AS (SELECT qid, id, list_cosine_distance(e, qe) AS x FROM dr, q WHERE {where}),
 k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, id) AS rank FROM r), {boost},
 p0 AS (SELECT *, x - boost AS eff, row_number() OVER (PARTITION BY qid ORDER BY x - boost, rank) AS place FROM z WHERE x <= {bound}), p AS (SELECT * FROM p0 WHERE place <= {k}),
 tq AS (SELECT DISTINCT qid, unnest({SPLIT.format(x='question')}) AS t FROM q), tl AS (SELECT qid, list(t) AS terms FROM tq GROUP BY 1), wn AS (SELECT DISTINCT p.qid, source_file, coalesce(terms, []) AS terms FROM p LEFT JOIN tl USING (qid) WHERE boost > 0),
 ch AS (SELECT qid, source_file, len(list_filter(terms, lambda t: contains(lower(document), t))) AS hits, row_number() OVER (PARTITION BY qid, source_file ORDER BY chunk_index, id) - 1 AS pos, count(*) OVER (PARTITION BY qid, source_file) AS total,
  string_agg(document, chr(10) || chr(10)) OVER (PARTITION BY qid, source_file ORDER BY chunk_index, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t FROM dr JOIN wn USING (source_file)),
 b0 AS (SELECT *, row_number() OVER (PARTITION BY qid, source_file ORDER BY hits DESC, pos) AS n FROM ch), b AS (SELECT qid, source_file, pos, total, CASE WHEN len(t) > 10000 THEN substring(t, 1, 10000) || chr(10) || chr(10) || '[...truncated. ' || total || ' total drawers.]' ELSE t END AS t FROM b0 WHERE n = 1 AND total > 1),
 c0 AS (SELECT p.*, coalesce(b.t, dr.document) AS document, b.pos, b.total, wing, room FROM p JOIN dr USING (id) LEFT JOIN b ON b.qid = p.qid AND b.source_file = p.source_file AND p.boost > 0), {BMOWN}, mx AS (SELECT qid, max(s) AS m FROM bm GROUP BY 1),
 h AS (SELECT c0.*, coalesce(s, 0) AS bm25, 0.6 * greatest(0, 1 - x) + 0.4 * coalesce(s / m, 0) AS score FROM c0 LEFT JOIN bm USING (qid, id) LEFT JOIN mx USING (qid)),
 o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, place) AS INTEGER) AS n FROM h)"""


def _searched(s, d, where=None):
    rows = drawers(s, d).join(vectors(s, d), "id")
    return search.search_memories(rows, questions(s, d), 5, _index(s, d), where, 1.2)


@query(_end_to_end() + f" SELECT qid, id, n AS rank, source_file, md5(document) AS text_md5, {SIX('x')} AS distance, boost, {SIX('eff')} AS effective, {SIX('greatest(0, 1 - eff)')} AS similarity, {SIX('bm25')} AS bm25, {SIX('score')} AS score, CASE WHEN boost > 0 THEN 'drawer+index' ELSE 'drawer' END AS matched_via, pos AS drawer_index, total FROM o")
def search_memories(s, d):
    found = _searched(s, d)
    numbers = [r6(F.col(c)).alias(c) for c in ("distance", "effective", "similarity", "bm25", "score")]
    return found.select("qid", "id", "rank", "source_file", F.md5("text").alias("text_md5"), "boost", *numbers, "matched_via", "drawer_index", "total")


@query(_end_to_end().replace("FROM v, q)", "FROM v, q WHERE label = 5)").replace("FROM dr, q WHERE true", "FROM dr, q WHERE label = 5") + f" SELECT qid, id, n AS rank, wing, room, source_file, CASE WHEN len(document) > 200 THEN substring(document, 1, 200) || '...' ELSE document END AS preview, {SIX('x')} AS distance, boost, {SIX('eff')} AS effective, {SIX('greatest(0, 1 - eff)')} AS similarity, {SIX('bm25')} AS bm25, {SIX('score')} AS score, CASE WHEN boost > 0 THEN 'drawer+index' ELSE 'drawer' END AS matched_via FROM o")
def explain_search(s, d):
    out = search.explain_search(_searched(s, d, {"label": 5}))
    return out.withColumns({c: r6(F.col(c)) for c in ("distance", "effective", "similarity", "bm25", "score")})


@query(f"""WITH {D}, h AS (SELECT id AS hit_id, source_file AS sf, chunk_index AS ci FROM d)
 SELECT hit_id, string_agg(document, chr(10) || chr(10) ORDER BY chunk_index, id) AS text, count(*) AS n, (SELECT count(*) FROM d e WHERE e.source_file = sf) AS total FROM h JOIN d ON d.source_file = sf AND chunk_index BETWEEN ci - 1 AND ci + 1 GROUP BY hit_id, sf""")
def neighbour_expand(s, d):
    rows = drawers(s, d)
    return search.neighbours(rows, rows)


@query(f"""WITH {D}, p AS (SELECT *, {' + '.join(f"CAST(contains(lower(document), '{w}') AS INTEGER)" for w in WORDS)} AS hits, row_number() OVER w - 1 AS position,
 string_agg(document, chr(10) || chr(10)) OVER (PARTITION BY source_file ORDER BY chunk_index, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t FROM d WINDOW w AS (PARTITION BY source_file ORDER BY chunk_index, id)),
 q AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY hits DESC, position) AS r FROM p) SELECT source_file, id, hits, substring(t, 1, 10000) AS text FROM q WHERE r = 1""")
def hydrate_best_chunk(s, d):
    return search.best_chunk(drawers(s, d), WORDS).select("source_file", "id", "hits", "text")


def _reranked(rows: DataFrame, factor, k: int = 10) -> DataFrame:
    out = rows.withColumn("distance", r6(F.col("distance") * factor))
    return collection.top(out, k, [F.col("distance"), F.col("id")], ["qid"], "n").select("qid", "id", "distance")


OV = "(" + " + ".join(f"CAST(contains(lower(document), '{w}') AS INTEGER)" for w in QUESTION) + f") / {len(QUESTION)}.0"


@query(CAND.format(k=50) + _best_sql(f"x * (1 - 0.30 * {OV})", "", "distance", 10))
def keyword_overlap_rank(s, d):
    return _reranked(_candidates(s, d, 50), 1 - 0.30 * overlap(F.col("document"), QUESTION))


@query(CAND.format(k=50) + ", o AS (SELECT *, abs(date_diff('day', DATE '2024-06-01' - 21, CAST(occurred_at AS DATE))) AS off FROM c0)" + _best_sql("x * CASE WHEN off <= 5 THEN 0.6 WHEN off <= 15 THEN 1 - 0.4 * (1 - (off - 5) / 10.0) ELSE 1 END", "", "distance", 10, "o"))
def temporal_boost_rank(s, d):
    when = dates.relative_days(F.lit("What did they say 3 weeks ago?"))
    rows = _candidates(s, d, 50)
    factor = dates.temporal_factor(F.lit("2024-06-01").cast("date"), F.col("occurred_at").cast("date"), when["days"], when["tolerance"])
    return _reranked(rows, factor)


@query(CAND.format(k=50) + _best_sql("x * (1 - 0.60 * CAST(contains(lower(document), 'the ') AS INTEGER)) * (1 - 0.40 * (CAST(contains(lower(document), 'ertion') AS INTEGER) + CAST(contains(lower(document), 'thnt') AS INTEGER)) / 2.0)", "", "distance", 10))
def phrase_name_boost(s, d):
    text_ = F.col("document")
    return _reranked(_candidates(s, d, 50), (1 - 0.60 * overlap(text_, ["the "])) * (1 - 0.40 * overlap(text_, ["ertion", "thnt"])))


@query(CAND.format(k=50) + _best_sql("CASE WHEN room = $$src2$$ THEN x * 0.8 ELSE x END", "", "distance", 10))
def room_soft_boost(s, d):
    return _reranked(_candidates(s, d, 50), F.when(F.col("room") == "src2", 0.8).otherwise(1.0))


# --- haystacks -------------------------------------------------------------------------------------------------------

#: What is asked of a question's own haystack, by the question's id.
ASKING = [
    "What did Anna say on 'thnt wh' and the ertion, 3 weeks ago?", "Can you remind me: you suggested \"is the\" and 'on th'", "Which elle was with that, last month and with that?", "When did I prefer it 10 days ago with Anna and Bob?",
]
#: What some documents state, so that there are preferences and names.
STATED = ["I prefer quiet rooms by far. Anna met Bob. ", "", "I usually walk home, Anna said. "]
HAY = f"""hq AS (SELECT qid, qe, {_before('qid // 50', "''", ASKING)} AS question FROM q), hs AS (SELECT hq.qid, v.id AS corpus_id, v.id AS position, {_before('v.id', 'document', STATED)} AS document, v.e, occurred_at FROM hq JOIN v ON v.label = (hq.qid // 50) % 10 JOIN d ON d.id = v.id)"""


def _haystack(s, d):
    """The stacks are the labels; each question looks through one of them."""
    v, q = vectors(s, d), questions(s, d).select("qid", "embedding")
    asked = q.select("qid", (F.expr("qid div 50") % 10).cast("int").alias("stack"), "embedding", F.element_at(F.array(*map(F.lit, ASKING)), (F.expr("qid div 50") % len(ASKING) + 1).cast("int")).alias("question"), F.lit("2024-06-01").alias("asked_at"))
    rows = v.join(drawers(s, d).select("id", "document", "occurred_at"), "id")
    return rows.select(F.col("label").alias("stack"), F.col("id").alias("corpus_id"), F.col("id").alias("position"), _put_before("position", "document", STATED).alias("document"), "embedding", "occurred_at"), asked


@query(lambda: f"""WITH {D}, {V}, {Q}, {HAY}, r AS (SELECT qid, corpus_id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_distance(e, qe), 12), position) AS n FROM hs JOIN hq USING (qid)),
 z AS (SELECT qid, corpus_id, CASE WHEN n <= 10 THEN n END AS n FROM r) SELECT qid, corpus_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY n NULLS LAST, corpus_id) AS INTEGER) AS rank FROM z""")
def haystack_raw(s, d):
    return haystack.raw(*_haystack(s, d), 10)


@query(lambda: f"""WITH {D}, {V}, {Q}, {HAY}, r AS (SELECT qid, corpus_id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_distance(list_reverse(e), qe), 12), position) AS n FROM hs JOIN hq USING (qid)),
 z AS (SELECT qid, corpus_id, CASE WHEN n <= 10 THEN n END AS n FROM r) SELECT qid, corpus_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY n NULLS LAST, corpus_id) AS INTEGER) AS rank FROM z""")
def haystack_full(s, d):
    """The plain ranking by the vectors of all that was said."""
    rows, asked = _haystack(s, d)
    return haystack.raw(rows.withColumn("full_embedding", F.reverse("embedding")), asked, 10, "full_embedding")


KW = "list_filter(regexp_extract_all(lower(question), '\\b[a-z]{3,}\\b'), lambda w: NOT list_contains({stop}, w))"
PH = "list_filter([trim(p) FOR p IN regexp_extract_all(question, '''([^'']{3,60})''', 1) || regexp_extract_all(question, '\"([^\"]{3,60})\"', 1)], lambda p: len(p) >= 3)"
NMS = "list_filter(list_distinct(regexp_extract_all(question, '\\b[A-Z][a-z]{2,15}\\b')), lambda w: NOT list_contains({not_names}, w))"
HELD_SHARE = "CASE WHEN len({of}) > 0 THEN len(list_filter({of}, lambda p: contains(lower(document), lower(p)))) / CAST(len({of}) AS DOUBLE) ELSE 0 END"


def _signals_sql() -> str:
    lists = f"{KW.replace('{stop}', _list(haystack.STOP_WORDS))} AS kw, {PH} AS ph, {NMS.replace('{not_names}', _list(haystack.NOT_NAMES))} AS nm"
    assistant = " OR ".join(f"contains(lower(question), '{x}')" for x in haystack.ASSISTANT)
    return f"sg AS (SELECT *, {lists}, ({assistant}) AS asst, CASE (qid // 50) % {len(ASKING)} WHEN 0 THEN 21 WHEN 2 THEN 30 WHEN 3 THEN 10 END AS days, CASE (qid // 50) % {len(ASKING)} WHEN 0 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 2 END AS tol FROM hq)"


@query(lambda: f"""WITH {D}, {V}, {Q}, {HAY}, {_signals_sql()},
 pr AS (SELECT hs.*, list_filter({_pref_sql('document')}, lambda x: len(x) BETWEEN 5 AND 80) AS a FROM hs), pu AS (SELECT qid, corpus_id, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM pr), pf AS (SELECT qid, corpus_id, p, min(i) AS i FROM pu GROUP BY 1, 2, 3),
 pk AS (SELECT qid, corpus_id, string_agg(p, '; ' ORDER BY i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY qid, corpus_id ORDER BY i) AS n FROM pf) WHERE n <= 12 GROUP BY 1, 2),
 al AS (SELECT *, FALSE AS made FROM hs UNION ALL SELECT hs.qid, hs.corpus_id, position + 1000000, 'User has mentioned: ' || t, e, occurred_at, TRUE FROM hs JOIN pk USING (qid, corpus_id)),
 di AS (SELECT al.*, sg.* EXCLUDE (qid), round(list_cosine_distance(e, qe), 12) AS x FROM al JOIN sg USING (qid) WHERE NOT (asst AND made)), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, position) AS n FROM di) WHERE n <= 20),
 o AS (SELECT *, abs(date_diff('day', DATE '2024-06-01' - CAST(days AS INTEGER), CAST(occurred_at AS DATE))) AS off FROM k),
 w AS (SELECT qid, corpus_id, position, round(x * (1 - 0.30 * {HELD_SHARE.format(of='kw')}) * CASE WHEN asst THEN 1 - 0.60 * {HELD_SHARE.format(of='ph')} ELSE (1 - 0.40 * {HELD_SHARE.format(of='nm')}) * coalesce(CASE WHEN off <= tol THEN 0.6 WHEN off <= tol * 3 THEN 1 - 0.40 * (1 - (off - tol) / CAST(tol * 2 AS DOUBLE)) ELSE 1 END, 1) END, 9) AS score FROM o),
 b AS (SELECT qid, corpus_id, min((score, position)) AS m FROM w GROUP BY 1, 2), every AS (SELECT DISTINCT qid, corpus_id FROM hs)
 SELECT qid, corpus_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY m NULLS LAST, corpus_id) AS INTEGER) AS rank FROM every LEFT JOIN b USING (qid, corpus_id)""")
def haystack_hybrid(s, d):
    return haystack.hybrid(*_haystack(s, d), 20)


@query(lambda: f"""WITH {D}, {V}, {Q}, {HAY}, {_signals_sql()}, di AS (SELECT hs.*, sg.* EXCLUDE (qid), list_filter(kw, lambda z: NOT list_contains([lower(y) FOR y IN nm], z)) AS pk, round(list_cosine_distance(e, qe), 12) AS x FROM hs JOIN sg USING (qid)),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, position) AS n FROM di) WHERE n <= 15), w AS (SELECT qid, corpus_id, position, round(x * (1 - 0.50 * {HELD_SHARE.format(of='pk')}), 9) AS score FROM k)
 SELECT * FROM (SELECT qid, corpus_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, position) AS INTEGER) AS rank FROM w) WHERE rank <= 5""")
def haystack_predicates(s, d):
    return haystack.by_predicates(*_haystack(s, d), 5)


#: Signals of every document of every haystack; y is its distance lowered as dialogs are weighed.
DIALOGS = f"""di AS (SELECT hs.*, sg.* EXCLUDE (qid), list_filter(kw, lambda z: NOT list_contains([lower(y) FOR y IN nm], z)) AS pk, round(list_cosine_distance(e, qe), 12) AS x FROM hs JOIN sg USING (qid)),
 dw AS (SELECT *, round(x * (1 - 0.50 * {HELD_SHARE.format(of='pk')}) * (1 - 0.60 * {HELD_SHARE.format(of='ph')}) * (1 - 0.20 * {HELD_SHARE.format(of='nm')}), 9) AS y FROM di)"""


def _dialog_sql(opened: str, fetched: str) -> str:
    return f"""WITH {D}, {V}, {Q}, {HAY}, {_signals_sql()}, {DIALOGS}, {opened}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, position) AS n FROM op) WHERE {fetched})
 SELECT * FROM (SELECT qid, corpus_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY y, position) AS INTEGER) AS rank FROM k) WHERE rank <= 5"""


@query(lambda: _dialog_sql("op AS (SELECT * FROM dw)", "n <= 15"))
def haystack_dialog(s, d):
    return haystack.dialog_hybrid(*_haystack(s, d), 5)


SAYS_SHARE = HELD_SHARE.replace("document", "substring(document, 1, 300)")


@query(lambda: _dialog_sql(f"""ss AS (SELECT qid, corpus_id, {SAYS_SHARE.format(of='pk')} AS s FROM dw), sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, corpus_id DESC) AS r, count(*) OVER (PARTITION BY qid) AS c FROM ss),
 op AS (SELECT dw.* FROM dw JOIN sr USING (qid, corpus_id) WHERE r <= greatest(5, c // 3))""", "n <= 10"))
def haystack_sessions(s, d):
    """Dialogs by sessions, whose summaries are their texts' beginnings."""
    rows, asked = _haystack(s, d)
    return haystack.dialog_sessions(rows, rows.select("stack", "corpus_id", F.substring("document", 1, 300).alias("summary")), asked, 5)


@query(lambda: _dialog_sql(f"""rt AS (SELECT qid, 'r' || corpus_id % 7 AS room, string_agg(substring(document, 1, 60), ' ' ORDER BY substring(document, 1, 60)) AS document, any_value(pk) AS pk FROM dw GROUP BY 1, 2), rs AS (SELECT qid, room, {HELD_SHARE.format(of='pk')} AS s FROM rt),
 rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, room DESC) AS r, max(s) OVER (PARTITION BY qid) AS m FROM rs), op AS (SELECT dw.* FROM dw JOIN rr ON rr.qid = dw.qid AND rr.room = 'r' || dw.corpus_id % 7 WHERE r <= 3 OR m = 0)""", "TRUE"))
def haystack_rooms(s, d):
    """Dialogs by rooms, whose summaries are the beginnings of what is in them."""
    rows, asked = _haystack(s, d)
    rows = rows.withColumn("room", F.concat(F.lit("r"), F.col("corpus_id") % 7))
    return haystack.dialog_rooms(rows, rows.select("stack", "room", F.substring("document", 1, 60).alias("summary")), asked, 5)


@query(lambda: f"""WITH {D}, {V}, {Q}, {HAY}, f AS (SELECT hs.*, list_reverse(e) AS fe, qe, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_distance(e, qe), 12), position) AS n FROM hs JOIN hq USING (qid)),
 g AS (SELECT *, CASE WHEN n <= 5 THEN round(list_cosine_distance(fe, qe), 12) END AS y FROM f) SELECT qid, corpus_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY y NULLS LAST, position) AS INTEGER) AS rank FROM g""")
def haystack_two_pass(s, d):
    rows, asked = _haystack(s, d)
    return haystack.two_pass(rows.withColumn("full_embedding", F.reverse("embedding")), asked)


# --- metrics ---------------------------------------------------------------------------------------------------------

RANKED = KNN.format(cond="id <> qid") + ", j AS (SELECT k.qid, k.rank, k.label = l.label AS rel FROM k JOIN v l ON l.id = k.qid WHERE rank <= 30)"


def _ranked(s, d):
    v = vectors(s, d)
    near = search.knn(v, _queries(v), 30, others=True)
    own = v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("label").alias("__l"))
    return near.join(own, "qid").withColumn("relevant", F.col("label") == F.col("__l"))


@query(RANKED + f" SELECT qid, max(CAST(rel AND rank <= 5 AS INTEGER)) AS recall_any, CAST(count_if(rel AND rank <= 5) = count_if(rel) AS INTEGER) AS recall_all, {SIX('count_if(rel AND rank <= 5) / CAST(greatest(count_if(rel), 1) AS DOUBLE)')} AS recall FROM j GROUP BY 1")
def recall_at_k(s, d):
    return metrics.recall(_ranked(s, d), 5).withColumn("recall", r6(F.col("recall")))


@query(RANKED + f""", g AS (SELECT qid, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count_if(rel) AS n FROM j WHERE rank <= 10 GROUP BY 1)
 SELECT qid, {SIX('CASE WHEN n > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= n) ELSE 0 END')} AS ndcg FROM g""")
def ndcg_at_k(s, d):
    return metrics.ndcg(_ranked(s, d), 10).withColumn("ndcg", r6(F.col("ndcg")))


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
 t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w, 1 AS p, 0 AS q FROM p UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(lower(y), '[\\p{{L}}\\p{{N}}_]{{2,}}')), 0, 1 FROM p),
 c AS (SELECT conv_id, turn, w, sum(p) AS p, sum(q) AS q FROM t GROUP BY 1, 2, 3), z AS (SELECT conv_id, turn, sum(least(p, q)) AS c, sum(p) AS p, sum(q) AS q FROM c GROUP BY 1, 2)
 SELECT conv_id, turn, {SIX('CASE WHEN c > 0 THEN 2.0 * c / (p + q) ELSE 0 END')} AS f1 FROM z""")
def token_f1(s, d):
    c = read(s, d, "conversations")
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    pairs = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("x")).join(b, ["conv_id", "turn"])
    return metrics.token_f1(pairs, "x", "y", ["conv_id", "turn"]).withColumn("f1", r6(F.col("f1")))


@query(KNN.format(cond="id <> qid") + f""", a AS (SELECT * FROM k WHERE rank <= 20), b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY x * CASE WHEN label = 1 THEN 0.8 ELSE 1 END, id) AS rb FROM k WHERE rank <= 20),
 m AS (SELECT a.qid, a.id, a.rank AS ra, b.rb FROM a JOIN b ON a.qid = b.qid AND a.id = b.id)
 SELECT l.qid, {SIX('sum(sign(CAST(l.ra AS DOUBLE) - r.ra) * sign(CAST(l.rb AS DOUBLE) - r.rb)) / count(*)')} AS tau, count(*) AS pairs FROM m l JOIN m r ON l.qid = r.qid AND l.id < r.id GROUP BY 1""")
def kendall_tau(s, d):
    v = vectors(s, d)
    a = search.knn(v, _queries(v), 20, others=True)
    b = collection.top(a.drop("rank").withColumn("distance", F.col("distance") * F.when(F.col("label") == 1, 0.8).otherwise(1.0)), 20, [F.col("distance"), F.col("id")], ["qid"])
    return metrics.kendall_tau(a, b).withColumn("tau", r6(F.col("tau")))


# --- counts ----------------------------------------------------------------------------------------------------------


@query(f"WITH {D} SELECT coalesce(wing, 'unknown') AS wing, count(*) AS n FROM d GROUP BY 1")
def wing_counts(s, d):
    return collection.taxonomy(drawers(s, d), "wing")


@query(f"WITH {D} SELECT coalesce(room, 'unknown') AS room, count(*) AS n FROM d WHERE wing = 'en' GROUP BY 1")
def room_counts(s, d):
    return collection.taxonomy(drawers(s, d).where("wing = 'en'"), "room")


@query(f"WITH {D} SELECT coalesce(wing, 'unknown') AS wing, coalesce(room, 'unknown') AS room, count(*) AS n FROM d GROUP BY 1, 2")
def taxonomy(s, d):
    return collection.taxonomy(drawers(s, d), "wing", "room")


@query(f"WITH {D} SELECT wing, room, count(*) AS n FROM d GROUP BY GROUPING SETS ((wing), (room), ())")
def status_grouping_sets(s, d):
    return drawers(s, d).groupingSets([[F.col("wing")], [F.col("room")], []], "wing", "room").agg(F.count("*").alias("n")).select("wing", "room", "n")


@query(f"WITH {D} SELECT room AS source, count(*) AS n FROM d WHERE wing = 'en' AND contains(lower(room), 'src1') GROUP BY 1 HAVING count(*) >= 5")
def dedup_groups(s, d):
    rows = drawers(s, d).where((F.col("wing") == "en") & F.contains(F.lower("room"), F.lit("src1")))
    return rows.groupBy(F.col("room").alias("source")).agg(F.count("*").alias("n")).where("n >= 5")


@query("SELECT count(*) AS sources, CAST(sum(CASE WHEN n > 20 THEN CAST(floor(n * 4 / 10.0) AS BIGINT) ELSE 0 END) AS BIGINT) AS estimate FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def dedup_estimate(s, d):
    n = drawers(s, d).groupBy("room").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("sources"), F.sum(F.when(F.col("n") > 20, F.expr("n * 4 div 10")).otherwise(0)).alias("estimate"))


# --- temporal graph --------------------------------------------------------------------------------------------------


def _kg(s, d):
    t = triples(s, d)
    return t, entities(t)


@query(f"WITH {K} SELECT 'outgoing' AS direction, predicate, name AS other, valid_from, valid_to, valid_to IS NULL AS current FROM t JOIN n ON n.id = object WHERE subject = 'u3'")
def kg_entity_outgoing(s, d):
    return kg.query_entity(*_kg(s, d), "u3", direction="outgoing")


@query(f"""WITH {K} SELECT 'outgoing' AS direction, predicate, name AS other, valid_from, valid_to, valid_to IS NULL AS current FROM t JOIN n ON n.id = object WHERE subject = 'k7'
 UNION ALL SELECT 'incoming', predicate, name, valid_from, valid_to, valid_to IS NULL FROM t JOIN n ON n.id = subject WHERE object = 'k7'""")
def kg_entity_both(s, d):
    return kg.query_entity(*_kg(s, d), "k7")


@query(f"WITH {K} SELECT subject, predicate, object, valid_from, valid_to, a.name AS subject_name, b.name AS object_name FROM t JOIN n a ON a.id = subject JOIN n b ON b.id = object WHERE predicate = 'click' AND object = 'k5'")
def kg_relationship(s, d):
    t, n = _kg(s, d)
    return kg.query_relationship(t, n, predicate="click", obj="k5").select("subject", "predicate", "object", "valid_from", "valid_to", "subject_name", "object_name")


@query(f"WITH {K}, m AS (SELECT max(valid_from) AS hi FROM t) SELECT subject, predicate, object, valid_from, valid_to FROM t WHERE (valid_from IS NULL OR valid_from <= '2024-01-15') AND (valid_to IS NULL OR valid_to >= '2024-01-15')")
def kg_as_of(s, d):
    return triples(s, d).where(kg.valid_at("2024-01-15"))


@query(f"WITH {K} SELECT subject, predicate, object, valid_from, valid_to, a.name AS subject_name, b.name AS object_name FROM t JOIN n a ON a.id = subject JOIN n b ON b.id = object WHERE subject = 'u5' OR object = 'u5' ORDER BY valid_from ASC NULLS LAST, subject, predicate, object LIMIT 100")
def kg_timeline(s, d):
    return kg.timeline(*_kg(s, d), "u5").select("subject", "predicate", "object", "valid_from", "valid_to", "subject_name", "object_name")


@query(f"WITH {K} SELECT (SELECT count(*) FROM n) AS entities, count(*) AS triples, CAST(count_if(valid_to IS NULL) AS BIGINT) AS current, CAST(count_if(valid_to IS NOT NULL) AS BIGINT) AS expired, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT predicate AS p FROM t)) AS predicates FROM t")
def kg_stats(s, d):
    return kg.stats(*_kg(s, d))


@query(f"WITH {K} SELECT subject, predicate, object, valid_from, CASE WHEN subject = 'u9' AND valid_to IS NULL THEN '2030-01-01' ELSE valid_to END AS valid_to FROM t")
def kg_invalidate(s, d):
    return kg.invalidate(triples(s, d), F.col("subject") == "u9", "2030-01-01")


@query(f"""WITH {K}, w AS (SELECT subject, 'view' AS predicate, object, min(valid_from) AS valid_from, CAST(NULL AS VARCHAR) AS valid_to FROM t GROUP BY 1, 2, 3)
 SELECT * FROM t UNION ALL SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.valid_to IS NULL AND t.subject = w.subject AND t.predicate = w.predicate AND t.object = w.object)""")
def kg_add_dedup(s, d):
    t = triples(s, d)
    return kg.add_triples(t, t.select("subject", F.lit("view").alias("predicate"), "object", "valid_from", F.lit(None).cast("string").alias("valid_to")))


@query(f"WITH {K} SELECT CASE WHEN subject = 'u1' THEN 'u2' ELSE subject END AS subject, predicate, CASE WHEN object = 'u1' THEN 'u2' ELSE object END AS object, valid_from, valid_to FROM t")
def kg_rename(s, d):
    return kg.rename(triples(s, d), "u1", "u2")


TRI = "list_distinct([substring('  ' || lower({x}) || ' ', CAST(i AS INTEGER), 3) FOR i IN range(1, len({x}) + 2)])"


@query(f"""WITH g AS (SELECT c_custkey AS id, c_name AS name, {TRI.format(x="c_name")} AS a, {TRI.format(x="'Customer#000000012'")} AS b FROM customer),
 z AS (SELECT id, name, len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) AS sim FROM g) SELECT id, name, {SIX('sim')} AS similarity FROM z WHERE sim >= 0.3 ORDER BY sim DESC, id LIMIT 10""")
def kg_similar_entities(s, d):
    c = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return kg.similar_names(c, "Customer#000000012").withColumn("similarity", r6(F.col("similarity")))


PLAIN = "regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')"


def _answer_sql() -> str:
    words = lambda x: f"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(replace({PLAIN.format(x=x)}, ',', ''), '\\b(a|an|the|and)\\b', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r\\x1c-\\x1f]+', ' ', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g')), ' '), lambda w: w <> '')".replace("{{", "{")
    return f"""WITH p AS (SELECT a.conv_id, a.turn, {words('a.text')} AS x, {words('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
 c AS (SELECT *, list_sum([least(len(list_filter(x, lambda z: z = w)), len(list_filter(y, lambda z: z = w))) FOR w IN list_distinct(x)]) AS c FROM p)
 SELECT conv_id, turn, {SIX('CASE WHEN len(x) = 0 OR len(y) = 0 THEN CAST(len(x) = len(y) AS DOUBLE) WHEN c = 0 THEN 0 ELSE 2.0::DOUBLE * c / (len(x) + len(y)) END')} AS f1 FROM c"""


@query(lambda: _answer_sql())
def answer_f1(s, d):
    """F1 of normalised answers: what a user says and what is answered, without letters beyond ASCII, whose words engines bound differently."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "")
    c = read(s, d, "conversations")
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), plain("text").alias("y"))
    pairs = c.where("role = 'user'").select("conv_id", "turn", plain("text").alias("x")).join(b, ["conv_id", "turn"])
    return metrics.answer_f1(pairs, "x", "y", ["conv_id", "turn"]).withColumn("f1", r6(F.col("f1")))


NAMES = "nm AS (SELECT DISTINCT substring(c_name, 10) AS name FROM customer)"


@query(f"WITH {NAMES}, m AS (SELECT DISTINCT substring(c_name, 10) AS mention FROM customer WHERE c_custkey % 50 = 0) SELECT mention, name AS candidate, CAST(levenshtein(lower(mention), lower(name)) AS INTEGER) AS distance FROM nm, m WHERE levenshtein(lower(mention), lower(name)) BETWEEN 1 AND 2 AND name NOT IN (SELECT mention FROM m)")
def edit_distance_confusion(s, d):
    c = read(s, d, "customer").withColumn("name", F.expr("substring(c_name, 10)"))
    return kg.confusable(c.where("c_custkey % 50 = 0").select("name"), c.select("name"))


#: What some orders' notes say of customers and nations, by the order's key.
SAYS = ["So Cust{a} is Nation{b}'s owner.", "Nation{b}'s owner is Cust{a}, they say", "Cust{a} is Nation{b}'s guest now", "nothing at all", "a word of Nation{b} alone"]


def _says_sql(a: str, b: str) -> str:
    return "CASE o_orderkey % 5 " + " ".join("WHEN {} THEN '{}'".format(k, t.replace("'", "''").replace("{a}", f"' || {a} || '").replace("{b}", f"' || {b} || '")) for k, t in enumerate(SAYS)) + " END"


@query(f"""WITH x AS (SELECT o_orderkey AS id, o_custkey AS a, o_orderkey % 25 AS b, CASE o_orderkey % 5 WHEN 2 THEN 'guest' ELSE 'owner' END AS p, o_orderkey % 5 AS k FROM orders), said AS (SELECT DISTINCT id, a, b, p FROM x WHERE k <= 2),
 f AS (SELECT c_custkey AS a, c_nationkey AS b, CASE WHEN c_custkey % 2 = 0 THEN 'owner' ELSE 'guest' END AS known, CASE WHEN c_custkey % 3 = 0 THEN '2024-01-01' END AS valid_to FROM customer),
 m AS (SELECT id, said.a, said.b, p, known, valid_to FROM said JOIN f ON f.a = said.a AND f.b = said.b), rg AS (SELECT 'Nation' || n_nationkey AS name FROM nation),
 mn AS (SELECT DISTINCT id, 'Nation' || b AS name FROM x WHERE k <> 3),
 al AS (SELECT id, mn.name AS mention, rg.name AS candidate, levenshtein(lower(mn.name), lower(rg.name)) AS e FROM mn JOIN rg ON mn.name <> rg.name)
 SELECT id, 'relationship_mismatch' AS kind, 'Cust' || a || ' ' || p || ' Nation' || b || ': known is ' || known AS detail FROM m WHERE valid_to IS NULL AND known <> p
 UNION SELECT id, 'stale_fact', 'Cust' || a || ' ' || p || ' Nation' || b || ': closed on ' || valid_to FROM m WHERE valid_to < '2024-06-01' AND known = p
 UNION SELECT id, 'similar_name', mention || ': did you mean ' || candidate || '? (edit distance ' || e || ')' FROM al WHERE e <= 2""")
def fact_report(s, d):
    o = read(s, d, "orders")
    said = F.element_at(F.array(*[F.replace(F.replace(F.lit(t), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")) for t in SAYS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    texts = o.withColumn("a", F.col("o_custkey").cast("string")).withColumn("b", (F.col("o_orderkey") % 25).cast("string")).select(F.col("o_orderkey").alias("id"), said.alias("text"))
    facts = read(s, d, "customer").select(
        F.concat(F.lit("cust"), "c_custkey").alias("subject"), F.when(F.col("c_custkey") % 2 == 0, "owner").otherwise("guest").alias("predicate"), F.concat(F.lit("nation"), "c_nationkey").alias("object"), F.when(F.col("c_custkey") % 3 == 0, "2024-01-01").alias("valid_to")
    )
    return kg.check_text(texts, facts, read(s, d, "nation").select(F.concat(F.lit("Nation"), "n_nationkey").alias("name")), "2024-06-01")


CLAIMS = "c AS (SELECT DISTINCT subject, object, 'purchase' AS predicate FROM t)"


@query(f"WITH {K}, {CLAIMS} SELECT DISTINCT c.subject, c.object, c.predicate, t.predicate AS known FROM c JOIN t ON t.subject = c.subject AND t.object = c.object AND t.predicate <> c.predicate WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.subject = c.subject AND x.object = c.object AND x.predicate = c.predicate)")
def fact_mismatch(s, d):
    t = triples(s, d)
    claims = t.select("subject", "object", F.lit("purchase").alias("predicate")).distinct()
    return kg.mismatches(claims, t).select("subject", "object", "predicate", "known")


# --- rooms -----------------------------------------------------------------------------------------------------------

G = f"""{D}, g AS (SELECT room, list_sort(list_distinct(list(wing))) AS wings, list_sort(list_distinct(list(hall))) AS halls, count(*) AS n, list_sort(list_distinct(list(occurred_at))) AS ds FROM d WHERE room IS NOT NULL AND room NOT IN ('', 'general') AND wing IS NOT NULL AND wing <> '' GROUP BY 1)"""


@query(f"WITH {G} SELECT room, array_to_string(wings, ',') AS wings, array_to_string(halls, ',') AS halls, n, array_to_string(ds[-5:], ',') AS dates FROM g")
def room_graph_nodes(s, d):
    join = lambda c: F.array_join(c, ",").alias(c)
    return graph.nodes(drawers(s, d)).select("room", join("wings"), join("halls"), "n", join("dates"))


@query(f"WITH {G}, e AS (SELECT room, n, halls, unnest(wings) AS wing_a, wings FROM g), f AS (SELECT room, n, halls, wing_a, unnest(wings) AS wing_b FROM e) SELECT room, wing_a, wing_b, unnest(halls) AS hall, n FROM f WHERE wing_a < wing_b")
def room_graph_edges(s, d):
    return graph.edges(graph.nodes(drawers(s, d)))


@query(f"WITH {G} SELECT room, n FROM g WHERE len(wings) >= 2 AND list_contains(wings, 'en') AND list_contains(wings, 'fr') ORDER BY n DESC, room LIMIT 50")
def find_tunnels(s, d):
    return graph.tunnels(graph.nodes(drawers(s, d)), "en", "fr").select("room", "n")


@query(f"WITH {G} SELECT count(*) AS rooms, CAST(count_if(len(wings) >= 2) AS BIGINT) AS tunnel_rooms, CAST(sum(len(wings) * (len(wings) - 1) / 2 * len(halls)) AS BIGINT) AS edges FROM g")
def graph_stats(s, d):
    return graph.stats(graph.nodes(drawers(s, d)))


NARROW = "r AS (SELECT DISTINCT 'r' || CAST(id % 40 AS VARCHAR) AS room, 'w' || CAST((id % 40) // 4 + id % 2 AS VARCHAR) AS wing, 1 AS z FROM d)"


WALK = f"""{NARROW}, w AS (SELECT room, list_sort(list(wing)) AS ws FROM r GROUP BY 1),
 f1 AS (SELECT b.room, w2.ws, 'r3' AS p, list_filter(w2.ws, lambda y: list_contains(w1.ws, y)) AS via FROM (SELECT DISTINCT b.room FROM r a JOIN r b USING (wing) WHERE a.room = 'r3' AND b.room <> 'r3') b JOIN w w2 ON w2.room = b.room JOIN w w1 ON w1.room = 'r3'),
 c2 AS (SELECT DISTINCT b.room, f1.p || chr(0) || f1.room AS p, f1.ws AS pw FROM f1 JOIN r a ON a.room = f1.room JOIN r b ON b.wing = a.wing WHERE b.room <> 'r3' AND b.room NOT IN (SELECT room FROM f1)),
 f2 AS (SELECT room, min(p) AS p, arg_min(pw, p) AS pw FROM c2 GROUP BY 1)"""


@query(f"""WITH {D}, {WALK} SELECT 'r3' AS room, 0 AS hop, '' AS connected_via UNION ALL SELECT room, 1, array_to_string(via, ',') FROM f1 UNION ALL SELECT f2.room, 2, array_to_string(list_filter(w.ws, lambda y: list_contains(f2.pw, y)), ',') FROM f2 JOIN w ON w.room = f2.room""")
def traverse_bfs(s, d):
    rows = drawers(s, d).select(F.expr("concat('r', id % 40)").alias("room"), F.expr("concat('w', (id % 40) div 4 + id % 2)").alias("wing"), F.lit("h").alias("hall"), "occurred_at")
    return graph.traverse(graph.nodes(rows), "r3", 2).select("room", "hop", F.array_join("connected_via", ",").alias("connected_via"))


@query(f"WITH {G}, w AS (SELECT unnest(wings) AS wing FROM g) SELECT wing, count(*) AS rooms FROM w GROUP BY 1")
def rooms_per_wing(s, d):
    return graph.rooms_per_wing(graph.nodes(drawers(s, d)))


@query(f"WITH {G} SELECT room, array_to_string(wings, ',') AS wings, n FROM g WHERE len(wings) >= 2 ORDER BY len(wings) DESC, room LIMIT 10")
def top_tunnels(s, d):
    return graph.top_tunnels(graph.nodes(drawers(s, d))).select("room", F.array_join("wings", ",").alias("wings"), "n")


LINKS = "l AS (SELECT id, wing AS wing_a, room AS room_a, CASE WHEN id % 2 = 0 THEN 'en' ELSE 'fr' END AS wing_b, 'src' || CAST(id % 7 AS VARCHAR) AS room_b, id AS drawer_a, id + 1 AS drawer_b FROM d)"


def _links(s, d):
    return drawers(s, d).selectExpr("id", "wing as wing_a", "room as room_a", "case when id % 2 = 0 then 'en' else 'fr' end as wing_b", "concat('src', id % 7) as room_b", "id as drawer_a", "id + 1 as drawer_b")


@query(f"WITH {D}, {LINKS} SELECT id, substring(sha256(least(wing_a || '/' || room_a, wing_b || '/' || room_b) || '↔' || greatest(wing_a || '/' || room_a, wing_b || '/' || room_b)), 1, 16) AS tunnel_id FROM l")
def tunnel_symmetric_ids(s, d):
    return graph.with_tunnel_ids(_links(s, d)).select("id", "tunnel_id")


@query(f"""WITH {D}, {LINKS}, x AS (SELECT 'outgoing' AS direction, wing_b AS wing, room_b AS room, drawer_b AS drawer FROM l WHERE wing_a = 'en' AND room_a = 'src0' UNION ALL SELECT 'incoming', wing_a, room_a, drawer_a FROM l WHERE wing_b = 'en' AND room_b = 'src0')
 SELECT direction, x.wing, x.room, drawer, CASE WHEN len(document) > 300 THEN substring(document, 1, 300) || '...' ELSE document END AS preview FROM x LEFT JOIN d ON d.id = drawer""")
def follow_tunnels(s, d):
    return graph.follow(_links(s, d), "en", "src0", drawers(s, d)).select("direction", "wing", "room", "drawer", "preview")


TUNNEL = "substring(sha256(least(wing_a || '/' || room_a, wing_b || '/' || room_b) || '↔' || greatest(wing_a || '/' || room_a, wing_b || '/' || room_b)), 1, 16)"


@query(f"WITH {D}, {LINKS}, m AS (SELECT {TUNNEL} AS tunnel_id, id % 366 AS c, 'l' || id AS label FROM l WHERE wing_a IS NOT NULL) SELECT tunnel_id, min(c) AS created_at, arg_max(label, (c, label)) AS label, CASE WHEN count(*) > 1 THEN max(c) END AS updated_at FROM m GROUP BY 1")
def tunnels_merged(s, d):
    links = _links(s, d).where("wing_a is not null").selectExpr("*", "id % 366 as created_at", "concat('l', id) as label")
    return graph.merge_tunnels(links.where("id % 2 = 0"), links.where("id % 2 = 1"))


@query(f"WITH {D}, {LINKS} SELECT id, {TUNNEL} AS tunnel_id FROM l WHERE (wing_a = 'es' OR wing_b = 'es') AND {TUNNEL} NOT IN (SELECT {TUNNEL} FROM l WHERE room_b = 'src3' AND wing_a IS NOT NULL)")
def tunnels_kept(s, d):
    links = graph.list_tunnels(_links(s, d), "es")
    gone = graph.with_tunnel_ids(_links(s, d).where("room_b = 'src3' and wing_a is not null"))
    return graph.delete_tunnels(links, gone).select("id", "tunnel_id")


# --- recent, importance, context -------------------------------------------------------------------------------------


@query(f"WITH {D} SELECT id, wing, room, occurred_at, CASE WHEN len(document) > 200 THEN substring(document, 1, 200) || '...' ELSE document END AS preview FROM d ORDER BY occurred_at DESC NULLS LAST, id LIMIT 25")
def recent_global(s, d):
    return context.recent(drawers(s, d), 25)


@query(f"WITH {D} SELECT id, occurred_at FROM d WHERE wing = 'de' AND occurred_at >= '2024-02-01' AND occurred_at <= '2024-02-29' ORDER BY occurred_at DESC, id LIMIT 50")
def timeline_range(s, d):
    rows = collection.get(drawers(s, d), where={"wing": "de", "occurred_at": {"$gte": "2024-02-01", "$lte": "2024-02-29"}})
    return collection.newest(rows, 50, "occurred_at").select("id", "occurred_at")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant') WHERE r <= 2")
def diary_last_n(s, d):
    rows = read(s, d, "conversations").where("role = 'assistant'")
    return collection.top(rows, 2, [F.col("turn").desc()], ["conv_id"]).select("conv_id", "turn", "text")


@query(f"""WITH {D}, b AS (SELECT id, room, n_chars, CASE WHEN len(document) > 200 THEN substring(document, 1, 200) || '...' ELSE document END AS line FROM d ORDER BY n_chars DESC, id LIMIT 15),
 u AS (SELECT *, CAST(sum(len(line)) OVER (ORDER BY n_chars DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM b) SELECT id, room, line, used FROM u WHERE used <= 3000""")
def importance_top(s, d):
    return context.wake_up(drawers(s, d), "n_chars", 15, 3000).select("id", "room", "line", "used")


@query(f"""WITH {K}, o AS (SELECT *, CASE WHEN subject = 'u4' THEN 0 ELSE 1 END AS o FROM t WHERE subject IN ('u4', 'u6')), r AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY o, valid_from) AS k FROM o)
 SELECT subject, predicate, object, valid_from FROM r WHERE k = 1 AND valid_to IS NULL ORDER BY o, valid_from, subject, predicate, object LIMIT 20""")
def context_facts(s, d):
    return context.facts(*_kg(s, d), ["u4", "u6"]).select("subject", "predicate", "object", "valid_from")


ASKED_OF = "concat('Tell me what U', qid % 20, ' and Anna did with k', qid % 90, ' since Tuesday. Then Bob')"
QC = Q.replace("coalesce(b.text, '') AS question", "'Tell me what U' || vec_id % 20 || ' and Anna did with k' || vec_id % 90 || ' since Tuesday. Then Bob' AS question")


def _context_sql(as_of: str | None) -> str:
    valid = "t.valid_to IS NULL" if as_of is None else f"t.valid_from <= '{as_of}' AND (t.valid_to IS NULL OR t.valid_to >= '{as_of}')"
    wing = "wing = 'en'"
    shown = lambda x: f"substring(string_split(CASE WHEN len({x}) > 300 THEN substring({x}, 1, 300) || '...' ELSE {x} END, chr(10))[1], 1, 120)"
    return _end_to_end(wing, 15, 9.0, QC).replace("FROM v, q)", "FROM v JOIN d USING (id), q WHERE wing = 'en')") + f""", {K.replace('t AS (', 'ev AS (', 1).replace('FROM t', 'FROM ev')},
 tr AS (SELECT * FROM ev t WHERE {valid}), nn AS (SELECT qid, 'U' || qid % 20 AS name, 0 AS kind, 0 AS i FROM q UNION ALL SELECT qid, 'K' || qid % 90, 0, 0 FROM q UNION ALL SELECT qid, unnest(['Anna', 'Tuesday', 'Bob', 'Tell']), unnest([1, 1, 1, 2]), unnest([0, 1, 2, 0]) FROM q),
 nk AS (SELECT nn.* FROM nn WHERE (kind = 0 AND name IN (SELECT name FROM n)) OR (kind > 0 AND lower(name) <> 'tell')), np AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kind, i, name) - 1 AS place FROM nk),
 ids AS (SELECT DISTINCT qid, place, e FROM (SELECT qid, place, n.id AS e FROM np JOIN n USING (name) UNION ALL SELECT qid, place, replace(replace(lower(name), ' ', '_'), chr(39), '') FROM np)),
 mt AS (SELECT qid, place, 0 AS way, tr.* FROM ids JOIN tr ON e = subject UNION ALL SELECT qid, place, 1, tr.* FROM ids JOIN tr ON e = object),
 m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, subject, predicate, object ORDER BY place, way, valid_from, subject) AS k1 FROM mt) WHERE k1 = 1),
 m2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, way, valid_from NULLS LAST, subject, predicate, object) AS k2 FROM m1) WHERE k2 <= 20),
 fa AS (SELECT qid, count(*) AS n_facts, string_agg('- ' || upper(subject) || ' ' || replace(predicate, '_', ' ') || ' ' || upper(object) || ' (since ' || valid_from || ')', chr(10) ORDER BY k2) AS facts FROM m2 GROUP BY 1),
 re AS (SELECT qid, count(*) AS n_relevant, string_agg('- [' || wing || '/' || coalesce(room, 'unknown') || '] "' || {shown('document')} || '" (' || printf('%.2f', greatest(0, 1 - eff)) || ' similarity)', chr(10) ORDER BY n) AS relevant FROM o WHERE n <= 5 GROUP BY 1),
 rc AS (SELECT count(*) AS n_recent, string_agg('- [' || wing || '/' || coalesce(room, 'unknown') || '] ' || {shown('document')}, chr(10) ORDER BY occurred_at DESC, id) AS recent FROM (SELECT * FROM dr WHERE {wing} ORDER BY occurred_at DESC, id LIMIT 5)),
 li AS (SELECT qid, string_agg(name, ',' ORDER BY place) AS entities FROM np GROUP BY 1)
 SELECT q.qid, coalesce(entities, '') AS entities, coalesce(n_facts, 0) AS n_facts, coalesce(n_recent, 0) AS n_recent, coalesce(n_relevant, 0) AS n_relevant,
 concat_ws(chr(10) || chr(10), '## Known facts' || chr(10) || facts, '## Recent activity (last ' || n_recent || ')' || chr(10) || recent, '## Relevant memories' || chr(10) || relevant) AS formatted FROM q LEFT JOIN li USING (qid) LEFT JOIN fa USING (qid) LEFT JOIN re USING (qid), rc"""


def _context(s, d, as_of=None):
    rows = drawers(s, d).join(vectors(s, d), "id")
    asked = questions(s, d).withColumn("question", F.expr(ASKED_OF))
    t, n = _kg(s, d)
    return context.build_context(asked, t, n, rows, _index(s, d).join(drawers(s, d).select("id", "wing"), "id"), wing="en", as_of=as_of)


@query(lambda: _context_sql(None))
def context_full(s, d):
    return _context(s, d)


@query(lambda: _context_sql("2024-01-15"))
def context_as_of(s, d):
    return _context(s, d, "2024-01-15")


# --- transcripts and segmentation ------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations), b AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM a)
 SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_turns FROM b GROUP BY conv_id, run""")
def merge_turns(s, d):
    return transcript.merge_turns(read(s, d, "conversations"))


EX = """e AS (SELECT *, count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations WHERE role IN ('user', 'assistant')),
 x AS (SELECT conv_id, CAST(exchange AS BIGINT) AS exchange, max(CASE WHEN role = 'user' THEN text END) AS question, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn), '') AS answer FROM e WHERE exchange > 0 GROUP BY 1, 2)"""


@query(f"WITH {EX} SELECT * FROM x")
def exchange_pairs(s, d):
    return transcript.exchanges(read(s, d, "conversations"))


@query(f"""WITH {EX}, t AS (SELECT conv_id, exchange, '> ' || question || chr(10) || answer AS t FROM x), p AS (SELECT conv_id, exchange, t, unnest(range(0, greatest(CAST(ceil(len(t) / 200.0) AS BIGINT), 1))) AS part FROM t)
 SELECT conv_id, exchange, CAST(part AS INTEGER) AS part, substring(t, part * 200 + 1, 200) AS chunk FROM p WHERE len(substring(t, part * 200 + 1, 200)) > 30""")
def exchange_chunks(s, d):
    return transcript.exchange_chunks(transcript.exchanges(read(s, d, "conversations")), size=200)


BLOCKS = r"""p AS (SELECT id, string_split(document, chr(10)) AS l, list_filter([regexp_replace(b, '^\s+|\s+$', '', 'g') FOR b IN string_split_regex(document, '\n\s*\n')], lambda b: len(b) > 0) AS bs FROM d),
 q AS (SELECT id, CASE WHEN len(bs) <= 1 AND len(l) > 21 THEN [regexp_replace(array_to_string(l[i * 25 + 1 : i * 25 + 25], chr(10)), '^\s+|\s+$', '', 'g') FOR i IN range(0, (len(l) - 1) // 25 + 1)] ELSE bs END AS cs FROM p)"""


@query(f"WITH {D}, {BLOCKS}, r AS (SELECT id, unnest(cs) AS chunk, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS position FROM q) SELECT id, position, chunk FROM r WHERE len(chunk) > 30")
def paragraph_chunks(s, d):
    return transcript.paragraphs(drawers(s, d)).select("id", "position", "chunk")


@query(rf"""WITH p AS (SELECT conv_id, turn, 'Checking pipeline... now' || chr(10) || text || chr(10) || 'Ran 2 Stop hooks' || chr(10) || 'end [12 tokens] (ctrl+o to expand)' AS t FROM conversations),
 l AS (SELECT conv_id, turn, list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^(> )?(Checking pipeline\.\.\.|Ran [0-9]+ (Stop|PreCompact) hook)')) AS l FROM p),
 j AS (SELECT conv_id, turn, regexp_replace(array_to_string(l, chr(10)), '\s*\[[0-9]+\s+tokens?\]\s*\(ctrl\+o to expand\)', '', 'g') AS t FROM l)
 SELECT conv_id, turn, regexp_replace(regexp_replace(t, '\n{{{{4,}}}}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS out FROM j""".replace("{{", "{").replace("}}", "}"))
def strip_noise(s, d):
    body = F.concat(F.lit("Checking pipeline... now\n"), "text", F.lit("\nRan 2 Stop hooks\nend [12 tokens] (ctrl+o to expand)"))
    return read(s, d, "conversations").select("conv_id", "turn", text.strip_noise(body).alias("out"))


def _chunks_sql() -> str:
    """Each step cuts one window off; the last line ends of its second half are looked for from its end."""
    size, half = transcript.CHUNK, transcript.CHUNK // 2

    def end(at: str) -> str:
        part = f"reverse(substring(t, {at} + {half + 2}, {size - half - 1}))"
        place = lambda mark, n: f"CASE WHEN strpos({part}, {mark}) > 0 THEN {at} + {half} + 1 + len({part}) - strpos({part}, {mark}) - {n} END"
        return f"CAST(CASE WHEN len(t) - {at} <= {size} THEN len(t) ELSE coalesce({place('chr(10) || chr(10)', 1)}, {place('chr(10)', 0)}, {at} + {size}) END AS BIGINT)"

    return f"""WITH RECURSIVE {D}, p AS (SELECT id, {TRIM.format(x='document')} AS t FROM d), w AS (SELECT id, t, 0 AS n, CAST(0 AS BIGINT) AS pos, {end('0')} AS stop FROM p
 UNION ALL SELECT id, t, n + 1, pos, {end('pos')} FROM (SELECT id, t, n, stop - {transcript.OVERLAP} AS pos FROM w WHERE stop < len(t))),
 c AS (SELECT id, n, {TRIM.format(x='substring(t, pos + 1, stop - pos)')} AS chunk FROM w) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INTEGER) AS chunk_index, chunk FROM c WHERE len(chunk) >= {transcript.LEAST}"""


@query(lambda: _chunks_sql())
def fixed_chunks(s, d):
    return transcript.fixed_chunks(drawers(s, d))


@query(lambda: _chunks_sql())
def records_through_source(s, d):
    """All texts written as JSON lines and read back as records through the data source."""
    folder = f"{shared_folder(s)}/records-{uuid.uuid4().hex}"
    drawers(s, d).select(F.to_json(F.struct(F.col("id").cast("string").alias("source_file"), "document")).alias("value")).write.text(folder)
    s.dataSource.register(records.RecordSource)
    rows = s.read.format("memlake_records").option("path", folder).option("adapter", "lines").load()
    return rows.select(F.col("source_file").cast("long").alias("id"), "chunk_index", F.col("document").alias("chunk"))


# --- classification --------------------------------------------------------------------------------------------------

HALLS = {"emotions": ["that", "hate", "ande"], "memory": ["thnt", "with"], "technical": ["ertion", "die", "der"]}


def _class_sql(x: str, sets: dict, otherwise: str) -> str:
    sc = {k: "(" + " + ".join(f"CAST(contains(lower({x}), '{w}') AS INTEGER)" for w in v) + ")" for k, v in sets.items()}
    best = "greatest(" + ", ".join(sc.values()) + ")"
    return f"CASE WHEN {best} = 0 THEN '{otherwise}' " + " ".join(f"WHEN {v} = {best} THEN '{k}'" for k, v in sc.items()) + " END"


@query(f"WITH {D} SELECT id, {_class_sql('document', classify.HALLS, 'general')} AS hall, {_class_sql('document', HALLS, 'general')} AS own FROM d")
def hall_detect(s, d):
    return drawers(s, d).select("id", classify.keyword_class(F.col("document"), classify.HALLS, "general").alias("hall"), classify.keyword_class(F.col("document"), HALLS, "general").alias("own"))


@query(f"SELECT conv_id, turn, {_class_sql('text', classify.TOPICS, 'general')} AS topic FROM conversations")
def topic_detect(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", classify.keyword_class(F.col("text"), classify.TOPICS, "general").alias("topic"))


def _marker_sql(x: str) -> str:
    return ", ".join("CAST(" + " + ".join("len(regexp_extract_all(lower({}), '{}'))".format(x, p.replace("'", "''")) for p in v) + f" AS INTEGER) AS {k}_score" for k, v in classify.MARKERS.items())


@query(lambda: f"""WITH p AS (SELECT conv_id, turn, {_before('turn', 'text', TOLD)} AS text FROM conversations), m AS (SELECT conv_id, turn, text, {_marker_sql('text')} FROM p),
 b AS (SELECT *, greatest(decision_score, preference_score, milestone_score, problem_score, emotional_score) AS best, CASE WHEN len(text) > 500 THEN 2 WHEN len(text) > 200 THEN 1 ELSE 0 END AS bonus FROM m)
 SELECT conv_id, turn, decision_score, preference_score, milestone_score, problem_score, emotional_score, CASE WHEN best > 0 THEN least(1.0, (best + bonus) / 5.0) ELSE 0.0 END AS confidence,
 CASE WHEN best > 0 AND least(1.0, (best + bonus) / 5.0) >= 0.3 THEN CASE WHEN decision_score = best THEN 'decision' WHEN preference_score = best THEN 'preference' WHEN milestone_score = best THEN 'milestone' WHEN problem_score = best THEN 'problem' ELSE 'emotional' END END AS memory_type FROM b""")
def memory_type_scores(s, d):
    return classify.memory_types(_told(s, d)).drop("document", "id")


#: Put before some turns: paragraphs, a dialogue, code.
TOLD = [
    "We decided to use the new store because it is faster.\n\nThe bug crashed the server, an error again, but we fixed it and it works.\n\nA stuck queue was the problem, it is broken\n\n",
    "Human: why is it broken, an error again\nAssistant: the problem is the cache and the issue is old\n> I love how you figured it out, so happy and proud\n",
    "```\nimport os\nwe decided to\n```\nI prefer tabs, always use them please\n| a | b | because because because\n$ git push because\n\n",
    "",
    "",
]


def _memories_sql() -> str:
    """Segments and prose by lines, where the operator uses expressions over whole texts."""
    words = lambda known: f"len(list_intersect(list_distinct(regexp_extract_all(lower(p), '\\w+')), {_list(known)}))"
    best = "greatest(decision_score, preference_score, milestone_score, problem_score, emotional_score)"
    fixed = " OR ".join(f"regexp_matches(lower(p), '{x}')" for x in memories.RESOLVED)
    code = "^(" + "|".join(memories.CODE) + ")"
    return f"""p AS (SELECT conv_id, turn, {_before('turn', 'text', TOLD)} AS t FROM conversations),
 l AS (SELECT conv_id, turn, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM p), f AS (SELECT *, CAST(regexp_matches(line, '^{memories.TURN}') AS INT) AS y FROM l),
 c AS (SELECT *, sum(y) OVER (PARTITION BY conv_id, turn) AS turns, sum(CASE WHEN i > 1 THEN y ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM f),
 bl AS (SELECT conv_id, turn, t, list_filter([{TRIM.format(x='z')} FOR z IN string_split(t, chr(10) || chr(10))], lambda b: b <> '') AS bs FROM p),
 sg AS (SELECT conv_id, turn, g AS s, string_agg(line, chr(10) ORDER BY i) AS seg FROM c WHERE turns >= {memories.TURNS} GROUP BY 1, 2, 3 UNION ALL
  SELECT conv_id, turn, s, seg FROM (SELECT conv_id, turn, generate_subscripts(bs, 1) AS s, unnest(bs) AS seg, len(bs) AS k FROM bl) JOIN (SELECT DISTINCT conv_id, turn, turns, n FROM c) USING (conv_id, turn) WHERE turns < {memories.TURNS} AND NOT (k <= 1 AND n > {memories.LONG}) UNION ALL
  SELECT conv_id, turn, s, {TRIM.format(x='seg')} FROM (SELECT conv_id, turn, (i - 1) // {memories.GROUP} AS s, string_agg(line, chr(10) ORDER BY i) AS seg FROM c JOIN bl USING (conv_id, turn) WHERE turns < {memories.TURNS} AND len(bs) <= 1 AND n > {memories.LONG} GROUP BY 1, 2, 3)),
 sl AS (SELECT *, unnest(string_split(seg, chr(10))) AS line, generate_subscripts(string_split(seg, chr(10)), 1) AS i FROM sg WHERE len({TRIM.format(x='seg')}) >= {memories.SHORTEST}), st AS (SELECT *, {TRIM.format(x='line')} AS x, CAST(starts_with({TRIM.format(x='line')}, '```') AS INT) AS fence FROM sl),
 sf AS (SELECT *, sum(fence) OVER (PARTITION BY conv_id, turn, s ORDER BY i) AS fences FROM st),
 sk AS (SELECT *, fence = 0 AND fences % 2 = 0 AND (x = '' OR NOT (regexp_matches(x, '{code}') OR (len(x) > 10 AND len(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / len(x) < 0.4))) AS keep FROM sf),
 pr AS (SELECT conv_id, turn, s, seg, coalesce(nullif({TRIM.format(x="coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')")}, ''), seg) AS p FROM sk GROUP BY 1, 2, 3, 4),
 sc AS (SELECT *, {_marker_sql('p')} FROM pr), b AS (SELECT *, {best} AS best, CASE WHEN len(seg) > 500 THEN 2 WHEN len(seg) > 200 THEN 1 ELSE 0 END AS bonus, {words(memories.POSITIVE)} > {words(memories.NEGATIVE)} AS glad, ({fixed}) AS done FROM sc),
 k AS (SELECT *, least(1.0, (best + bonus) / 5.0) AS confidence, CASE WHEN decision_score = best THEN 'decision' WHEN preference_score = best THEN 'preference' WHEN milestone_score = best THEN 'milestone' WHEN problem_score = best THEN 'problem' ELSE 'emotional' END AS kind FROM b WHERE best > 0)
 SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY s) - 1 AS INTEGER) AS chunk_index, {TRIM.format(x='seg')} AS content, confidence,
 CASE WHEN kind = 'problem' AND done THEN CASE WHEN emotional_score > 0 AND glad THEN 'emotional' ELSE 'milestone' END WHEN kind = 'problem' AND glad AND milestone_score > 0 THEN 'milestone' WHEN kind = 'problem' AND glad AND emotional_score > 0 THEN 'emotional' ELSE kind END AS memory_type FROM k WHERE confidence >= 0.3"""


def _told(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("id"), _put_before("turn", "text", TOLD).alias("document"))


@query(lambda: "WITH " + _memories_sql())
def memory_extract(s, d):
    found = memories.extract(_told(s, d))
    key = F.split("id", "/")
    return found.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "chunk_index", "content", "memory_type", "confidence")


def _pref_sql(x: str) -> str:
    alls = ", ".join("regexp_extract_all(lower({}), '{}', 1)".format(x, p.replace("'", "''")) for p in classify.PREFERENCES)
    return rf"[regexp_replace(regexp_replace(z, '^\s+|\s+$', '', 'g'), '[.,;!? ]+$', '') FOR z IN flatten([{alls}])]"


@query(f"""WITH p AS (SELECT conv_id, turn, 'I prefer ' || text || '. I want to ' || text AS t FROM conversations), z AS (SELECT conv_id, turn, list_filter({_pref_sql('t')}, lambda q: len(q) BETWEEN 5 AND 80) AS a FROM p),
 u AS (SELECT conv_id, turn, unnest(a) AS pref, generate_subscripts(a, 1) AS i FROM z), f AS (SELECT conv_id, turn, pref, min(i) AS i FROM u GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM f) SELECT conv_id, turn, pref FROM k WHERE r <= 12""")
def preference_extract(s, d):
    t = F.concat(F.lit("I prefer "), F.col("text"), F.lit(". I want to "), F.col("text"))
    return read(s, d, "conversations").select("conv_id", "turn", F.explode(classify.preferences(t)).alias("pref"))


@query(f"WITH {D}, w AS (SELECT unnest(regexp_extract_all(document, '(?:^|[^\\p{{L}}])(\\p{{Lu}}\\p{{Ll}}+)', 1)) AS word FROM d) SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3")
def entity_candidates(s, d):
    return classify.entity_candidates(drawers(s, d))


STOP = ["this", "that", "with", "from", "have", "will", "would", "should"]


@query(f"""WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM conversations), c AS (SELECT conv_id, word, count(*) AS n FROM w WHERE len(word) >= 4 AND regexp_matches(word, '^\\p{{L}}+$') AND word NOT IN ({", ".join(f"'{x}'" for x in STOP)}) GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) AS rank FROM c) SELECT conv_id, word, n, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def theme_words(s, d):
    return classify.themes(read(s, d, "conversations"), "conv_id", "text", STOP)


@query(rf"""WITH {D}, p AS (SELECT id, 'Fixed ' || substring(document, 1, 60) || '; deployed the api, ' || document AS t FROM d), a AS (SELECT id, [lower(regexp_replace(z, '^\s+|\s+$', '', 'g')) FOR z IN regexp_extract_all(t, '{classify.ACTIONS}', 1)] AS a FROM p) SELECT DISTINCT id, unnest(a) AS topic FROM a""")
def action_phrases(s, d):
    t = F.concat(F.lit("Fixed "), F.substring("document", 1, 60), F.lit("; deployed the api, "), F.col("document"))
    return drawers(s, d).select("id", F.explode(classify.actions(t)).alias("topic"))


@query(f"""WITH {D}, p AS (SELECT id, regexp_extract_all('"' || substring(document, 1, 100) || '" said ' || document, '{classify.QUOTES}', 1)[1:3] AS q FROM d) SELECT id, unnest(q) AS quote FROM p""")
def quotes_extract(s, d):
    t = F.concat(F.lit('"'), F.substring("document", 1, 100), F.lit('" said '), F.col("document"))
    return drawers(s, d).select("id", F.explode(classify.quotes(t)).alias("quote"))


# --- dates, ids, clean-up --------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS found FROM events")
def date_from_text(s, d):
    t = F.concat(F.lit("on 2099-02-31 or "), F.date_format("ts", "yyyy-MM-dd"), F.lit(", not 2999-12-31"))
    return read(s, d, "events").select("event_id", dates.date_from_text(t).alias("found"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN '2023-05-06' ELSE '2022-02-02' END AS occurred_at FROM events""")
def occurred_at_resolve(s, d):
    i = F.col("event_id") % 4
    path = F.when(i == 0, F.concat(F.lit("a/b/log_"), F.date_format("ts", "yyyyMMdd"), F.lit(".md"))).otherwise(F.lit("a/20240101/notes_99999999.md"))
    line = F.when(i == 1, F.concat(F.lit('{"timestamp": '), F.unix_timestamp("ts") * 1000, F.lit("}"))).otherwise(F.lit("no json"))
    filed = F.when(i == 2, F.lit("2023-05-06T10:00:00"))
    return read(s, d, "events").select("event_id", dates.resolve_occurred_at(path, line, filed, F.lit("2022-02-02")).alias("occurred_at"))


@query("""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN event_id % 30 WHEN 1 THEN 7 * (event_id % 30) WHEN 2 THEN 30 WHEN 3 THEN 14 END AS INTEGER) AS days, CAST(CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 14 END AS INTEGER) AS tolerance FROM events""")
def relative_time(s, d):
    i = F.col("event_id")
    endings = F.array(*map(F.lit, [" days ago", " Weeks ago", " a month ago", " or recently", " ever"]))
    q = F.concat(F.lit("say "), i % 30, F.element_at(endings, (i % 5 + 1).cast("int")))
    r = dates.relative_days(q)
    return read(s, d, "events").select("event_id", r["days"].alias("days"), r["tolerance"].alias("tolerance"))


@query(rf"""WITH {D} SELECT id, array_to_string(list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(document, chr(10))], lambda y: len(y) > 0), ' ') AS out FROM d""")
def transforms_pipeline(s, d):
    return drawers(s, d).select("id", text.transform_by_names(F.col("document"), ["newline_normalize", "line_trim", "line_join_spaces"]).alias("out"))


@query(r"""SELECT p_partkey, replace(replace(lower(p_name || '''s'), ' ', '_'), '''', '') AS graph_id, regexp_replace(regexp_replace(regexp_replace(lower(p_name || '''s'), '[''"]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def slug_ids(s, d):
    name = F.concat("p_name", F.lit("'s"))
    return read(s, d, "part").select("p_partkey", text.entity_id(name).alias("graph_id"), text.entity_slug(name).alias("slug"))


@query(f"WITH {D} SELECT id, 'drawer_' || wing || '_' || room || '_' || substring(sha256(source_file || CAST(chunk_index AS VARCHAR)), 1, 24) AS mined, 'drawer_' || wing || '_' || room || '_' || substring(sha256(wing || room || document), 1, 24) AS added FROM d")
def deterministic_ids(s, d):
    head = F.concat(F.lit("drawer_"), F.col("wing"), F.lit("_"), F.col("room"), F.lit("_"))
    mined = text.short_hash(24, F.col("source_file"), F.col("chunk_index").cast("string"))
    return drawers(s, d).select("id", F.concat(head, mined).alias("mined"), F.concat(head, text.short_hash(24, F.col("wing"), F.col("room"), F.col("document"))).alias("added"))


@query(f"WITH {D} SELECT id, CASE WHEN len(document) > 200 THEN substring(document, 1, 200) || '...' ELSE document END AS preview FROM d")
def previews(s, d):
    return drawers(s, d).select("id", text.preview(F.col("document"), 200).alias("preview"))


# --- incremental -----------------------------------------------------------------------------------------------------

HELD = "h AS (SELECT * FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0)"


@query(f"""WITH {HELD}, c AS (SELECT user_id, max(ts) AS cur FROM h GROUP BY 1) SELECT e.event_id, CASE WHEN e.ts < cur THEN 'skipped' WHEN h.event_id IS NOT NULL THEN 'present' ELSE 'new' END AS state FROM events e LEFT JOIN c ON c.user_id = e.user_id LEFT JOIN h ON h.event_id = e.event_id""")
def sweep_incremental(s, d):
    e = read(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").alias("timestamp"))
    return incremental.sweep(e, e.where("id % 2 = 0 and id % 5 <> 0")).select(F.col("id").alias("event_id"), "state")


@query("SELECT user_id AS session_id, max(ts) AS cursor FROM events GROUP BY 1")
def session_cursor(s, d):
    e = read(s, d, "events")
    return incremental.cursors(e.select(F.col("user_id").alias("session_id"), F.col("ts").alias("timestamp")))


@query(f"WITH {D} SELECT DISTINCT source_file FROM d WHERE id % 5 = 0 AND NOT ((id // 5) % 3 = 0 AND (id // 5) % 2 = 0)")
def freshness_antijoin(s, d):
    files = drawers(s, d).where("id % 5 = 0").select("source_file", F.expr("id div 5").alias("k"), F.expr("cast(id as double)").alias("mtime"))
    state = files.where("k % 3 = 0").select("source_file", F.when(F.col("k") % 2 == 0, F.col("mtime") + 0.0005).otherwise(F.col("mtime") + 1).alias("mtime"), F.lit(2).alias("version"))
    return incremental.stale_sources(files, state).select("source_file")


@query("SELECT user_id, time_bucket(INTERVAL '60 seconds', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def rate_window_60s(s, d):
    return incremental.rate_windows(read(s, d, "events"), "user_id", "ts")


# --- queries, answers, sessions --------------------------------------------------------------------------------------

TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query()
def query_sanitize(s, d):
    """Every document as it stands; no oracle, as DuckDB's expressions don't peel quotes layer by layer."""
    c = text.sanitize_query(F.col("document"))
    return drawers(s, d).select("id", c["clean_query"].alias("clean_query"), c["method"].alias("method"))


@query()
def answer_normalise(s, d):
    """Every turn, of any script; no oracle, as DuckDB's expressions have no boundaries of Unicode words."""
    return read(s, d, "conversations").select("conv_id", "turn", text.normalised_answer(F.col("text")).alias("answer"))


@query(f"WITH {G} SELECT room, CASE WHEN contains(room, 'src1') THEN 1.0 ELSE 0.5 END AS score FROM g WHERE contains(room, 'src1') ORDER BY score DESC, room LIMIT 5")
def fuzzy_rooms(s, d):
    return graph.fuzzy_rooms(graph.nodes(drawers(s, d)), "src1").select("room", "score")


@query(f"""WITH {K}, c AS (SELECT DISTINCT subject, predicate, object FROM t), e AS (SELECT subject, predicate, object, max(coalesce(valid_to, '9999-12-31')) AS valid_to FROM t GROUP BY 1, 2, 3)
 SELECT c.*, e.valid_to FROM c JOIN e USING (subject, predicate, object) WHERE e.valid_to < '2024-06-01'""")
def fact_stale(s, d):
    t = triples(s, d)
    claims = t.select("subject", "predicate", "object").distinct()
    return kg.stale(claims, t, "2024-06-01").select("subject", "predicate", "object", "valid_to")


@query("SELECT conv_id, turn, CAST(count_if(text LIKE 'T%') OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS session FROM conversations")
def session_split(s, d):
    rows = transcript.sessions(read(s, d, "conversations"), "^T", "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", "session")


# --- names, summaries, topic lines ----------------------------------------------------------------------------------

#: Sentences put before a text by its id, so that signals occur.
SAID = ["Anna said she was late.\nThanks Anna, hey Anna\nfor Anna:\n", "we built Vesper\nVesper v2 is out\nsee Vesper.py and Vesper-core\n", "Tully: hm\n> Tully asked them\nTully and the Tully system\n", ""]
MORE = ["We decided on the api because it was important. I love it.\n# Plan of the week\n", 'fixed the broken thing; "it is a turning point for us all" he told\n', ""]


def _ascii(x: str) -> str:
    """Lower case, other letters than ASCII spelt out, as the oracle's engine takes them for a word's end."""
    return f"array_to_string([CASE WHEN ch >= chr(128) AND regexp_matches(ch, '[\\p{{L}}\\p{{N}}]') THEN 'q' || unicode(ch) || 'q' ELSE ch END FOR ch IN string_split(lower({x}), '')], '')"


def _counts() -> str:
    def one(kind: str, t: str) -> str:
        flags = "(?im)" if kind == "dialogue" else "(?i)"
        body = (flags + t).replace("'", "''").replace("{name}", "' || word || '")
        return f"len(regexp_extract_all(t, '{body}'))"

    return ", ".join("sum(" + " + ".join(one(k, t) for t in ts) + f") AS {k}" for k, ts in naming.ENGLISH.items())


NAMES_SQL = f"""p AS (SELECT conv_id, turn, {_before('conv_id', 'text', SAID)} AS t FROM conversations),
 w AS (SELECT conv_id, turn, t, unnest(regexp_extract_all(t, '(?:^|[^\\p{{L}}])(\\p{{Lu}}\\p{{Ll}}+)', 1)) AS word FROM p), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3),
 o AS (SELECT conv_id, turn, {_ascii('t')} AS t FROM p),
 m AS (SELECT DISTINCT o.conv_id, o.turn, o.t, word AS name, {_ascii('word')} AS word, string_split(o.t, chr(10)) AS l FROM w JOIN c USING (word) JOIN o ON o.conv_id = w.conv_id AND o.turn = w.turn),
 g AS (SELECT name AS word, {_counts()}, sum(len(list_filter(l, lambda x, i: contains(lower(x), lower(word)) AND len(list_filter(l[greatest(i - 2, 1):i + 2], lambda y: regexp_matches(y, '(?i){naming.PRONOUNS}'))) > 0))) AS pronoun FROM m GROUP BY 1)"""


def _locale_sql() -> str:
    """Names by maximal runs of word characters, and by runs of capitalised words with nothing but space between."""
    inside = locales.INSIDE
    of = lambda pick: "CASE lang " + " ".join(f"WHEN '{k}' THEN {pick(v)}" for k, v in locales.LOCALES.items() if k != "en") + f" ELSE {pick(locales.LOCALES['en'])} END"
    cap = lambda v: f"'{v.candidate.split('{')[0]}+'"
    return f"""WITH {D}, x AS (SELECT id, CASE WHEN wing IN ({', '.join(f"'{k}'" for k in locales.LOCALES)}) THEN wing ELSE 'en' END AS lang, regexp_extract_all(coalesce(document, ''), '[{inside}]+|[^{inside}]+') AS l FROM d),
 t AS (SELECT id, lang, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM x),
 k AS (SELECT *, regexp_full_match(w, {of(cap)}) AS cap, regexp_full_match(w, {of(lambda v: f"'{v.candidate}'")}) AS one, regexp_full_match(w, '[ \t\n\x0B\f\r]+') AS gap, list_contains({of(lambda v: _list(v.stop))}, lower(w)) AS stop FROM (SELECT DISTINCT lang, w FROM t)),
 u AS (SELECT id, i, lang, w, cap, one, gap, stop FROM t JOIN k USING (lang, w)),
 v AS (SELECT *, cap AND coalesce(lag(gap) OVER o AND lag(cap, 2) OVER o, FALSE) AS goes_on FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
 y AS (SELECT *, sum(CASE WHEN cap AND NOT goes_on THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run, max(CASE WHEN cap THEN i END) OVER (PARTITION BY id ORDER BY i) AS last FROM v),
 z AS (SELECT lang, id, run, string_agg(w, '' ORDER BY i) AS word FROM (SELECT *, max(CASE WHEN cap THEN i END) OVER (PARTITION BY id, run) AS high, min(CASE WHEN cap THEN i END) OVER (PARTITION BY id, run) AS low FROM y) WHERE i BETWEEN low AND high GROUP BY 1, 2, 3 HAVING count_if(cap) > 1 AND count_if(stop) = 0),
 n AS (SELECT lang, w AS word FROM u WHERE NOT stop AND one UNION ALL SELECT lang, word FROM z)
 SELECT lang, word, count(*) AS n FROM n GROUP BY 1, 2 HAVING count(*) >= 3"""


@query(lambda: _locale_sql())
def locale_candidates(s, d):
    """Names that stand three times or more in the texts of a language, one and several words long."""
    return locales.candidates(drawers(s, d), lang="wing")


#: Sentences in the language of a text, put before it by its id.
SAID_BY = {
    "en": ["Hey Marta, thanks!\nMarta said he knows Orbit.\nimport Orbit\n", "Marta wrote to Orbit. She laughed.\nOrbit v2 is out\n"],
    "de": ["Marta sagte, dass sie kommt.\nhallo Marta, danke Marta\n", "installiert Orbit jetzt\nOrbit v3 läuft, Marta weiß es\n"],
    "fr": ["Marta a dit oui.\nbonjour Marta, elle rit\n", "le projet Orbit avance, Marta aime Orbit\n"],
    "es": ["Marta dijo que sí.\nhola Marta, ella\n", "el proyecto Orbit, Marta quiere Orbit\n"],
}


def _said_by_sql() -> str:
    q = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "CASE wing " + " ".join(f"WHEN '{k}' THEN CASE id % 2 WHEN 0 THEN {q(a)} ELSE {q(b)} END" for k, (a, b) in SAID_BY.items()) + " ELSE '' END"


def _locale_signals_sql() -> str:
    def one(kind: str, t: str) -> str:
        body = (("(?im)" if kind == "dialogue" else "(?i)") + t).replace("'", "''").replace("{name}", "' || word || '")
        return f"len(regexp_extract_all(t, '{body}'))"

    def plain(t: str) -> str:
        return "".join(c if c < "\x80" else f"q{ord(c)}q" for c in t.lower() if True) if any(c >= "\x80" for c in t) else t

    kinds = [k for k in naming.POINTS if k != "pronoun"]
    of = lambda pick: "CASE lang " + " ".join(f"WHEN '{k}' THEN {pick(v)}" for k, v in locales.LOCALES.items() if k != "en") + f" ELSE {pick(locales.LOCALES['en'])} END"
    counts = ", ".join("sum(" + of(lambda v, k=k: "(" + " + ".join(one(k, plain(t)) for t in v.signals[k]) + ")") + f") AS {k}" for k in kinds)
    return f"""WITH {D}, p AS (SELECT id, coalesce(wing, '') AS lang, {_said_by_sql()} || coalesce(document, '') AS x FROM d), o AS (SELECT id, lang, {_ascii('x')} AS t FROM p),
 m AS (SELECT o.*, word, string_split(t, chr(10)) AS l FROM o, (VALUES ('marta'), ('orbit')) n(word) WHERE list_contains(regexp_extract_all((SELECT x FROM p WHERE p.id = o.id), '(?:^|[^\\p{{L}}])(\\p{{Lu}}\\p{{M}}*[\\p{{Ll}}\\p{{M}}]+)', 1), upper(word[1]) || word[2:]))
 SELECT upper(word[1]) || word[2:] AS word, {counts}, sum({of(lambda v: f"len(list_filter(l, lambda x, i: contains(x, word) AND len(list_filter(l[greatest(i - 2, 1):i + 2], lambda y: regexp_matches(y, '(?i){plain(v.pronouns)}'))) > 0))")}) AS pronoun FROM m GROUP BY 1"""


@query(lambda: _locale_signals_sql())
def locale_signals(s, d):
    """Signals of two names, each text read by the patterns of its language."""
    first = [F.when(F.col("wing") == k, F.when(F.col("id") % 2 == 0, a).otherwise(b)) for k, (a, b) in SAID_BY.items()]
    rows = drawers(s, d).select("id", "wing", F.concat(F.coalesce(*first, F.lit("")), F.coalesce("document", F.lit(""))).alias("document"))
    named = s.createDataFrame([("Marta",), ("Orbit",)], "word string")
    by = {k: (v.signals, v.pronouns) for k, v in locales.LOCALES.items() if k != "en"}
    return naming.signals(rows, named, lang=F.col("wing"), languages=by)


@query(f"WITH {NAMES_SQL} SELECT word, dialogue, action, pronoun, addressed, verb, versioned, code FROM g")
def entity_signals(s, d):
    rows = read(s, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), _put_before("conv_id", "text", SAID).alias("document"))
    return naming.signals(rows, classify.entity_candidates(rows))


TYPES_SQL = f"""WITH {NAMES_SQL}, z AS (SELECT c.word, c.n, 3 * dialogue + 2 * action + 2 * pronoun + 4 * addressed AS ps, 2 * verb + 3 * versioned + 3 * code AS js, CAST(dialogue > 0 AS INT) + CAST(action > 0 AS INT) + CAST(pronoun > 0 AS INT) + CAST(addressed > 0 AS INT) AS k FROM c JOIN g USING (word)),
 y AS (SELECT *, CASE WHEN ps + js = 0 THEN NULL ELSE ps / CAST(ps + js AS DOUBLE) END AS r FROM z)
 SELECT word, n, ps AS person_score, js AS project_score, CASE WHEN r IS NULL THEN 'uncertain' WHEN r >= 0.7 THEN CASE WHEN k >= 2 AND ps >= 5 THEN 'person' ELSE 'uncertain' END WHEN r <= 0.3 THEN 'project' ELSE 'uncertain' END AS type,
 floor(CASE WHEN r IS NULL THEN least(0.4, n / 50.0) WHEN r >= 0.7 THEN CASE WHEN k >= 2 AND ps >= 5 THEN least(0.99, 0.5 + r * 0.5) ELSE 0.4 END WHEN r <= 0.3 THEN least(0.99, 0.5 + (1 - r) * 0.5) ELSE 0.5 END * 100 + 0.5) / 100 AS confidence FROM y"""


@query(TYPES_SQL)
def entity_types(s, d):
    rows = read(s, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), _put_before("conv_id", "text", SAID).alias("document"))
    candidates = classify.entity_candidates(rows)
    return naming.classify(candidates, naming.signals(rows, candidates))


@query(f"WITH t AS ({TYPES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, n DESC, word) AS rank FROM t) SELECT word, n, person_score, project_score, type, confidence, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE type WHEN 'person' THEN 15 WHEN 'project' THEN 10 ELSE 8 END")
def entity_report(s, d):
    return naming.report(entity_types(s, d))


def _batch_sql(k: int) -> str:
    return TYPES_SQL.replace("AS t FROM conversations)", f"AS t FROM conversations WHERE conv_id % 2 = {k})", 1)


@query(lambda: f"""WITH a AS ({_batch_sql(0)}), b AS ({_batch_sql(1)}), seed AS (SELECT 'Max' AS name, 'person' AS kind, ['Maxwell'] AS alias UNION ALL SELECT 'Maxwell', 'person', ['Max'] UNION ALL SELECT 'Orbit', 'project', []),
 l AS (SELECT word, confidence, n, 1 AS batch FROM a WHERE type = 'person' AND confidence >= 0.75 AND word NOT IN (SELECT name FROM seed)), m AS (SELECT word, confidence, n FROM b WHERE type = 'person' AND confidence >= 0.75 AND word NOT IN (SELECT name FROM seed UNION SELECT word FROM l))
 SELECT name, kind, array_to_string(alias, ',') AS alias, 1.0::DOUBLE AS confidence, 'onboarding' AS source, name = 'Max' AS ambiguous, CAST(0 AS BIGINT) AS seen FROM seed
 UNION ALL SELECT word, 'person', '', confidence, 'learned', word = 'Ben', n FROM (SELECT word, confidence, n FROM l UNION ALL SELECT * FROM m)""")
def registry_learned(s, d):
    """A registry told of two names and a project, then shown the conversations in two batches, the second one twice."""
    rows = read(s, d, "conversations").select("conv_id", F.concat_ws("/", "conv_id", "turn").alias("id"), _put_before("conv_id", "text", SAID).alias("document"))
    common = s.createDataFrame([("max",), ("BEN",)], "word string")
    known = registry.seeded(s.createDataFrame([("Maxwell", "Max")], "name string, alias string"), s.createDataFrame([("Orbit",)], "name string"), common)
    for batch in (0, 1, 1):
        known = registry.learned(known, rows.where(F.col("conv_id") % 2 == batch), common)
    return known.withColumn("alias", F.array_join("alias", ","))


@query(lambda: f"""WITH {D}, w AS (SELECT id, regexp_extract_all(lower(document), '[\\p{{L}}\\p{{N}}_]+') AS w, document FROM d), q AS (SELECT id AS qid, ' ' || array_to_string(w, ' ') || ' ' AS t FROM w WHERE id % 50 = 0),
 r AS (SELECT id, array_to_string(w[1:1 + id // 25 % 4], ' ') AS name, array_to_string(w[5:6 + id // 25 % 5], ' ') AS alias FROM w WHERE id % 25 = 0 AND len(w) > 0), f AS (SELECT name, name AS form FROM r UNION SELECT name, alias FROM r WHERE alias <> '' UNION SELECT alias, name FROM r WHERE alias <> '')
 SELECT DISTINCT qid, name FROM q JOIN f ON contains(t, ' ' || form || ' ')""")
def people_in_question(s, d):
    """The people of a registry that texts speak of: names and aliases of one to six words, taken from other texts."""
    words = F.regexp_extract_all(F.lower("document"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    part = lambda a, n: F.array_join(F.slice("w", F.lit(a), n), " ")
    rows = drawers(s, d).where("id % 25 = 0").select("id", words.alias("w")).where("size(w) > 0")
    step = F.expr("id div 25").cast("int")
    told = rows.select(part(1, step % 4 + 1).alias("name"), part(5, step % 5 + 2).alias("alias"))
    none = s.createDataFrame([], "word string")
    known = registry.seeded(told, s.createDataFrame([], "name string"), none)
    asked = drawers(s, d).where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("document").alias("question"))
    return registry.people_in(asked, known)


def _first_codes_sql(x: str, words: dict[str, str]) -> str:
    pos = {v: "CASE " + " ".join(f"WHEN contains(lower({x}), '{k}') THEN {i}" for i, (k, w) in enumerate(words.items()) if w == v) + " END" for v in dict.fromkeys(words.values())}
    pairs = ", ".join(f"{{'p': {e}, 'v': '{v}'}}" for v, e in pos.items())
    return f"list_transform(list_sort(list_filter([{pairs}], lambda c: c.p IS NOT NULL)), lambda c: c.v)[1:3]"


FILL = ", ".join(f"'{w}'" for w in summary.FILLER)
WEIGH = " + ".join(f"2 * CAST(contains(lower(x), '{w}') AS INT)" for w in summary.DECISIVE)
COMPRESS_SQL = rf"""{D}, p AS (SELECT id, wing, room, occurred_at, source_file, {_before('id', 'document', MORE)} AS t FROM d),
 tw AS (SELECT id, unnest(regexp_extract_all(t, '{summary.TOPIC_WORD}')) AS w, generate_subscripts(regexp_extract_all(t, '{summary.TOPIC_WORD}'), 1) AS i FROM p),
 tc AS (SELECT id, lower(w) AS w, sum(1 + 2 * CAST(regexp_matches(w, '^[A-Z]') AS INT) + 2 * CAST(regexp_matches(w, '[_-]|^.+[A-Z]') AS INT)) AS x, min(i) AS i FROM tw WHERE lower(w) NOT IN ({FILL}) GROUP BY 1, 2),
 tr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, i) AS r FROM tc), tt AS (SELECT id, string_agg(w, '_' ORDER BY r) AS topics FROM tr WHERE r <= 3 GROUP BY 1),
 nm AS (SELECT id, list_filter(list_transform(string_split_regex({TRIM.format(x='t')}, '\s+')[2:], lambda w: regexp_replace(w, '[^a-zA-Z]', '', 'g')), lambda w: regexp_matches(w, '^[A-Z][a-z]+$') AND lower(w) NOT IN ({FILL})) AS ws FROM p),
 nu AS (SELECT id, upper(substring(unnest(ws), 1, 3)) AS c, generate_subscripts(ws, 1) AS i FROM nm), nd AS (SELECT id, c, min(i) AS i FROM nu GROUP BY 1, 2), nr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM nd),
 ns AS (SELECT id, string_agg(c, '+' ORDER BY i) AS names FROM nr WHERE r <= 3 GROUP BY 1),
 ks AS (SELECT id, [{TRIM.format(x='z')} FOR z IN string_split_regex(t, '[.!?\n]+') IF len({TRIM.format(x='z')}) > 10] AS a FROM p), ku AS (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM ks),
 kr AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY {WEIGH} + CASE WHEN len(x) < 40 THEN 2 WHEN len(x) < 80 THEN 1 WHEN len(x) > 150 THEN -2 ELSE 0 END DESC, i) AS r FROM ku), kk AS (SELECT id, CASE WHEN len(x) > 55 THEN substring(x, 1, 52) || '...' ELSE x END AS x FROM kr WHERE r = 1),
 fe AS (SELECT id, array_to_string({_first_codes_sql('t', summary.FEELINGS)}, '+') AS f, array_to_string({_first_codes_sql('t', summary.FLAGS)}, '+') AS g FROM p),
 su AS (SELECT p.id, p.t, wing || '|' || room || '|' || occurred_at || '|' || source_file || chr(10) || concat_ws('|', '0:' || coalesce(names, '???'), coalesce(topics, 'misc'), '"' || x || '"', CASE WHEN f <> '' THEN f END, CASE WHEN g <> '' THEN g END) AS summary
  FROM p LEFT JOIN tt USING (id) LEFT JOIN ns USING (id) LEFT JOIN kk USING (id) LEFT JOIN fe USING (id))"""


def _compressed(s, d):
    return summary.compress(drawers(s, d).withColumn("document", _put_before("id", "document", MORE)))


@query(f"WITH {COMPRESS_SQL} SELECT id, summary FROM su")
def summary_lines(s, d):
    return _compressed(s, d).select("id", "summary")


@query(lambda: ORACLES["summary_lines"])
def summaries_refreshed(s, d):
    """The compressed table, first of other rows (some changed, some lacking, some more), then brought up to date."""
    folder = f"{shared_folder(s)}/summaries-{uuid.uuid4().hex}"
    rows = drawers(s, d).withColumn("document", _put_before("id", "document", MORE))
    before = rows.where("id % 11 <> 0").withColumn("document", F.when(F.col("id") % 7 == 0, F.upper("document")).otherwise(F.col("document")))
    more = rows.where("id % 13 = 0").withColumn("id", F.col("id") + 10_000_000_000)
    make = lambda df: summary.compress(df).select("id", "summary")
    derived.refresh(before.unionByName(more), folder, make)
    derived.refresh(rows, folder, make)
    return derived.current(s.read.parquet(folder), "id")


#: What notes quote, by the document's number; their people with their codes, and their feelings with theirs.
QUOTED_IN_NOTES = ["She said: I remember the quiet sea. ", "\"The old harbour town\" and 'we trust the real one'. ", "", "('never to forget it') \"short\" "]
NOTE_PEOPLE = [(["Ana", "Bob Ray"], ["ANA1", "BOB"]), ([], []), (["gandalf bot", "Zoe Lind"], ["ZOE"])]
NOTE_FEELINGS = [(["joy", "raw_grief", "strange", "joyful"], "joy+grief+stra"), (["anger", "rage", "love", "hope", "peace"], "rage+love+hope"), ([], ""), (["warmth"], "warmth")]
NOTE_CODES = {"Ana": "ANA1", "bob": "BOB"}


def _notes_sql() -> str:
    pick = lambda n, values: f"CASE id % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    rx = lambda p: "'" + p.replace("'", "''") + "'"
    moving = " + ".join(f"CAST(contains(lower(q), '{w}') AS INTEGER)" for w in zettel.MOVING)
    return f"""WITH {D}, n AS (SELECT id, id // 5 AS k, {_before('id', "coalesce(document, '')", QUOTED_IN_NOTES)} AS content, CASE WHEN id % 3 = 0 THEN 'genesis of it' ELSE '' END AS label, CASE WHEN id % 4 = 0 THEN 'core and pivot' ELSE '' END AS notes,
  'Doc ' || id || CASE WHEN id % 2 = 0 THEN ' - ' || substring(coalesce(document, ''), 1, 60) ELSE '' END AS title, {pick(3, [_list(c) + '::VARCHAR[]' for _, c in NOTE_PEOPLE])} AS codes, {pick(4, [f"'{c}'" for _, c in NOTE_FEELINGS])} AS feel,
  regexp_extract_all(coalesce(document, ''), '[a-z]{{4,}}')[1:2] AS topics, wing FROM d),
 m AS (SELECT id, content || ' ' || label || ' ' || notes AS t FROM n), f AS (SELECT id, {' || '.join(f"regexp_extract_all(t, {rx(p)}, 1)" for p in zettel.QUOTES)} AS qs FROM m),
 u AS (SELECT id, regexp_replace(unnest(qs), '^\\s+|\\s+$', '', 'g') AS q, generate_subscripts(qs, 1) AS i FROM f), w AS (SELECT *, 2 * CAST(regexp_matches(q, '^\\p{{Lu}}') AS INTEGER) + 2 * ({moving}) + CAST(len(q) > 20 AS INTEGER) - 2 * CAST(regexp_matches(q, '^(The|This|She) ') AS INTEGER) AS s FROM u WHERE len(q) >= 8),
 b AS (SELECT id, q FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, i) AS r FROM w) WHERE r = 1),
 z AS (SELECT n.*, coalesce(b.q, substring(CASE WHEN contains(title, ' - ') THEN substring(title, strpos(title, ' - ') + 3) ELSE '' END, 1, 45)) AS quote,
  array_to_string(list_filter([CASE WHEN n.id % 5 = 0 THEN 'ORIGIN' END, CASE WHEN n.id % 6 = 0 THEN 'SENSITIVE' END, CASE WHEN n.id % 4 = 0 THEN 'CORE' END, CASE WHEN n.id % 3 = 0 THEN 'GENESIS' END, CASE WHEN n.id % 4 = 0 THEN 'PIVOT' END], lambda x: x IS NOT NULL), '+') AS flags FROM n LEFT JOIN b ON b.id = n.id),
 l AS (SELECT k, id, id || ':' || CASE WHEN len(codes) > 0 THEN array_to_string(codes, '+') ELSE '???' END || '|' || CASE WHEN len(topics) > 0 THEN array_to_string(topics, '_') ELSE 'misc' END || CASE WHEN quote <> '' THEN '|"' || quote || '"' ELSE '' END || '|' || CAST((id % 10) / 10.0::DOUBLE AS VARCHAR)
  || CASE WHEN feel <> '' THEN '|' || feel ELSE '' END || CASE WHEN flags <> '' THEN '|' || flags ELSE '' END AS line FROM z),
 e AS (SELECT k, list_sort(list_distinct(flatten(list(codes)))) AS every FROM n GROUP BY 1), g AS (SELECT k, string_agg(line, chr(10) ORDER BY id) AS lines, min(id) AS low, max(id) AS high FROM l GROUP BY 1),
 o AS (SELECT k, 'n' || k || '|' || CASE WHEN len(every) > 0 THEN array_to_string(every[1:3], '+') ELSE '???' END || '|day ' || low % 7 || '|' || 'Notes ' || k || CASE WHEN k % 2 = 0 THEN chr(10) || 'ARC:joy->fear' ELSE '' END || chr(10) || lines || chr(10) || 'T:' || low || '<->' || high || '|' || CASE WHEN k % 2 = 0 THEN 'same wing' ELSE substring('a label of more than thirty letters', 1, 30) END AS encoded FROM g JOIN e USING (k)),
 s AS (SELECT k, encoded, string_split(regexp_replace(encoded, '^\\s+|\\s+$', '', 'g'), chr(10)) AS ls FROM o)
 SELECT k, encoded, coalesce(string_split(list_filter(ls, lambda x: NOT starts_with(x, 'ARC:') AND NOT starts_with(x, 'T:') AND contains(x, '|') AND NOT contains(string_split(x, '|')[1], ':'))[-1], '|')[4], '') AS title, len(list_filter(ls, lambda x: NOT starts_with(x, 'ARC:') AND NOT starts_with(x, 'T:') AND contains(x, '|') AND contains(string_split(x, '|')[1], ':'))) AS notes, len(list_filter(ls, lambda x: starts_with(x, 'T:'))) AS links, CASE WHEN k % 2 = 0 THEN 'joy->fear' ELSE '' END AS arc FROM s"""


@query(lambda: _notes_sql())
def notes_encoded(s, d):
    """Notes made of all documents, a file for every five, written as lines and taken apart again. A quote that goes over a
    line's end is two lines when read, of which the second may count as a header, as lines alone tell what is what."""
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    by = lambda n, values: F.element_at(F.array(*values), (F.col("id") % n + 1).cast("int"))
    body = F.coalesce("document", F.lit(""))
    note = F.struct(
        F.concat(F.lit("z-"), "id").alias("id"),
        F.concat(F.lit("Doc "), "id", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" - "), F.substring(body, 1, 60))).otherwise("")).alias("title"),
        F.concat(by(len(QUOTED_IN_NOTES), list(map(F.lit, QUOTED_IN_NOTES))), body).alias("content"),
        F.when(F.col("id") % 3 == 0, "genesis of it").alias("origin_label"),
        F.when(F.col("id") % 4 == 0, "core and pivot").alias("notes"),
        by(3, [array(p) for p, _ in NOTE_PEOPLE]).alias("people"),
        F.regexp_extract_all(body, F.lit("[a-z]{4,}"), F.lit(0)).alias("topics"),
        ((F.col("id") % 10) / 10.0).alias("emotional_weight"),
        by(4, [array(t) for t, _ in NOTE_FEELINGS]).alias("emotional_tone"),
        (F.col("id") % 5 == 0).alias("origin_moment"),
        F.when(F.col("id") % 6 == 0, "Maximum care").alias("sensitivity"),
        F.concat(F.lit("day "), F.col("id") % 7).alias("date_context"),
    )
    k = F.expr("id div 5")
    tunnel = F.struct(F.concat(F.lit("z-"), F.min("id")).alias("from"), F.concat(F.lit("z-"), F.max("id")).alias("to"), F.when(F.first("k") % 2 == 0, "same wing: more of it").otherwise("a label of more than thirty letters").alias("label"))
    grouped = drawers(s, d).withColumn("k", k).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("id", note.alias("z")))).alias("zs"), F.array(tunnel).alias("tunnels"))
    files = grouped.select("k", F.concat(F.lit("n"), "k", F.lit("-Notes "), "k", F.lit(".txt")).alias("source_file"), F.when(F.col("k") % 2 == 0, "joy->fear").alias("emotional_arc"), F.transform("zs", lambda x: x["z"]).alias("zettels"), "tunnels")
    told = zettel.decode(zettel.encode(files, NOTE_CODES, ["gandalf"]))
    return told.select("k", "encoded", "header.title", F.size("notes").alias("notes"), F.size("links").alias("links"), "arc")


def _tokens_sql(x: str) -> str:
    t = TRIM.format(x=x)
    return rf"CAST(sum(greatest(1, CAST(floor(CASE WHEN {t} = '' THEN 0 ELSE len(string_split_regex({t}, '\s+')) END * 1.3::DOUBLE) AS INTEGER))) AS BIGINT)"


@query(f"WITH {COMPRESS_SQL} SELECT count(*) AS n, {_tokens_sql('t')} AS original_tokens, {_tokens_sql('summary')} AS summary_tokens, CAST(sum(len(t)) AS BIGINT) AS original_chars, CAST(sum(len(summary)) AS BIGINT) AS summary_chars FROM su")
def summary_totals(s, d):
    return summary.compression_totals(_compressed(s, d))


@query(rf"""WITH {D}, p AS (SELECT id, wing, room, source_file, substring({_before('id', 'document', MORE)}, 1, 5000) AS t FROM d),
 e AS (SELECT id, unnest(regexp_extract_all(t, '{summary.WORD}')) AS w, generate_subscripts(regexp_extract_all(t, '{summary.WORD}'), 1) AS i FROM p),
 ec AS (SELECT id, w, count(*) AS n, min(i) AS i FROM e WHERE regexp_matches(w, '{summary.NAME}') AND w NOT IN ({", ".join(f"'{w}'" for w in summary.NO_NAMES)}) GROUP BY 1, 2 HAVING count(*) >= 2), er AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS r FROM ec),
 es AS (SELECT id, string_agg(w, ';' ORDER BY r) AS names FROM er WHERE r <= 5 GROUP BY 1),
 a AS (SELECT id, wing, room, source_file, [lower({TRIM.format(x='z')}) FOR z IN regexp_extract_all(t, '{classify.ACTIONS}', 1) || regexp_extract_all(t, '{summary.HEADER}', 1)] AS a, ['"' || z || '"' FOR z IN regexp_extract_all(t, '{classify.QUOTES}', 1)[1:3]] AS q FROM p),
 u AS (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM a), f AS (SELECT id, x, min(i) AS i FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM f), t12 AS (SELECT id, list(x ORDER BY r) AS a FROM k WHERE r <= 12 GROUP BY 1),
 b AS (SELECT a.id, wing, room, source_file, coalesce(t12.a, []) || q AS b FROM a LEFT JOIN t12 USING (id)), z AS (SELECT id, CASE WHEN len(b) > 0 THEN b ELSE [wing || '/' || room || '/' || source_file] END AS b FROM b),
 y AS (SELECT id, unnest(b) AS x, generate_subscripts(b, 1) - 1 AS position FROM z) SELECT id, position, x || '|' || coalesce(names, '') || '|→' || id || ',' || (id + 1) AS line FROM y LEFT JOIN es USING (id)""")
def topic_lines(s, d):
    rows = drawers(s, d).withColumn("document", _put_before("id", "document", MORE))
    return summary.topic_lines(rows.withColumn("drawer_ids", F.array("id", F.col("id") + 1)))


@query(lambda: f"""WITH RECURSIVE tl AS ({ORACLES['topic_lines']}), w AS (SELECT id, position, line, len(line) + 1 AS used, 1 AS closet FROM tl WHERE position = 0
 UNION ALL SELECT tl.id, tl.position, tl.line, CASE WHEN used + len(tl.line) + 1 > {summary.CLOSET} THEN len(tl.line) + 1 ELSE used + len(tl.line) + 1 END, closet + CAST(used + len(tl.line) + 1 > {summary.CLOSET} AS INT) FROM w JOIN tl ON tl.id = w.id AND tl.position = w.position + 1)
 SELECT id, closet, string_agg(line, chr(10) ORDER BY position) AS text FROM w GROUP BY 1, 2""")
def closet_pack(s, d):
    rows = drawers(s, d).withColumn("document", _put_before("id", "document", MORE))
    return summary.closets(summary.topic_lines(rows.withColumn("drawer_ids", F.array("id", F.col("id") + 1))))


# --- sessions, rooms of projects, more metrics -----------------------------------------------------------------------

REFUSING = ["I'm sorry, but I can't do that. ", "The request was denied: ", ""]


@query(f"""WITH p AS (SELECT conv_id, turn, {_before('conv_id', 'text', REFUSING)} AS t FROM conversations WHERE role = 'assistant' AND text <> ''), l AS (SELECT conv_id, max_by(t, turn) AS t FROM p GROUP BY 1),
 m AS (SELECT conv_id, t, list_filter([{", ".join("CASE WHEN regexp_matches(t, '(?i){0}') THEN '{0}' END".format(p.replace("'", "''")) for p in transcript.REFUSALS)}], lambda x: x IS NOT NULL) AS m FROM l)
 SELECT conv_id, array_to_string(m, ' ') AS matched, CASE WHEN len(t) > 500 THEN regexp_replace(substring(t, 1, 500), ' [^ ]*$', '') || ' ...' ELSE t END AS snippet FROM m WHERE len(m) > 0""")
def refusal_log(s, d):
    rows = read(s, d, "conversations").where("text <> ''").withColumn("text", _put_before("conv_id", "text", REFUSING))
    return transcript.refusals(rows).withColumn("matched", F.array_join("matched", " "))


PAGE = "regexp_extract(url, '^https?://[^/]+/(.*)$', 1)"


@query(f"""WITH n AS (SELECT regexp_replace(lower(string_split({PAGE}, '/')[-1]), '[- ]', '_', 'g') AS name FROM pages UNION ALL SELECT regexp_replace(lower(p_name), '[- ]', '_', 'g') || '_design' FROM part),
 k AS (SELECT unnest({_list(rooms.KEYWORDS)}) AS k, unnest({_list(rooms.KEYWORDS.values())}) AS room), c AS (SELECT room, count(*) AS n FROM n JOIN k ON contains(name, k) GROUP BY 1 HAVING count(*) >= 2)
 SELECT room, n FROM (SELECT * FROM c ORDER BY n DESC, room LIMIT 6) UNION ALL SELECT 'general', 0 WHERE NOT EXISTS (SELECT 1 FROM c)""")
def rooms_from_names(s, d):
    paths = read(s, d, "pages").select(F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path"))
    return rooms.from_names(paths.union(read(s, d, "part").select(F.concat("p_name", F.lit("_design")))))


@query(f"""WITH e AS (SELECT p_partkey AS qid, p_partkey % 3 AS n FROM part), r AS (SELECT l_partkey AS qid, l_linenumber AS id FROM lineitem)
 SELECT qid, {SIX("CASE WHEN n = 0 THEN 1.0 ELSE (SELECT count(DISTINCT id) FROM r WHERE r.qid = e.qid AND id <= e.n) / CAST(n AS DOUBLE) END")} AS recall, hex8 % 10 <> 0 AS held_out FROM (SELECT *, CAST('0x' || substring(md5(CAST(qid AS VARCHAR)), 1, 8) AS BIGINT) AS hex8 FROM e) e""")
def evidence_recall(s, d):
    n = F.col("p_partkey") % 3
    evidence = read(s, d, "part").select(F.col("p_partkey").alias("qid"), F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n.cast("int"))).alias("evidence"))
    found = read(s, d, "lineitem").select(F.col("l_partkey").alias("qid"), F.col("l_linenumber").cast("int").alias("id"))
    out = metrics.evidence_recall(evidence, found)
    return out.select("qid", r6(F.col("recall")).alias("recall"), metrics.held_out(F.col("qid")).alias("held_out"))


@query(f"""WITH e AS (SELECT DISTINCT conv_id AS qid, lower({TRIM.format(x='text')}) AS e FROM conversations WHERE role = 'user'), t AS (SELECT DISTINCT conv_id AS qid, lower({TRIM.format(x='text')}) AS t FROM conversations WHERE role <> 'user' OR turn % 3 = 0),
 h AS (SELECT qid, e, max(CAST(coalesce(contains(e, t) OR contains(t, e), FALSE) AS INT)) AS hit FROM e LEFT JOIN t USING (qid) GROUP BY 1, 2) SELECT qid, {SIX('avg(hit)')} AS recall FROM h GROUP BY 1""")
def message_recall(s, d):
    c = read(s, d, "conversations").withColumnRenamed("conv_id", "qid")
    found = c.where("role <> 'user' or turn % 3 = 0")  # what a search came back with, beside all evidence
    return metrics.message_recall(c.where("role = 'user'"), found).withColumn("recall", r6(F.col("recall")))


# --- halls, claims ---------------------------------------------------------------------------------------------------

SAY = ["I prefer tea. ", "Here are two: I suggest it. ", "My birthday. ", "A job in the city. ", ""]


def _holds(x: str, words: list[str]) -> list[str]:
    return ["contains(lower({}), '{}')".format(x, w.replace("'", "''")) for w in words]


def _hall_sql(u: str, a: str) -> str:
    where = {halls.PREFERENCES: u, halls.ASSISTANT: a, halls.EVENTS: f"{u} || {a}", halls.FACTS: f"{u} || {a}"}
    count = lambda h, words: " + ".join(f"CAST({c} AS INT)" for c in _holds(where[h], words))
    return "CASE " + " ".join(f"WHEN {count(h, words)} >= {halls.LEAST[h]} THEN '{h}'" for h, words in halls.SESSION_SIGNALS.items()) + " ELSE 'general' END"


@query(f"""WITH p AS (SELECT conv_id, turn, role, {_before('conv_id', 'text', SAY)} AS t FROM conversations), c AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN t END, ' ' ORDER BY turn), '') AS u, coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, ' ' ORDER BY turn), '') AS a FROM p GROUP BY 1)
 SELECT conv_id, {_hall_sql('u', 'a')} AS hall FROM c""")
def session_halls(s, d):
    return halls.sessions(read(s, d, "conversations").withColumn("text", _put_before("conv_id", "text", SAY))).select("conv_id", "hall")


def _question_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(_holds(x, words))} THEN '{'>'.join(halls.TARGETS[h])}'" for h, words in halls.QUESTION_SIGNALS.items()) + " ELSE 'general' END"


ASKED = ["What you said on ", "Lately on ", "Three weeks ago on ", "Which school is ", ""]


@query(f"WITH p AS (SELECT conv_id, turn, {_before('conv_id', 'text', ASKED)} AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, {_question_sql('t')} AS halls FROM p")
def question_halls(s, d):
    rows = read(s, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.array_join(halls.question_halls(_put_before("conv_id", "text", ASKED)), ">").alias("halls"))


@query(KNN.format(cond="id <> qid").replace("WITH ", f"WITH {D}, ", 1) + f""", c0 AS (SELECT d.*, k.qid, k.x FROM k JOIN d USING (id)), h AS (SELECT qid, id, x, document, {_hall_sql(_before('id', 'document', SAY), chr(39) * 2)} AS hall FROM c0),
 f AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, id) AS r FROM h WHERE hall = 'events') WHERE r <= 10), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, id) AS r FROM h) WHERE r <= 50)
 SELECT n.qid, n.id, hall, {SIX(f"x * (1 - 0.30 * {OV}) * CASE WHEN hall = 'events' THEN 0.75 WHEN hall IN ('facts', 'general') THEN 0.90 ELSE 1 END * CASE WHEN f.id IS NOT NULL THEN 0.85 ELSE 1 END")} AS score FROM n LEFT JOIN f ON f.qid = n.qid AND f.id = n.id""")
def two_pass_rank(s, d):
    halled = drawers(s, d).withColumn("hall", halls.session_hall(_put_before("id", "document", SAY), F.lit(""))).join(vectors(s, d).select("id", "embedding"), "id")
    out = halls.two_pass(halled, _queries(vectors(s, d)), halls.TARGETS[halls.EVENTS], QUESTION)
    return out.select("qid", "id", "hall", r6(F.col("score")).alias("score"))


@query("SELECT c_custkey, 'Cust' || c_custkey AS subject, 'owner' AS predicate, 'Nation' || c_nationkey AS object FROM customer WHERE c_custkey % 3 <> 2")
def claims_stated(s, d):
    a, b = F.concat(F.lit("Cust"), "c_custkey"), F.concat(F.lit("Nation"), "c_nationkey")
    i = F.col("c_custkey") % 3
    said = F.when(i == 0, F.concat(F.lit("So "), a, F.lit(" is "), b, F.lit("'s owner."))).when(i == 1, F.concat(b, F.lit("'s owner is "), a, F.lit(", they say"))).otherwise(F.concat(a, F.lit(" was "), b, F.lit("'s owner")))
    rows = read(s, d, "customer").select("c_custkey", F.explode(naming.claims(said)).alias("c"))
    return rows.select("c_custkey", "c.subject", "c.predicate", "c.object")


# --- intake ----------------------------------------------------------------------------------------------------------

ROOMS = [{"name": "src3"}, {"name": "Prose", "keywords": ["ertion", "thnt"]}, {"name": "deutsch", "keywords": ["der", "die"]}, {"name": "f21", "keywords": []}]


def _room_sql() -> str:
    known = [(r["name"], [r["name"].lower(), *r.get("keywords", [])]) for r in ROOMS]
    near = lambda x, w: f"(contains({x}, '{w}') OR contains('{w}', {x}))"
    case = lambda rows: "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rows) + " END"
    folder = case([(" OR ".join(near("lower(z)", w) for w in words), name) for name, words in known])
    stem = case([(near("stem", words[0]), name) for name, words in known])
    score = lambda words: " + ".join(f"(len(low) - len(replace(low, '{w}', ''))) / {len(w)}" for w in words)
    best = "greatest(" + ", ".join(score(words) for _, words in known) + ")"
    counted = case([(f"{score(words)} = {best} AND {best} > 0", name) for name, words in known])
    return f"""WITH {D}, p AS (SELECT id, wing || '/' || room || '/' || source_file || '.v' || chunk_index || '.md' AS path, lower(substring(document, 1, 2000)) AS low FROM d),
 q AS (SELECT *, string_split(path, '/')[:-2] AS f, regexp_replace(lower(string_split(path, '/')[-1]), '(.)\\.[^.]*$', '\\1') AS stem FROM p)
 SELECT id, coalesce(list_filter([{folder} FOR z IN f], lambda x: x IS NOT NULL)[1], {stem}, {counted}, 'general') AS told FROM q"""


@query(lambda: _room_sql())
def room_routed(s, d):
    path = F.concat(F.col("wing"), F.lit("/"), F.col("room"), F.lit("/"), F.col("source_file"), F.lit(".v"), F.col("chunk_index"), F.lit(".md"))
    return drawers(s, d).select("id", ingest.room_of(path, F.col("document"), ROOMS).alias("told"))


@query(lambda: f"""WITH {D}, w AS (SELECT id, regexp_extract_all(document, '{summary.WORD}') AS w, regexp_extract_all(substring(document, 1, {summary.WINDOW}), '{summary.WORD}') AS b FROM d),
 k AS (SELECT unnest(['License', 'the', 'MIT License', 'Der', 'nothing here']) AS name UNION SELECT array_to_string(w[1:1 + id // 50 % 8], ' ') FROM w WHERE id % 50 = 0 AND len(w) > 0),
 m AS (SELECT id, name FROM w, k WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || name || ' ')), u AS (SELECT id, unnest(b) AS name FROM w),
 o AS (SELECT id, name FROM u WHERE regexp_matches(name, '{summary.NAME}') AND len(name) > 2 AND NOT list_contains({_list(summary.NO_NAMES)}, name) GROUP BY 1, 2 HAVING count(*) >= 2), a AS (SELECT * FROM m UNION SELECT * FROM o),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS n FROM a) SELECT id, string_agg(name, ';' ORDER BY name) AS entities FROM r WHERE n <= 25 GROUP BY 1""")
def entity_metadata(s, d):
    """Some known names, and the first one to eight words of some texts."""
    words = F.slice(F.regexp_extract_all("document", F.lit(summary.WORD), F.lit(0)), F.lit(1), (F.expr("id div 50") % 8 + 1).cast("int"))
    begun = drawers(s, d).where("id % 50 = 0").select(F.array_join(words, " ").alias("name"))
    known = s.createDataFrame([("License",), ("the",), ("MIT License",), ("Der",), ("nothing here",)], "name string")
    return ingest.names_of(drawers(s, d), known.union(begun).distinct())


@query(f"WITH {D}, i AS (SELECT id, id % 7 AS k FROM d), e AS (SELECT id, unnest([id, (id + k) % (SELECT count(*) FROM documents), id + 100000000]) AS x, unnest([0, 1, 2]) AS place FROM i), f AS (SELECT id, x, min(place) AS place FROM e GROUP BY 1, 2) SELECT f.id AS index_id, place, CAST(x AS VARCHAR) AS drawer, document FROM f JOIN d ON d.id = x")
def pointed_drawers(s, d):
    n = read(s, d, "documents").count()
    lines = drawers(s, d).select("id", F.concat(F.lit("topic|A;B|→"), "id", F.lit(","), (F.col("id") + F.col("id") % 7) % n, F.lit("\nother||→"), F.col("id") + 100000000, F.lit(","), "id").alias("text"))
    return ingest.pointed_drawers(lines, drawers(s, d))


@query("SELECT page_id, 'wing_' || CASE page_id % 3 WHEN 0 THEN 'app' || page_id WHEN 1 THEN 'big_thing' ELSE 'sessions' END AS wing FROM pages")
def transcript_wings(s, d):
    k = F.col("page_id") % 3
    path = F.when(k == 0, F.concat(F.lit("/home/x/.claude/projects/-home-x-dev-App"), "page_id", F.lit("/s.jsonl"))).when(k == 1, F.lit("C:\\\\data\\\\-Projects-Big thing\\\\s.jsonl")).otherwise(F.col("url"))
    return read(s, d, "pages").select("page_id", ingest.wing_of_transcript(path).alias("wing"))


FAULTY = ["", "../", "   ", "(", ""]


@query(rf"""WITH s AS (SELECT doc_id, text, string_split_regex(text, '[.,]\s') AS a FROM documents), u AS (SELECT doc_id, text, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS piece FROM s),
 p AS (SELECT doc_id, text, CAST(piece AS INTEGER) AS piece, {_before('piece', 'x', FAULTY)} AS v FROM u), q AS (SELECT *, regexp_replace(v, '^\s+|\s+$', '', 'g') AS t FROM p)
 SELECT doc_id, piece, CASE WHEN t = '' THEN 'empty' WHEN len(t) > 128 THEN 'too long' WHEN contains(t, '..') OR contains(t, '/') OR contains(t, chr(92)) THEN 'path characters' WHEN NOT regexp_full_match(t, '[\p{{L}}\p{{N}}]|[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_ .''-]{{0,126}}[\p{{L}}\p{{N}}]') THEN 'characters' END AS name_fault,
 CASE WHEN t = '' THEN 'empty' WHEN len(t) > 128 THEN 'too long' END AS value_fault, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN len(text) > 100000 THEN 'too long' END AS content_fault FROM q""")
def faults(s, d):
    """A text is checked once, before it is cut: its pieces carry the result and not the text."""
    texts = read(s, d, "documents").select("doc_id", "text", checks.content_fault(F.col("text")).alias("content_fault"))
    pieces = texts.select("doc_id", "content_fault", F.posexplode(F.split("text", r"[.,]\s")).alias("piece", "__x"))
    v = _put_before("piece", "__x", FAULTY)
    return pieces.select("doc_id", "piece", checks.name_fault(v).alias("name_fault"), checks.value_fault(v).alias("value_fault"), "content_fault")


@query(f"WITH {D}, h AS (SELECT coalesce(wing, 'unknown') AS wing, coalesce(room, 'unknown') AS room, count(*) AS n FROM d GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY wing ORDER BY n DESC, room) AS INTEGER) AS rank FROM h")
def status_histogram(s, d):
    return collection.histogram(drawers(s, d))


@query(f"WITH {D} SELECT source_file, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, source_file LIMIT 15")
def dedup_top_sources(s, d):
    return collection.top_sources(collection.source_groups(drawers(s, d)))


@query(f"WITH {D} SELECT id FROM d ORDER BY id LIMIT 100")
def page_clamped(s, d):
    limit, offset = checks.page(5000, -3)
    return collection.get(drawers(s, d), limit=limit, offset=offset).select("id")


@query(f"WITH {K}, e AS (SELECT * FROM n WHERE id NOT LIKE 'k%') SELECT id, name FROM e UNION ALL SELECT DISTINCT object, object FROM t WHERE object NOT IN (SELECT id FROM e)")
def kg_entities_made(s, d):
    t, n = _kg(s, d)
    return kg.with_entities(n.where("id not like 'k%'"), t)


@query(f"WITH {K} SELECT subject, predicate, object, valid_from, 't_' || subject || '_' || predicate || '_' || object || '_' || substring(sha256(subject || '_' || predicate || '_' || object || coalesce(valid_from, '')), 1, 12) AS id FROM t")
def kg_triple_ids(s, d):
    return triples(s, d).select("subject", "predicate", "object", "valid_from", kg.triple_id(F.col("subject"), F.col("predicate"), F.col("object"), F.col("valid_from")).alias("id"))


@query(f"WITH {V} SELECT id, {SIX('list_sum(list_transform(u, lambda x: x * x))')} AS length, {SIX('u[1]')} AS first FROM (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v)")
def normalised_vectors(s, d):
    u = vectors(s, d).select("id", normalised(F.col("embedding")).alias("u"))
    return u.select("id", r6(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)).alias("length"), r6(F.col("u")[0]).alias("first"))


@query()
def embedded_texts(s, d):
    """Every text by the hashing embedder; no oracle, as it hashes with CRC-32."""
    return embed.embed(drawers(s, d).select("id", "document")).select("id", "embedding")


@query(f"WITH {D}, st AS (SELECT DISTINCT source_file FROM d WHERE (id // 5) % 3 = 0) SELECT id, source_file, document FROM d WHERE source_file NOT IN (SELECT * FROM st) UNION ALL SELECT id, source_file, upper(wing) FROM d WHERE source_file IN (SELECT * FROM st) AND chunk_index < 3")
def reingested(s, d):
    held = drawers(s, d).select("id", "source_file", "document")
    new = drawers(s, d).where("chunk_index < 3").select("id", "source_file", F.upper("wing").alias("document"))
    return incremental.reingest(held, new, drawers(s, d).where("(id div 5) % 3 = 0").select("source_file"))


@query(f"WITH {D} SELECT source_file, CAST(min(id) AS DOUBLE) AS mtime, 2 AS version, CAST(count_if(len(document) > 400) AS BIGINT) AS n_chunks FROM d GROUP BY 1")
def file_states(s, d):
    rows = drawers(s, d)
    return incremental.file_state(rows.groupBy("source_file").agg(F.min("id").cast("double").alias("mtime")), rows.where(F.length("document") > 400))


@query("""WITH e AS (SELECT conv_id, turn, text, sum(len(text)) OVER (PARTITION BY conv_id) AS size, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
 SELECT 'diary' || conv_id AS source_file, turn AS position FROM e WHERE conv_id % 4 = 3 OR (conv_id % 4 = 2 AND turn >= n - 1)""")
def diary_news(s, d):
    c = read(s, d, "conversations")
    size = c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("size"), F.count("*").alias("n"))
    e = c.join(size, "conv_id").select("conv_id", F.concat(F.lit("diary"), "conv_id").alias("source_file"), "size", F.col("turn").alias("position"), "n")
    old = F.col("conv_id") % 4
    state = incremental.diary_state(e).join(e.select("source_file", "conv_id", "n").distinct(), "source_file").where(old < 3).select("source_file", F.when(old == 2, F.col("size") - 1).otherwise(F.col("size")).alias("size"), F.when(old == 2, F.col("n") - 1).otherwise(F.col("n")).alias("entry_count"))
    return incremental.diary_news(e.drop("conv_id", "n"), state).select("source_file", "position")


@query(f"WITH {D} SELECT coalesce(wing, 'unknown') AS wing, count(DISTINCT coalesce(room, 'general')) AS rooms, count(*) AS drawers FROM d GROUP BY 1")
def export_stats(s, d):
    return collection.export_stats(drawers(s, d))


@query(f"WITH {D} SELECT source_file, string_agg(CAST(id AS VARCHAR), ',' ORDER BY chunk_index, id) AS drawer_ids, md5(string_agg(document, chr(10) || chr(10) ORDER BY chunk_index, id)) AS content FROM d WHERE wing = 'en' GROUP BY 1")
def regrouped_sources(s, d):
    return ingest.regrouped(drawers(s, d), "en").select("source_file", F.array_join("drawer_ids", ",").alias("drawer_ids"), F.md5("content").alias("content"))


@query(f"WITH {D} SELECT CAST(id AS VARCHAR) AS id, document, wing, CAST(chunk_index AS VARCHAR) AS chunk_index FROM d WHERE id % 5 <> 4")
def eav_join(s, d):
    """Rows of ids and rows of their attributes, joined and turned."""
    rows = drawers(s, d).selectExpr("id as row", "concat('', id) as embedding_id", "document", "wing", "chunk_index")
    of = lambda key, column, value: rows.selectExpr("row as id", f"'{key}' as key", *[(f"cast({value} as {t}) as {c}" if c == column else f"cast(null as {t}) as {c}") for c, t in (("string_value", "string"), ("int_value", "bigint"), ("float_value", "double"), ("bool_value", "boolean"))])
    attributes = of("chroma:document", "string_value", "document").unionByName(of("wing", "string_value", "wing")).unionByName(of("chunk_index", "int_value", "chunk_index")).unionByName(of("chroma:x", "string_value", "wing"))
    out = projects.pivot_joined(rows.where("chunk_index <> 4").select(F.col("row").alias("id"), "embedding_id"), attributes)
    return out.select("id", "document", F.col("metadata")["wing"].alias("wing"), F.col("metadata")["chunk_index"].alias("chunk_index"))


@query("SELECT conv_id, CAST(count_if(role = 'user' AND turn % 4 <> 2) AS BIGINT) AS n FROM conversations GROUP BY 1 HAVING count_if(role = 'user' AND turn % 4 <> 2) > 0")
def human_messages(s, d):
    c = read(s, d, "conversations")
    content = F.concat(F.when(F.col("turn") % 4 == 2, "<command-message>x</command-message> ").otherwise(""), F.col("text"))
    plain = F.to_json(F.struct(F.struct("role", content.alias("content")).alias("message")))
    event = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.concat("role", F.lit("_message")).alias("type"), content.alias("message")).alias("payload")))
    lines = c.select(F.col("conv_id").cast("string").alias("source_file"), F.when(F.col("turn") % 2 == 0, plain).otherwise(event).alias("line"))
    return chats.human_messages(lines).select(F.col("source_file").cast("long").alias("conv_id"), "n")


_LINE = "'  - ' || CASE WHEN len(f) > 200 THEN substring(f, 1, 197) || '...' ELSE f END || '  (' || source_file || ')'"


@query(f"""WITH {D}, b AS (SELECT *, trim(replace(document, chr(10), ' ')) AS f, row_number() OVER (ORDER BY n_chars DESC, id) AS place FROM d), l AS (SELECT coalesce(room, 'general') AS room, place, {_LINE} AS line FROM b WHERE place <= 15),
 h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY room ORDER BY place) = 1 THEN chr(10) || '[' || room || ']' ELSE '' END AS head FROM l), u AS (SELECT *, sum(len(head) + len(line)) OVER (ORDER BY room, place) AS used FROM h),
 o AS (SELECT *, sum(CAST(used > 1500 AS INT)) OVER (ORDER BY room, place) AS ov FROM u), t AS (SELECT room, place, CASE WHEN used > 1500 THEN '  ... (more in a search)' ELSE line END AS s, head FROM o WHERE ov <= 1)
 SELECT '## Essential story' || chr(10) || string_agg(CASE WHEN head <> '' THEN head || chr(10) ELSE '' END || s, chr(10) ORDER BY room, place) AS story FROM t""")
def wake_up_story(s, d):
    return context.story(drawers(s, d), "n_chars", 15, 1500)


@query(f"WITH {D}, b AS (SELECT id, room, source_file, trim(replace(document, chr(10), ' ')) AS f FROM d WHERE wing = 'fr' AND room = 'src2' ORDER BY id LIMIT 10) SELECT id, '  [' || room || '] ' || CASE WHEN len(f) > 300 THEN substring(f, 1, 297) || '...' ELSE f END || '  (' || source_file || ')' AS line FROM b")
def on_demand(s, d):
    return context.on_demand(drawers(s, d), "fr", "src2")


@query("""WITH l AS (SELECT conv_id, turn, text, starts_with(text, 'T') AS h, contains(text, 'the') AS r FROM conversations), m AS (SELECT *, max(CAST(r AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS near FROM l)
 SELECT conv_id, turn, CAST(count_if(h AND near = 0) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS session FROM m""")
def session_restores(s, d):
    rows = transcript.sessions(read(s, d, "conversations"), "^T", "conv_id", "turn", "text", restored="the", within=2)
    return rows.select("conv_id", "turn", "session")


@query(f"WITH {V} SELECT id, name, type FROM (SELECT 'e' || id AS id, 'Entity ' || id AS name, CASE WHEN label < 5 THEN 'person' ELSE 'project' END AS type FROM v) WHERE type = 'person' ORDER BY id LIMIT 100")
def entities_listed(s, d):
    known = vectors(s, d).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("Entity "), "id").alias("name"), F.when(F.col("label") < 5, "person").otherwise("project").alias("type"))
    return kg.list_entities(known, "person")


@query("""SELECT replace(lower(c_name), ' ', '_') AS id, c_name AS name, 'person' AS type, CASE WHEN c_custkey % 2 = 0 THEN 'relationship: ' || c_mktsegment ELSE '' END || CASE WHEN c_custkey % 6 = 0 THEN '; ' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN 'context: home, n' || c_nationkey ELSE '' END AS description FROM customer WHERE c_custkey % 5 <> 0""")
def entities_from_registry(s, d):
    k = F.col("c_custkey")
    rows = read(s, d, "customer").select(
        F.col("c_name").alias("name"), F.lit("person").alias("kind"), F.when(k % 5 == 0, "Other").alias("canonical"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("relationship"), F.when(k % 3 == 0, F.array(F.lit("home"), F.concat(F.lit("n"), "c_nationkey"))).otherwise(F.array().cast("array<string>")).alias("contexts")
    )
    return kg.from_registry(rows)


# --- plain relational ------------------------------------------------------------------------------------------------


@query(f"""SELECT o_orderpriority, count(*) AS n, {SIX('sum(l_extendedprice * (1 - l_discount)) / 1e6')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1""")
def tpch_join_agg(s, d):
    li = read(s, d, "lineitem").where("l_shipdate < timestamp '1998-09-02'").select("l_orderkey", "l_extendedprice", "l_discount")
    o = read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = read(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6).alias("revenue"))


ORACLES |= {name: sql() for name, sql in LATER.items()}
