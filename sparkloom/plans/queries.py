"""The core's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import stats, text
from sparkloom.functions.shared import materialize
from sparkloom.operators import batches, explorer, findings, graph, proposals, retrieval, sections, validation
from sparkloom.plans import pipeline
from sparkloom.schema import ENDS, TO_CONCEPT, Graph
from sparkloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Tables of the graph, each node and edge once; WITH parts the queries below put together.
E = "e AS (SELECT DISTINCT ON (id) * FROM edges)"
S = "s AS (SELECT DISTINCT ON (id) * FROM sections)"
D = "d AS (SELECT DISTINCT ON (id) * FROM docs)"
A = "a AS (SELECT DISTINCT ON (id) * FROM answers)"
Q = "q AS (SELECT DISTINCT ON (number) 'q:' || number AS id, number, title, body, created_at, url, answered FROM discussions)"
SC = "sc AS (SELECT DISTINCT src AS section, dst AS concept FROM e WHERE type IN ('DEFINES', 'REQUIRES', 'MENTIONS'))"
WORDS = ", ".join(f"'{w}'" for w in text.PYTHON_WORDS)
SCOPE = f"""scope AS (SELECT id, label, kind FROM concepts WHERE NOT (
  trim(lower(label)) IN ({", ".join(f"'{w}'" for w in text.ELSEWHERE)})
  OR len(list_filter(regexp_split_to_array(lower(label), '[^a-z0-9_]+'), lambda x: x <> '')) = 0
  OR len(list_filter(regexp_split_to_array(lower(label), '[^a-z0-9_]+'), lambda x: x <> '' AND x NOT IN ({WORDS}))) = 0))"""
CC = """cc AS (SELECT dst AS concept, count(*) FILTER (type = 'DEFINES') AS defines_count, count(*) FILTER (type = 'REQUIRES') AS requires_count,
  count(*) FILTER (type = 'MENTIONS') AS mentions_count, count(*) FILTER (type = 'ASKS_ABOUT') AS demand,
  coalesce(bool_or(evidence.kind = 'prose' AND type IN ('REQUIRES', 'MENTIONS')), false) AS in_prose
  FROM e WHERE type IN ('DEFINES', 'REQUIRES', 'MENTIONS', 'ASKS_ABOUT') GROUP BY dst)"""
NM = "nm AS (SELECT cc.*, scope.label, scope.kind FROM cc JOIN scope ON scope.id = cc.concept WHERE demand > 0 AND requires_count > 0 AND defines_count = 0)"
SIM = """tok AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM s),
  atok AS (SELECT DISTINCT question_id AS q, unnest(regexp_extract_all(lower(coalesce(body, '')), '[a-z]{4,}')) AS w FROM a)"""

# Comparison form of a text; texts by lines with the place of each line in the joined form, and the joined form itself.
NORM = r"lower(trim(regexp_replace(translate({0}, '’‘“”–—', chr(39) || chr(39) || chr(34) || chr(34) || '--'), '\s+', ' ', 'g')))"
TEXTS = f"""tx AS (SELECT id, 0 AS k, path, lines.start AS first, text FROM s UNION ALL SELECT id, CAST(k AS INT), c.path, c.lines.start, c.text FROM (SELECT id, unnest(code) AS c, generate_subscripts(code, 1) AS k FROM s)),
ln AS (SELECT id, k, path, first + n - 1 AS no, {NORM.format('line')} AS line FROM (SELECT id, k, path, first, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM tx)),
lp AS (SELECT *, greatest(0, sum(length(line) + 1) OVER (PARTITION BY id, k ORDER BY no) - length(line) - 2) AS off FROM ln WHERE line <> ''),
fl AS (SELECT id, k, path, string_agg(line, ' ' ORDER BY no) AS flat FROM lp GROUP BY id, k, path)"""
RAW = """th AS (SELECT DISTINCT ON (number) * FROM discussions), raw AS (SELECT number, regexp_replace('# ' || coalesce(title, '') || chr(10) || chr(10) || 'Source: ' || coalesce(url, '') || chr(10) || chr(10) || '## Question' || chr(10) || chr(10) || coalesce(body, '') || chr(10)
|| CASE WHEN answer IS NULL THEN '' ELSE chr(10) || '## Accepted answer by ' || coalesce(answer.author, 'unknown') || chr(10) || chr(10) || coalesce(answer.body, '') || chr(10) END, chr(13) || chr(10) || '?', chr(10), 'g') AS raw FROM th)"""
# Edges with faults in one of fifty each: a blank span, a missing end, a wrong type, lines beyond the page, a span from elsewhere, and some turned round.
FAULTY = """fe AS (SELECT id, CASE n WHEN 2 THEN 'USES' ELSE type END AS type, src, CASE n WHEN 1 THEN 'concept:gone' ELSE dst END AS dst, CASE n WHEN 0 THEN ' ' WHEN 4 THEN 'these words stand nowhere at all' ELSE evidence.span END AS span, evidence.path AS path,
  evidence.lines.start + CASE n WHEN 3 THEN 5000 ELSE 0 END AS lo, evidence.lines."end" + CASE n WHEN 3 THEN 5000 ELSE 0 END AS hi FROM (SELECT *, CAST(regexp_extract(id, '[0-9]+') AS BIGINT) % 50 AS n FROM e)
  UNION ALL SELECT id || '-back', type, dst, src, evidence.span, evidence.path, evidence.lines.start, evidence.lines."end" FROM e WHERE CAST(regexp_extract(id, '[0-9]+') AS BIGINT) % 50 = 5)"""


def number_of(c: str) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).cast("bigint")


def faulty(g: Graph) -> Graph:
    n, e = number_of("id") % 50, F.col("evidence")
    more = F.when(n == 3, 5000).otherwise(0)
    lines = F.struct((e["lines"]["start"] + more).cast("int").alias("start"), (e["lines"]["end"] + more).cast("int").alias("end"))
    proof = F.struct(F.when(n == 0, " ").when(n == 4, "these words stand nowhere at all").otherwise(e["span"]).alias("span"), e["path"].alias("path"), lines.alias("lines"), e["kind"].alias("kind"))
    bad = g.edges.withColumns({"type": F.when(n == 2, "USES").otherwise(F.col("type")), "dst": F.when(n == 1, "concept:gone").otherwise(F.col("dst")), "evidence": proof})
    back = g.edges.where(n == 5).withColumns({"id": F.concat("id", F.lit("-back")), "src": F.col("dst"), "dst": F.col("src")})
    return Graph(g.docs, g.sections, g.concepts, g.questions, g.answers, bad.unionByName(back))


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def answer_similarity(g: Graph, pairs: DataFrame) -> DataFrame:
    """Jaccard of the words of a question's answer and of a section, for the given pairs."""
    bag = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)))
    a = g.answers.select(F.col("question_id").alias("question"), bag(F.coalesce("body", F.lit(""))).alias("a"))
    s = g.sections.select(F.col("id").alias("section"), bag(F.col("text")).alias("s"))
    both = pairs.join(a, "question").join(s, "section")
    shared = F.size(F.array_intersect("a", "s"))
    return both.select(F.col("question").alias("question_id"), F.col("section").alias("section_id"), (shared / F.nullif(F.size("a") + F.size("s") - shared, F.lit(0))).alias("sim"))


# ---- finders -------------------------------------------------------------------------------


@query(f"""WITH {E}, {S}, {A}, {Q}, {SC}, {SCOPE}, {CC}, {NM},
asks AS (SELECT src AS q, dst AS x FROM e WHERE type = 'ASKS_ABOUT'),
topics AS (SELECT DISTINCT nm.concept, b.x FROM nm JOIN asks a1 ON a1.x = nm.concept JOIN asks b ON b.q = a1.q WHERE b.x <> nm.concept),
shared AS (SELECT r.dst AS concept, r.src AS section, count(DISTINCT t.x) AS n, list_sort(list(DISTINCT t.x)) AS l FROM e r JOIN sc ON sc.section = r.src JOIN topics t ON t.concept = r.dst AND t.x = sc.concept WHERE r.type = 'REQUIRES' GROUP BY ALL),
width AS (SELECT section, count(*) AS w FROM sc GROUP BY section),
req AS (SELECT r.dst AS concept, r.src AS section, r.id, r.evidence.kind AS ek, coalesce(sh.l, []) AS l, row_number() OVER (PARTITION BY r.dst ORDER BY coalesce(sh.n, 0) DESC, CASE WHEN r.evidence.kind = 'prose' THEN 1 ELSE 0 END DESC,
  CASE r.confidence WHEN 'high' THEN 2 WHEN 'low' THEN 0 ELSE 1 END DESC, width.w DESC, r.src) AS rn
  FROM e r JOIN nm ON nm.concept = r.dst LEFT JOIN shared sh ON sh.concept = r.dst AND sh.section = r.src JOIN width ON width.section = r.src WHERE r.type = 'REQUIRES'),
askers AS (SELECT k.dst AS concept, list(k.src ORDER BY coalesce(CAST(a.is_maintainer AS INT), 0) DESC, coalesce(length(a.body), 0) DESC, k.src) AS questions FROM e k JOIN nm ON nm.concept = k.dst
  LEFT JOIN e w ON w.type = 'ANSWERED_BY' AND w.src = k.src LEFT JOIN a ON a.id = w.dst WHERE k.type = 'ASKS_ABOUT' GROUP BY k.dst),
others AS (SELECT r.dst AS concept, r.src AS section FROM e r JOIN nm ON nm.concept = r.dst WHERE r.type = 'REQUIRES')
SELECT 'F1-' || lpad(CAST(row_number() OVER (ORDER BY nm.demand DESC, nm.requires_count DESC, nm.concept) AS VARCHAR), 4, '0') AS id, nm.demand, nm.concept, nm.label AS concept_label, nm.kind AS concept_kind, req.section,
  req.id AS requires_edge, array_to_string(askers.questions, ',') AS questions, array_to_string(req.l[1:12], ',') AS shared_concepts, (SELECT count(*) FROM others o WHERE o.concept = nm.concept AND o.section <> req.section) AS other_sections,
  nm.mentions_count, nm.requires_count, coalesce(req.ek, 'prose') AS requires_evidence_kind, NOT nm.in_prose AS code_samples_only, (SELECT count(*) FROM s) AS sections_checked
FROM nm JOIN req ON req.concept = nm.concept AND req.rn = 1 JOIN askers ON askers.concept = nm.concept""")
def f1_near_miss(spark, d):
    f = findings.near_misses(Graph.read(spark, d).written())
    return f.select(
        "id", "demand", "concept", "concept_label", "concept_kind", "section", F.col("proof_path")[1]["edge"].alias("requires_edge"), F.array_join("questions", ",").alias("questions"), F.array_join("shared_concepts", ",").alias("shared_concepts"),
        F.size("other_requiring_sections").cast("bigint").alias("other_sections"), "mentions_count", "requires_count", "requires_evidence_kind", "code_samples_only", F.col("proof_path")[2]["sections_checked"].alias("sections_checked"),
    )


@query(f"""WITH {E}, {S}, {SCOPE}, {CC}, {NM},
u AS (SELECT dst AS concept, count(*) AS n, list_extract(list(src ORDER BY type, src), 1) AS section, count(DISTINCT src) AS sections, list_slice(list(id ORDER BY type, src), 1, 6) AS ids FROM e WHERE type IN ('REQUIRES', 'MENTIONS') GROUP BY dst)
SELECT 'F2-' || lpad(CAST(row_number() OVER (ORDER BY cc.demand DESC, u.n DESC, cc.concept) AS VARCHAR), 4, '0') AS id, cc.demand, cc.concept, u.section, s.heading AS section_heading, array_to_string(u.ids, ',') AS proof_edges,
  u.sections AS sections_referencing, cc.requires_count, cc.mentions_count, u.n AS in_edges_total, NOT cc.in_prose AS code_samples_only
FROM cc JOIN scope ON scope.id = cc.concept JOIN u ON u.concept = cc.concept LEFT JOIN s ON s.id = u.section WHERE cc.defines_count = 0 AND u.sections >= 2 AND cc.concept NOT IN (SELECT concept FROM nm)""")
def f2_orphan(spark, d):
    f = findings.orphans(Graph.read(spark, d).written())
    steps = F.filter(F.transform("proof_path", lambda p: p["edge"]), lambda x: x.isNotNull())
    return f.select("id", "demand", "concept", "section", "section_heading", F.array_join(steps, ",").alias("proof_edges"), F.size("sections_referencing").cast("bigint").alias("sections_referencing"), "requires_count", "mentions_count", "in_edges_total", "code_samples_only")


OVERLAP = f"""WITH {E}, {S}, {A}, {SC},
ov AS (SELECT a.src AS question, sc.section, count(*) AS overlap FROM (SELECT DISTINCT src, dst FROM e WHERE type = 'ASKS_ABOUT') a JOIN sc ON sc.concept = a.dst GROUP BY ALL HAVING count(*) >= 2)"""


@query(OVERLAP + " SELECT question, section, overlap FROM ov")
def j7_concept_overlap(spark, d):
    return findings.overlaps(Graph.read(spark, d).written().edges).select("question", "section", F.col("overlap").cast("bigint").alias("overlap"))


COMPETE = OVERLAP + """,
best AS (SELECT *, max(overlap) OVER (PARTITION BY question) AS top FROM ov),
near AS (SELECT question, section, overlap, row_number() OVER (PARTITION BY question ORDER BY overlap DESC, section) AS place FROM best WHERE overlap >= top * 0.8),
comp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY question) AS among FROM near WHERE place <= 5) WHERE among > 1)"""


@query(COMPETE + " SELECT question, section, overlap, place FROM comp")
def w6_competing_sections(spark, d):
    return findings.competing(Graph.read(spark, d).written().edges).select("question", "section", F.col("overlap").cast("bigint").alias("overlap"), F.col("place").cast("bigint").alias("place"))


@query(COMPETE + f""", {SIM},
tn AS (SELECT id, count(*) AS n FROM tok GROUP BY id), an AS (SELECT q, count(*) AS n FROM atok GROUP BY q),
sh AS (SELECT c.question, c.section, count(*) AS n FROM comp c JOIN atok ON atok.q = c.question JOIN tok ON tok.id = c.section AND tok.w = atok.w GROUP BY ALL),
sim AS (SELECT c.*, CASE WHEN a.id IS NULL OR coalesce(an.n, 0) + coalesce(tn.n, 0) - coalesce(sh.n, 0) = 0 THEN NULL ELSE coalesce(sh.n, 0) / CAST(coalesce(an.n, 0) + coalesce(tn.n, 0) - coalesce(sh.n, 0) AS DOUBLE) END AS sim
  FROM comp c LEFT JOIN a ON a.question_id = c.question LEFT JOIN an ON an.q = c.question LEFT JOIN tn ON tn.id = c.section LEFT JOIN sh ON sh.question = c.question AND sh.section = c.section),
ok AS (SELECT * FROM (SELECT *, bool_or(sim IS NULL) OVER (PARTITION BY question) AS unknown FROM sim) WHERE NOT unknown),
h AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, place) AS h FROM ok),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY CASE WHEN h = 1 THEN 1 ELSE 0 END, overlap DESC, sim, place) AS r FROM h),
p AS (SELECT x.question, x.section AS hs, y.section AS rs, x.sim AS hsim, y.sim AS rsim, x.overlap AS ho, y.overlap AS ro FROM r x JOIN r y ON y.question = x.question AND x.h = 1 AND y.r = 1 WHERE y.overlap >= x.overlap AND x.sim - y.sim >= 0.02),
g AS (SELECT least(hs, rs) AS lo, greatest(hs, rs) AS hi, min(question) AS sample_question, count(DISTINCT question) AS demand FROM p GROUP BY ALL)
SELECT 'F3-' || lpad(CAST(row_number() OVER (ORDER BY g.demand DESC, p.rs, g.sample_question, p.hs) AS VARCHAR), 4, '0') AS id, g.demand, p.rs AS section, p.hs AS holder_section, round(p.hsim, 4) AS holder_similarity, round(p.rsim, 4) AS rival_similarity, p.ho AS holder_overlap, p.ro AS rival_overlap, g.sample_question
FROM g JOIN p ON p.question = g.sample_question AND least(p.hs, p.rs) = g.lo AND greatest(p.hs, p.rs) = g.hi""")
def f3_collision(spark, d):
    g = Graph.read(spark, d).written()
    rivals = materialize(findings.competing(g.edges), "competing")
    f = findings.collisions(g, answer_similarity(g, rivals.select("question", "section")), rivals)
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return f.select("id", "demand", "section", "holder_section", "holder_similarity", "rival_similarity", long("holder_overlap"), long("rival_overlap"), "sample_question")


def all_findings(g: Graph) -> DataFrame:
    rivals = materialize(findings.competing(g.edges), "competing")
    return findings.findings(g, answer_similarity(g, rivals.select("question", "section")), rivals)


FOUND_ALL = f"""SELECT 'near_miss' AS type, id, demand, concept, section FROM ({SQL['f1_near_miss']}) UNION ALL SELECT 'orphan_concept', id, demand, concept, section FROM ({SQL['f2_orphan']}) UNION ALL SELECT 'retrieval_collision', id, demand, NULL, section FROM ({SQL['f3_collision']})"""


@query(FOUND_ALL)
def o1_all_findings(spark, d):
    return all_findings(Graph.read(spark, d).written()).select("type", "id", "demand", "concept", "section")


def m1_manifest(spark, d):
    g = Graph.read(spark, d).written()
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(c)
    return pipeline.manifest(g, all_findings(g)).select(said("nodes"), said("edges"), said("findings"), "defined", "required", "orphan", "in_two_sections", "isolated")


@query(f"""WITH x AS (SELECT 'near_miss' AS type, concept FROM ({SQL['f1_near_miss']}) UNION ALL SELECT 'orphan_concept', concept FROM ({SQL['f2_orphan']})), k AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'ASKS_ABOUT'),
c AS ({SQL['f3_collision'].split('SELECT ' + chr(39) + 'F3-')[0].replace(chr(10) + 'g AS', chr(10) + 'unused AS')} SELECT DISTINCT question FROM p)
SELECT type, count(DISTINCT src) AS threads FROM x JOIN k ON k.dst = x.concept GROUP BY type UNION ALL SELECT 'retrieval_collision', count(*) FROM c HAVING count(*) > 0""")
def a18_threads_reached(spark, d):
    return pipeline.reached(all_findings(Graph.read(spark, d).written()))


# ---- retrieval -----------------------------------------------------------------------------

SEEDS = f"""WITH {E},
asks AS (SELECT src AS question, dst AS concept FROM e WHERE type = 'ASKS_ABOUT'),
defined AS (SELECT DISTINCT dst FROM e WHERE type = 'DEFINES'),
per AS (SELECT dst AS concept, src AS section, sum(CASE WHEN type = 'DEFINES' THEN 3 ELSE 1 END) AS score FROM e WHERE type = 'DEFINES' OR (type IN ('REQUIRES', 'MENTIONS') AND dst NOT IN (SELECT dst FROM defined)) GROUP BY ALL),
seed AS (SELECT question, section, CAST(sum(score) AS BIGINT) AS score FROM asks JOIN per USING (concept) GROUP BY ALL)"""


@query(SEEDS + " SELECT * FROM seed")
def a14_seed_scores(spark, d):
    return retrieval.seeds(Graph.read(spark, d).written().edges)


HOPS = SEEDS + """,
sr AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, section) AS rank FROM seed),
hop AS (SELECT t.question, g.src AS section, count(*) AS score FROM sr t JOIN e n ON n.type = 'REQUIRES' AND n.src = t.section JOIN e g ON g.type = 'DEFINES' AND g.dst = n.dst
  WHERE t.rank <= 3 AND NOT EXISTS (SELECT 1 FROM sr z WHERE z.question = t.question AND z.rank <= 3 AND z.section = g.src) GROUP BY ALL)"""


@query(HOPS + " SELECT * FROM hop")
def a15_hop_scores(spark, d):
    e = Graph.read(spark, d).written().edges
    return retrieval.hops(e, retrieval.best_seeds(e, 3))


@query(HOPS + """,
hr AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, section) AS rank FROM hop),
b AS (SELECT question, section, rank, 0 AS hop FROM sr WHERE rank <= 5 UNION ALL SELECT question, section, rank, 1 FROM hr WHERE rank <= 5),
c AS (SELECT *, sum(1 - hop) OVER (PARTITION BY question) AS ns, sum(hop) OVER (PARTITION BY question) AS nh FROM b),
k AS (SELECT question, section, min(hop * 100 + rank) AS pos FROM c WHERE rank <= CASE WHEN hop = 0 THEN CASE WHEN nh < 2 THEN 5 - nh ELSE 3 END ELSE CASE WHEN nh >= 2 AND ns < 3 THEN 5 - ns ELSE 2 END END GROUP BY ALL)
SELECT question, array_to_string(list_slice(list(section ORDER BY pos, section), 1, 5), ',') AS sections FROM k GROUP BY question""")
def r2_graph_retrieval(spark, d):
    return retrieval.graph_retrieval(Graph.read(spark, d).written().edges).select("question", F.array_join("sections", ",").alias("sections"))


@query(f"""WITH {E}, k AS (SELECT src AS question, dst AS concept FROM e WHERE type = 'ASKS_ABOUT'), i AS (SELECT dst AS concept, count(*) FILTER (type = 'DEFINES') AS d, count(DISTINCT src) FILTER (type <> 'DEFINES') AS u FROM e WHERE type IN ('DEFINES', 'REQUIRES', 'MENTIONS') GROUP BY dst),
t AS (SELECT question, k.concept, CASE WHEN coalesce(d, 0) > 0 THEN question || ' ASKS_ABOUT ' || k.concept || ': defined by ' || d || ' section(s)' ELSE question || ' ASKS_ABOUT ' || k.concept || ': no definition, used by ' || coalesce(u, 0) || ' section(s)' END AS step FROM k LEFT JOIN i ON i.concept = k.concept) SELECT question, string_agg(step, chr(10) ORDER BY concept, step) AS steps FROM t GROUP BY question""")
def r2_traversal_steps(spark, d):
    return retrieval.traversal(Graph.read(spark, d).edges).select("question", F.array_join("steps", "\n").alias("steps"))


def vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    v = rows(spark, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vector"))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM p) SELECT query_id, item_id, round(s, 4) AS score, rank FROM r WHERE rank <= 5""")
def r1_vector_top5(spark, d):
    return retrieval.vector_top_k(*vectors(spark, d)).select("query_id", "item_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH v AS (SELECT question, list_sort(list(section)) AS v FROM (SELECT question, section, row_number() OVER (PARTITION BY question ORDER BY overlap DESC, section) AS r FROM ({SQL['j7_concept_overlap']})) WHERE r <= 5 GROUP BY question), g AS (SELECT question, string_split(sections, ',') AS g FROM ({SQL['r2_graph_retrieval']})),
b AS (SELECT coalesce(v, []) AS v, coalesce(g, []) AS g FROM v FULL JOIN g USING (question)) SELECT count(*) AS questions, count(*) FILTER (len(g) = 0) AS graph_empty, count(*) FILTER (v = list_sort(g)) AS identical, count(*) FILTER (len(list_filter(g, lambda x: NOT list_contains(v, x))) > 0) AS graph_reached_new FROM b""")
def a16_retrieval_overlap(spark, d):
    e = Graph.read(spark, d).written().edges
    by_overlap = findings.best_overlaps(e, 5).groupBy("question").agg(F.array_sort(F.collect_list("section")).alias("sections"))
    return retrieval.retrieval_overlap(by_overlap, retrieval.graph_retrieval(e))


VERDICTS = """v AS (SELECT id AS question_id, CASE number % 7 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong_confident' WHEN 2 THEN NULL ELSE 'declined' END AS vector,
  CASE number % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong_confident' ELSE 'declined' END AS graph FROM q)"""


def verdicts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Verdicts by a rule on thread numbers, the tables having none."""
    q = Graph.read(spark, d).questions
    pick = lambda n, *w: F.element_at(F.array(*[F.lit(x) for x in w]), (F.col("number") % n + 1).cast("int"))
    v = q.select(F.col("id").alias("question_id"), F.lit("vector").alias("path"), pick(7, "correct", "wrong_confident", None, "declined", "declined", "declined", "declined").alias("verdict")).where("verdict IS NOT NULL")
    g = q.select(F.col("id").alias("question_id"), F.lit("graph").alias("path"), pick(5, "correct", "wrong_confident", "declined", "declined", "declined").alias("verdict"))
    return q.select(F.col("id").alias("question_id")), v.unionByName(g)


@query(f"""WITH {Q}, {VERDICTS} SELECT count(*) AS n, count(*) FILTER (vector = 'correct') AS vector_correct, count(*) FILTER (vector IS NULL) AS vector_unscored, count(*) FILTER (graph = 'declined') AS graph_declined,
  count(*) FILTER (coalesce(vector, '') = 'correct' AND graph <> 'correct') AS vector_only, count(*) FILTER (coalesce(vector, '') <> 'correct' AND graph = 'correct') AS graph_only, count(*) FILTER (vector = 'correct' AND graph = 'correct') AS both,
  round(count(*) FILTER (vector = 'correct') / CAST(count(vector) AS DOUBLE), 4) AS vector_correct_rate FROM v""")
def c1_comparison(spark, d):
    c = retrieval.compare(*verdicts(spark, d))
    return c.select("n", "vector_correct", "vector_unscored", "graph_declined", "vector_only", "graph_only", "both", "vector_correct_rate")


REPLIES = """rp AS (SELECT 'q:' || number AS question_id, CASE number % 4 WHEN 0 THEN '{"answer": " yes ' || number || ' "}' WHEN 1 THEN '  plain ' || number || chr(10) WHEN 2 THEN '{"answer": " "}' ELSE '{"other": 1}' END AS reply, CASE number % 4 WHEN 0 THEN 'yes ' || number WHEN 1 THEN 'plain ' || number END AS answer FROM q)"""


def replies(spark, d) -> DataFrame:
    """Replies of a model by a rule on thread numbers: objects, texts, blank ones and objects without an answer."""
    n = F.col("number")
    made = F.when(n % 4 == 0, F.concat(F.lit('{"answer": " yes '), n, F.lit(' "}'))).when(n % 4 == 1, F.concat(F.lit("  plain "), n, F.lit("\n"))).when(n % 4 == 2, '{"answer": " "}').otherwise('{"other": 1}')
    return Graph.read(spark, d).questions.select(F.col("id").alias("question_id"), made.alias("reply"))


@query(f"WITH {Q}, {REPLIES} SELECT question_id, answer FROM rp WHERE answer IS NOT NULL")
def pr3_generated_answers(spark, d):
    return retrieval.generated(replies(spark, d))


@query(f"WITH {Q}, {REPLIES} SELECT id AS question_id, number FROM q JOIN rp ON rp.question_id = q.id WHERE answer IS NOT NULL OR number % 6 = 2")
def pr4_scorable_questions(spark, d):
    """Questions answered by the replies, or by another way that answers every sixth thread."""
    q = Graph.read(spark, d).questions.select(F.col("id").alias("question_id"), "number")
    return retrieval.scorable(q, retrieval.generated(replies(spark, d)), q.where("number % 6 = 2"))


@query("WITH t AS (SELECT DISTINCT ON (number) number, title FROM discussions) SELECT number, title, row_number() OVER (ORDER BY number DESC) AS place FROM t")
def s15_newest_threads(spark, d):
    return files.newest(rows(spark, d, "discussions").select("number", "title").dropDuplicates(["number"]))


@query(f"WITH {Q}, {VERDICTS}, u AS (SELECT 'vector' AS path, coalesce(vector, 'unscored') AS verdict FROM v UNION ALL SELECT 'graph', graph FROM v) SELECT path, verdict, count(*) AS n FROM u GROUP BY ALL")
def a9_verdict_histogram(spark, d):
    q, v = verdicts(spark, d)
    every = q.crossJoin(spark.createDataFrame([("vector",), ("graph",)], "path string"))
    return every.join(v, ["question_id", "path"], "left").fillna("unscored", ["verdict"]).groupBy("path", "verdict").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT s_suppkey % 12 AS a, s_nationkey AS b FROM supplier), u AS (SELECT DISTINCT a, b FROM t)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(0, CAST(least(a, b) AS BIGINT) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2.0))))) END, 4) AS p FROM u""")
def st1_mcnemar(spark, d):
    t = rows(spark, d, "supplier").select((F.col("s_suppkey") % 12).cast("bigint").alias("a"), F.col("s_nationkey").cast("bigint").alias("b")).distinct()
    return t.select("a", "b", F.round(stats.mcnemar(F.col("a"), F.col("b")), 4).alias("p"))


@query("""WITH t AS (SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT *, CAST(s AS DOUBLE) / n AS p, 1.959963984540054 AS z FROM t)
SELECT priority, s, n, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 0), 4) AS low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 1), 4) AS high FROM w""")
def st2_wilson(spark, d):
    t = rows(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count("*").alias("n"))
    return t.select("*", stats.wilson(F.col("s"), F.col("n")).alias("w")).select("priority", "s", "n", "w.low", "w.high")


# ---- graph counts and integrity ------------------------------------------------------------


@query(f"WITH {E}, {CC} SELECT * FROM cc")
def a3_concept_counts(spark, d):
    return findings.concept_counts(Graph.read(spark, d).edges)


@query(f"WITH {E} SELECT type, count(*) AS n FROM e GROUP BY type")
def a2_edges_by_type(spark, d):
    return Graph.read(spark, d).edges.groupBy("type").agg(F.count("*").alias("n"))


NODES = "n AS (SELECT id, 'Doc' AS kind FROM d UNION ALL SELECT id, 'Section' FROM s UNION ALL SELECT id, 'Concept' FROM concepts UNION ALL SELECT id, 'Question' FROM q UNION ALL SELECT id, 'Answer' FROM a)"


@query(f"WITH {D}, {S}, {Q}, {A}, {NODES} SELECT kind, count(*) AS n FROM n GROUP BY kind")
def a2_nodes_by_type(spark, d):
    return graph.nodes(Graph.read(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, {D}, {S}, {Q}, {A}, {CC}, {NODES}, sp AS (SELECT dst AS concept, count(DISTINCT src) AS k FROM e WHERE type IN ('DEFINES', 'REQUIRES', 'MENTIONS') GROUP BY dst)
SELECT count(*) FILTER (cc.defines_count > 0) AS defined, count(*) FILTER (cc.requires_count > 0) AS required, count(*) FILTER (coalesce(cc.defines_count, 0) = 0) AS orphan, count(*) FILTER (sp.k >= 2) AS in_two_sections,
(SELECT count(*) FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)) AS isolated FROM concepts c LEFT JOIN cc ON cc.concept = c.id LEFT JOIN sp ON sp.concept = c.id""")
def a4_sanity(spark, d):
    return graph.sanity(Graph.read(spark, d))


def said(table: str, key: str) -> str:
    return f"(SELECT string_agg({key} || '=' || n, ',' ORDER BY {key}) FROM ({table}))"


query(f"""SELECT {said(SQL['a2_nodes_by_type'], 'kind')} AS nodes, {said(SQL['a2_edges_by_type'], 'type')} AS edges, {said(f'SELECT type, count(*) AS n FROM ({FOUND_ALL}) GROUP BY type', 'type')} AS findings, x.* FROM ({SQL['a4_sanity']}) x""")(m1_manifest)


@query(f"WITH {E}, {D}, {S}, {Q}, {A}, {NODES}, k AS (SELECT * FROM e WHERE type = 'ASKS_ABOUT') SELECT id, kind FROM n WHERE id NOT IN (SELECT src FROM k UNION SELECT dst FROM k)")
def j15_isolated_nodes(spark, d):
    """Nodes that no question's edge touches."""
    g = Graph.read(spark, d)
    return graph.isolated(Graph(g.docs, g.sections, g.concepts, g.questions, g.answers, findings.of_type(g.edges, "ASKS_ABOUT")))


@query(f"WITH {E}, {FAULTY}, {D}, {S}, {Q}, {A}, {NODES}, x AS (SELECT id AS edge, src AS missing FROM fe UNION ALL SELECT id, dst FROM fe) SELECT edge, missing FROM x WHERE missing NOT IN (SELECT id FROM n)")
def j13_dangling_ends(spark, d):
    return graph.dangling(faulty(Graph.read(spark, d)))


@query(f"WITH {E} SELECT id, label FROM concepts WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)")
def j14_used_concepts(spark, d):
    g = Graph.read(spark, d)
    return graph.used_concepts(g.concepts, g.edges).select("id", "label")


@query(f"WITH {E}, {FAULTY} SELECT id, type FROM fe WHERE NOT coalesce(length(trim(span)) > 0 AND length(path) > 0 AND lo >= 1 AND lo <= hi, false)")
def i1_without_evidence(spark, d):
    return graph.without_evidence(faulty(Graph.read(spark, d)).edges)


@query(f"WITH {E} SELECT type, count(DISTINCT split_part(src, ':', 1) || '>' || split_part(dst, ':', 1)) AS pairs FROM e GROUP BY type")
def a20_end_pairs(spark, d):
    return graph.end_pairs(Graph.read(spark, d).edges)


ENDS_SQL = " OR ".join(f"(type = '{t}' AND src LIKE '{a}:%' AND dst LIKE '{b}:%')" for t, (a, b) in ENDS.items())


@query(f"WITH {E}, {FAULTY} SELECT id, type FROM fe WHERE NOT ({ENDS_SQL})")
def i5_wrong_ends(spark, d):
    return graph.wrong_ends(faulty(Graph.read(spark, d)).edges)


@query(f"WITH {E}, {FAULTY} SELECT DISTINCT x.src, x.dst FROM fe x JOIN fe y ON y.src = x.dst AND y.dst = x.src WHERE x.src < x.dst")
def o8_reciprocal_pairs(spark, d):
    return graph.reciprocal(faulty(Graph.read(spark, d)).edges)


@query(f"WITH {E} SELECT src, dst, count(*) AS edges FROM e GROUP BY src, dst HAVING count(*) > 1")
def a19_parallel_edges(spark, d):
    return graph.parallel(Graph.read(spark, d).edges)


@query(f"WITH {E} SELECT src, dst FROM e WHERE type IN ('DEFINES', 'REQUIRES', 'MENTIONS') GROUP BY src, dst HAVING bool_or(type = 'DEFINES') AND count(DISTINCT type) > 1")
def i7_double_relations(spark, d):
    return graph.double_relations(Graph.read(spark, d).edges)


BARE = r"regexp_replace(regexp_replace({0}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[`*_~]', '', 'g')"
SPACED = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
CITED = f"""ct AS (SELECT path, lines.start AS first, text FROM s UNION SELECT c.path, c.lines.start, c.text FROM (SELECT unnest(code) AS c FROM s)),
ce AS (SELECT id, src, path, lo, hi, {SPACED.format('span')} AS span FROM fe WHERE src LIKE 'sec:%')"""
HOLDS = f"(contains(t, span) OR contains({BARE.format('t')}, {BARE.format('span')}))"


@query(f"""WITH {E}, {FAULTY}, {S}, {CITED}, w AS (SELECT ce.*, {SPACED.format("array_to_string((string_split(text, chr(10)))[lo - first + 1 : hi - first + 1], ' ')")} AS t FROM ce JOIN ct ON ct.path = ce.path WHERE lo >= first AND hi < first + len(string_split(text, chr(10))) AND hi >= lo)
SELECT DISTINCT id, src FROM ce WHERE id NOT IN (SELECT id FROM w WHERE {HOLDS})""")
def i3_misplaced_spans(spark, d):
    g = faulty(Graph.read(spark, d))
    return graph.misplaced_spans(g.edges.where(F.col("src").startswith("sec:")), graph.cited_texts(g.sections))


@query(f"""WITH {E}, {FAULTY}, {S}, {CITED}, w AS (SELECT ce.*, {SPACED.format('text')} AS t FROM ce JOIN ct ON ct.path = ce.path) SELECT DISTINCT id, path FROM ce WHERE id NOT IN (SELECT id FROM w WHERE {HOLDS})""")
def i2_lost_spans(spark, d):
    g = faulty(Graph.read(spark, d))
    return graph.lost_spans(g.edges.where(F.col("src").startswith("sec:")), graph.cited_texts(g.sections))


@query(f"WITH {E} SELECT id, CASE WHEN evidence.path LIKE 'docs/en/%' THEN 'pages/' || substr(evidence.path, 9) WHEN evidence.path LIKE 'data/raw/discussions/%' THEN 'threads/' || substr(evidence.path, 22) ELSE evidence.path END AS path FROM e")
def i4_aliased_paths(spark, d):
    return Graph.read(spark, d).edges.select("id", graph.aliased(F.col("evidence.path"), {"docs/en/": "pages/", "data/raw/discussions/": "threads/"}).alias("path"))


DOUBTFUL = "x AS (SELECT CASE WHEN rn % 9 = 0 THEN 'F1-1' WHEN rn % 9 = 1 THEN 'F2-' || substr(id, 4) ELSE id END AS id, CASE WHEN rn % 9 = 2 THEN 'other' ELSE type END AS type FROM (SELECT *, row_number() OVER (ORDER BY concept) AS rn FROM (SELECT 'F1-' || lpad(CAST(row_number() OVER (ORDER BY id) AS VARCHAR), 4, '0') AS id, 'near_miss' AS type, id AS concept FROM concepts)))"


@query(f"WITH {DOUBTFUL} SELECT id, type FROM x WHERE type <> 'near_miss' OR NOT regexp_full_match(id, 'F1-[0-9]{{4,}}') OR id IN (SELECT id FROM x GROUP BY id HAVING count(*) > 1)")
def i6_malformed_findings(spark, d):
    """Findings by a rule on concepts, some with ids that are short, of another type or repeated, or of an unknown type."""
    rn = F.row_number().over(W.orderBy("id"))
    f = rows(spark, d, "concepts").select(F.format_string("F1-%04d", rn).alias("id"), F.lit("near_miss").alias("type"), F.lit(1).alias("demand"), F.array(F.lit("x")).alias("proof_path"), rn.alias("rn"))
    name = F.when(F.col("rn") % 9 == 0, "F1-1").when(F.col("rn") % 9 == 1, F.concat(F.lit("F2-"), F.substr("id", F.lit(4)))).otherwise(F.col("id"))
    return findings.malformed(f.select(name.alias("id"), F.when(F.col("rn") % 9 == 2, "other").otherwise(F.col("type")).alias("type"), "demand", "proof_path"))


@query(f"WITH {E}, w AS (SELECT id, dst AS concept FROM e WHERE type = 'REQUIRES') SELECT id, concept FROM w WHERE concept IN (SELECT dst FROM e WHERE type = 'DEFINES')")
def i7_defined_near_misses(spark, d):
    """Every required concept taken for a near miss: those that are defined come out."""
    e = Graph.read(spark, d).edges
    claimed = findings.of_type(e, "REQUIRES").select("id", F.lit("near_miss").alias("type"), F.col("dst").alias("concept"))
    return findings.defined_near_misses(claimed, e)


@query("""WITH t AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT priority, status, n, n // 2 AS valid, n - n // 2 - CASE WHEN status = 'P' THEN 1 ELSE 0 END AS invalid, 0.5 AS rate, CASE WHEN status = 'F' THEN 0.6 ELSE 0.4 END AS low, 0.9 AS high FROM t)
SELECT priority, status FROM r WHERE n <> valid + invalid OR low > rate OR high < rate""")
def i8_inconsistent_rates(spark, d):
    """Summaries by a rule on orders, some with a part missing or with an interval beside the rate."""
    t = rows(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    half = F.floor(F.col("n") / 2)
    t = t.withColumns({"valid": half, "invalid": F.col("n") - half - F.when(F.col("status") == "P", 1).otherwise(0), "rate": F.lit(0.5), "low": F.when(F.col("status") == "F", 0.6).otherwise(0.4), "high": F.lit(0.9)})
    return validation.inconsistent(t).select("priority", "status")


@query(f"SELECT id FROM ({SQL['f2_orphan']}) WHERE CAST(right(id, 4) AS INT) % 4 = 0")
def i10_unshown_findings(spark, d):
    """Findings of which every fourth was left out of the payload."""
    f = findings.orphans(Graph.read(spark, d).written())
    shown = files.payload(f.where(F.substring("id", -4, 4).cast("int") % 4 != 0), ["id", "type"])
    return findings.unshown(f, shown)


@query("WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN text || '–' ELSE text END AS text, url FROM documents) SELECT id, 'text' AS \"column\" FROM d WHERE regexp_matches(text, '[–—]') UNION ALL SELECT id, 'url' FROM d WHERE regexp_matches(url, '[–—]')")
def i11_dashes(spark, d):
    """Every seventh text with a dash more."""
    t = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\u2013"))).otherwise(F.col("text"))
    return findings.dashes(rows(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), t.alias("text"), "url"), "text", "url")


@query("WITH b AS (SELECT c_custkey AS id, c_custkey % 5 AS readers, c_nationkey % 4 AS votes, c_custkey % 3 = 0 AS outside FROM customer) SELECT CAST(id AS VARCHAR) AS id FROM b WHERE readers < 3 OR outside <> (votes * 2 > readers)")
def i12_doubtful_boundaries(spark, d):
    c = rows(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 5).alias("readers"), (F.col("c_nationkey") % 4).alias("votes_outside"), (F.col("c_custkey") % 3 == 0).alias("outside"))
    return validation.too_few_readers(c)


@query(f"""WITH {E} SELECT row_number() OVER (ORDER BY type, src, dst) AS ordinal, 'e:' || lpad(CAST(row_number() OVER (ORDER BY type, src, dst) AS VARCHAR), 5, '0') AS id, type, src, dst FROM e""")
def w13_renumbered_edges(spark, d):
    return graph.with_ids(Graph.read(spark, d).edges.select(*graph.EDGE)).select("ordinal", "id", "type", "src", "dst")


@query(f"WITH {S} SELECT doc_id AS src, id AS dst, string_split(text, chr(10))[1] AS span, path, CAST(lines.start AS INT) AS line FROM s")
def g1_contains_edges(spark, d):
    e = graph.contains_edges(Graph.read(spark, d).sections)
    return e.select("src", "dst", "evidence.span", "evidence.path", F.col("evidence.lines.start").alias("line"))


@query(f"""WITH {S}, {D}, m AS (SELECT min(id) AS low, max(id) AS top FROM d)
SELECT id AS src, t AS dst, trim(line) AS span, CAST(lines.start + len(string_split(text, chr(10))) AS INT) AS line FROM (SELECT s.*, unnest([low, top]) AS t, ' see [one](/' || substr(low, 5) || '.md#part) and [again](/' || substr(low, 5) || '.md), [two](/x/../' || substr(top, 5) || '.md), [out](https://x.test/a.md), [gone](gone.md), [self](/' || substr(doc_id, 5) || '.md)' AS line FROM s, m) WHERE t <> doc_id""")
def g1_link_edges(spark, d):
    """Every section with a line of links more: to two pages, one of them twice, to outside, to a missing page and to its own."""
    g = Graph.read(spark, d)
    ends = g.docs.agg(F.min("id").alias("low"), F.max("id").alias("top"))
    stem = lambda c: F.substr(c, F.lit(5))
    line = F.concat(F.lit(" see [one](/"), stem("low"), F.lit(".md#part) and [again](/"), stem("low"), F.lit(".md), [two](/x/../"), stem("top"), F.lit(".md), [out](https://x.test/a.md), [gone](gone.md), [self](/"), stem("doc_id"), F.lit(".md)"))
    linked = g.sections.crossJoin(F.broadcast(ends)).withColumn("text", F.concat("text", F.lit("\n"), line))
    return graph.link_edges(linked, g.docs).select("src", "dst", "evidence.span", F.col("evidence.lines.start").alias("line"))


@query(f"""WITH {A}, {RAW}, x AS (SELECT 'q:' || raw.number AS src, a.id AS dst, string_split(raw, chr(10)) AS l FROM raw JOIN a ON a.question_id = 'q:' || raw.number),
y AS (SELECT src, dst, l, greatest(coalesce(list_position(list_transform(l, lambda z: starts_with(z, '## Accepted answer')), true), 0), 1) AS line FROM x) SELECT src, dst, l[line] AS span, CAST(line AS INT) AS line FROM y""")
def g1_answer_edges(spark, d):
    t = rows(spark, d, "discussions").dropDuplicates(["number"])
    q = t.selectExpr("concat('q:', number) AS id", "number").join(files.rendered(t), "number")
    return graph.answer_edges(q, Graph.read(spark, d).answers).select("src", "dst", "evidence.span", F.col("evidence.lines.start").alias("line"))


# ---- sections and text ---------------------------------------------------------------------


def pages(spark, d) -> DataFrame:
    """Each page put together again from its sections."""
    s = Graph.read(spark, d).sections
    whole = s.groupBy(F.regexp_replace("doc_id", "^doc:", "").alias("stem")).agg(F.array_sort(F.collect_list(F.struct("lines.start", "text"))).alias("l"))
    return whole.select(F.concat("stem", F.lit(".md")).alias("path"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


SPLIT = r"""pg AS (SELECT substr(doc_id, 5) AS stem, string_agg(text, chr(10) ORDER BY lines.start, text) AS text FROM s GROUP BY 1),
pl AS (SELECT stem, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pg),
pf AS (SELECT *, regexp_matches(line, '^\s*(`{3,}|~{3,})') AS fence, count(*) OVER (PARTITION BY stem) AS total FROM pl),
po AS (SELECT *, coalesce(sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM pf),
ph AS (SELECT stem, n AS first, line, coalesce(lead(n) OVER (PARTITION BY stem ORDER BY n) - 1, total) AS last FROM po WHERE NOT fence AND NOT inside AND regexp_matches(line, '^#{1,6}\s+')),
pt AS (SELECT ph.stem, ph.first, any_value(ph.last) AS last, any_value(ph.line) AS head, string_agg(pl.line, chr(10) ORDER BY pl.n) AS text FROM ph JOIN pl ON pl.stem = ph.stem AND pl.n BETWEEN ph.first AND ph.last GROUP BY ph.stem, ph.first),
pr AS (SELECT *, length(regexp_extract(head, '^(#+)', 1)) AS level, trim(regexp_replace(regexp_replace(regexp_replace(head, '^#{1,6}\s+', ''), '`([^`]*)`', '\1', 'g'), '\*\*([^*]*)\*\*', '\1', 'g')) AS heading FROM pt),
ps AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug, list_transform(string_split(replace(regexp_extract(stem, '([^/]*)$', 1), '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])) AS named FROM pr),
pa AS (SELECT *, row_number() OVER (PARTITION BY stem, slug ORDER BY first) AS nth, arg_min(heading, first) FILTER (level = 1) OVER (PARTITION BY stem) AS one FROM ps),
px AS (SELECT *, slug || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS anchor FROM pa)"""


@query(f"""WITH {S}, {SPLIT} SELECT 'sec:' || stem || '#' || anchor AS id, 'doc:' || stem AS doc_id, coalesce(one, array_to_string(named, ' ')) AS doc_title, heading, CAST(level AS INT) AS level, CAST(first AS INT) AS first, CAST(last AS INT) AS last, stem || '/' || CASE WHEN level > 1 THEN '#' || anchor ELSE '' END AS url, CAST(length(text) AS INT) AS chars FROM px""")
def sec_p2_sections(spark, d):
    return sections.split_pages(pages(spark, d)).select("id", "doc_id", "doc_title", "heading", "level", F.col("lines.start").alias("first"), F.col("lines.end").alias("last"), "url", "chars")


@query(f"WITH {S}, {SPLIT} SELECT 'sec:' || stem || '#' || anchor AS id FROM px WHERE first % 7 = 0")
def sec_p11_broken_cuts(spark, d):
    """Every seventh section by its first line with a letter too many."""
    p = pages(spark, d)
    cut = sections.split_pages(p)
    return sections.broken_cuts(cut.withColumn("text", F.when(F.col("lines.start") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))), p)


@query(f"WITH {S}, o AS (SELECT chars, row_number() OVER (ORDER BY chars) AS r, count(*) OVER () AS n FROM s) SELECT (SELECT count(*) FROM s) AS sections, (SELECT chars FROM o WHERE r = n // 2 + 1) AS median_chars, max(chars) AS max_chars, count(*) FILTER (chars < 200) AS under_200, count(*) FILTER (len(code) > 0) AS with_code FROM s")
def sec_p12_size_stats(spark, d):
    return sections.size_stats(Graph.read(spark, d).sections)


@query(r"SELECT id, 'concept:' || lower(regexp_replace(regexp_replace(label, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(label, '`([^`]*)`', '\1', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS anchor FROM concepts")
def x4_concept_ids(spark, d):
    return rows(spark, d, "concepts").select("id", text.concept_id(F.col("label")).alias("slug"), text.slugify(F.col("label")).alias("anchor"))


@query(f"WITH {SCOPE} SELECT id, id NOT IN (SELECT id FROM scope) AS out_of_scope FROM concepts")
def x9_scope(spark, d):
    return rows(spark, d, "concepts").select("id", text.out_of_scope(F.col("label")).alias("out_of_scope"))


@query(f"WITH {S} SELECT id, {NORM.format('text')} AS flat FROM s")
def x1_normalized(spark, d):
    return Graph.read(spark, d).sections.select("id", text.normalize(F.col("text")).alias("flat"))


@query(f"""WITH {E}, {S}, {TEXTS}, w AS (SELECT e.id, e.src, {NORM.format('e.evidence.span')} AS span FROM e JOIN s ON s.id = e.src WHERE type IN ('DEFINES', 'REQUIRES', 'MENTIONS')), h AS (SELECT w.*, strpos(flat, span) - 1 AS p FROM w JOIN fl ON fl.id = w.src AND fl.k = 0),
g AS (SELECT h.id, max(no) FILTER (off <= p) AS lo, max(no) FILTER (off <= p + length(span) - 1) AS hi, any_value(p) AS p FROM h JOIN lp ON lp.id = h.src AND lp.k = 0 GROUP BY h.id)
SELECT id, CASE WHEN p >= 0 THEN lo END AS start, CASE WHEN p >= 0 THEN hi END AS "end", false AS stripped FROM g""")
def x3_located_spans(spark, d):
    """Where each edge's span stands in its section, found anew."""
    g = Graph.read(spark, d)
    e = g.edges.where(F.col("type").isin(*TO_CONCEPT)).select("id", "src", "evidence").join(g.sections.select(F.col("id").alias("src"), "text", "lines"), "src")
    w = text.locate(F.col("evidence.span"), F.col("text"), F.col("lines.start"), F.lit(True))
    return e.select("id", w.alias("w")).select("id", "w.start", "w.end", "w.stripped")


@query(r"""WITH s AS (SELECT DISTINCT ON (id) * FROM sections) SELECT id, len(regexp_extract_all(text, '\[[^\]]*\]\([^)\s]+[^)]*\)')) AS links FROM s""")
def x7_link_counts(spark, d):
    return Graph.read(spark, d).sections.select("id", F.size(text.link_targets(F.col("text"))).cast("bigint").alias("links"))


@query("""WITH t AS (SELECT DISTINCT ON (number) * FROM discussions) SELECT number, coalesce(answer.author_association IN ('OWNER', 'MEMBER', 'COLLABORATOR'), false) AS maintainer FROM t
WHERE length(regexp_replace(answer.body, '^[\\s\\x{00a0}\\x{2007}\\x{202f}\\x{3000}]+|[\\s\\x{00a0}\\x{2007}\\x{202f}\\x{3000}]+$', '', 'g')) >= 120 AND length(regexp_replace(body, '^[\\s\\x{00a0}\\x{2007}\\x{202f}\\x{3000}]+|[\\s\\x{00a0}\\x{2007}\\x{202f}\\x{3000}]+$', '', 'g')) >= 80""".replace("\\\\", "\\"))
def s9_substantial_threads(spark, d):
    t = rows(spark, d, "discussions").dropDuplicates(["number"])
    return files.substantial(t).select("number", files.is_maintainer(F.col("answer.author_association")).alias("maintainer"))


@query(f"WITH {RAW} SELECT number, raw FROM raw")
def s11_rendered_threads(spark, d):
    return files.rendered(rows(spark, d, "discussions").dropDuplicates(["number"]))


# ---- proposals -----------------------------------------------------------------------------


PROPOSED = f"""pb AS (SELECT 'batch-000' AS batch_id, CASE WHEN n % 20 = 0 THEN 'sec:gone#x' ELSE src END AS section_id, n AS pos, CASE WHEN n % 20 = 1 THEN 'USES' ELSE lower(type) END AS type, substr(dst, 9) AS concept, CASE n % 20 WHEN 2 THEN 'too short' WHEN 3 THEN head WHEN 4 THEN 'these words stand nowhere at all' ELSE span END AS span, confidence
  FROM (SELECT e.*, evidence.span AS span, string_split(s.text, chr(10))[1] AS head, CAST(regexp_extract(e.id, '[0-9]+') AS BIGINT) AS n FROM e LEFT JOIN s ON s.id = e.src WHERE type IN ('DEFINES', 'REQUIRES', 'MENTIONS'))),
pp AS (SELECT * FROM pb UNION ALL SELECT * REPLACE ('batch-001' AS batch_id) FROM pb WHERE pos % 10 = 5)"""
JUDGED = f"""{PROPOSED}, {TEXTS},
pk AS (SELECT pp.*, upper(trim(pp.type)) AS kind, 'concept:' || lower(regexp_replace(regexp_replace(concept, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS concept_id, {NORM.format('span')} AS nspan, s.id IS NULL AS lost, {NORM.format("string_split(s.text, chr(10))[1]")} AS nhead, s.path FROM pp LEFT JOIN s ON s.id = pp.section_id),
pe AS (SELECT *, CASE WHEN lost THEN 'unknown_section' WHEN kind NOT IN ('DEFINES', 'REQUIRES', 'MENTIONS') THEN 'bad_type' WHEN length(nspan) < 12 THEN 'short_span' WHEN nspan = nhead THEN 'heading_only' END AS early FROM pk),
pw AS (SELECT pe.*, fl.k, fl.path AS found_in, strpos(flat, nspan) - 1 AS p, row_number() OVER (PARTITION BY batch_id, pos ORDER BY fl.k) AS r FROM pe JOIN fl ON fl.id = pe.section_id AND contains(flat, nspan) WHERE early IS NULL),
pd AS (SELECT pw.batch_id, pw.pos, any_value(pw.k) AS k, any_value(found_in) AS found_in, max(no) FILTER (off <= p) AS lo, max(no) FILTER (off <= p + length(nspan) - 1) AS hi FROM pw JOIN lp ON lp.id = pw.section_id AND lp.k = pw.k WHERE r = 1 GROUP BY pw.batch_id, pw.pos),
pz AS (SELECT pe.*, pd.found_in, pd.lo, pd.hi, pd.k, row_number() OVER (PARTITION BY section_id, concept_id, kind, early, pd.k IS NULL ORDER BY pe.batch_id, pe.pos) AS nth FROM pe LEFT JOIN pd ON pd.batch_id = pe.batch_id AND pd.pos = pe.pos),
pj AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN k IS NULL THEN 'span_not_found' WHEN nth > 1 THEN 'duplicate' END AS drop_reason FROM pz)"""


def proposed(spark, d) -> DataFrame:
    """The concept edges as they might have been proposed: some for unknown sections, of bad types, too short, a heading, nowhere to be found, or twice."""
    g = Graph.read(spark, d)
    e = g.edges.where(F.col("type").isin(*TO_CONCEPT)).join(g.sections.select(F.col("id").alias("src"), F.split("text", "\n")[0].alias("head")), "src", "left").withColumn("n", number_of("id"))
    n = F.col("n") % 20
    span = F.when(n == 2, "too short").when(n == 3, F.col("head")).when(n == 4, "these words stand nowhere at all").otherwise(F.col("evidence.span"))
    base = e.select(F.lit("batch-000").alias("batch_id"), F.when(n == 0, "sec:gone#x").otherwise(F.col("src")).alias("section_id"), F.col("n").cast("int").alias("pos"), F.when(n == 1, "USES").otherwise(F.lower("type")).alias("type"), F.regexp_replace("dst", "^concept:", "").alias("concept"), span.alias("span"), "confidence")
    return base.unionByName(base.where(F.col("pos") % 10 == 5).withColumn("batch_id", F.lit("batch-001")))


def judged(spark, d) -> DataFrame:
    return proposals.judged(proposed(spark, d), Graph.read(spark, d).sections)


@query(f"""WITH {E}, {S}, {JUDGED} SELECT kind AS type, section_id AS src, concept_id AS dst, span, found_in AS path, CAST(lo AS INT) AS first, CAST(hi AS INT) AS last, CASE WHEN found_in = path THEN 'prose' ELSE 'code' END AS kind, CASE WHEN lower(trim(confidence)) IN ('high', 'medium', 'low') THEN lower(trim(confidence)) ELSE 'medium' END AS confidence FROM pj WHERE drop_reason IS NULL""")
def e1_assembled_edges(spark, d):
    e = proposals.edges_of(judged(spark, d))
    return e.select("type", "src", "dst", "evidence.span", "evidence.path", F.col("evidence.lines.start").alias("first"), F.col("evidence.lines.end").alias("last"), "evidence.kind", "confidence")


DROPPED = ", ".join(f"count(*) FILTER (coalesce(drop_reason, '') = '{r}') AS dropped_{r}" for r in proposals.REASONS)


@query(f"WITH {E}, {S}, {JUDGED} SELECT count(*) FILTER (coalesce(drop_reason, '') <> 'unknown_section') AS proposed, count(*) FILTER (drop_reason IS NULL) AS kept, {DROPPED} FROM pj")
def v10_ledger(spark, d):
    return proposals.ledger(judged(spark, d))


@query(f"WITH {E}, {S}, {JUDGED} SELECT batch_id, section_id, CAST(pos AS INT) AS pos, concept_id, span FROM pj WHERE drop_reason = 'span_not_found' ORDER BY batch_id, section_id, pos LIMIT 40")
def v10_not_found(spark, d):
    return proposals.not_found(judged(spark, d))


@query(f"WITH {E} SELECT count(*) FILTER (n % 11 = 0 AND type = 'DEFINES') AS landed FROM (SELECT type, CAST(regexp_extract(id, '[0-9]+') AS BIGINT) AS n FROM e)")
def a22_sweep_landed(spark, d):
    """Every eleventh definition taken for one of the sweep."""
    swept = (number_of("id") % 11 == 0) & (F.col("type") == "DEFINES")
    return proposals.sweep_landed(Graph.read(spark, d).edges.withColumn("extractor", F.when(swept, "definition-sweep").otherwise(F.col("extractor"))))


@query("""WITH f AS (SELECT id, kind, unnest(surface_forms) AS form FROM concepts), k AS (SELECT lower(trim(form)) AS key, max(id) FILTER (lower(trim(form)) = lower(trim(label))) AS l, min(id) AS o FROM (SELECT c.id, c.label, unnest(list_concat(c.surface_forms, c.aliases)) AS form FROM concepts c) GROUP BY 1),
lb AS (SELECT lower(trim(label)) AS key, max(id) AS l FROM concepts GROUP BY 1) SELECT coalesce(lb.key, k.key) AS key, coalesce(lb.l, k.o) AS concept FROM lb FULL JOIN k ON k.key = lb.key""")
def v15_label_resolver(spark, d):
    return proposals.resolver(rows(spark, d, "concepts"))


@query("""WITH l AS (SELECT id, unnest(list_append(surface_forms, label)) AS label, generate_subscripts(list_append(surface_forms, label), 1) AS o, coalesce(kind, 'term') AS kind FROM concepts),
b AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, length(label), min(o)) AS r FROM l GROUP BY id, label), k AS (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, kind DESC) AS r FROM l GROUP BY id, kind)
SELECT b.id, b.label, k.kind, coalesce((SELECT string_agg(DISTINCT l.label, ',' ORDER BY l.label) FROM l WHERE l.id = b.id AND l.label <> b.label), '') AS aliases FROM b JOIN k ON k.id = b.id AND k.r = 1 WHERE b.r = 1""")
def v13_voted_concepts(spark, d):
    c = rows(spark, d, "concepts").select(F.col("id").alias("concept_id"), F.posexplode(F.concat("surface_forms", F.array("label"))).alias("ordinal", "label"), F.coalesce("kind", F.lit("term")).alias("kind"))
    v = proposals.voted_concepts(c)
    return v.select("id", "label", "kind", F.array_join("aliases", ",").alias("aliases"))


@query(f"""WITH {E} SELECT dst AS concept, count(DISTINCT src) FILTER (type IN ('REQUIRES', 'MENTIONS')) AS sections, count(*) FILTER (type = 'ASKS_ABOUT') AS asked FROM e WHERE dst LIKE 'concept:%' GROUP BY dst
HAVING count(*) FILTER (type = 'DEFINES') = 0 AND (count(DISTINCT src) FILTER (type IN ('REQUIRES', 'MENTIONS')) >= 2 OR count(*) FILTER (type = 'ASKS_ABOUT') > 0)""")
def v19_sweep_targets(spark, d):
    return proposals.sweep_targets(Graph.read(spark, d).edges)


@query(f"WITH {E} SELECT c.id, c.label, count(DISTINCT e.src) AS sections FROM concepts c JOIN e ON e.dst = c.id AND e.type IN ('DEFINES', 'REQUIRES', 'MENTIONS') GROUP BY c.id, c.label HAVING count(*) FILTER (e.type <> 'MENTIONS') > 0")
def v21_candidate_concepts(spark, d):
    g = Graph.read(spark, d)
    return proposals.candidate_concepts(g.edges, g.concepts)


@query(f"WITH {E} SELECT id, CASE WHEN lower(trim(confidence)) IN ('high', 'medium', 'low') THEN lower(trim(confidence)) ELSE 'medium' END AS confidence FROM e")
def v8_confidence(spark, d):
    return Graph.read(spark, d).edges.select("id", proposals.confidence(F.col("confidence")).alias("confidence"))


@query(f"""SELECT 'CONTAINS' AS type, count(DISTINCT id) AS n FROM sections UNION ALL SELECT 'ANSWERED_BY', count(*) FROM ({SQL['g1_answer_edges']}) UNION ALL SELECT type, count(*) FROM ({SQL['e1_assembled_edges']}) GROUP BY type UNION ALL SELECT type, count(DISTINCT id) FROM edges WHERE type = 'ASKS_ABOUT' GROUP BY type""")
def g2_built_graph(spark, d):
    """The whole build from proposals, threads and mapped questions."""
    g, t = Graph.read(spark, d), rows(spark, d, "discussions").dropDuplicates(["number"])
    built = pipeline.build(g.docs, g.sections, g.concepts, g.questions, g.answers, proposals.edges_of(judged(spark, d)), findings.of_type(g.edges, "ASKS_ABOUT"), threads=files.rendered(t))
    return built.edges.groupBy("type").agg(F.count("*").alias("n"))


# ---- batches, ballots, explorer ------------------------------------------------------------


@query(f"""WITH RECURSIVE {S}, o AS (SELECT id, doc_id, length(text) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY lines.start) AS rn FROM s),
b AS (SELECT id, doc_id, rn, 1 AS part, 1 AS held, size FROM o WHERE rn = 1 UNION ALL SELECT o.id, o.doc_id, o.rn, CASE WHEN held >= 12 OR b.size + o.size > 18000 THEN part + 1 ELSE part END, CASE WHEN held >= 12 OR b.size + o.size > 18000 THEN 1 ELSE held + 1 END, CASE WHEN held >= 12 OR b.size + o.size > 18000 THEN o.size ELSE b.size + o.size END FROM b JOIN o ON o.doc_id = b.doc_id AND o.rn = b.rn + 1)
SELECT doc_id, part, id FROM b""")
def w15_packed_batches(spark, d):
    return batches.packed(Graph.read(spark, d).sections)


@query(f"WITH {S} SELECT id, doc_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1) // 5 AS INT) AS batch FROM s")
def w14_fixed_batches(spark, d):
    return batches.fixed(Graph.read(spark, d).sections.select("id", "doc_id"), 5, "doc_id", "id")


BALLOTS = """b AS (SELECT 'F' || c_custkey % 400 AS finding_id, 'r' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS reader, CASE WHEN c_acctbal > 5000 THEN 'valid' WHEN c_acctbal > 0 THEN 'invalid' ELSE 'unsure' END AS verdict, c_mktsegment AS reason FROM customer),
m AS (SELECT finding_id, count(*) FILTER (verdict IN ('valid', 'invalid')) AS readers, count(*) FILTER (verdict = 'valid') AS votes_valid, arg_min(reason, reader) FILTER (verdict = 'valid') AS yes, arg_min(reason, reader) FILTER (verdict = 'invalid') AS no FROM b GROUP BY finding_id),
j AS (SELECT *, CASE WHEN readers = 0 THEN 'unchecked' WHEN votes_valid * 2 > readers THEN 'valid' ELSE 'invalid' END AS verdict FROM m)"""


def ballots(spark, d) -> DataFrame:
    """Ballots by a rule on customers, the tables having none."""
    c, bal = rows(spark, d, "customer"), F.col("c_acctbal")
    return c.select(F.concat(F.lit("F"), (F.col("c_custkey") % 400).cast("string")).alias("finding_id"), F.format_string("r%08d", F.col("c_custkey").cast("bigint")).alias("reader"), F.when(bal > 5000, "valid").when(bal > 0, "invalid").otherwise("unsure").alias("verdict"), F.col("c_mktsegment").alias("reason"))


@query(f"WITH {BALLOTS} SELECT finding_id, readers, votes_valid, verdict, readers > 0 AND (votes_valid = 0 OR votes_valid = readers) AS \"unanimous\", CASE verdict WHEN 'valid' THEN yes WHEN 'invalid' THEN no END AS reason FROM j")
def a12_ballot_majority(spark, d):
    return validation.majorities(ballots(spark, d))


@query(f"""WITH {BALLOTS}, t AS (SELECT count(*) FILTER (verdict <> 'unchecked') AS n, count(*) FILTER (verdict = 'valid') AS valid, max(readers) AS max_readers FROM j), w AS (SELECT *, CAST(valid AS DOUBLE) / n AS p, 1.959963984540054 AS z FROM t)
SELECT n, valid, n - valid AS invalid, round(p, 4) AS rate, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 0), 4) AS low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 1), 4) AS high, max_readers, round(p, 4) < 0.7 AS stop FROM w""")
def q2_validation_summary(spark, d):
    return validation.summary(validation.majorities(ballots(spark, d)))


@query()
def q1_validation_sample(spark, d):
    return validation.sample(findings.orphans(Graph.read(spark, d))).select("id", "concept")


FOUND = "f AS (SELECT 'F1-' || lpad(CAST(c.rn AS VARCHAR), 4, '0') AS id, CASE c.rn % 3 WHEN 0 THEN 'near_miss' WHEN 1 THEN 'orphan_concept' ELSE 'retrieval_collision' END AS type, c.rn * 7 % 13 AS demand, c.id AS concept, c.label AS concept_label, CASE WHEN c.rn % 4 = 0 THEN NULL ELSE c.rn % 4 = 1 END AS validated FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM concepts) c)"


def shown(spark, d) -> DataFrame:
    """Findings by a rule on concepts, so that the explorer has rows of every kind."""
    c = rows(spark, d, "concepts").withColumn("rn", F.row_number().over(W.orderBy("id")).cast("bigint"))
    rn = F.col("rn")
    f = c.select(F.format_string("F1-%04d", rn).alias("id"), F.when(rn % 3 == 0, "near_miss").when(rn % 3 == 1, "orphan_concept").otherwise("retrieval_collision").alias("type"), (rn * 7 % 13).alias("demand"), F.col("id").alias("concept"), F.col("label").alias("concept_label"), F.when(rn % 4 != 0, rn % 4 == 1).alias("validated"))
    return explorer.searchable(explorer.status(f), "concept_label", "concept", "type")


@query(f"WITH {FOUND} SELECT id, concept, demand FROM f WHERE type = 'near_miss' AND coalesce(validated, true) AND validated IS NOT NULL ORDER BY demand DESC, id LIMIT 25")
def u1_explorer_page(spark, d):
    return explorer.selected(shown(spark, d), kind="near_miss", state="held").select("id", "concept", "demand")


@query(f"WITH {FOUND} SELECT id, concept FROM f WHERE lower(concept_label || ' · ' || concept || ' · ' || type) LIKE '%prefix%' ORDER BY demand, id LIMIT 25")
def u1_explorer_search(spark, d):
    return explorer.selected(shown(spark, d), text="Prefix", order="demand-asc").select("id", "concept")


@query(f"WITH {FOUND} SELECT type, CASE WHEN validated IS NULL THEN 'unchecked' WHEN validated THEN 'held' ELSE 'failed' END AS status, count(*) AS n FROM f GROUP BY ALL")
def u1_facets(spark, d):
    return explorer.facets(shown(spark, d))


@query(f"WITH {FOUND} SELECT id, concept FROM f WHERE id = 'F1-0007'")
def u2_lookup(spark, d):
    return explorer.lookup(shown(spark, d), spark.createDataFrame([("#F1-0007",), ("#type=all",)], "hash string")).select("id", "concept")


@query(f"SELECT id, 'near_miss' AS type, CAST(demand AS VARCHAR) AS demand, concept, section, least(len(string_split(questions, ',')), 12) AS questions FROM ({SQL['f1_near_miss']})")
def s19_payload(spark, d):
    """The payload of the near misses, read back."""
    p = files.payload(findings.near_misses(Graph.read(spark, d).written()), ["id", "type", "demand", "concept", "concept_label", "section", "questions"])
    field = lambda n: F.get_json_object("json", f"$.{n}").alias(n)
    return p.select("id", field("type"), field("demand"), field("concept"), field("section"), F.json_array_length(F.get_json_object("json", "$.questions")).cast("bigint").alias("questions"))


@query(f"WITH {A}, {Q} SELECT q.id, a.id AS answer, coalesce(a.is_maintainer, false) AS is_maintainer FROM q JOIN a ON a.id = 'ans:' || q.number")
def j5_answer_by_number(spark, d):
    g = Graph.read(spark, d)
    return g.questions.select("id", F.concat(F.lit("ans:"), "number").alias("answer")).join(g.answers.select(F.col("id").alias("answer"), F.coalesce("is_maintainer", F.lit(False)).alias("is_maintainer")), "answer").select("id", "answer", "is_maintainer")


@query(f"WITH {E}, x AS (SELECT src AS question, dst AS concept, count(*) OVER (PARTITION BY src) AS k FROM e WHERE type = 'ASKS_ABOUT') SELECT question, array_to_string(list_sort(list(concept)), ',') AS concepts, count(*) AS n FROM x GROUP BY question")
def a5_question_concepts(spark, d):
    e = Graph.read(spark, d).edges.where("type = 'ASKS_ABOUT'")
    return e.groupBy(F.col("src").alias("question")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("concepts"), F.count("*").alias("n"))


@query(f"WITH {E} SELECT id, type, src, dst FROM e WHERE extractor <> 'structural'")
def pr6_without_structural(spark, d):
    return Graph.read(spark, d).edges.where("extractor <> 'structural'").select("id", "type", "src", "dst")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
