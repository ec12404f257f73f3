"""Text cleaning, labels, chunking, retrieval and answer checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from almanac.functions import strings
from almanac.functions.picks import mixed_sql, pick_sql
from almanac.operators import answers as an, chunks as ch, keyword_index as ki, labels as lb, retrieval as rt, vector_cells as vc
from almanac.operators.lineage import written
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin


@query("clean_html", "N1 X5", "SELECT page_id, md5(trim(lower(regexp_replace(html, '<[^>]+>', '', 'g')))) AS digest FROM pages")
def clean_html(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", F.md5(strings.clean_text("html").cast("binary")).alias("digest"))


UNIT, INNER = f"({mixed_sql(['doc_id'], 0)} % 100)", f"({mixed_sql(['doc_id'], 1)} % 100)"


@query("nested_split", "N2", f"SELECT doc_id, CASE WHEN {UNIT} >= 60 THEN 'phase_two' WHEN {INNER} >= 80 THEN 'test' WHEN {INNER} >= 60 THEN 'validation' ELSE 'train' END AS part FROM documents")
def nested_split(spark, sf):
    return lb.nested_split(t.table(spark, sf, "documents").select("doc_id"), "doc_id")


VOTES = """votes AS (SELECT doc_id, 'a' AS model, quality AS label, (n_chars % 100) / 100.0::DOUBLE AS confidence, quality AS truth FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 'b', CAST(n_chars % 2 AS INTEGER), (n_chars % 97) / 97.0::DOUBLE, quality FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 'c', CASE WHEN toxic = 1 THEN 0 ELSE 1 END, (n_chars % 89) / 89.0::DOUBLE, quality FROM labels JOIN documents USING (doc_id))"""


def votes(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = t.table(spark, sf, "labels").join(docs, "doc_id")
    n = F.col("n_chars")
    each = F.array(
        F.struct(F.lit("a").alias("model"), F.col("quality").alias("label"), ((n % 100) / F.lit(100.0)).alias("confidence")),
        F.struct(F.lit("b").alias("model"), (n % 2).cast("int").alias("label"), ((n % 97) / F.lit(97.0)).alias("confidence")),
        F.struct(F.lit("c").alias("model"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("label"), ((n % 89) / F.lit(89.0)).alias("confidence")),
    )
    return rows.select("doc_id", F.inline(each), F.col("quality").alias("truth"))


@query("confident_labels", "N3", twin("", "SELECT doc_id, model, label, confidence FROM votes WHERE confidence >= 0.8::DOUBLE", VOTES))
def confident_labels(spark, sf):
    return lb.confident(votes(spark, sf), "confidence", 0.8).drop("truth")


@query("agreed_labels", "N4", twin("", """SELECT doc_id, arg_min(label, (-n, label)) AS label, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS agreement FROM (SELECT doc_id, label, count(*) AS n FROM votes GROUP BY 1, 2) GROUP BY 1 HAVING max(n) / CAST(sum(n) AS DOUBLE) >= 0.66""", VOTES))
def agreed_labels(spark, sf):
    return rounded(lb.agreed(votes(spark, sf), "doc_id", "label", min_share=0.66), ["agreement"], 6)


@query("entropy_guard", "N5", twin("", """SELECT doc_id, model, label FROM (SELECT *, confidence AS p1, 1 - confidence AS p0 FROM votes) WHERE confidence > 0.9::DOUBLE AND -(p1 * ln(p1 + 1e-9::DOUBLE)) - p0 * ln(p0 + 1e-9::DOUBLE) > 0.1::DOUBLE""", VOTES))
def entropy_guard(spark, sf):
    rows = votes(spark, sf).withColumn("p1", F.col("confidence")).withColumn("p0", 1 - F.col("confidence"))
    return lb.entropy_guard(rows, ["p1", "p0"], "confidence").select("doc_id", "model", "label")


@query("distribution_matched", "N6", twin("", """SELECT doc_id, model, label, confidence FROM (SELECT v.*, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, doc_id * 3 + ascii(model)) AS rk FROM votes v) v
  JOIN (SELECT quality, floor(count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE) * (SELECT count(*) FROM votes)) AS q FROM labels GROUP BY 1) k ON k.quality = v.label WHERE rk <= q""", VOTES))
def distribution_matched(spark, sf):
    rows = votes(spark, sf).drop("truth").withColumn("vote", F.col("doc_id") * 3 + F.ascii("model"))
    target = t.table(spark, sf, "labels").select(F.col("quality").alias("label"))
    return lb.matched_to_distribution(rows, target, "label", "confidence", "vote").drop("vote")


@query("rebalanced_classes", "N7", twin("", f"""SELECT p.label, p.draw, x.doc_id FROM (SELECT label, draw, {pick_sql(['draw', 'label'], 'n', 5)} AS pos FROM (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1),
  generate_series(1, (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality))) g(draw)) p JOIN (SELECT quality AS label, doc_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS pos FROM labels) x ON x.label = p.label AND x.pos = p.pos"""))
def rebalanced_classes(spark, sf):
    rows = t.table(spark, sf, "labels").select(F.col("quality").alias("label"), "doc_id")
    return lb.rebalanced(rows, "label", "doc_id", seed=5).select("label", "draw", "doc_id")


@query("confusion_matrix", "N8", twin("", "SELECT truth, label, count(*) AS n FROM votes GROUP BY 1, 2", VOTES))
def confusion_matrix(spark, sf):
    return lb.confusion(votes(spark, sf), "truth", "label")


CLASS = """cls AS (SELECT l.label, (SELECT count(*) FROM votes WHERE truth = l.label) AS support, (SELECT count(*) FROM votes v WHERE v.label = l.label) AS predicted, (SELECT count(*) FROM votes v WHERE v.label = l.label AND truth = l.label) AS tp
  FROM (SELECT truth AS label FROM votes UNION SELECT label FROM votes) l), per AS (SELECT *, tp / CAST(predicted AS DOUBLE) AS pr, tp / CAST(support AS DOUBLE) AS rc, 2.0::DOUBLE * tp / (predicted + support) AS f1 FROM cls)"""


@query("class_metrics", "N8", twin("", "SELECT label, support, predicted, tp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM per", VOTES + ", " + CLASS))
def class_metrics(spark, sf):
    return rounded(lb.class_metrics(votes(spark, sf), "truth", "label"), ["precision", "recall", "f1"], 6)


@query("overall_metrics", "N8", twin("", """SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(pr * support) / sum(support), 6) AS weighted_precision,
  round(sum(rc * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM per""", VOTES + ", " + CLASS))
def overall_metrics(spark, sf):
    made = lb.overall_metrics(votes(spark, sf), "truth", "label")
    return rounded(made, [c for c in made.columns if c != "n"], 6)


@query("label_validity", "N9", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality IS NULL) AS n_null, count(*) FILTER (WHERE quality NOT IN (1, 2)) AS n_unknown, count(*) FILTER (WHERE quality IN (1, 2)) AS n_valid FROM labels")
def label_validity(spark, sf):
    return lb.label_validity(t.table(spark, sf, "labels"), "quality", [1, 2])


# ---- chunks

@query("adaptive_chunks", "N11")
def adaptive_chunks(spark, sf):
    """Whole texts; the kind of text decides the size. Checked against a plain loop in the tests."""
    kind = F.when(F.col("lang") == "en", "general").when(F.col("source") == "src1", "faq").otherwise("narrative")
    docs = t.table(spark, sf, "documents").select("doc_id", "text", kind.alias("kind"))
    return ch.adaptive_chunks(docs, "doc_id", "text", "kind").select("doc_id", "chunk", "n_words", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("separator_chunks", "N12")
def separator_chunks(spark, sf):
    made = ch.separator_chunks(t.table(spark, sf, "documents"), "doc_id", "text")
    return made.select("doc_id", "chunk", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("word_windows", "N12", """SELECT doc_id, CAST(c AS BIGINT) AS chunk, 'doc_' || doc_id || '_' || c AS chunk_id, md5(array_to_string(w[c * 462 + 1 : c * 462 + 512], ' ')) AS digest FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(CAST(ceil((len(w) - 50) / 462.0) AS BIGINT) - 1, 0))) AS c
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)""")
def word_windows(spark, sf):
    made = ch.word_windows(t.table(spark, sf, "documents"), "doc_id", "text")
    return made.select("doc_id", "chunk", "chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("source_types", "N13", "SELECT doc_id, CASE WHEN contains(lower(text), 'api') THEN 'engineering' WHEN contains(lower(text), 'marketing') THEN 'marketing' ELSE 'general' END AS source_type FROM documents")
def source_types(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", ch.source_type("text").alias("source_type"))


# ---- retrieval

VECTORS = """vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), dims AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vecs),
  cents AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1)"""


def class_centres(spark, sf):
    return rt.centroids(t.table(spark, sf, "embeddings"), "label", "embedding")


@query("nearest_vectors", "N14", twin("", "SELECT label, vec_id, round(s, 6) AS score, rank FROM (SELECT c.label, vec_id, list_cosine_similarity(c.c, v) AS s, CAST(row_number() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(c.c, v) DESC, vec_id) AS INTEGER) AS rank FROM cents c, vecs) WHERE rank <= 10", VECTORS))
def nearest_vectors(spark, sf):
    found = rt.nearest(class_centres(spark, sf), t.table(spark, sf, "embeddings"), 10, query_id="label", vector_id="vec_id", vector="embedding")
    return rounded(found, ["score"], 6)


@query("nearest_with_filter", "N14", twin("", "SELECT q, vec_id, round(s, 6) AS score, rank FROM (SELECT c.label AS q, vec_id, list_cosine_similarity(c.c, v) AS s, CAST(row_number() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(c.c, v) DESC, vec_id) AS INTEGER) AS rank FROM cents c JOIN vecs ON vecs.label = c.label) WHERE rank <= 5", VECTORS))
def nearest_with_filter(spark, sf):
    queries = class_centres(spark, sf).select(F.col("label").alias("q"), "label", "embedding")
    found = rt.nearest(queries, t.table(spark, sf, "embeddings"), 5, query_id="q", vector_id="vec_id", vector="embedding", same="label")
    return rounded(found, ["score"], 6)


@query("nearest_by_cells", "N14", twin("", """SELECT q, vec_id, round(s, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank FROM (
  SELECT a.vec_id AS q, b.vec_id, list_cosine_similarity(a.v, b.v) AS s FROM vecs a, vecs b WHERE a.vec_id % 100 = 0)) WHERE rank <= 10""", VECTORS))
def nearest_by_cells(spark, sf):
    """Every hundredth vector against all, through the cells, exactly."""
    vectors = t.table(spark, sf, "embeddings")
    index = vc.build_cells(vectors, vector_id="vec_id", vector="embedding")
    queries = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("q"), "embedding")
    return rounded(vc.nearest_in_cells(index, queries, 10, query_id="q", vector_id="vec_id", vector="embedding"), ["score"], 6)


TERMS = r"""terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2), lens AS (SELECT doc_id, sum(tf) AS len FROM terms GROUP BY 1),
  asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark), dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY 1), cnt AS (SELECT count(*) AS n FROM documents),
  bm AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (SELECT sum(len) / CAST((SELECT n FROM cnt) AS DOUBLE) FROM lens)))) AS score
    FROM asked JOIN dfs USING (term) JOIN terms USING (term) JOIN lens USING (doc_id), cnt GROUP BY 1, 2)"""


ASKED = {"query_id": "item_id", "query_text": "text", "doc_id": "doc_id"}


def keyword_index(spark, sf):
    return ki.build_index(t.table(spark, sf, "documents"), doc_id="doc_id", text="text")


def opened(spark, sf, index):
    return ki.open_questions(index, t.table(spark, sf, "benchmark"), query_id="item_id", query_text="text")


def keyword_top(spark, sf, k):
    return ki.keyword_top(keyword_index(spark, sf), t.table(spark, sf, "benchmark"), k, **ASKED)


@query("bm25_top", "N15", twin("", "SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM bm) WHERE rank <= 10", TERMS))
def bm25_top(spark, sf):
    return rounded(keyword_top(spark, sf, 10), ["score"], 6)


HYBRID = TERMS + ", " + VECTORS + """, sem AS (SELECT item_id, vec_id AS doc_id, list_cosine_similarity(c, v) AS s FROM benchmark JOIN cents ON cents.label = item_id % 10, vecs),
  kinds AS (SELECT item_id, CASE WHEN regexp_matches(lower(text), 'error|function|api|endpoint|class') THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS w FROM benchmark),
  fused AS (SELECT item_id, doc_id, w * coalesce(s, 0) + (1 - w) * coalesce(score, 0) AS score FROM (SELECT coalesce(sem.item_id, bm.item_id) AS item_id, coalesce(sem.doc_id, bm.doc_id) AS doc_id, s, score FROM sem FULL JOIN bm ON bm.item_id = sem.item_id AND bm.doc_id = sem.doc_id) JOIN kinds USING (item_id)),
  top_fused AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM fused) WHERE rank <= 10)"""


def hybrid(spark, sf, index, opened):
    questions = t.table(spark, sf, "benchmark")
    queries = questions.select("item_id", (F.col("item_id") % 10).cast("int").alias("label")).join(class_centres(spark, sf), "label")
    vectors = t.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    names = {"query_id": "item_id", "doc_id": "doc_id", "vector": "embedding"}
    best_words = ki.keyword_top(index, questions, 10, **ASKED, opened=opened)
    best_vectors = rt.nearest(queries, vectors, 10, query_id="item_id", vector_id="doc_id", vector="embedding")
    floors = rt.keyword_floors(best_words, best_vectors, queries, vectors, questions, 10, **names, query_text="text")
    keyword = written(ki.keyword_above(index, questions, floors, **ASKED, opened=opened), "keyword")
    semantic = rt.semantic_scores(queries, vectors, keyword, 10, **names)
    both = rt.fused(semantic, keyword, questions, query_id="item_id", doc_id="doc_id", query_text="text")
    return rt.top_scores(both, "item_id", "doc_id", 10)


@query("hybrid_top", "N16", twin("", "SELECT item_id, doc_id, round(score, 6) AS score, rank FROM top_fused", HYBRID))
def hybrid_top(spark, sf):
    index = keyword_index(spark, sf)
    return rounded(hybrid(spark, sf, index, opened(spark, sf, index)), ["score"], 6)


@query("merged_variants", "N17", twin("", """SELECT question, doc_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM (
  SELECT item_id // 4 AS question, doc_id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM bm) WHERE rk <= 3 GROUP BY 1, 2)) WHERE rank <= 5""", TERMS))
def merged_variants(spark, sf):
    """Four phrasings per question, three results each."""
    results = keyword_top(spark, sf, 3).drop("rank")
    variants = t.table(spark, sf, "benchmark").select("item_id", F.floor(F.col("item_id") / 4).alias("question"))
    made = rt.merged_variants(results, variants, variant_id="item_id", query_id="question", doc_id="doc_id", k=5)
    return rounded(made, ["score"], 6)


@query("similar_vectors", "N18", twin("", """SELECT vec_id, other, round(score, 6) AS score FROM (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rk FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id) WHERE rk = 1 AND score > 0.95""", VECTORS))
def similar_vectors(spark, sf):
    """Batch form of a semantic cache: the most similar other vector above the threshold."""
    return rounded(similar(spark, sf, t.table(spark, sf, "embeddings")), ["score"], 6)


def similar(spark, sf, vectors):
    centres = [row["embedding"] for row in class_centres(spark, sf).orderBy("label").collect()]  # as many as labels
    return rt.similar_pairs(vectors, key="vec_id", vector="embedding", threshold=0.95, pivots=centres)


COPIED = """vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL
  SELECT -1 - vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * (1 + 0.2 * (i % 3 - 1))) FROM embeddings WHERE vec_id % 5 = 0)"""


@query("similar_copies", "N18", twin("", """SELECT vec_id, other, round(score, 6) AS score FROM (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rk FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id) WHERE rk = 1 AND score > 0.95""", COPIED))
def similar_copies(spark, sf):
    """The same over a table in which every fifth vector stands again with its coordinates bent by a fifth."""
    vectors = t.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    bent = F.transform("embedding", lambda x, i: x * (1 + 0.2 * ((i + 1) % 3 - 1)))
    copies = vectors.filter(F.col("vec_id") % 5 == 0).select((-1 - F.col("vec_id")).alias("vec_id"), bent.alias("embedding"))
    return rounded(similar(spark, sf, vectors.unionByName(copies)), ["score"], 6)


@query("retrieval_recall", "N21", twin("", "SELECT round(avg(r), 6) AS recall, count(*) AS n_queries FROM (SELECT item_id, count(f.doc_id) / CAST(count(*) AS DOUBLE) AS r FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM bm) WHERE rk <= 3) b LEFT JOIN top_fused f USING (item_id, doc_id) GROUP BY 1)", HYBRID))
def retrieval_recall(spark, sf):
    index = keyword_index(spark, sf)
    questions = opened(spark, sf, index)
    truth = ki.keyword_top(index, t.table(spark, sf, "benchmark"), 3, **ASKED, opened=questions).select("item_id", "doc_id")
    return rounded(rt.recall_at(hybrid(spark, sf, index, questions), truth, query_id="item_id", doc_id="doc_id", k=10), ["recall"], 6)


PASSAGES = """passages AS (SELECT doc_id AS item_id, array_to_string(list_slice(string_split(text, ' '), 11, 30), ' ') AS text FROM documents WHERE doc_id % 100 = 0 AND len(string_split(text, ' ')) > 10), """


@query("known_passage_recall", "N21", twin("", """SELECT round(avg(CASE WHEN f.doc_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, count(*) AS n_queries FROM passages LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM bm) f
  ON f.item_id = passages.item_id AND f.doc_id = passages.item_id AND rk <= 10""", PASSAGES + re.sub(r"\bbenchmark\b", "passages", TERMS)))
def known_passage_recall(spark, sf):
    """Twenty words from inside a document are asked for; the one right answer is the document they come from."""
    documents = t.table(spark, sf, "documents")
    words = F.split("text", " ")
    asked = documents.filter((F.col("doc_id") % 100 == 0) & (F.size(words) > 10))
    passages = asked.select(F.col("doc_id").alias("item_id"), F.array_join(F.slice(words, 11, 20), " ").alias("text"))
    truth = passages.select("item_id", F.col("item_id").alias("doc_id"))
    results = ki.keyword_top(keyword_index(spark, sf), passages, 10, **ASKED)
    return rounded(rt.recall_at(results, truth, query_id="item_id", doc_id="doc_id", k=10), ["recall"], 6)


# ---- answers and logs

def exchanges(spark, sf):
    turns = t.table(spark, sf, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return turns.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("predicted")).join(asked, ["conv_id", "turn"])


PAIRS = r"""pairs AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[\p{L}\p{N}]+') AS p, regexp_extract_all(lower(u.text), '[\p{L}\p{N}]+') AS g
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant')"""


@query("answer_matches", "N19", twin("", """SELECT conv_id, turn, len(list_filter(g, lambda w: w NOT IN ('a', 'an', 'the'))) > 0 AND list_filter(p, lambda w: w NOT IN ('a', 'an', 'the')) = list_filter(g, lambda w: w NOT IN ('a', 'an', 'the')) AS exact_match,
  len(g) > 0 AND len(list_filter(list_filter(g, lambda w: length(w) > 6), lambda w: NOT list_contains(p, w))) = 0 AS contains_answer FROM pairs""", PAIRS))
def answer_matches(spark, sf):
    return an.evaluated(exchanges(spark, sf), "predicted", "gold").select("conv_id", "turn", "exact_match", "contains_answer")


# the longest common subsequence, one row of its table for each word of the answer: a row is the running maximum of its candidates
OVERLAP = """overlap AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * list_reduce(list_transform(p, lambda w: struct_pack(w := w, l := CAST([] AS INTEGER[]))),
  lambda a, x: struct_pack(w := x.w, l := list_transform(generate_series(1, len(g)), lambda j: CAST(list_max(list_transform(generate_series(1, j), lambda i: CASE WHEN g[i] = x.w THEN (CASE WHEN i > 1 THEN a.l[i - 1] ELSE 0 END) + 1 ELSE a.l[i] END)) AS INTEGER))),
  struct_pack(w := '', l := list_transform(g, lambda v: 0))).l[len(g)] / (len(p) + len(g)) END AS rouge FROM pairs)"""


@query("answer_overlap", "N19", twin("", "SELECT conv_id, turn, round(rouge, 6) AS rouge_l FROM overlap", PAIRS + ", " + OVERLAP))
def answer_overlap(spark, sf):
    return an.evaluated(exchanges(spark, sf), "predicted", "gold").select("conv_id", "turn", r("rouge_l", 6).alias("rouge_l"))


@query("answer_cosine", "N19", twin("", """SELECT conv_id, turn, round(coalesce(sum(np * ng) / nullif(sqrt(sum(np * np) * sum(ng * ng)), 0), 0), 6) AS cosine FROM (
  SELECT conv_id, turn, w, CAST(sum(x) AS DOUBLE) AS np, CAST(sum(y) AS DOUBLE) AS ng FROM (SELECT conv_id, turn, unnest(p) AS w, 1 AS x, 0 AS y FROM pairs
    UNION ALL SELECT conv_id, turn, unnest(g), 0, 1 FROM pairs UNION ALL SELECT conv_id, turn, '', 0, 0 FROM pairs) GROUP BY 1, 2, 3) GROUP BY 1, 2""", PAIRS))
def answer_cosine(spark, sf):
    return an.evaluated(exchanges(spark, sf), "predicted", "gold").select("conv_id", "turn", r("cosine", 6).alias("cosine"))


@query("answer_metrics", "N19", twin("", "SELECT count(*) AS n, round(avg(CASE WHEN exact_match THEN 1 ELSE 0 END), 6) AS exact_match, round(avg(CASE WHEN contains_answer THEN 1 ELSE 0 END), 6) AS contains_answer FROM matches", PAIRS + """,
  matches AS (SELECT len(list_filter(g, lambda w: w NOT IN ('a', 'an', 'the'))) > 0 AND list_filter(p, lambda w: w NOT IN ('a', 'an', 'the')) = list_filter(g, lambda w: w NOT IN ('a', 'an', 'the')) AS exact_match,
  len(g) > 0 AND len(list_filter(list_filter(g, lambda w: length(w) > 6), lambda w: NOT list_contains(p, w))) = 0 AS contains_answer FROM pairs)"""))
def answer_metrics(spark, sf):
    """The mean row of the metrics that SQL can state."""
    rows = an.evaluated(exchanges(spark, sf), "predicted", "gold")
    return rows.agg(F.count(F.lit(1)).alias("n"), *[r(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("exact_match", "contains_answer")])


MEANS = PAIRS + ", " + OVERLAP + """, matches AS (SELECT len(list_filter(g, lambda w: w NOT IN ('a', 'an', 'the'))) > 0 AND list_filter(p, lambda w: w NOT IN ('a', 'an', 'the')) = list_filter(g, lambda w: w NOT IN ('a', 'an', 'the')) AS same,
    len(g) > 0 AND len(list_filter(list_filter(g, lambda w: length(w) > 6), lambda w: NOT list_contains(p, w))) = 0 AS holds FROM pairs),
  counts AS (SELECT conv_id, turn, w, CAST(sum(x) AS DOUBLE) AS np, CAST(sum(y) AS DOUBLE) AS ng FROM (SELECT conv_id, turn, unnest(p) AS w, 1 AS x, 0 AS y FROM pairs
    UNION ALL SELECT conv_id, turn, unnest(g), 0, 1 FROM pairs UNION ALL SELECT conv_id, turn, '', 0, 0 FROM pairs) GROUP BY 1, 2, 3),
  angles AS (SELECT coalesce(sum(np * ng) / nullif(sqrt(sum(np * np) * sum(ng * ng)), 0), 0) AS cosine FROM counts GROUP BY conv_id, turn)"""


@query("answer_means", "N19", twin("", """SELECT (SELECT count(*) FROM pairs) AS n, (SELECT round(avg(CASE WHEN same THEN 1 ELSE 0 END), 6) FROM matches) AS exact_match, (SELECT round(avg(CASE WHEN holds THEN 1 ELSE 0 END), 6) FROM matches) AS contains_answer,
  (SELECT round(avg(rouge), 6) FROM overlap) AS rouge_l, (SELECT round(avg(cosine), 6) FROM angles) AS cosine""", MEANS))
def answer_means(spark, sf):
    """The mean row of all four metrics."""
    rows = an.evaluated(exchanges(spark, sf), "predicted", "gold")
    means = [r(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("exact_match", "contains_answer", "rouge_l", "cosine")]
    return rows.agg(F.count(F.lit(1)).alias("n"), *means)


@query("invented_citations", "N20 J16", """SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END AS item_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]+)', 1)) AS n FROM documents))
  WHERE item_id NOT IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)""")
def invented_citations(spark, sf):
    made = an.invented_citations(t.table(spark, sf, "documents"), t.table(spark, sf, "benchmark"), answer_id="doc_id", text="text", source_id="item_id", pattern="([0-9]+)")
    return made.select("doc_id", "item_id")


@query("request_log", "N22 X16 A5", """SELECT count(*) AS n_requests, count(DISTINCT k) AS n_distinct, round((count(*) - count(DISTINCT k)) / CAST(count(*) AS DOUBLE), 6) AS repeat_rate, round(CAST(count(*) FILTER (WHERE c > 1 AND conf >= 0.85) AS DOUBLE) / count(*), 6) AS cacheable_share,
  quantile_cont(CAST(latency AS DOUBLE), 0.5) AS p50, round(quantile_cont(CAST(latency AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST(latency AS DOUBLE), 0.99), 6) AS p99 FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM (SELECT role || '|' || text AS k, length(text) AS latency, (length(text) % 100) / 100.0::DOUBLE AS conf FROM conversations))""")
def request_log(spark, sf):
    log = t.table(spark, sf, "conversations").select("role", "text", F.length("text").alias("latency"), ((F.length("text") % 100) / F.lit(100.0)).alias("confidence"))
    made = an.request_summary(log, ["role", "text"], "latency", "confidence")
    return rounded(made, ["repeat_rate", "cacheable_share", "p50", "p95", "p99"], 6)
