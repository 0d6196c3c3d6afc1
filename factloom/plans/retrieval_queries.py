"""Queries over documents, embeddings, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import storage
from factloom.functions import keys, numbers, text
from factloom.operators import containment, goldset, reports, retrieval, segmentation
from factloom.session import spread, table

SOURCES = ["src0", "src1", "src2", "src3"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return retrieval.records(docs.select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("block_id"), "text"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("qid", F.col("rank").cast("long").alias("rank"), "evidence_id", F.round("score", 6).alias("score"))


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _records(spark, sf_dir), _questions(spark, sf_dir)
    return _shown(retrieval.lexical_topk(rows, asked, 10))


def restricted_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = retrieval.restrict(_records(spark, sf_dir), SOURCES), _questions(spark, sf_dir)
    return _shown(retrieval.lexical_topk(rows, asked, 5))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("E").alias("source_id"), F.col("vec_id").cast("string").alias("block_id"), F.concat(F.lit("E:"), F.col("vec_id").cast("string")).alias("evidence_id"), F.col("embedding").alias("vector"), "vec_id")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "vector")
    return _shown(retrieval.dense_topk(rows, asked, 5))


def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have an embedding, by benchmark text and by the embedding of the item's number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"))
    rows = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("evidence_id"), F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("block_id"), "text", F.col("doc_id").alias("_id")).join(vectors, "_id")
    asked = _questions(spark, sf_dir).join(vectors, F.col("qid") == F.col("_id")).select("qid", "text", "vector")
    return _shown(retrieval.hybrid(rows, asked, 10)).withColumn("score", F.round("score", 6))


def _relevant(rows: DataFrame, asked: DataFrame) -> DataFrame:
    found = containment.containing(rows.select(F.col("evidence_id").alias("text_id"), "text"), asked.select(F.col("qid").alias("passage_id"), F.col("text").alias("passage")))
    return found.select(F.col("passage_id").alias("qid"), F.col("text_id").alias("evidence_id"))


def _measures(first: DataFrame) -> DataFrame:
    return retrieval.evaluate(first).select("questions", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5", "mrr")])


def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions; documents that contain the passage are relevant.
    The lexical leg alone, over its complete ranking."""
    rows, asked = _records(spark, sf_dir), _questions(spark, sf_dir)
    return _measures(retrieval.lexical_first_ranks(rows, asked, storage.written(_relevant(rows, asked), "relevant")))


def hybrid_retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``retrieval_eval``, over the complete hybrid ranking of all documents (those without
    a vector have the dense score 0); questions without a vector are ranked by their terms only."""
    vectors = _vectors(spark, sf_dir).select("block_id", "vector")
    rows = _records(spark, sf_dir).join(vectors, "block_id", "left")
    asked = _questions(spark, sf_dir)
    relevant = storage.written(_relevant(rows, asked), "relevant")
    asked = asked.join(relevant.select("qid").distinct(), "qid", "left_semi")
    asked = asked.join(vectors, F.col("qid").cast("string") == F.col("block_id"), "left").select("qid", "text", "vector")
    both, words = asked.where("vector IS NOT NULL"), asked.where("vector IS NULL")
    first = retrieval.hybrid_first_ranks(rows, both, relevant.join(both.select("qid"), "qid", "left_semi"))
    rest = retrieval.lexical_first_ranks(rows, words, relevant.join(words.select("qid"), "qid", "left_semi"))
    return _measures(first.unionByName(rest))


def passage_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as held-out values: which documents have them, or name their ids."""
    gold = table(spark, sf_dir, "benchmark").select(F.format_string("PG-V01-S001-%03d", "item_id").alias("annotation_id"), F.lit("held_out").alias("split"), F.col("text").alias("raw_value"))
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document"), "text")
    return goldset.leaks(gold, docs)


def retrieval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("evidence_id", "source_id", "block_id", F.length("text").cast("long").alias("n_chars"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = keys.document_id(F.concat(F.col("source"), F.lit(" "), F.col("doc_id").cast("string")), F.sha2("text", 256))
    return docs.select("doc_id", keys.sha256_upper(F.col("text")).alias("sha256"), name.alias("document_id"), keys.block_id(name, F.lit(1)).alias("block_id"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return reports.duplicated(docs, "h").select(F.col("h").alias("sha256"), "n")


def keep_first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return reports.keep_first(docs, ["sha256"], ["doc_id"])


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("block_id"), "text")
    rows = segmentation.lines(docs)
    return rows.select("block_id", F.col("line_number").cast("long").alias("line_number"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("line_md5"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("block_id"), F.lit(1).alias("sequence"), F.lit("page_text").alias("block_type"), "text")
    return segmentation.statements(docs).drop("text", "context")


def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.length("text").cast("long").alias("chars"))
    found = reports.page_audit(docs)
    return found.select("document", "pages", "total_chars", "min_chars", "max_chars", "mean_chars", F.size("zero_pages").cast("long").alias("n_zero"), F.size("near_empty_pages").cast("long").alias("n_near_empty"), "scan_risk", F.array_join("sample_pages", ",").alias("sample_pages"))


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring documents of a source that have fewer than 1,000 characters."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.length("text").cast("long").alias("chars"))
    return reports.page_runs(docs, 1000)


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks in sequence, with their evidence ids."""
    turns = table(spark, sf_dir, "conversations")
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.md5("text"))
    rows = turns.withColumn("sequence", F.row_number().over(order).cast("long"))
    name = F.concat(F.lit("CONV-"), F.col("conv_id").cast("string"))
    return rows.select("conv_id", "sequence", "role", keys.block_id(name, F.col("sequence")).alias("block_id"), F.length("text").cast("long").alias("n_chars"))


def thread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).cast("long").alias("chars"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    unit = numbers.unit(F.col("embedding"))
    return rows.select("vec_id", F.round(numbers.dot(unit, unit), 6).alias("norm"), F.round(F.sqrt(numbers.dot(F.col("embedding"), F.col("embedding"))), 4).alias("length"))


def comparable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal in the comparison form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(text.comparable(F.col("text")).cast("binary")).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).select("first", "n")


_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def _lexical(records: str, k: int | None) -> str:
    return f"""
    WITH r AS ({records}),
    q AS (SELECT item_id AS qid, text FROM benchmark),
    n AS (SELECT count(*) AS n FROM r),
    tf AS (SELECT evidence_id, term, count(*) AS tf FROM (SELECT evidence_id, unnest({_TERMS}) AS term FROM r) GROUP BY 1, 2),
    idf AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
    w AS (SELECT evidence_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
    nn AS (SELECT evidence_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
    qt AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_TERMS}) AS term FROM q) GROUP BY 1, 2),
    qw AS (SELECT qid, term, tf * idf AS w FROM qt JOIN idf USING (term)),
    qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
    s AS (SELECT qid, evidence_id, sum(w.w * qw.w) AS s FROM w JOIN qw USING (term) GROUP BY 1, 2),
    scored AS (SELECT qid, evidence_id, round(s / (nn.norm * qn.norm), 10) AS score FROM s JOIN nn USING (evidence_id) JOIN qn USING (qid)),
    every AS (SELECT q.qid, r.evidence_id, r.source_id, r.block_id, coalesce(scored.score, 0.0) AS score FROM q CROSS JOIN r LEFT JOIN scored ON scored.qid = q.qid AND scored.evidence_id = r.evidence_id),
    ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_id, block_id) AS rank, evidence_id, score FROM every)
    SELECT qid, rank, evidence_id, round(score, 6) AS score FROM ranked{f" WHERE rank <= {k}" if k else ""}"""


_ALL = "SELECT source || ':' || doc_id AS evidence_id, source AS source_id, CAST(doc_id AS VARCHAR) AS block_id, text FROM documents WHERE length(trim(text)) > 0"
_SOME = _ALL + " AND source IN (" + ", ".join(f"'{s}'" for s in SOURCES) + ")"
_COSINE = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])) * list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"

QUERIES = {f.__name__: f for f in (lexical_topk, restricted_lexical_topk, dense_topk, hybrid_rrf_topk, retrieval_eval, hybrid_retrieval_eval, passage_leaks, retrieval_records, content_hash, exact_duplicates, keep_first_documents, line_offsets, statements, page_audit, page_runs, conversation_blocks, thread_summary, embedding_norms, comparable_text)}

ORACLES = {
    "lexical_topk": _lexical(_ALL, 10),
    "restricted_lexical_topk": _lexical(_SOME, 5),
    "dense_topk": f"""
        WITH s AS (SELECT q.vec_id AS qid, e.vec_id, round({_COSINE.format(a='e.embedding', b='q.embedding')}, 10) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM s)
        SELECT qid, rank, 'E:' || vec_id AS evidence_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "hybrid_rrf_topk": f"""
        WITH r AS (SELECT source || ':' || doc_id AS evidence_id, source AS source_id, CAST(doc_id AS VARCHAR) AS block_id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
        q AS (SELECT item_id AS qid, text, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
        n AS (SELECT count(*) AS n FROM r),
        tf AS (SELECT evidence_id, term, count(*) AS tf FROM (SELECT evidence_id, unnest({_TERMS}) AS term FROM r) GROUP BY 1, 2),
        idf AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
        w AS (SELECT evidence_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
        nn AS (SELECT evidence_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
        qt AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_TERMS}) AS term FROM q) GROUP BY 1, 2),
        qw AS (SELECT qid, term, tf * idf AS w FROM qt JOIN idf USING (term)),
        qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
        s AS (SELECT qid, evidence_id, sum(w.w * qw.w) AS s FROM w JOIN qw USING (term) GROUP BY 1, 2),
        lex AS (SELECT qid, evidence_id, round(s / (nn.norm * qn.norm), 10) AS score FROM s JOIN nn USING (evidence_id) JOIN qn USING (qid)),
        both_ AS (SELECT q.qid, r.evidence_id, r.source_id, r.block_id, coalesce(lex.score, 0.0) AS l, round({_COSINE.format(a='r.embedding', b='q.embedding')}, 10) AS d FROM r CROSS JOIN q LEFT JOIN lex ON lex.qid = q.qid AND lex.evidence_id = r.evidence_id),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY l DESC, source_id, block_id) AS lr, row_number() OVER (PARTITION BY qid ORDER BY d DESC, source_id, block_id) AS dr FROM both_),
        fused AS (SELECT *, round(1.0 / (60 + lr) + 1.0 / (60 + dr), 12) AS f FROM ranks),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f DESC, source_id, block_id) AS rank FROM fused)
        SELECT qid, rank, evidence_id, round(f, 6) AS score FROM ranked WHERE rank <= 10""",
    "retrieval_eval": f"""
        WITH top AS ({_lexical(_ALL, None)}),
        rel AS (SELECT b.item_id AS qid, d.source || ':' || d.doc_id AS evidence_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
        f AS (SELECT rel.qid, min(top.rank) AS r FROM rel LEFT JOIN top USING (qid, evidence_id) GROUP BY 1)
        SELECT count(*) AS questions, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3,
               round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f""",
    "hybrid_retrieval_eval": f"""
        WITH r AS (SELECT source || ':' || doc_id AS evidence_id, source AS source_id, CAST(doc_id AS VARCHAR) AS block_id, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE length(trim(text)) > 0),
        rel AS (SELECT b.item_id AS qid, r.evidence_id FROM r JOIN benchmark b ON contains(r.text, b.text)),
        q AS (SELECT item_id AS qid, text, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id WHERE item_id IN (SELECT qid FROM rel)),
        n AS (SELECT count(*) AS n FROM r),
        tf AS (SELECT evidence_id, term, count(*) AS tf FROM (SELECT evidence_id, unnest({_TERMS}) AS term FROM r) GROUP BY 1, 2),
        idf AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
        w AS (SELECT evidence_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
        nn AS (SELECT evidence_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
        qt AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_TERMS}) AS term FROM q) GROUP BY 1, 2),
        qw AS (SELECT qid, term, tf * idf AS w FROM qt JOIN idf USING (term)),
        qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
        s AS (SELECT qid, evidence_id, sum(w.w * qw.w) AS s FROM w JOIN qw USING (term) GROUP BY 1, 2),
        lex AS (SELECT qid, evidence_id, round(s / (nn.norm * qn.norm), 10) AS score FROM s JOIN nn USING (evidence_id) JOIN qn USING (qid)),
        both_ AS (SELECT q.qid, q.embedding IS NULL AS words, r.evidence_id, r.source_id, r.block_id, coalesce(lex.score, 0.0) AS l, coalesce(round({_COSINE.format(a='r.embedding', b='q.embedding')}, 10), 0.0) AS d FROM r CROSS JOIN q LEFT JOIN lex ON lex.qid = q.qid AND lex.evidence_id = r.evidence_id),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY l DESC, source_id, block_id) AS lr, row_number() OVER (PARTITION BY qid ORDER BY d DESC, source_id, block_id) AS dr FROM both_),
        fused AS (SELECT *, CASE WHEN words THEN -lr ELSE round(1.0 / (60 + lr) + 1.0 / (60 + dr), 12) END AS f FROM ranks),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f DESC, source_id, block_id) AS rank FROM fused),
        best AS (SELECT qid, min(rank) AS r FROM ranked JOIN rel USING (qid, evidence_id) GROUP BY 1)
        SELECT count(*) AS questions, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3,
               round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(1.0 / r), 6) AS mrr FROM best""",
    "passage_leaks": """
        SELECT 'PG-V01-S001-' || lpad(CAST(item_id AS VARCHAR), 3, '0') AS annotation_id, doc_id AS document, 'raw_value' AS what FROM documents d JOIN benchmark b ON length(b.text) >= 40 AND contains(d.text, b.text)
        UNION ALL SELECT 'PG-V01-S001-' || lpad(CAST(item_id AS VARCHAR), 3, '0'), doc_id, 'annotation_id' FROM documents d JOIN benchmark b ON contains(d.text, 'PG-V01-S001-' || lpad(CAST(item_id AS VARCHAR), 3, '0'))""",
    "retrieval_records": f"SELECT evidence_id, source_id, block_id, length(text) AS n_chars FROM ({_ALL})",
    "content_hash": "SELECT doc_id, upper(sha256(text)) AS sha256, 'DOC-' || upper(source) || '-' || doc_id AS document_id, 'DOC-' || upper(source) || '-' || doc_id || '-B0001' AS block_id FROM documents",
    "exact_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "keep_first_documents": "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY 2",
    "comparable_text": r"""
        WITH f AS (SELECT doc_id, regexp_replace(trim(regexp_replace(translate(replace(lower(text), 'ß', 'ss'), '‘’‚‛“”„‟‐‑‒–—―−', repeat(chr(39), 4) || repeat(chr(34), 4) || '-------'), '\s+', ' ', 'g')), '\s*[.!?]$', '') AS form FROM documents)
        SELECT min(doc_id) AS first, count(*) AS n FROM f GROUP BY form""",
    "line_offsets": r"""
        WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS block_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
        o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY block_id ORDER BY n) - length(line) - 1 AS off FROM l),
        t AS (SELECT block_id, n, off, line, regexp_replace(line, '^\s+', '') AS ls, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS body FROM o)
        SELECT block_id, n AS line_number, CAST(off + length(line) - length(ls) AS BIGINT) AS start, CAST(off + length(line) - length(ls) + length(body) AS BIGINT) AS "end", md5(body) AS line_md5 FROM t WHERE body <> ''""",
    "statements": r"""
        WITH l AS (SELECT source, CAST(doc_id AS VARCHAR) AS block_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
        o AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY block_id ORDER BY n) AS BIGINT) - length(line) - 1 AS off, regexp_replace(line, '^\s+', '') AS ls FROM l),
        t AS (SELECT *, regexp_replace(ls, '\s+$', '') AS body, off + length(line) - length(ls) AS start FROM o),
        h AS (SELECT *, regexp_extract_all(body, '[A-Za-z0-9][A-Za-z0-9''&/\-]*') AS words FROM t),
        g AS (SELECT *, length(body) > 0 AND length(body) < 120 AND (suffix(body, ':') OR NOT regexp_matches(body, '[.!?]$') AND len(words) BETWEEN 1 AND 12 AND (upper(body) = body AND lower(body) <> body OR
              len(list_filter(words, lambda w: lower(w) IN ('will', 'must', 'shall', 'is', 'are', 'was', 'were', 'has', 'have', 'had', 'recommends', 'recommended', 'approved', 'completed'))) = 0
              AND len(list_filter(words, lambda w: regexp_matches(w, '^[A-Z]'))) >= greatest(1, len(words) - 1))) AS heading FROM h),
        c AS (SELECT *, lag(heading) OVER w AS before, lag(start) OVER w AS before_start FROM g WINDOW w AS (PARTITION BY block_id ORDER BY n)),
        s AS (SELECT *, CASE WHEN regexp_matches(body, '(?i)^Recommendation\s+\d+\s*[:\-–—]\s*.+$') THEN [body] ELSE string_split(regexp_replace(body, '([.!?])([ \t]+)(["''\[(]?[A-Z0-9])', '\1' || chr(1) || '\2\3', 'g'), chr(1)) END AS parts FROM c WHERE body <> '' AND NOT heading),
        p AS (SELECT source, block_id, n, start, before, before_start, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS k, parts FROM s),
        e AS (SELECT *, start + coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: length(x))), 0) AS beg, regexp_replace(part, '^\s+', '') AS ps FROM p)
        SELECT source AS source_id, block_id, 1 AS sequence, 'page_text' AS block_type, n AS line_number, CAST(beg + length(part) - length(ps) AS BIGINT) AS start, CAST(beg + length(part) - length(ps) + length(regexp_replace(ps, '\s+$', '')) AS BIGINT) AS "end",
               CASE WHEN before THEN before_start END AS context_start FROM e WHERE regexp_replace(ps, '\s+$', '') <> ''""",
    "page_audit": """
        WITH p AS (SELECT source AS document, doc_id, length(text) AS chars FROM documents)
        SELECT document, count(*) AS pages, CAST(sum(chars) AS BIGINT) AS total_chars, min(chars) AS min_chars, max(chars) AS max_chars, round(avg(chars), 2) AS mean_chars,
               count(*) FILTER (WHERE chars = 0) AS n_zero, count(*) FILTER (WHERE chars BETWEEN 1 AND 49) AS n_near_empty,
               CASE WHEN count(*) FILTER (WHERE chars = 0) = 0 THEN 'none' WHEN count(*) FILTER (WHERE chars = 0) <= .1 * count(*) THEN 'low' WHEN count(*) FILTER (WHERE chars = 0) <= .4 * count(*) THEN 'medium' ELSE 'high' END AS scan_risk,
               array_to_string(list_sort(list_distinct([1, CAST(floor((count(*) + 1) / 2) AS BIGINT), count(*)])), ',') AS sample_pages
        FROM p GROUP BY 1""",
    "page_runs": """
        WITH p AS (SELECT source AS document, doc_id AS page, coalesce(length(text), 0) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
        s AS (SELECT *, place - row_number() OVER (PARTITION BY document ORDER BY page) AS island FROM p WHERE chars < 1000)
        SELECT document, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM s GROUP BY document, island""",
    "conversation_blocks": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS sequence FROM conversations)
        SELECT conv_id, sequence, role, 'CONV-' || conv_id || '-B' || lpad(CAST(sequence AS VARCHAR), 4, '0') AS block_id, length(text) AS n_chars FROM r""",
    "thread_summary": "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS chars, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM conversations GROUP BY 1",
    "embedding_norms": "SELECT vec_id, 1.0::DOUBLE AS norm, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS length FROM embeddings",
}
