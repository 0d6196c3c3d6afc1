"""Source divergence audit (operator 11): wide term vectors.

Terms are counted by (language, source) inside each task, with the number of texts that have
them. The counts of a term are then pivoted into an array with a place for every source of its language;
higher-order functions turn that array into the contributions of the term to all pairs of
sources, and an aggregation, begun in each task, sums them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.frames import settled
from factloom.llm import arrow, storage
from factloom.llm import text_kernels as tk

#: Texts a term must be in, of its language.
LEAST_TEXTS = 3
#: Shares are whole numbers of this fraction.
SCALE = 1_000_000_000
#: Best terms reported of each group.
TOP_TERMS = 200
#: Counts a task holds before it hands them on.
HELD = 1 << 20
#: The arrays of a language travel once for each of so many parts of its terms.
PARTS = 64

# What stands between terms is ASCII other than letters; only A-Z are lower-cased.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_COUNTS = "lang string, source string, term string, n long, texts long"


def _chunk_counts(chunk: tk.TextChunk, groups: np.ndarray) -> pa.Table | None:
    """(group, term, n, texts) of the texts of a chunk, whose groups are given as numbers."""
    starts, ends, per_text = tk.words(chunk, _BETWEEN)
    if not len(starts):
        return None
    inside = _LOWER[chunk.data[~_BETWEEN[chunk.data]]]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(inside)).dictionary_encode()
    codes, size = terms.indices.to_numpy(), len(terms.dictionary)
    text = np.repeat(np.arange(len(chunk)), np.diff(per_text))
    pair, n = np.unique(text * size + codes, return_counts=True)
    key, own = np.unique(groups[pair // size] * size + pair % size, return_inverse=True)
    total = np.bincount(own, n, len(key)).astype(np.int64)
    return pa.table({"group": key // size, "term": terms.dictionary.take(pa.array(key % size)), "n": total, "texts": np.bincount(own, minlength=len(key))})


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, texts), summed as far as one task sees; a key can have several rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow.BATCH_ROWS))
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{k}") for k, c in enumerate((lang, source, text))])

    def run(batches):
        numbers: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []
        count = 0

        def summed() -> pa.Table:
            found = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("n", "sum"), ("texts", "sum")])
            return found.select(["group", "term", "n_sum", "texts_sum"]).rename_columns(["group", "term", "n", "texts"])

        def out(found: pa.Table):
            names = list(numbers)
            for batch in found.combine_chunks().to_batches(max_chunksize=50_000):
                own = batch.column(0)
                langs, sources = (pa.array([x[k] for x in names], pa.string()).take(own) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, batch.column(1).cast(pa.string()), batch.column(2), batch.column(3)], names=["lang", "source", "term", "n", "texts"])

        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            groups = np.array([numbers.setdefault(p, len(numbers)) for p in pairs], np.int64)
            for chunk in tk.text_chunks(batch.column(2)):
                found = _chunk_counts(chunk, groups[chunk.first : chunk.first + len(chunk)])
                if found is None:
                    continue
                held.append(found)
                count += len(found)
                if count > HELD:
                    held = [summed()]
                    count = len(held[0])
                    if count > HELD // 2:
                        yield from out(held[0])
                        held, count = [], 0
        if held:
            yield from out(summed())

    return arrow.mapped(rows, run, _COUNTS)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact for any count."""
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), total.cast("decimal(19,0)"))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_TEXTS) -> DataFrame:
    """(lang, term, counts): the terms in at least ``least`` texts of their language, and their
    counts in the sources that have them."""
    counted = term_counts(docs, text, lang, source)
    # one exchange serves both sums: rows of a term meet, by source first
    one = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    met = one.groupBy("lang", "term").agg(F.sum("texts").alias("texts"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return met.where(F.col("texts") >= least).select("lang", "term", "counts")


def languages(docs: DataFrame, terms: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, terms, total, sources): for each language its number of kept terms, the divisor of its
    shares, and all its sources in order with theirs. Sources without a term are there too."""
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    own = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    rows = groups.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n", "terms"])
    packed = F.sort_array(F.collect_list(F.struct("source", (F.col("n") + F.col("terms")).alias("total"))))
    return rows.groupBy("lang").agg(F.max("terms").alias("terms"), (F.sum("n") + F.max("terms")).alias("total"), packed.alias("sources"))


def wide(terms: DataFrame, langs: DataFrame) -> DataFrame:
    """Terms with arrays that have a place for each source of the language: counts and shares ``p``;
    ``q`` is the share in the language. A language's terms are joined in parts, for one language may
    have most of them."""
    parts = langs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).join(parts.drop("terms"), ["lang", "part"])
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    rows = settled(rows, {"found": F.map_from_entries("counts"), "q": _share(whole, F.col("total"))})
    rows = settled(rows, {"n": F.transform("sources", lambda s: F.coalesce(F.try_element_at("found", s["source"]), F.lit(0).cast("long")))})
    rows = settled(rows, {"p": F.zip_with("n", "sources", lambda n, s: _share(n, s["total"]))})
    return rows.select("lang", "term", "sources", "n", "p", "q")


def pair_sums(vectors: DataFrame) -> DataFrame:
    """(lang, i, j, there, seen, back, lone): sums over the terms that source i has. ``there`` is the sum of i's gaps
    from j, of ``seen`` terms; ``back`` that of j's gaps from i, of the ``lone`` terms that j does not have. So a
    term contributes for the sources that have it, and a pair's other terms are all alike."""
    held = F.filter(F.transform("p", lambda p, i: F.struct(i.alias("i"), p.alias("p"), F.get("n", i).alias("n"))), lambda x: x["n"] > 0)
    each = vectors.select("lang", "n", "p", F.explode(held).alias("own"))
    own = F.col("own.p")
    gaps = F.zip_with("p", "n", lambda q, n: F.struct(_gap(own, q).alias("there"), F.when(n == 0, _gap(q, own)).alias("back")))
    emitted = each.select("lang", F.col("own.i").alias("i"), F.posexplode(gaps).alias("j", "c"))
    return emitted.groupBy("lang", "i", "j").agg(F.sum("c.there").alias("there"), F.count("*").alias("seen"), F.sum("c.back").alias("back"), F.count("c.back").alias("lone"))


def pair_values(langs: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language. Terms that neither has have the least
    share in both."""
    least = lambda s: _share(F.lit(0), F.greatest(s["total"], F.lit(1)))
    rows = langs.select("lang", "terms", "sources", F.posexplode("sources").alias("i", "s")).select("lang", "terms", "i", "s", F.posexplode("sources").alias("j", "o")).where("i <> j")
    rows = rows.select("lang", "terms", "i", "j", F.col("s.source").alias("source"), F.col("o.source").alias("item"), _gap(least(F.col("s")), least(F.col("o"))).alias("apart"))
    back = sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), F.col("back").alias("_back"), F.col("lone").alias("_lone"))
    found = rows.join(sums.select("lang", "i", "j", "there", "seen"), ["lang", "i", "j"], "left").join(back, ["lang", "i", "j"], "left").na.fill(0, ["there", "seen", "_back", "_lone"])
    rest = (F.col("terms") - F.col("seen") - F.col("_lone")) * F.col("apart")
    return found.select("lang", "source", "item", (F.col("there") + F.col("_back") + F.when(F.col("terms") > F.col("seen") + F.col("_lone"), rest).otherwise(0)).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_TEXTS, top: int = TOP_TERMS) -> DataFrame:
    """How far each source's use of terms is from the other sources' and from its language's.

    Terms are runs of ASCII letters and of any other characters beyond ASCII. A share is
    p = 1 + floor(SCALE * (count + 1) / (N + V)) with N the group's occurrences of kept terms and V the number
    of kept terms; the gap of p from q is floor((p - q)^2 / q). Returns (lang, source, part, item, value,
    rank): part ``pair`` has every other source of the language, with the sum of all kept terms' gaps (0
    where there are none); part ``term`` the kept terms that the group has and uses more than its
    language, up to rank ``top``.

    Null texts, languages and sources count as ''. Each row is a text of its own, repeated rows too. Groups
    without a term are reported. Ties go by item in order of UTF-8. An empty table gives no rows. Other
    columns are not read.
    """
    terms = storage.written(kept_terms(docs, text, lang, source, least), "terms")
    langs = storage.written(languages(docs, terms, lang, source), "languages")
    vectors = wide(terms, langs)
    sums = storage.written(pair_sums(vectors), "sums")  # of all pairs of sources, which the result has too
    pairs = pair_values(langs, sums).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    own = F.transform("sources", lambda s, k: F.struct(s["source"].alias("source"), F.get("n", k).alias("n"), F.get("p", k).alias("p")))
    used = vectors.select("lang", "term", "q", F.explode(F.filter(own, lambda x: (x["n"] > 0) & (x["p"] > F.col("q")))).alias("own"))
    used = used.select("lang", "own.source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("own.p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return pairs.select("*", rank).unionByName(used.select("*", rank).where(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
w AS (SELECT id, lang, source, unnest(found) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
gs AS (SELECT lang, source, CAST(coalesce(t.n, 0) + coalesce(v.v, 0) AS HUGEINT) AS total
       FROM g LEFT JOIN t USING (lang, source) LEFT JOIN v USING (lang)),
ls AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang),
p AS (SELECT gs.lang, gs.source, k.term, coalesce(c.n, 0) AS n,
             1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // gs.total AS p
      FROM gs JOIN k ON gs.lang = k.lang LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = k.term),
q AS (SELECT c.lang, c.term, 1 + CAST(1000000000 AS HUGEINT) * (CAST(sum(c.n) AS HUGEINT) + 1) // (any_value(ls.n) + any_value(v.v)) AS q
      FROM c JOIN ls ON c.lang = ls.lang JOIN v ON c.lang = v.lang GROUP BY c.lang, c.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT) AS value
          FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
