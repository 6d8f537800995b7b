"""Similarity join of documents on word shingles (see ``operators.set_join``), its classes, and one document of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.set_join import _BLOCK, candidates, classes, near_duplicates, postings, profiles, set_key, shared_postings, shingle_sets, small, word_hashes  # noqa: F401
from .common import counted_cut, cut, table


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near duplicates: the one with the least id (nulls last), then the least
    hash of its text.

    Rows are told apart by id and text: of different texts under one id each is judged by itself, and of rows that are
    equal in both, one stays. Rows without words are not alike to any others and all stay. All columns are kept,
    whatever their names.
    """
    prof, names = classes(docs, id_col, text_col, 16, 1_000_000, 64)
    rows = cut(prof.where("sk is not null").groupBy("doc_id", "tk", "sk").agg(F.count(F.lit(1)).alias("copies")).join(names.select("sk", "root"), "sk"))
    best = cut(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tk")).alias("x")).select("root", F.col("x.doc_id").alias("best_id"), F.col("x.tk").alias("best_tk")))  # a row a class, apart, so that the rows of a large class can be split
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("tk") == F.col("best_tk"))
    marks = rows.join(best, "root").where(~stays | (F.col("copies") > 1)).select("doc_id", "tk", F.when(stays, 1).otherwise(2).alias("mark"))
    marks, n = counted_cut(marks)
    marks = small(marks, n).select(F.struct("doc_id", "tk").alias("k"), "mark")
    whole = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tk")).alias("key"))
    marked = whole.join(marks, (F.col("key.doc_id").eqNullSafe(F.col("k.doc_id"))) & (F.col("key.tk") == F.col("k.tk")), "left")
    once = marked.where("mark is null").select("row.*")
    return once.unionByName(marked.where("mark = 1").groupBy("key").agg(F.first("row").alias("row")).select("row.*"))


def op4_jaccard_join(spark, sf_dir):
    """Classes of near-duplicate documents, by all links of 0.75 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w),
u AS (SELECT md5(array_to_string(list_sort(ss), chr(10))) AS k, min(doc_id) AS rep, any_value(ss) AS ss, len(any_value(ss)) AS n FROM s WHERE len(ss) > 0 GROUP BY 1),
t AS (SELECT rep, n, unnest(ss) AS g FROM u),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * i >= 75 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT rep, rep FROM u UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT doc_id, ss, md5(array_to_string(list_sort(ss), chr(10))) AS k FROM s)
SELECT k.doc_id, CAST(len(k.ss) AS BIGINT) AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id
FROM k LEFT JOIN u ON u.k = k.k AND len(k.ss) > 0 LEFT JOIN m ON m.x = u.rep
"""
