"""Line deduplication across documents, in DataFrame functions alone.

Plan: explode the lines to 128-bit hashes of their keys, which are written; a minimum and maximum of doc_id per hash
(pre-aggregated, so a line that a third of all documents hold is one row per task) tells which keys at least two documents hold
and which document keeps them; the hashed lines meet those keys in a shuffled join that adaptive execution may split where a key
is hot; the dropped positions, a set per document, meet the documents, which reassemble their lines by position in one pass over
the lines. Texts are shuffled once.

Cases: a null or empty text is one empty line; a null doc_id stands for no document, so its lines count nowhere and all stay;
rows of one doc_id are one document, a repeated row is treated like the first; an empty table gives an empty table; columns of
the input beside doc_id and text are carried through untouched whatever their names (n_lines and n_dropped are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import free_name, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dedup_lines(documents: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """documents with text cut down to the lines that stay, n_lines (before) and n_dropped.

    Lines whose key has min_chars code points at least and is held by min_docs documents at least go from every document but
    the smallest doc_id that holds the key.
    """
    text, doc = F.col("text"), F.col("doc_id")
    mark = F.xxhash64(text)  # tells rows of one doc_id with different texts apart
    lines = (
        documents.where(doc.isNotNull())
        .select(doc.alias("_d"), mark.alias("_m"), _lines(text).alias("_all"))  # below the generator, so that a text is hashed once, not for each line
        .select("_d", "_m", F.posexplode("_all").alias("_p", "_line"))
        .select("_d", "_m", "_p", line_key(F.col("_line")).alias("_k"))
        .where(F.length("_k") >= min_chars)
        .select("_d", "_m", "_p", F.xxhash64("_k").alias("_h"), F.xxhash64(F.lit(1), "_k").alias("_g"))
    )
    lines = written(lines)  # read twice: the texts are split and hashed once
    if min_docs == 2:  # two documents differ just where the smallest and the largest do
        shared = lines.groupBy("_h", "_g").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last")).where("_first < _last")
    else:
        shared = lines.groupBy("_h", "_g", "_d").agg(F.lit(1).alias("_one")).groupBy("_h", "_g").agg(F.min("_d").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") >= min_docs)
    # Written, so that the join has a shuffle of its own on both sides and adaptive execution can split a hot line.
    shared = written(shared)
    dropped = (
        lines.join(shared.select("_h", "_g", "_first"), ["_h", "_g"])
        .where("_d > _first")
        .groupBy("_d", "_m")
        .agg(F.collect_set("_p").alias("_gone"))
    )
    own, of, other, gone = (free_name(documents, x) for x in ("_mark", "_doc", "_other", "_gone"))
    # The array of the lines is bound once by the outer function: within a lambda a column is evaluated anew for each element.
    by_place = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i)), "\n")
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.get(F.transform(F.array(_lines(text)), by_place), F.lit(0)))
    joined = documents.withColumn(own, mark).join(
        dropped.select(F.col("_d").alias(of), F.col("_m").alias(other), F.col("_gone").alias(gone)), (doc == F.col(of)) & (F.col(own) == F.col(other)), "left"
    )
    return joined.select(
        *[kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns if c not in ("n_lines", "n_dropped")],
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    return dedup_lines(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), each AS (
  SELECT doc_id, r, unnest(parts) AS line, unnest(range(len(parts))) AS p FROM lines
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
), shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT e.*, s.k IS NOT NULL AND e.doc_id <> s.first AS gone FROM keyed e LEFT JOIN shared s ON e.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
