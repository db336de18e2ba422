"""Lines found in many documents, dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WHITE, ascii_lower, by_row, movable, unpacked
from basketry.session import durable

MIN_DOCS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The columns of `docs` with n_lines, n_dropped and kept_text added (replacing columns of these names).

    Lines are split at \\n; a line's key is trimmed of ASCII white space and lower-cased in A-Z. A key of at least
    `min_chars` code points found in at least `min_docs` rows loses all its lines everywhere; the others stay in order,
    joined by \\n. A null or empty text is one empty line, which is never dropped. Every row counts as a document, also a
    repeated one or one with a null id; an empty table gives an empty result.

    Only hashes of lines are shuffled by line. The table of common lines is stored, so that a line of a third of all
    documents meets it in a join whose large partitions Spark splits; the texts move once, by document.
    """
    rows = movable(docs, id_col, text_col)
    text = F.coalesce("_raw", F.lit(""))
    lines = F.split(text, "\n")
    hashed = F.transform(lines, lambda x: F.when(F.length(line_key(x)) >= min_chars, F.md5(line_key(x).cast("binary"))))
    seen = durable(rows.select("_id", "_h", hashed.alias("hashes")))
    counted = seen.select(F.explode(F.array_distinct(F.array_compact("hashes"))).alias("line")).groupBy("line").count()
    common = durable(counted.filter(F.col("count") >= min_docs).select("line"))
    placed = seen.select("_id", "_h", F.posexplode("hashes").alias("at", "line")).filter(F.col("line").isNotNull())
    dropped = placed.join(common, "line", "left_semi").groupBy("_id", "_h").agg(F.collect_set("at").alias("_gone"))
    both = by_row(rows, dropped, "left").withColumn("_lines", lines)
    both = both.withColumn("_gone", F.coalesce("_gone", F.expr("cast(array() as array<int>)")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.size("_gone") == 0, text).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    )
    return unpacked(
        both,
        docs.columns,
        text_col,
        n_lines=F.size("_lines").cast("bigint"),
        n_dropped=F.size("_gone").cast("bigint"),
        kept_text=kept,
    )
