"""Rules on a document's words and lines, and verdicts on the hosts that documents come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WHITE, WHITE_RUN, column, packed, unpacked
from basketry.session import durable

# Fixed values
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A document also counts against its host beyond these.
MEAN_WORD_CHARS = (2.0, 20.0)
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINES = 0.3
# A host is rejected if its shrunk rate of failed documents, less two posterior standard deviations, is above this.
MAX_HOST_RATE = 0.9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(words: Column) -> Column:
    """Words inside a window of three words that the text holds twice or more.

    Window hashes are sorted with their places, so equal windows are neighbours; each repeated window adds the words that
    the repeated one before it did not reach.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(F.size(words) >= 3, F.sort_array(hashes))


def _repeated(ordered: Column) -> Column:
    same = lambda i, j: F.get(ordered, i)["h"].eqNullSafe(F.get(ordered, j)["h"])
    marked = F.filter(ordered, lambda x, k: same(k - 1, k) | same(k, k + 1))
    return F.sort_array(F.transform(marked, lambda x: x["i"]))


def _reach(places: Column) -> Column:
    steps = F.transform(
        places, lambda i, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), i - F.get(places, k - 1))).cast("bigint")
    )
    return F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0).cast("bigint"))


def measured(rows: DataFrame) -> DataFrame:
    """Adds the counts and base_failed to packed rows."""
    bare = F.btrim(F.col("_text"), F.lit(WHITE))
    empty = F.expr("cast(array() as array<string>)")
    step = rows.withColumn("_words", F.when(F.length(bare) > 0, F.split(bare, WHITE_RUN)).otherwise(empty))
    step = step.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0))
    step = step.withColumn("_ordered", _covered(F.col("_words")))
    step = step.withColumn("_places", _repeated(F.col("_ordered")))
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.translate("_text", WHITE, "")).cast("bigint"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": _reach(F.col("_places")),
            "n_lines": F.size("_lines").cast("bigint"),
        }
    )
    few = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return step.withColumn("base_failed", few | repeats).drop("_words", "_lines", "_ordered", "_places")


def failed_rules() -> dict[str, Column]:
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "base": F.col("base_failed"),
        "word_length": (mean < MEAN_WORD_CHARS[0]) | (mean > MEAN_WORD_CHARS[1]),
        "symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") > MAX_DUP_LINES * F.greatest(F.col("n_lines"), F.lit(1)),
    }


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per _host of (_host, _failed): n_docs, n_failed, rate (posterior mean) and host_rejected.

    The beta prior comes from the hosts themselves by the method of moments: the mean of their rates and the variance
    beyond what their sizes explain. Where the rates show no such variance, the prior weighs as much as all documents
    of an average host.
    """
    hosts = judged.groupBy("_host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("_failed").cast("bigint")).alias("n_failed")
    )
    hosts = durable(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("var"),
        F.avg(1 / F.col("n_docs")).alias("inv"),
        F.avg("n_docs").alias("size"),
    )
    noise = F.col("mean") * (1 - F.col("mean"))
    beyond = F.greatest(F.col("var") - noise * F.col("inv"), noise / (F.col("size") + 1))
    weight = F.greatest(F.when(beyond > 0, noise / beyond - 1).otherwise(F.lit(1.0)), F.lit(1.0))
    prior = moments.select(
        F.greatest(F.col("mean") * weight, F.lit(1e-6)).alias("_a"),
        F.greatest((1 - F.col("mean")) * weight, F.lit(1e-6)).alias("_b"),
    )
    # Two numbers for all hosts, read as scalars: nothing is joined.
    a = prior.select("_a").scalar() + F.col("n_failed")
    b = prior.select("_b").scalar() + F.col("n_docs") - F.col("n_failed")
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select(
        "_host", "n_docs", "n_failed", (a / (a + b)).alias("rate"), ((a / (a + b) - 2 * spread) > max_rate).alias("host_rejected")
    )


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    carry: Sequence[str] | None = None,
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """The columns `carry` of `docs` (all if not given) with the counts, base_failed, host_rate and kept added.

    A document is dropped if it has fewer than 50 words, if more than half its words lie in repeated windows of three, or
    if its host is rejected: one where nearly all documents fail some rule, judged on a rate shrunk towards all hosts'.
    A null text has no words; a null host is a host of its own; repeated rows count each. An empty table gives an empty
    result. Columns of `docs` named like a new one are replaced. DataFrame functions only.
    """
    columns = list(docs.columns if carry is None else carry)
    rows = packed(docs, id_col, text_col, columns, _host=column(host_col))
    measures = measured(rows).withColumn("_failed", F.lit(False))
    for failed in failed_rules().values():
        measures = measures.withColumn("_failed", F.col("_failed") | failed)
    stored = durable(measures.drop("_text", "_h"))
    verdicts = durable(host_verdicts(stored, max_rate).select(F.col("_host").alias("_host2"), "rate", "host_rejected"))
    both = stored.join(verdicts, stored["_host"].eqNullSafe(verdicts["_host2"]), "left")
    made = {name: F.col(name) for name in (*COUNTS, "base_failed")}
    return unpacked(both, columns, **made, host_rate=F.col("rate"), kept=~F.col("base_failed") & ~F.col("host_rejected"))
