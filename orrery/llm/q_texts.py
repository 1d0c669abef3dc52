"""Problems 7 to 9: queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.garble import garbled
from orrery.llm.leak import leaked, without_leaks
from orrery.llm.mixture import mixture_of, shares
from orrery.llm.tokens import TOKENIZER, with_token_counts
from orrery.sources.tables import table


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "eval_item"),
        doc_id=F.col("doc_id"),
        doc_text=F.col("text"),
        item_id=F.col("item_id"),
        item_text=F.col("text"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 12 consecutive words of a test item, and the item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the longest verbatim match and where it begins."""
    return _leaks(spark, sf_dir)


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold no test item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return without_leaks(docs, _leaks(spark, sf_dir), "doc_id")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mix_target").select(F.lower(F.trim("source")).alias("src"), F.col("target_share").alias("share"), F.col("max_repeats").cast("long").alias("cap"))


def _mix(spark: SparkSession, sf_dir: str, tokenizer: str) -> tuple[DataFrame, int, list[str]]:
    text = F.col("text")
    # Prose counts for more than tables of figures, and fragments for less.
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    weight = F.greatest(letters * letters * F.least(F.length(text) / 400, F.lit(1.0)), F.lit(0.05))
    cols = {"src": F.lower(F.trim("source")), "id": F.col("doc_id"), "weight": weight}
    return mixture_of(with_token_counts(table(spark, sf_dir, "documents"), text, cols, tokenizer, "size"), _targets(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents of the mix, each with its tokens and how often it is repeated."""
    mix, *_ = _mix(spark, sf_dir, tokenizer)
    return mix.select(F.col("id").alias("doc_id"), F.col("src").alias("source"), F.col("size").alias("n_tokens"), F.col("copies").alias("repeats"))


def p8_shares(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each source's target, its actual share of the mix and of the corpus's size, and why it has less than its target."""
    mix, *rest = _mix(spark, sf_dir, tokenizer)
    out = shares(mix, _targets(spark, sf_dir), *rest)
    return out.select(
        F.col("src").alias("source"), "target_share", F.round("actual_share", 6).alias("actual_share"), F.round("share_of_total", 6).alias("share_of_total"), F.col("size").alias("n_tokens"), F.col("records").alias("n_documents"), F.col("max_copies").alias("max_repeats_used"), "short"
    )


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "documents"), ident=F.col("doc_id"), text=F.col("text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of which some stretch was decoded wrongly."""
    return _garbled(spark, sf_dir).select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the original text as far as it can be restored."""
    out = _garbled(spark, sf_dir)
    how = F.when(F.col("by_twin"), "twin").when(F.col("lost"), "in part").otherwise("undone")
    return out.select(F.col("id").alias("doc_id"), F.col("restored").alias("text"), how.alias("how"), "n_stretches")


QUERIES = {f.__name__: f for f in (p7_found, p7_matches, p7_clean, p8_mix, p8_shares, p9_found, p9_restored)}

_GRAMS = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw WHERE len(w) >= 12),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""
ORACLE = {
    "p7_found": f"{_GRAMS} SELECT doc_id, item_id FROM hit",
    "p7_clean": f"{_GRAMS} SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)",
    # Matching runs of 12 words that follow each other are one longer match.
    "p7_matches": rf"""{_GRAMS}, dp AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 11)) AS i FROM dw WHERE len(w) >= 12)),
ip AS (SELECT item_id, j, array_to_string(w[j + 1:j + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 11)) AS j FROM iw WHERE len(w) >= 12)),
h AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM dp JOIN ip USING (g)),
r AS (SELECT doc_id, item_id, min(i) AS doc_word, min(j) AS item_word, count(*) + 11 AS n_words FROM h GROUP BY doc_id, item_id, i - j, run)
SELECT doc_id, item_id, n_words, doc_word, item_word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_word, item_word) AS k FROM r) WHERE k = 1""",
}
