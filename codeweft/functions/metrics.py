"""Deterministic answer metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: words that carry no fact.
STOP_WORDS = ("the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "that", "this", "which", "it", "as", "if", "what", "does", "do", "can", "when", "then")
#: Fixed value: what counts as a dotted name.
DOTTED = r"[a-z_][a-z0-9_]+\.[a-z_][a-z0-9_]+"
#: Word borders that count letters and digits of any script: what ``\\b``
#: counts is another matter from one Java release to the next.
_BEGIN, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Places that a score is rounded to, ties to the even digit.
PLACES = 3


def tokens(text: Column) -> Column:
    """Distinct lower-case words of two and more characters, no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BEGIN + "[a-zA-Z_][a-zA-Z0-9_]*" + _END), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def jaccard(answer: Column, truth: Column) -> Column:
    """Overlap of two token sets: 1 without any truth, 0 without an answer."""
    both, any_ = F.size(F.array_intersect(answer, truth)), F.size(F.array_union(answer, truth))
    return F.when(F.size(truth) == 0, 1.0).when(F.size(answer) == 0, 0.0).otherwise(both / any_)


def base_name(entity: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(entity, r"\."), -1), "::"), -1)


def entity_scores(answers: DataFrame, answer: str = "answer", expected: str = "expected_entities") -> DataFrame:
    """``answers`` with ``recall, precision, f1``. An entity is recalled if it
    or its base name occurs in the answer; precision is over the dotted names
    in the answer, 0.5 to 1, and without any 1 if something was recalled."""
    text = F.lower(F.coalesce(F.col(answer), F.lit("")))
    hit = F.filter(expected, lambda e: text.contains(F.lower(e)) | text.contains(F.lower(base_name(e))))
    dotted = F.array_distinct(F.regexp_extract_all(text, F.lit(_BEGIN + DOTTED + _END), F.lit(0)))
    wanted = F.transform(expected, lambda e: F.lower(e))
    right = F.filter(dotted, lambda d: F.exists(wanted, lambda e: d.contains(e) | e.contains(d)))
    empty = F.size(expected) == 0
    rows = answers.withColumn("__hit", F.size(hit)).withColumn("__dotted", F.size(dotted)).withColumn("__right", F.size(right))
    recall = F.when(empty, 1.0).otherwise(F.col("__hit") / F.size(expected))
    rows = rows.withColumn("recall", recall)
    share = F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.col("__right") / F.greatest("__dotted", F.lit(1))))
    precision = F.when(empty, 1.0).when(F.col("__dotted") > 0, share).when(F.col("recall") > 0, 1.0).otherwise(0.0)
    rows = rows.withColumn("precision", precision)
    total = F.col("recall") + F.col("precision")
    return rows.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / total)).drop("__hit", "__dotted", "__right")


def evaluate(answers: DataFrame, answer: str = "answer", truth: str = "ground_truth", expected: str = "expected_entities") -> DataFrame:
    """Entity scores and ``fact_overlap``, rounded."""
    rows = entity_scores(answers, answer, expected).withColumn("fact_overlap", jaccard(tokens(F.col(answer)), tokens(F.col(truth))))
    return rows.withColumns({c: F.bround(c, PLACES) for c in ("recall", "precision", "f1", "fact_overlap")})


def entity_recall(answers: DataFrame, answer: str = "answer", expected: str = "expected_entities") -> DataFrame:
    """``answers`` with ``recall`` alone, rounded."""
    return entity_scores(answers, answer, expected).drop("precision", "f1").withColumn("recall", F.bround("recall", PLACES))


def overlap_judge(answers: DataFrame, answer: str = "answer", truth: str = "ground_truth") -> DataFrame:
    """``answers`` with ``correctness`` (the fact overlap) and ``faithfulness``
    (always 1): the shape of a judge's verdict without a judge."""
    overlap = jaccard(tokens(F.col(answer)), tokens(F.col(truth)))
    return answers.withColumns({"correctness": F.bround(overlap, PLACES), "faithfulness": F.lit(1.0)})


def summary(scored: DataFrame, by: str = "mode") -> DataFrame:
    """Averages per mode, to three places (latency to two)."""
    return scored.groupBy(by).agg(*[F.round(F.avg(c), 3).alias(f"avg_{c}") for c in ("recall", "precision", "f1", "fact_overlap") if c in scored.columns], *([F.round(F.avg("latency"), 2).alias("avg_latency")] if "latency" in scored.columns else []))


def answer_delta(scored: DataFrame, base: str, other: str, key: str = "id", by: str = "mode") -> DataFrame:
    """Per question the scores of ``other`` less those of ``base``."""
    columns = [c for c in ("recall", "precision", "f1", "fact_overlap") if c in scored.columns]
    a = scored.where(F.col(by) == base).select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = scored.where(F.col(by) == other).select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, key).select(key, *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in columns])


def chat_title(text: Column) -> Column:
    """The first five words, without closing punctuation."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    title = F.regexp_replace(F.array_join(F.slice(F.split(clean, " "), 1, 5), " "), r"[?.!,;:]+$", "")
    return F.when((clean == "") | (title == ""), "New Chat").otherwise(title)
