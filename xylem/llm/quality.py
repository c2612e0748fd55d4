"""Quality rules: counts of plain defects and a hashed n-gram log-likelihood ratio.

Word n-grams are hashed into a fixed number of buckets. Two multinomials over the buckets, one of trusted documents and one of the
whole corpus, give each bucket a log ratio; a document's score is the mean ratio of its n-grams. Ratios are whole millionths and
sums are integers, so scores and the threshold are the same in every run and on every cluster. A document is kept if it passes the
plain rules and its score reaches the threshold. That is the score that all but a fixed share of trusted documents reach under a
model that has not seen them: they are dealt into two halves, and each is scored by the model of the other.

Built-in functions only. All trusted documents count, so their texts are a table of their own, from a join that is not broadcast;
every other pass over the texts is narrow. What is broadcast or becomes a literal is bounded: classes of the trusted documents' ids
and one number per bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import Staging, parted, words_of

#: Fixed values of the plain rules.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30


@dataclass(frozen=True)
class Rules:
    """buckets: of the n-gram hash. orders: of the n-grams. share: of held-out trusted documents that may fall below the threshold.
    margin: in millionths, subtracted from that score. smoothing: added to each bucket's count."""

    buckets: int = 8192
    orders: tuple[int, ...] = (1, 2)
    share: float = 0.001
    margin: int = 0
    smoothing: int = 5
    seed: int = 7


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words stand in windows of WINDOW words that occur twice or more; hashes: array of the windows' hashes."""
    tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ends = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))

    def in_pairs(sorted_windows: Column) -> Column:
        near = lambda k: F.get(sorted_windows, k).h
        return F.filter(sorted_windows, lambda w, k: F.coalesce(near(k - 1) == w.h, F.lit(False)) | F.coalesce(near(k + 1) == w.h, F.lit(False)))

    # transform over a one-element array binds the sorted windows once
    starts = F.array_sort(F.get(F.transform(F.array(tagged), lambda s: F.transform(in_pairs(s), lambda w: w.i)), F.lit(0)))
    covered = F.aggregate(
        starts, ends, lambda a, p: F.struct((a.covered + p + WINDOW - F.greatest(p, a.end)).alias("covered"), (p + WINDOW).alias("end")), lambda a: a.covered
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("long")


def plain_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with words and the plain rules' counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    numbers = F.transform("words", lambda w: F.xxhash64(w))
    counted = docs.withColumn("words", words_of(F.col(text))).withColumn("hashed", numbers).withColumn("windows", windows_of(F.col("hashed"), WINDOW)).withColumn("lines", lines)
    counted = counted.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("words"), F.col("windows")),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("windows", "lines")


def windows_of(hashed: Column, n: int) -> Column:
    """Hashes of all runs of n words; hashed: the words' hashes, an attribute."""
    at_each = F.transform(hashed, lambda h, i: F.xxhash64(h, *[F.get(hashed, i + k) for k in range(1, n)]))
    return F.slice(at_each, F.lit(1), F.greatest(F.size(hashed) - (n - 1), F.lit(0)))


def grams(hashed: Column, rules: Rules) -> Column:
    """Buckets of all n-grams, as an array; hashed: the words' hashes."""
    hashes = [hashed if n == 1 else windows_of(hashed, n) for n in rules.orders]
    return F.transform(F.concat(*hashes), lambda h: F.pmod(h, F.lit(rules.buckets)).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, rules: Rules, text: str) -> list[list[int]]:
    """Millionths of the log ratio of each bucket, for the model of each half of the trusted documents and of all of them. The raw
    counts are of every document. trusted: half and text of all trusted documents."""
    hashed = lambda rows: F.transform(words_of(rows), lambda w: F.xxhash64(w)).alias("hashed")

    def counted(rows: DataFrame, *of: Column) -> list:
        return rows.withColumn("bucket", F.explode(grams(F.col("hashed"), rules))).groupBy("bucket").agg(*of).collect()  # one row per bucket at most

    seen = {r.bucket: r for r in counted(trusted.select("half", hashed(F.col("text"))), *(F.count_if(F.col("half") == h).alias(f"half_{h}") for h in (0, 1)))}
    rows = counted(docs.select(hashed(F.col(text))), F.count("*").alias("raw"))
    n, s, raw = rules.buckets, rules.smoothing, sum(r.raw for r in rows)
    models = []
    for halves in ((0,), (1,), (0, 1)):
        of = {bucket: sum(r[f"half_{h}"] for h in halves) for bucket, r in seen.items()}
        target, ratios = sum(of.values()), [0] * n
        for r in rows:
            ratios[r.bucket] = round(1_000_000 * math.log((of.get(r.bucket, 0) + s) / (target + s * n) * (raw + s * n) / (r.raw + s)))
        models.append(ratios)
    return models


def score_of(grams: Column, ratios: list[int]) -> Column:
    """The mean ratio of the n-grams, rounded down; 0 without n-grams."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda a, g: a + F.get(table, g))
    return F.when(F.size(grams) > 0, F.expr("0L") + F.floor(total / F.size(grams))).otherwise(F.lit(0)).cast("long")


#: Binary digits of the width of the ranges that scores are counted by.
_RANGE = 12


def percentile(scores: DataFrame, share: float) -> float | None:
    """The exact percentile of the column score, None without rows: counts by ranges, and then the counts of the few scores in the
    ranges that hold it. Ratios are bounded and so are the ranges, and no task holds all scores."""
    counts = sorted((r.part, r.n) for r in scores.groupBy(F.shiftright("score", _RANGE).alias("part")).agg(F.count("*").alias("n")).collect())
    if not counts:
        return None
    position = share * (sum(n for _, n in counts) - 1)
    low, high = math.floor(position), math.ceil(position)
    before, wanted = 0, []
    for part, n in counts:
        if before <= high and before + n > low:
            wanted.append((part, before))
        before += n
    place, found = wanted[0][1], {}
    for r in sorted(scores.filter(F.shiftright("score", _RANGE).isin([part for part, _ in wanted])).groupBy("score").agg(F.count("*").alias("n")).collect(), key=lambda r: r.score):
        found |= {p: r.score for p in (low, high) if place <= p < place + r.n}
        place += r.n
    return found[low] if low == high else (high - position) * found[low] + (position - low) * found[high]


def judge(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, the plain counts, base_failed, score and kept of every document; with carry, also record, a struct of its whole row.

    labels: doc_id and quality, and toxic where there is such a column; documents of quality 1 that are not toxic are trusted. Null
    and blank texts have 0 words and so fail the plain rules, with score 0. Null keys are never trusted; repeated rows are judged,
    and counted, as often as they occur. Without trusted documents all ratios are those of the smoothed corpus alone, and all that
    pass the plain rules with a score of 0 or more are kept. Other columns of docs are not read, whatever their names. A text's
    words and n-grams are in the memory of a task as a whole.
    """
    chosen = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0 if "toxic" in labels.columns else F.lit(True)))
    chosen = chosen.select(F.col(key).alias("__key")).filter("__key is not null").distinct()
    chosen = chosen.withColumn("__half", F.pmod(F.xxhash64("__key", F.lit(rules.seed)), F.lit(2)))
    with Staging(docs.sparkSession, "quality") as staging:
        # both sides grow, so neither is broadcast at any size; as a string, a key has one class whatever its type
        some, _ = parted(docs.select(F.col(key).alias("__key"), F.col(text).alias("text")), F.col("__key").cast("string"), chosen.select(F.col("__key").cast("string")))
        trusted = staging.save(some.join(chosen.hint("merge"), "__key").select(F.col("__half").alias("half"), "text"), "trusted")
        *halves, whole = log_ratios(docs, trusted, rules, text)
        held_out = plain_counts(trusted).withColumn("grams", grams(F.col("hashed"), rules)).select("base_failed", F.when(F.col("half") == 0, score_of(F.col("grams"), halves[1])).otherwise(score_of(F.col("grams"), halves[0])).alias("score"))
        # a filter would be pushed below the counts and compute them again and again
        reached = percentile(staging.save(held_out, "held-out").filter("not base_failed"), rules.share)  # of the trusted documents' scores
    threshold = math.floor(reached if reached is not None else 0) - rules.margin

    record = [F.struct(*(docs[c] for c in docs.columns)).alias("record")] if carry else []
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *record)
    counted = plain_counts(narrow).withColumn("grams", grams(F.col("hashed"), rules))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    scored = counted.select(*columns, score_of(F.col("grams"), whole).alias("score"), *(["record"] if carry else []))
    judged = F.struct(*scored.columns, (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
    # a filter of what inline() makes stays above it; else it would be pushed below the counts and compute them again and again
    return scored.select(F.inline(F.array(judged)))
