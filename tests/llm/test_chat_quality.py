import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm import cases
from xylem.llm import chat, quality, queries

TURNS = "conv_id long, turn long, role string, text string, header string, escaped int, span string"
NASTY = [r"\### Assistant: </turn> ok", "###", "####", "</turn>\n", "</turn></turn>", "\\", "\\b\\h\\t\\c", "a: b: c", "", "\n### user: x</turn>\n", "### ", "###! user: ", "é ü" * 50, " </tur", "#"]


def turn_rows():
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "user", None), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (2, None, None, "first"), (None, 1, "assistant", "no id"), (3, 5, "we: ird\n### role</turn>\\", "x"), (4, 0, "assistant", "y" * 50000)]
    return [(*r, "h", 1, "s") for r in rows]


def ordered(rows):
    low = lambda x: (x is not None, x)
    out = defaultdict(list)
    for c, n, role, text, *_ in rows:
        out[c].append((low(n), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in out.items()}


def test_conversations_survive_the_round_trip(spark):
    shown = chat.format_chat(spark.createDataFrame(turn_rows(), TURNS).repartition(3))
    got = shown.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("masked", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()
    want = ordered(turn_rows())
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        turns = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns and r.round_trip and r.n_turns == len(turns)
        assert r.masked == "".join(t for role, t in turns if role == "assistant")
        body = r.formatted
        for start, length, escaped in r.loss_mask:
            assert 0 <= start and start + length <= len(body)
            assert escaped == ("\\" in body[start : start + length]) or not escaped
    assert chat.format_chat(spark.createDataFrame([], TURNS)).count() == 0


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "plain \\ text"), (1, 1, "assistant", "a ### b")]
    text = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().formatted
    assert text == "### user: plain \\ text</turn>\n###! assistant: a \\h b</turn>\n"


def test_query_five_reads_back_its_conversation(spark):
    row = queries.op5_chat_formatting(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, 26, hashlib.sha256(said.encode()).hexdigest())


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered), n < 20 or 100 * len(covered) > 30 * n


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_plain_counts_equal_brute_force(spark):
    docs = cases.docs(spark)
    got = quality.judge(docs, labels(spark, [(1, 1, 0), (20, 1, 0), (5, 0, 0), (None, 1, 0)])).collect()
    want = Counter((r[0], *plain(r[1])) for r in cases.rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(cases.empty(spark), labels(spark, [])).count() == 0


def test_scores_follow_from_whole_counts(spark):
    """The scores of a small corpus, from counts by hand; the buckets are Spark's."""
    rows = [(i, cases.prose(i % 3, 40 + i)) for i in range(12)] + [(50 + i, "%%% " * 15 + cases.prose(9, 30, 20)) for i in range(3)]
    docs, rules = spark.createDataFrame(rows, "doc_id long, text string"), quality.Rules(buckets=64, margin=0, share=0.0)
    trusted = {0, 3, 6}
    got = {r.doc_id: r for r in quality.judge(docs, labels(spark, [(i, 1, 0) for i in trusted]), rules).collect()}
    hashed = docs.select("doc_id", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h")).select("doc_id", quality.grams(F.col("h"), rules).alias("g")).collect()
    half = {r.id: r.half for r in spark.range(51).select("id", F.pmod(F.xxhash64("id", F.lit(rules.seed)), F.lit(2)).alias("half")).collect()}
    raw = Counter(b for r in hashed for b in r.g)
    s, n = rules.smoothing, rules.buckets

    def scores(seen):
        target = Counter(b for r in hashed if r.doc_id in seen for b in r.g)
        ratio = {b: round(1_000_000 * math.log((target[b] + s) / (sum(target.values()) + s * n) * (sum(raw.values()) + s * n) / (raw[b] + s))) for b in raw}
        return {r.doc_id: math.floor(sum(ratio[b] for b in r.g) / len(r.g)) for r in hashed}

    assert {i: r.score for i, r in got.items()} == scores(trusted)
    held_out = [scores({j for j in trusted if half[j] != half[i]})[i] for i in trusted]
    assert all(r.kept == (not r.base_failed and r.score >= min(held_out)) for r in got.values())
    assert not got[50].kept


def test_all_trusted_documents_count(spark):
    """Where every document is trusted, the target is the raw corpus and all scores are 0, however many there are."""
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).cast("string")) for i in range(20))).alias("text"))
    got = quality.judge(docs, docs.select("doc_id", F.lit(1).alias("quality"))).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert (got.n, got.low, got.high) == (20_500, 0, 0)


def test_percentiles_are_exact(spark):
    rng = random.Random(5)
    for n, share in ((1, 0.0), (2, 0.5), (7, 0.001), (999, 0.001), (1000, 0.37), (1000, 1.0)):
        values = [rng.choice((-5_000_000, rng.randint(-9000, 9000), -1, 0)) for _ in range(n)]
        scores = spark.createDataFrame([(v,) for v in values], "score long")
        assert math.isclose(quality.percentile(scores, share), scores.agg(F.percentile("score", F.lit(share))).first()[0], rel_tol=1e-12)
    assert quality.percentile(scores.limit(0), 0.5) is None


def test_judgement_carries_whole_rows(spark):
    docs = cases.docs(spark)
    kept = quality.judge(docs, labels(spark, []), carry=True).select("record.*")
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_junk_goes_and_clean_documents_stay(spark):
    got = queries.op7_quality_rules(spark, "/root/testdata/sf0.01")
    judged = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    shares = {r.quality: r.kept for r in judged.collect()}
    assert shares[1] > 0.995 and shares[0] < 0.25
