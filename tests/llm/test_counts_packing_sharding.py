import re
import zlib
from collections import Counter as Multiset
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import cases
from xylem.llm import packing, queries, sharding, token_counts

pytestmark = pytest.mark.filterwarnings("ignore")


def test_counts_equal_a_unigram_tokenizer():
    from tokenizers import Tokenizer, models

    vocabulary = token_counts.read_vocabulary(queries.vocabulary_file("piece_bpe_32k.model"))
    low = min(s for _, s in vocabulary)
    tokenizer = Tokenizer(models.Unigram([("<unk>", low), *vocabulary], 0, False))
    counter = token_counts.Counter(vocabulary)
    texts = {token_counts.MARK + w for row in cases.rows() for w in (row[1] or "").split()} | {"▁漢字ﷺab", "▁", "▁aaaaaaaaaaaaaaaa", "▁ﷺﷺxﷺ"}
    for text in texts:
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_counts_ties_keep_the_earliest_start():
    counter = token_counts.Counter([("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    assert [counter.count("a" * n) for n in range(7)] == [0, 1, 1, 1, 2, 2, 2]
    assert token_counts.Counter([]).count("xyz") == 1  # neighbouring unknown characters are one piece


def test_counts_of_all_rows(spark):
    model = queries.vocabulary_file("piece_bpe_32k.model")
    got = token_counts.count_tokens(cases.docs(spark), model).collect()
    assert len(got) == len(cases.rows())
    by_id = {r.doc_id: r for r in got}
    assert (by_id[5].n_words, by_id[5].n_tokens) == (by_id[6].n_words, by_id[7].n_tokens) == (0, 0)
    assert token_counts.count_tokens(cases.empty(spark), model).count() == 0


def test_word_encoder_equals_the_tokenizer():
    encode = packing._encoder(queries.vocabulary_file("word_bpe_49k.json"))
    texts = [row[1] or "" for row in cases.rows()] + ["It's they've 'll", "ΣΑΣ", "x\x1cy\x85z a　b", "éa ́b", "ÀÉÎ,õ×÷ ª º µ ß", "123 4a5 a_b--c!!'s"]
    for text in texts:
        assert b"".join(map(encode.__getitem__, packing.byte_words(text))) == encode.make.whole(text)


def test_packing_covers_each_id_once(spark):
    path = queries.vocabulary_file("word_bpe_49k.json")
    pieces = packing.pack_documents(cases.docs(spark), path, window=64)
    got = pieces.collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    want = Multiset(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in cases.rows())
    documents, sequences = defaultdict(list), defaultdict(list)
    stream = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    found, held = Multiset(), b""
    for r in stream:  # documents follow each other in the stream
        assert len(r.ids) == 4 * r.length and r.start == len(held) // 4
        held += r.ids
        if len(held) == 4 * r.doc_tokens:
            found[held] += 1
            held = b""
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
    assert found == want and held == b""
    for s, rows in sequences.items():
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert sum(r.length for r in rows) == 64 or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    whole = packing.sequences(pieces).collect()
    assert all(len(r["ids"]) == 4 * r.n_tokens for r in whole) and len(whole) == len(sequences)
    assert packing.pack_documents(cases.empty(spark), path).count() == 0


def test_shards_are_even_and_gapless(spark, tmp_path):
    docs = cases.docs(spark)
    sharded = sharding.shard(docs, shards=5, bucket_bytes=20_000)
    got = sharded.collect()
    counts = Multiset(r.shard for r in got)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert Multiset((r.doc_id, r.text) for r in got) == Multiset((r[0], r[1]) for r in cases.rows())
    assert all(r["size"] == len((r.text or "").encode()) + 8 for r in got)
    again = {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.shard(docs.repartition(7), shards=5, bucket_bytes=20_000).collect()}
    assert all(again[r.doc_id, r.text] == (r.shard, r.slot) for r in got if r.doc_id not in (0, 20))
    assert [r.slot for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] != sorted(r.slot for r in got)
    sharding.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    assert sharding.shard(cases.empty(spark)).count() == 0


def test_many_equal_rows_share_no_bucket(spark):
    docs = spark.createDataFrame([(1, "same", "x")] * 60 + [(1, "same", "y")] * 40 + [(i, f"t{i}", "z") for i in range(30)], "doc_id long, text string, lang string").repartition(3)
    got = sharding.shard(docs, shards=5, bucket_bytes=200, hot_rows=50).collect()
    assert Multiset((r.doc_id, r.lang) for r in got) == Multiset((r.doc_id, r.lang) for r in docs.collect())
    assert sorted(Multiset(r.shard for r in got).values()) == [26] * 5 and len({(r.shard, r.slot) for r in got}) == 130
    assert len({r.shard for r in got if r.text == "same"}) == 5


def test_fisher_yates_is_uniform():
    seen = Multiset(tuple(sharding.fisher_yates(3, seed)) for seed in range(3000))
    assert len(seen) == 6 and all(400 < n < 600 for n in seen.values())


def test_rows_of_the_packing_query(spark):
    """All pieces of the smallest table against the tokenizer itself."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_file("word_bpe_49k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    pieces = queries.op3_packing(spark, "/root/testdata/sf0.001").collect()
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))


def test_rows_of_the_count_query(spark):
    """All rows of the smallest table against a unigram tokenizer over the query's vocabulary."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.read_vocabulary(queries.vocabulary_file("piece_bpe_32k.model"))
    tokenizer = Tokenizer(models.Unigram([("<unk>", min(s for _, s in vocabulary)), *vocabulary], 0, False))
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op1_token_counts(spark, "/root/testdata/sf0.001").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert (r.n_words, r.n_tokens) == (len(words), sum(len(tokenizer.encode(token_counts.MARK + w, add_special_tokens=False).ids) for w in words))


def test_unigram_vocabulary_files(spark, tmp_path):
    """A vocabulary with scores of its own, as tokenizers store it."""
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", -20.0), ("▁", -3.0), ("▁a", -2.0), ("a", -2.5), ("b", -2.7), ("ab", -4.1), ("▁ab", -5.0), ("bab", -6.5), ("aa", -4.4)]
    tokenizer = Tokenizer(models.Unigram(pieces, 0, False))
    tokenizer.save(str(tmp_path / "unigram.json"))
    docs = spark.createDataFrame([(0, "ab aab babab"), (1, "zz abz"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, str(tmp_path / "unigram.json")).collect()}
    assert got == {r.doc_id: sum(len(tokenizer.encode("▁" + w, add_special_tokens=False).ids) for w in (r.text or "").split()) for r in docs.collect()}


def test_special_tokens_by_the_librarys_default(spark, tmp_path):
    """The registered query's ids are those of the tokenizer as its file has it."""
    from tokenizers import Tokenizer

    path, texts = queries.vocabulary_file("word_bpe_49k.json"), ["see <|endoftext|> here", "a<|startoftext|>b <|endoftext|>", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert want[0] == [862, 49407, 763, 1]
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in queries.op3_packing(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
