import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from xylem.llm import components, ngram_join, queries, suffix_dedup
from xylem.llm.common import Staging, pack, unpack

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute_groups(rows):
    """rows: (id, text); per row size of its set and least id reachable."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        least[find(i)].append(name)
    return Counter((name, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (name, _) in enumerate(rows))


def groups(df, **how):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_groups(df, ngram_join.Join(**how)).collect())


def test_groups_equal_brute_force_on_awkward_rows(spark):
    assert groups(cases.docs(spark)) == brute_groups([(r[0], r[1]) for r in cases.rows()])
    assert ngram_join.link_groups(cases.empty(spark)).count() == 0


def test_groups_of_many_near_copies(spark):
    """Chains and stars around the threshold, and counters so few that the order of n-grams is nearly blind."""
    rows, number = [], 0
    for seed in range(6):
        base = cases.prose(seed, 60)
        for i in range(25):
            rows.append((number * 7 % 1009, cases.edited(base, 1000 * seed + i, i % 4)))
            number += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_groups(rows)
    assert groups(docs) == want
    assert groups(docs, counter_bits=6, block_entries=50, hubs=1, compared=1, worthwhile=1.0) == want
    # columns dealt to several blocks, and all pairs of parts multiplied apart
    assert groups(docs, counter_bits=18, block_entries=50, hot=2, column=3, worthwhile=1.0) == want


def test_bounds_are_safe():
    join, rng = ngram_join.Join(), np.random.default_rng(1)
    for n in range(1, 200):
        assert join.prefix(n) == n - -(-75 * n // 100) + 1
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, 50, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: rng.integers(0, 50)], rng.integers(0, 1 << 62, 9, dtype=np.uint64))))
        apart = len(a) + len(b) - 2 * ngram_join.overlap(a, b)
        assert np.bitwise_count(ngram_join.signature(a) ^ ngram_join.signature(b)).sum() <= apart


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(links, Staging(spark, "test"), "chain").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_groups_merge_by_few_links(spark):
    """Of many links between the same groups one is gone through, and what is linked already none."""
    staging, links = Staging(spark, "test"), lambda rows: spark.createDataFrame(rows, "a long, b long")
    first, later = [(i, i + 1) for i in range(1, 20)] + [(i, i + 1) for i in range(31, 50)], [(i, j) for i in range(1, 20) for j in range(31, 50)] + [(3, 9), (60, 20), (71, 70)]
    groups = components.merged(components.components(links(first), staging, "some"), links(later), staging, "more")
    both = components.components(links(first + later), staging, "both")
    assert Counter(map(tuple, groups.collect())) == Counter(map(tuple, both.collect()))


def test_packed_arrays_round_trip():
    x, y = np.arange(1000, dtype=np.uint64) ** 3, np.arange(1000, dtype=np.uint32)
    for a, b in zip(unpack(pack(x, y), "<u8", "<u4"), (x, y), strict=True):
        assert (a == b).all()


def brute_removed(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = Counter()
    for (name, _), d in zip(rows, data, strict=True):
        mark = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                mark[s : s + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out[name, len(d), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(d, mark, strict=True) if not m)).hexdigest()] += 1
    return out


def removed(df, *how, **more):
    out = Counter()
    for r in suffix_dedup.removed_spans(df, *how, **more).collect():
        out[r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), r.kept_sha256] += 1
    return out


def test_removed_bytes_equal_brute_force(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    assert removed(cases.docs(spark), suffix_dedup.Repeats()) == brute_removed(rows, 400)
    assert removed(cases.docs(spark), suffix_dedup.Repeats(length=60, gram=20, piece=7, batches=5)) == brute_removed(rows, 60)
    assert suffix_dedup.removed_spans(cases.empty(spark)).count() == 0


def test_repeats_at_the_edge_of_the_length(spark):
    """Strings of exactly the length, one byte less, periodic texts, and characters that a cut would split."""
    passage = cases.prose(3, 40)[:100]
    rows = [(1, "aaaa " + passage + " bbbb"), (2, "cc" + passage + "dd"), (3, "e" + passage[:99] + "f"), (4, "xy" * 80), (5, "é" * 70 + "q"), (6, "z" + "é" * 70), (7, None), (8, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    how = suffix_dedup.Repeats(length=100, gram=30, piece=16)
    assert removed(docs, how) == brute_removed(rows, 100)
    left = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs, how).collect()}
    assert left[1] == "aaaa  bbbb" and left[2] == "ccdd" and left[3] == rows[2][1] and left[7] is None and left[8] == ""
    assert left[6].startswith("z")


def test_family_takes_later_batches(spark, tmp_path):
    """A stored family is opened again for each batch; what is removed then equals brute force over all batches so far."""
    rows, how = [(r[0], r[1]) for r in cases.rows()], suffix_dedup.Repeats(length=60, gram=20, piece=7)
    for batch in range(5):
        docs = spark.createDataFrame(rows[batch::5], "doc_id long, text string")
        suffix_dedup.Family(spark, f"file://{tmp_path}/family", how).add(suffix_dedup.texts_of(docs, "text", how.least))
        family = suffix_dedup.Family(spark, f"file://{tmp_path}/family", how)
        if batch % 2:  # as in another session, whose catalog knows nothing of the levels
            for _, name in family.levels:
                spark.sql(f"DROP TABLE {name}")
            family = suffix_dedup.Family(spark, f"file://{tmp_path}/family", how)
            assert all("bucket" in spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first().col_name.lower() for _, name in family.levels)
        sizes = [size for size, _ in family.levels]
        assert len(family.batches) == batch + 1 and len(sizes) <= 3 and all(a >= b for a, b in zip(sizes, sizes[1:])) or batch < 2
        if batch in (1, 4):
            so_far = [r for b in range(batch + 1) for r in rows[b::5]]
            assert removed(spark.createDataFrame(so_far, "doc_id long, text string"), how, families=[family]) == brute_removed(so_far, 60)
    for size, name in family.levels:
        heads = [bytes(r.head) for r in spark.table(name).select("head").collect()]
        assert len(set(heads)) == len(heads) == size
    counts = Counter()
    for _, name in family.levels:
        counts.update({bytes(r.head): r.n for r in spark.table(name).collect()})
    want = Counter()
    for _, text in rows:
        units = how.units((text or "").encode())
        want.update(units.heads(suffix_dedup.anchors_of(units, how)[0], how.gram))
    assert set(counts) == set(want)
    with pytest.raises(ValueError, match="other strings"):
        suffix_dedup.Family(spark, f"file://{tmp_path}/family", suffix_dedup.Repeats())
    family.drop()


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    how, text = suffix_dedup.Repeats(length=60, gram=20), suffix_dedup.Text((cases.prose(4, 300) + "ab" * 200).encode())
    whole = suffix_dedup.anchors_of(text, how)
    hashes = text.hashes(np.arange(text.n - 19), np.arange(20, text.n + 1))
    of = np.repeat(whole[0], whole[3] - whole[2] + 1)
    kept = hashes >> np.uint64(7) << np.uint64(7)
    assert [int(np.argmin(kept[s : s + 41])) + s for s in range(len(of))] == of.tolist()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 37)
    for a, b in zip(whole, suffix_dedup.anchors_of(text, how), strict=True):
        assert (a == b).all()


def brute_words_removed(rows, length):
    """What is left of each text without the strings of so many words that occur again, and without its white space."""
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[s : s + length]) for w in lists for s in range(len(w) - length + 1))
    out = Counter()
    for (name, _), w in zip(rows, lists, strict=True):
        gone = {s + i for s in range(len(w) - length + 1) if seen[tuple(w[s : s + length])] > 1 for i in range(length)}
        out[name, tuple(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def test_removed_words_equal_brute_force(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    for how in (suffix_dedup.Repeats(length=51, gram=16, piece=4, words=True), suffix_dedup.Repeats(length=12, gram=4, piece=3, batches=5, words=True)):
        left = Counter((r.doc_id, tuple(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in suffix_dedup.without_repeats(cases.docs(spark), how).collect())
        assert left == brute_words_removed(rows, how.length)


def test_passages_of_over_fifty_words_leave_the_pipeline(spark):
    """51 short words in fewer than 400 bytes, 50 words, 400 bytes in few words, and white space that differs."""
    words = [f"{w[:4]}{i}" for i, w in enumerate(cases.prose(9, 140).split())]
    passage, short, few = words[:51], words[60:110], "".join(words)[:420]
    assert len(" ".join(passage)) < 400
    rows = [(1, "aa " + " ".join(passage) + " bb"), (2, "cc  " + "\n".join(passage) + " dd"), (3, "ee " + " ".join(short) + " ff"), (4, "gg " + " ".join(short) + " hh"), (5, "ii " + few + " jj"), (6, "kk " + few + " ll"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    assert left[1] == "aa  bb" and left[2] == "cc   dd" and left[3] == rows[2][1] and left[4] == rows[3][1] and left[5] == "iijj" and left[7] is None


def test_levels_of_equal_batches_merge_alike(spark, tmp_path):
    """Batches whose sizes differ a little merge as equal ones do: the merged level of two is not merged with the third again."""
    how = suffix_dedup.Repeats(length=60, gram=20, piece=7)
    family, merged = suffix_dedup.Family(spark, f"file://{tmp_path}/family", how), []
    for batch, words in enumerate((300, 300, 330, 300)):
        family.add(suffix_dedup.texts_of(spark.createDataFrame([(cases.prose(900 + batch, words),)], "text string"), "text"))
        merged.append(len(family.levels))
    assert merged == [1, 2, 2, 3]
    family.drop()


def test_repeats_in_texts_that_are_not_well_formed(spark):
    """Bytes that are no UTF-8 count as they are."""
    passage = cases.prose(8, 60)[:90].encode()
    data = [(1, b"a\xff" + passage + b"\xfe\x80" + b"tail"), (2, b"\x80b" + passage + b"\xff"), (3, b"\xff" * 130), (4, "é".encode() * 60)]
    docs = spark.createDataFrame(data, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    found = suffix_dedup.removed_spans(docs, suffix_dedup.Repeats(length=60, gram=20, piece=7))
    got = {r.doc_id: (r.n_bytes, [(s.begin, s.end) for s in r.spans], r.kept_sha256) for r in found.select("doc_id", "n_bytes", "spans", "kept_sha256").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got[1] == (98, [(2, 92)], sha(b"a\xff\xfe\x80tail")) and got[2] == (93, [(2, 92)], sha(b"\x80b\xff"))
    assert got[3] == (130, [(0, 130)], sha(b"")) and got[4] == (120, [(0, 120)], sha(b""))


def test_passages_that_text_alone_goes_without(spark, tmp_path):
    """Spans and digests are those of the first kinds; text is what without_repeats leaves of all. So in the query: 51 short words, in
    fewer than 400 bytes, leave the text and count as nothing removed."""
    rows, how, words = [(r[0], r[1]) for r in cases.rows()], suffix_dedup.Repeats(length=60, gram=20, piece=7), suffix_dedup.Repeats(length=6, gram=3, piece=2, words=True)
    assert removed(cases.docs(spark), how, also=[words]) == brute_removed(rows, 60)
    texts = lambda df: Counter((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    assert texts(suffix_dedup.removed_spans(cases.docs(spark), how, also=[words])) == texts(suffix_dedup.without_repeats(cases.docs(spark), how, words))
    passage, few = " ".join(f"{w[:4]}{i}" for i, w in enumerate(cases.prose(9, 51).split())), cases.prose(12, 200).replace(" ", "")[:420]
    assert len(passage) < 400
    rows = [(1, f"aa {passage} bb"), (2, f"cc {passage} dd"), (3, f"ee {few} ff"), (4, f"gg {few} hh {passage}"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_suffix_array_dedup(spark, f"file://{tmp_path}").collect()}
    assert {i: r.text for i, r in got.items()} == {1: "aa  bb", 2: "cc  dd", 3: "eeff", 4: "gghh ", 5: ""}
    want = brute_removed(rows, 400)
    assert Counter((i, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()) == want and got[1].n_removed == 0 < got[4].n_removed


def test_copies_that_one_task_reads_together(spark):
    rows = [(i, cases.prose(77, 120)) for i in range(3)] + [(3, cases.prose(78, 120))]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute_removed(rows, 400)


def test_joined_texts_have_the_anchors_of_each(monkeypatch):
    """Short texts are hashed together, a few times for all of them, and no string crosses from one into the next."""
    monkeypatch.setattr(suffix_dedup, "JOINED", 3000)
    passage = cases.prose(5, 90)
    texts = [t.encode() for t in ("", passage, passage[:60], passage[:59], "", " \t ", "é" * 40, passage[7:], "one", cases.prose(6, 2000), "xy" * 90, passage)] + [cases.prose(i, 30).encode() for i in range(200)]
    for how in (suffix_dedup.Repeats(length=60, gram=20, piece=7), suffix_dedup.Repeats(length=12, gram=4, piece=3, words=True)):
        seen, turns = 0, 0
        for low, high, units, bounds in how.joined(texts):
            assert low == seen and len(bounds) == high - low + 1 and (high - low == 1 or sum(map(len, texts[low:high])) <= 3000)
            got = suffix_dedup.anchors_of(units, how, bounds)
            alone = [how.units(t) for t in texts[low:high]]
            want = [suffix_dedup.anchors_of(own, how) for own in alone]
            for i, (at, hashes, first, last) in enumerate(want):
                mine = (bounds[i] <= got[0]) & (got[0] < bounds[i + 1])
                assert all((a == b).all() and len(a) == len(b) for a, b in zip((g[mine] for g in got), (at + bounds[i], hashes, first + bounds[i], last + bounds[i]), strict=True))
                assert units.heads(got[0][mine], how.gram) == alone[i].heads(at, how.gram)
            assert len(got[0]) == sum(len(w[0]) for w in want)
            seen, turns = high, turns + 1
        assert seen == len(texts) and turns < len(texts) / 5
