"""Jaccard join of documents on their word n-grams, and the groups that the links form.

The join is a sparse product of the document by n-gram incidence with itself, computed in blocks of n-grams: in a column, each two
documents add one to their overlap. Bounds that follow from the sizes keep the product small and lose no pair that reaches the
threshold t:

* rows are ordered from rare to frequent n-grams, and only the first |A| - ceil(t |A|) + 1 entries of a row are in the blocks, as
  two sets with similarity t share an n-gram among those;
* sets whose sizes differ by more than the factor t are not paired;
* an n-gram at place i of A leaves |A| - i entries for the overlap, which must reach t / (1 + t) (|A| + |B|);
* parity signatures of the sets differ in no more bits than the sets have elements that are not common.

Overlaps over the blocks are added up pair by pair in partial aggregates; for pairs that the bounds let pass the rest of both rows is
multiplied too, and the whole overlap decides. Rows are hashed once and kept as sorted arrays until then.

Frequencies come from a table of counters of fixed size over all documents. It orders n-grams; when counters are shared the order
is less sharp and no less exact. A task ships its counters compressed, one or two percent of what it read.

Equal sets are one row, so copies cost nothing. Groups need no pair inside a group that is linked already, so the product is taken
in turns: each row by a few representatives of its columns first, and their greatest overlaps are completed, until a turn finds few
links or settles few entries; then all rows that still are in different groups. A column with very many entries is dealt to several blocks, and pairs of
blocks are multiplied apart.

N-grams are compared by 64-bit hashes, within columns and pairs of rows. Rows stand for equal sets by 128 bits: should two sets agree
in the 64 that name them, other names are drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import LOWER, Staging, mixed, pack, parted, text_key, told_apart, unpack
from xylem.llm.components import components, merged
from xylem.llm.rolling import Text

_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
SIGNATURE_BITS = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Join:
    """words: of a shingle. percent: the threshold. counter_bits: of the frequency table's size (4 bytes each). hubs:
    representatives of a column in a turn. compared: of a row's pairs that are completed in a turn. worthwhile: share of links among
    a turn's possible pairs up to which there are no more turns. settled: share of the entries in columns of several groups that a
    turn must settle, or else there are no more. block_entries: of a block of the product, so of a task's memory. hot: entries
    from which a column is dealt to several blocks; a table's counter shows it, if it is far above the mean. column: entries of a
    column that are multiplied with each other in one go."""

    words: int = 5
    percent: int = 75
    counter_bits: int = 22
    hubs: int = 3
    compared: int = 2
    worthwhile: float = 0.2
    settled: float = 0.1
    block_entries: int = 500_000
    hot: int = 500_000
    column: int = 4096

    def linked(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of a shorter sequence of words, the hash of all of it."""
    read = Text(text.encode().translate(LOWER) if text else b"")
    edges = np.flatnonzero(np.diff(_IN_WORD[read.values], prepend=False, append=False))
    if not len(edges):
        return np.empty(0, np.uint64)
    hashes = read.hashes(edges[::2], edges[1::2])
    length = min(words, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - length + 1, length, np.uint64)
        for i in range(length):
            out = out * _STEP + hashes[i : len(hashes) - length + 1 + i]
    return np.unique(mixed(out))


def signature(own: np.ndarray) -> np.ndarray:
    """One bit for each of SIGNATURE_BITS classes of hashes: whether an odd number of the set's belongs to it. Two signatures
    differ in as many bits at most as the sets have elements that are not common."""
    odd = np.bincount((own % np.uint64(SIGNATURE_BITS)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def node_of(own: np.ndarray, seed: int) -> int:
    """One number for equal sets, as a signed long."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), seed))))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _survey(docs: DataFrame, join: Join, seed: int) -> DataFrame:
    """doc_id, digest, n, node and twin (64 further bits) of every row, and beside them each task's counters in segments."""
    size, segments = 1 << join.counter_bits, 64
    names = ["doc_id", "digest", "n", "node", "twin", "part", "segment", "counters"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, shift = np.zeros(size, np.uint32), np.uint64(64 - join.counter_bits)
        for batch in batches:
            counts, nodes, twins, places, held = [], [], [], [], 0
            for text in batch.column(1):
                own = shingles(text.as_py(), join.words)
                counts.append(len(own))
                nodes.append(node_of(own, seed) if len(own) else None)
                twins.append(node_of(own, seed + 1) if len(own) else None)
                places.append((own >> shift).astype(np.int64))
                held += len(own)
                if held > 1_000_000:
                    counters += np.bincount(np.concatenate(places), minlength=size).astype(np.uint32)
                    places, held = [], 0
            if places:
                counters += np.bincount(np.concatenate(places), minlength=size).astype(np.uint32)
            none = lambda kind: pa.nulls(len(counts), kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (counts, nodes, twins)), none(pa.int32()), none(pa.int32()), none(pa.binary())], names)
        blobs = [pack(x) for x in np.split(counters, segments)]
        empty = [pa.nulls(segments, pa.binary() if name == "digest" else pa.int64()) for name in names[:5]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([TaskContext.get().partitionId()] * segments, pa.int32()), pa.array(range(segments), pa.int32()), pa.array(blobs, pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, digest binary, n long, node long, twin long, part int, segment int, counters binary")


def _counters(survey: DataFrame, join: Join) -> np.ndarray:
    """The sum of all tasks' counters; its size is fixed. Two levels, so that no group holds more than a root of the tasks."""
    parts = survey.filter("segment is not null")
    tasks = parts.agg(F.max("part")).first()[0] or 0
    schema = "part int, segment int, counters binary"

    def add(group: pa.Table) -> pa.Table:
        total = sum(unpack(b.as_py(), "<u4")[0].astype(np.uint64) for b in group.column("counters"))
        blob = pack(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))
        return pa.table([pa.array([0], pa.int32()), group.column("segment")[:1].cast(pa.int32()), pa.array([blob], pa.binary())], ["part", "segment", "counters"])

    some = parts.select((F.col("part") % (math.isqrt(tasks) + 1)).alias("part"), "segment", "counters").groupBy("part", "segment").applyInArrow(add, schema)
    rows = some.groupBy("segment").applyInArrow(add, schema).collect()  # as many bytes as the table of counters has
    return np.concatenate([unpack(r.counters, "<u4")[0] for r in sorted(rows, key=lambda r: r.segment)]) if rows else np.zeros(1 << join.counter_bits, np.uint32)


_ENTRY = ("<u8", "<i8", "<u4", "<u4")
#: Columns go by 48 bits of an n-gram's hash: two n-grams that share them only make candidates more.
_COLUMN = np.uint64((1 << 48) - 1)


def _entries(docs: DataFrame, counters, join: Join, blocks: int, limit: int, more: int, seed: int) -> DataFrame:
    """block and packed entries (n-gram, node, size, place) of all prefixes. counters: a broadcast. Entries of columns whose counter
    is above the limit are dealt, by n-gram and node, to more blocks behind the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shift = counters.value, np.uint64(64 - join.counter_bits)
        for batch in batches:
            seen: set[int] = set()
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for text in batch.column(1):
                own = shingles(text.as_py(), join.words)
                if not len(own) or (node := node_of(own, seed)) in seen:
                    continue
                seen.add(node)
                n = len(own)
                first = own[np.lexsort((own, table[(own >> shift).astype(np.int64)]))[: join.prefix(n)]]
                for column, value in zip(columns, (first, np.full(len(first), node, np.int64), np.full(len(first), n, np.uint32), np.arange(len(first), dtype=np.uint32)), strict=True):
                    column.append(value)
            if not seen:
                continue
            arrays = [np.concatenate(c) for c in columns]
            hot = table[(arrays[0] >> shift).astype(np.int64)] > limit
            arrays[0] &= _COLUMN
            of = (arrays[0] % np.uint64(blocks)).astype(np.int64)
            of[hot] = blocks + (mixed(arrays[0][hot] ^ arrays[1][hot].view(np.uint64)) % np.uint64(more)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(blocks + more + 1))
            rows = [(b, pack(*(a[order[starts[b] : starts[b + 1]]] for a in arrays))) for b in range(blocks + more) if starts[b] < starts[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "entries"])

    return docs.mapInArrow(run, "block int, entries binary")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of each run of equal sorted keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(keys)) if len(keys) else starts


def _partnered(gram: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, join: Join) -> list[np.ndarray]:
    """The entries, sorted by gram and size, whose column has another node that the bounds of sizes and places allow.

    The least fitting size asks for the least overlap, so an entry is compared with that one.
    """
    order = np.lexsort((n, gram))
    gram, node, n, place = gram[order], node[order], n[order], place[order]
    starts, ends = _runs(gram)
    of = np.repeat(np.arange(len(starts)), ends - starts)
    size, span = n.astype(np.int64), int(n.max(initial=0)) + 1
    least = -(-join.percent * size // 100)
    partner = np.searchsorted(of * span + size, of * span + least)
    partner += partner == np.arange(len(gram))
    there = partner < len(gram)
    partner[~there] = 0
    other = size[partner]
    need = -(-join.percent * (size + other) // (100 + join.percent))
    fits = there & (of[partner] == of) & (100 * size >= join.percent * other) & (size - place >= need) if len(gram) else there
    return [a[fits] for a in (gram, node, n, place)]


def _columns(entries: DataFrame, join: Join, blocks: int) -> DataFrame:
    """block, entries of the columns that at least two nodes share and that bounds allow to link; all entries of blocks that hold
    parts of columns."""

    def run(block: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py(), *_ENTRY) for b in block.column("entries")]
        gram, node, n, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((node, gram))
        gram, node, n, place = gram[order], node[order], n[order], place[order]
        fresh = np.concatenate(([True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])))
        gram, node, n, place = gram[fresh], node[fresh], n[fresh], place[fresh]
        arrays = [gram, node, n, place]
        if block.column("block")[0].as_py() < blocks:
            arrays = _partnered(*_partnered(*arrays, join), join)
        return pa.table([block.column("block")[:1].cast(pa.int32()), pa.array([pack(*arrays)], pa.binary())], ["block", "entries"])

    return entries.groupBy("block").applyInArrow(run, "block int, entries binary")


def _exploded(columns: DataFrame) -> DataFrame:
    """gram, node, n, place of all entries, a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                gram, node, n, place = unpack(blob.as_py(), *_ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], ["gram", "node", "n", "place"])

    return columns.mapInArrow(run, "gram long, node long, n int, place int")


def _by_hubs(apart: DataFrame, turn: int, join: Join) -> DataFrame:
    """a, b: of the product of all rows by representatives, the pairs with each row's greatest overlaps so far.

    The representatives of a column are its nodes with the least hashes, other ones in each turn and only one in the first, when
    all columns have a say. Of a column, no more than its entries times these few are added up.
    """
    hubs = range(join.hubs if turn else 1)
    one = F.struct("node", "n", "component")
    chosen = apart.groupBy("gram").agg(*(F.min_by(one, F.struct(F.xxhash64("node", F.lit(turn * join.hubs + i)), "node")).alias(f"hub{i}") for i in hubs))
    products = apart.join(chosen, "gram").select("node", "n", "component", F.explode(F.array_distinct(F.array(*(f"hub{i}" for i in hubs)))).alias("hub"))
    small, large = F.least("n", "hub.n"), F.greatest("n", "hub.n")
    fit = products.filter((F.col("component") != F.col("hub.component")) & (100 * small >= join.percent * large))
    overlaps = fit.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.count("*").alias("overlap"))
    # a node has as many candidates as its columns have representatives, no more
    best = overlaps.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("overlap", "b")), asc=False).alias("best"))
    pairs = best.select("a", F.explode(F.slice("best", 1, join.compared)).alias("one")).select("a", "one.b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


_APART = ["gram", "node", "n", "place", "component"]


def _apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """gram, node, n, place, component of the columns whose nodes are in several groups. rows: of columns that once were so."""
    rows = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = rows.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("gram")
    return rows.join(several, "gram").select(*_APART)


def _dealt(apart: DataFrame, join: Join) -> DataFrame:
    """The rows of apart with block, part and mixed: a long column is dealt to parts, and each two of its parts meet in a block."""
    counts = apart.groupBy("gram").agg(F.ceil(F.count("*") / join.column).cast("int").alias("parts")).filter("parts > 1")
    dealt = apart.join(counts, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.xxhash64("gram", F.least("part", "other"), F.greatest("part", "other"))
    # the rows of a part meet each other once, in the block of the part with itself
    return dealt.select(block.alias("block"), F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("part"), *_APART)


def _between(apart: DataFrame, rows: DataFrame, join: Join) -> DataFrame:
    """a, b of different groups that share an entry and pass the bounds of sizes, places and signatures: the product of all that is
    not linked yet."""
    names = ["block", "part", *_APART, "signature"]
    signed = _dealt(apart, join).join(rows.select("node", "signature"), "node").select(*names)

    def multiplied(part: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, component: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs of one block, whose rows are in the order of their sizes: partners of a row from it on are a range."""
        t = join.percent
        stops = np.searchsorted(n, 100 * n // t, "right")
        for i in range(len(n) - 1):
            j = np.arange(i + 1, stops[i])
            if not len(j):
                continue
            need = -(-t * (n[i] + n[j]) // (100 + t))
            good = (component[j] != component[i]) & ((part[j] != part[i]) | (part[i] < 0)) & (n[i] - place[i] >= need) & (n[j] - place[j] >= need)
            j, need = j[good], need[good]
            j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= n[i] + n[j] - 2 * need]
            if len(j):
                yield np.stack((np.minimum(node[j], node[i]), np.maximum(node[j], node[i])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block and size, so a block and a batch are all that is held."""

        def of_blocks(held: pa.Table) -> Iterator[np.ndarray]:
            block, part, _, node, n, place, component = (held.column(c).to_numpy() for c in names[:-1])
            bits = np.frombuffer(b"".join(held.column("signature").to_pylist()), np.uint64).reshape(len(block), -1)
            for lo, hi in zip(*_runs(block), strict=True):
                if hi - lo > 1:
                    yield from multiplied(part[lo:hi], node[lo:hi], n[lo:hi].astype(np.int64), place[lo:hi].astype(np.int64), component[lo:hi], bits[lo:hi])

        def pairs() -> Iterator[np.ndarray]:
            held = None
            for batch in batches:
                if not len(batch):
                    continue
                table = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, table]) if held is not None else table
                block = held.column("block").to_numpy()
                last = int(np.searchsorted(-(block != block[-1]).astype(np.int8), 0)) if block[0] != block[-1] else 0
                if last:
                    yield from of_blocks(held.slice(0, last))
                    held = held.slice(last).combine_chunks()
            if held is not None:
                yield from of_blocks(held)

        found, number = [], 0
        for some in pairs():
            found.append(some)
            number += some.shape[1]
            if number > 500_000:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                if (number := found[0].shape[1]) > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0][0]), pa.array(found[0][1])], ["a", "b"])
                    found, number = [], 0
        if found:
            unique = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(unique[0]), pa.array(unique[1])], ["a", "b"])

    return signed.repartition("block").sortWithinPartitions("block", "n").mapInArrow(run, "a long, b long").distinct()


def _possible(pairs: DataFrame, rows: DataFrame, join: Join) -> DataFrame:
    """The pairs whose sizes and signatures let them reach the threshold."""
    of = lambda x: rows.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}"))
    both = pairs.hint("merge").join(of("a"), "a").hint("merge").join(of("b"), "b").select("a", "b", "n_a", "n_b", "signature_a", "signature_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            first, second = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(batch), -1) for i in (4, 5))
            need = -(-join.percent * n // (100 + join.percent))
            yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(first ^ second).sum(axis=1) <= n - 2 * need))

    return both.mapInArrow(run, "a long, b long")


def _completed(pairs: DataFrame, rows: DataFrame, join: Join) -> DataFrame:
    """a, b and overlap of the pairs whose rows, multiplied to the end, reach the threshold."""
    left = pairs.hint("merge").join(rows.select(F.col("node").alias("a"), F.col("row").alias("row_a")), "a")
    both = left.join(rows.select(F.col("node").alias("b"), F.col("row").alias("row_b")), "b").select("a", "b", "row_a", "row_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, overlaps = [], []
            for row_a, row_b in zip(batch.column(2), batch.column(3), strict=True):
                first, second = (np.frombuffer(x.as_buffer(), np.uint64) for x in (row_a, row_b))
                overlaps.append(overlap(first, second))
                keep.append(bool(join.linked(overlaps[-1], len(first), len(second))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(overlaps, pa.int64())], ["a", "b", "overlap"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long, overlap long")


def _linked(docs: DataFrame, join: Join, key: str, text: str) -> DataFrame:
    """A table of doc_id, digest (of the text), n and component (a node; null without shingles) of every row. All other tables that
    led to it are gone."""
    with Staging(docs.sparkSession, "ngram-join") as staging:
        return Staging(docs.sparkSession, "near-copies").save(_link(docs, join, key, text, staging), "rows")


def _link(docs: DataFrame, join: Join, key: str, text: str, staging: Staging) -> DataFrame:
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("digest"))
    for seed in range(5, 1 << 30, 2):
        survey = staging.save(_survey(narrow, join, seed), "survey", batch_rows=2000)
        sets = survey.filter("segment is null")
        if sets.groupBy("node").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).filter("low <> high").isEmpty():
            break
    summed = _counters(survey, join)
    counters = spark.sparkContext.broadcast(summed)  # 4 << join.counter_bits bytes
    limit = int(max(16 * summed.mean(), join.hot))
    more = max(1, math.ceil(int(summed[summed > limit].sum()) / join.block_entries))
    members = staging.save(sets.select("doc_id", "digest", "n", "node"), "members")
    staging.drop("survey")
    total = members.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total * (100 - join.percent) / 100 / join.block_entries))
    columns = staging.save(_columns(_entries(narrow, counters, join, blocks, limit, more, seed), join, blocks), "columns", batch_rows=2000)
    counters.destroy()
    apart = staging.deal(_exploded(columns).withColumn("component", F.col("node")).select(*_APART).repartition(partitions, "gram"), "apart-0", "gram")
    staging.drop("columns")

    several = apart.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("gram")
    wanted = staging.save(members.join(apart.join(several, "gram").select("node").distinct(), "node").groupBy("node").agg(F.min("digest").alias("digest")), "wanted")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingles(t.as_py(), join.words) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([signature(r).tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "row", "signature"])

    some, _ = parted(narrow, F.col("digest"), wanted.select("digest"))
    once = some.join(wanted.hint("merge"), "digest").dropDuplicates(["digest"]).select("node", "text")
    made = once.mapInArrow(own, "node long, n long, row binary, signature binary").repartition(partitions, "node")
    rows = staging.deal(made, "rows", "node", batch_rows=1000)  # read in each turn, so dealt out by node once and for all

    groups, turn, more_turns, entries = None, 0, True, None
    while True:
        # while overlaps with few rows often are links, it is too early to multiply all rows of different groups
        pairs = staging.save(_possible(_by_hubs(apart, turn, join), rows, join) if more_turns else _between(apart, rows, join), f"pairs-{turn}")
        links = staging.save(_completed(pairs, rows, join), f"links-{turn}", batch_rows=500)
        found, met = links.count(), pairs.count()
        staging.drop(f"pairs-{turn}")
        if groups is None:
            groups = components(links, staging, "first-groups")
        elif found:
            groups = merged(groups, links, staging, f"groups-{turn}")
        staging.drop(f"links-{turn}")
        if not more_turns:
            break
        turn += 1
        apart = staging.deal(_apart(apart.drop("component"), groups), f"apart-{turn}", "gram")
        staging.drop(f"apart-{turn - 1}")
        before, entries = entries, apart.count()
        more_turns = before is None or found > join.worthwhile * met and entries <= (1 - join.settled) * before
    return members.join(groups.withColumnRenamed("component", "of"), "node", "left").select("doc_id", "digest", "n", F.coalesce("of", "node").alias("component"))


def link_groups(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) of every row.

    Null and blank texts have no shingles and are linked with nothing; their component is their own id. Repeated rows are kept and
    belong together. A null id is the component only where all ids that links reach are null. Other columns of docs are not read,
    whatever their names. An empty input has no rows. Very long texts are hashed whole, some forty bytes for each of their own.
    """
    rows = _linked(docs, join, key, text)
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id")).filter("component is not null")
    of = rows.join(least, "component", "left")
    return of.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: of the least id, and among rows of that id the one whose text has the least digest.

    A null id is greater than all others. Rows are told apart by id and text, so rows that share an id and nothing else all stay,
    and of rows equal in both one stays. Rows without shingles all stay. All columns stay.
    """
    rows = _linked(docs, join, key, text).filter("component is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    best = rows.groupBy("component").agg(F.min(rank).alias("best"))
    ranked = rows.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n")).join(best, "component").withColumn("stays", rank == F.col("best"))
    decided = Staging(docs.sparkSession, "left-out").save(ranked.filter("n > 1 or not stays").select("doc_id", "digest", "stays"), "rows")
    told, others = told_apart(docs, decided.withColumnRenamed("stays", "__stays"), key, text)
    free = told.filter("__stays is null").select(*docs.columns)
    one = told.filter("__stays").dropDuplicates(["__id", "__digest"]).select(*docs.columns)
    return free.unionAll(one).unionAll(others)
