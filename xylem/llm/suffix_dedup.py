"""Removal of strings that repeat anywhere in a corpus, by a logarithmic family of suffix arrays.

A suffix array of every byte would be many times the corpus, so the arrays are sparse: of the suffixes that begin in a document,
those are indexed that are anchors of a string of ``length`` units (bytes, or words). The anchor of a string is the suffix in it
whose first ``gram`` units have the least hash, so equal strings have anchors at the same place with the same first units.

* A new batch of documents gets a suffix array of its own: its anchors' heads, the first ``gram`` units of their suffixes, in the
  order of their text within buckets, each head with its number of occurrences. Equal heads meet in a partial aggregate before the
  shuffle, so a head in a third of all documents is a row from each task.
* The array is merge-scanned for heads that occur in it twice, and, by a sort-merge join of tables with equal buckets and order,
  against each existing level for heads that occur there: these are the places where long matches may be.
* Then it is a level of its own. Before the next batch, levels merge while the older of two has fewer than MERGED times the rows of
  the newer, so n batches leave about log n levels and a head is rewritten about log n times.

The family is a folder: levels, the places of anchors, repeated heads and a manifest. It can be opened by another session, and
takes later batches then; see Family.

Anchors whose head repeats then are compared in full. An anchor stands for a run of neighbouring strings. If the text of the whole
run repeats, all of them do; if only the head repeats, the run is cut into pieces and each piece is judged the same way by what is
common to all its strings, and at last string by string. Texts are fetched once, and only those with repeated heads. Groups of
equal strings are counted, not paired. Texts stand for themselves by 128 bits of SHA-256, strings by two independent 64-bit hashes.

Several kinds of strings can be asked for at once, and then all are judged on the input, each kind in a family of its own.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm.common import PLAIN, Staging, mixed, parted, text_key
from xylem.llm.rolling import Text, Words


@dataclass(frozen=True)
class Repeats:
    """length: of the strings. gram: units of an anchor's head. piece: strings in a piece. batches: that a corpus without a family
    is added in. words: whether length and gram are numbers of words and strings begin at words, or else bytes."""

    length: int = 400
    gram: int = 64
    piece: int = 16
    batches: int = 4
    words: bool = False

    @property
    def least(self) -> int:
        """Bytes that a text with a string has at least."""
        return 2 * self.length - 1 if self.words else self.length

    def units(self, data: bytes) -> Text:
        return Words(data) if self.words else Text(data)

    def joined(self, texts: Sequence[bytes | pa.Buffer]) -> Iterator[tuple[int, int, Text, np.ndarray]]:
        """Neighbouring texts as one, as short ones take longer one by one: the first of them, the end of them, their units, and
        bounds, the units at which each begins and the last ends. Hashes do not hang on places, so they are those of each text."""
        low, size = 0, 0
        for high, text in enumerate(texts, 1):
            size += len(text)
            if high < len(texts) and size + len(texts[high]) <= JOINED:
                continue
            units = self.units((b" " if self.words else b"").join(texts[low:high]))
            bounds = np.cumsum([0, *(len(x) + self.words for x in texts[low:high])])
            yield low, high, units, np.searchsorted(units.begin, bounds) if self.words else bounds
            low, size = high, 0


BYTES = Repeats()

#: All strings of more than 50 words, whatever their bytes.
PASSAGES = Repeats(length=51, gram=10, piece=4, words=True, batches=2)

#: Levels merge below this ratio. Batches of equal size give ratios near 1, 2, 4, ...; it is apart from all of these, so that
#: small differences of size do not decide what merges.
MERGED = 1.5

#: Starts of strings whose anchors are looked for at once, so that what is made on the way stays in a core's cache.
CHUNK = 1 << 15

#: Bytes of the texts that are taken as one, at most, if they are several.
JOINED = 1 << 17


def _anchor_places(text: Text, low: int, high: int, how: Repeats) -> np.ndarray:
    """The anchor of each string that starts from low to high. Windows span two blocks at most, so a place within two blocks in
    the low bits of the hash breaks ties to the left."""
    k, w, n = how.gram, how.length - how.gram + 1, high - low
    bits = (2 * w - 1).bit_length()
    x = np.full(-(-(n - 1 + w) // w) * w, np.iinfo(np.uint64).max)
    x[: n - 1 + w] = text.hashes_of_all(low, high - 1 + w, k)
    x &= np.uint64((1 << 64) - (1 << bits))
    rows, place = x.reshape(-1, w), np.arange(w, dtype=np.uint64)
    ahead = np.minimum.accumulate(rows | (place + np.uint64(w)), axis=1).ravel()
    rows |= place
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    least &= np.uint64((1 << bits) - 1)
    return np.repeat(np.arange(low, low + len(x), w), w)[:n] + least.view(np.int64)


def _counted(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each first on, so many as its count, and which first each is of."""
    of = np.repeat(np.arange(len(first)), counts)
    return np.arange(len(of)) + (first - np.cumsum(counts) + counts)[of], of


def anchors_of(text: Text, how: Repeats, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and head's hash of each anchor, and the first and last start of the strings that it stands for. bounds: of the texts
    that text is joined of; strings never cross them."""
    bounds = np.array([0, text.n]) if bounds is None else bounds
    strings, counts = text.n - how.length + 1, np.maximum(np.diff(bounds) - how.length + 1, 0)
    if not counts.any():
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    at = np.concatenate([_anchor_places(text, low, min(low + CHUNK, strings), how) for low in range(0, strings, CHUNK)])
    starts = None if len(counts) == 1 else _counted(bounds[:-1], counts)[0]  # one text, which may be long, has all starts
    at = at if starts is None else at[starts]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last, at = np.append(first[1:], len(at)) - 1, at[first]
    if starts is not None:
        first, last = starts[first], starts[last]
    return at, text.hashes(at, at + how.gram), first, last


def texts_of(docs: DataFrame, text: str, least: int = 0) -> DataFrame:
    """text (its key) and data of every row whose text has so many bytes at least."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("whole")).filter(F.octet_length("whole") >= least)
    return rows.select(text_key(F.col("whole")).alias("text"), F.col("whole").cast("binary").alias("data"))


def _anchors(texts: DataFrame, how: Repeats) -> DataFrame:
    """head, mark (a hash of the head), text and at of the anchors of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, marks, names, places, seen = [], [], [], [], Counter()

            def out():
                arrays = [pa.array(heads, pa.binary()), pa.array(np.concatenate(marks).view(np.int64)), pa.concat_arrays(names), pa.array(np.concatenate(places))]  # noqa: B023
                return pa.RecordBatch.from_arrays(arrays, ["head", "mark", "text", "at"])

            chosen = []
            for i, name in enumerate(batch.column(0).to_pylist()):
                if seen[name] < 2:  # two copies show that all of its heads repeat
                    chosen.append(i)
                seen[name] += 1
            keys = batch.column(0).take(pa.array(chosen, pa.int64()))
            for low, _, units, bounds in how.joined([batch.column(1)[i].as_buffer() for i in chosen]):
                at, hashes, _, _ = anchors_of(units, how, bounds)
                of = np.searchsorted(bounds, at, "right") - 1
                heads += units.heads(at, how.gram)
                marks.append(hashes)
                names.append(keys.take(pa.array(low + of)))
                places.append(at - bounds[of])
                if len(heads) > 100_000:
                    yield out()
                    heads, marks, names, places = [], [], [], []
            if heads:
                yield out()

    return texts.mapInArrow(run, "head binary, mark long, text binary, at long")


class Family:
    """The levels under a folder that driver and executors share; a new folder is an empty family.

    The manifest is appended to, a version at a time, after all tables of the version are written; what an interrupted version
    left behind is not read. One session adds at a time.
    """

    def __init__(self, spark: SparkSession, root: str, how: Repeats = BYTES):
        self.spark, self.how, self.tables = spark, how, Staging.at(spark, root)
        self.version, self.levels, self.batches, self.buckets = 0, [], [], int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._manifest = "version int, place int, kind string, name string, size long, buckets int, gram int, length int, words boolean"
        if self.tables.exists("manifest"):
            rows = self.tables.read("manifest", self._manifest).collect()  # a few rows a version
            self.version = max(r.version for r in rows)
            last = sorted((r for r in rows if r.version == self.version), key=lambda r: r.place)
            self.buckets = last[0].buckets
            if any((r.gram, r.length, r.words) != (how.gram, how.length, how.words) for r in last):
                raise ValueError("the family was made for other strings")
            self.levels = [(r.size, r.name) for r in last if r.kind == "level"]
            self.batches = [r.name for r in last if r.kind == "batch"]
            for _, name in self.levels:
                self._declare(name)

    def _declare(self, name: str) -> None:
        """Tells the session of a level's files, their buckets and order."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (head BINARY, mark BIGINT, n BIGINT) USING parquet CLUSTERED BY (head) SORTED BY (head) INTO {self.buckets} BUCKETS LOCATION '{self.tables.root}/{name}'")

    def _write(self, heads: DataFrame) -> tuple[int, str]:
        """A level: distinct heads in the order of their text within buckets."""
        name = f"xylem_level_{uuid.uuid4().hex[:12]}"
        writer = heads.write.format("parquet").option("path", f"{self.tables.root}/{name}").options(**PLAIN)
        writer.bucketBy(self.buckets, "head").sortBy("head").saveAsTable(name)
        return self.spark.table(name).count(), name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.drop(name)

    def add(self, texts: DataFrame) -> None:
        """Adds a batch (text, data): its suffix array is scanned against itself and all levels, and becomes a level."""
        gone = []
        while len(self.levels) > 1 and self.levels[-2][0] < MERGED * self.levels[-1][0]:
            (_, one), (_, two) = self.levels.pop(), self.levels.pop()
            a, b = self.spark.table(one).alias("a"), self.spark.table(two).alias("b")  # merged in the order that both have
            n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
            self.levels.append(self._write(a.join(b, "head", "full_outer").select("head", F.coalesce("a.mark", "b.mark").alias("mark"), n.alias("n"))))
            gone += [one, two]
        batch = uuid.uuid4().hex[:12]
        anchors = self.tables.save(_anchors(texts, self.how), f"anchors-{batch}", plain=True)
        self.tables.save(anchors.select("mark", "text", "at"), f"places-{batch}")
        size, new = self._write(anchors.groupBy("head").agg(F.min("mark").alias("mark"), F.count("*").alias("n")).repartition(self.buckets, "head"))
        self.tables.drop(f"anchors-{batch}")
        heads = self.spark.table(new)
        found = heads.filter("n > 1").select("mark")
        for _, level in self.levels:
            found = found.unionAll(heads.join(self.spark.table(level).select("head"), "head", "left_semi").select("mark"))
        self.tables.save(found.distinct(), f"repeated-{batch}")
        self.levels.append((size, new))
        self.batches.append(batch)
        self.version += 1
        rows = [("level", name, size) for size, name in self.levels] + [("batch", name, 0) for name in self.batches]
        rows = [(self.version, i, kind, name, size, self.buckets, self.how.gram, self.how.length, self.how.words) for i, (kind, name, size) in enumerate(rows)]
        self.tables.append(self.spark.createDataFrame(rows, self._manifest).coalesce(1), "manifest")
        for name in gone:
            self._remove(name)

    def _all(self, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for name in self.batches:
            out = out.unionAll(self.tables.read(f"{kind}-{name}", schema))
        return out

    def hits(self) -> DataFrame:
        """text and at of the anchors, of all batches, whose heads occur again."""
        again = self._all("repeated", "mark long").distinct()
        return self._all("places", "mark long, text binary, at long").join(again.hint("merge"), "mark").select("text", "at")  # both grow with the corpus

    def drop(self) -> None:
        for _, name in self.levels:
            self._remove(name)
        self.tables.close()


_NAMES = ["key", "span", "twin", "id", "at", "first", "last", "lone"]
_ITEM = ", ".join(f"{c} long" for c in _NAMES)


def _rows(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    arrays = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)) for a in arrays], names)


def _items(texts: DataFrame, how: Repeats, make) -> DataFrame:
    """Items that make(units of joined texts, their bounds, their arrays) yields. texts: id, data and then arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in _NAMES]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, units, bounds in how.joined([x.as_buffer() for x in batch.column(1)]):
                arrays = []
                for name, lists in zip(batch.schema.names[2:], batch.slice(low, high - low).columns[2:], strict=True):
                    x = lists.flatten().to_numpy(zero_copy_only=False)
                    arrays.append(x if name == "lone" else x + np.repeat(bounds[:-1], lists.value_lengths().to_numpy(zero_copy_only=False)))
                key, span, twin, at, first, last, lone = make(units, bounds, *arrays)
                of = np.searchsorted(bounds, at, "right") - 1
                start = bounds[of]
                for column, x in zip(columns, (key, span, twin, ids[low + of], at - start, first - start, last - start, lone), strict=True):
                    column.append(x)
            yield _rows(columns, _NAMES)

    return texts.mapInArrow(run, _ITEM)


def _judged(items: DataFrame, staging: Staging, name: str) -> tuple[DataFrame, DataFrame]:
    """Runs of strings that repeat as a whole (id, first, last), and what is open: one item for each span of keys with several."""
    same, one = ["key", "span", "twin"], ["id", "at", "first", "last"]
    items = staging.save(items, f"{name}-items", batch_rows=1000, plain=True)
    # the firsts of one aggregate are of one row, whichever comes; all of a span are alike, and longs are aggregated without a sort
    spans = items.groupBy(*same).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in one), F.max("lone").alias("lone"))
    spans = staging.save(spans, f"{name}-spans", plain=True)
    again = spans.filter("n > 1").select(*same)
    whole = staging.save(items.filter("lone = 1").join(again, same).select("id", "first", "last"), f"{name}-runs")
    staging.drop(f"{name}-items")
    several = spans.groupBy("key").agg(F.count("*").alias("spans"), F.max(F.when(F.col("n") == 1, F.col("lone")).otherwise(0)).alias("any")).filter("spans > 1 and any = 1").select("key")
    # spans that repeat are settled; they stay in the comparison for the sake of the others
    opened = staging.save(spans.join(several, "key").select(*one, F.when(F.col("n") == 1, F.col("lone")).otherwise(0).alias("lone")), f"{name}-open")
    staging.drop(f"{name}-spans")
    return whole, opened


def repeated_runs(texts: DataFrame, staging: Staging, how: Repeats) -> DataFrame:
    """id, first, last: runs of starts of strings that occur elsewhere. texts: id, data and at, the repeated anchors."""
    length, piece = how.length, how.piece

    def both(text: Text, begin: np.ndarray, end: np.ndarray, salt) -> tuple[np.ndarray, np.ndarray]:
        return mixed(text.hashes(begin, end) ^ salt), mixed(text.twin().hashes(begin, end) ^ salt)

    def anchors(text: Text, bounds: np.ndarray, at: np.ndarray):
        places, keys, first, last = anchors_of(text, how, bounds)
        chosen = np.isin(places, at)
        places, keys, first, last = places[chosen], keys[chosen], first[chosen], last[chosen]
        span = both(text, first, last + length, ((places - first) << 32 | (last - first)).astype(np.uint64))
        return keys, *span, places, first, last, np.ones(len(places), np.int64)

    def pieces(text: Text, _: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, lone: np.ndarray):
        low, high = (at - last) // piece, (at - first) // piece  # numbers of the pieces, counted to the left from the anchor
        number, of = _counted(low, high - low + 1)
        right, left = at[of] - number * piece, at[of] - number * piece - piece + 1
        begin, end = np.maximum(left, first[of]), np.minimum(right, last[of])
        key = mixed(text.hashes(right, left + length) ^ (number + 1).astype(np.uint64))
        span = both(text, begin, end + length, ((right - begin) << 32 | (end - begin)).astype(np.uint64))
        return key, *span, at[of], begin, end, lone[of]

    def strings(text: Text, _: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, lone: np.ndarray):
        start, of = _counted(first, last - first + 1)
        key, twin = both(text, start, start + length, np.uint64(0))
        return key, key, twin, at[of], start, start, lone[of]

    def opened_texts(opened: DataFrame) -> DataFrame:
        """One row per text; its items are as many as the text has anchors at most."""
        lists = opened.groupBy("id").agg(F.collect_list(F.struct("at", "first", "last", "lone")).alias("i"))
        return lists.join(texts.select("id", "data"), "id").select("id", "data", "i.at", "i.first", "i.last", "i.lone")

    whole, opened = _judged(_items(texts.filter("at is not null"), how, anchors), staging, "anchors")
    parts, last = _judged(_items(opened_texts(opened), how, pieces), staging, "pieces")
    staging.drop("anchors-open")
    items = staging.save(_items(opened_texts(last), how, strings), "strings-items", batch_rows=1000, plain=True)
    staging.drop("pieces-open")
    again = items.groupBy("key", "twin").agg(F.count("*").alias("n")).filter("n > 1").select("key", "twin")
    single = staging.save(items.filter("lone = 1").join(again, ["key", "twin"]).select("id", "first", "last"), "strings-runs")
    staging.drop("strings-items")
    return whole.unionAll(parts).unionAll(single)


def _merged(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal stretches that runs of strings cover."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + length)
    fresh = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return begin[fresh], end[np.append(fresh[1:], len(end)) - 1]


def _whole_characters(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches less the characters that they hold in part."""
    starts = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
    inner = starts[np.searchsorted(starts, begin)]
    return inner, np.maximum(inner, starts[np.searchsorted(starts, end, "right") - 1])


_SPANS = "array<struct<begin:long,end:long>>"


def _spans(texts: DataFrame, kinds: Sequence[Repeats], also: Sequence[Repeats]) -> DataFrame:
    """text (its key), spans that are removed, kept (what lies between them) and kept_text (the same in whole characters, without the
    strings of the kinds also either). texts: text, data, copied and the lists kind (of kinds and then also), first and last of runs."""

    def stretches(some: Sequence[Repeats], data: bytes, copied: bool, of: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the runs of some kinds; of a text that has copies, of all its strings."""
        begins, ends = [], []
        for i, kind in enumerate(some):
            own = of == i
            if not copied and not own.any():
                continue
            units = kind.units(data)
            if copied and units.n >= kind.length:
                begin, end = np.array([0]), np.array([units.n])
            elif own.any():
                begin, end = _merged(first[own], last[own], kind.length)
            else:
                continue
            if kind.words:
                begin, end = units.begin[begin], units.end[end - 1]
            begins.append(begin)
            ends.append(end)
        return _merged(np.concatenate(begins), np.concatenate(ends), 0) if begins else (np.empty(0, np.int64), np.empty(0, np.int64))

    def pairs(begin: np.ndarray, end: np.ndarray) -> list[dict]:
        return [{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True) if b < e]

    def between(begin: np.ndarray, end: np.ndarray, n: int) -> list[dict]:
        return pairs(np.concatenate(([0], end)), np.append(begin, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for name, data, copied, *lists in zip(*batch.columns, strict=True):
                data = data.as_py()
                runs = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int64) for x in lists]
                begin, end = stretches(kinds, data, copied.as_py(), *runs)
                more = stretches([*kinds, *also], data, copied.as_py(), *runs) if also else (begin, end)
                if len(more[0]):
                    for column, x in zip(out, (name.as_py(), pairs(begin, end), between(begin, end, len(data)), between(*_whole_characters(data, *more), len(data))), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *(pa.array(x, span) for x in out[1:])], ["text", "spans", "kept", "kept_text"])

    return texts.select("text", "data", "copied", "kind", "first", "last").mapInArrow(run, f"text binary, spans {_SPANS}, kept {_SPANS}, kept_text {_SPANS}")


def removals(docs: DataFrame, kinds: Sequence[Repeats], text: str = "text", families: Sequence[Family] = (), also: Sequence[Repeats] = ()) -> DataFrame:
    """A table with spans, kept and kept_text of each text that loses something; see _spans. It is small against the texts, and all
    that is left of the tables that led to it. families: of the kinds, and of also, with all of docs added; or else new ones are made."""
    with Staging(docs.sparkSession, "suffixes") as staging:
        return Staging(docs.sparkSession, "removals").save(_removals(docs, kinds, text, families, also, staging), "spans", batch_rows=1000)


def _removals(docs: DataFrame, counted: Sequence[Repeats], text: str, families: Sequence[Family], also: Sequence[Repeats], staging: Staging) -> DataFrame:
    spark, kinds = docs.sparkSession, [*counted, *also]
    texts = texts_of(docs, text, min(kind.least for kind in kinds))
    hits = []
    for i, kind in enumerate(kinds):
        if families:
            family = families[i]
        else:
            family = Family(spark, f"{staging.root}/family-{i}", kind)
            for batch in range(kind.batches):
                family.add(texts_of(docs.filter(F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(kind.batches)) == batch), text, kind.least))
        hits.append(staging.save(family.hits().groupBy("text").agg(F.collect_set("at").alias(f"at_{i}")), f"hits-{i}"))
        if not families:
            family.drop()
    hit = hits[0]
    for more in hits[1:]:
        hit = hit.join(more, "text", "full_outer")
    hit = staging.save(hit, "hit")
    copied = docs.select(text_key(F.col(text)).alias("text")).groupBy("text").agg(F.count("*").alias("n")).filter("n > 1").select("text", F.lit(True).alias("copied"))
    some, _ = parted(texts, F.col("text"), hit.select("text"))
    # hit is the larger of the small sides in a join of texts; one exchange by their key serves the join and the choice of one row
    once = some.join(hit.join(copied, "text", "left").hint("merge"), "text").dropDuplicates(["text"])
    once = once.select(F.monotonically_increasing_id().alias("id"), "text", "data", F.coalesce("copied", F.lit(False)).alias("copied"), *(f"at_{i}" for i in range(len(kinds))))
    # texts are read in several turns, so they are dealt out by id once and for all
    fetched = staging.deal(staging.save(once, "once").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"), "texts", "id")
    for name in ("hit", "once", *(f"hits-{i}" for i in range(len(kinds)))):
        staging.drop(name)
    runs: DataFrame | None = None
    for i, kind in enumerate(kinds):
        inner = Staging.at(spark, f"{staging.root}/judged-{i}")  # only the runs are left there
        of_kind = repeated_runs(fetched.select("id", "data", F.col(f"at_{i}").alias("at")), inner, kind).withColumn("kind", F.lit(i))
        runs = of_kind if runs is None else runs.unionAll(of_kind)
    lists = runs.groupBy("id").agg(F.collect_list(F.struct("kind", "first", "last")).alias("r")).select("id", "r.kind", "r.first", "r.last")
    return _spans(fetched.join(lists, "id", "left").filter("copied or kind is not null"), counted, also)


def _with_removals(rows: DataFrame, found: DataFrame, text: str, names: list[str], make) -> DataFrame:
    """names of rows, and what make(spans, kept, kept_text) is for texts that lose something and for all others, where these are null."""
    null = F.lit(None).cast(_SPANS)
    changed, same = parted(rows.withColumn("__key", text_key(F.col(text))), F.col("__key"), found.select("text"))
    of = found.select(F.col("text").alias("__key"), F.col("spans").alias("__spans"), F.col("kept").alias("__kept"), F.col("kept_text").alias("__kept_text"))
    joined = changed.join(of.hint("merge"), "__key", "left").select(*names, *make(F.col("__spans"), F.col("__kept"), F.col("__kept_text")))
    return joined.unionAll(same.select(*names, *make(null, null, null)))


def _left(whole: Column, kept_text: Column) -> Column:
    """The text that is left, null where nothing is removed."""
    data = whole.cast("binary")
    return F.array_join(F.transform(kept_text, lambda s: F.substring(data, (s.begin + 1).cast("int"), (s.end - s.begin).cast("int")).cast("string")), "")


def without_repeats(docs: DataFrame, *how: Repeats, text: str = "text", families: Sequence[Family] = ()) -> DataFrame:
    """docs with what is left of each text; all other columns and all rows stay. See removed_spans."""
    found = removals(docs, how or (BYTES,), text, families)
    names = [c for c in docs.columns if c != text]
    make = lambda spans, kept, kept_text: [F.coalesce(_left(F.col(text), kept_text), F.col(text)).alias(text)]
    return _with_removals(docs, found, text, names, make).select(*docs.columns)


def removed_spans(docs: DataFrame, *how: Repeats, also: Sequence[Repeats] = (), key: str = "doc_id", text: str = "text", families: Sequence[Family] = ()) -> DataFrame:
    """doc_id, n_bytes, spans (array of struct(begin, end), in bytes), kept_sha256 (of the bytes that are left, in one) and text (the
    same as text; characters that are removed in part stay) of every row. how: kinds of strings, BYTES if none is given; what
    repeats as a string of any kind is removed. also: kinds of strings that text alone goes without.

    Strings are judged on the input, in one document or across documents. Null and empty texts have no bytes; texts shorter than a
    string keep all of theirs, even copies. Repeated rows and null keys are kept, each with the values of its text. Other columns
    of docs are not read, whatever their names. An empty input has no rows. A text is in the memory of a task as a whole, with some
    forty bytes for each of its own.
    """
    found = removals(docs, how or (BYTES,), text, families, also)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    data = F.col("text").cast("binary")  # its bytes as they are, well formed or not

    def make(spans: Column, kept: Column, kept_text: Column) -> list[Column]:
        # as hexadecimal digits, bytes of all stretches are joined at once
        bytes_left = F.unhex(F.array_join(F.transform(kept, lambda s: F.hex(F.substring(data, (s.begin + 1).cast("int"), (s.end - s.begin).cast("int")))), ""))
        digest = F.when(kept.isNull(), F.sha2("text", 256)).otherwise(F.sha2(bytes_left, 256))
        return [F.coalesce(spans, F.array().cast(_SPANS)).alias("spans"), digest.alias("kept_sha256"), F.coalesce(_left(F.col("text"), kept_text), F.col("text")).alias("text")]

    return _with_removals(rows, found, "text", ["doc_id", "n_bytes"], make)
