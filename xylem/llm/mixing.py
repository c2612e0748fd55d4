"""Mixing of documents to target weights of domains, by soft membership.

A classifier of labelled rows gives every document a posterior over the domains. With n_i tokens and posterior p_i, document i at
rate r_i adds r_i n_i p_i to the domains' expected token totals. The rates, between bounds, are fitted by least squares of totals
against targets, scaled by the inverse of the posteriors' second moments, and of all such rates the closest to 1 are taken.

They are found by distributed projected gradient with lazy projection: the steps against the gradient add up to one vector with a
number for each domain, and a document's rate is the projection onto its bounds of 1 less the product of posterior and vector. A
step is the gradient (totals less targets) scaled by the inverse moments of the documents that no bound holds, Newton's scaling; a
pass tries the step and its halves at once and brings back small sums, and a weight on the distance to rate 1 falls until it no
longer counts. Plain projection after every step needs hundreds of passes where a target is 0 and many documents are at the bound.
Rates are never stored, so tasks can be run again.

The classifier is multinomial logistic regression on the presence of words, hashed into buckets, that tell the domains apart. It is
fitted on a bounded sample of labelled rows, those with the least hashes; everything else covers all documents.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import LOWER, Cache, Staging, text_key

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Mixing:
    """labelled_rows: bound of the sample that the classifier is fitted on. buckets: of the word hash. features: that are kept.
    z: from which a bucket tells domains apart. most: bound of the rates. anchored: lower bound of the rates of documents whose
    likeliest domain is the anchor. steps: of the gradient for each weight. tolerance: of totals and of the gradient, as a share of all tokens."""

    labelled_rows: int = 6000
    buckets: int = 1 << 16
    features: int = 4096
    z: float = 4.0
    most: float = 4.0
    anchored: float = 0.0
    steps: int = 25
    tolerance: float = 1e-4
    seed: int = 10


_BUCKETS: dict[int, Cache] = {}


def word_buckets(text: str | None, buckets: int) -> np.ndarray:
    """Distinct buckets of the words of a text, in order; A-Z count as a-z, and marks that end a word do not
    count. Two buckets stand for the text's length, in powers of
    two, and for the share of its words that are distinct, in tenths."""
    if buckets not in _BUCKETS:
        _BUCKETS[buckets] = Cache(lambda w: xxhash.xxh64_intdigest(w.rstrip(b".,;:!?")) % buckets)
    of, found = _BUCKETS[buckets], text.encode().translate(LOWER).split() if text else []
    if not found:
        return np.empty(0, np.int64)
    shape = [b"\0words %d" % len(found).bit_length(), b"\0distinct %d" % (10 * len(set(found)) // len(found))]
    return np.unique(np.fromiter(map(of.__getitem__, (*found, *shape)), np.int64, len(found) + 2))


class Classifier:
    """Softmax regression on the presence of chosen buckets."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: np.ndarray, buckets: int):
        self.place = np.full(buckets, -1, np.int64)
        self.place[chosen] = np.arange(len(chosen))
        self.weights, self.bias, self.buckets = weights, bias, buckets

    def posteriors(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        logits = np.tile(self.bias, (len(rows), 1))
        for i, row in enumerate(rows):
            places = self.place[row]
            logits[i] += self.weights[places[places >= 0]].sum(axis=0)
        return softmax(logits)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, domains: int, how: Mixing, rounds: int = 300, penalty: float = 0.01) -> Classifier:
    """rows: distinct buckets of each labelled document. Domains without rows keep a small prior."""
    n = len(rows)
    lengths = np.array([len(r) for r in rows], np.int64)
    flat, of = np.concatenate([*rows, np.empty(0, np.int64)]), np.repeat(np.arange(n), lengths)
    seen = np.stack([np.bincount(flat[labels[of] == d], minlength=how.buckets) for d in range(domains)]).astype(float)
    size = np.bincount(labels, minlength=domains).astype(float)
    strength = np.zeros(how.buckets)
    for d in range(domains):
        rest = n - size[d]
        if size[d] and rest:
            p = seen.sum(0) / n
            spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / size[d] + 1 / rest))
            strength = np.maximum(strength, np.abs(seen[d] / size[d] - (seen.sum(0) - seen[d]) / rest) / spread)
    chosen = np.argsort(-strength, kind="stable")[: how.features]
    chosen = np.sort(chosen[strength[chosen] >= how.z])
    bias = np.log((size + 1) / (n + domains))
    model = Classifier(chosen, np.zeros((len(chosen), domains)), bias, how.buckets)
    if not n or not len(chosen):
        return model
    place = model.place[flat]
    at, of = place[place >= 0], of[place >= 0]
    target = np.eye(domains)[labels]
    first, second = [np.zeros_like(model.weights), np.zeros(domains)], [np.zeros_like(model.weights), np.zeros(domains)]
    for t in range(1, rounds + 1):
        logits = np.stack([np.bincount(of, model.weights[at, d], n) for d in range(domains)], 1) + model.bias
        error = (softmax(logits) - target) / n
        slope = [np.stack([np.bincount(at, error[of, d], len(chosen)) for d in range(domains)], 1) + penalty / n * model.weights, error.sum(0)]
        for i, value in enumerate((model.weights, model.bias)):
            first[i] = 0.9 * first[i] + 0.1 * slope[i]
            second[i] = 0.999 * second[i] + 0.001 * slope[i] ** 2
            value -= 0.05 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-10)
    return model


def train(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], how: Mixing, key: str, text: str) -> Classifier:
    """labelled: key and domain. The sample has how.labelled_rows rows at most, so what reaches the driver is bounded."""
    chosen = labelled.select(F.col(key).alias("__key"), "domain").filter(F.col("domain").isin(*domains) & F.col("__key").isNotNull()).dropDuplicates(["__key"])
    chosen = chosen.orderBy(F.xxhash64("__key", F.lit(how.seed)), "__key").limit(how.labelled_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [word_buckets(t.as_py(), how.buckets).astype(np.int32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["key", "domain", "row"])

    sample = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key").select(F.col("__key").cast("long"), "text", "domain")
    rows = sorted(sample.mapInArrow(run, "key long, domain string, row binary").dropDuplicates(["key"]).collect(), key=lambda r: r.key)
    return fit([np.frombuffer(r.row, np.int32).astype(np.int64) for r in rows], np.array([list(domains).index(r.domain) for r in rows], np.int64), len(domains), how)


def posteriors(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), n_tokens (words) and posterior (array of double) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [word_buckets(t, shared.value.buckets) for t in texts]
            counts = [len(t.encode().split()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(list(shared.value.posteriors(rows)), pa.list_(pa.float64()))], ["doc_id", "digest", "n_tokens", "posterior"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("digest"))
    return narrow.mapInArrow(run, "doc_id long, digest binary, n_tokens long, posterior array<double>")


def rates_of(p: np.ndarray, steps: Sequence[np.ndarray], how: Mixing, anchor: int) -> np.ndarray:
    """Rates after the given steps; each is projected onto the bounds."""
    rates, low = np.ones(len(p)), np.where(p.argmax(axis=1) == anchor, how.anchored, 0.0) if len(p) else np.zeros(0)
    for step in steps:
        rates = np.clip(rates - p @ step, low, how.most)
    return rates


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


#: Weights on the distance to rate 1, one after the other, and how many halves of a step a pass tries.
WEIGHTS_OF_ONE, HALVES = (1e-2, 1e-4, 1e-6), 10


def descend(members: DataFrame, width: int, targets, how: Mixing, anchor: int = 0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The vector of the rates as one step from rate 1, the totals that it reaches, and the targets. targets: from totals at rate 1
    to those wanted."""
    size = width + width * width + 1

    def sums(vectors: np.ndarray):
        """Totals, second moments of the documents not at a bound, and sums of the dual, for each vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(vectors), size))
            for batch in batches:
                n, p = batch.column(0).to_numpy(zero_copy_only=False).astype(float), _matrix(batch.column(1), width)
                low = np.where(p.argmax(axis=1) == anchor, how.anchored, 0.0) if len(p) else np.zeros(0)
                for one, vector in zip(found, vectors, strict=True):
                    shift, rates = p @ vector, rates_of(p, [vector], how, anchor)
                    free = n * ((1 - shift >= low) & (1 - shift <= how.most))
                    one[:width] += (rates * n) @ p
                    one[width:-1] += ((p * free[:, None]).T @ p).ravel()
                    one[-1] += n @ ((rates - 1) ** 2 / 2 + shift * rates)
            yield pa.RecordBatch.from_arrays([pa.array(range(found.size), pa.int32()), pa.array(found.ravel())], ["place", "value"])

        # a task's share is summed by place; places are few
        rows = members.select("n_tokens", "posterior").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        values = np.zeros(len(vectors) * size)
        for r in rows:
            values[r.place] = r.value
        values = values.reshape(len(vectors), size)
        return values[:, :width], values[:, width:-1].reshape(-1, width, width), values[:, -1]

    at = np.zeros(width)
    (totals, *_), (moment, *_), _ = sums(at[None])
    wanted = np.asarray(targets(totals), float)
    base = moment + 1e-9 * max(np.trace(moment), 1.0) * np.eye(width)
    limit, free, missed = how.tolerance * max(wanted.sum(), 1.0), moment, False
    for weight in WEIGHTS_OF_ONE:
        for _ in range(how.steps):
            slope = totals - wanted - weight * base @ at
            if missed := np.abs(slope).max() > limit:
                step = np.linalg.solve(free + weight * base, slope)
                tried = at + step * 0.5 ** np.arange(HALVES)[:, None]
                found, moments, duals = sums(tried)
                best = int(np.argmax(duals - tried @ wanted - weight / 2 * np.einsum("ij,jk,ik->i", tried, base, tried)))
                at, totals, free = tried[best], found[best], moments[best]
            else:
                break
    report = "the rates bring totals to %s; wanted are %s"
    logger.log(logging.WARNING if missed else logging.INFO, ("not converged: " if missed else "") + report, totals.tolist(), wanted.tolist())
    return [at], totals, wanted


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str, how: Mixing = Mixing(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), n_tokens, posterior, rate and copies of every row.

    labelled: doc_id and domain. weights: target share of tokens of each domain; the anchor domain's expected total stays and the
    others' follow from the weights. copies: the whole part of the rate, and one more if the hash of id and text, seen as a number
    from 0 to 1, is below the rest; so expected counts are the rates and a document is treated alike in each run.

    Null and blank texts have no tokens and the posterior of no words. Null keys are never labelled; repeated rows are repeated.
    Rows whose domain has no weight are not labels. Without labels all posteriors are equal. Other columns of docs are not read,
    whatever their names. An empty input has no rows. A very long text's words are in the memory of a task as a whole.
    """
    domains = sorted(weights)
    model = train(docs, labelled, domains, how, key, text)
    members = Staging(docs.sparkSession, "mixing").save(posteriors(docs, model, key, text), "members", batch_rows=1000)
    at = domains.index(anchor)
    steps, _, _ = descend(members, len(domains), lambda totals: [weights[d] / weights[anchor] * totals[at] for d in domains], how, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = rates_of(_matrix(batch.column(3), len(domains)), steps, how, at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates)], ["doc_id", "digest", "n_tokens", "posterior", "rate"])

    rated = members.mapInArrow(run, "doc_id long, digest binary, n_tokens long, posterior array<double>, rate double")
    chance = F.pmod(F.xxhash64(F.lit(how.seed), "doc_id", "digest"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def domains_of(labels: DataFrame) -> DataFrame:
    """The three domains of labels with quality and toxic: toxic, and else clean or low by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low").alias("domain"))


#: Target shares of tokens of the registered query and of the pipeline.
WEIGHTS = {"clean": 0.97, "low": 0.03, "toxic": 0.0}
