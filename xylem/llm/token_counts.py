"""Token counts by a unigram model, without building the tokens.

An Aho-Corasick automaton over the vocabulary yields all matches that end at each character, and dynamic programming over the
ends carries two numbers only: the best score and how many pieces reach it. Ties follow the rule of unigram tokenizers: starts are
visited from left to right and a later one must score strictly more, so of equal paths the one with the longest last piece stays.
Characters that no one-character piece covers count as unknown at the least score less ``UNKNOWN_PENALTY``; neighbouring unknown
characters are one piece.

Words are counted on their own, each with the word mark before it, as with a splitting metaspace pre-tokenizer. The job is one
narrow pass: no shuffle, and memory is the automaton plus a bounded cache of word counts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import Cache, byte_words

#: Fixed values of unigram tokenizers: the mark at the start of a word, and what an unknown character costs below the least score.
MARK = "▁"
UNKNOWN_PENALTY = 10.0

Vocabulary = list[tuple[str, float]]


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a unigram vocabulary: the JSON of a tokenizer whose model is Unigram, or a sentencepiece model, without
    control, unknown and byte pieces.

    A sentencepiece model of merges has no scores of a unigram model, but ranks its pieces (scores -0, -1, ...). Its ranks become log
    probabilities of Zipf's law, log(1 / (rank + 2)), so that sums of scores weigh pieces as a unigram model does. Pieces that the model keeps for its user's own symbols are left out.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type") != "Unigram":
            raise ValueError("the tokenizer's model is not Unigram")
        return [(piece, score) for piece, score in model["vocab"]]

    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and model.get_score(i) > -1e8]
    scores = [model.get_score(i) for i in ids]
    ranked = all(s == int(s) for s in scores)
    return [(model.id_to_piece(i), -math.log(2.0 - s) if ranked else s) for i, s in zip(ids, scores, strict=True)]


class Counter:
    """Counts pieces of strings under a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(self, text: str) -> int:
        n = len(text)
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        end, value = next(matches, (n, None))
        for i in range(n):
            score, count, by_unknown, single = float("-inf"), 0, False, False
            while end == i:  # from the longest match, which starts first, to the shortest
                length, worth = value
                start = i + 1 - length
                single |= length == 1
                if best[start] + worth > score:
                    score, count, by_unknown = best[start] + worth, pieces[start] + 1, False
                end, value = next(matches, (n, None))
            if not single and best[i] + self.unknown > score:
                score, count, by_unknown = best[i] + self.unknown, pieces[i] + (not unknown[i]), True
            best[i + 1], pieces[i + 1], unknown[i + 1] = score, count, by_unknown
        return pieces[n]


_counters: dict[str, Cache] = {}


def _counter(path: str) -> Cache:
    if path not in _counters:
        counter = Counter(read_vocabulary(path))
        _counters[path] = Cache(lambda w: counter.count(MARK + w.decode()))
    return _counters[path]


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every row, repeated rows and null keys included; null and blank texts have 0 of both.

    ``model`` is the path of a vocabulary at the executors; see read_vocabulary. A very long text's words are in the memory of a task
    as a whole, and a word is counted in one go. Other columns of docs are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counter(model)
        for batch in batches:
            words = [byte_words(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array([sum(map(of.__getitem__, w)) for w in words], pa.int64())], ["doc_id", "n_words", "n_tokens"]
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
