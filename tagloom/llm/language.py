"""Language identification by cross-parsing.

For every language a suffix automaton of some labelled text accepts exactly its substrings. A text is cut greedily into
the longest phrases each automaton accepts; the language that needs the fewest phrases for it wins. Texts are parsed in
blocks, all blocks of a batch side by side, so that a step of numpy moves many automata by one byte.

The automata of up to ``LANGUAGES`` languages are sent to the workers at once. With more languages the texts are parsed
once for each block of them, and the phrase counts of a text are brought together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, held_out, pieces, saved

UNKNOWN = "und"
#: Languages that are held in memory together; an automaton of 16 KB of text takes some 10 MB.
LANGUAGES = 16


class SuffixAutomaton:
    """States of all substrings of a text over small integer symbols; 0 means that no substring goes on like that."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            state = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = state
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state
        self.table = np.zeros((len(moves), n_symbols), np.int32)
        for state, out in enumerate(moves):
            for c, to in out.items():
                self.table[state, c] = to

    def phrases(self, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of greedy phrases of every row of ``blocks`` (symbols; rows sorted by falling length)."""
        n = len(blocks)
        state, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        flat, width = self.table.ravel(), self.table.shape[1]
        alive = np.searchsorted(-lengths, -np.arange(1, blocks.shape[1] + 1), "right")
        steps = np.ascontiguousarray(blocks.T)
        for i, m in enumerate(alive.tolist()):
            if not m:
                break
            symbols = steps[i, :m]
            to = flat[state[:m] * width + symbols]
            stuck = np.flatnonzero(to == 0)
            if len(stuck):
                # The phrase ends here; the next one starts with this byte. A byte the language never has is a phrase.
                again = flat[symbols[stuck]]
                count[stuck] += (state[stuck] > 0).astype(np.int64) + (again == 0)
                to[stuck] = again
            state[:m] = to
        return count + (state > 0)


@dataclass
class Model:
    languages: list[str]
    automata: list[SuffixAutomaton]
    code: np.ndarray  # byte -> symbol; 0 for bytes that no training text has
    block: int = 1024

    def predict(self, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """Number of the winning language (ties: the first) and its score, for every text."""
        phrases = self.phrases(data, offsets, step)
        best = phrases.argmin(axis=1)
        # Needed phrases per byte are a cross-entropy rate; the score compares the winner's with the others'.
        share = (phrases.min(axis=1)[:, None] + 1) / (phrases + 1)
        return best, 1 / (share**4).sum(axis=1)

    def phrases(self, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 21) -> np.ndarray:
        """Number of phrases of every text (rows) for every language."""
        n = len(offsets) - 1
        phrases = np.zeros((n, len(self.languages)))
        for a, b in pieces(offsets, step):
            for begin in range(int(offsets[a]), int(offsets[b]), step):  # one long text takes several rounds
                end = min(begin + step, int(offsets[b]))
                self._add(phrases, data, offsets, begin, end)
        return phrases

    def _add(self, phrases: np.ndarray, data: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> None:
        rows = np.arange(np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, end, "left"))
        low, high = np.maximum(offsets[rows], begin), np.minimum(offsets[rows + 1], end)
        count = -(-(high - low) // self.block)
        owner = np.repeat(np.arange(len(rows)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        starts = low[owner] + number * self.block
        lengths = np.minimum(high[owner] - starts, self.block)
        order = np.argsort(-lengths, kind="stable")
        owner, starts, lengths = owner[order], starts[order], lengths[order]
        if not len(owner):
            return
        places = np.minimum(starts[:, None] + np.arange(lengths[0]), len(data) - 1)
        blocks = self.code[data[places]]
        for k, automaton in enumerate(self.automata):
            np.add.at(phrases[:, k], rows[owner], automaton.phrases(blocks, lengths))


def prepared(text: str) -> bytes:
    """Letters in lower case; everything between words is one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()


def fit(samples: dict[str, list[str]], sample_bytes: int = 1 << 14) -> Model:
    """One automaton per language, over at most ``sample_bytes`` bytes of its samples."""
    languages = sorted(samples)
    texts = {name: b" ".join(prepared(t) for t in samples[name])[:sample_bytes] for name in languages}
    used = sorted(set(b"".join(texts.values())))
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, len(used) + 1)
    return Model(languages, [SuffixAutomaton(code[np.frombuffer(texts[x], np.uint8)], len(used) + 1) for x in languages], code)


def learn(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", lang_name: str = "lang",
          fold: tuple[int, int] | None = (4, 2), sample: int = 64, sample_bytes: int = 1 << 14, block: int = LANGUAGES) -> list[Callable[[], Model]]:
    """Fit on at most ``sample`` documents per language, cut to 4,096 characters each, chosen by the hash of the id.

    Rows without an id, and those of the fold ``(modulus, remainder)``, are not learnt from. All other languages are
    learnt, ``block`` of them at a time, in the order of their names: each function returned fits one block.
    """
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), F.col(text_name).alias("text"),
                       F.col(lang_name).alias("lang")).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    if fold:
        rows = rows.filter(~held_out("doc_id", *fold))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    names = sorted(counts)
    whole = 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(whole))

    def fitted(block: list[str]) -> Model:
        # A share of each language that gives about the wanted number of documents; small languages are taken whole.
        take = F.create_map(*[F.lit(x) for name in block for x in (name, min(whole, 2 * sample * whole // counts[name]))])
        chosen = rows.filter(place < take[F.col("lang")]).select("lang", F.substring("text", 1, 4096).alias("text"), place.alias("place"), "doc_id")
        samples: dict[str, list] = {}
        for r in chosen.toLocalIterator():
            samples.setdefault(r.lang, []).append((r.place, r.doc_id, r.text))
        return fit({lang: [t for *_, t in sorted(found)[:sample]] for lang, found in samples.items()}, sample_bytes)

    return [partial(fitted, names[i:i + block]) for i in range(0, len(names), block)]


def identify(docs: DataFrame, fold: tuple[int, int] = (4, 2), id_name: str = "doc_id", text_name: str = "text",
             lang_name: str = "lang", **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if no language was learnt; ties go to
    the language that sorts first. The score is higher the more phrases the other languages need. Rows without an id are
    judged, but not learnt from; repeated rows are judged alike. An empty table gives an empty table.
    """
    models = learn(docs, id_name, text_name, lang_name, fold, **options)
    # Case and everything but letters goes before the parse, in the same way as in the samples.
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_name), F.lit(""))), r"[^\p{L}]+", " "))
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), clean.cast("binary").alias("text"))

    if len(models) > 1:
        return _by_blocks(rows, models).select("doc_id", held_out("doc_id", *fold).alias("held_out"), "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(models[0]() if models else Model([], [], np.zeros(256, np.int64)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            empty = (np.diff(offsets) == 0) | (not model.languages)
            best, score = model.predict(data, offsets) if model.languages else (np.zeros(len(empty), int), np.zeros(len(empty)))
            best[empty] = len(model.languages)
            score[empty] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out("doc_id", *fold).alias("held_out"), "lang_pred", "score")


def _by_blocks(rows: DataFrame, models: list[Callable[[], Model]]) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``doc_id, text``, one block of languages after the other.

    A row is known by its id and the hash of its text; rows equal in both are counted, and judged alike.
    """
    keyed = rows.withColumn("key", F.xxhash64("text"))
    found = None
    for number, fitted in enumerate(models):
        shared = rows.sparkSession.sparkContext.broadcast(fitted())
        if not shared.value.languages:
            continue

        def parse(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            model = shared.value
            names = np.array(model.languages, object)
            for batch in batches:
                offsets, data = buffers(batch.column("text"))
                phrases = model.phrases(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(offsets) == 0),
                     pa.array(np.full(len(phrases), number, np.int32)), pa.array(phrases.min(axis=1)),
                     pa.array(names[phrases.argmin(axis=1)], pa.string()), pa.array(((phrases + 1) ** -4).sum(axis=1))],
                    names=["doc_id", "key", "empty", "block", "phrases", "lang", "others"])

        part = saved(keyed.mapInArrow(parse, "doc_id long, key long, empty boolean, block int, phrases double, lang string, others double"),
                     "languages")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    once = found.groupBy("doc_id", "key", "block").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("empty", "phrases", "lang", "others")])
    best = once.groupBy("doc_id", "key").agg(
        F.max("n").alias("n"), F.first("empty").alias("empty"), F.sum("others").alias("others"),
        F.min(F.struct("phrases", "block", "lang")).alias("best"))
    score = 1 / (F.pow(F.col("best.phrases") + 1, F.lit(4)) * F.col("others"))
    return best.select(
        "doc_id", F.when(F.col("empty"), UNKNOWN).otherwise(F.col("best.lang")).alias("lang_pred"),
        F.when(F.col("empty"), 0.0).otherwise(score).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("col")
