"""A hidden Markov language model: Baum-Welch over all training documents, exact scaled forward scores.

Tokens are words (A-Z lower-cased) and one end per document. A state emits a class: the most frequent words are classes of
their own, all other words fall into classes by their last bytes. A word within such a class has the add-one smoothed share
of its training count, all unseen words of a class together one count; so the model gives every text a probability.

Counts cover the whole training part: they are summed in the workers, then by Spark. The classes grow with the vocabulary, up to
what two bytes can name. At most ``TOP`` frequent words are broadcast; counts of all others meet their occurrences in a
shuffled join, where no word is hot any more. Each Baum-Welch round sums the expected counts of its tasks by class in a
shuffle and brings the bounded matrices (classes times states) to the driver. Sequences of any length are trained on whole: a
long one is run through in blocks of steps, forward once to keep the variables at the block edges, then block by block backward.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.words import map_docs, raw, sliced
from lattice.plans.materialize import materialize

#: Latent states, words whose counts are broadcast, rounds.
STATES, TOP, ROUNDS = 8, 200_000, 5
#: Most bytes of a word whose count is broadcast.
LONGEST_TOP = 64
#: Words that are classes of their own, and classes of other words: least, distinct words a class, most.
OWN, RARE = (4096, 128, 49_152), (1024, 512, 12_288)
SUFFIX = 3
#: The end of a document among the words; no word has a space.
END = b" "
#: Bytes of forward variables held at once, distinct words counted at once.
HELD, COUNTED = 1 << 26, 1 << 18
#: Bytes of class sequences that are grouped by length at once; two bytes a token.
GROUPED = 1 << 24
SEED = 7


def rare_class(word: bytes, rare: int) -> int:
    return zlib.crc32(word[-SUFFIX:]) % rare


class _Count:
    """Words and their counts, in tables of about ``COUNTED`` words."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                counts.update(text.lower().split())
            counts[END] += batch.num_rows
            if len(counts) >= COUNTED:
                yield self.table(counts)
                counts = Counter()
        yield self.table(counts)

    def table(self, counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, c) over a table of one binary column; the end counts once a row."""
    return texts.mapInArrow(_Count(), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0")


@dataclass
class Lexicon:
    """What workers need to know of the vocabulary; its size is bounded by ``top`` and ``rare``."""

    rank: dict[bytes, int]
    klass: np.ndarray  # of the top words
    log_count: np.ndarray  # log10(c + 1) of the top words
    rare_log: np.ndarray  # log10 of the smoothed size of each rare class
    prior: np.ndarray  # smoothed training share of each class
    own: int
    rare: int
    total: int
    distinct: int

    @property
    def classes(self) -> int:
        return self.own + self.rare


def frequent(vocab: DataFrame, top: int) -> list[tuple[bytes, int]]:
    """At most ``top`` words with their counts, most frequent first, ties by word.

    A histogram of counts, 32 steps an octave and so under 2,048 rows, gives the least count whose words are few enough; only those
    leave the executors. Words of the step at the limit stay out together, and so do words above ``LONGEST_TOP`` bytes.
    """
    vocab = vocab.filter(F.length("word") <= LONGEST_TOP)
    step = F.floor(F.log2("c") * 32).cast("long")
    histogram = vocab.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    taken, least = 0, None
    for r in sorted(histogram, key=lambda r: -r["step"]):
        taken += r["n"]
        if taken > top:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in vocab.filter(step >= least).collect()), key=lambda x: (-x[1], x[0]))


def lexicon(vocab: DataFrame, own: int | None = None, rare: int | None = None, top: int = TOP) -> Lexicon:
    """From (word, c): totals, the ``top`` words and the sums of the rare classes; without a number the classes grow with the words."""
    total, distinct = (x or 0 for x in vocab.agg(F.sum("c"), F.count("*")).first())
    own, rare = (n or min(max(least, distinct // words), most) for n, (least, words, most) in ((own, OWN), (rare, RARE)))
    most = frequent(vocab, top)
    rank = {w: i for i, (w, _) in enumerate(most)}
    counts = [c for _, c in most]
    if END not in rank:
        rank[END] = len(rank)
        counts.append(vocab.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    counts = np.array(counts, np.int64)
    inside = [w for w in rank][: own - 1]
    inside += [END] * (END not in inside)
    klass = np.array([0] * len(rank), np.uint16)
    for w, i in rank.items():
        klass[i] = own + rare_class(w, rare)
    for k, w in enumerate(inside):
        klass[rank[w]] = k
    sizes = np.zeros((rare, 2), np.int64)
    suffix = F.pmod(F.crc32(F.expr(f"substring(word, -{SUFFIX}, {SUFFIX})")), F.lit(rare))
    for r in vocab.groupBy(suffix.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        sizes[r["k"]] = r["c"], r["v"]
    held = np.zeros(own, np.int64)
    for k, w in enumerate(inside):
        held[k] = counts[rank[w]]
        if counts[rank[w]]:
            sizes[rare_class(w, rare)] -= counts[rank[w]], 1
    prior = np.concatenate([held, sizes[:, 0]]) + 1.0
    return Lexicon(rank, klass, np.log10(counts + 1.0), np.log10(sizes.sum(axis=1) + 1.0), prior / prior.sum(), own, rare, int(total), int(distinct))


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_top long, base_log double, model_log double, codes binary, tail array<binary>, tail_n array<long>"


class Encode:
    """Texts to class sequences, with the sums over top words and the words outside them."""

    def __init__(self, known):
        self.known = known

    def __call__(self, row: int, doc: int | None, held_out: bool, text: bytes) -> tuple:
        lex: Lexicon = self.known.value
        words, get = text.lower().split(), lex.rank.get
        words.append(END)
        ranks = np.array([get(w, -1) for w in words], np.int64)
        klass, logs = lex.klass[ranks], lex.log_count[ranks]
        tail: Counter[bytes] = Counter()
        outside = np.flatnonzero(ranks < 0)
        if len(outside):
            logs[outside] = 0.0
            found = [words[i] for i in outside.tolist()]
            tail.update(found)
            klass[outside] = [lex.own + rare_class(w, lex.rare) for w in found]
        rare = klass >= lex.own
        model_log = float(logs[rare].sum() - lex.rare_log[klass[rare] - lex.own].sum())
        known = int((logs > 0).sum())
        return row, doc, held_out, len(words), known, float(logs.sum()), model_log, klass.astype(np.uint16).tobytes(), list(tail), list(tail.values())


@dataclass
class Model:
    """Start (S), transition (S, S) and emission (classes, S) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(prior: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    """A fixed pseudo-random start around the class shares, whose states persist.

    A text keeps its language and kind, so states that last tell texts apart from the first round on; from states that change with
    every word, five rounds stay at the unigram shares.
    """
    random = np.random.default_rng(seed)
    emit = prior[:, None] * np.exp(random.normal(0, 0.5, (len(prior), states)))
    move = np.eye(states) * 100 + random.random((states, states)) + 0.5
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _groups(sequences: list[np.ndarray], states: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Padded groups of bounded size, longest first: codes (T, B), how many are active at each step, their numbers."""
    order = sorted(range(len(sequences)), key=lambda i: (-len(sequences[i]), i))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        part = order[at : at + max(1, HELD // (16 * states * max(1, longest)))]
        codes = np.zeros((longest, len(part)), np.uint16)
        for b, i in enumerate(part):
            codes[: len(sequences[i]), b] = sequences[i]
        lengths = np.array([len(sequences[i]) for i in part])
        yield codes, np.searchsorted(-lengths, -np.arange(longest), "left"), np.array(part)
        at += len(part)


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each class sequence, by the scaled forward recursion.

    Arrays are states by sequences, so every operation runs along the sequences.
    """
    out, emit, back = np.zeros(len(sequences)), np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    for codes, active, numbers in _groups(sequences, 2):
        alpha = np.repeat(model.start[:, None], codes.shape[1], axis=1)
        log = np.zeros(codes.shape[1])
        for t, n in enumerate(active.tolist()):
            alpha = (back @ alpha[:, :n] if t else alpha[:, :n]) * emit.take(codes[t, :n], axis=1)
            scale = alpha.sum(axis=0)
            alpha /= scale
            log[:n] += np.log(scale)
        out[numbers] = log
    return out


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch expected counts of starts (S), transitions (S, S) and emissions (classes, S), of whole sequences."""
    states, classes = len(model.start), len(model.emit)
    start, move, counts = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    emit, back = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)

    def step(before: np.ndarray | None, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha = (model.start[:, None] if before is None else back @ before[:, : seen.shape[1]]) * seen
        scale = alpha.sum(axis=0)
        alpha /= scale
        return alpha, scale

    for codes, active, _ in _groups(sequences, states):
        steps, n0 = codes.shape
        active, block = active.tolist(), max(1, HELD // (16 * states * n0))
        edges = [*range(0, steps, block), steps]
        entry: list[np.ndarray | None] = [None]  # the forward variables before each block
        for first, end in list(pairwise(edges))[:-1]:
            alpha = entry[-1]
            for t in range(first, end):
                alpha, _ = step(alpha, emit.take(codes[t, : active[t]], axis=1))
            entry.append(alpha)
        beta = np.ones((states, n0))
        for first, end in reversed(list(pairwise(edges))):
            alpha = before = entry.pop()
            at = np.concatenate([[0], np.cumsum(active[first:end])]).tolist()
            flat = np.concatenate([codes[t, : active[t]] for t in range(first, end)])
            alphas, ratios = np.empty((states, at[-1])), emit.take(flat, axis=1)  # steps side by side, active ones only
            for a, b in pairwise(at):
                alpha, scale = step(alpha, ratios[:, a:b])
                alphas[:, a:b] = alpha
                ratios[:, a:b] /= scale
            for t in range(end - 1, first - 1, -1):
                n, own = active[t], slice(at[t - first], at[t - first + 1])
                ahead = ratios[:, own] * beta[:, :n]
                alphas[:, own] *= beta[:, :n]  # now the chances of the states
                if t == 0:
                    start += alphas[:, own].sum(axis=1)
                    break
                last = before if t == first else alphas[:, at[t - first - 1] : at[t - first]]
                move += last[:, :n] @ ahead.T
                beta[:, :n] = model.move @ ahead
            for s in range(states):
                counts[s] += np.bincount(flat, weights=alphas[s], minlength=classes)
    return start, move * model.move, counts.T.copy()


def _sequences(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in batch.column(column).to_pylist()]


class _Expect:
    """Rows (key, s0, s1, ...): class k of the emissions, -1 the start, -2 - s the transitions from s."""

    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = self.model.value, None
        for batch in sliced(batches, GROUPED):
            found = expected_counts(model, _sequences(batch, 0))
            total = found if total is None else tuple(a + b for a, b in zip(total, found, strict=True))
        if total is not None:
            start, move, emit = total
            used = np.flatnonzero(emit.any(axis=1))
            keys = np.concatenate([[-1], -2 - np.arange(len(start)), used])
            rows = np.concatenate([start[None], move, emit[used]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(np.ascontiguousarray(rows[:, s])) for s in range(len(start)))], ["key", *(f"s{s}" for s in range(len(start)))])


def train(codes: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over a table of one column, codes; every round reads all of it."""
    sc, model = codes.sparkSession.sparkContext, first_model(lex.prior, states)
    columns = [f"s{s}" for s in range(states)]
    for _ in range(rounds):
        sent = sc.broadcast(model)
        summed = codes.mapInArrow(_Expect(sent), ", ".join(["key long", *(f"{c} double" for c in columns)])).groupBy("key").agg(*(F.sum(c).alias(c) for c in columns))
        rows = {r["key"]: np.array([r[c] for c in columns]) for r in summed.collect()}
        sent.destroy()
        if not rows:
            break
        start = rows.get(-1, 0) + np.ones(states)
        move = np.array([rows.get(-2 - s, np.zeros(states)) for s in range(states)]) + 1.0
        emit = lex.prior[:, None] * np.ones(states)  # a prior of one token's weight
        for k, row in rows.items():
            if k >= 0:
                emit[k] += row
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


class _Forward:
    """(row, log10 probability of the class sequence), all of a batch at once."""

    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, GROUPED):
            logs = log_likelihoods(self.model.value, _sequences(batch, batch.num_columns - 1)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logs)], [*batch.schema.names[:-1], "forward"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, own: int | None = None, rare: int | None = None, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of ``docs``.

    held_out: crc32 of the id as text has remainder 2 by 7; these rows aren't learned from. n_known counts tokens seen in training.
    base_score is the add-one unigram log10 probability, score the hidden Markov model's. A null or empty text is the end
    alone; very long ones are learned from and scored whole. A null id counts as the empty text and is learned from. Repeated rows are
    learned from each time. Other columns are ignored; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    doc = F.col(id_col).cast("long")
    held_out = F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 7 == 2
    vocab = materialize(vocabulary(docs.filter(~held_out).select(raw(text_col).alias("text"))))
    lex = lexicon(vocab, own, rare, top)
    known = sc.broadcast(lex)
    encoded = materialize(map_docs(docs, [F.monotonically_increasing_id(), doc, held_out, raw(text_col)], ENCODED, Encode(known)))
    model = sc.broadcast(train(encoded.filter(~F.col("held_out")).select("codes"), lex, states, rounds))
    fields = [x.split()[0] for x in ENCODED.split(", ")][:-2]
    kinds = ", ".join(ENCODED.split(", ")[:-3])
    scored = encoded.select(*fields).mapInArrow(_Forward(model), f"{kinds}, forward double")
    tail = encoded.select("row", F.inline(F.arrays_zip(F.col("tail").alias("word"), F.col("tail_n").alias("n")))).join(vocab, "word")
    tail = tail.groupBy("row").agg(F.sum("n").alias("n_tail"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_log"))
    joined = scored.join(tail, "row", "left").withColumn("tail_log", F.coalesce("tail_log", F.lit(0.0)))
    base = F.col("base_log") + F.col("tail_log") - F.col("n_tokens") * F.lit(float(np.log10(lex.total + lex.distinct + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_tail", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("forward") + F.col("model_log") + F.col("tail_log")).alias("score"),
    )
