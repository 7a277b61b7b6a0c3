"""Subject areas of subtitles by subject-specific language models.

Each subject, the background, and what nobody says (adverts, credits) has an interpolated n-gram model of the characters of
its words (Witten-Bell weights, up to ORDER - 1 characters of context; under the last one lies the background's, so that words
that nobody has seen before are as likely in both). A word's evidence for a subject is how much lower its
cross-entropy is under the subject's model than under the background's. A text's cues are shared out between the classes by
the evidence of their words and by how much of the text each holds, and a subject whose cues make up the subject's calibrated
share of the spoken ones is accepted; none, one or several can be. The models are fitted to a bounded sample of labelled texts,
the cues of each shared out between the background, the unspoken and its labels in the same way, so that labels of whole texts
suffice and wrong ones wash out. What is unspoken is learnt from the cues with a web or mail address, and from there to cues
that share their words: no list of phrases is given.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import cues
from tidewire.llm.tokens import spread

TRAIN_TEXTS = 8000  # at most so many labelled texts, those of the lowest hash, are fitted to
HELD_OUT = 5  # one in so many of them calibrates the acceptance
TRAIN_CHARS = 40_000  # a labelled text longer than this does not take part in the fit; it is classified as any other
ORDER = 5
ROUNDS = 8
STRAY = 0.0005  # a training text's prior of a subject it isn't labelled with
CACHE_WORDS = 300_000
MARGIN = 0.7  # nats by which a word must tell a subject from the others
DOUBT = 2.0  # nats by which a cue must speak for another class than the background
SHARES = np.arange(0.12, 0.3, 0.005)  # acceptance shares tried in calibration
USUAL_SHARE = 0.2  # where no text can calibrate one
POOLED = 30  # held-out texts of a subject that tell as much of its share as those of all subjects together


def _grams(word: str) -> list[list[str]]:
    """For each character of the word and its end, the n-grams that end there, the shortest first."""
    w = f"\x02{word}\x03"
    return [[w[max(i - k, 0) : i + 1] for k in range(min(i, ORDER - 1) + 1)] for i in range(1, len(w))]


@dataclass
class Models:
    """counts: n-gram -> row of weights by class (0 is the background, then the subjects, the last is the unspoken); context:
    its beginnings' weights and kinds."""

    subjects: list[str]
    gram: dict[str, int]
    weight: np.ndarray  # n-grams x classes
    total: np.ndarray  # contexts x classes
    kinds: np.ndarray
    context: dict[str, int]
    share: np.ndarray | None = None  # of each subject, from which on it is accepted
    live: np.ndarray | None = None  # 1 for the classes that have a labelled text

    def word(self, word: str) -> np.ndarray:
        """Log likelihood by class."""
        n = self.weight.shape[1]
        out = np.zeros(n)
        for ends in _grams(word):
            p, q = np.full(n, 1 / 400), []
            for g in ends:
                c = self.context.get(g[:-1])
                if c is None:
                    break
                i = self.gram.get(g)
                w = self.weight[i] if i is not None else np.zeros(n)
                p = (w + self.kinds[c] * p) / (self.total[c] + self.kinds[c])
                q.append((w[-1], self.kinds[c, -1], self.total[c, -1]))
            last = p[0]
            for w, k, t in q:
                last = (w + k * last) / (t + k)
            p[-1] = last
            out += np.log(p)
        return out


class Vocabulary:
    """The n-grams of a set of words, indexed once for all rounds of a fit."""

    def __init__(self, words: Sequence[str]):
        self.words = len(words)
        self.gram: dict[str, int] = {}
        self.context: dict[str, int] = {}
        of, owner, paths = [], [], []
        for k, w in enumerate(words):
            for ends in _grams(w):
                path = []
                for g in ends:
                    i = self.gram.setdefault(g, len(self.gram))
                    if i == len(of):
                        of.append(self.context.setdefault(g[:-1], len(self.context)))
                    path.append(i)
                owner.append(k)
                paths.append(path + [-1] * (ORDER - len(path)))
        self.of, self.owner = np.array(of, np.int64), np.array(owner, np.int64)
        self.paths = np.array(paths, np.int64).reshape(-1, ORDER)

    def fit(self, weights: np.ndarray, subjects: Sequence[str]) -> tuple[Models, np.ndarray]:
        """Models from weighted words (words x classes), and the words' log likelihoods under them."""
        n = weights.shape[1]
        weight, total, kinds = np.zeros((len(self.gram), n)), np.zeros((len(self.context), n)), np.zeros((len(self.context), n))
        for d in range(ORDER):
            live = self.paths[:, d] >= 0
            np.add.at(weight, self.paths[live, d], weights[self.owner[live]])
        np.add.at(total, self.of, weight)
        np.add.at(kinds, self.of, np.minimum(weight, 1.0))
        kinds = np.maximum(kinds, 0.5)
        prob = np.full((len(self.paths), n), 1 / 400)
        for own in (slice(0, n - 1), slice(n - 1, n)):
            for d in range(ORDER):
                live = self.paths[:, d] >= 0
                i = self.paths[live, d]
                c = self.of[i]
                prob[live, own] = (weight[i, own] + kinds[c, own] * prob[live, own]) / (total[c, own] + kinds[c, own])
            prob[:, -1:] = prob[:, :1] if own.stop < n else prob[:, -1:]  # the unspoken falls back on the background
        score = np.zeros((self.words, n))
        np.add.at(score, self.owner, np.log(prob))
        return Models(list(subjects), self.gram, weight, total, kinds, self.context), score


def _clipped(d: np.ndarray) -> np.ndarray:
    return np.sign(d) * np.maximum(np.abs(d) - MARGIN, 0)


def evidence(score: np.ndarray) -> np.ndarray:
    """Words' log likelihoods with small differences taken out, of the background and the subjects from the subjects' mean and
    of the unspoken from the background: a word that all use alike, but for the chance of which texts were labelled, tells
    none of them, however often it recurs in a cue."""
    mean = score[:, 1:-1].mean(1, keepdims=True)
    near = mean + _clipped(score[:, :-1] - mean)
    mixed = np.logaddexp(score[:, -1:], score[:, :1]) - np.log(2)  # an advert also has ordinary words
    return np.hstack([near, near[:, :1] + _clipped(mixed - score[:, :1])])


def shared_out(score: np.ndarray, text: np.ndarray, n: int, allowed: np.ndarray | None = None, rounds: int = ROUNDS, doubt: float = 0.0) -> np.ndarray:
    """Cues x classes: how much of each cue belongs to each class. score: log likelihoods; text: each cue's text, 0 .. n-1;
    allowed: texts x classes, how far a class can hold cues of the text."""
    classes = score.shape[1]
    prior = np.full((n, classes), 0.5 / max(classes - 1, 1))
    prior[:, 0] = 0.5
    if allowed is not None:
        prior *= allowed
    count = np.maximum(np.bincount(text, minlength=n), 1)[:, None]
    top = score + np.eye(classes)[0] * doubt - np.eye(classes)[-1] * DOUBT
    top -= top.max(1, keepdims=True)
    like = np.exp(np.maximum(top, -60))
    for _ in range(rounds):
        r = like * prior[text]
        r /= r.sum(1, keepdims=True)
        prior = (_grouped(r, text, n) + 0.02) / (count + 0.02 * classes)
        if allowed is not None:
            prior = np.maximum(prior * allowed, 1e-9)
    return r


class _Cues(dict):
    """Words of cues seen before, None of those without any; starts anew when it is full."""

    def __missing__(self, cue: str) -> tuple[str, ...] | None:
        if len(self) >= CACHE_WORDS:
            self.clear()
        w = cues.speech(cue)
        out = None if w is None else tuple(w)
        if len(cue) <= 300:
            self[cue] = out
        return out


_SPOKEN = _Cues()


def _cues_of(text: str | None) -> list[tuple[str, ...]]:
    """The words of each cue that has any."""
    return [w for c in cues.split_cues(cues.repaired(text)) if (w := _SPOKEN[c.strip()]) is not None] if text else []


def _grouped(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each owner."""
    return np.stack([np.bincount(owner, rows[:, j], n) for j in range(rows.shape[1])], 1)


def _sums(score: np.ndarray, spoken: list[list[int]]) -> np.ndarray:
    """Cue scores: sums over the cue's words."""
    if not spoken:
        return np.zeros((0, score.shape[1]))
    flat = np.fromiter((i for c in spoken for i in c), np.int64)
    owner = np.repeat(np.arange(len(spoken)), [len(c) for c in spoken])
    return _grouped(score[flat], owner, len(spoken))


def text_shares(score: np.ndarray, text: np.ndarray, n: int, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Texts x subjects: the share of the spoken cues that each subject holds; one without labelled texts (live 0) holds none.
    And the spoken cues of each text: all but what the unspoken holds."""
    if not len(score):
        return np.zeros((n, score.shape[1] - 2)), np.zeros(n)
    total = _grouped(shared_out(score, text, n, None if live is None else np.broadcast_to(live, (n, len(live))), doubt=DOUBT), text, n)
    spoken = total[:, :-1].sum(1)
    return total[:, 1:-1] / np.maximum(spoken, 0.5)[:, None], spoken


def _f1(share: np.ndarray, true: np.ndarray) -> np.ndarray:
    return np.array([2 * ((share >= s) & true).sum() / max((share >= s).sum() + true.sum(), 1) for s in SHARES])


def acceptance(share: np.ndarray, true: np.ndarray) -> np.ndarray:
    """For each subject the share from which on its texts are accepted: the middle of those of the best F1 among SHARES, where
    the F1 of all subjects together counts as much as POOLED of the subject's own texts. share, true: texts x subjects."""
    if not true.any():
        return np.full(share.shape[1], USUAL_SHARE)
    every, out = _f1(share, true), []
    for j in range(share.shape[1]):
        n = true[:, j].sum()
        f1 = (n * _f1(share[:, j], true[:, j]) + POOLED * every) / (n + POOLED)
        best = np.flatnonzero(f1 >= f1.max() - 1e-9)
        out.append(SHARES[best[len(best) // 2]])
    return np.array(out)


def train(texts: Sequence[str | None], labels: Sequence[set[str]], subjects: Sequence[str]) -> Models:
    """labels: the subjects of each text. Every HELD_OUT-th text is kept from the fit and sets the subjects' acceptance
    shares."""
    number = {s: i + 1 for i, s in enumerate(subjects)}
    classes = len(subjects) + 2
    word: dict[str, int] = defaultdict(lambda: len(word))
    spoken, owner = [], []
    for k, t in enumerate(texts):
        for c in _cues_of(t):
            spoken.append([word[w] for w in c])
            owner.append(k)
    address = word.get(cues.ADDRESS, -1)
    words, owner = list(word), np.array(owner, np.int64)
    vocabulary = Vocabulary(words)
    live = np.zeros(classes)
    live[0] = 1
    live[sorted({number[s] for ls in labels for s in ls if s in number})] = 1
    live[-1] = address >= 0
    allowed = np.full((len(texts), classes), STRAY)
    allowed[:, 0], allowed[:, -1] = 1, live[-1]
    for k, ls in enumerate(labels):
        allowed[k, [number[s] for s in ls if s in number]] = 1
    fit = np.flatnonzero(owner % HELD_OUT > 0)
    flat = np.fromiter((i for c in fit for i in spoken[c]), np.int64)
    cue = np.repeat(np.arange(len(fit)), [len(spoken[c]) for c in fit])
    known = np.array([address in spoken[c] for c in fit], bool) if address >= 0 else np.zeros(len(fit), bool)
    # to begin with, all cues of a text belong to its labels and to the background alike, those with an address are unspoken
    part = np.where(allowed == 1, 1.0, STRAY)[owner[fit]]
    part[:, -1] = STRAY * live[-1]
    for _ in range(ROUNDS):
        part[known] = np.eye(classes)[-1]
        part /= part.sum(1, keepdims=True)
        weights = np.zeros((len(words), classes))
        np.add.at(weights, flat, part[cue])
        models, score = vocabulary.fit(weights, subjects)
        score = evidence(score)
        sums = _sums(score, [spoken[c] for c in fit])
        part = shared_out(sums, owner[fit], len(texts), allowed, 3) if len(fit) else part
    models.live, models.share = live, np.full(len(subjects), USUAL_SHARE)
    held = np.flatnonzero(owner % HELD_OUT == 0)
    if len(held):
        got, _ = text_shares(_sums(score, [spoken[c] for c in held]), owner[held], len(texts), live)
        asked = np.arange(len(texts)) % HELD_OUT == 0
        got, true = got[asked], allowed[asked][:, 1:-1] == 1
        models.share = acceptance(got, true)
    return models


def fitted(docs: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text") -> Models:
    """Models from the labelled texts (labels: key, subject; compared without case and surrounding blanks; null or unknown
    subjects are no label). At most TRAIN_TEXTS texts, those whose keys have the lowest hashes; the sample, and no more, comes to the
    driver. areas: the subjects, in the order of subject_id."""
    subjects = [r.subject.strip().lower() for r in areas.where("subject is not null").orderBy("subject_id", "subject").select("subject").collect()]
    subjects = list(dict.fromkeys(subjects))
    l = labels.where(F.col(key).isNotNull() & F.col("subject").isNotNull()).groupBy(key).agg(F.collect_set(F.lower(F.trim("subject"))).alias("__labels"))
    l = l.orderBy(F.xxhash64(key), key).limit(TRAIN_TEXTS)
    rows = docs.select(key, text).where(F.length(text).between(1, TRAIN_CHARS)).join(F.broadcast(l), key)
    got = sorted(rows.select(key, F.col(text).cast("binary").alias("text"), "__labels").collect(), key=lambda r: str(r[0]))
    return train([bytes(r.text).decode("utf-8", "replace") for r in got], [set(r["__labels"]) for r in got], subjects)


def classify(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spoken BIGINT (cues with speech, to the nearest number), subjects ARRAY<STRING> (accepted, in the areas' order), shares ARRAY<DOUBLE> (of
    each area, of the spoken cues): one row per row. Null and empty texts, and texts without cues, have no subjects."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # n-grams of a bounded sample
    schema = T.StructType([docs.schema[key], T.StructField("spoken", T.LongType()), T.StructField("subjects", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Models = shared.value
        number: dict[str, int] = {}
        scores: list[np.ndarray] = []
        for batch in batches:
            if len(number) > CACHE_WORDS:
                number, scores = {}, []
            spoken, owner = [], []
            for k, b in enumerate(batch.column(1).to_pylist()):
                for cue in _cues_of(b.decode("utf-8", "replace") if b else None):
                    ids = []
                    for w in cue:
                        if (i := number.get(w)) is None:
                            i = number[w] = len(scores)
                            scores.append(m.word(w))
                        ids.append(i)
                    spoken.append(ids)
                    owner.append(k)
            owner = np.array(owner, np.int64)
            table = evidence(np.array(scores)) if scores else np.zeros((0, len(m.subjects) + 2))
            share, n = text_shares(_sums(table, spoken), owner, batch.num_rows, m.live)
            names = [[m.subjects[j] for j in np.flatnonzero(row >= m.share)] for row in share]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.rint(n).astype(np.int64)), pa.array(names, pa.list_(pa.string())), pa.array(share.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return spread(docs.select(key, F.col(text).cast("binary").alias("__text"))).mapInArrow(run, schema)


def composition(found: DataFrame) -> DataFrame:
    """subject (`none`: no subject), documents, spoken: the corpus by subject; a text of several subjects counts in each."""
    s = found.select("spoken", F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("none")))).alias("subject"))
    return s.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("spoken").alias("spoken"))
