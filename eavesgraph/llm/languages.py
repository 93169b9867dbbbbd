"""Languages of documents and of the stretches in mixed ones.

Each language has probabilities of the pieces of a fixed public vocabulary. A
word is scored by the sum over all its segmentations into pieces (forward
algorithm), so no segmentation has to be chosen; the scores of words add up to
those of lines, and the shares of languages in a document are fitted to its lines.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eavesgraph.llm import subtitles
from eavesgraph.session import broadcast_if_small

#: The public vocabulary whose pieces are used.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled documents that the probabilities are fitted on, at most so many a language, and the most letters of one.
SAMPLE, SAMPLE_LETTERS = 300, 1_000_000
#: Passes of expectation and maximisation over the piece counts.
ROUNDS = 3
#: A language belongs to a document from this share of its dialogue on.
SHARE = 0.2
#: Log-probability of going on in the language of the line before, and of changing.
STAY, CHANGE = float(np.log(0.9)), float(np.log(0.1))
#: A piece that a language has not shown weighs as so many occurrences of its overall share.
SMOOTH = 50.0
#: Words kept with their scores in a worker.
CACHE = 500_000


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """Pieces in lower case, with the mark of a word's begin; single letters are added by need."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


def line_words(text: str | None) -> list[list[str]]:
    """The words of each line of dialogue that has any; numbers are no words.

    Lines, not cues, are the unit: a cue may show one language above another.
    """
    if not text:
        return []
    find = subtitles.WORD.findall
    lines = [[w for w in find(c) if not w.isdigit()] for c in subtitles.dialogue(text).split("\n")]
    return [c for c in lines if c]


@dataclass
class PieceModel:
    """Log-probabilities of pieces by language, and how words are scored with them."""

    langs: list[str]
    pieces: dict[str, int]
    prob: np.ndarray
    longest: int
    letter: float = 1e-7

    def __post_init__(self) -> None:
        self._index: dict[str, int] = {}
        self._rows: list[np.ndarray] = []
        self._log: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _edges(self, word: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) of the segmentation lattice; -1 is a letter outside the vocabulary."""
        w = "▁" + word
        get, n = self.pieces.get, len(w)
        out = []
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = get(w[i:j])
                if k is not None:
                    out.append((i, j, k))
                elif j == i + 1:
                    out.append((i, j, -1))
        return out

    def score(self, word: str) -> np.ndarray:
        """log of the summed probability of all segmentations, for each language.

        The sums are taken as they are, and as logarithms where a language's
        sum would come near the smallest number, so a word of any length has
        its whole score.
        """
        edges = self._edges(word)
        alpha = np.zeros((len(word) + 2, len(self.langs)))
        alpha[0] = 1.0
        for i, j, k in edges:
            alpha[j] += alpha[i] * (self.prob[k] if k >= 0 else self.letter)
        if alpha[-1].min() > 1e-250:
            return np.log(alpha[-1])
        log, letter = self._log_prob(), np.log(self.letter)
        alpha[:] = -np.inf
        alpha[0] = 0.0
        for i, j, k in edges:
            np.logaddexp(alpha[j], alpha[i] + (log[k] if k >= 0 else letter), out=alpha[j])
        return alpha[-1]

    def _log_prob(self) -> np.ndarray:
        if self._log is None:
            self._log = np.log(self.prob)
        return self._log

    def word_ids(self, words: list[str]) -> list[int]:
        index, out = self._index, []
        for w in words:
            k = index.get(w)
            if k is None:
                k = index[w] = len(self._rows)
                self._rows.append(self.score(w))
            out.append(k)
        return out

    def table(self) -> np.ndarray:
        return np.array(self._rows)

    def forget(self) -> None:
        if len(self._rows) > CACHE:
            self.__post_init__()


def fit(words: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> PieceModel:
    """Piece probabilities by language from word counts, by expectation and maximisation over segmentations."""
    langs = sorted(words)
    index = {p: i for i, p in enumerate(pieces)}
    for w in {c for l in langs for w in words[l] for c in "▁" + w}:
        index.setdefault(w, len(index))
    model = PieceModel(langs, index, np.full((len(index), len(langs)), 1.0 / len(index)), max(map(len, index)))
    every = sorted({w for l in langs for w in words[l]})
    count = np.array([[words[l][w] for l in langs] for w in every], float)
    lattice = [model._edges(w) for w in every]
    for _ in range(rounds):
        got = np.zeros_like(model.prob)
        for w, edges, c in zip(every, lattice, count):
            n = len(w) + 1
            a, b = np.zeros((n + 1, len(langs))), np.zeros((n + 1, len(langs)))
            a[0] = b[n] = 1.0
            p = [model.prob[k] for _, _, k in edges]
            for (i, j, _), q in zip(edges, p):
                a[j] += a[i] * q
            for (i, j, _), q in zip(reversed(edges), reversed(p)):
                b[i] += b[j] * q
            z = c / np.maximum(a[n], 1e-300)
            for (i, j, k), q in zip(edges, p):
                got[k] += a[i] * q * b[j] * z
        overall = (got.sum(1) + 0.1) / (got.sum() + 0.1 * len(got))
        model.prob = (got + SMOOTH * overall[:, None]) / (got.sum(0) + SMOOTH)
    return model


def labelled_sample(documents: DataFrame, codes: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(language, text) of at most ``sample`` labelled documents of each language, by a hash of doc_id.

    Documents of more than SAMPLE_LETTERS letters are not picked, so what comes
    to the driver is bounded in bytes too.
    """
    known = broadcast_if_small(codes.select(F.col("label").alias("lang"), F.col("lang").alias("language")).dropDuplicates(["lang"]))
    labelled = documents.where(F.length("text") <= SAMPLE_LETTERS).select("doc_id", "lang").join(known, "lang")
    by = Window.partitionBy("language").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = labelled.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= sample).select("doc_id", "language")
    rows = documents.select("doc_id", "text").join(broadcast_if_small(picked), "doc_id").select("language", "text").collect()
    return [(r[0], r[1]) for r in rows]


def train(documents: DataFrame, codes: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> PieceModel | None:
    """The model of the languages that labelled documents show; None without any.

    Fitted twice: cues that the first model gives to another language than the
    label of their document are left out of the second fit, since labels may be
    wrong and documents mixed.
    """
    rows = labelled_sample(documents, codes, sample)
    if not rows:
        return None
    cues = [(l, c) for l, t in rows for c in line_words(t)]
    pieces = vocabulary(path)
    counts: dict[str, Counter] = {}
    for l, c in cues:
        counts.setdefault(l, Counter()).update(c)
    first = fit(counts, pieces, 1)
    at = {l: i for i, l in enumerate(first.langs)}
    ids = [first.word_ids(c) for _, c in cues]
    table = first.table()
    clean: dict[str, Counter] = {l: Counter() for l in counts}
    for (l, c), i in zip(cues, ids):
        if table[i].sum(0).argmax() == at[l]:
            clean[l].update(c)
    return fit({l: clean[l] or counts[l] for l in counts}, pieces)


def shares(score: np.ndarray, size: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(share of each language, posterior of each line) of a document by expectation and maximisation.

    score: log-likelihoods of the lines; size: their words.
    """
    pi = np.full(score.shape[1], 1.0 / score.shape[1])
    like = np.exp(score - score.max(1, keepdims=True))
    for _ in range(rounds):
        post = like * pi
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        pi = size @ post / size.sum()
    return pi, post


def best_path(score: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """The likeliest language of each line, if neighbours tend to share theirs (Viterbi).

    Every language takes part, however small its share. Two exact shortcuts:
    against the language c that is best for all lines as one, a language that
    gains on no stretch of lines is on no best path; and if none gains more
    than half the price of a change, c is best throughout.
    """
    s = score + np.log(np.maximum(pi, 1e-300))
    c = int(s.sum(0).argmax())
    total = np.cumsum(s - s[:, [c]], axis=0)
    low = np.minimum.accumulate(np.concatenate((np.zeros((1, s.shape[1])), total[:-1])), axis=0)
    gain = (total - low).max(0)
    if gain.max() <= (STAY - CHANGE) / 2:
        return np.full(len(s), c)
    keep = np.flatnonzero((gain > 0) | (np.arange(s.shape[1]) == c))
    s = s[:, keep]
    back = np.zeros(s.shape, np.int64)
    total = s[0]
    for t in range(1, len(s)):
        best = int(total.argmax())
        stay, move = total + STAY, total[best] + CHANGE
        own = stay >= move
        back[t] = np.where(own, np.arange(len(keep)), best)
        total = np.where(own, stay, move) + s[t]
    path = [int(total.argmax())]
    for t in range(len(s) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return keep[np.array(path[::-1])]


def _segments(model: PieceModel, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int, int, float]]]]:
    """For each text with dialogue: (number of the text, [(first line, last line, language, words, confidence)])."""
    ids, starts, sizes, docs = [], [], [], []
    for t in texts:
        cues = line_words(t)
        docs.append(len(cues))
        for c in cues:
            starts.append(len(ids))
            sizes.append(len(c))
            ids += model.word_ids(c)
    if not ids:
        return
    score = np.add.reduceat(model.table()[ids], starts, axis=0)
    size = np.array(sizes, float)
    at = 0
    for d, n in enumerate(docs):
        if not n:
            continue
        s, w = score[at : at + n], size[at : at + n]
        at += n
        pi, post = shares(s, w)
        path = best_path(s, pi)
        cut = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1], [True])))
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            words = w[a:b].sum()
            out.append((int(a), int(b - 1), int(path[a]), int(words), float(w[a:b] @ post[a:b, path[a]] / words)))
        yield d, out


def language_segments(documents: DataFrame, codes: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, first_line, last_line, lang, n_words, confidence): stretches of one language.

    documents: doc_id, text, lang; codes: label, lang; other columns are
    ignored. Lines are counted from 0 among those with words. Confidence is the
    mean posterior of the language over the words of the stretch. Documents
    without dialogue (null, empty, only numbers or adverts) give no row;
    repeated documents each give theirs; without any labelled document there
    is nothing to fit, and the result is empty. The probabilities are fitted on
    at most ``sample`` labelled documents a language; every document is scored
    as a whole, without a shuffle.
    """
    schema = "doc_id long, first_line int, last_line int, lang string, n_words int, confidence double"
    spark = documents.sparkSession
    model = train(documents, codes, path, sample)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                doc = part.column(0).to_pylist()
                rows = [(doc[d], f, l, m.langs[k], n, c) for d, out in _segments(m, part.column(1).to_pylist()) for f, l, k, n, c in out]
                m.forget()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()))], ["doc_id", "first_line", "last_line", "lang", "n_words", "confidence"])

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def document_languages(segments: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, lang, share, confidence, n_langs): languages that make up at least ``share`` of the words."""
    per = segments.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n"), (F.sum(F.col("n_words") * F.col("confidence")) / F.sum("n_words")).alias("confidence"))
    doc = Window.partitionBy("doc_id")
    per = per.withColumn("share", F.col("n") / F.sum("n").over(doc)).where(F.col("share") >= share)
    return per.withColumn("n_langs", F.count("*").over(doc)).select("doc_id", "lang", "share", "confidence", "n_langs")


def label_faults(documents: DataFrame, codes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, lang) of documents whose label is absent, unknown or wrong, and of mixed ones."""
    known = broadcast_if_small(codes.select(F.col("label"), F.col("lang").alias("named")).dropDuplicates(["label"]))
    labels = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label")).join(known, "label", "left").select("doc_id", "named")
    wrong = F.col("named").isNull() | (F.col("named") != F.col("lang")) | (F.col("n_langs") > 1)
    return found.join(labels, "doc_id").where(wrong).select("doc_id", "lang").distinct()
