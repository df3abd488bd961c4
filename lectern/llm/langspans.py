"""Language identification: script ranges narrow the candidates, then Viterbi labels spans of mixed-language text.

A word is a run of characters without white space; what counts is its letters, in lower case. Its score for a language is
the log-likelihood of its letter n-grams (1 to 4, with word borders) under that language's counts. A word's script,
by Unicode ranges of its letters, leaves only the languages that were seen to use that script. Viterbi over the words of a
text, with a penalty for each change of language, labels spans; the text's language is the one with most letters.

Learning: at most `max_docs` documents a language (those with the least hash of their id), whole texts, counted by Spark
into hashed n-gram cells; the counts that reach the driver are bounded by cells times languages. The sample is found by a
histogram of hashes (partial counts), so that only ids up to the histogram's cut are ranked: a language that holds most of
the rows never meets in one task. Prediction is one projection over all documents; each word of a slice is scored once.

Defined results: null texts and texts without a letter are `und` with score 0 and have no span; a text whose scripts no
language was seen to use keeps all languages as candidates; very long texts are labelled whole; ties go to the first language
in alphabetical order; repeated rows give equal results, and an id that stands in several rows of a language counts once
for `max_docs` and is learnt from with all its rows; an empty table gives an empty result, and with nothing learned
every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_fold, least_hashes, slices_of

#: Fixed values of the Unicode standard: first and last code point of the blocks of each script.
SCRIPT_RANGES = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "burmese": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
SCRIPTS = [*SCRIPT_RANGES, "other"]
_STARTS, _ENDS, _NAMES = (np.array(x) for x in zip(*sorted((a, b, SCRIPTS.index(s)) for s, own in SCRIPT_RANGES.items() for a, b in own)))
UNKNOWN = "und"
#: Texts are taken in slices of about so many bytes, and their different words so many at a time: both bound a worker's memory.
SLICE_BYTES = 2 << 20
WORDS_AT_ONCE = 1 << 14


@dataclass(frozen=True)
class LangConfig:
    max_docs: int = 2000
    cells: int = 1 << 16
    orders: tuple[int, ...] = (1, 2, 3, 4)
    #: Cost of a change of language, in nats; also the most that one word can speak for or against a language.
    switch: float = 12.0
    most_a_word: float = 6.0
    #: A language uses a script if at least this share of its words do.
    script_share: float = 0.02
    smooth: float = 0.5


def script_of(letters: str) -> int:
    """The script of the first letter whose block is known."""
    for c in letters:
        k = int(np.searchsorted(_STARTS, ord(c), side="right")) - 1
        if k >= 0 and ord(c) <= _ENDS[k]:
            return int(_NAMES[k])
    return len(SCRIPTS) - 1


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def _cells(words: list[str], config: LangConfig) -> tuple[np.ndarray, np.ndarray]:
    """n-gram cells of all words, and for each cell the index of its word. Words are letters only."""
    joined = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    cells, owners = [], []
    h = np.zeros(len(joined), np.uint64)
    for n in range(1, max(config.orders) + 1):
        if len(joined) < n:
            break
        h = h[: len(joined) - n + 1] * np.uint64(0x100000001B3) + joined[n - 1 :]
        if n in config.orders:
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
            x = (h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            cells.append(((x >> np.uint64(40)) % np.uint64(config.cells))[inside].astype(np.int64))
            owners.append(owner[: len(owner) - n + 1][inside])
    return np.concatenate(cells) if cells else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def _coded(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Offsets of texts, different words, and each place's word."""
    filled = pc.fill_null(column.cast(pa.string()), "")
    cut = pc.utf8_split_whitespace(filled)
    coded = cut.flatten().dictionary_encode()
    return cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py(), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)


def _counts(config: LangConfig):
    """(lang, cell, n) partial counts; cells from config.cells on count words by script."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for own in slices_of(batch, 1, SLICE_BYTES):
                langs = np.array(own.column(0).to_pylist(), object)
                for lang in sorted(set(langs)):
                    _, words, index = _coded(own.column(1).filter(pa.array(langs == lang)))
                    times = np.bincount(index, minlength=len(words))
                    letters = [letters_of(w) for w in words]
                    keep = [k for k, w in enumerate(letters) if w]
                    letters, times = [letters[k] for k in keep], times[keep]
                    cells, owner = _cells(letters, config)
                    own_sums = sums.setdefault(lang, np.zeros(config.cells + len(SCRIPTS), np.int64))
                    own_sums += np.bincount(cells, times[owner], minlength=len(own_sums)).astype(np.int64)
                    own_sums += np.bincount([config.cells + script_of(w) for w in letters], times, minlength=len(own_sums)).astype(np.int64)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(s[at])], names=["lang", "cell", "n"])

    return run


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    #: Log-probabilities, cells x languages, and scripts x languages: whether the language uses the script.
    logs: np.ndarray
    uses: np.ndarray
    config: LangConfig

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its scores (the best is 0) and its number of letters; words without letters are neutral."""
        parts = [self._word_scores(words[k : k + WORDS_AT_ONCE]) for k in range(0, max(1, len(words)), WORDS_AT_ONCE)]
        return np.concatenate([p[0] for p in parts]).astype(np.float32), np.concatenate([p[1] for p in parts])

    def _word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = [letters_of(w) for w in words]
        sizes = np.fromiter(map(len, letters), np.int64, len(letters))
        cells, owner = _cells(letters, self.config)
        scores = np.zeros((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            scores[:, k] = np.bincount(owner, self.logs[cells, k], minlength=len(words))
        scripts = np.array([script_of(w) for w in letters], np.int64)
        allowed = self.uses[scripts] if len(words) else np.zeros((0, len(self.langs)), bool)
        allowed |= ~allowed.any(axis=1, keepdims=True)
        # a word borders only on itself, so spread the n-gram sums over the orders used
        scores = np.where(allowed, scores / len(self.config.orders), -np.inf)
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -self.config.most_a_word) if len(words) else scores
        scores = np.where(allowed, scores, -4 * self.config.most_a_word)
        scores[sizes == 0] = 0
        return scores, sizes

    def paths(self, at: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Viterbi's label for each place. at: offsets of texts into the rows of scores."""
        lengths = np.diff(at)
        labels = np.zeros(len(scores), np.int64)
        long = lengths > 1000
        for k in np.flatnonzero(long).tolist():
            labels[at[k] : at[k + 1]] = self._path(scores[at[k] : at[k + 1]].tolist())
        order = np.argsort(-lengths, kind="stable")
        order = order[(~long & (lengths > 0))[order]]
        if len(order):
            self._paths_together(at[:-1][order], lengths[order], scores, labels)
        return labels

    def _path(self, rows: list[list[float]]) -> list[int]:
        cost, back, v = self.config.switch, [], rows[0]
        for row in rows[1:]:
            top = max(v)
            back.append((v.index(top), [x < top - cost for x in v]))
            floor = top - cost
            v = [(x if x >= floor else floor) + e for x, e in zip(v, row)]
        now = v.index(max(v))
        out = [now]
        for best, moved in reversed(back):
            now = best if moved[now] else now
            out.append(now)
        return out[::-1]

    def _paths_together(self, start: np.ndarray, lengths: np.ndarray, scores: np.ndarray, labels: np.ndarray) -> None:
        """Texts in order of falling length, one step for all that are that long."""
        longest, cost = int(lengths[0]), self.config.switch
        # in the precision of `_path`, so that a text's labels don't depend on which of the two labels it
        v = scores[start].astype(np.float64)
        moved = np.zeros((len(scores), scores.shape[1]), bool)
        best = np.zeros(len(scores), np.int64)
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]
        for t in range(1, longest):
            n = active[t]
            own, here = v[:n], start[:n] + t
            best[here] = own.argmax(axis=1)
            floor = own.max(axis=1, keepdims=True) - cost
            moved[here] = own < floor
            v[:n] = np.maximum(own, floor) + scores[here]
        now = v.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = active[t] if t else len(lengths)
            here = start[:n] + t
            labels[here] = now[:n]
            if t:
                now[:n] = np.where(moved[here, now[:n]], best[here], now[:n])


def learn(docs: DataFrame, learn_from, config: LangConfig = LangConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """A model from the rows of docs for which the column learn_from(id) is true and the language is known."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(learn_from(F.col("id")) & F.col("lang").isNotNull() & F.col("id").isNotNull())
    chosen = least_hashes(rows.distinct(), "lang", config.max_docs)
    # at most max_docs narrow rows a language
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(chosen), ["id", "lang"], "left_semi")
    counts = texts.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counts(config), "lang string, cell long, n long")
    # at most cells times languages rows, kept as Arrow columns
    found = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(pc.unique(found["lang"]).to_pylist())
    sums = np.zeros((config.cells + len(SCRIPTS), len(langs)))
    sums[found["cell"].to_numpy(), pc.index_in(found["lang"], pa.array(langs, pa.string())).to_numpy()] = found["n"].to_numpy()
    grams, scripts = sums[: config.cells], sums[config.cells :]
    logs = np.log((grams + config.smooth) / (grams.sum(axis=0) + config.smooth * config.cells)) if langs else grams
    uses = scripts >= config.script_share * np.maximum(1, scripts.sum(axis=0)) if langs else scripts > 0
    return LangModel(langs, logs.astype(np.float32), uses & (scripts > 0), config)


def _labelled(model: LangModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, and for each word its label and number of letters."""
    at, words, index = _coded(column)
    scores, sizes = model.word_scores(words)
    return at, model.paths(at, scores[index]), sizes[index]


def predictions(docs: DataFrame, model: LangModel, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of letters in spans of that language), n_spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices_of(batch, 2, SLICE_BYTES):
                n = own.num_rows
                pred, score, spans = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
                if model.langs:
                    at, labels, sizes = _labelled(model, own.column(2))
                    doc = np.repeat(np.arange(n), np.diff(at))
                    share = np.bincount(doc * len(model.langs) + labels, sizes, minlength=n * len(model.langs)).reshape(n, -1)
                    total = share.sum(axis=1)
                    best = share.argmax(axis=1)
                    pred = [model.langs[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist())]
                    score = share.max(axis=1) / np.maximum(total, 1)
                    new = np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])]) if len(labels) else np.zeros(0, bool)
                    spans = np.where(total > 0, np.bincount(doc, new, minlength=n), 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(spans)], names=["doc_id", "held_out", "lang_pred", "score", "n_spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")


def spans(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, span, first_word, n_words, lang: the spans of each text with a letter, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices_of(batch, 1, SLICE_BYTES):
                rows = []
                if model.langs:
                    at, labels, sizes = _labelled(model, own.column(1))
                    for k, doc_id in enumerate(own.column(0).to_pylist()):
                        a, b = int(at[k]), int(at[k + 1])
                        if sizes[a:b].sum():
                            cuts = [a, *(np.flatnonzero(labels[a + 1 : b] != labels[a : b - 1]) + a + 1).tolist(), b]
                            rows += [(doc_id, j, x - a, y - x, model.langs[labels[x]]) for j, (x, y) in enumerate(zip(cuts, cuts[1:]))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["doc_id", "span", "first_word", "n_words", "lang"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, span int, first_word long, n_words long, lang string")


def languages(docs: DataFrame, config: LangConfig = LangConfig()) -> DataFrame:
    """Predictions for all documents by a model that never saw the held-out fold."""
    held = lambda i: id_fold(i, 5) == 0
    return predictions(docs, learn(docs, lambda i: ~held(i), config), held)
