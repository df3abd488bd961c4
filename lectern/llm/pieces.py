"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder is a score-ordered agenda: symbols start as characters, every adjacent pair that forms a piece is put on the agenda
by (score, position), and the best pair whose two symbols are still there is merged, which puts its new neighbours on the
agenda. Symbols that are no piece fall back to bytes. Long texts have a heap as their agenda (`merge`); the many words of a
batch have a matrix (`merge_words`): words of one length are its rows, their pairs' scores its entries, and in each round the
best entry of every row, the leftmost of equals, is merged and its two neighbours are scored anew.

A vocabulary in which the space mark stands only at the start of pieces (checked on loading) never merges over the border
before a word, so a text's ids are those of its words; each new word goes through the agenda once, and in the same Arrow
batch its ids are compared with the sentencepiece library's. Where they differ the library's ids count and `differing` says how
often that was; the tests demand 0. One whole text of each slice of a batch is compared too; a difference there is an error.
Where the vocabulary lacks that property, or with by_word=False, whole texts go through the agenda and all are compared.

One projection, no shuffle; memory holds a slice of an Arrow batch and a table of words of MOST_BYTES.

Defined results: null and empty texts have no ids and decode to the empty text; very long texts are handled whole; repeated
rows give equal values; an empty table gives an empty result; other columns are carried or ignored as documented below.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import slices_of

MARK = "▁"
#: Texts are encoded in slices of about so many bytes; one whole text of each is compared with the library.
SLICE_BYTES = 1 << 20
#: Piece types of the model format.
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6


class Agenda:
    """A merge-type model: pieces with scores, and the encoder over them."""

    #: Words are kept in two generations, so that frequent ones outlive the many that come once. A generation ends when its words
    #: and ids take so many bytes; an entry takes ENTRY_BYTES besides its characters and ids.
    MOST_BYTES = 40 << 20
    ENTRY_BYTES = 190
    #: Words up to so many characters go through a matrix, so many at a time.
    MATRIX_CHARS, MATRIX_ROWS = 24, 1 << 15

    def __init__(self, path: str, by_word: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only merge-type models with identity normalisation and kept spaces are handled")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not handled")
        self.prefix = norm.add_dummy_prefix
        self.rank = {p.piece: (p.score, k) for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.by_word = by_word and self.prefix and not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.kind = "<u2" if len(model.pieces) <= 1 << 16 else "<u4"
        self.decimal = [str(k) for k in range(len(model.pieces))]
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = self.differing = 0
        self._pairs()

    def _pairs(self) -> None:
        """Numbers of symbols (characters and pieces) and, sorted by code, each pair of symbols that forms a piece with that piece."""
        # number 0 is any character that no piece has
        names = ["", *sorted({c for p in self.rank for c in p} | self.rank.keys())]
        number = {s: k for k, s in enumerate(names)}
        codes, made, scores = [], [], []
        for p, (score, _) in self.rank.items():
            for cut in range(1, len(p)):
                a, b = number.get(p[:cut]), number.get(p[cut:])
                if a is not None and b is not None:
                    codes.append(a * len(names) + b)
                    made.append(number[p])
                    scores.append(score)
        order = np.argsort(np.array(codes, np.int64), kind="stable")
        self.n_symbols = len(names)
        self.codes = np.array(codes, np.int64)[order]
        self.made, self.scores = np.array(made, np.int64)[order], np.array(scores, np.float32)[order]
        self.id_of = np.array([self.rank[s][1] if s in self.rank else -1 for s in names], np.int64)
        points = {ord(s): k for k, s in enumerate(names) if len(s) == 1}
        self.points, self.symbols = np.array(sorted(points), np.int64), np.array([points[c] for c in sorted(points)], np.int64)

    def _score(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each pair of symbols (-inf where it forms no piece) and the piece's number."""
        if not len(self.codes):
            return np.full(left.shape, -np.inf, np.float32), np.zeros(left.shape, np.int64)
        code = left * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        found = self.codes[at] == code
        return np.where(found, self.scores[at], np.float32(-np.inf)), self.made[at]

    def _rows(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of symbols of equal length, merged: (numbers of rows, their symbols), in groups of equal remaining length."""
        rows = np.arange(len(symbols))
        score, made = self._score(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if symbols.shape[1] < 2:
                yield rows, symbols
                return
            best = score.argmax(axis=1)
            own = np.arange(len(rows))
            live = score[own, best] > -np.inf
            if not live.all():
                yield rows[~live], symbols[~live]
                rows, symbols, score, made, best = rows[live], symbols[live], score[live], made[live], best[live]
                if not len(rows):
                    return
                own = np.arange(len(rows))
            n = symbols.shape[1] - 1
            behind = np.arange(n) + (np.arange(n) > best[:, None])
            merged = np.take_along_axis(symbols, behind, axis=1)
            merged[own, best] = made[own, best]
            symbols = merged
            # the merged pair's entry goes; the entries on its two sides are new pairs
            keep = np.arange(n - 1) + (np.arange(n - 1) >= best[:, None])
            score, made = np.take_along_axis(score, keep, axis=1), np.take_along_axis(made, keep, axis=1)
            for at, inside in ((best - 1, best > 0), (best, best < n - 1)):
                k, c = own[inside], at[inside]
                score[k, c], made[k, c] = self._score(symbols[k, c], symbols[k, c + 1])

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of escaped words as numbers of `kind`."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            size = int(sizes[order[a]])
            for at in range(a, b, self.MATRIX_ROWS):
                own = order[at : min(b, at + self.MATRIX_ROWS)].tolist()
                if not size:
                    continue
                if size > self.MATRIX_CHARS:
                    for k in own:
                        out[k] = np.array(self.merge(words[k]), self.kind).tobytes()
                    continue
                points = np.frombuffer("".join([words[k] for k in own]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(-1, size)
                place = np.minimum(np.searchsorted(self.points, points), max(len(self.points) - 1, 0))
                symbols = np.where(self.points[place] == points, self.symbols[place], 0) if len(self.points) else np.zeros_like(points)
                for rows, left in self._rows(symbols):
                    ids = self.id_of[left]
                    whole = (ids >= 0).all(axis=1)
                    data, width = ids.astype(self.kind).tobytes(), ids.shape[1] * np.dtype(self.kind).itemsize
                    for j, (k, plain) in enumerate(zip(rows.tolist(), whole.tolist())):
                        # characters that are no piece fall back to bytes
                        out[own[k]] = data[j * width : (j + 1) * width] if plain else np.array(self.merge(words[own[k]]), self.kind).tobytes()
        return out

    def merge(self, text: str) -> list[int]:
        """Ids of an escaped text by the agenda."""
        n, rank = len(text), self.rank
        sym, left, right = list(text), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-rank[p][0], k, k + 1, p) for k in range(n - 1) if (p := text[k : k + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, a, b, piece = heapq.heappop(heap)
            if right[a] != b or not sym[a] or sym[a] + sym[b] != piece:
                continue
            sym[a], sym[b] = piece, ""
            after = right[a] = right[b]
            right[b] = -2
            if after >= 0:
                left[after] = a
                if (p := piece + sym[after]) in rank:
                    heapq.heappush(heap, (-rank[p][0], a, after, p))
            if (before := left[a]) >= 0 and (p := sym[before] + piece) in rank:
                heapq.heappush(heap, (-rank[p][0], before, a, p))
        out: list[int] = []
        for s in filter(None, sym):
            if s in rank:
                out.append(rank[s][1])
            elif self.byte:
                out += [self.byte[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def escape(self, text: str) -> str:
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""

    def _learn(self, words: list[str]) -> None:
        """Put words (without their first space mark) through the agenda and hold the ids against the library's."""
        found = self.merge_words([self.escape(w) or MARK for w in words])
        theirs = self.library.encode(words, num_threads=1)
        for w, a, b in zip(words, found, theirs):
            if w and np.frombuffer(a, self.kind).tolist() != b:
                self.differing += 1
                a = np.array(b, self.kind).tobytes()
            self._keep(w, a)

    def _keep(self, word: str, ids: bytes) -> None:
        self.words[word] = ids
        self.size += len(word) + len(ids) + self.ENTRY_BYTES

    @staticmethod
    def cut(text: str) -> list[str]:
        """Words of a text, each without the space before it; further spaces before a word stay with it."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts[:-1]:
            if p:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        return [*out, " " * spaces + parts[-1]]

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, list[int]]]:
        """For each text its ids joined by commas, and its ids."""
        whole = [t or "" for t in texts]
        if self.by_word:
            if self.size > self.MOST_BYTES:
                self.words, self.old, self.size = {}, self.words, 0
            cut = [self.cut(t) if t else [] for t in whole]
            new = []
            for w in set().union(*cut) - self.words.keys() if cut else ():
                if (found := self.old.get(w)) is not None:
                    self._keep(w, found)
                else:
                    new.append(w)
            self._learn(new)
            look, decimal = self.words.__getitem__, self.decimal
            out = []
            for words in cut:
                ids = np.frombuffer(b"".join([look(w) for w in words]), self.kind).tolist()
                out.append((",".join([decimal[i] for i in ids]), ids))
            held = out[:1]
        else:
            out = [(",".join(map(str, ids)), ids) for ids in (self.merge(self.escape(t)) for t in whole)]
            held = out
        for k, theirs in enumerate(self.library.encode(whole[: len(held)], num_threads=1)):
            if out[k][1] != theirs:
                self.differing += 1
                if held is not out:
                    raise ValueError("this model's ids of a text aren't those of its words: encode with by_word=False")
                return self._theirs(whole)
        return out

    def _theirs(self, whole: list[str]) -> list[tuple[str, list[int]]]:
        return [(",".join(map(str, ids)), ids) for ids in self.library.encode(whole, num_threads=1)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.lru_cache(maxsize=2)
def agenda_for(path: str, by_word: bool = True) -> Agenda:
    """One model a worker process: its words serve later tasks too."""
    return Agenda(path, by_word)


def _mapped(path: str, by_word: bool, make, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_for(path, by_word)
        for batch in batches:
            for own in slices_of(batch, 1, SLICE_BYTES):
                rows = [make(agenda, *x) for x in agenda.encode_batch(own.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["id", *names])

    return run


def _digest(agenda: Agenda, joined: str, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(agenda.decode(ids).encode()).hexdigest()


def encoded_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    run = _mapped(model, by_word, _digest, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()])
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", "doc_id")


def encode_documents(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", by_word: bool = True) -> DataFrame:
    """docs with its ids and the decoded text as two more columns; existing columns of those names are replaced."""
    keep = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    fields = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    text_at = keep.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_for(model, by_word)
        for batch in batches:
            for own in slices_of(batch, text_at, SLICE_BYTES):
                rows = [ids for _, ids in agenda.encode_batch(own.column(text_at).to_pylist())]
                more = [pa.array(rows, pa.list_(pa.int32())), pa.array([agenda.decode(i) for i in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, ids_col, decoded_col])

    schema = fields.add(ids_col, T.ArrayType(T.IntegerType())).add(decoded_col, T.StringType())
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
