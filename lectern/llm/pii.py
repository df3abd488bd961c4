"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to other mentions.

Base spans are e-mail addresses, IP addresses, card and phone numbers that match a pattern and its check; they always stay. Mentions
of the same data that break the pattern (a phone number without its country code, an address without its last part, a card number
with other separators) are found by consistency: the field's variables are the words with a digit or an @, labelled O or with
a kind. A variable has features of its form; neighbouring words share a potential, and so do distant words that repeat (same
form) or resemble each other (same last digits, or the same name at the same host): each has one link, to a word of a base span of its group
if there is one, so that the edges are as many as the words. Words of base spans are evidence. Loopy message passing (sum-product, damped, a fixed
number of rounds) gives marginals; a stretch of neighbouring words whose best label is one kind is added if some word of it
resembles a word of a base span of that kind in the same text and the stretch has the form of the kind. So texts without
base spans get none.

The weights are learnt here: at most `max_docs` documents (those with the least hash of their id) are labelled by the patterns. What a
mention without a valid pattern looks like is learnt from made ones: each base span is followed by itself in broken forms (its
label stays), each followed by the same form with other digits (label O). Tasks count patterns of features and neighbouring labels, whose number
doesn't grow with the texts, and the driver maximises the pseudo-likelihood of the counted patterns with a quadratic penalty. Finding is one projection over all documents, a text at a time, in time
linear in the text.

Defined results: null and empty texts have no spans; spans are in code points, by start, then kind in the order of KINDS; repeated
rows give repeated results; an empty table an empty result, and with nothing to learn from the weights are those of the
penalty alone; texts are handled whole; columns other than id and text don't matter. Memory of a task grows with the words with a digit or
an @ of one text that has base spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import least_hashes, slices_of

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is O, label k the k-th kind.
LABELS = 1 + len(KINDS)
SLICE_BYTES = 4 << 20
SPANS = "array<struct<kind: string, start: long, stop: long, base: boolean>>"

_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where digits do, and takes all of the last ones
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (ord(c) - 48) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind (its number in KINDS), end of the spans that match a pattern and its check, in that order."""
    out = []
    if "@" in text:
        done = 0
        for m in _HOST.finditer(text):
            at = m.start()
            while at > done and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                out.append((at, 0, m.end()))
                done = m.end()
    if _SIGN.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 2 or (len(p) == 3 and p <= "255") for part in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(digits_of(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Features of a word's form, each true or false.
FEATURES = ("any", "at", "at with a dot behind", "plus", "four dotted numbers", "1 to 3 digits", "4 to 6 digits", "7 to 13 digits", "14 to 19 digits", "20 digits or more", "digits only", "digits and signs", "brackets", "letters", "word before", "word behind")


@dataclass(frozen=True)
class Word:
    """A variable of the field: its place without signs around it, form, group of resembling words and label (0 unless in a base span)."""

    start: int
    stop: int
    form: str
    group: str
    label: int
    #: Whether only blanks, no signs, part it from the variable before it.
    follows: bool


def _group(form: str) -> str:
    """Words with one group resemble each other; the empty group has no links."""
    if "@" in form:
        name, _, host = form.lower().partition("@")
        return "".join(c for c in name if c.isalnum()) + "@" + re.split(r"[^0-9a-z-]", host, maxsplit=1)[0]
    digits = digits_of(form)
    return digits[-7:] if len(digits) >= 3 else ""


def words_of(text: str, base: list[tuple[int, int, int]]) -> list[Word]:
    """The words with a digit or an @, in order."""
    out, stop, b = [], 0, 0
    for m in _SIGN.finditer(text):
        if m.start() < stop:
            continue
        start = 1 + max(text.rfind(c, stop, m.start()) for c in _BLANKS)
        start = max(start, stop)
        end = _BLANK.search(text, m.end())
        stop = end.start() if end else len(text)
        a, z = start, stop
        while not (text[a].isalnum() or text[a] in "+(@"):
            a += 1
        while not (text[z - 1].isalnum() or text[z - 1] in ")@"):
            z -= 1
        while b < len(base) and base[b][2] <= start:
            b += 1
        label, k = 0, b
        while k < len(base) and base[k][0] < stop:
            if base[k][2] > start:
                label = base[k][1] + 1
                break
            k += 1
        out.append(Word(a, z, text[a:z], _group(text[a:z]), label, bool(out) and not text[out[-1].stop : a].strip(_BLANKS)))
    return out


def _features(words: list[Word]) -> np.ndarray:
    """A row a word, a column a feature."""
    rows = np.zeros((len(words), len(FEATURES)), bool)
    for k, w in enumerate(words):
        n = len(digits_of(w.form))
        at = w.form.find("@")
        behind = k + 1 < len(words) and words[k + 1].follows
        rows[k] = [
            True, at >= 0, at >= 0 and "." in w.form[at:], w.form.startswith("+"), _IP.fullmatch(w.form) is not None, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 13, 14 <= n <= 19, n >= 20,
            n == len(w.form), n < len(w.form) and not any(c.isalpha() for c in w.form), "(" in w.form or ")" in w.form, any(c.isalpha() for c in w.form), w.follows, behind,
        ]
    return rows


#: Kinds of edges: neighbours, repeated words, resembling words.
NEXT, SAME, SIMILAR = 0, 1, 2


def edges_of(words: list[Word]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in words, in order, and the kind of each: neighbours, and one link of each word within its group.

    The link goes to the last word of a base span before it, or else to the first one behind it, or else to the word before it.
    """
    first: dict[str, int] = {}
    for k, w in enumerate(words):
        if w.label:
            first.setdefault(w.group, k)
    pairs, kinds, last = [], [], {}
    for k, w in enumerate(words):
        if w.follows:
            pairs.append((k - 1, k))
            kinds.append(NEXT)
        if w.group:
            other = last.get(w.group, k if w.label else first.get(w.group))
            if other is not None and other != k:
                pairs.append((min(k, other), max(k, other)))
                kinds.append(SAME if words[other].form == w.form else SIMILAR)
            if w.label or w.group not in first:
                last[w.group] = k
    return np.array(pairs, np.int64).reshape(-1, 2), np.array(kinds, np.int64)


@dataclass(frozen=True)
class PiiRules:
    max_docs: int = 20_000
    #: Weight of the quadratic penalty; the label O of any word is drawn towards `prior`.
    penalty: float = 1.0
    prior: float = 2.0
    steps: int = 400
    rounds: int = 30
    damping: float = 0.5


@dataclass(frozen=True)
class SkipChain:
    """Weights: of features by label, of neighbouring labels, and of equal labels of repeated and of resembling words."""

    forms: np.ndarray
    next: np.ndarray
    same: np.ndarray
    similar: np.ndarray
    rules: PiiRules

    def potentials(self) -> np.ndarray:
        return np.stack([self.next, np.diag(self.same), np.diag(self.similar)])

    def marginals(self, local: np.ndarray, pairs: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Beliefs of the variables by damped sum-product messages; exact on graphs without cycles no longer than the rounds."""
        if not len(pairs):
            return _softmax(local)
        table = self.potentials()[kinds]
        # messages along each edge, then against it
        source, sink = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        sent = np.zeros((len(source), LABELS))
        half, keep = len(pairs), self.rules.damping
        for _ in range(self.rules.rounds):
            belief = local.copy()
            np.add.at(belief, sink, sent)
            back = np.concatenate([sent[half:], sent[:half]])
            own = (belief[source] - back)[:, :, None] + table
            top = own.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(own - top).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            sent = keep * sent + (1 - keep) * new
        belief = local.copy()
        np.add.at(belief, sink, sent)
        return _softmax(belief)

    def added(self, words: list[Word]) -> list[tuple[int, int, int]]:
        """start, kind, end of the stretches that the field labels beside the base spans."""
        pairs, kinds = edges_of(words)
        if not (kinds != NEXT).any():
            return []
        label = np.array([w.label for w in words])
        local = _features(words).astype(float) @ self.forms
        known = label > 0
        local[known] = -60.0
        local[known, label[known]] = 0.0
        best = self.marginals(local, pairs, kinds).argmax(axis=1).tolist()
        sources = {(w.group, w.label) for w in words if w.label and w.group}
        out, k = [], 0
        while k < len(words):
            j = k + 1
            if not words[k].label and best[k]:
                while j < len(words) and words[j].follows and not words[j].label and best[j] == best[k]:
                    j += 1
                # a stretch is one mention, or each of its words is one
                whole = _has_form(best[k], words[k:j])
                for own in [words[k:j]] if whole else [[w] for w in words[k:j]]:
                    if any((w.group, best[k]) in sources for w in own) and _has_form(best[k], own):
                        out.append((own[0].start, best[k] - 1, own[-1].stop))
            k = j
        return out


def _has_form(label: int, words: list[Word]) -> bool:
    kind, digits = KINDS[label - 1], sum(len(digits_of(w.form)) for w in words)
    if kind == "email":
        return len(words) == 1 and "@" in words[0].form.strip("@")
    if kind == "ip":
        return len(re.findall(r"[0-9]+", " ".join(w.form for w in words))) == 4
    return 14 <= digits <= 19 if kind == "card" else 7 <= digits <= 15


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: States of the linked word before and of the one behind: none, then repeated with each label, then resembling with each label.
_LINKS = 1 + 2 * LABELS
#: States of a neighbour: none, then each label.
_SIDES = 1 + LABELS
_BASES = (LABELS, _SIDES, _SIDES, _LINKS, _LINKS)


def patterns_of(words: list[Word]) -> np.ndarray:
    """A number for each word from its features, its label, its neighbours' labels and those of its linked words."""
    features = _features(words) @ (1 << np.arange(len(FEATURES), dtype=np.int64))
    label = np.array([w.label for w in words], np.int64)
    parts = [label, *(np.zeros(len(words), np.int64) for _ in range(4))]
    pairs, kinds = edges_of(words)
    for kind, shift in ((NEXT, 0), (SAME, 0), (SIMILAR, LABELS)):
        a, b = pairs[kinds == kind].T
        before, behind = (1, 2) if kind == NEXT else (3, 4)
        parts[before][b] = 1 + shift + label[a]
        parts[behind][a] = 1 + shift + label[b]
    out = features
    for base, part in zip(_BASES, parts):
        out = out * base + part
    return out


def broken(kind: int, form: str) -> list[str]:
    """Mentions of the same data that the patterns don't find."""
    if kind == 0:
        name, _, host = form.partition("@")
        return [f"{name}@{host.partition('.')[0]}"]
    if kind == 1:
        return [form.replace(".", "-")]
    d = digits_of(form)
    if kind == 2:
        return [".".join(d[k : k + 4] for k in range(0, len(d), 4))]
    return [f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}"]


#: Other digits and names than those of a mention.
_OTHER = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyz", "5678901234nopqrstuvwxyzabcdefghijklm")


def made_words(text: str, base: list[tuple[int, int, int]]) -> list[Word]:
    """The variables of a text made of its base spans, each followed by its broken forms and by these forms of other data."""
    out, spans, at = [], [], 0

    def put(part: str, kind: int | None) -> None:
        nonlocal at
        if kind is not None:
            spans.append((at, kind, at + len(part)))
        out.append(f"{part} and ")
        at += len(part) + 5

    for start, kind, stop in base:
        form = text[start:stop]
        put(form, kind)
        for other in broken(kind, form):
            put(other, kind)
            put(other.lower().translate(_OTHER), None)
    return words_of("".join(out), spans)


def fit(patterns: np.ndarray, counts: np.ndarray, rules: PiiRules = PiiRules()) -> SkipChain:
    """The weights of greatest penalised pseudo-likelihood of these counted patterns, by gradient steps of adapted size."""
    parts, rest = [], patterns
    for base in reversed(_BASES):
        parts.append(rest % base)
        rest = rest // base
    link_b, link_a, right, left, label = parts
    x = ((rest[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)
    one_hot = lambda v, n: np.eye(n)[v]
    left, right, truth = one_hot(left, _SIDES)[:, 1:], one_hot(right, _SIDES)[:, 1:], one_hot(label, LABELS)
    links = one_hot(link_a, _LINKS)[:, 1:] + one_hot(link_b, _LINKS)[:, 1:]
    same, similar = links[:, :LABELS], links[:, LABELS:]
    shapes = [(len(FEATURES), LABELS), (LABELS, LABELS), (LABELS,), (LABELS,)]
    centre = [np.zeros(s) for s in shapes]
    centre[0][0, 0] = rules.prior
    w, first, second = [c.copy() for c in centre], [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, rules.steps + 1):
        p = _softmax(x @ w[0] + left @ w[1] + right @ w[1].T + same * w[2] + similar * w[3])
        gap = counts[:, None] * (truth - p)
        slope = [x.T @ gap, left.T @ gap + gap.T @ right, (same * gap).sum(axis=0), (similar * gap).sum(axis=0)]
        for k in range(4):
            slope[k] = slope[k] - rules.penalty * (w[k] - centre[k])
            first[k] = 0.9 * first[k] + 0.1 * slope[k]
            second[k] = 0.99 * second[k] + 0.01 * slope[k] ** 2
            w[k] = w[k] + 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return SkipChain(*w, rules)


def learn(docs: DataFrame, rules: PiiRules = PiiRules(), id_col: str = "doc_id", text_col: str = "text") -> SkipChain:
    """Weights from the documents with the least hashes, labelled by the base patterns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices_of(batch, 0, SLICE_BYTES):
                texts = own.column(0).to_pylist()
                bases = [base_spans(t) for t in texts]
                found = [patterns_of(words) for t, base in zip(texts, bases) for words in (words_of(t, base), made_words(t, base)) if words]
                pattern, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], names=["pattern", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.lit(0).alias("g")).where("id IS NOT NULL").distinct()
    # at most max_docs narrow rows
    chosen = F.broadcast(least_hashes(rows, "g", rules.max_docs).select("id"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id", "left_semi")
    found = texts.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    return fit(found["pattern"].to_numpy(), found["n"].to_numpy(), rules)


def personal_data(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, stop, base: whether a fixed pattern found it) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices_of(batch, 1, SLICE_BYTES):
                rows = []
                for text in own.column(1).to_pylist():
                    base = base_spans(text) if text else []
                    more = model.added(words_of(text, base)) if base else []
                    every = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                    rows.append([{"kind": KINDS[kind], "start": start, "stop": stop, "base": own_base} for start, kind, stop, own_base in every])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlapping spans by the first one's kind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for own in slices_of(batch, place, SLICE_BYTES):
                out = []
                for text in own.column(place).to_pylist():
                    base = base_spans(text) if text else []
                    parts, at = [], 0
                    for start, kind, stop in sorted([*base, *(model.added(words_of(text, base)) if base else [])]):
                        if start >= at:
                            parts += [text[at:start], f"<{KINDS[kind]}>"]
                        at = max(at, stop)
                    out.append(text if text is None else "".join([*parts, text[at:]]))
                yield own.set_column(place, text_col, pa.array(out, own.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def span_digests(found: DataFrame) -> DataFrame:
    """Of personal_data: base spans of each kind, the digest of all base spans, and all spans as kind:start:end."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, line), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
