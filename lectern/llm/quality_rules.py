"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own: shouting, symbol litter, cell separators and menus (navigation), boilerplate phrases and
missing end punctuation. Failing lines are removed, then a document is rejected when too small a share of its words
is left, or when it fails one of the document-wide base rules (too few words, too many words in repeated windows).

Everything happens inside a row, so the plan is one scan and one projection: no shuffle, whatever the skew of keys.

Defined results: a null text counts as the empty text and has no words, so it is base_failed and not kept; very long
texts are handled whole; repeated rows give repeated results; an empty table gives an empty result; columns other than
the text column are carried through untouched by `clean_documents` (names starting with `__qr_` are reserved).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the two document decisions. Shares are of the characters of a line."""

    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_share: float = 0.06
    max_upper_share: float = 0.4
    #: A line this short may be all capitals (acronyms, initials).
    min_chars_for_case: int = 12
    #: More separator bars or menu arrows than this make a line navigation.
    max_separators: int = 2
    #: Looked for in the last word of a line, whatever blanks follow; a digit in it passes too (addresses, dates, amounts).
    terminal: str = r"([.!?:;…。！？][\"'”’»)\]]*|[0-9][^\x20\x09-\x0D]*)[\x20\x09-\x0D]*$"
    #: A boilerplate phrase fails a line of at most so many characters; in a longer line it is part of prose.
    max_boilerplate_chars: int = 160
    #: English, French, German and Spanish; looked for in lower-cased lines.
    boilerplate: str = (
        r"(all rights reserved|cookie (policy|settings|consent)|privacy policy|terms of (use|service)|enable javascript"
        r"|tous droits réservés|politique de (confidentialité|cookies)|conditions (générales|d.utilisation)|mentions légales"
        r"|alle rechte vorbehalten|datenschutz(erklärung|hinweise)|cookie-(richtlinie|einstellungen)|allgemeine geschäftsbedingungen"
        r"|todos los derechos reservados|política de (privacidad|cookies)|términos (y condiciones|de uso)|aviso legal"
        r"|^[\x20\x09-\x0D]*(licensed under|released under|this work is licensed|copyright (\(c\)|©|[0-9]{4})"
        r"|sous licence|lizenziert unter|publicado bajo licencia|licencia de uso)|lorem ipsum)"
    )
    navigation: str = (
        r"^[\x20\x09-\x0D]*(home|menu|next|previous|prev|back to top|share|login|sign (in|up)|read more|skip to content"
        r"|accueil|suivant|précédent|partager|se connecter|s.inscrire|lire la suite|haut de page"
        r"|startseite|menü|weiter|zurück|teilen|anmelden|registrieren|mehr lesen|nach oben"
        r"|inicio|menú|siguiente|anterior|compartir|iniciar sesión|registrarse|leer más|volver arriba)[\x20\x09-\x0D]*$"
    )
    #: A document is rejected when less than this percentage of its words is left.
    min_kept_percent: int = 50


DEFAULT = LineRules()


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than space and U+0009 to U+000D. Splitting at one character avoids the regex engine."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _without(text: Column, pattern: str) -> Column:
    """Characters of text that pattern matches."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _grams(hashes: Column, width: int) -> Column:
    """64-bit hashes of each window of `width` words, put together from windows of powers of two: every bit of every word's hash counts.

    Elements past the last whole window are wrong.
    """
    after = lambda a, k: F.slice(a, k + 1, F.size(a))
    mix = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    if width == 1:
        return hashes
    half = 1 << (width.bit_length() - 1)
    if half == width:
        return _let(_grams(hashes, width // 2), lambda p: mix(p, after(p, width // 2)))
    return _let(hashes, lambda h: mix(_grams(h, half), after(_grams(h, width - half), half)))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(grams: Column, window: int) -> Column:
    """Words in windows that occur twice or more: sort (window, position), keep those with an equal neighbour, join their ranges."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(s, j - 1)["g"] == x["g"]).otherwise(F.lit(False))
            return before | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return _let(pairs, lambda s: _let(repeated(s), total))


def with_metrics(df: DataFrame, text: str = "text", rules: LineRules = DEFAULT) -> DataFrame:
    """df with __qr_words (the words) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    k = rules.window
    df = df.withColumn("__qr_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__qr_words", words_of(F.col("__qr_text")))
    n = F.size("__qr_words")
    hashes = F.transform("__qr_words", lambda w: F.xxhash64(w))
    grams = F.slice(_grams(hashes, k), 1, F.greatest(n - k + 1, F.lit(0)))
    lines = F.filter(F.split("__qr_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__qr_grams", grams).withColumn("__qr_lines", lines)
    grams = F.col("__qr_grams")
    plain = F.size(F.array_distinct(grams)) == F.size(grams)
    out = df.select(
        *[c for c in df.columns if c not in ("__qr_grams", "__qr_lines")],
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__qr_words", "")).cast("long").alias("word_chars"),
        F.when(F.col("__qr_text").rlike(SYMBOLS), _without(F.col("__qr_text"), SYMBOLS)).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines"))).cast("long").alias("n_dup_lines"),
        F.when(plain, F.lit(0)).otherwise(_covered(grams, k)).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def last_word(line: Column) -> Column:
    """What follows the last inner space or tab of a line, without the blanks at its end."""
    tail = F.rtrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.substring_index(F.substring_index(tail, " ", -1), "\t", -1)


def line_passes(line: Column, rules: LineRules = DEFAULT) -> Column:
    """The verdict on one line. A line without words passes (it is paragraph spacing).

    Most lines hold few capitals and no symbols; one pass finds that, and only the others are looked at closely.
    """
    blank = ~line.rlike(r"[^\x20\x09-\x0D]")
    length = F.char_length(line)
    odd = _without(line, r"[#*$%&|<>»›→\p{Lu}]+") > min(rules.max_symbol_share, rules.max_upper_share) * length
    symbols = _without(line, SYMBOLS) > rules.max_symbol_share * length
    separators = _without(line, "[|»›→]+") > rules.max_separators
    shouting = (length >= rules.min_chars_for_case) & (_without(line, r"\p{Lu}+") > rules.max_upper_share * length)
    short = length <= rules.max_boilerplate_chars
    return F.when(blank, True).otherwise(
        last_word(line).rlike(rules.terminal)
        & ~(odd & (symbols | separators | shouting))
        & ~(line.rlike("[|»›→]") & separators)
        & ~(short & (F.lower(line).rlike(rules.boilerplate) | F.lower(line).rlike(rules.navigation)))
    )


def with_verdict(df: DataFrame, rules: LineRules = DEFAULT) -> DataFrame:
    """with_metrics(...) plus clean_text, n_kept_words and kept."""
    clean = F.array_join(F.filter(F.split("__qr_text", "\n"), lambda x: line_passes(x, rules)), "\n")
    df = df.withColumn("clean_text", clean)
    same = F.col("clean_text") == F.col("__qr_text")
    df = df.withColumn("n_kept_words", F.when(same, F.col("n_words")).otherwise(n_words(F.col("clean_text"))))
    return df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_kept_words") >= rules.min_kept_percent * F.col("n_words")))


def quality_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: LineRules = DEFAULT) -> DataFrame:
    """One row a document: the metrics and the verdict."""
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return with_verdict(with_metrics(slim, "text", rules), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words"
    )


def clean_documents(df: DataFrame, text: str = "text", rules: LineRules = DEFAULT) -> DataFrame:
    """The documents that pass, with the columns of df; the text column holds the lines that passed."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__qr_row"), F.col(f"`{text}`").alias("text"))
    kept = with_verdict(with_metrics(own, "text", rules), rules).where("kept")
    return kept.select(*[(F.col("clean_text") if c == text else F.col(f"__qr_row.`{c}`")).alias(c) for c in df.columns])
