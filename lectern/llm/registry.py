"""The queries of this subpackage: name -> callable(spark, sf_dir), and the SQL where SQL can express the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sst_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.sst import read_digests, write_shards

    docs = read_table(spark, sf_dir, "documents")
    return read_digests(spark, write_shards(spark, docs, tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pulearn import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.ogg import store_and_probe

    return store_and_probe(spark, read_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pieces import encoded_digests

    return encoded_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.htmlrender import render_pages

    return render_pages(read_table(spark, sf_dir, "pages"))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.langspans import languages

    return languages(read_table(spark, sf_dir, "documents"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.simhash import groups

    return groups(spark, read_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.suffixdedup import repeat_digests

    return repeat_digests(spark, read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality_rules import quality_report

    return quality_report(read_table(spark, sf_dir, "documents"))


def repeating_texts(docs: DataFrame) -> DataFrame:
    """The documents of op11: where crc32 of the id is a multiple of ten, the words from word a on repeat those of one period.

    With h the crc32, g = floor(h / 10) and n words: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)); word i >= a becomes
    word a + (i - a) % p. Other texts stay as they are. A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    copies = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(copies, F.lit(1), n - a))
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.tandem import periodic_runs, run_digests

    return run_digests(periodic_runs(repeating_texts(read_table(spark, sf_dir, "documents"))))


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.importance import importance_draw

    drawn = importance_draw(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pii import learn, personal_data, span_digests

    docs = read_table(spark, sf_dir, "documents")
    return span_digests(personal_data(docs, learn(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sst_token_shards": op1_sst_token_shards,
    "op2_pu_quality": op2_pu_quality,
    "op3_ogg_media": op3_ogg_media,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_poisson_mix": op5_poisson_mix,
    "op6_html_text": op6_html_text,
    "op7_language_spans": op7_language_spans,
    "op8_simhash_groups": op8_simhash_groups,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_draw": op12_importance_draw,
    "op13_personal_data": op13_personal_data,
}

OP5_SQL = """
WITH sizes AS (
  SELECT coalesce(source, '') AS s, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY 1
), totals AS (
  SELECT sum(chars) AS all_chars, CAST(sum(CASE WHEN chars > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n FROM sizes
), rates AS (
  SELECT s, CASE WHEN chars > 0 THEN 1.0 / n * all_chars / chars ELSE 0.0 END AS rate FROM sizes, totals
), parted AS (
  SELECT s, greatest(1, CAST(ceil(rate / 50.0) AS BIGINT)) AS parts, rate / greatest(1, ceil(rate / 50.0)) AS rate FROM rates
), terms AS (
  SELECT s, k, exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(greatest(rate, 1e-300)) END - lgamma(k + 1)) AS p FROM parted, range(0, 140) AS r(k)
), cdf AS (
  SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms
), named AS (
  SELECT row_number() OVER () AS id, coalesce(source, '') AS s, d.*, '42|' || coalesce(CAST(doc_id AS VARCHAR) || '|', '|') || md5(coalesce(text, '')) AS name FROM documents d
), drawn AS (
  SELECT id, s, CAST(('0x' || substr(md5(CASE WHEN parts = 1 THEN name ELSE name || '|part|' || CAST(part AS VARCHAR) END), 1, 12)) AS BIGINT) / 281474976710656.0 AS u
  FROM (SELECT n.id, n.s, n.name, p.parts, unnest(range(1, p.parts + 1)) AS part FROM named n JOIN parted p USING (s))
), counted AS (
  SELECT id, sum((SELECT count(*) FROM cdf WHERE cdf.s = drawn.s AND cdf.c <= drawn.u)) AS n FROM drawn GROUP BY id
), copies AS (
  SELECT id, unnest(range(0, CAST(n AS BIGINT))) AS copy FROM counted
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS BIGINT) AS copy, md5(name || '|' || CAST(copy AS VARCHAR)) AS mix_key
FROM named JOIN copies USING (id)
"""


def op10_sql() -> str:
    """The line rules and the base rules with the production parameters; \\n-split lines, words by white space."""
    from lectern.llm.quality_rules import DEFAULT as R
    from lectern.llm.quality_rules import SPACE, SYMBOLS

    q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    count = lambda text, pattern: f"(length({text}) - length(regexp_replace({text}, {q(pattern)}, '', 'g')))"
    words = lambda text: f"list_filter(string_split_regex({text}, {q(SPACE)}), lambda w: w <> '')"
    has_word = lambda text: f"regexp_matches({text}, '[^\\x20\\x09-\\x0D]')"
    k = R.window
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {words("t")} AS ws, string_split(t, chr(10)) AS ls FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + {k - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, {k}) AS r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(ls) AS x FROM w),
judged AS (
  SELECT doc_id, x, {has_word("x")} AS filled, NOT {has_word("x")} OR (
    regexp_matches(regexp_extract(rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[^ ' || chr(9) || ']*$'), {q(R.terminal)})
    AND NOT ({count("x", SYMBOLS)} > {R.max_symbol_share} * length(x) OR {count("x", "[|»›→]+")} > {R.max_separators}
      OR (length(x) >= {R.min_chars_for_case} AND {count("x", "[[:upper:]" + chr(92) + "p{Lu}]+")} > {R.max_upper_share} * length(x)))
    AND NOT (length(x) <= {R.max_boilerplate_chars} AND (regexp_matches(lower(x), {q(R.boilerplate)}) OR regexp_matches(lower(x), {q(R.navigation)})))) AS passes FROM lines),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE filled) - count(DISTINCT x) FILTER (WHERE filled) AS dup, CAST(coalesce(sum(len({words("x")})) FILTER (WHERE passes), 0) AS BIGINT) AS kept_words FROM judged GROUP BY doc_id),
metrics AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST({count("t", SYMBOLS)} AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, kept_words AS n_kept_words FROM w JOIN by_doc USING (doc_id) LEFT JOIN covered c ON c.doc_id = w.doc_id),
base AS (SELECT *, n_words < {R.min_words} OR 100 * n_repeat_words > {R.max_repeat_percent} * n_words AS base_failed FROM metrics)
SELECT *, NOT base_failed AND 100 * n_kept_words >= {R.min_kept_percent} * n_words AS kept FROM base
"""


def op12_sql() -> str:
    """SQL has no crc32: the bytes of each different feature are folded with the table of the polynomial."""
    from lectern.llm.importance import DrawRules

    R = DrawRules()
    runs = " UNION ALL ".join(f"SELECT id, unnest([array_to_string(ws[i:i + {k}], ' ') FOR i IN range(1, len(ws) - {k - 1})]) AS f FROM w" for k in range(R.max_run))
    return f"""
WITH RECURSIVE steps(c, k, x) AS (
  SELECT c, 0, CAST(c AS BIGINT) FROM range(0, 256) AS r(c)
  UNION ALL SELECT c, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) FROM steps WHERE k < 8
), crc AS (
  SELECT list(x ORDER BY c) AS t FROM steps WHERE k = 8
), texts AS (
  SELECT row_number() OVER () AS id, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER () AS id, NULL, text FROM benchmark
), w AS (
  SELECT id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts
), features AS ({runs}
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)
), hashed AS (
  SELECT f, xor(list_reduce([CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, length(h) // 2)], lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {R.buckets} AS bucket FROM hexed, crc
), cells AS (
  SELECT bucket, count(*) FILTER (WHERE id > 0) AS s, count(*) FILTER (WHERE id < 0) AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + {R.buckets}) / CAST((s + 1) * (sum(t) OVER () + {R.buckets}) AS DOUBLE)))) AS BIGINT) AS gain FROM cells
), sums AS (
  SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE id > 0 GROUP BY id
), scored AS (
  SELECT w.id, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{R.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN sums USING (id) WHERE w.id > 0
), ranked AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {R.min_words}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {R.percent} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (id)
"""


ORACLE_SQL: dict[str, str] = {"op5_poisson_mix": OP5_SQL, "op10_quality_rules": op10_sql(), "op12_importance_draw": op12_sql()}
