"""Provider payloads to blocks, blocks to chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import block_type, none_if_empty, trim
from lectern.operators.ranks import positions, running, with_previous
from lectern.stages import Stages

BLOCK_JSON = "struct<type: string, text: string, content: string, markdown: string, caption: string, label: string, alt_text: string, image_ref: string, bbox: array<double>, confidence: double>"
PAYLOAD = (
    f"struct<pages: array<struct<page: int, page_number: int, blocks: array<{BLOCK_JSON}>, elements: array<{BLOCK_JSON}>, layout: array<{BLOCK_JSON}>>>, "
    f"blocks: array<{BLOCK_JSON}>, elements: array<{BLOCK_JSON}>, layout: array<{BLOCK_JSON}>, markdown: string, md_results: string, result: string>"
)
#: Block types that are evidence of their own.
EVIDENCE = ("table", "figure", "equation", "caption")


def block_text(b: Column) -> Column:
    """The first filled of text, content, markdown; if all are null or the last is, caption, label, alt text. Trimmed."""
    main = F.coalesce(none_if_empty(b["text"]), none_if_empty(b["content"]), b["markdown"])
    spare = F.coalesce(none_if_empty(b["caption"]), none_if_empty(b["label"]), b["alt_text"])
    return trim(F.coalesce(main, spare, F.lit("")))


def _blocks_of(x: Column) -> Column:
    """The first filled of the three names under which providers list blocks."""
    none = F.array().cast(f"array<{BLOCK_JSON}>")
    return F.coalesce(*[F.when(F.size(x[n]) > 0, x[n]) for n in ("blocks", "elements", "layout")], none)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once: an array of one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _listed(p: Column) -> Column:
    """The blocks that a parsed response lists in reading order, pages first, then top-level lists: page, b_idx, b."""
    page_of = lambda x, i: F.coalesce(F.nullif(x["page"], F.lit(0)), F.nullif(x["page_number"], F.lit(0)), i + 1)
    none = F.array().cast(f"array<struct<page: int, page_number: int, blocks: array<{BLOCK_JSON}>, elements: array<{BLOCK_JSON}>, layout: array<{BLOCK_JSON}>>>")
    paged = F.flatten(F.transform(F.coalesce(p["pages"], none), lambda x, i: F.transform(_blocks_of(x), lambda b, j: F.struct(page_of(x, i).alias("page"), j.alias("b_idx"), b.alias("b")))))
    top = F.transform(_blocks_of(p), lambda b, j: F.struct(F.lit(1).alias("page"), j.alias("b_idx"), b.alias("b")))
    return F.concat(paged, top)


def _carried(blocks: Column, heading_own: bool) -> Column:
    """A response's blocks with section_heading, the text of the last heading. A response is cut at its headings, so the work grows with its blocks."""
    own = lambda b: F.lit(True) if heading_own else b["type"] != "heading"

    def sections(bs: Column) -> Column:
        heads = F.filter(F.transform(bs, lambda b, i: F.when(b["type"] == "heading", i)), lambda i: i.isNotNull())

        def section(starts: Column, s: Column, j: Column) -> Column:
            first = F.greatest(s, F.lit(0))
            part = F.slice(bs, first + 1, F.coalesce(F.get(starts, j + 1), F.size(bs)) - first)
            title = F.when(s < 0, "").otherwise(F.get(bs, first)["text"])
            return F.transform(part, lambda b: b.withField("section_heading", F.when(own(b), title).otherwise("")))

        # -1: what stands before the first heading
        return _let(F.concat(F.array(F.lit(-1)), heads), lambda starts: F.flatten(F.transform(starts, lambda s, j: section(starts, s, j))))

    return _let(blocks, sections)


def _structured(listed: Column) -> Column:
    """Listed blocks that have a text, as blocks of a response."""
    texts = F.transform(listed, lambda x, i: F.struct(i.alias("ord"), x["page"].alias("page"), x["b_idx"].alias("b_idx"), x["b"].alias("b"), block_type(x["b"]["type"]).alias("type"), block_text(x["b"]).alias("text")))
    caption = lambda x: F.coalesce(none_if_empty(x["b"]["caption"]), F.when(x["type"].isin("figure", "caption"), x["text"]))
    place = lambda x: F.concat(F.lit(":p"), x["page"].cast("string"), F.lit(":b"), x["b_idx"].cast("string"))
    own = F.transform(
        F.filter(texts, lambda x: x["text"] != ""),
        lambda x: F.struct(
            place(x).alias("place"), x["type"].alias("type"), x["page"].alias("page"), x["b"]["bbox"].alias("bbox"), x["ord"].alias("reading_order"), x["text"].alias("text"),
            caption(x).alias("caption"), x["b"]["image_ref"].alias("image_ref"), x["b"]["confidence"].alias("confidence"),
        ),
    )
    return _carried(own, heading_own=True)


def _markdown(text: Column) -> Column:
    """Paragraphs between blank lines, single # lines as headings, as blocks of a response."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), trim), lambda x: x != "")
    is_heading = lambda x: x.rlike(r"\A#{1,6}\s+[^\n]+\z")
    none = lambda kind: F.lit(None).cast(kind)
    own = F.transform(
        parts,
        lambda x, i: F.struct(
            F.concat(F.lit(":p0:b"), i.cast("string")).alias("place"), F.when(is_heading(x), "heading").otherwise("paragraph").alias("type"), none("int").alias("page"), none("array<double>").alias("bbox"), i.alias("reading_order"),
            F.when(is_heading(x), trim(F.regexp_replace(x, r"\A#{1,6}\s+", ""))).otherwise(x).alias("text"), none("string").alias("caption"), none("string").alias("image_ref"), none("double").alias("confidence"),
        ),
    )
    return _carried(own, heading_own=False)


def with_blocks(payloads: DataFrame, markdown: Column | None = None) -> DataFrame:
    """payloads (payload as JSON) with structured (whether it lists blocks, on a page or at its top) and blocks, an array: no shuffle.

    A response whose listed blocks yield none falls back to its markdown (markdown, md_results, result, or a bare string); where markdown is given,
    it is what a response without lists is read as.
    """
    parsed = payloads.withColumn("__p", F.from_json("payload", PAYLOAD)).withColumn("__listed", _listed(F.col("__p")))
    structured, p = F.size("__listed") > 0, F.col("__p")
    bare = F.when(~F.col("payload").rlike(r"^\s*[\[{]"), F.regexp_replace("payload", r'^\s*"|"\s*$', ""))
    spare = F.coalesce(none_if_empty(p["markdown"]), none_if_empty(p["md_results"]), none_if_empty(p["result"]), bare)
    spare = spare if markdown is None else F.when(structured, spare).otherwise(none_if_empty(markdown))
    own = _let(_structured(F.col("__listed")), lambda found: F.when(F.size(found) > 0, found).otherwise(_markdown(spare)))
    return parsed.withColumns({"structured": structured, "blocks": own}).drop("__p", "__listed")


def block_rows(responses: DataFrame, *keep: str) -> DataFrame:
    """A row a block of responses (attachment_key, provider, blocks as an array and the columns to keep)."""
    rows = responses.select("attachment_key", "provider", *keep, F.explode("blocks").alias("b"))
    return rows.select(
        F.concat_ws("", "attachment_key", "b.place").alias("block_id"), "attachment_key", *keep, *[F.col(f"b.{c}").alias(c) for c in ("type", "page", "bbox", "reading_order", "section_heading", "text", "caption", "image_ref")],
        F.col("provider").alias("source_provider"), F.lit(None).cast("string").alias("source_ref"), F.col("b.confidence").alias("confidence"),
        F.when(F.col("b.bbox").isNotNull(), "strong").otherwise("weak").alias("provenance_strength"),
    )


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """docs (attachment_key, item_key, provider, markdown) to blocks: paragraphs between blank lines, single # lines as headings."""
    return block_rows(docs.select("attachment_key", "item_key", "provider", _markdown(F.col("markdown")).alias("blocks")), "item_key")


def provider_blocks(payloads: DataFrame) -> DataFrame:
    """payloads (attachment_key, item_key, provider, payload as JSON) to blocks; each response's headings are its own."""
    return block_rows(with_blocks(payloads.select("attachment_key", "item_key", "provider", "payload")), "item_key")


def _cut(max_chars: int):
    """Rows sorted by segment (first column) and order, with their size (second): as they are, with chunk (its number in the segment, from 0) and whether they begin it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, chunk, filled = None, 0, 0
        for batch in batches:
            out, first = [], []
            for own, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = own != segment or filled + size > max_chars
                if own != segment:
                    segment, chunk, filled = own, 0, size
                elif new:
                    chunk, filled = chunk + 1, size
                else:
                    filled += size
                out.append(chunk)
                first.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64()), pa.array(first, pa.bool_())], names=[*batch.schema.names, "chunk", "first"])

    return run


_FIELDS = ["block_id", "item_key", "type", "page", "bbox", "section_heading", "text", "caption", "image_ref", "provenance_strength"]


def block_sizes(blocks: DataFrame, *keep: str) -> DataFrame:
    """What cut_blocks asks of blocks, without their texts, and the columns to keep."""
    return blocks.select("attachment_key", "reading_order", "block_id", "type", "section_heading", F.length("text").alias("size"), *keep)


def cut_blocks(sizes: DataFrame, max_chars: int) -> DataFrame:
    """Blocks without their texts (attachment_key, item_key, reading_order, block_id, type, section_heading, size, __row) to their chunks.

    Headings have none. segment and chunk name a block's chunk, first is true for the block that begins it. Written, so that it is cut once.
    """
    order = ["reading_order", "block_id", "__row"]
    own = with_previous(sizes, ["attachment_key"], order, {"__type": "type", "__section": "section_heading"})
    fresh = F.col("__type").isNull() | (F.col("__type") == "heading") | ~F.col("section_heading").eqNullSafe(F.col("__section"))
    marked = own.withColumn("__fresh", fresh.cast("int")).drop("__type", "__section", "section_heading")
    split = running(marked, ["attachment_key", *order], F.col("__fresh"), "segment").where("type <> 'heading'")
    dealt = split.select("segment", "size", *[c for c in split.columns if c not in ("segment", "size", "type")]).repartition("segment").sortWithinPartitions("segment", *order)
    schema = T.StructType([*dealt.schema.fields, T.StructField("chunk", T.LongType()), T.StructField("first", T.BooleanType())])
    return Stages(sizes.sparkSession, "chunks").put(dealt.mapInArrow(_cut(max_chars), schema).drop("block_id", "size"), "cut")


def gather_chunks(blocks: DataFrame, cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The chunks of blocks, gathered (max_chars bounds them) and numbered in their attachment. keys: columns of both by which a block is found; the item is that of cut."""
    numbers = positions(cut.where("first").select("attachment_key", "segment", "chunk"), ["attachment_key"], ["segment", "chunk"], "n")
    place = cut.join(numbers.select("segment", "chunk", "n"), ["segment", "chunk"]).select(*keys, "item_key", "n")
    rows = blocks.select(*dict.fromkeys([*keys, "attachment_key", "reading_order", *[c for c in _FIELDS if c != "item_key"]])).join(place, list(keys))
    rows = rows.groupBy("attachment_key", "n").agg(F.array_sort(F.collect_list(F.struct("reading_order", *_FIELDS))).alias("c"))
    pages = F.filter(F.transform("c", lambda b: b["page"]), lambda p: p.isNotNull())
    kinds = F.array_distinct(F.transform("c", lambda b: b["type"]))
    strengths = F.array_distinct(F.transform("c", lambda b: b["provenance_strength"]))
    evidence = F.transform(F.filter("c", lambda b: b["type"].isin(*EVIDENCE)), lambda b: F.struct(b["block_id"].alias("block_id"), b["type"].alias("type"), b["page"].alias("page"), b["bbox"].alias("bbox"), b["caption"].alias("caption"), b["image_ref"].alias("image_ref")))
    text = F.array_join(F.transform("c", lambda b: b["text"]), "\n\n")
    return rows.select(
        F.concat("attachment_key", F.lit(":c"), F.col("n").cast("string")).alias("chunk_id"), F.get("c", F.lit(0))["item_key"].alias("item_key"), "attachment_key",
        F.transform("c", lambda b: b["block_id"]).alias("block_ids"), kinds.alias("block_types"), F.get("c", F.lit(0))["section_heading"].alias("section_heading"),
        F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), text.alias("text"), F.lit(0).alias("char_start"), F.length(text).alias("char_end"),
        F.lit("chunk").alias("level"), evidence.alias("evidence_refs"), F.when(F.size(strengths) > 1, "mixed").otherwise(F.get(strengths, F.lit(0))).alias("provenance_strength"),
    )

def chunk_blocks(blocks: DataFrame, max_chars: int = 1000) -> DataFrame:
    """Chunks of consecutive blocks of one section, at most max_chars (joins not counted; a longer block stands alone).

    Headings end a chunk and belong to none, so a chunk lies between two headings or changes of section. Such segments are numbered
    over all rows at once, whatever attachment they are of; a task reads the sizes of a segment's blocks in order and keeps only
    how full the chunk is. Texts are written once and meet their chunks' numbers; all that goes before is done without them.
    """
    own = blocks.select("attachment_key", "reading_order", *_FIELDS).withColumn("__row", F.monotonically_increasing_id())
    own = Stages(blocks.sparkSession, "chunks").put(own, "blocks")
    return gather_chunks(own, cut_blocks(block_sizes(own, "item_key", "__row"), max_chars), ["__row"])
