"""Providers of embeddings and of recognised text: dimension tables, request bodies by role, and readers of responses.

Requests and responses are columns, so a batch of them is a projection; sending them needs a network and a transport, which a
caller supplies as an `Engine` or an `Embedder`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.errors import InvalidParams
from lectern.functions.text import none_if_empty

#: Provider, style of its requests, task names for queries and for documents.
EMBEDDING_PROVIDERS = (
    ("openai", "plain", None, None),
    ("zhipu", "plain", None, None),
    ("dashscope", "plain", None, None),
    ("siliconflow", "plain", None, None),
    ("voyage", "voyage", "query", "document"),
    ("jina", "jina", "retrieval.query", "retrieval.passage"),
    ("cohere", "cohere", "search_query", "search_document"),
    ("doubao", "plain", None, None),
    ("gemini", "gemini", "RETRIEVAL_QUERY", "RETRIEVAL_DOCUMENT"),
)
#: Provider of recognised text, style of its requests, how it is authorised, whether responses can be read here.
OCR_PROVIDERS = (
    ("glm", "glm-layout-parsing", "bearer", True),
    ("qwen", "dashscope-multimodal", "bearer", True),
    ("custom", "openai-vision", "bearer", True),
    ("openai-vision-compat", "openai-vision", "bearer", False),
    ("olmocr", "olmocr-vllm", "bearer", False),
    ("mistral-ocr", "mistral-ocr", "bearer", True),
    ("mineru", "mineru-cli", "none", True),
    ("paddleocr-vl", "openai-vision", "bearer", True),
    ("mathpix", "mathpix", "header-key", False),
    ("doubao-ocr", "openai-vision", "bearer", False),
)
ROLES = ("query", "document")


def embedding_providers(spark: SparkSession) -> DataFrame:
    """id, style, query_task, document_task; by id."""
    return spark.createDataFrame(EMBEDDING_PROVIDERS, "id string, style string, query_task string, document_task string").orderBy("id")


def ocr_providers(spark: SparkSession) -> DataFrame:
    """id, style, auth, readable; by id."""
    return spark.createDataFrame(OCR_PROVIDERS, "id string, style string, auth string, readable boolean").orderBy("id")


def _row(table: tuple, provider: str, what: str) -> tuple:
    found = next((r for r in table if r[0] == provider), None)
    if found is None:
        raise InvalidParams(f"unknown {what} provider: {provider}; known: {', '.join(sorted(r[0] for r in table))}")
    return found


def embedding_request(provider: str, model: str, texts: Column, role: str) -> Column:
    """The request body as JSON for an array of texts: providers that know roles are told whether these are queries or documents."""
    if role not in ROLES:
        raise InvalidParams(f"unknown role: {role}")
    _, style, query_task, document_task = _row(EMBEDDING_PROVIDERS, provider, "embedding")
    task = F.lit(query_task if role == "query" else document_task)
    if style == "gemini":
        parts = F.transform(texts, lambda t: F.struct(t.alias("text")))
        return F.to_json(F.struct(task.alias("taskType"), F.struct(parts.alias("parts")).alias("content")))
    name = F.lit(model).alias("model")
    if style == "cohere":
        return F.to_json(F.struct(name, texts.alias("texts"), task.alias("input_type"), F.array(F.lit("float")).alias("embedding_types")))
    more = {"voyage": [task.alias("input_type")], "jina": [task.alias("task")]}.get(style, [])
    return F.to_json(F.struct(name, texts.alias("input"), *more))


def embedding_vectors(response: Column) -> Column:
    """The vectors of a response, whichever of the usual envelopes it has, as array<array<float>>."""
    kind = "array<array<float>>"
    lists = "array<struct<embedding: array<float>, values: array<float>>>"
    read = lambda schema: F.from_json(response, schema)
    listed = F.transform(read(f"data {lists}")["data"], lambda x: x["embedding"])
    single = read("data struct<embedding: array<float>>")["data"]["embedding"]
    named = read("embeddings struct<float: array<array<float>>>")["embeddings"]["float"]
    plain = read(f"embeddings {kind}")["embeddings"]
    values = F.transform(read(f"embeddings {lists}")["embeddings"], lambda x: x["values"])
    one = read("embedding struct<values: array<float>>")["embedding"]["values"]
    bare = read("embedding array<float>")["embedding"]
    whole = lambda x: F.when((F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull()), x)
    alone = lambda x: F.when(F.size(x) > 0, F.array(x))
    return F.coalesce(whole(listed), whole(named), whole(plain), whole(values), alone(single), alone(one), alone(bare))


def _filled(payload: Column, *names: str) -> Column:
    return F.coalesce(*[none_if_empty(F.get_json_object(payload, f"$.{n}")) for n in names])


def _pages(payload: Column) -> Column:
    pages = F.from_json(payload, "pages array<struct<markdown: string>>")["pages"]
    return none_if_empty(F.array_join(F.filter(F.transform(pages, lambda p: p["markdown"]), lambda m: F.coalesce(m, F.lit("")) != ""), "\n\n"))


#: For each readable provider what of a response is markdown and what is plain text; null where it has none.
_READERS: dict[str, Callable[[Column], tuple[Column, Column]]] = {
    "glm": lambda p: (F.coalesce(F.get_json_object(p, "$.md_results"), F.when(F.get_json_object(p, "$.choices").isNull(), F.get_json_object(p, "$.result"))), F.get_json_object(p, "$.choices[0].message.content")),
    "qwen": lambda p: (F.lit(None).cast("string"), F.get_json_object(p, "$.output.choices[0].message.content")),
    "custom": lambda p: (F.get_json_object(p, "$.choices[0].message.content"), F.lit(None).cast("string")),
    "mistral-ocr": lambda p: (F.coalesce(_filled(p, "markdown", "content"), _pages(p)), F.lit(None).cast("string")),
    "mineru": lambda p: (_filled(p, "markdown", "md", "content"), F.lit(None).cast("string")),
    "paddleocr-vl": lambda p: (_filled(p, "markdown", "md"), _filled(p, "text", "content")),
}


def recognised(provider: Column, payload: Column) -> Column:
    """struct(markdown, text, content, strength) of a provider's response: content is the markdown or else the text, "" without either.

    strength is raw where the provider gives layout markdown of its own, else parsed. An unreadable provider gives null.
    """
    cases = None
    for name, reader in _READERS.items():
        markdown, text = reader(payload)
        text = F.when(markdown.isNull(), text)
        strength = F.when(F.lit(name == "glm") & markdown.isNotNull(), "raw").otherwise("parsed")
        found = F.struct(markdown.alias("markdown"), text.alias("text"), F.coalesce(none_if_empty(markdown), text, F.lit("")).alias("content"), strength.alias("strength"))
        cases = F.when(provider == name, found) if cases is None else cases.when(provider == name, found)
    return cases


class Engine(Protocol):
    """Turns the bytes of a PDF into a provider's response (JSON text)."""

    provider: str
    model: str

    def recognise(self, pdf: bytes) -> str: ...


class TextEngine:
    """An engine for files that hold their text plainly: UTF-8, else an error. Its response has the form of a layout parser's."""

    provider, model = "glm", "plain-text"

    def recognise(self, pdf: bytes) -> str:
        try:
            return json.dumps({"md_results": pdf.decode()}, ensure_ascii=False)
        except UnicodeDecodeError:
            raise InvalidParams("the file isn't UTF-8 text") from None


def payloads(pdfs: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """pdfs (attachment_key, item_key, content) with provider, payload and error; the engine is made once a task, and an error is a row's, not the job's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = make()
        for batch in batches:
            out = []
            for content in batch.column(2):
                try:
                    out.append((engine.recognise(content.as_buffer().to_pybytes()), None))
                except Exception as e:
                    out.append((None, str(e)))
            cols = [[engine.provider] * len(out), [p for p, _ in out], [e for _, e in out]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in cols)], names=["attachment_key", "item_key", "provider", "payload", "error"])

    return pdfs.select("attachment_key", "item_key", "content").mapInArrow(run, "attachment_key string, item_key string, provider string, payload string, error string")
