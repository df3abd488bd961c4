"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output. With W the share and w the source's present share of tokens (here: of
characters), a document's mean repetition rate is  budget * W / w, budget being the output's size over the input's. A
document's count is drawn by inverting the Poisson distribution at a uniform number made from a hash of seed and document,
so it is reproducible and independent of partitioning. A mean above `PART_RATE` is split into equal parts no larger, each
drawn with its own hash; the sum of independent Poisson counts is Poisson with the sum of the means, so no rate is cut.
Up to `BLOCK` parts are summed in the row; more (means above PART_RATE * BLOCK, from a source of a few characters beside large
ones) become rows of blocks of parts, whose first copy numbers are prefix sums in levels of `BLOCK`, so that no array and no
window holds more than that, and the work follows the number of copies. Copies are exploded in blocks and shuffled globally by a
second hash.

Shuffles: one small aggregation over sources (partial sums first), whose result is written to the shared folder; a join with
that table of one row a source, which Spark broadcasts below its own size threshold and else shuffles, splitting hot sources;
and the global shuffle, which deals rows by the leading digits of a hash of document and copy. The hash is uniform, so
the borders are known beforehand (no sampling run) and a hot source or document spreads evenly. Sizes are counted over all
documents.

Defined results: a null source is a source of its own named "" ; null and empty texts weigh nothing but are drawn like the
others of their source; a source that `targets` doesn't name has target 0; a source whose texts are all empty has rate 0, so
its documents go; repeated rows are drawn alike, as the hash sees their id and text; an empty table gives an empty result;
columns named like the added ones (copy_col, key_col) are replaced, so name these otherwise where such columns must stay;
names starting with `__mix_` are reserved.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Workspace

#: Mean of a single draw at most: its terms neither underflow nor take many steps.
PART_RATE = 50.0
#: Parts, blocks of parts and copies stand in arrays of this length at most.
BLOCK = 1000


def hex_uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of md5."""
    return hex_share(F.md5(key))


def hex_share(digits: Column) -> Column:
    """The first 12 hex digits as a fraction in [0, 1)."""
    return F.conv(F.substring(digits, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """Least k with P(X <= k) > u for X Poisson with this mean: a fold over k that stops adding when the sum passes u."""
    state = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))
    step = lambda s, k: F.when(s["c"] > u, s).otherwise(
        F.struct(k.alias("k"), (s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"))
    )
    top = (rate + 10 * F.sqrt(rate) + 12).cast("int")
    return F.aggregate(F.sequence(F.lit(1), top), state, step, lambda s: s["k"])


def poisson_count(name: Column, rate: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """A Poisson count drawn by the hash of name; above PART_RATE the sum of draws of equal parts, each by the hash of name and part.

    first and last bound the parts that are summed (1 to all of them): BLOCK at most.
    """
    parts = F.ceil(rate / F.lit(PART_RATE))
    part = lambda k: poisson_inverse(hex_uniform(F.concat(name, F.lit("|part|"), k.cast("string"))), rate / parts).cast("long")
    span = F.sequence(F.lit(1).cast("long") if first is None else first, parts if last is None else last)
    many = F.aggregate(span, F.lit(0).cast("long"), lambda n, k: n + part(k))
    return F.when(rate <= PART_RATE, poisson_inverse(hex_uniform(name), rate).cast("long")).otherwise(many)


def numbered(rows: DataFrame, count: str, number: str, most: int) -> DataFrame:
    """Each row as often as its column count says (up to `most`), with number 0, 1, ...; exploded in levels of BLOCK."""
    step, out = 1, rows.withColumn(number, F.lit(0).cast("long"))
    while step * BLOCK < most:
        step *= BLOCK
    while step:
        last = F.least(F.col(number) + step * BLOCK, F.col(count)) - 1
        out = out.where(F.col(count) > 0).withColumn(number, F.explode(F.sequence(F.col(number), last, F.lit(step).cast("long"))))
        step //= BLOCK
    return out


def drawn_blocks(space: Workspace, named: DataFrame) -> DataFrame:
    """name, block, n, before: of each different (name, rate) with a large rate the draws of its blocks of parts, and of all blocks before."""
    wide = named.distinct().withColumn("parts", F.ceil(F.col("rate") / F.lit(PART_RATE))).withColumn("blocks", F.ceil(F.col("parts") / BLOCK))
    wide = space.put(wide, "wide")
    most = wide.agg(F.max("blocks")).first()[0] or 0
    first = F.col("block") * BLOCK + 1
    rows = numbered(wide, "blocks", "block", most).withColumn("n", poisson_count(F.col("name"), F.col("rate"), first, F.least(first + (BLOCK - 1), F.col("parts"))))
    rows = space.put(rows.select("name", "block", "n"), "blocks")
    step = 1
    while step * BLOCK < most:
        step *= BLOCK
    found = None
    while step:
        sums = rows.groupBy("name", F.floor(F.col("block") / step).alias("at")).agg(F.sum("n").alias("n")).withColumn("up", F.floor(F.col("at") / BLOCK))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("name", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", before)
        if found is not None:
            above = found.select("name", F.col("at").alias("up"), F.col("before").alias("above"))
            sums = sums.join(above, ["name", "up"]).withColumn("before", F.col("before") + F.col("above"))
        found = space.put(sums.select("name", "at", "n", "before"), f"before_{step}")
        step //= BLOCK
    return found.withColumnRenamed("at", "block")


def source_rates(docs: DataFrame, targets: Mapping[str, float] | None = None, budget: float = 1.0, alpha: float = 0.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, chars, rate: one row a source. Without targets a source's share goes with its size to the power alpha: 0 equal shares, 1 as it is."""
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")).alias("chars"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(float(alpha))))
    else:
        known = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]) if targets else F.create_map().cast("map<string,double>")
        weighted = sizes.withColumn("weight", F.coalesce(known[F.col("source")].cast("double"), F.lit(0.0)))
    # a source without characters can't carry a share
    weighted = weighted.withColumn("weight", F.when(F.col("chars") > 0, F.col("weight")).otherwise(F.lit(0.0)))
    totals = weighted.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("weight") > 0, F.lit(float(budget)) * (F.col("weight") / F.col("all_weight")) * F.col("all_chars") / F.col("chars")).otherwise(F.lit(0.0))
    return weighted.join(F.broadcast(totals)).select("source", "chars", rate.alias("rate"))


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, budget: float = 1.0, alpha: float = 0.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy", key_col: str = "mix_key", parts: int | None = None) -> DataFrame:
    """docs with copy (0, 1, ...) and mix_key, each document as often as drawn, dealt and sorted by mix_key.

    mix_key is md5 of seed, document and copy: reading files in order gives the mixed order. It is dealt to `parts` partitions
    (the session's number of shuffle partitions) of equal ranges.
    """
    docs = docs.drop(copy_col, key_col)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that its size is known when the join is planned
    space = Workspace(docs.sparkSession, "mix")
    rates = space.put(source_rates(docs, targets, budget, alpha, source_col, text_col), "rates").select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"))
    large = F.col("__mix_rate") > PART_RATE * BLOCK
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))

    def rated(own: DataFrame) -> DataFrame:
        return docs.join(own, F.coalesce(F.col(source_col), F.lit("")) == F.col("__mix_source")).withColumn("__mix_name", name)

    drawn = rated(rates.where(~large)).withColumn("__mix_n", poisson_count(F.col("__mix_name"), F.col("__mix_rate"))).withColumn("__mix_before", F.lit(0).cast("long"))
    if not rates.where(large).isEmpty():
        wide = rated(rates.where(large))
        blocks = drawn_blocks(space, wide.select(F.col("__mix_name").alias("name"), F.col("__mix_rate").alias("rate")))
        blocks = blocks.select(F.col("name").alias("__mix_name"), F.col("n").alias("__mix_n"), F.col("before").alias("__mix_before"))
        drawn = drawn.unionByName(wide.join(blocks, "__mix_name"))
    end = F.col("__mix_before") + F.col("__mix_n")
    blocks = drawn.where("__mix_n > 0").withColumn("__mix_from", F.explode(F.sequence(F.col("__mix_before"), end - 1, F.lit(BLOCK).cast("long"))))
    copies = blocks.withColumn(copy_col, F.explode(F.sequence(F.col("__mix_from"), F.least(F.col("__mix_from") + BLOCK, end) - 1)))
    keyed = copies.withColumn(key_col, F.md5(F.concat_ws("|", "__mix_name", F.col(copy_col).cast("string"))))
    keyed = keyed.drop("__mix_source", "__mix_rate", "__mix_name", "__mix_n", "__mix_before", "__mix_from")
    return keyed.repartitionById(parts, F.floor(hex_share(F.col(key_col)) * parts).cast("int")).sortWithinPartitions(key_col)
