"""Benchmark decontamination: short test items inside long documents, by containment MinHash.

Jaccard MinHash cannot see a 50-word item in a 10,000-word document, as the document's minima hide
the item's. Containment turns it round: only the item is sketched, by its k smallest shingle
hashes, and the sketch is looked up among a document's shingles; the share found estimates
|item and document| / |item|. Items are partitioned by size (powers of two); each partition has its
own k, the hits that a document needs, and a least document size, so that a document too short to
contain an item of the partition is not matched with it. The hits needed are the most that still
miss a true match with probability below ``miss``.

The search probes the sketches alone, so of all shingles only those that are in some sketch make a
row, and only documents and items with enough hits go on. These candidates are written; the
documents among them are read again and every candidate pair is verified by the exact share of the
item's distinct five-word shingles.

All of it is DataFrame functions. A table (sketches, candidates, the candidates' items) is broadcast
only when its measured size is below ``broadcast_rows``; beyond it both sides are shuffled, where
adaptive execution splits frequent keys.

Defined results: one row per (document id, text, item) at or over the threshold; rows of documents
that are repeated give one row; items that repeat an id are distinct by text; null and empty texts
and items of fewer than five words have no shingles and match nothing; empty tables give an empty
result. Extra columns are ignored by the report and kept by ``clean``, whatever their names. Words
are runs of letters and digits in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import text_of, written


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    sketch: int = 24
    miss: float = 1e-6
    broadcast_rows: int = 1_000_000


def hits_needed(k: int, settings: Settings) -> int:
    """The largest h with P(Binomial(k, threshold) < h) <= miss, at least 1."""
    tail, h = 0.0, 0
    while h < k:
        tail += comb(k, h) * settings.threshold**h * (1 - settings.threshold) ** (k - h)
        if tail > settings.miss:
            break
        h += 1
    return max(1, h)


def words(column: str) -> Column:
    return F.filter(F.split(F.lower(F.col(column)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingled(words_column: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    w = F.col(words_column)
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k if k else i) for k in range(size)]))
    return F.when(F.size(w) >= size, grams)


def item_table(items: DataFrame, settings: Settings) -> DataFrame:
    """(gram, item_id, item_hash, item_grams, sketched, needed, least): a row for each distinct shingle of each distinct item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").alias("__t")).select("item_id", F.xxhash64("__t").alias("item_hash"), words("__t").alias("__w")).dropDuplicates(["item_id", "item_hash"])
    grams = rows.withColumn("__g", F.array_distinct(shingled("__w", settings.words))).where(F.size("__g") > 0)
    k = F.least(F.size("__g"), F.lit(settings.sketch))
    partition = F.floor(F.log2(F.size("__g"))).cast("int")
    needed = F.element_at(F.array(*[F.lit(hits_needed(n, settings)) for n in range(1, settings.sketch + 1)]), k)
    least = F.ceil(F.lit(settings.threshold) * F.pow(F.lit(2.0), partition)).cast("int")
    return grams.select("item_id", "item_hash", F.size("__g").alias("item_grams"), needed.alias("needed"), least.alias("least"), k.alias("__k"), F.posexplode(F.array_sort("__g")).alias("__at", "gram")).select("gram", "item_id", "item_hash", "item_grams", (F.col("__at") < F.col("__k")).alias("sketched"), "needed", "least")


def small(table: DataFrame, settings: Settings) -> DataFrame:
    """The table, marked for broadcast if it is measured to be small."""
    return F.broadcast(table) if table.limit(settings.broadcast_rows + 1).count() <= settings.broadcast_rows else table


def texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("__t"))
    return rows.select("doc_id", F.xxhash64("__t").alias("__text_hash"), "__t")


def numbered(rows: DataFrame) -> DataFrame:
    """(doc_id, __text_hash, __w, __row) of texts().

    A row's shingles are in one task, so its number need only be unique in one attempt. The number also
    keeps the optimiser from splitting a text into words again for each shingle.
    """
    return rows.select("doc_id", "__text_hash", words("__t").alias("__w")).withColumn("__row", F.monotonically_increasing_id())


PAIR = ["doc_id", "__text_hash", "item_id", "item_hash", "item_grams"]


def searched(docs: DataFrame, table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, __text_hash, item_id, item_hash, item_grams): the pairs with enough hits in the item's sketch."""
    sketches = small(table.where("sketched"), settings)
    rows = numbered(texts(docs)).withColumn("__g", shingled("__w", settings.words))
    rows = rows.select("__row", "doc_id", "__text_hash", F.size("__g").alias("__size"), F.explode("__g").alias("gram"))
    found = rows.join(sketches, "gram").where(F.col("__size") >= F.col("least"))
    hits = found.groupBy("__row", *PAIR, "needed", "gram").agg(F.lit(1).alias("__one")).groupBy("__row", *PAIR, "needed").agg(F.count("*").alias("__hits"))
    return hits.where(F.col("__hits") >= F.col("needed")).select(*PAIR).distinct()


def contained(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, __text_hash, item_id, item_hash, shared, item_grams) with shared / item_grams >= threshold."""
    table = item_table(items, settings)
    pairs = written(searched(docs, table, settings))
    which = pairs.select(F.col("doc_id").alias("__id"), F.col("__text_hash").alias("__hash")).distinct()
    rows = texts(docs).join(small(which, settings), (F.col("__text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    rows = numbered(rows).select("__row", "doc_id", "__text_hash", F.explode(F.array_distinct(shingled("__w", settings.words))).alias("gram"))
    own = table.select("gram", "item_id", "item_hash").join(pairs.select(F.col("item_id").alias("__i"), F.col("item_hash").alias("__h")).distinct(), F.col("item_id").eqNullSafe(F.col("__i")) & (F.col("item_hash") == F.col("__h")), "left_semi")
    counts = rows.join(small(own, settings), "gram").groupBy("__row", "doc_id", "__text_hash", "item_id", "item_hash").agg(F.count("*").alias("shared"))
    counts = counts.select(F.col("doc_id").alias("__d"), F.col("__text_hash").alias("__t"), F.col("item_id").alias("__i"), F.col("item_hash").alias("__h"), "shared").distinct()
    match = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__text_hash") == F.col("__t")) & F.col("item_id").eqNullSafe(F.col("__i")) & (F.col("item_hash") == F.col("__h"))
    verified = pairs.join(counts, match).where(F.col("shared") >= F.lit(settings.threshold) * F.col("item_grams"))
    return verified.select("doc_id", "__text_hash", "item_id", "item_hash", "shared", F.col("item_grams").cast("long").alias("item_grams"))


def report(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, shared, item_grams, containment)."""
    return contained(docs, items, settings).select("doc_id", "item_id", "shared", "item_grams", F.round(F.col("shared") / F.col("item_grams"), 6).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that contain no item, with docs' own columns."""
    bad = contained(docs, items, settings).select(F.col("doc_id").alias("__bad_id"), F.col("__text_hash").alias("__bad_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("own"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text_of("text")).alias("__hash"))
    match = F.col("__id").eqNullSafe(F.col("__bad_id")) & (F.col("__hash") == F.col("__bad_hash"))
    return rows.join(bad, match, "left_anti").select(*[F.col(f"own.`{n}`").alias(n) for n in docs.columns])


def oracle(settings: Settings = Settings(), documents: str = "documents") -> str:
    """report() in DuckDB SQL: every document and item that share a shingle, counted exactly."""
    n = settings.words

    def grams(name: str, key: str) -> str:
        gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
        return f"""{name} AS (SELECT DISTINCT {key}, h, unnest([{gram} FOR i IN range(1, len(w) - {n - 2})]) AS gram FROM
            (SELECT {key}, md5(coalesce(text, '')) AS h, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {documents if key == 'doc_id' else 'benchmark'}) WHERE len(w) >= {n})"""

    return f"""
    WITH {grams("d", "doc_id")}, {grams("b", "item_id")},
    sizes AS (SELECT item_id, h, count(*) AS item_grams FROM b GROUP BY ALL),
    f AS (SELECT d.doc_id, d.h AS dh, b.item_id, b.h, count(*) AS shared FROM d JOIN b USING (gram) GROUP BY ALL)
    SELECT doc_id, item_id, shared, item_grams, round(shared / item_grams, 6) AS containment FROM f JOIN (SELECT item_id AS i, h AS k, item_grams FROM sizes) ON h = k AND item_id IS NOT DISTINCT FROM i
    WHERE shared >= {settings.threshold} * item_grams"""
