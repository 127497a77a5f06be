"""N-gram Jaccard join by MinHash banding.

Texts become sets of hashed five-word shingles. Texts with the same set are one class, so copies
are joined once. Each class has a MinHash signature cut into bands; the numbers of bands and rows
are chosen so that a pair at the threshold collides in some band with the target recall. Classes
are shuffled by band hash; a class that shares a band with another is a member of the cluster of
its smallest partner, the hub.

Clusters are dealt into blocks of bounded size by a hash, and the pairs of blocks that share a
band, each block with itself included, are verified: a task holds the full shingle sets of two
blocks and computes exact intersections, so what is checked contains all colliding pairs. No pair
of documents becomes a row: a block pair returns each class's number of linked documents and its
local root, and connected components of the roots give the classes' groups.

In a cluster of more than one block the exact Jaccard distance of each class to the hub is taken
first. It is a metric: two classes whose distances to the hub add up to no more than 1 - threshold
are linked. These links are counted by the distances' histogram, not by pairs; blocks hold classes
of like distance, and a pair of blocks is verified only if some of its sums are greater. A cluster
of near copies, however large, whose members lie within half of that of the hub, is counted in
linear time; what lies farther out is verified block against block.

Result: one row per document with its group's id (the smallest document id in it) and the number
of other documents linked to it, copies included.

Defined results: words are runs of letters, digits and underscores in lower case; a text of one to
four words is one shingle; texts without a word are linked to equal texts only, null being empty;
repeated rows are copies; null ids are grouped as any other and are a group's id only if it has no
other; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import checkpointed, extended, plainly_joined, text_of, written

WORD = re.compile(r"\w+")
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    rows: int = 5
    block: int = 256
    block_bytes: int = 1 << 24

    @property
    def limit(self) -> int:
        """The greatest distance of a linked pair, in thousandths."""
        return 1000 - ceil(self.threshold * 1000 - 1e-9)

    @property
    def bands(self) -> int:
        """The fewest bands with 1 - (1 - threshold^rows)^bands >= recall."""
        return ceil(log(1 - self.recall) / log(1 - self.threshold**self.rows))


class WordHashes(dict):
    """word -> 64-bit hash; forgets all at a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``words`` words."""
    tokens = WORD.findall(text.lower())
    if not tokens:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(ids))
    h = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        h = mixed(h ^ ids[k : k + len(h)])
    return np.unique(h)


class Signer:
    def __init__(self, settings: Settings):
        self.settings, self.hashes = settings, WordHashes()
        rng = np.random.default_rng(11)
        count = settings.bands * settings.rows
        self.factor = rng.integers(0, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, count, dtype=np.uint64)
        self.band = mixed(np.arange(1, settings.bands + 1, dtype=np.uint64))

    def minima(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 512):
            part = grams[at : at + 512, None] * self.factor + self.shift
            np.minimum(least, (part >> np.uint64(24)).min(0), out=least)
        return least

    def sign(self, text: str) -> tuple[bytes, list[int] | None]:
        """Class key, and band keys (None for a text without shingles)."""
        grams = shingles(text, self.settings.words, self.hashes)
        if not len(grams):
            return b"t" + xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")), None
        key = self.band.copy()
        for column in self.minima(grams).reshape(self.settings.bands, self.settings.rows).T:
            key = mixed(key ^ column)
        return b"s" + xxhash.xxh3_128_digest(grams.tobytes()), key.view(np.int64).tolist()


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text_hash, __text): own and text_hash tell a row's id and text; a null id's hash differs from that of id 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("__text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("own"), F.xxhash64("__text", F.col("doc_id").isNull()).alias("text_hash"), "__text")


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, own, text_hash, cls, bands) of every row."""

    def make():
        signer = Signer(settings)

        def work(part):
            return list(zip(*[signer.sign(t) for t in part.column("__text").to_pylist()])) or [[], []]

        return work

    return extended(keyed(docs), "cls binary, bands array<long>", make)


def packed(rows: DataFrame) -> DataFrame:
    """__text as zstandard frames in __z: what the join moves is about a third."""

    def make():
        press = zstandard.ZstdCompressor(level=1)
        return lambda part: [[press.compress(t) for t in part.column("__text").cast(pa.binary()).to_pylist()]]

    return extended(rows, "__z binary", make)


def shingle_sets(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows with the sorted shingle hashes, as bytes, for the packed texts."""

    def make():
        press, hashes = zstandard.ZstdDecompressor(), WordHashes()
        return lambda part: [[shingles(press.decompress(z).decode("utf-8", "surrogatepass"), settings.words, hashes).tobytes() for z in part.column("__z").to_pylist()]]

    return extended(rows, "grams binary", make, ("__z",))


def hub_distances(pairs: DataFrame) -> DataFrame:
    """rows with ``far``: the Jaccard distance of grams and hub_grams in thousandths, rounded up."""

    def make():
        def work(part):
            out = []
            for a, b in zip(part.column("grams").to_pylist(), part.column("hub_grams").to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                out.append(-(-1000 * (union - common) // union))
            return [out]

        return work

    return extended(pairs, "far int", make, ("grams", "hub_grams"))


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard >= threshold, by exact intersections.

    Shingles are numbered; those in two sets at least are taken in slices as 0/1 matrices, so the
    memory is (sets x slice), whatever the sets' sizes.
    """
    both = left if right is None else left + right
    sizes = np.array([len(s) for s in both])
    owner = np.repeat(np.arange(len(both)), sizes)
    values, code, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    place = np.cumsum(count > 1) - 1
    owner, code = owner[shared], place[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width, n = 4096, len(left)
    common = np.zeros((n, len(both) - (0 if right is None else n)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (low, low + width))
        ones = np.zeros((len(both), width), np.float32)
        ones[owner[a:b], code[a:b] - low] = 1
        common += ones[:n] @ (ones if right is None else ones[n:]).T
    union = sizes[:n, None] + (sizes if right is None else sizes[n:])[None, :] - common
    hit = common >= np.float32(threshold) * union - 1e-3
    exact = common.astype(np.int64) * 1000 >= round(threshold * 1000) * union.astype(np.int64)
    return hit & exact


def roots(matrix: np.ndarray) -> np.ndarray:
    """Smallest member of each row's connected component in a symmetric boolean matrix."""
    label = np.arange(len(matrix))
    while True:
        best = np.where(matrix, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, best)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def verified(members: DataFrame, settings: Settings) -> DataFrame:
    """(cls, links, root) from rows (p, q, block, cls, hub, far, copies, grams): each group is a pair of blocks.

    Pairs that the histogram of their cluster counts (``close`` below) join their roots, but add no links here.
    """

    def verify(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("cls", key=lambda c: c.map(bytes))
        alone = batch.p.iloc[0] == batch.q.iloc[0]
        side = np.zeros(len(batch), bool) if alone else (batch.block != batch.p).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in batch.grams]
        copies, names = batch.copies.to_numpy(np.int64), batch.cls.map(bytes).to_numpy()
        order = np.flatnonzero(~side)
        if alone:
            matrix = linked(sets, None, settings.threshold)
            np.fill_diagonal(matrix, False)
        else:
            other = np.flatnonzero(side)
            matrix = np.zeros((len(batch), len(batch)), bool)
            if len(order) and len(other):
                hit = linked([sets[i] for i in order], [sets[i] for i in other], settings.threshold)
                matrix[np.ix_(order, other)] = hit
                matrix[np.ix_(other, order)] = hit.T
        far, hub = batch.far.to_numpy(np.int64), np.unique(batch.hub.map(bytes).to_numpy(), return_inverse=True)[1]
        close = (far[:, None] + far[None, :] <= settings.limit) & (hub[:, None] == hub[None, :])
        links = (matrix & ~close) @ copies
        top = roots(matrix)
        keep = matrix.any(axis=1)
        return pd.DataFrame({"cls": names[keep], "links": links[keep], "root": names[top[keep]]})

    return members.groupBy("p", "q").applyInPandas(verify, "cls binary, links long, root binary")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the connected components of (cls, root) edges, by large-star and small-star steps.

    Each step is joins and minima only; the edges never number more than at the start, and the
    lineage is cut after each round. Frequent nodes are minima, so partial sums meet their rows.
    """
    now = edges.select(F.greatest("cls", "root").alias("u"), F.least("cls", "root").alias("v")).where(F.col("u") != F.col("v")).distinct()
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("__m")).select(F.col("u").alias("__u"), F.least("u", "__m").alias("__m"))
        large = plainly_joined(both, least, "u", "__u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("__m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("__m")).select(F.col("u").alias("__u"), "__m")
        joined = plainly_joined(large, down, "u", "__u")
        small = joined.select(F.col("v").alias("u"), F.col("__m").alias("v")).unionByName(down.select(F.col("__u").alias("u"), F.col("__m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(state) == before:
            return now.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        before = tuple(state)
    raise RuntimeError("components did not settle")


#: far of a class whose distance is not taken: more than any limit.
UNKNOWN = 1001


def placed(sets: DataFrame, settings: Settings) -> DataFrame:
    """(cls, hub, copies, far, ring, block) of the members in rows (cls, hub, copies, grams, size).

    far is known in clusters of more than one block; ring is the tenth of the limit that it lies in.
    """
    bound = F.greatest(F.ceil(F.count("*") / settings.block), F.ceil(F.sum("size") / settings.block_bytes))
    sizes = written(sets.groupBy("hub").agg(bound.alias("__parts")))
    large = sizes.where("__parts > 1").select(F.col("hub").alias("__hub"))
    hub_sets = sets.join(large, sets["cls"] == large["__hub"]).select("__hub", F.col("grams").alias("hub_grams"))
    far = written(hub_distances(plainly_joined(sets, hub_sets, "hub", "__hub").select("cls", "hub", "copies", "size", "grams", "hub_grams")))
    small = sets.join(sizes.where("__parts = 1"), "hub").select("cls", "hub", "copies", "size", F.lit(UNKNOWN).alias("far"))
    width = max(1, settings.limit // 10)
    ringed = small.unionByName(far).withColumn("ring", F.when(F.col("far") <= settings.limit, F.ceil(F.col("far") / width)).otherwise(UNKNOWN).cast("int"))
    parts = written(ringed.groupBy("hub", "ring").agg(bound.alias("__parts")))
    parts = parts.select(F.col("hub").alias("__hub"), F.col("ring").alias("__ring"), "__parts")
    joined = ringed.join(parts, (F.xxhash64("hub", "ring") == F.xxhash64("__hub", "__ring")) & (F.col("hub") == F.col("__hub")) & (F.col("ring") == F.col("__ring")))
    return joined.select("cls", "hub", "copies", "far", "ring", F.xxhash64("hub", "ring", F.pmod(F.xxhash64("cls"), "__parts")).alias("block"))


def close_links(places: DataFrame, settings: Settings) -> DataFrame:
    """(cls, links): for each class the documents of other classes whose distances to the hub tell that they are linked."""
    inner = places.where(F.col("far") <= settings.limit)
    counts = inner.groupBy("hub", "far").agg(F.sum("copies").alias("n")).groupBy(F.col("hub").alias("__hub")).agg(F.collect_list(F.struct("far", "n")).alias("__counts"))
    joined = plainly_joined(inner, counts, "hub", "__hub")
    within = F.aggregate(F.filter("__counts", lambda x: x["far"] + F.col("far") <= settings.limit), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    own = F.when(2 * F.col("far") <= settings.limit, F.col("copies")).otherwise(0)
    return joined.select("cls", (within - own).alias("links"))


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, own, text_hash, root, group_id, links) of every row."""
    signed = written(signatures(docs, settings))
    classes = signed.groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("own", "text_hash")).alias("__one"), F.any_value("bands").alias("bands"))
    banded = classes.where(F.col("bands").isNotNull()).select("cls", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.min("cls").alias("hub"), F.count("*").alias("__n")).where("__n > 1").select(F.col("band").alias("__band"), "hub")
    hubs = plainly_joined(banded, crowded, "band", "__band").select("band", "cls", "hub")
    # written, as all other tables here that are joined by their key, so that the join's sides are plain shuffles, which adaptive execution can split
    member = written(hubs.groupBy("cls").agg(F.min("hub").alias("hub")))
    wanted = member.join(classes.select("cls", "copies", "__one.own", "__one.text_hash"), "cls")
    # one row of each id and text, however often it is repeated
    texts = packed(keyed(docs).drop("doc_id")).groupBy("own", "text_hash").agg(F.first("__z").alias("__z"))
    sets = written(shingle_sets(texts.join(wanted, ["own", "text_hash"]).select("cls", "hub", "copies", "__z"), settings).withColumn("size", F.length("grams")))
    places = written(placed(sets, settings))
    blocks = places.select("block", "hub", "ring").distinct()
    width, limit = max(1, settings.limit // 10), settings.limit
    counted = lambda a, b: (F.col(a) + F.col(b)) * width <= limit  # noqa: E731  all sums of two rings are within the limit
    meet = hubs.select("band", "cls").join(places.select("cls", "block", "hub", "ring"), "cls").select("band", "block", "hub", "ring").distinct()
    many = meet.groupBy("band").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("band").alias("__band"))
    meet = plainly_joined(meet, many, "band", "__band").drop("__band")
    other = meet.select(F.col("band").alias("__band"), F.col("block").alias("q"), F.col("hub").alias("__hub"), F.col("ring").alias("__ring"))
    cross = plainly_joined(meet.withColumnRenamed("block", "p"), other, "band", "__band").where((F.col("p") < F.col("q")) & ~((F.col("hub") == F.col("__hub")) & counted("ring", "__ring"))).select("p", "q").distinct()
    cross = written(cross)
    alone = blocks.where(~counted("ring", "ring")).select("block")
    tasks = cross.select("p", "q", F.col("p").alias("block")).unionByName(cross.select("p", "q", F.col("q").alias("block"))).unionByName(alone.select(F.col("block").alias("p"), F.col("block").alias("q"), "block"))
    members = places.join(sets.select("cls", "grams"), "cls").select("block", "cls", "hub", "far", "copies", "grams")
    found = written(verified(members.join(tasks, "block").select("p", "q", "block", "cls", "hub", "far", "copies", "grams"), settings))
    links = found.select("cls", "links").unionByName(close_links(places, settings)).groupBy("cls").agg(F.sum("links").alias("links"))
    root = components(found.select("cls", "root").unionByName(places.where(F.col("far") <= limit).select("cls", F.col("hub").alias("root"))))
    named = classes.select("cls", "copies", "first_id").join(links, "cls", "left").join(root, "cls", "left").select("cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "first_id", F.coalesce("root", "cls").alias("root"))
    first = named.groupBy("root").agg(F.min("first_id").alias("group_id")).withColumnRenamed("root", "__root")
    named = plainly_joined(named, first, "root", "__root").select("cls", "links", "group_id", "root")
    return signed.select("doc_id", "own", "text_hash", "cls").join(named, "cls").select("doc_id", "own", "text_hash", "root", "group_id", "links")


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, n_links) of every row."""
    return groups(docs, settings).select("doc_id", F.col("group_id").alias("class_id"), F.col("links").cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each group, the smallest id's, with docs' own columns."""
    first = groups(docs, settings).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own", "text_hash")).alias("__one"))
    chosen = first.select("__one.own", "__one.text_hash")
    text = text_of("text")
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("__row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("own"), F.xxhash64(text, F.col("doc_id").cast("long").isNull()).alias("text_hash"))
    kept = rows.join(chosen, ["own", "text_hash"], "left_semi").dropDuplicates(["own", "text_hash"])
    return kept.select(*[F.col(f"__row.`{n}`").alias(n) for n in docs.columns])


def oracle(settings: Settings = Settings(), documents: str = "documents") -> str:
    """report() in DuckDB SQL: exact Jaccard of all rows that share a shingle, closed by recursion."""
    n = settings.words
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
    WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {documents}),
    g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= {n} THEN [{gram} FOR i IN range(1, len(w) - {n - 2})] WHEN len(w) > 0 THEN [len(w) || ':' || array_to_string(w, ' ')] ELSE [] END) AS gram FROM t),
    s AS (SELECT r, count(*) AS size FROM g GROUP BY r),
    p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r GROUP BY ALL),
    links AS (SELECT a, b FROM p JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE common >= {settings.threshold} * (x.size + y.size - common)
              UNION SELECT x.r, y.r FROM t x JOIN t y ON x.text = y.text AND x.r <> y.r AND len(x.w) = 0),
    reach(a, b) AS (SELECT r, r FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    root AS (SELECT reach.a, min(t.doc_id) AS class_id FROM reach JOIN t ON t.r = reach.b GROUP BY reach.a)
    SELECT t.doc_id, root.class_id, (SELECT count(*) FROM links WHERE links.a = t.r)::BIGINT AS n_links FROM t JOIN root ON root.a = t.r"""
