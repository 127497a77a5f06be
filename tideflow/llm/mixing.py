"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over the cells source x language x topic. Cell masses are raked: scaled to the
target share of each source, then of each language, then of each topic, again and again until every
share is within ``tolerance`` of its target. The ratio of a cell's raked mass to its tokens is its
weight. Weights have no bound, so that the targets are met. The largest weight has probability 1,
the others in proportion, and a document is drawn if a hash of its id lies below its probability:
the expected token shares of the sample are the raked ones. ``marginals`` tells for each category
its observed, target and reached share; targets that no weights can meet (a source all of whose
cells another target empties) show there as a difference, after ``rounds`` rounds.

A topic is the field whose word stems a text has most of, the first of those that tie; a text
without any is told by its form.

Targets are shares by category; by default each category's observed share to the power ``flatten``,
normalised. Categories below ``least_share`` are raised by the same factor as one of that share, so that
a category of a few documents does not set the largest weight, and with it how little is drawn. A category that explicit targets do not name keeps its observed share, and the shares
are normalised to 1.

Defined results: null source and language are the category ``(none)``; a document without tokens
counts as one token, so that it has a cell; a null id is drawn by the empty id's hash; repeated
rows are drawn together; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import checkpointed, text_of

DIMENSIONS = ("source", "lang", "topic")

# Word stems of each field, in English, German, French and Spanish, in the order of the fields.
TOPICS = {
    "law": "licen copyright warrant liabil contract court lizenz urheber vertrag gericht garantie droit tribunal derecho",
    "software": "software source code algorithm comput program data server quellcode programm rechner logiciel ordinateur servidor",
    "commerce": "price market custom invoice payment kunde markt rechnung marché client facture mercado cliente factura precio",
    "science": "theor experiment molecul quantum equation physic chemi biolog wissenschaft versuch théor expérience teoría científic",
    "health": "patient doctor disease medicin hospital therap krankheit arzt gesund maladie médecin santé enfermedad salud médico",
    "politics": "government election president parliament minister regierung wahlen gouvernement élection gobierno elección presiden",
    "sport": "football champion tournament athlet olympic fußball meister mannschaft joueur équipe fútbol jugador torneo",
    "school": "question answer student teacher examin schule lehrer antwort école élève réponse escuela alumno respuesta pregunta",
}


@dataclass(frozen=True)
class Settings:
    """most_cells: the largest cell table that is raked on the driver and broadcast; beyond it Spark rakes and joins."""

    flatten: float = 0.7
    least_share: float = 0.01
    rounds: int = 200
    tolerance: float = 1e-13
    seed: str = "mix"
    most_cells: int = 50_000
    targets: dict[str, dict[str, float]] = field(default_factory=dict)


def stems() -> str:
    """A pattern with one group: a stem at a word's start, longer ones first, as the first that fits is taken.

    Stems are gathered by their first letter, so that few alternatives are tried at a word.
    """
    all_stems = {x for field in TOPICS.values() for x in field.split()}
    by_letter = {c: sorted((x[1:] for x in all_stems if x[0] == c), key=lambda x: (-len(x), x)) for c in sorted({x[0] for x in all_stems})}
    return "[^a-zß-ÿ](" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


def topic(text: Column, words: Column) -> Column:
    """The topic from the text and from the stems found in it."""
    def count(field: str) -> Column:
        return F.size(F.filter(words, lambda x: x.isin(*field.split())))

    counts = [count(field) for field in TOPICS.values()]
    most = F.greatest(*counts)
    form = F.when(text.contains(" | "), "table").when(text.contains("@") | text.contains("http"), "contact").when(text.contains("!!"), "shout").otherwise("prose")
    out = F.when(F.size(words) == 0, form)
    for name, n in zip(TOPICS, counts):
        out = out.when(n == most, name)
    return out.otherwise(form)  # never null, so that a join on it does not compute it twice to test that


def celled(docs: DataFrame) -> DataFrame:
    """docs with the cell columns __source, __lang, __topic and __tokens."""
    text = text_of("text")
    rows = docs.withColumn("__words", F.regexp_extract_all(F.concat(F.lit(" "), F.lower(text)), F.lit(stems()), F.lit(1)))
    return rows.withColumns(
        {
            "__source": F.coalesce(F.col("source").cast("string"), F.lit("(none)")),
            "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("(none)")),
            "__topic": topic(text, F.col("__words")),
            "__tokens": F.greatest(F.lit(1), F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+"))).cast("long"),
        }
    ).drop("__words")


def shares(observed: dict[str, float], wanted: dict[str, float] | None, settings: Settings) -> dict[str, float]:
    total = sum(observed.values())
    flat = lambda share: share * max(share, settings.least_share) ** (settings.flatten - 1)
    raw = {k: (wanted.get(k, v / total) if wanted else flat(v / total)) for k, v in observed.items()}
    norm = sum(raw.values())
    return {k: v / norm for k, v in raw.items()}


def flattened(share: str, settings: Settings) -> Column:
    return F.col(share) * F.pow(F.greatest(F.col(share), F.lit(settings.least_share)), F.lit(settings.flatten - 1))


def rake(cells: list[tuple[str, str, str, int]], settings: Settings) -> np.ndarray:
    """Weights of the cells (source, lang, topic, tokens), in order."""
    tokens = np.array([c[3] for c in cells], float)
    mass = tokens / tokens.sum()
    codes, wanted = [], []
    for j, name in enumerate(DIMENSIONS):
        values, code = np.unique(np.array([c[j] for c in cells], dtype=object), return_inverse=True)
        observed = dict(zip(values, np.bincount(code, tokens)))
        share = shares(observed, settings.targets.get(name), settings)
        codes.append(code)
        wanted.append(np.array([share[v] for v in values]))
    base = mass.copy()
    for _ in range(settings.rounds):
        for code, share in zip(codes, wanted):
            mass = mass * share[code] / np.bincount(code, mass, len(share))[code]
        if max(np.abs(np.bincount(code, mass, len(share)) - share).max() for code, share in zip(codes, wanted)) < settings.tolerance:
            break
    return mass / base


def rake_frame(cells: DataFrame, settings: Settings) -> DataFrame:
    """rake() for cell tables of any size: cells with __weight. Cuts lineage after each round."""
    total = float(cells.agg(F.sum("__tokens")).first()[0])
    frame = cells.withColumn("__base", F.col("__tokens") / F.lit(total)).withColumn("__mass", F.col("__base"))
    for name in DIMENSIONS:
        observed = cells.groupBy(f"__{name}").agg((F.sum("__tokens") / F.lit(total)).alias("__share"))
        wanted = settings.targets.get(name)
        if wanted:
            table = F.create_map(*[F.lit(x) for k, v in sorted(wanted.items()) for x in (k, float(v))])
            raw = F.coalesce(F.try_element_at(table, F.col(f"__{name}")), F.col("__share"))
        else:
            raw = flattened("__share", settings)
        observed = observed.withColumn("__raw", raw)
        norm = float(observed.agg(F.sum("__raw")).first()[0])
        frame = frame.join(observed.select(f"__{name}", (F.col("__raw") / F.lit(norm)).alias(f"__want_{name}")), f"__{name}")
    frame = checkpointed(frame)
    for _ in range(settings.rounds):
        for name in DIMENSIONS:
            sums = frame.groupBy(f"__{name}").agg(F.sum("__mass").alias("__now"))
            frame = frame.join(sums, f"__{name}").withColumn("__mass", F.col("__mass") * F.col(f"__want_{name}") / F.col("__now")).drop("__now")
        frame = checkpointed(frame)
        gaps = [frame.groupBy(f"__want_{n}", f"__{n}").agg(F.sum("__mass").alias("__now")).select(F.abs(F.col("__now") - F.col(f"__want_{n}")).alias("gap")) for n in DIMENSIONS]
        if gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).agg(F.max("gap")).first()[0] < max(settings.tolerance, 1e-11):
            break
    return frame.select("__source", "__lang", "__topic", (F.col("__mass") / F.col("__base")).alias("__weight"))


def drawn(column: str, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def weighed(cells: DataFrame, settings: Settings) -> tuple[DataFrame, bool]:
    """cells (__source, __lang, __topic, __tokens) with __weight and __probability, and whether they are few."""
    got = cells.limit(settings.most_cells + 1).collect()
    if len(got) > settings.most_cells:
        weights = rake_frame(cells, settings)
        return weights.withColumn("__probability", F.col("__weight") / F.lit(float(weights.agg(F.max("__weight")).first()[0]))), False
    got = sorted(tuple(r) for r in got)
    weight = rake(got, settings) if got else np.zeros(0)
    table = [(*c[:3], float(w), float(w / weight.max())) for c, w in zip(got, weight)]
    return cells.sparkSession.createDataFrame(table, "__source string, __lang string, __topic string, __weight double, __probability double"), True


def mixed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (own, __source, __lang, __topic, __tokens, __weight, __probability, __sampled); own holds docs' columns, whatever their names."""
    rows = celled(docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("own"), "doc_id", "source", "lang", "text")).drop("source", "lang", "text")
    keys = ["__source", "__lang", "__topic"]
    weights, few = weighed(rows.groupBy(*keys).agg(F.sum("__tokens").alias("__tokens")), settings)
    joined = rows.join(F.broadcast(weights) if few else weights, keys)
    return joined.withColumn("__sampled", drawn("doc_id", settings.seed) < F.col("__probability"))


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, sampled) of every row."""
    return mixed(docs.select("doc_id", "source", "lang", "text"), settings).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__weight", 6).alias("weight"), F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled")
    )


def sample(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The drawn rows, with docs' own columns."""
    return mixed(docs, settings).where("__sampled").select(*[F.col(f"own.`{n}`").alias(n) for n in docs.columns])


def marginals(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(dimension, category, observed, target, reached): token shares of the input, as wanted and as the weights give them."""
    cells = celled(docs.select("doc_id", "source", "lang", "text")).groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("__tokens"))
    weights, _ = weighed(cells, settings)
    both = cells.join(weights, ["__source", "__lang", "__topic"])
    out = None
    for name in DIMENSIONS:
        part = both.groupBy(F.col(f"__{name}").alias("category")).agg(F.sum("__tokens").alias("__n"), F.sum(F.col("__tokens") * F.col("__weight")).alias("__m"))
        total = part.agg(F.sum("__n").alias("__total"), F.sum("__m").alias("__mass"))
        part = part.join(F.broadcast(total)).select(F.lit(name).alias("dimension"), "category", (F.col("__n") / F.col("__total")).alias("observed"), (F.col("__m") / F.col("__mass")).alias("reached"))
        wanted = settings.targets.get(name)
        if wanted:
            raw = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in sorted(wanted.items()) for x in (k, float(v))]), F.col("category")), F.col("observed"))
        else:
            raw = flattened("observed", settings)
        part = part.withColumn("__raw", raw)
        norm = part.agg(F.sum("__raw").alias("__norm"))
        part = part.join(F.broadcast(norm)).select("dimension", "category", "observed", (F.col("__raw") / F.col("__norm")).alias("target"), "reached")
        out = part if out is None else out.unionByName(part)
    return out


def oracle(rounds: int = 40, settings: Settings = Settings(), source: str = "documents") -> str:
    """report() in DuckDB SQL for the default targets: enough rounds to meet them are written out."""
    steps, now = [], "m0"
    for k in range(rounds):
        for name in DIMENSIONS:
            to = f"m{k}_{name}"
            steps.append(f"{to} AS MATERIALIZED (SELECT * REPLACE (mass * want_{name} / sum(mass) OVER (PARTITION BY {name}) AS mass) FROM {now})")
            now = to
    wants = ", ".join(f"w_{n} AS (SELECT {n}, r / sum(r) OVER () AS want_{n} FROM (SELECT {n}, share * pow(greatest(share, {settings.least_share}), {settings.flatten - 1}) AS r FROM (SELECT {n}, sum(tokens) / (SELECT sum(tokens) FROM cells) AS share FROM cells GROUP BY {n})))" for n in DIMENSIONS)
    counts = ", ".join("len(list_filter(words, lambda x: x IN (" + ", ".join(f"'{x}'" for x in field.split()) + "))) AS n_" + name for name, field in TOPICS.items())
    most = "greatest(" + ", ".join(f"n_{name}" for name in TOPICS) + ")"
    fields = " ".join(f"WHEN n_{name} = {most} THEN '{name}'" for name in TOPICS)
    return f"""
    WITH t AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text,
        regexp_extract_all(' ' || lower(coalesce(text, '')), '{stems()}', 1) AS words FROM {source}),
    c AS (SELECT *, {counts} FROM t),
    d AS (SELECT doc_id, source, lang, CASE WHEN len(words) = 0 THEN CASE WHEN contains(text, ' | ') THEN 'table'
             WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact' WHEN contains(text, '!!') THEN 'shout' ELSE 'prose' END {fields} END AS topic,
        greatest(1, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')))::BIGINT AS tokens FROM c),
    cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL), {wants},
    m0 AS (SELECT source, lang, topic, tokens / (SELECT sum(tokens) FROM cells) AS base, tokens / (SELECT sum(tokens) FROM cells) AS mass, want_source, want_lang, want_topic
           FROM cells JOIN w_source USING (source) JOIN w_lang USING (lang) JOIN w_topic USING (topic)), {", ".join(steps)},
    p AS (SELECT source, lang, topic, mass / base AS weight, (mass / base) / max(mass / base) OVER () AS probability FROM {now})
    SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{settings.seed}'), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)} < probability AS sampled
    FROM d JOIN p USING (source, lang, topic)"""
