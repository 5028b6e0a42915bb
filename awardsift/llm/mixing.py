"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents fall into cells of source, language and topic. The cells' token weights are raked to the three target marginals in
turn, and no cell may ever get more weight than its tokens allow when a share ``KEEP`` of all tokens is to be kept. A
cell's calibrated probability is its raked weight over its share of the tokens, and each document is kept with that probability
by a hash of its id. The kept tokens then have the target marginals, up to sampling.

A marginal's target is a power or a table. With a power every value is a class of its own and its target is its token sum to that
power, whatever the values are called: 1 leaves the shares as they are, 0 makes all equal. With a table the classes are those it
names plus ``other``; a class that it leaves out gets nothing. Where a class has fewer tokens than its target asks for, it gives all it
has, and the other classes of the marginal fill up in proportion to their targets (``shares``).

Up to ``FEW`` cells are raked in one task. Beyond, each step sums the weights of a marginal's classes and joins the sums with
the cells, both as tables; the results agree up to rounding in the last digits.

Defined results: null sources and languages are ``other``; texts without words (null, empty) carry no weight, have
probability 0 and are not kept; repeated rows share their fate; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import broadcast_if_small
from .data import SQL_SPACED, only, query, store, table

OTHER = "other"
SWEEPS = 12
#: Share of all tokens to keep.
KEEP = 0.7
SEED = "mix-1"
#: Every source, language and topic by the root of its tokens, halfway between their own shares and equal ones.
TEMPERED = {"source": 0.5, "lang": 0.5, "topic": 0.5}
#: Most cells that one task rakes.
FEW = 100_000
Targets = dict[str, dict[str, float] | float]
_WORD = r"[^\x20\x09-\x0D]+"
#: Topic by the form of a text: symbols per word, digits per word, words per line.
_MARKED, _FIGURES, _LISTS = 5, 4, 6


def tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD)).cast("long")


def topic(text: str = "text") -> Column:
    """What a text is about, by form: marked up, full of figures, lists of short lines, or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    symbols, digits, breaks = (F.regexp_count(t, F.lit(x)) for x in (r"[#*$%&|<>{}]", "[0-9]", r"\n"))
    count = F.col("_tokens")
    return (
        F.when(symbols * _MARKED > count, "marked").when(digits * _FIGURES > count, "figures")
        .when(count < (breaks + 1) * _LISTS, "lists").otherwise("prose")
    )


def classes(docs: DataFrame, targets: Targets) -> DataFrame:
    """Documents with ``_tokens`` and a class column ``_<marginal>`` for each marginal."""
    def named(column: str) -> Column:
        if not isinstance(targets[column], dict):
            return F.coalesce(F.col(column), F.lit(OTHER))
        return F.when(F.col(column).isin(list(targets[column])), F.col(column)).otherwise(F.lit(OTHER))
    counted = docs.withColumn("_tokens", tokens())
    return counted.withColumns({"_source": named("source"), "_lang": named("lang"), "_topic": topic()})


def shares(cells: DataFrame, name: str, target: dict[str, float] | float, total: int) -> DataFrame:
    """``name``, ``t<name>``: what each class is to get, at most what it has, 1 in all.

    Targets are raised by one common factor until those that are not held back by their tokens make up for those that are. Each
    round is one sum over the classes and a Newton step for the factor, which only grows.
    """
    wanted = cells.groupBy(name).agg(F.sum("tokens").alias("tokens"))
    if isinstance(target, dict):
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in target.items() for x in pair]), F.col(name)), F.lit(0.0))
    else:
        raw = F.pow(F.col("tokens").cast("double"), F.lit(float(target)))
    most = F.col("tokens").cast("double") / F.lit(float(total)) / F.lit(KEEP)
    wanted = store(wanted.select(name, raw.alias("t"), most.alias("all")))
    factor, seen = 0.0, -1
    while True:
        held = F.col("t") * factor >= F.col("all")
        n, given, rest = wanted.agg(F.count_if(held), F.sum(F.when(held, F.col("all"))), F.sum(F.when(~held, F.col("t")))).first()
        if n == seen or not rest:
            break
        factor, seen = (1 - (given or 0.0)) / rest, n
    return wanted.select(name, F.least(F.col("t") * factor, F.col("all")).alias(f"t{name}"))


def rake(cells: DataFrame, targets: Targets, sweeps: int = SWEEPS, few: int = FEW) -> DataFrame:
    """Cells (class columns, ``tokens``) with ``probability``; cells without tokens are left out."""
    cells = store(cells.where("tokens > 0"))
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    marginals = [f"_{name}" for name in targets]
    share = F.col("tokens").cast("double") / F.lit(float(total or 1))
    raked = cells.select(*marginals, share.alias("w"), (share / F.lit(KEEP)).alias("most"))
    if n <= few:
        raked = raked.coalesce(1)  # every window stays in this task
    for name, target in targets.items():
        raked = raked.join(broadcast_if_small(shares(cells, f"_{name}", target, total or 1)), f"_{name}")

    def step(sums: Column, name: str) -> Column:
        return F.least(F.coalesce(F.try_divide(F.col("w") * F.col(f"t{name}"), sums), F.lit(0.0)), F.col("most"))

    for _ in range(sweeps):
        for name in marginals:
            if n <= few:
                raked = raked.withColumn("w", step(F.sum("w").over(W.partitionBy(name)), name))
            else:
                raked = store(raked)
                sums = broadcast_if_small(store(raked.groupBy(name).agg(F.sum("w").alias("_sum"))))
                raked = raked.join(sums, name).withColumn("w", step(F.col("_sum"), name)).drop("_sum")
    return raked.select(*marginals, (F.col("w") / F.col("most")).alias("probability"))


def mix(docs: DataFrame, targets: Targets = TEMPERED, sweeps: int = SWEEPS, seed: str = SEED, few: int = FEW) -> DataFrame:
    """Documents with ``n_tokens``, ``source_class``, ``lang_class``, ``topic``, ``probability`` and ``kept``; other columns stay.

    Two passes over the texts: one sums tokens by cell, one looks up each document's cell.
    """
    docs = docs.drop("n_tokens", "source_class", "lang_class", "topic", "probability", "kept")
    classed = classes(docs, targets)
    cells = classed.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))
    raked = broadcast_if_small(store(rake(cells, targets, sweeps, few)))
    found = classed.join(raked, ["_source", "_lang", "_topic"], "left")
    chance = F.when(F.col("_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("_tokens").alias("n_tokens"), F.col("_source").alias("source_class"),
        F.col("_lang").alias("lang_class"), F.col("_topic").alias("topic"), chance.alias("probability"), (draw < chance).alias("kept"),
    )


def sample(docs: DataFrame, targets: Targets = TEMPERED) -> DataFrame:
    """The kept documents, with their own columns."""
    flagged = mix(docs.select(*[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(docs.columns)],
                              *[F.col(c) for c in ("doc_id", "text", "source", "lang")]), targets)
    return flagged.where("kept").select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(docs.columns)])


def _sql() -> str:
    count = "len(regexp_extract_all({0}, '{1}'))"
    wanted, steps, last = [], [], "s0"
    for name, power in TEMPERED.items():
        up = f"(ORDER BY own / t, _{name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        down = f"(ORDER BY own / t, _{name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        wanted.append(f"""
a_{name} AS (SELECT _{name}, sum(tokens) / (SELECT sum(tokens) FROM cells) / {KEEP}::DOUBLE AS own, pow(sum(tokens), {power}::DOUBLE) AS t FROM cells GROUP BY ALL),
b_{name} AS MATERIALIZED (SELECT *, own * sum(t) OVER {down} <= t * (1 - coalesce(sum(own) OVER {up}, 0)) AS held FROM a_{name}),
w_{name} AS MATERIALIZED (SELECT _{name}, least(own, t * (SELECT (1 - coalesce(sum(own) FILTER (held), 0)) / sum(t) FILTER (NOT held) FROM b_{name})) AS t_{name} FROM b_{name}),""")
    for k in range(SWEEPS * 3):
        name = list(TEMPERED)[k % 3]
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT * REPLACE (least(w * t_{name} / sum(w) OVER (PARTITION BY _{name}), most) AS w) FROM {last})")
        last = f"s{k + 1}"
    return rf"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS x, source, lang FROM documents),
counted AS (SELECT *, len({SQL_SPACED.format("x")})::BIGINT AS n FROM raw),
classed AS (SELECT doc_id, n, coalesce(source, '{OTHER}') AS _source, coalesce(lang, '{OTHER}') AS _lang,
  CASE WHEN {count.format("x", "[#*$%&|<>{}]")} * {_MARKED} > n THEN 'marked' WHEN {count.format("x", "[0-9]")} * {_FIGURES} > n THEN 'figures'
       WHEN n < ({count.format("x", chr(92) + "n")} + 1) * {_LISTS} THEN 'lists' ELSE 'prose' END AS _topic FROM counted),
cells AS MATERIALIZED (SELECT _source, _lang, _topic, sum(n)::DOUBLE AS tokens FROM classed GROUP BY ALL HAVING sum(n) > 0),{"".join(wanted)}
s0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS w, tokens / sum(tokens) OVER () / {KEEP}::DOUBLE AS most
  FROM cells JOIN w_source USING (_source) JOIN w_lang USING (_lang) JOIN w_topic USING (_topic)),
{", ".join(steps)},
p AS (SELECT _source, _lang, _topic, w / most AS probability FROM {last}),
found AS (SELECT *, CASE WHEN n > 0 THEN coalesce(probability, 0) ELSE 0 END AS chance FROM classed LEFT JOIN p USING (_source, _lang, _topic))
SELECT doc_id, n AS n_tokens, _source AS source_class, _lang AS lang_class, _topic AS topic, round(chance::DOUBLE, 9) AS probability,
       ('0x' || substr(md5('{SEED}' || coalesce(':' || doc_id, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < chance AS kept
FROM found"""


@query(sql=_sql())
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(only(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "n_tokens", "source_class", "lang_class", "topic", F.round("probability", 9).alias("probability"), "kept")
