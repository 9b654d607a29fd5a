"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

DataFrame functions alone; the only rows that meet in one task are those of the cell table, whose
size is the number of combinations of source, language and topic, at most CELLS_PER_TASK a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorlode.llm.common import checkpointed, small

#: Exponent of each margin: its target shares are the present ones to this power, made to sum to 1.
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Share of all tokens that the sample has.
BUDGET = 0.6
SWEEPS, SWEEPS_AT_ONCE, TOLERANCE = 60, 6, 1e-9
SEED = "mix-1"
CELLS_PER_TASK = 1_000_000
#: What a null margin value is called among the cells.
NONE = "(none)"


def topic_of(text):
    """A topic by the text's form: tables, licences, snippets, long reads and plain prose."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("License")), "license").when(words < 50, "snippet").when(words > 1000, "long").otherwise("prose")


def new_names(columns: list[str]) -> dict[str, str]:
    """Names of the columns that mix() adds: mix_source and so on, with underscores where a column has that name."""
    out = {}
    for name in ("source", "lang", "topic", "tokens", "rate", "kept"):
        out[name] = f"mix_{name}"
        while out[name] in columns:
            out[name] += "_"
    return out


def with_cells(docs: DataFrame, text: str = "text", topic=None) -> DataFrame:
    """`docs` with source, lang, topic and tokens (words) under new_names; nulls are named NONE, null texts empty."""
    whole, names = F.coalesce(F.col(text), F.lit("")), new_names(docs.columns)
    margin = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return docs.withColumns({names["source"]: margin(F.col("source")), names["lang"]: margin(F.col("lang")), names["topic"]: margin(topic_of(whole) if topic is None else topic), names["tokens"]: F.regexp_count(whole, F.lit(r"\S+")).cast("long")})


def cell_table(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Tokens of each cell of with_cells(); the only shuffle of corpus size, after a sum on the map side."""
    return docs.groupBy(*(F.col(names[d]).alias(d) for d in ("source", "lang", "topic"))).agg(F.sum(names["tokens"]).cast("double").alias("base")).where("base > 0")


def filled(rows: DataFrame, key: str, budget: float = BUDGET) -> DataFrame:
    """(key, goal) of `rows` (key, base, share): tokens to draw of each, `budget` times all in total.

    They are in proportion to the shares, but for values that have fewer tokens: these go whole, and
    the others make up for them. goal = min(base, x share); x follows from what the whole ones leave.
    """
    order = Window.partitionBy().orderBy((F.col("share") / F.col("base")).desc(), key)
    upto, all_ = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("base").over(all_) * budget - F.sum("base").over(upto) + F.col("base")
    rest = F.sum("share").over(all_) - F.sum("share").over(upto) + F.col("share")
    x = rows.withColumn("x", left / F.greatest(rest, F.lit(1e-300)))
    x = x.withColumn("x", F.first(F.when(F.col("x") * F.col("share") < F.col("base"), F.col("x")), ignorenulls=True).over(all_))
    return x.select(key, F.when(F.col("x").isNull(), F.col("base")).otherwise(F.least("base", F.col("x") * F.col("share"))).alias("goal"))


def rake(cells: DataFrame, temperatures: dict[str, float] = TEMPERATURES, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(`cells` (a column for each margin, base) with goals and weight, largest miss of a margin left).

    The weight is the tokens to draw of a cell. Cells of a value that goes whole go whole, and the
    others make up the rest of the goals. Their weight starts as all they have, and one margin after
    the other is scaled to its goals, no cell beyond what it has, until the largest miss, relative to
    all tokens drawn, is below the tolerance, falls by less than half in SWEEPS_AT_ONCE sweeps (goals
    that can't be met together), or for `sweeps` at most. Goals (see filled) follow
    `targets` (margin: a table (margin, share); values that aren't in it get nothing), else the
    present shares to the power in `temperatures`.
    """
    cells = checkpointed(cells)
    tasks = max(1, -(-cells.count() // CELLS_PER_TASK))
    whole = F.lit(False)
    for d, power in temperatures.items():
        margin = cells.groupBy(d).agg(F.sum("base").alias("base"))
        if targets and d in targets:
            margin = margin.join(targets[d].groupBy(d).agg(F.sum("share").alias("share")), d, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        else:
            margin = margin.withColumn("share", F.pow("base", F.lit(power)))
        goals = filled(margin, d, budget).join(margin.select(d, F.col("base").alias("all")), d)
        goals = goals.select(d, F.col("goal").alias(f"goal_{d}"), (F.col("goal") >= F.col("all") * (1 - 1e-12)).alias(f"whole_{d}"))
        cells, whole = cells.join(small(goals), d), whole | F.col(f"whole_{d}")
    cells = checkpointed(cells.withColumn("whole", whole).withColumn("weight", F.col("base")).repartition(tasks))
    given = {d: F.sum(F.when(F.col("whole"), F.col("base")).otherwise(0.0)).over(Window.partitionBy(d)) for d in temperatures}
    cells = cells.withColumns({f"rest_{d}": F.greatest(F.lit(0.0), F.col(f"goal_{d}") - given[d]) for d in temperatures})
    all_tokens, all_cells = cells.agg(F.sum("base")).first()[0] or 0.0, cells
    cells = checkpointed(cells.where("not whole").select(*temperatures, "base", "weight", *(f"rest_{d}" for d in temperatures)))
    missed = 0.0
    for k in range(0, sweeps, SWEEPS_AT_ONCE):
        cells = cells.coalesce(1) if tasks == 1 else cells  # then no window below shuffles
        for _ in range(SWEEPS_AT_ONCE):
            for d in temperatures:
                total = F.sum("weight").over(Window.partitionBy(d).orderBy(*temperatures).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                cells = cells.withColumn("weight", F.least("base", F.col("weight") * F.coalesce(F.try_divide(F.col(f"rest_{d}"), total), F.lit(0.0))))
        cells = checkpointed(cells)
        was, missed = missed, 0.0
        for d in temperatures:
            miss = cells.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"rest_{d}")).alias("m")).agg(F.max("m")).first()[0]
            missed = max(missed, (miss or 0.0) / max(1.0, all_tokens * budget))
        if missed < tolerance or was and missed > was / 2:
            break
    raked = cells.select(*temperatures, F.col("weight").alias("raked"))
    goals = [f"goal_{d}" for d in temperatures]
    return all_cells.join(small(raked), list(temperatures), "left").select(*temperatures, "base", *goals, F.coalesce("raked", "base").alias("weight")), missed


def draw(key, seed: str = SEED):
    """A uniform number in [0, 1) for each key, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", temperatures: dict[str, float] = TEMPERATURES, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, topic=None) -> DataFrame:
    """`docs` with mix_source, mix_lang, mix_topic, mix_tokens, mix_rate and mix_kept (see new_names).

    Each document of a cell is drawn at its rate: the cell's raked weight over its tokens. `topic` is
    a column, else topic_of the text; `targets` as for rake. Null margin values form cells of their
    own, documents without words are drawn like their cell, or always if it has no words at all;
    rows of one key share their draw. All rows and columns stay, whatever the columns are called.
    """
    names = new_names(docs.columns)
    docs = with_cells(docs, text, topic)
    cells, _ = rake(cell_table(docs, names), temperatures, budget, targets)
    margins = [names[d] for d in ("source", "lang", "topic")]
    rates = checkpointed(cells.select(*(F.col(d).alias(names[d]) for d in ("source", "lang", "topic")), (F.col("weight") / F.col("base")).alias(names["rate"])))
    out = docs.join(small(rates), margins, "left").withColumn(names["rate"], F.coalesce(names["rate"], F.lit(1.0)))
    return out.withColumn(names["kept"], draw(key) < F.col(names["rate"])).select(*docs.columns, names["rate"], names["kept"])


def op6_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, rate, kept) of every document."""
    out = mix(docs.select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_rate", 6).alias("rate"), F.col("mix_kept").alias("kept"))


_SWEEP = "SELECT source, lang, topic, base, gs, gl, gt, it, least(base, w * {g} / sum(w) OVER (PARTITION BY it, {d})) AS w FROM {f}"


def _goals(d: str) -> str:
    """SQL: the goals of a margin."""
    return f"""{d}0 AS (SELECT {d}, sum(base) AS base, pow(sum(base), {TEMPERATURES[d]}) AS share FROM c GROUP BY {d}),
{d}1 AS (SELECT *, sum(base) OVER () * {BUDGET} - sum(base) OVER u + base AS l, sum(share) OVER () - sum(share) OVER u + share AS t
         FROM {d}0 WINDOW u AS (ORDER BY share / base DESC, {d} ROWS UNBOUNDED PRECEDING)),
{d}2 AS (SELECT {d}, base AS all_, coalesce(least(base, (SELECT arg_max(l / t, share / base) FILTER (l / t * share < base) FROM {d}1) * share), base) AS goal FROM {d}1)"""


#: The same rows in DuckDB: as many sweeps, by a recursive query.
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\t\n\x0B\f\r ]+')) AS tokens, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, source, lang, tokens, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'License') THEN 'license'
        WHEN tokens < 50 THEN 'snippet' WHEN tokens > 1000 THEN 'long' ELSE 'prose' END AS topic FROM d),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS base FROM e GROUP BY ALL HAVING sum(tokens) > 0),
{_goals("source")},
{_goals("lang")},
{_goals("topic")},
g AS (SELECT c.*, s.goal AS gs, l.goal AS gl, t.goal AS gt, (s.goal >= s.all_ * (1 - 1e-12) OR l.goal >= l.all_ * (1 - 1e-12) OR t.goal >= t.all_ * (1 - 1e-12)) AS whole
  FROM c JOIN source2 s USING (source) JOIN lang2 l USING (lang) JOIN topic2 t USING (topic)),
h AS (SELECT *, gs - coalesce(sum(base) FILTER (whole) OVER (PARTITION BY source), 0) AS rs, gl - coalesce(sum(base) FILTER (whole) OVER (PARTITION BY lang), 0) AS rl,
        gt - coalesce(sum(base) FILTER (whole) OVER (PARTITION BY topic), 0) AS rt FROM g),
r AS (
  SELECT source, lang, topic, base, greatest(0, rs) AS gs, greatest(0, rl) AS gl, greatest(0, rt) AS gt, 0 AS it, base AS w FROM h WHERE NOT whole
  UNION ALL
  SELECT source, lang, topic, base, gs, gl, gt, it + 1, w FROM ({_SWEEP.format(g="gt", d="topic", f="(" + _SWEEP.format(g="gl", d="lang", f="(" + _SWEEP.format(g="gs", d="source", f="r") + ")") + ")")}) WHERE it < {SWEEPS}),
p AS (SELECT source, lang, topic, w / base AS rate FROM r WHERE it = {SWEEPS})
SELECT doc_id, e.source, e.lang, e.topic, tokens, round(coalesce(rate, 1.0), 6) AS rate,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '{SEED}'), 1, 13))::UBIGINT::DOUBLE / {16**13}.0 < coalesce(rate, 1.0) AS kept
FROM e LEFT JOIN p ON e.source = p.source AND e.lang = p.lang AND e.topic = p.topic
"""
