"""Mixing sources to target weights by iterative proportional fitting.

Token counts are added up per cell (source, language, topic). Each margin gets
target shares; by default a margin's own shares raised to ``TEMPER``, so that
large sources are drawn less and small ones more. Raking multiplies the cells
by target / sum over one margin after another, ``ROUNDS`` times. A cell's factor
is its raked over its counted tokens. A document is kept if a number made from
its id's md5 lies below its cell's probability, so every retry and every engine
draws the same documents.

A stated share of all tokens is drawn (``KEPT_SHARE``): probabilities are the
factors times one scale, capped at 1, and what capped cells cannot supply is
spread over the others, so one rare cell does not set how much is kept.

Everything is DataFrame functions. The rounds run on the cell table, whose
size is sources x languages x topics; only narrow rows (no texts) are joined
with it, and Spark picks the join from the table's size.

The topic is a parameter: any column or expression. ``form_topic`` is the
default, made from the whole text: table, shouted, marked, long or short.

Edge cases: null source, language or topic form a group of their own
("(none)"); null text has no words, and documents without words get their
cell's probability, or 1 where the cell has no words at all; repeated rows
share one fate; an empty table gives no rows; columns of other names pass.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.7}
ROUNDS = 6
DIGITS = 9
KEPT_SHARE = 0.5
SEED = "mix-1"
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
SHORT_WORDS = 200


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def times(text: Column, part: str) -> Column:
    """How often ``part`` occurs in the text."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)


def form_topic(text: Column, words: Column) -> Column:
    """A coarse topic from the form of the whole text."""
    marks = functools.reduce(operator.add, (times(text, m) for m in ("***", "###", "$$$", "%%%", "&&&")))
    return (F.when(times(text, " | ") * 4 > words, "table").when(times(text, "!! ") * 4 > words, "shouted")
            .when(marks * 4 > words, "marked").when(words >= SHORT_WORDS, "long").otherwise("short"))


def cell_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
              topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens), one narrow row a document."""
    body = F.col(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit(NONE)).alias("source"),
                       F.coalesce(F.col(lang).cast("string"), F.lit(NONE)).alias("lang"), word_count(body).alias("n_tokens"),
                       *([topic.alias("topic")] if topic is not None else [body.alias("body")]))
    if topic is None:
        rows = rows.withColumn("topic", form_topic(F.col("body"), F.col("n_tokens")))
    return rows.select("doc_id", "source", "lang", F.coalesce("topic", F.lit(NONE)).alias("topic"), "n_tokens")


def with_targets(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """Adds t_<margin>: the margin's target tokens, its tempered share of all tokens."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("own"))
    total = own.agg(F.sum(F.pow(F.col("own"), F.lit(temper)))).scalar()
    every = own.agg(F.sum("own")).scalar()
    return cells.join(own.select(margin, (F.pow(F.col("own"), F.lit(temper)) / total * every).alias(f"t_{margin}")), margin)


def raked(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``w``: their tokens after raking to the t_ columns."""
    out = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for m in MARGINS:
            out = out.withColumn("w", F.col("w") * F.col(f"t_{m}") / F.sum("w").over(W.partitionBy(m)))
    return out


def scale_for(cells: DataFrame, share: float) -> float:
    """The scale at which the cells' min(1, scale * factor) draw ``share`` of all tokens.

    Each round caps the cells that the last scale takes whole and spreads the
    rest over the others. The scale only grows, so it ends when no cell is added.
    """
    scale, capped = 0.0, -1
    while True:
        whole = F.col("factor") * scale >= 1
        got = cells.agg(F.sum("tokens").alias("total"), F.count_if(whole).alias("capped"), F.sum(F.when(whole, F.col("tokens"))).alias("taken"),
                        F.sum(F.when(~whole, F.col("factor") * F.col("tokens"))).alias("free")).first()
        if got.capped == capped or not got.free:
            return scale
        capped = got.capped
        scale = (share * got.total - (got.taken or 0)) / got.free


def probabilities(rows: DataFrame, temper: dict[str, float] | None = None, rounds: int = ROUNDS,
                  targets: dict[str, DataFrame] | None = None, share: float = KEPT_SHARE) -> DataFrame:
    """(source, lang, topic, factor, probability) per cell with tokens; ``share`` of all tokens is drawn.

    ``targets`` maps a margin to a (margin, t_margin) table in place of tempered shares.
    """
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    # a small table, written once, so that the rounds do not count the documents again
    cells = cells.checkpoint()
    for m in MARGINS:
        if targets and m in targets:
            cells = cells.join(targets[m].select(m, F.col(f"t_{m}").cast("double")), m)
        else:
            cells = with_targets(cells, m, (temper or TEMPER)[m])
    done = raked(cells, rounds).withColumn("factor", F.round(F.col("w") / F.col("tokens"), DIGITS)).select(*MARGINS, "tokens", "factor").checkpoint()
    p = F.least(F.lit(1.0), F.col("factor") * scale_for(done, share))
    return done.select(*MARGINS, "factor", F.round(p, DIGITS).alias("probability"))


def drawn(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) made from the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def mixing_plan(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, factor, probability, kept) of every document."""
    names = {k: options.pop(k) for k in ("doc_id", "text", "source", "lang", "topic") if k in options}
    rows = cell_rows(docs, **names)
    cells = probabilities(rows, **options)
    joined = rows.join(cells, list(MARGINS), "left")
    p = F.coalesce("probability", F.lit(1.0))
    return joined.select("doc_id", *MARGINS, "n_tokens", F.coalesce("factor", F.lit(1.0)).alias("factor"), p.alias("probability"),
                         (drawn(F.col("doc_id"), seed) < p).alias("kept"))


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang",
                    seed: str = SEED, share: float = KEPT_SHARE, **options) -> DataFrame:
    """The documents drawn, with their own columns: about ``share`` of all tokens."""
    rows = cell_rows(docs, doc_id, text, source, lang)
    cells = probabilities(rows, share=share, **options)
    words = word_count(F.col(text))
    keys = {"source": F.coalesce(F.col(source).cast("string"), F.lit(NONE)), "lang": F.coalesce(F.col(lang).cast("string"), F.lit(NONE)),
            "topic": form_topic(F.col(text), words)}
    names = docs.columns
    wide = docs.select("*", *[v.alias(f"_mix_{k}") for k, v in keys.items()])
    cells = cells.select(*[F.col(m).alias(f"_mix_{m}") for m in MARGINS], F.col("probability").alias("_mix_p"))
    joined = wide.join(cells, [f"_mix_{m}" for m in MARGINS], "left")
    return joined.where(drawn(F.col(doc_id), seed) < F.coalesce("_mix_p", F.lit(1.0))).select(*names)


def mixing_sql(rounds: int = ROUNDS, share: float = KEPT_SHARE) -> str:
    """The same plan over ``documents`` in DuckDB."""
    t = "coalesce(text, '')"

    def count(part: str) -> str:
        return f"(length({t}) - length(replace({t}, '{part}', ''))) / {len(part)}.0"

    marks = " + ".join(count(m) for m in ("***", "###", "$$$", "%%%", "&&&"))
    parts = [f"""rows AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, n_tokens,
        CASE WHEN {count(' | ')} * 4 > n_tokens THEN 'table' WHEN {count('!! ')} * 4 > n_tokens THEN 'shouted' WHEN ({marks}) * 4 > n_tokens THEN 'marked'
        WHEN n_tokens >= {SHORT_WORDS} THEN 'long' ELSE 'short' END AS topic
        FROM (SELECT *, len(regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents))""",
             "c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for m in MARGINS:
        parts.append(f"own_{m} AS (SELECT {m}, sum(tokens) AS own FROM c0 GROUP BY {m})")
        parts.append(f"target_{m} AS (SELECT {m}, pow(own, {TEMPER[m]}::DOUBLE) / (SELECT sum(pow(own, {TEMPER[m]}::DOUBLE)) FROM own_{m}) "
                     f"* (SELECT sum(own) FROM own_{m}) AS t_{m} FROM own_{m})")
    last = 0
    parts.append("r0 AS (SELECT c0.*, t_source, t_lang, t_topic, tokens AS w FROM c0 JOIN target_source USING (source) JOIN target_lang USING (lang) "
                 "JOIN target_topic USING (topic))")
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(f"r{last + 1} AS (SELECT * REPLACE (w * t_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM r{last})")
            last += 1
    parts.append(f"f AS (SELECT source, lang, topic, tokens, round(w / tokens, {DIGITS}) AS factor FROM r{last})")
    # with the j largest factors capped at 1 the others' scale follows; the first j whose next factor stays below 1 is right
    order = "OVER (ORDER BY factor DESC ROWS BETWEEN"
    parts.append(f"g AS (SELECT factor, row_number() OVER (ORDER BY factor DESC) AS j, ({share}::DOUBLE * sum(tokens) OVER () - coalesce(sum(tokens) {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
                 f"/ sum(factor * tokens) {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM f)")
    parts.append(f"p AS (SELECT source, lang, topic, factor, round(least(1.0::DOUBLE, factor * (SELECT min_by(scale, j) FROM g WHERE factor * scale < 1)), {DIGITS}) AS probability FROM f)")
    draw = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE"
    return (f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, n_tokens, coalesce(factor, 1.0::DOUBLE) AS factor, "
            f"coalesce(probability, 1.0::DOUBLE) AS probability, {draw} < coalesce(probability, 1.0::DOUBLE) AS kept "
            "FROM rows LEFT JOIN p USING (source, lang, topic)")
