"""Operator 4: quality rules with adaptive thresholds.

Fixed cutoffs are replaced by thresholds learned for each language and source
from mergeable quantile sketches.  The sketch is a table of counts over
logarithmic buckets (relative error 1 %): it merges by adding counts, gives
the same result in any order of merging, has at most about 1,200 buckets a
group whatever the group's size, and is built by a plain map-side aggregate,
so a group with a third of all rows is no hot spot.  Sketches of sources merge
into their language's, and those into one for all.  A group's quartiles are
drawn towards its language's, and these towards all documents', by the weight of
``PRIOR`` documents: a small group leans on the wider one, a large one stands for itself,
and nothing switches in between.

A rule's fence is ``q75 + REACH * max(q75 - q25, least spread)``, a lower one
``q25`` less the same.  The least spread alone guards a group of uniform
documents; there is no fixed cutoff beside the base rule.

Defined results: a null text counts as empty; a text without words fails the
base rule; null languages and sources are groups of their own; repeated rows
count and are returned each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import SPACES, documents, join_small, once, stash, words

# The symbols counted, and the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: metric: (least spread, whether there is a lower fence too)
RULES = {
    "symbol_ratio": (0.02, False),
    "mean_word": (0.5, True),
    "dup_line_ratio": (0.05, False),
    "repeat_ratio": (0.02, False),
    "twin_ratio": (0.02, False),
}
REACH = 8.0
PRIOR = 100
GAMMA = 1.02          # width of a bucket; relative error below 1 %
LEAST = 1e-3          # values below share the first bucket


def _sliding_hash(word_hashes: Column) -> Column:
    """Hashes of all windows of 8 words, by doubling: 1 -> 2 -> 4 -> 8."""
    def pair(by: int):
        def made(h: Column) -> Column:
            n = F.greatest(F.size(h) - by, F.lit(0))
            return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))
        return made
    out = word_hashes
    for by in (1, 2, 4):
        out = once(out, pair(by))
    return out


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur at least twice (linear in the number of windows)."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(s["h"], F.lit(1), n - 1))
        after = F.concat(F.slice(s["h"], F.lit(2), n - 1), F.array(F.lit(None).cast("bigint")))
        twin = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        at = F.zip_with(s, twin, lambda x, y: F.when(
            F.coalesce(x["h"] == y["a"], F.lit(False)) | F.coalesce(x["h"] == y["b"], F.lit(False)), x["i"]))
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def total(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1),
                          lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW).cast("bigint"), lambda acc, g: acc + g)

    return once(placed, lambda s: once(repeated(s), total))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Id, group columns and the base counts of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(g) for g in group_cols], text.alias("_text"))
    base = base.withColumns({
        "n_words": F.size(words(F.col("_text"))).cast("long"),
        "word_chars": F.length(F.translate("_text", SPACES, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        "_hashes": F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)),
    })
    base = base.withColumn("_windows", _sliding_hash(F.col("_hashes")))
    short = F.greatest(F.size("_hashes") - 1, F.lit(0))
    twins = F.filter(F.zip_with(F.slice("_hashes", F.lit(1), short), F.slice("_hashes", F.lit(2), short), lambda a, b: a == b), lambda x: x)
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return base.select(
        "doc_id", *group_cols, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(twice, _covered(F.col("_windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"), F.size(twins).cast("long").alias("n_twins"))


def _metrics() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbol_ratio": F.col("n_symbols") / n, "mean_word": F.col("word_chars") / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeat_ratio": F.col("n_repeat_words") / n, "twin_ratio": F.col("n_twins") / n}


def sketch(stats: DataFrame, groups: list[str]) -> DataFrame:
    """Quantile sketch: ``groups, metric, bucket, n``."""
    long = stats.select(*groups, F.explode(F.create_map(
        *[x for k, v in _metrics().items() for x in (F.lit(k), v)])).alias("metric", "_x"))
    bucket = F.when(F.col("_x") < LEAST, 0).otherwise(1 + F.floor(F.log(F.col("_x") / LEAST) / math.log(GAMMA))).cast("int")
    return long.groupBy(*groups, "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, metric, n, q25, q75`` read from sketches."""
    w = Window.partitionBy(*groups, "metric")
    run = sketches.withColumn("_cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("_all", F.sum("n").over(w))
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    run = run.withColumn("_v", value)
    return run.groupBy(*groups, "metric").agg(
        F.max("_all").alias("n"),
        F.min(F.when(F.col("_cum") >= 0.25 * F.col("_all"), F.col("_v"))).alias("q25"),
        F.min(F.when(F.col("_cum") >= 0.75 * F.col("_all"), F.col("_v"))).alias("q75"))


def thresholds(stats: DataFrame, group_cols: tuple[str, str] = ("lang", "source"), prior: int = PRIOR,
               reach: float = REACH, rules: dict = RULES) -> DataFrame:
    """One row per (language, source) with ``{metric}_low`` and ``{metric}_high``."""
    lang, source = group_cols
    fine = stash(sketch(stats, [lang, source]))
    wide = fine.groupBy(lang, "metric", "bucket").agg(F.sum("n").alias("n"))
    top = fine.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    q0 = quantiles(fine, [lang, source])
    q1 = quantiles(wide, [lang]).select(F.col(lang).alias("_l"), F.col("metric").alias("_m"),
                                        *[F.col(c).alias(f"{c}1") for c in ("n", "q25", "q75")])
    q2 = quantiles(top, []).select(F.col("metric").alias("_m2"), *[F.col(c).alias(f"{c}2") for c in ("n", "q25", "q75")])
    q = q0.join(q1, F.col(lang).eqNullSafe(F.col("_l")) & (F.col("metric") == F.col("_m")))
    q = q.join(F.broadcast(q2), F.col("metric") == F.col("_m2"))        # one row per rule
    wider = lambda c: (F.col("n1") * F.col(f"{c}1") + F.lit(prior) * F.col(f"{c}2")) / (F.col("n1") + prior)
    drawn = lambda c: (F.col("n") * F.col(c) + F.lit(prior) * wider(c)) / (F.col("n") + prior)
    q = q.select(lang, source, "metric", drawn("q25").alias("q25"), drawn("q75").alias("q75"))
    out = []
    for metric, (spread, low) in rules.items():
        far = reach * F.greatest(F.col("q75") - F.col("q25"), F.lit(spread))
        mine = F.col("metric") == metric
        out.append(F.max(F.when(mine, F.col("q75") + far)).alias(f"{metric}_high"))
        if low:
            out.append(F.max(F.when(mine, F.col("q25") - far)).alias(f"{metric}_low"))
    return q.groupBy(lang, source).agg(*out)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                group_cols: tuple[str, str] = ("lang", "source"), prior: int = PRIOR,
                reach: float = REACH, rules: dict = RULES) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of each document."""
    stats = stash(text_stats(docs, id_col, text_col, group_cols).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))))
    # what the base rule rejects doesn't shape the thresholds
    fences = stash(thresholds(stats.filter(~F.col("base_failed")), group_cols, prior, reach, rules))
    joined = join_small(stats, fences, list(group_cols), "left")
    ok = ~F.col("base_failed")
    for metric, value in _metrics().items():
        if metric in rules:
            ok = ok & (value <= F.col(f"{metric}_high"))
            if rules[metric][1]:
                ok = ok & (value >= F.col(f"{metric}_low"))
    return joined.withColumn("kept", F.coalesce(ok, F.lit(False))).select(*stats.columns, "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    far = f"{REACH} * greatest(q75 - q25, {{s}})"
    fence = lambda m, side: f"(SELECT {side} FROM f WHERE f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source AND f.metric = '{m}')"
    bounds = " AND ".join(f"{m} <= {fence(m, 'q75 + ' + far.format(s=s))}" + (f" AND {m} >= {fence(m, 'q25 - ' + far.format(s=s))}" if low else "")
                          for m, (s, low) in RULES.items())
    drawn = lambda c: (f"(q0.n::DOUBLE * q0.{c} + {PRIOR}::DOUBLE * ((q1.n::DOUBLE * q1.{c} + {PRIOR}::DOUBLE * q2.{c}) / (q1.n::DOUBLE + {PRIOR})))"  # noqa: E731
                       f" / (q0.n::DOUBLE + {PRIOR}) AS {c}")
    quant = ("SELECT {g} metric, sum(n) AS n, min(CASE WHEN cum >= 0.25 * total THEN v END) AS q25, min(CASE WHEN cum >= 0.75 * total THEN v END) AS q75 "
             "FROM (SELECT *, sum(n) OVER (PARTITION BY {g} metric ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {g} metric) AS total, "
             f"CASE WHEN bucket = 0 THEN 0.0::DOUBLE ELSE {LEAST}::DOUBLE * pow({GAMMA}::DOUBLE, bucket - 0.5) END AS v "
             "FROM (SELECT {g} metric, bucket, count(*) AS n FROM b GROUP BY ALL)) GROUP BY {g} metric")
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT *, list_transform(range(1, greatest(len(ws) - 6, 1)), lambda i: array_to_string(ws[i:i+7], ' ')) AS win FROM w),
rep AS (SELECT doc_id, text, win AS win0, unnest(win) AS x, generate_subscripts(win, 1) AS i FROM g WHERE len(list_distinct(win)) < len(win)),
pos AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM rep) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM pos) GROUP BY doc_id),
s AS (SELECT g.doc_id, lang, source, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i+1])) AS n_twins
      FROM g LEFT JOIN cov USING (doc_id)),
x AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word,
        n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_ratio,
        n_twins / greatest(n_words, 1)::DOUBLE AS twin_ratio FROM s),
m AS (UNPIVOT (SELECT lang, source, symbol_ratio, mean_word, dup_line_ratio, repeat_ratio, twin_ratio FROM x WHERE NOT base_failed)
      ON symbol_ratio, mean_word, dup_line_ratio, repeat_ratio, twin_ratio INTO NAME metric VALUE v),
b AS (SELECT lang, source, metric, CASE WHEN v < {LEAST} THEN 0 ELSE 1 + floor(ln(v / {LEAST}::DOUBLE) / {math.log(GAMMA)!r}::DOUBLE)::INT END AS bucket FROM m),
q0 AS ({quant.format(g='lang, source,')}), q1 AS ({quant.format(g='lang,')}), q2 AS ({quant.format(g='')}),
f AS (SELECT q0.lang, q0.source, q0.metric, {drawn('q25')}, {drawn('q75')}
      FROM q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.metric = q1.metric JOIN q2 ON q0.metric = q2.metric)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({bounds}, false) AS kept FROM x
"""


ORACLE_OP4 = _oracle()
