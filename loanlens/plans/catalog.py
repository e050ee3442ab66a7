"""Named queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the
operator is relational, ``ORACLE[name]`` -- the same result stated as DuckDB SQL
over the driver tables.  Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.plans import oracle_views as V
from loanlens.sources import fixtures as fx
from loanlens.operators import snapshot as snap
from loanlens.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (oracle convention)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if f.dataType.typeName() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])


def with_(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


# ---------------------------------------------------------------- snapshot

def snapshot_df(spark: SparkSession, sf: str) -> DataFrame:
    return snap.build_snapshot(fx.loan_panel(spark, sf))


def gold_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot written once (A9) for queries that read it from several branches."""
    return materialize(snapshot_df(spark, sf))


SNAP_R6 = ("loan_id, origination_date, observation_date, original_upb, original_interest_rate, "
           "original_loan_term, original_ltv, original_dti, borrower_credit_score, loan_purpose, "
           "property_type, occupancy_status, property_state, hist_max_dpd, hist_30dpd_months, "
           "round(hist_avg_upb, 6) AS hist_avg_upb, round(hist_upb_volatility, 6) AS hist_upb_volatility, "
           "hist_latest_upb, hist_latest_dpd, hist_modified_months, bad_12m_90dpd, "
           "round(hist_upb_to_original_upb, 6) AS hist_upb_to_original_upb")


@register("d1_snapshot", with_(V.SNAPSHOT, f"SELECT {SNAP_R6} FROM snapshot"))
def q_d1_snapshot(spark, sf):
    """SQL-mode point-in-time snapshot."""
    return r6(snapshot_df(spark, sf))


@register("d8_snapshot_summary", with_(V.SNAPSHOT, """
SELECT CAST(count(*) AS BIGINT) AS loan_count,
       round(avg(CAST(bad_12m_90dpd AS DOUBLE)), 6) AS bad_rate,
       min(origination_date) AS earliest_origination,
       max(origination_date) AS latest_origination,
       round(avg(CASE WHEN borrower_credit_score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS fico_missing_rate,
       round(avg(CASE WHEN original_ltv IS NULL THEN 1.0 ELSE 0.0 END), 6) AS ltv_missing_rate
FROM snapshot"""))
def q_d8_summary(spark, sf):
    return r6(snap.snapshot_summary(snapshot_df(spark, sf)))


# ---------------------------------------------------------------- metrics (2.I, 2.F)
from loanlens.operators import metrics as M  # noqa: E402

PTS_SQL = """,
pts AS (SELECT {score} AS score, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(1 - bad) AS BIGINT) AS good
        FROM scored WHERE {score} IS NOT NULL GROUP BY {score}),
cum AS (SELECT *, CAST(sum(bad) OVER (ORDER BY score DESC) AS BIGINT) AS cum_bad,
               CAST(sum(good) OVER (ORDER BY score DESC) AS BIGINT) AS cum_good,
               row_number() OVER (ORDER BY score DESC) AS pos FROM pts),
tot AS (SELECT CAST(sum(bad) AS BIGINT) AS nb, CAST(sum(good) AS BIGINT) AS ng FROM pts)"""


def _metrics_sql(score: str) -> str:
    return with_(V.SCORED + PTS_SQL.format(score=score), """
SELECT round(sum(good * (cum_bad - bad / 2.0)) / (max(nb) * max(ng)), 6) AS auc,
       round(CAST(greatest(max(cum_bad * ng - cum_good * nb), 0) AS DOUBLE) / (max(nb) * max(ng)), 6) AS ks,
       round(sum(bad * CAST(cum_bad AS DOUBLE) / (cum_bad + cum_good)) / max(nb), 6) AS pr_auc,
       (SELECT round(avg((""" + score + """ - bad) * (""" + score + """ - bad)), 6) FROM scored WHERE """ + score + """ IS NOT NULL) AS brier_score,
       (SELECT CAST(count(*) AS BIGINT) FROM scored WHERE """ + score + """ IS NOT NULL) AS sample_count
FROM cum, tot""")


@register("i11_metrics", _metrics_sql("pd"))
def q_i11(spark, sf):
    """I2, I3, I5, I6, I11 on continuous scores."""
    return r6(M.binary_metrics(fx.scored(spark, sf), "bad", "pd"))


@register("i2_metrics_tied_scores", _metrics_sql("pd_b"))
def q_i2_ties(spark, sf):
    """Same bundle on a score with heavy ties (grouped ROC points)."""
    return r6(M.binary_metrics(fx.scored(spark, sf), "bad", "pd_b"))


@register("i4_ks_threshold", with_(V.SCORED + PTS_SQL.format(score="pd_b"), """
SELECT round(CAST(greatest(max(cum_bad * ng - cum_good * nb), 0) AS DOUBLE) / (max(nb) * max(ng)), 6) AS ks,
       CASE WHEN max(cum_bad * ng - cum_good * nb) > 0
            THEN CAST(arg_max(score, {'d': cum_bad * ng - cum_good * nb, 's': score}) AS DOUBLE)
            ELSE CAST('inf' AS DOUBLE) END AS ks_threshold
FROM cum, tot"""))
def q_i4(spark, sf):
    return r6(M.ks_with_threshold(fx.scored(spark, sf), "bad", "pd_b"))


@register("i1_roc_curve", with_(V.SCORED + PTS_SQL.format(score="pd_b") + """,
nb_ AS (SELECT *, lead(bad) OVER (ORDER BY score DESC) AS nbad, lead(good) OVER (ORDER BY score DESC) AS ngood
        FROM cum),
kept AS (SELECT * FROM nb_ WHERE pos = 1 OR nbad IS NULL OR NOT (nbad = bad AND ngood = good))""", """
SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(tpr - fpr, 6) AS ks_gap FROM (
  SELECT score AS threshold, CAST(cum_good AS DOUBLE) / ng AS fpr, CAST(cum_bad AS DOUBLE) / nb AS tpr
  FROM kept, tot
  UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0)"""))
def q_i1(spark, sf):
    """ROC points with ties grouped and collinear points dropped."""
    return r6(M.roc_curve(fx.scored(spark, sf), "bad", "pd_b"))


DECILE_SQL = """,
rk AS (SELECT *, row_number() OVER (ORDER BY {score}, loan_id) AS r, count(*) OVER () AS n
       FROM scored WHERE {score} IS NOT NULL),
dec AS (SELECT *, CASE WHEN n <= 1 THEN 1
                       ELSE greatest(1, CAST(((r - 1) * {q} + n - 2) // (n - 1) AS INTEGER)) END AS decile FROM rk)"""


@register("f2_decile_table", with_(V.SCORED + DECILE_SQL.format(score="pd_b", q=10), """
SELECT decile, CAST(count(*) AS BIGINT) AS sample_count, round(avg(CAST(bad AS DOUBLE)), 6) AS observed_bad_rate,
       round(avg(pd_b), 6) AS average_score, 'D' || CAST(decile AS VARCHAR) AS decile_label
FROM dec GROUP BY decile"""))
def q_f2(spark, sf):
    """F1 / F2: rank deciles (ties by id) and the decile table."""
    return r6(M.decile_table(fx.scored(spark, sf), "bad", "pd_b", "loan_id"))


@register("f1_text_id_deciles", with_(V.SCORED + """,
named AS (SELECT 'L' || CAST(loan_id AS VARCHAR) AS name, pd_b FROM scored),
pos AS (SELECT *, row_number() OVER (ORDER BY pd_b, name) AS r, count(*) OVER () AS n FROM named WHERE pd_b IS NOT NULL)""", """
SELECT name, CAST(CASE WHEN n < 2 THEN 1 ELSE greatest(1, ((r - 1) * 10 + n - 2) // (n - 1)) END AS INTEGER) AS decile FROM pos"""))
def q_f1(spark, sf):
    """rank deciles whose ties are broken by a text id."""
    named = fx.scored(spark, sf).select(F.concat(F.lit("L"), F.col("loan_id").cast("string")).alias("name"), "pd_b")
    return M.rank_bins(named, "pd_b", "name").select("name", "decile")


@register("f4_latest_row", """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS last_date FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def q_f4(spark, sf):
    """the latest order of each customer."""
    from loanlens.operators.topk import latest_per_group
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("last_date"))
    return latest_per_group(o, ["o_custkey"], [F.col("last_date"), F.col("o_orderkey")])


@register("i7_ece", with_(V.SCORED + DECILE_SQL.format(score="pd", q=10) + """,
t AS (SELECT decile, count(*) AS c, avg(pd) AS s, avg(CAST(bad AS DOUBLE)) AS b FROM dec GROUP BY decile)""", """
SELECT round(sum(c * abs(s - b)) / sum(c), 6) AS ece FROM t"""))
def q_i7(spark, sf):
    return r6(M.expected_calibration_error(fx.scored(spark, sf), "bad", "pd", "loan_id"))


@register("i8_calibration_curve", with_(V.SCORED + """,
e AS (SELECT quantile_cont(pd, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM scored),
b AS (SELECT s.*, len(list_filter(e.qs, lambda x: x < s.pd)) AS bin FROM scored s, e WHERE s.pd IS NOT NULL)""", """
SELECT CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS sample_count, round(avg(pd), 6) AS mean_predicted,
       round(avg(CAST(bad AS DOUBLE)), 6) AS fraction_positive
FROM b GROUP BY bin"""))
def q_i8(spark, sf):
    return r6(M.calibration_curve(fx.scored(spark, sf), "bad", "pd"))


@register("i9_cohort_metrics", with_(V.SCORED + """,
c AS (SELECT *, CAST(year(observation_date) AS VARCHAR) || 'Q' || CAST(quarter(observation_date) AS VARCHAR) AS cohort
      FROM scored),
keep AS (SELECT cohort, CAST(count(*) AS BIGINT) AS sample_count, avg(CAST(bad AS DOUBLE)) AS bad_rate
         FROM c GROUP BY cohort HAVING count(DISTINCT bad) = 2),
pts AS (SELECT cohort, pd AS score, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(1 - bad) AS BIGINT) AS good
        FROM c WHERE pd IS NOT NULL GROUP BY cohort, pd),
cum AS (SELECT *, sum(bad) OVER (PARTITION BY cohort ORDER BY score DESC) AS cum_bad,
               sum(good) OVER (PARTITION BY cohort ORDER BY score DESC) AS cum_good FROM pts),
tot AS (SELECT cohort, sum(bad) AS nb, sum(good) AS ng FROM pts GROUP BY cohort),
m AS (SELECT cum.cohort,
        sum(good * (cum_bad - bad / 2.0)) / (max(nb) * max(ng)) AS auc,
        CAST(greatest(max(cum_bad * ng - cum_good * nb), 0) AS DOUBLE) / (max(nb) * max(ng)) AS ks,
        sum(bad * CAST(cum_bad AS DOUBLE) / (cum_bad + cum_good)) / max(nb) AS pr_auc
      FROM cum JOIN tot USING (cohort) GROUP BY cum.cohort),
br AS (SELECT cohort, avg((pd - bad) * (pd - bad)) AS brier_score FROM c WHERE pd IS NOT NULL GROUP BY cohort)""", """
SELECT keep.cohort, sample_count, round(bad_rate, 6) AS bad_rate, round(auc, 6) AS auc, round(ks, 6) AS ks,
       round(pr_auc, 6) AS pr_auc, round(brier_score, 6) AS brier_score
FROM keep JOIN m USING (cohort) JOIN br USING (cohort)"""))
def q_i9(spark, sf):
    return r6(M.cohort_metrics(fx.scored(spark, sf), "bad", "pd", "observation_date"))


@register("i10_confusion", with_(V.SCORED, """
SELECT CAST(count(*) FILTER (WHERE bad = 0 AND pd < 0.5) AS BIGINT) AS true_negatives,
       CAST(count(*) FILTER (WHERE bad = 0 AND pd >= 0.5) AS BIGINT) AS false_positives,
       CAST(count(*) FILTER (WHERE bad = 1 AND pd < 0.5) AS BIGINT) AS false_negatives,
       CAST(count(*) FILTER (WHERE bad = 1 AND pd >= 0.5) AS BIGINT) AS true_positives
FROM scored"""))
def q_i10(spark, sf):
    return M.confusion_counts(fx.scored(spark, sf), "bad", "pd", 0.5)


# ---------------------------------------------------------------- stability (2.J, D17, D18)
from loanlens.operators import stability as S  # noqa: E402
from loanlens.operators import split as SP  # noqa: E402

PROBS11 = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"
FLOOR = "CAST(0.0001 AS DOUBLE)"


def psi_sql(e: str, a: str, keys: list[str], categorical: bool = False, missing_bin: bool = False,
            out: str = "psi_out") -> str:
    """CTE chunk computing ``out(keys..., psi)`` from CTEs ``e(keys, value)`` and ``a(keys, value)``."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    using = f"USING ({k})" if keys else "ON TRUE"
    if categorical:
        cte = f""",
{out}_eb AS (SELECT {kc}coalesce(CAST(value AS VARCHAR), 'Missing') AS bin FROM {e}),
{out}_seen AS (SELECT DISTINCT {kc}bin FROM {out}_eb),
{out}_ab0 AS (SELECT {kc}coalesce(CAST(value AS VARCHAR), 'Missing') AS bin FROM {a}),
{out}_ab AS (SELECT {", ".join("x." + c for c in keys) + ", " if keys else ""}
               CASE WHEN s.bin IS NULL THEN 'Other' ELSE x.bin END AS bin
             FROM {out}_ab0 x LEFT JOIN {out}_seen s ON {" AND ".join([f"x.{c} = s.{c}" for c in keys] + ["x.bin = s.bin"])}),
{out}_flat AS (SELECT DISTINCT {kc}FALSE AS flat FROM {out}_ab)"""
    else:
        miss = "'Missing'" if missing_bin else "NULL"
        cte = f""",
{out}_q AS (SELECT {kc}list_sort(list_distinct(quantile_cont(value, {PROBS11}))) AS u
            FROM {e} WHERE value IS NOT NULL {"GROUP BY " + k if keys else ""}),
{out}_ed AS (SELECT {kc}CASE WHEN len(u) >= 3 THEN list_slice(u, 2, len(u) - 1) END AS inner_ FROM {out}_q),
{out}_eb AS (SELECT {kc}CASE WHEN value IS NULL THEN {miss} WHEN isnan(value) THEN {miss}
                  ELSE CAST(len(list_filter(inner_, lambda x: x < value)) AS VARCHAR) END AS bin
             FROM {e} LEFT JOIN {out}_ed {using}),
{out}_ab AS (SELECT {kc}CASE WHEN value IS NULL THEN {miss} WHEN isnan(value) THEN {miss}
                  ELSE CAST(len(list_filter(inner_, lambda x: x < value)) AS VARCHAR) END AS bin
             FROM {a} LEFT JOIN {out}_ed {using}),
{out}_flat AS (SELECT DISTINCT {", ".join("x." + c for c in keys) + ", " if keys else ""}(d.inner_ IS NULL) AS flat
               FROM {a} x LEFT JOIN {out}_ed d {("ON " + " AND ".join(f"x.{c} = d.{c}" for c in keys)) if keys else "ON TRUE"})"""
    join_keys = " AND ".join([f"ec.{c} = ac.{c}" for c in keys] + ["ec.bin = ac.bin"])
    co = ", ".join(f"coalesce(ec.{c}, ac.{c}) AS {c}" for c in keys)
    cte += f""",
{out}_ne AS (SELECT {kc}count(*) AS Ne FROM {out}_eb {"GROUP BY " + k if keys else ""}),
{out}_na AS (SELECT {kc}count(*) AS Na FROM {out}_ab {"GROUP BY " + k if keys else ""}),
{out}_ec AS (SELECT {kc}bin, count(*) AS n FROM {out}_eb WHERE bin IS NOT NULL GROUP BY ALL),
{out}_ac AS (SELECT {kc}bin, count(*) AS n FROM {out}_ab WHERE bin IS NOT NULL GROUP BY ALL),
{out}_m AS (SELECT {co + "," if keys else ""} coalesce(ec.n, 0) AS ne_, coalesce(ac.n, 0) AS na_
            FROM {out}_ec ec FULL OUTER JOIN {out}_ac ac ON {join_keys}),
{out}_s AS (SELECT {kc}greatest(CAST(ne_ AS DOUBLE) / Ne, {FLOOR}) AS es, greatest(CAST(na_ AS DOUBLE) / Na, {FLOOR}) AS as_
            FROM {out}_m JOIN {out}_ne {using} JOIN {out}_na {using}),
{out}_p AS (SELECT {kc}sum((as_ - es) * ln(as_ / es)) AS psi FROM {out}_s {"GROUP BY " + k if keys else ""}),
{out} AS (SELECT {", ".join("f." + c for c in keys) + ", " if keys else ""}
            CASE WHEN f.flat THEN 0.0 ELSE coalesce(p.psi, 0.0) END AS psi
          FROM {out}_flat f LEFT JOIN {out}_p p {("ON " + " AND ".join(f"f.{c} = p.{c}" for c in keys)) if keys else "ON TRUE"})"""
    return cte


SPLIT_DATE = "1998-01-01"


@register("j1_score_psi", with_(V.SCORED + f""",
e AS (SELECT pd AS value FROM scored WHERE observation_date < DATE '{SPLIT_DATE}'),
a AS (SELECT pd AS value FROM scored WHERE observation_date >= DATE '{SPLIT_DATE}')""" + psi_sql("e", "a", []),
    "SELECT round(psi, 6) AS psi FROM psi_out"))
def q_j1(spark, sf):
    """Score PSI, bins fixed on the earlier population."""
    s = fx.scored(spark, sf)
    d = F.col("observation_date")
    return r6(S.psi_between(s, d < F.lit(SPLIT_DATE).cast("date"), "pd"))


@register("j1_score_psi_tied", with_(V.SCORED + f""",
e AS (SELECT pd_b AS value FROM scored WHERE observation_date < DATE '{SPLIT_DATE}'),
a AS (SELECT pd_b AS value FROM scored WHERE observation_date >= DATE '{SPLIT_DATE}')""" + psi_sql("e", "a", []),
    "SELECT round(psi, 6) AS psi FROM psi_out"))
def q_j1_tied(spark, sf):
    s = fx.scored(spark, sf)
    d = F.col("observation_date")
    return r6(S.psi_between(s, d < F.lit(SPLIT_DATE).cast("date"), "pd_b"))


COHORT = "CAST(year({d}) AS VARCHAR) || 'Q' || CAST(quarter({d}) AS VARCHAR)"


@register("j5_cohort_monitoring", with_(V.SCORED + f""",
c AS (SELECT *, {COHORT.format(d='observation_date')} AS cohort FROM scored),
e AS (SELECT k.cohort, b.pd AS value FROM c b, (SELECT DISTINCT cohort FROM c) k
      WHERE b.cohort = (SELECT min(cohort) FROM c)),
a AS (SELECT cohort, pd AS value FROM c)""" + psi_sql("e", "a", ["cohort"]), """
SELECT l.cohort, CAST(count(*) AS BIGINT) AS sample_count, round(avg(CAST(bad AS DOUBLE)), 6) AS bad_rate,
       round(avg(pd), 6) AS average_score, round(max(p.psi), 6) AS score_psi_vs_baseline,
       CASE WHEN max(p.psi) >= 0.25 THEN 'alert' WHEN max(p.psi) >= 0.10 THEN 'review' ELSE 'stable' END AS psi_status
FROM c l JOIN psi_out p ON l.cohort = p.cohort GROUP BY l.cohort"""))
def q_j5(spark, sf):
    """Cohort monitoring against the first cohort."""
    return r6(S.monitoring_table(fx.scored(spark, sf), "pd", "bad", "observation_date"))


def oot_ids(snapshot):
    """OOT population: snapshot loans on/after the automatic cutoff."""
    _, test, _ = SP.split_out_of_time(snapshot)
    return test.select("loan_id")


AUTO_CUTOFF_SQL = """,
qs AS (SELECT DISTINCT CAST(date_trunc('quarter', observation_date) AS DATE) AS q FROM snapshot),
qn AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS i, count(*) OVER () AS n FROM qs),
cut AS (SELECT q AS cutoff FROM qn WHERE i = greatest(1, CAST(floor(n * 0.8) AS BIGINT))),
oot AS (SELECT s.* FROM snapshot s, cut WHERE s.observation_date >= cut.cutoff),
train AS (SELECT s.* FROM snapshot s WHERE s.loan_id NOT IN (SELECT loan_id FROM oot))"""

CONT = ["borrower_credit_score", "original_ltv", "original_dti", "original_upb", "hist_upb_to_original_upb"]
CATS = ["hist_max_dpd", "hist_30dpd_months", "loan_purpose", "property_type", "occupancy_status", "property_state"]


def _long(src: str, cols: list[str], typ: str, comparison: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {comparison} AS comparison, '{c}' AS feature, CAST({c} AS {typ}) AS value FROM {src}" for c in cols)


J4_SQL = with_(V.SNAPSHOT + AUTO_CUTOFF_SQL + f""",
ootc AS (SELECT *, {COHORT.format(d='observation_date')} AS cohort FROM oot),
b AS (SELECT min(cohort) AS f, max(cohort) AS l FROM ootc),
firstc AS (SELECT ootc.* FROM ootc, b WHERE cohort = b.f),
lastc AS (SELECT ootc.* FROM ootc, b WHERE cohort = b.l),
cname AS (SELECT f || ' vs ' || l AS nm FROM b),
en AS ({_long('train', CONT, 'DOUBLE', "'Train vs OOT'")} UNION ALL
       {_long('firstc, cname', CONT, 'DOUBLE', 'cname.nm')}),
an AS ({_long('oot', CONT, 'DOUBLE', "'Train vs OOT'")} UNION ALL
       {_long('lastc, cname', CONT, 'DOUBLE', 'cname.nm')}),
ec AS ({_long('train', CATS, 'VARCHAR', "'Train vs OOT'")} UNION ALL
       {_long('firstc, cname', CATS, 'VARCHAR', 'cname.nm')}),
ac AS ({_long('oot', CATS, 'VARCHAR', "'Train vs OOT'")} UNION ALL
       {_long('lastc, cname', CATS, 'VARCHAR', 'cname.nm')})"""
    + psi_sql("en", "an", ["comparison", "feature"], missing_bin=True, out="pn")
    + psi_sql("ec", "ac", ["comparison", "feature"], categorical=True, out="pc") + """,
psi AS (SELECT comparison, feature, 'continuous' AS feature_type, psi FROM pn
        UNION ALL SELECT comparison, feature, 'categorical', psi FROM pc),
em AS (SELECT comparison, feature, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM en GROUP BY ALL
       UNION ALL SELECT comparison, feature, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) FROM ec GROUP BY ALL),
am AS (SELECT comparison, feature, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM an GROUP BY ALL
       UNION ALL SELECT comparison, feature, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) FROM ac GROUP BY ALL)""", """
SELECT comparison, feature, feature_type, round(psi, 6) AS psi, round(em.m, 6) AS baseline_missing_rate,
       round(am.m, 6) AS comparison_missing_rate,
       CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.10 THEN 'review' ELSE 'stable' END AS psi_status,
       round(am.m - em.m, 6) AS missing_rate_change
FROM psi JOIN em USING (comparison, feature) JOIN am USING (comparison, feature)""")


@register("j4_feature_stability", J4_SQL)
def q_j4(spark, sf):
    """Feature PSI train-vs-OOT and first-vs-last cohort."""
    s = gold_snapshot(spark, sf)
    return r6(S.feature_stability(s, oot_ids(s)))


D17_SQL = with_(V.SNAPSHOT + AUTO_CUTOFF_SQL + """,
rules AS (SELECT * FROM (VALUES ('borrower_credit_score', 300.0, 850.0), ('original_ltv', 0.0, 100.0),
          ('original_dti', 0.0, 65.0), ('original_upb', 0.0, NULL), ('hist_upb_to_original_upb', 0.0, 1.20))
          t(feature, mn, mx)),
pops AS (""" + " UNION ALL ".join(
    f"SELECT '{p}' AS population, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}"
    for p, src in (("train", "train"), ("oot", "oot")) for c in CONT) + """)""", """
SELECT population, feature, CAST(count(*) AS BIGINT) AS sample_count,
       round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate,
       round(avg(CASE WHEN value IS NOT NULL AND (value < mn OR (mx IS NOT NULL AND value > mx)) THEN 1.0 ELSE 0.0 END), 6)
         AS invalid_rate,
       CASE WHEN avg(CASE WHEN value IS NOT NULL AND (value < mn OR (mx IS NOT NULL AND value > mx)) THEN 1.0 ELSE 0.0 END) > 0.01
              OR avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) > 0.02 THEN 'alert' ELSE 'stable' END AS quality_status
FROM pops JOIN rules USING (feature) GROUP BY population, feature""")


@register("d17_data_quality", D17_SQL)
def q_d17(spark, sf):
    """Domain-rule quality per population (rules broadcast, features stacked)."""
    s = gold_snapshot(spark, sf)
    return r6(S.data_quality(s, oot_ids(s)))


@register("e2_auto_cutoff", with_(V.SNAPSHOT + AUTO_CUTOFF_SQL, """
SELECT (SELECT cutoff FROM cut) AS cutoff, CAST((SELECT count(*) FROM train) AS BIGINT) AS train_rows,
       CAST((SELECT count(*) FROM oot) AS BIGINT) AS test_rows,
       round((SELECT avg(CAST(bad_12m_90dpd AS DOUBLE)) FROM train), 6) AS train_bad_rate,
       round((SELECT avg(CAST(bad_12m_90dpd AS DOUBLE)) FROM oot), 6) AS test_bad_rate"""))
def q_e2(spark, sf):
    """Automatic out-of-time cutoff and split sizes."""
    train, test, cutoff = SP.split_out_of_time(gold_snapshot(spark, sf))
    t = train.agg(F.count(F.lit(1)).alias("train_rows"), F.avg(F.col("bad_12m_90dpd").cast("double")).alias("train_bad_rate"))
    o = test.agg(F.count(F.lit(1)).alias("test_rows"), F.avg(F.col("bad_12m_90dpd").cast("double")).alias("test_bad_rate"))
    return r6(cutoff.crossJoin(t).crossJoin(o))


CAP_ROWS = 900


@register("e3_stratified_cap", with_(V.SCORED + f""",
named AS (SELECT 'L' || CAST(loan_id AS VARCHAR) AS name, bad FROM scored WHERE bad IS NOT NULL),
drawn AS (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY md5('42|' || name), name) AS r,
  count(*) OVER (PARTITION BY bad) AS nc, count(*) OVER () AS n FROM named)""", f"""
SELECT name, bad FROM drawn WHERE n <= {CAP_ROWS} OR r <= round_even({CAP_ROWS}::DOUBLE * nc / n::DOUBLE, 0)"""))
def q_e3(spark, sf):
    """Stratified cap on text ids (the cap is the feature)."""
    named = fx.scored(spark, sf).filter("bad is not null").select(F.concat(F.lit("L"), F.col("loan_id").cast("string")).alias("name"), "bad")
    return SP.stratified_cap(named, CAP_ROWS, "bad", "name")


# ---------------------------------------------------------------- policy (2.K)
from loanlens.operators import policy as P  # noqa: E402

SCEN_SQL = """,
scen AS (SELECT * FROM (VALUES ('Conservative', 0.08, 0.20, 0.40), ('Balanced', 0.12, 0.30, 0.40),
         ('Growth', 0.18, 0.40, 0.40)) t(scenario, p_, r_, l_)),
scen2 AS (SELECT scenario, CAST(p_ AS DOUBLE) AS pass_max_pd, CAST(r_ AS DOUBLE) AS review_max_pd,
          CAST(l_ AS DOUBLE) AS lgd FROM scen),
assigned AS (SELECT s.*, x.*, CASE WHEN s.pd <= x.pass_max_pd THEN 'pass' WHEN s.pd <= x.review_max_pd
                 THEN 'manual_review' ELSE 'reject' END AS action,
                 s.pd * coalesce(s.original_upb, 0) * x.lgd AS el
             FROM scored s CROSS JOIN scen2 x),
summary AS (SELECT scenario, action, count(*) AS loan_count,
              CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY scenario) AS action_rate,
              avg(CAST(bad AS DOUBLE)) AS observed_bad_rate, avg(pd) AS average_predicted_pd,
              coalesce(sum(original_upb), 0.0) AS exposure_amount, coalesce(sum(el), 0.0) AS expected_loss,
              max(pass_max_pd) AS pass_max_pd, max(review_max_pd) AS review_max_pd
            FROM assigned GROUP BY scenario, action)"""


def policy_scores(spark, sf):
    return fx.scored(spark, sf).withColumnRenamed("pd", "xgboost_pd").withColumnRenamed("bad", "bad_12m_90dpd")


@register("k3_strategy_summary", with_(V.SCORED + SCEN_SQL, """
SELECT scenario, action, CAST(loan_count AS BIGINT) AS loan_count, round(action_rate, 6) AS action_rate,
       round(observed_bad_rate, 6) AS observed_bad_rate, round(average_predicted_pd, 6) AS average_predicted_pd,
       round(exposure_amount, 2) AS exposure_amount, round(expected_loss, 2) AS expected_loss,
       pass_max_pd, review_max_pd FROM summary"""))
def q_k3(spark, sf):
    """Every scenario on every score row in one pass (money in cents)."""
    out = P.summarize_strategy(policy_scores(spark, sf), P.scenarios_table(spark))
    out = out.withColumn("exposure_amount", F.round("exposure_amount", 2)).withColumn(
        "expected_loss", F.round("expected_loss", 2))
    return r6(out)


K4_SELECT = """
SELECT scenario,
  coalesce(sum(action_rate) FILTER (WHERE action = 'pass'), 0.0) AS pass_rate,
  coalesce(sum(action_rate) FILTER (WHERE action = 'manual_review'), 0.0) AS review_rate,
  coalesce(sum(action_rate) FILTER (WHERE action IN ('pass', 'manual_review')), 0.0) AS approval_or_review_rate,
  max(observed_bad_rate) FILTER (WHERE action = 'pass') AS pass_bad_rate,
  coalesce(sum(expected_loss) FILTER (WHERE action IN ('pass', 'manual_review')), 0.0) AS provisional_booked_expected_loss,
  coalesce(sum(expected_loss) FILTER (WHERE action = 'reject'), 0.0) AS expected_loss_avoided_by_reject,
  coalesce(sum(expected_loss), 0.0) AS pre_decision_portfolio_expected_loss
FROM summary GROUP BY scenario"""


@register("k4_scenario_overview", with_(V.SCORED + SCEN_SQL + ",\nov AS (" + K4_SELECT + ")", """
SELECT scenario, round(pass_rate, 6) AS pass_rate, round(review_rate, 6) AS review_rate,
  round(approval_or_review_rate, 6) AS approval_or_review_rate, round(pass_bad_rate, 6) AS pass_bad_rate,
  round(provisional_booked_expected_loss, 2) AS provisional_booked_expected_loss,
  round(expected_loss_avoided_by_reject, 2) AS expected_loss_avoided_by_reject,
  round(pre_decision_portfolio_expected_loss, 2) AS pre_decision_portfolio_expected_loss FROM ov"""))
def q_k4(spark, sf):
    """K4 (money in cents, as in k3: sums of doubles differ past the 15th digit by the order of their terms)."""
    out = P.scenario_overview(P.summarize_strategy(policy_scores(spark, sf), P.scenarios_table(spark)))
    money = ["provisional_booked_expected_loss", "expected_loss_avoided_by_reject", "pre_decision_portfolio_expected_loss"]
    return r6(out.withColumns({c: F.round(c, 2) for c in money}))


@register("l6_scenario_tradeoff", with_(V.SCORED + SCEN_SQL + ",\nov AS (" + K4_SELECT + ")", """
SELECT scenario, round(1.0 - approval_or_review_rate, 6) AS reject_rate,
  round(provisional_booked_expected_loss / 1e6, 6) AS booked_el_millions,
  round(expected_loss_avoided_by_reject / 1e6, 6) AS avoided_el_millions FROM ov"""))
def q_l6(spark, sf):
    return r6(P.scenario_tradeoff(P.scenario_overview(
        P.summarize_strategy(policy_scores(spark, sf), P.scenarios_table(spark)))))


K5_SQL = with_(V.SCORED + """,
a AS (SELECT *, CASE WHEN pd <= 0.12 THEN 'pass' WHEN pd <= 0.30 THEN 'manual_review' ELSE 'reject' END AS action,
         pd * coalesce(original_upb, 0) * 0.40 AS el FROM scored),
g AS (SELECT action, count(*) AS c, avg(CAST(bad AS DOUBLE)) AS br, avg(pd) AS ap,
         coalesce(sum(original_upb), 0.0) AS ex, coalesce(sum(el), 0.0) AS el FROM a GROUP BY action),
dom AS (SELECT * FROM (VALUES ('pass'), ('manual_review'), ('reject')) t(action))""", """
SELECT dom.action, CAST(coalesce(c, 0) AS BIGINT) AS loan_count, round(coalesce(br, 0.0), 6) AS observed_bad_rate,
       round(coalesce(ap, 0.0), 6) AS average_pd, round(coalesce(ex, 0.0), 6) AS exposure,
       round(coalesce(el, 0.0), 6) AS expected_loss,
       round(CAST(coalesce(c, 0) AS DOUBLE) / (SELECT count(*) FROM scored), 6) AS action_rate
FROM dom LEFT JOIN g USING (action)""")


@register("k5_adhoc_strategy", K5_SQL)
def q_k5(spark, sf):
    """K5: ad-hoc thresholds, all three actions zero-filled."""
    detail, _ = P.strategy_summary(policy_scores(spark, sf), 0.12, 0.30, 0.40)
    return r6(detail)


@register("k5_adhoc_overview", "SELECT sum(CASE WHEN action <> 'reject' THEN action_rate ELSE 0 END) AS non_reject_rate, "
          "max(observed_bad_rate) FILTER (action = 'pass') AS pass_bad_rate, "
          "round(sum(CASE WHEN action <> 'reject' THEN expected_loss ELSE 0 END), 2) AS booked_expected_loss, "
          "round(sum(CASE WHEN action = 'reject' THEN expected_loss ELSE 0 END), 2) AS expected_loss_avoided FROM (" + K5_SQL + ")")
def q_k5_overview(spark, sf):
    """K5: overview of the ad-hoc thresholds (money in cents)."""
    detail, overview = P.strategy_summary(policy_scores(spark, sf), 0.12, 0.30, 0.40)
    money = ["booked_expected_loss", "expected_loss_avoided"]
    return r6(overview.select("non_reject_rate", "pass_bad_rate", *[F.round(c, 2).alias(c) for c in money]))


SWEEP = 1000


@register("k3_scenario_sweep", with_(V.SCORED + SCEN_SQL.replace("""scen AS (SELECT * FROM (VALUES ('Conservative', 0.08, 0.20, 0.40), ('Balanced', 0.12, 0.30, 0.40),
         ('Growth', 0.18, 0.40, 0.40)) t(scenario, p_, r_, l_))""", f"""scen AS (SELECT 'cut ' || i AS scenario,
         (500 + 4 * i)::DOUBLE / 10000.0::DOUBLE AS p_, (2500 + 5 * i)::DOUBLE / 10000.0::DOUBLE AS r_,
         (30 + i % 31)::DOUBLE / 100.0::DOUBLE AS l_ FROM range({SWEEP}) t(i))"""), """
SELECT scenario, action, CAST(loan_count AS BIGINT) AS loan_count, round(action_rate, 6) AS action_rate,
       round(observed_bad_rate, 6) AS observed_bad_rate, round(average_predicted_pd, 6) AS average_predicted_pd,
       round(exposure_amount, 2) AS exposure_amount, round(expected_loss, 2) AS expected_loss,
       pass_max_pd, review_max_pd FROM summary"""))
def q_k3_sweep(spark, sf):
    """A thousand scenarios, one look at each score (money in cents)."""
    at = lambda first, step, per: (F.lit(first) + F.col("id") * step).cast("double") / F.lit(per)
    grid = spark.range(SWEEP).select(F.concat(F.lit("cut "), F.col("id").cast("string")).alias("scenario"), at(500, 4, 10000.0).alias("pass_max_pd"),
                                     at(2500, 5, 10000.0).alias("review_max_pd"), ((F.lit(30) + F.col("id") % 31) / F.lit(100.0)).alias("lgd_assumption"))
    out = P.summarize_strategy(policy_scores(spark, sf), grid)
    return r6(out.withColumn("exposure_amount", F.round("exposure_amount", 2)).withColumn("expected_loss", F.round("expected_loss", 2)))


# ---------------------------------------------------------------- profiling
from loanlens.operators import profile as PR  # noqa: E402

WIDE_COLS = ["ID", "LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", *fx.PAY_STATUS_COLUMNS,
             *fx.BILL_COLUMNS, *fx.PAY_AMOUNT_COLUMNS, fx.TARGET_WIDE]
WIDE_TYPES = {"ID": "bigint", "LIMIT_BAL": "double", **{c: "int" for c in ["SEX", "EDUCATION", "MARRIAGE", "AGE",
              *fx.PAY_STATUS_COLUMNS, fx.TARGET_WIDE]}, **{c: "double" for c in fx.BILL_COLUMNS + fx.PAY_AMOUNT_COLUMNS}}


@register("d10_field_profile", with_(V.WIDE + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM wide" for c in WIDE_COLS) + ")", """
SELECT field AS "column", CASE field """ + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in WIDE_TYPES.items()) + """ END AS dtype,
       CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS missing_count,
       round(CAST(count(*) FILTER (WHERE value IS NULL) AS DOUBLE) / count(*), 6) AS missing_rate,
       CAST(count(DISTINCT value) AS BIGINT) AS unique_count
FROM long GROUP BY field"""))
def q_d10(spark, sf):
    """D10 (A10 load): field profile over the wide customer table."""
    return r6(PR.field_profile(fx.wide_customer(spark, sf)))


D11_PARTS = [f"""SELECT '{c}' AS field, '{", ".join(map(str, v))}' AS expected_codes,
  array_to_string(list_sort(list_distinct(list(CAST({c} AS BIGINT)))), ', ') AS observed_codes,
  CAST(count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({", ".join(map(str, v))})) AS BIGINT) AS unexpected_count,
  round(CAST(count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({", ".join(map(str, v))})) AS DOUBLE) / count(*), 6) AS unexpected_rate,
  '{PR.CODE_NOTE.replace("'", "''")}' AS note FROM wide""" for c, v in PR.EXPECTED_CODES.items()] + [
    f"""SELECT '{c}', '-2 to 8', CAST(min({c}) AS VARCHAR) || ' to ' || CAST(max({c}) AS VARCHAR),
  CAST(count(*) FILTER (WHERE {c} < -2 OR {c} > 8) AS BIGINT),
  round(CAST(count(*) FILTER (WHERE {c} < -2 OR {c} > 8) AS DOUBLE) / count(*), 6), '{PR.PAY_NOTE}' FROM wide"""
    for c in fx.PAY_STATUS_COLUMNS]


@register("d11_code_quality", with_(V.WIDE, " UNION ALL ".join(D11_PARTS)))
def q_d11(spark, sf):
    return r6(PR.code_quality(fx.wide_customer(spark, sf)))


MONEY_LONG = ",\nml AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST({c} AS DOUBLE) AS value FROM wide" for c in fx.MONEY_COLUMNS) + ")"
D12_CTE = MONEY_LONG + """,
q AS (SELECT field, quantile_cont(value, [0.01, 0.5, 0.99]) AS qs FROM ml WHERE value IS NOT NULL GROUP BY field),
mp AS (SELECT ml.field, min(value) AS minimum, max(qs[1]) AS p01, max(qs[2]) AS median, max(qs[3]) AS p99,
         max(value) AS maximum, CAST(count(*) FILTER (WHERE value = 0) AS BIGINT) AS zero_count,
         CAST(count(*) FILTER (WHERE value < 0) AS BIGINT) AS negative_count,
         CAST(count(*) FILTER (WHERE value > qs[3]) AS BIGINT) AS above_p99_count
       FROM ml LEFT JOIN q USING (field) GROUP BY ml.field)"""


@register("d12_money_profile", with_(V.WIDE + D12_CTE, """
SELECT field, round(minimum, 6) AS minimum, round(p01, 6) AS p01, round(median, 6) AS median, round(p99, 6) AS p99,
       round(maximum, 6) AS maximum, zero_count, negative_count, above_p99_count FROM mp"""))
def q_d12(spark, sf):
    """Exact percentiles for all money fields in one grouped pass."""
    return r6(PR.money_profile(fx.wide_customer(spark, sf)))


@register("d16_negative_bills", with_(V.WIDE + D12_CTE, """
SELECT CAST(coalesce(sum(negative_count), 0) AS BIGINT) AS negative_count FROM mp WHERE field LIKE 'BILL_%'"""))
def q_d16(spark, sf):
    return PR.negative_total(fx.wide_customer(spark, sf))


def _band_sql(x: str, edges, labels) -> str:
    parts = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        lo_s = "" if lo == float("-inf") else f"{x} > {float(lo)}"
        hi_s = "" if hi == float("inf") else f"{x} <= {float(hi)}"
        cond = " AND ".join(p for p in (lo_s, hi_s) if p) or "TRUE"
        if lo != float("-inf") or hi != float("inf"):
            cond = f"{x} IS NOT NULL AND " + cond
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


def _map_sql(x: str, mapping, default) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {k} THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


SEG_SQL = V.WIDE + """,
lq AS (SELECT list_sort(list_distinct(quantile_cont(LIMIT_BAL, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS u
       FROM wide WHERE LIMIT_BAL IS NOT NULL),
w2 AS (SELECT wide.*, greatest(PAY_0, PAY_2, PAY_3, PAY_4, PAY_5, PAY_6) AS mds,
         """ + " + ".join(f"(CASE WHEN {c} >= 1 THEN 1 ELSE 0 END)" for c in fx.PAY_STATUS_COLUMNS) + """ AS dmc,
         CASE WHEN LIMIT_BAL IS NULL THEN NULL ELSE ['Q1 low', 'Q2', 'Q3', 'Q4 high'][
           1 + len(list_filter(list_slice(u, 2, greatest(len(u) - 1, 1)), lambda e: e < LIMIT_BAL))] END AS limit_segment
       FROM wide, lq),
seg AS (SELECT default_payment_next_month AS t,
    """ + _map_sql("SEX", PR.GENDER, "Unknown") + """ AS gender,
    """ + _map_sql("EDUCATION", PR.EDUCATION, "Other / unknown") + """ AS education,
    """ + _map_sql("MARRIAGE", PR.MARRIAGE, "Other / unknown") + """ AS marriage,
    """ + _band_sql("AGE", PR.AGE_EDGES, PR.AGE_LABELS) + """ AS age,
    limit_segment AS "limit",
    """ + _band_sql("mds", PR.DELQ_EDGES, PR.DELQ_LABELS) + """ AS max_delinquency,
    """ + _band_sql("dmc", PR.COUNT_EDGES, PR.COUNT_LABELS) + """ AS delinquent_month,
    CAST(PAY_0 AS VARCHAR) AS recent_delinquency_status FROM w2),
long AS (""" + " UNION ALL ".join(
    f"SELECT '{s}' AS segment, \"{s}\" AS segment_value, t FROM seg" for s in
    ["gender", "education", "marriage", "age", "limit", "max_delinquency", "delinquent_month",
     "recent_delinquency_status"]) + ")"


@register("d13_segment_rates", with_(SEG_SQL, """
SELECT segment, segment_value, CAST(count(*) AS BIGINT) AS sample_count, round(avg(CAST(t AS DOUBLE)), 6) AS default_rate
FROM long WHERE segment_value IS NOT NULL GROUP BY segment, segment_value"""))
def q_d13(spark, sf):
    """D13 with B12-B15: segments and default rates in one stacked group-by."""
    return r6(PR.segment_default_rates(PR.build_segments(fx.wide_customer(spark, sf))))


@register("d10_sketch_profile", "SELECT *, true AS close FROM (SELECT \"column\", dtype, missing_count, missing_rate FROM (" + ORACLE["d10_field_profile"] + "))")
def q_d10_sketch(spark, sf):
    """D10 by sketches stored per part and merged: ``close`` says that the distinct count is within 5 % of the exact one."""
    wide = fx.wide_customer(spark, sf)
    merged = PR.merge_sketches(materialize(PR.profile_sketches(wide, F.pmod(F.col("ID"), F.lit(8)))), wide)
    exact = PR.field_profile(wide).select("column", F.col("unique_count").alias("exact"))
    j = merged.join(F.broadcast(exact), "column")                 # a row a column
    return r6(j.select("column", "dtype", "missing_count", "missing_rate",
                       (F.abs(F.col("unique_count") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close")))


@register("d14_duplicates", with_(V.WIDE, """
SELECT CAST((SELECT count(*) FROM wide) - (SELECT count(*) FROM (SELECT DISTINCT * FROM wide)) AS BIGINT) AS duplicate_rows,
       CAST((SELECT count(*) FROM wide) - (SELECT count(DISTINCT ID) FROM wide) AS BIGINT) AS duplicate_ids,
       CAST(""" + " + ".join(f"(SELECT CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN 1 ELSE 0 END FROM wide)"
                          for c in WIDE_COLS) + """ AS INTEGER) AS fields_with_missing"""))
def q_d14(spark, sf):
    return PR.duplicate_summary(fx.wide_customer(spark, sf))


@register("d15_class_shares", with_(V.WIDE, """
SELECT default_payment_next_month AS default_flag, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM wide), 6) AS sample_rate
FROM wide GROUP BY default_payment_next_month"""))
def q_d15(spark, sf):
    return r6(PR.class_shares(fx.wide_customer(spark, sf)))


def _rowmean_sql(cols):
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    n = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in cols)
    return f"(CASE WHEN ({n}) = 0 THEN NULL ELSE ({s}) / ({n}) END)"


B18_SQL = with_(V.WIDE + """,
f0 AS (SELECT ID, LIMIT_BAL, CAST(PAY_0 AS DOUBLE) AS recent_delinquency_status,
   CAST(greatest(PAY_0, PAY_2, PAY_3, PAY_4, PAY_5, PAY_6) AS DOUBLE) AS max_delinquency_status,
   CAST(""" + " + ".join(f"(CASE WHEN {c} >= 1 THEN 1 ELSE 0 END)" for c in fx.PAY_STATUS_COLUMNS) + """ AS DOUBLE)
     AS delinquent_month_count,
   """ + _rowmean_sql(fx.BILL_COLUMNS) + """ AS avg_bill_amount,
   """ + _rowmean_sql(fx.PAY_AMOUNT_COLUMNS) + """ AS avg_payment_amount,
   (""" + " + ".join(f"coalesce(greatest({c}, 0), 0)" for c in fx.BILL_COLUMNS) + """) AS pos_bills,
   (""" + " + ".join(f"coalesce({c}, 0)" for c in fx.PAY_AMOUNT_COLUMNS) + """) AS pay_sum,
   stddev_samp_b AS bill_amount_volatility, default_payment_next_month
 FROM (SELECT *, (SELECT stddev_samp(x) FROM (SELECT unnest([""" + ", ".join(fx.BILL_COLUMNS) + """]) AS x))
       AS stddev_samp_b FROM wide))""", """
SELECT ID, round(LIMIT_BAL, 6) AS LIMIT_BAL, recent_delinquency_status, max_delinquency_status, delinquent_month_count,
  round(avg_bill_amount, 6) AS avg_bill_amount, round(avg_payment_amount, 6) AS avg_payment_amount,
  round(CASE WHEN avg_bill_amount IS NULL OR LIMIT_BAL = 0 THEN NULL
             ELSE greatest(-2.0, least(10.0, avg_bill_amount / LIMIT_BAL)) END, 6) AS balance_to_limit_ratio,
  round(greatest(0.0, least(5.0, CASE WHEN pos_bills = 0 THEN 0.0 ELSE pay_sum / pos_bills END)), 6) AS payment_to_bill_ratio,
  round(bill_amount_volatility, 6) AS bill_amount_volatility, default_payment_next_month
FROM f0""")


@register("b18_behaviour_features", B18_SQL)
def q_b18(spark, sf):
    """Row-wise behaviour features for every customer (NULL check off)."""
    return r6(PR.prepare_features(fx.wide_customer(spark, sf), require_complete=False))


# ---------------------------------------------------------------- models (2.H), rows-only checks
from loanlens.operators import models as ML  # noqa: E402


def _oot_frames(spark, sf):
    s = gold_snapshot(spark, sf)
    train, test, _ = SP.split_out_of_time(s)
    return train, test


@register("h9_champion_challenger")
def q_h9(spark, sf):
    """Logistic + boosted trees on the OOT split; metrics per model."""
    train, test = _oot_frames(spark, sf)
    n = train.count()
    _, metrics, _ = ML.train_models(train, test, {"logistic": ML.logistic(n), "boosted": ML.boosted()})
    return r6(metrics)


@register("h7_oot_scores")
def q_h7(spark, sf):
    """H7 / H5: OOT scores from the second boosted challenger (300 trees, depth 5, 100 rows per leaf)."""
    train, test = _oot_frames(spark, sf)
    m = ML.fit(train, "boosted_deep", ML.boosted(max_iter=300, depth=5, min_instances=100, subsample=1.0))
    return r6(m.score(test, "boosted_deep_pd").select("loan_id", "observation_date", "bad_12m_90dpd", "boosted_deep_pd"))


@register("h4_second_order_boosting")
def q_h4(spark, sf):
    """Second-order trees by levels, fitted on a capped training sample; OOT scores.

    ``Params()`` has H4's settings.  Here the Hessian floor is 1 in place of 100, as the fixture has some hundred loans whose Hessians
    add up to less than 100, and 60 trees take four times the step of 250.
    """
    train, test = _oot_frames(spark, sf)
    snap.check_snapshot(train)
    SP.check_split(train, test)
    train = SP.stratified_cap(train, 750_000)
    m = ML.fit(train, "second_order", ML.boosting.Params(trees=60, step=0.2, least_hessian=1.0, bins=32))
    return r6(m.score(test, "second_order_pd").select("loan_id", "observation_date", "bad_12m_90dpd", "second_order_pd"))


@register("h5_leaf_wise_boosting")
def q_h5(spark, sf):
    """H5 / H7: trees grown best leaf first; OOT scores.

    ``LEAF_WISE`` has H5's settings.  Here a leaf needs 20 rows in place of 100, as the fixture has some hundred loans, and 60 trees take five
    times the step of 300.
    """
    train, test = _oot_frames(spark, sf)
    SP.check_split(train, test)
    m = ML.fit(train, "leaf_wise", ML.boosting.with_params(ML.boosting.LEAF_WISE, trees=60, step=0.25, least_rows=20, bins=32))
    return r6(m.score(test, "leaf_wise_pd").select("loan_id", "observation_date", "bad_12m_90dpd", "leaf_wise_pd"))


H2_NUMERIC = ["original_ltv", "original_dti", "borrower_credit_score", "original_upb", "hist_avg_upb", "hist_upb_to_original_upb"]
H2_CATEGORIES = ["loan_purpose", "property_type", "occupancy_status", "property_state"]
H2_LEAST = 14
H2_SQL = with_(V.SNAPSHOT + f""",
num AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in H2_NUMERIC)} FROM snapshot) ON {', '.join(H2_NUMERIC)} INTO NAME col VALUE x),
med AS (SELECT col, quantile_cont(x, 0.5) AS median FROM num GROUP BY col),
every AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM snapshot" for c in H2_NUMERIC)}),
filled AS (SELECT col, median, coalesce(x, median) AS x FROM every JOIN med USING (col)),
cat AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c} AS v FROM snapshot" for c in H2_CATEGORIES)}),
cnt AS (SELECT col, v, count(*) AS n FROM cat GROUP BY ALL),
mo AS (SELECT col, v AS mode FROM cnt WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, v) = 1),
lev AS (SELECT col, v, mode, n + CASE WHEN v = mode THEN coalesce((SELECT n FROM cnt z WHERE z.col = cnt.col AND z.v IS NULL), 0) ELSE 0 END AS n
        FROM cnt JOIN mo USING (col) WHERE v IS NOT NULL),
sl AS (SELECT *, n >= {H2_LEAST} AS keep, sum((n >= {H2_LEAST})::INT) OVER (PARTITION BY col ORDER BY v) - 1 AS place,
         sum((n >= {H2_LEAST})::INT) OVER (PARTITION BY col) AS size FROM lev)""", """
SELECT col AS feature, 'median' AS item, CAST(NULL AS BIGINT) AS slot, round(max(median), 6) AS amount FROM filled GROUP BY col
UNION ALL SELECT col, 'mean', NULL, round(avg(x), 6) FROM filled GROUP BY col
UNION ALL SELECT col, 'std', NULL, round(stddev_pop(x), 6) FROM filled GROUP BY col
UNION ALL SELECT col, 'mode ' || max(mode), NULL, CAST(sum(n) AS DOUBLE) FROM sl GROUP BY col
UNION ALL SELECT col, v, CAST(CASE WHEN keep THEN place ELSE size END AS BIGINT), CAST(n AS DOUBLE) FROM sl""")


@register("h2_preprocessing", H2_SQL)
def q_h2(spark, sf):
    """H1 / H2: medians, means and deviations after imputing; modes, and the slot of every category (the rare ones share the last)."""
    from loanlens.operators import preprocess as PP
    snapshot = gold_snapshot(spark, sf)
    nothing = F.lit(None).cast("long").alias("slot")
    numbers = PP.numeric_stats(snapshot, H2_NUMERIC).select(F.col("column").alias("feature"), F.inline(F.array(
        *[F.struct(F.lit(c).alias("item"), F.col(c).alias("amount")) for c in ("median", "mean", "std")]))).select("feature", "item", nothing, "amount")
    levels = PP.category_dictionary(snapshot, H2_CATEGORIES, H2_LEAST)
    modes = levels.groupBy("column").agg(F.first("mode").alias("m"), F.sum("n").cast("double").alias("amount")).select(
        F.col("column").alias("feature"), F.concat(F.lit("mode "), "m").alias("item"), nothing, "amount")
    slots = levels.select(F.col("column").alias("feature"), F.col("value").alias("item"), F.col("slot").cast("long"), F.col("n").cast("double").alias("amount"))
    return r6(numbers.unionByName(modes).unionByName(slots))


@register("h10_importance")
def q_h10(spark, sf):
    train, _ = _oot_frames(spark, sf)
    return r6(ML.importance(ML.fit(train, "boosted", ML.boosted())))


@register("h8_isotonic_calibration")
def q_h8(spark, sf):
    """Fit before the calibration quarter, isotonic map on it, evaluate OOT."""
    s = gold_snapshot(spark, sf)
    _, _, cutoff = SP.split_out_of_time(s)
    start = str(cutoff.first()["cutoff"])
    model_train, calibration, oot = SP.three_way_time_split(s, start)
    m = ML.fit(model_train, "boosted", ML.boosted())
    cal = ML.isotonic_calibrate(m.score(calibration, "raw_pd"), m.score(oot, "raw_pd"), "raw_pd")
    raw = M.binary_metrics(cal, "bad_12m_90dpd", "raw_pd").withColumn("score_version", F.lit("raw"))
    iso = M.binary_metrics(cal, "bad_12m_90dpd", "calibrated_pd").withColumn("score_version", F.lit("isotonic"))
    return r6(raw.unionByName(iso))


# Scores of the orders before a date are fitted, later ones calibrated.  The fit is stated as the largest, over starts,
# of the least, over ends, of the mean from start to end; values between fitted scores lie on lines.
ISO_SQL = V.SCORED + """,
pts AS (SELECT pd_b AS x, sum(bad) AS s, count(*) AS w FROM scored WHERE observation_date < DATE '1996-01-01'
        AND pd_b BETWEEN 0.05 AND 0.9 AND loan_id % 13 <> 0 GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM pts),
pr AS (SELECT a.i AS a, b.i AS b, CAST(b.cs - a.cs + a.s AS DOUBLE) / (b.cw - a.cw + a.w) AS m FROM o a JOIN o b ON b.i >= a.i),
mn AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS low FROM pr),
iso AS (SELECT o.x, max(low) AS y FROM mn JOIN o ON o.i = mn.b GROUP BY o.x),
oot AS (SELECT loan_id, bad, pd_b AS v FROM scored WHERE observation_date >= DATE '1996-01-01'),
lo AS (SELECT oot.*, iso.x AS x0, iso.y AS y0 FROM oot ASOF LEFT JOIN iso ON oot.v >= iso.x),
hi AS (SELECT lo.*, iso.x AS x1, iso.y AS y1 FROM lo ASOF LEFT JOIN iso ON lo.v <= iso.x),
cal AS (SELECT loan_id, bad, v AS raw, CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR x0 = x1 THEN y0
               ELSE y0 + (y1 - y0) * ((v - x0) / (x1 - x0)) END AS isotonic FROM hi),
ver AS (SELECT loan_id, bad, 'raw' AS score_version, raw AS score FROM cal UNION ALL SELECT loan_id, bad, 'isotonic', isotonic FROM cal),
rk AS (SELECT *, row_number() OVER (PARTITION BY score_version ORDER BY score, loan_id) AS r, count(*) OVER (PARTITION BY score_version) AS n FROM ver),
dec AS (SELECT *, greatest(1, CAST(((r - 1) * 10 + n - 2) // (n - 1) AS INTEGER)) AS decile FROM rk),
tab AS (SELECT score_version, decile, count(*) AS c, avg(CAST(bad AS DOUBLE)) AS rate, avg(score) AS mean FROM dec GROUP BY ALL)"""


def _calibrated(spark, sf):
    s = fx.scored(spark, sf)
    early = F.col("observation_date") < F.lit("1996-01-01").cast("date")
    fitted = s.filter(early & F.col("pd_b").between(0.05, 0.9) & (F.col("loan_id") % 13 != 0))
    return ML.isotonic_calibrate(fitted, s.filter(~early), "pd_b", "bad")


@register("h8_isotonic_map", with_(ISO_SQL, "SELECT loan_id, raw AS pd_b, round(isotonic, 6) AS calibrated_pd FROM cal"))
def q_h8_map(spark, sf):
    """H8: every later score calibrated by the fit on earlier ones (clipped and between fitted scores too)."""
    return r6(_calibrated(spark, sf).select("loan_id", "pd_b", "calibrated_pd"))


@register("h8_calibration_report", with_(ISO_SQL + """,
p AS (SELECT score_version, score, sum(bad) AS bad, sum(1 - bad) AS good FROM ver GROUP BY ALL),
c AS (SELECT *, sum(bad) OVER w AS cb, sum(good) OVER w AS cg, sum(bad) OVER (PARTITION BY score_version) AS nb,
        sum(good) OVER (PARTITION BY score_version) AS ng FROM p WINDOW w AS (PARTITION BY score_version ORDER BY score DESC)),
m AS (SELECT score_version, sum(good * (cb - bad / 2.0::DOUBLE)) / (max(nb) * max(ng))::DOUBLE AS auc,
        greatest(max(cb / nb::DOUBLE - cg / ng::DOUBLE), 0) AS ks, sum(bad * cb / (cb + cg)::DOUBLE) / max(nb) AS pr_auc FROM c GROUP BY 1),
b AS (SELECT score_version, avg((score - bad) * (score - bad)) AS brier, count(*) AS n FROM ver GROUP BY 1),
e AS (SELECT score_version, sum(c * abs(mean - rate)) / sum(c) AS ece FROM tab GROUP BY 1)""", """
SELECT score_version, round(auc, 6) AS auc, round(ks, 6) AS ks, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier_score,
  CAST(n AS BIGINT) AS sample_count, round(ece, 6) AS ece FROM m JOIN b USING (score_version) JOIN e USING (score_version)"""))
def q_h8_report(spark, sf):
    """Metrics with ECE of raw and calibrated scores."""
    return r6(ML.calibration_report(ML.calibration_versions(_calibrated(spark, sf), "pd_b", "calibrated_pd", ["loan_id", "bad"]), "bad", "loan_id"))


@register("f2_version_deciles", with_(ISO_SQL, """
SELECT score_version, decile, CAST(c AS BIGINT) AS sample_count, round(rate, 6) AS observed_bad_rate, round(mean, 6) AS average_score,
  'D' || CAST(decile AS VARCHAR) AS decile_label FROM tab"""))
def q_f2_versions(spark, sf):
    """F2 / H8: the decile table of raw and of calibrated scores."""
    both = ML.calibration_versions(_calibrated(spark, sf), "pd_b", "calibrated_pd", ["loan_id", "bad"])
    return r6(M.decile_table(both, "bad", "score", "loan_id", groups=["score_version"]))


def _wide_model_frame(spark, sf):
    # all customers: a month without a statement has no balance, no payment and the status "no consumption" (-2)
    w = fx.wide_customer(spark, sf)
    w = w.fillna(0.0, [c for c in w.columns if c.startswith(("BILL_AMT", "PAY_AMT"))]).fillna(
        -2, [c for c in w.columns if c.startswith("PAY_") and not c.startswith("PAY_AMT")])
    return PR.prepare_features(w)


@register("h11_coefficients")
def q_h11(spark, sf):
    """Baseline-case logistic on a seeded stratified split; coefficient table."""
    feats = _wide_model_frame(spark, sf)
    train, _ = SP.stratified_split(feats, 0.2, fx.TARGET_WIDE, "ID")
    m = ML.fit(train, "logistic", ML.logistic(train.count(), 2000), label=fx.TARGET_WIDE,
               numeric=PR.FEATURES_WIDE, categorical=[])
    return r6(ML.coefficients(m))


@register("h6_forest_metrics")
def q_h6(spark, sf):
    """E5 / H6 / I4 / F2: random forest on the baseline case; KS with threshold."""
    feats = _wide_model_frame(spark, sf)
    train, test = SP.stratified_split(feats, 0.2, fx.TARGET_WIDE, "ID")
    m = ML.fit(train, "forest", ML.forest(), label=fx.TARGET_WIDE, numeric=PR.FEATURES_WIDE, categorical=[])
    scored = m.score(test, "forest_pd")
    return r6(M.ks_with_threshold(scored, fx.TARGET_WIDE, "forest_pd").crossJoin(
        M.binary_metrics(scored, fx.TARGET_WIDE, "forest_pd").select("auc")))


# ---------------------------------------------------------------- two-extract mode

def extracts(spark, sf):
    """Both extracts from one scan of the panel: the deduped months are stored, the loans' statics come from them."""
    panel = fx.loan_panel(spark, sf)
    perf = materialize(snap.dedupe_keep_last(panel, ["loan_id", "reporting_month"], ["ingest_date", "ingest_key", "ingest_line"]))
    return fx.origination_extract(spark, sf, perf), perf


EXTRA_CTES = """,
perf AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY loan_id, reporting_month
           ORDER BY ingest_date DESC, ingest_key DESC, ingest_line DESC) AS rn FROM panel) WHERE rn = 1),
orig AS (SELECT loan_id, max(origination_date) AS origination_date, max(original_upb) AS original_upb,
           max(original_ltv) AS original_ltv, max(original_dti) AS original_dti,
           max(borrower_credit_score) AS borrower_credit_score, max(original_interest_rate) AS original_interest_rate,
           max(original_loan_term) AS original_loan_term, max(loan_purpose) AS loan_purpose,
           max(occupancy_status) AS occupancy_status, max(property_state) AS property_state,
           max(property_type) AS property_type FROM panel GROUP BY loan_id)"""
EXTRACT_SQL = V.PANEL + EXTRA_CTES

D6_SQL = with_(EXTRACT_SQL + """,
j AS (SELECT p.loan_id, p.reporting_month, p.current_actual_upb, p.current_delinquency_status,
        coalesce(p.modification_flag, 'Unknown') AS modification_flag, o.original_upb,
        (year(p.reporting_month) - year(o.origination_date)) * 12 + month(p.reporting_month) - month(o.origination_date) AS mob
      FROM perf p JOIN orig o USING (loan_id)
      WHERE o.origination_date IS NOT NULL AND p.reporting_month IS NOT NULL AND p.current_delinquency_status IS NOT NULL),
j1 AS (SELECT * FROM j WHERE mob >= 1),
a AS (SELECT loan_id, max(mob) AS max_mob,
        count(*) FILTER (WHERE mob BETWEEN 1 AND 6) AS nh, count(*) FILTER (WHERE mob BETWEEN 7 AND 18) AS nf,
        max(current_delinquency_status) FILTER (WHERE mob BETWEEN 1 AND 6) AS hist_max_dpd,
        CAST(count(*) FILTER (WHERE mob BETWEEN 1 AND 6 AND current_delinquency_status >= 1) AS BIGINT) AS hist_30dpd_months,
        avg(current_actual_upb) FILTER (WHERE mob BETWEEN 1 AND 6) AS hist_avg_upb,
        stddev_samp(current_actual_upb) FILTER (WHERE mob BETWEEN 1 AND 6) AS hist_upb_volatility,
        CAST(count(*) FILTER (WHERE mob BETWEEN 1 AND 6 AND modification_flag = 'Y') AS BIGINT) AS hist_modified_months,
        max(mob) FILTER (WHERE mob BETWEEN 1 AND 6) AS last_h,
        CAST(CASE WHEN max(current_delinquency_status) FILTER (WHERE mob BETWEEN 7 AND 18) >= 3 THEN 1 ELSE 0 END AS INTEGER)
          AS bad_12m_90dpd
      FROM j1 GROUP BY loan_id),
lat AS (SELECT j1.loan_id, j1.current_actual_upb AS hist_latest_upb, j1.current_delinquency_status AS hist_latest_dpd,
          CASE WHEN j1.original_upb = 0 THEN NULL ELSE j1.current_actual_upb / j1.original_upb END AS hist_upb_to_original_upb
        FROM j1 JOIN a ON j1.loan_id = a.loan_id AND j1.mob = a.last_h)""", """
SELECT o.loan_id, o.origination_date, o.original_upb, o.original_ltv, o.original_dti, o.borrower_credit_score,
  o.original_interest_rate, o.original_loan_term, coalesce(o.loan_purpose, 'Unknown') AS loan_purpose,
  coalesce(o.occupancy_status, 'Unknown') AS occupancy_status, coalesce(o.property_state, 'Unknown') AS property_state,
  coalesce(o.property_type, 'Unknown') AS property_type, a.hist_max_dpd, a.hist_30dpd_months,
  round(a.hist_avg_upb, 6) AS hist_avg_upb, round(a.hist_upb_volatility, 6) AS hist_upb_volatility,
  a.hist_modified_months, lat.hist_latest_upb, lat.hist_latest_dpd,
  round(lat.hist_upb_to_original_upb, 6) AS hist_upb_to_original_upb, a.bad_12m_90dpd,
  CAST(o.origination_date + INTERVAL 6 MONTH AS DATE) AS observation_date
FROM orig o JOIN a USING (loan_id) JOIN lat USING (loan_id)
WHERE a.max_mob >= 18 AND a.nh > 0 AND a.nf > 0""")


@register("d6_snapshot_extracts", D6_SQL)
def q_d6(spark, sf):
    """Two-extract snapshot (max-month eligibility, last row even if NULL)."""
    orig, perf = extracts(spark, sf)
    return r6(snap.build_snapshot_extracts(orig, perf))


PANEL_COLS = ["loan_id", "reporting_month", "original_interest_rate", "original_upb", "current_actual_upb",
              "original_loan_term", "origination_date", "original_ltv", "original_dti", "borrower_credit_score",
              "loan_purpose", "property_type", "occupancy_status", "property_state", "current_delinquency_status",
              "modification_flag", "ingest_date", "ingest_key", "ingest_line"]
ORIG_COLS = ["loan_id", "origination_date", "original_upb", "original_ltv", "original_dti", "borrower_credit_score",
             "original_interest_rate", "original_loan_term", "loan_purpose", "occupancy_status", "property_state",
             "property_type"]


def _stage_sql(name, src, cols):
    rate = " + ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)" for c in cols)
    return (f"SELECT '{name}' AS stage, CAST(count(*) AS BIGINT) AS row_count, "
            f"CAST(count(DISTINCT loan_id) AS BIGINT) AS unique_loans, round(({rate}) / {len(cols)}, 6) "
            f"AS average_field_missing_rate FROM {src}")


@register("d9_stage_quality", with_(V.SNAPSHOT + EXTRA_CTES,
                                    " UNION ALL ".join([_stage_sql("origination", "orig", ORIG_COLS),
                                                        _stage_sql("performance", "perf", PANEL_COLS),
                                                        _stage_sql("snapshot", "snapshot", snap.SNAPSHOT_COLUMNS)])))
def q_d9(spark, sf):
    """Rows, distinct loans and mean field missing rate per stage."""
    orig, perf = extracts(spark, sf)
    return r6(snap.stage_quality({"origination": orig, "performance": perf, "snapshot": snapshot_df(spark, sf)}))


# ---------------------------------------------------------------- reports (2.L)
from loanlens.plans import reports as RP  # noqa: E402


@register("l1_overview_kpis", with_(V.SNAPSHOT + ",\n" + V.SCORED.strip() + PTS_SQL.format(score="pd") + f""",
e AS (SELECT pd AS value FROM scored WHERE observation_date < DATE '{SPLIT_DATE}'),
a AS (SELECT pd AS value FROM scored WHERE observation_date >= DATE '{SPLIT_DATE}')""" + psi_sql("e", "a", []), """
SELECT CAST((SELECT count(*) FROM snapshot) AS BIGINT) AS loan_count,
  round((SELECT avg(CAST(bad_12m_90dpd AS DOUBLE)) FROM snapshot), 6) AS bad_rate,
  round((SELECT sum(good * (cum_bad - bad / 2.0)) / (max(nb) * max(ng)) FROM cum, tot), 6) AS champion_auc,
  round((SELECT psi FROM psi_out), 6) AS score_psi,
  CASE WHEN (SELECT psi FROM psi_out) >= 0.10 THEN 'review' ELSE 'stable' END AS psi_flag"""))
def q_l1(spark, sf):
    s = fx.scored(spark, sf)
    d = F.col("observation_date")
    psi = S.psi_between(s, d < F.lit(SPLIT_DATE).cast("date"), "pd")
    return r6(RP.overview_kpis(snap.snapshot_summary(snapshot_df(spark, sf)), M.binary_metrics(s, "bad", "pd"), psi))


@register("l2_model_comparison", "SELECT 'model_a' AS model, * FROM (" + _metrics_sql("pd")
          + ") UNION ALL SELECT 'model_b' AS model, * FROM (" + _metrics_sql("pd_b") + ")")
def q_l2(spark, sf):
    """Comparison table of two score versions."""
    s = fx.scored(spark, sf)
    return r6(RP.model_comparison(M.binary_metrics(s, "bad", "pd").withColumn("model", F.lit("model_a")),
                                  M.binary_metrics(s, "bad", "pd_b").withColumn("model", F.lit("model_b"))))


@register("l3_top_drift", with_(J4_SQL.split("\nSELECT comparison, feature, feature_type")[0].replace("WITH ", "", 1)
                                + """,
j4 AS (SELECT comparison, feature, feature_type, psi FROM psi)""", """
SELECT comparison, feature, feature_type, round(psi, 6) AS psi, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY psi DESC, feature) AS rank FROM j4
  WHERE starts_with(comparison, 'Train vs OOT')) WHERE rank <= 10"""))
def q_l3(spark, sf):
    """Top-10 train-vs-OOT drift features."""
    s = gold_snapshot(spark, sf)
    t = RP.top_drift(S.feature_stability(s, oot_ids(s)))
    return r6(t.select("comparison", "feature", "feature_type", "psi", F.col("rank").cast("int").alias("rank")))


@register("l4_quality_alerts", "SELECT * FROM (" + D17_SQL + ") WHERE quality_status = 'alert'")
def q_l4(spark, sf):
    s = gold_snapshot(spark, sf)
    return r6(RP.quality_alerts(S.data_quality(s, oot_ids(s))))


@register("l5_quality_pivot", """SELECT feature,
  max(CASE WHEN population = 'train' THEN missing_rate END) AS train_missing_rate,
  max(CASE WHEN population = 'train' THEN invalid_rate END) AS train_invalid_rate,
  max(CASE WHEN population = 'oot' THEN missing_rate END) AS oot_missing_rate,
  max(CASE WHEN population = 'oot' THEN invalid_rate END) AS oot_invalid_rate
FROM (""" + D17_SQL + ") GROUP BY feature")
def q_l5(spark, sf):
    s = gold_snapshot(spark, sf)
    return r6(RP.quality_pivot(S.data_quality(s, oot_ids(s))))


@register("l7_latest_cohort", """SELECT baseline_cohort, cohort AS latest_cohort, bad_rate AS latest_bad_rate,
  score_psi_vs_baseline AS latest_psi, psi_status
FROM (SELECT *, min(cohort) OVER () AS baseline_cohort, max(cohort) OVER () AS mx FROM (""" + ORACLE["j5_cohort_monitoring"]
          + """)) WHERE cohort = mx""")
def q_l7(spark, sf):
    """Latest-cohort monitoring KPIs."""
    return r6(RP.latest_cohort_kpis(S.monitoring_table(fx.scored(spark, sf), "pd", "bad", "observation_date")))


# ---------------------------------------------------------------- streaming monitor, batch form (M1)
from loanlens.streaming import monitor as MON  # noqa: E402


@register("m1_daily_score_bins", """
WITH ev AS (SELECT ts, least(value / 500.0, 1.0) AS score FROM events),
base AS (SELECT score FROM ev WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM ev)),
q AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS u
      FROM base WHERE score IS NOT NULL),
ed AS (SELECT list_slice(u, 2, greatest(len(u) - 1, 1)) AS inner_ FROM q)
SELECT CAST(ts AS DATE) AS day, CAST(len(list_filter(inner_, lambda e: e < score)) AS INTEGER) AS bin,
       CAST(count(*) AS BIGINT) AS records
FROM ev, ed GROUP BY ALL""")
def q_m1(spark, sf):
    """M1 (batch form of the stream): records per event day and first-day baseline bin."""
    ev = fx.score_events(spark, sf)
    first = ev.agg(F.min(F.to_date("ts")).alias("_d"))
    base = ev.join(F.broadcast(first), F.to_date(ev.ts) == F.col("_d"), "left_semi")
    return MON.daily_score_bins(ev, MON.baseline_edges(base))


# ---------------------------------------------------------------- ingest chain over written files (2.A)
from loanlens.plans import ingest_queries  # noqa: E402, F401
