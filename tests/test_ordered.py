"""Bucketed global order helpers against brute force, incl. a hot tie value."""

import numpy as np
import pandas as pd
import pytest

from loanlens.operators.ordered import exact_quantiles, prefix_sums, row_ranks
from loanlens.operators import metrics as M


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    score = np.round(rng.random(n), 3)
    score[: n // 3] = 0.5            # a third of all rows share one value
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "score": score, "y": y, "g": rng.integers(0, 3, n)})
    return pdf, spark.createDataFrame(pdf)


def test_row_ranks_match_sorted_order(skewed):
    pdf, df = skewed
    got = row_ranks(df, "score", "id", buckets=16).select("id", "rank").toPandas().set_index("id")["rank"]
    want = pdf.sort_values(["score", "id"]).reset_index(drop=True)
    want = pd.Series(np.arange(1, len(want) + 1), index=want["id"])
    assert (got.sort_index() == want.sort_index()).all()


def test_grouped_row_ranks(skewed):
    pdf, df = skewed
    got = row_ranks(df, "score", "id", ["g"], buckets=8).select("id", "rank").toPandas().set_index("id")["rank"]
    want = pdf.sort_values(["g", "score", "id"]).groupby("g").cumcount() + 1
    want.index = pdf.sort_values(["g", "score", "id"])["id"]
    assert (got.sort_index() == want.sort_index()).all()


def test_prefix_sums_descending(skewed, spark):
    pdf, df = skewed
    d = df.groupBy("score").sum("y").withColumnRenamed("sum(y)", "b")
    got = prefix_sums(d, "score", ["b"], descending=True, buckets=16).toPandas().sort_values("score", ascending=False)
    assert (got["cum_b"].to_numpy() == got["b"].cumsum().to_numpy()).all()


def test_exact_quantiles_match_numpy(skewed):
    pdf, df = skewed
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    row = exact_quantiles(df, "score", probs, buckets=16).first()
    want = np.quantile(pdf["score"], probs)
    assert np.allclose([row[f"q{i}"] for i in range(len(probs))], want, atol=1e-12)


def _brute_metrics(y, s):
    order = np.argsort(-s, kind="stable")
    pos, neg = y.sum(), len(y) - y.sum()
    # AUC by pairwise comparison with ties counted half
    sp, sn = s[y == 1], s[y == 0]
    auc = ((sp[:, None] > sn[None, :]).sum() + 0.5 * (sp[:, None] == sn[None, :]).sum()) / (pos * neg)
    uniq = np.unique(s)[::-1]
    tp = np.array([(s[y == 1] >= u).sum() for u in uniq])
    fp = np.array([(s[y == 0] >= u).sum() for u in uniq])
    ks = max(0.0, float(np.max(tp / pos - fp / neg)))
    prec = tp / (tp + fp)
    rec = tp / pos
    ap = float(np.sum(np.diff(np.r_[0.0, rec]) * prec))
    del order
    return auc, ks, ap


def test_metrics_match_brute_force(skewed):
    pdf, df = skewed
    row = M.binary_metrics(df, "y", "score").first()
    auc, ks, ap = _brute_metrics(pdf["y"].to_numpy(), pdf["score"].to_numpy())
    assert abs(row["auc"] - auc) < 1e-12 and abs(row["ks"] - ks) < 1e-12 and abs(row["pr_auc"] - ap) < 1e-12


def test_deciles_equal_frequency(skewed):
    pdf, df = skewed
    t = M.decile_table(df, "y", "score", "id").toPandas()
    assert sorted(t["decile"]) == list(range(1, 11))
    assert t["sample_count"].sum() == len(pdf)
    assert t["sample_count"].max() - t["sample_count"].min() <= 1


def test_text_ids_any_order(spark):
    rows = [(f"L{i % 13}x{i}", 0.5 if i % 3 else i / 100) for i in range(200)]
    got = row_ranks(spark.createDataFrame(rows, "id string, s double"), "s", "id", buckets=7).collect()
    want = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert {r["id"]: r["rank"] for r in got} == want


def test_empty_and_equal_values(spark):
    none = spark.createDataFrame([], "id string, s double, g string")
    assert exact_quantiles(none, "s", [0.0, 0.5, 1.0]).count() == 0
    assert exact_quantiles(none, "s", [0.5], ["g"]).count() == 0
    assert row_ranks(none, "s", "id").count() == 0 and prefix_sums(none, "s", ["s"]).count() == 0
    same = spark.createDataFrame([(str(i), 0.25, "a") for i in range(50)], "id string, s double, g string")
    row = exact_quantiles(same, "s", [0.0, 0.3, 1.0], ["g"]).first()
    assert [row["_n"], row["q0"], row["q1"], row["q2"]] == [50, 0.25, 0.25, 0.25]
    from loanlens.operators import stability as S
    assert S.population_stability_index(none, same, "s").first()["psi"] == 0.0


@pytest.mark.parametrize("buckets", [1, 7, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_next_values_reach_over_partitions(spark, buckets, descending):
    rows = [(g, float(x), (x * 7) % 5 if x % 4 else None) for g in ("a", "b", "c") for x in range(40 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, x double, v int")
    got = {(r.g, r.x): r.next_v for r in prefix_sums(df, "x", ["v"], ["g"], descending, buckets, following=["v"]).collect()}
    want = {}
    for g in ("a", "b", "c"):
        own = sorted([r for r in rows if r[0] == g], key=lambda r: r[1], reverse=descending)
        want |= {(g, r[1]): after[2] if after else None for r, after in zip(own, [*own[1:], None], strict=True)}
    assert got == want


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_roc_curve_drops_what_lies_on_a_line(skewed, groups):
    pdf, df = skewed
    got = M.roc_curve(df, "y", "score", groups).toPandas()
    for key, part in (pdf.groupby("g") if groups else [(None, pdf)]):
        mine = got[got["g"] == key] if groups else got
        counts = part.groupby("score")["y"].agg(["sum", "count"]).sort_index(ascending=False)
        steps = list(zip(counts["sum"], counts["count"] - counts["sum"], strict=True))
        kept = [s for i, s in enumerate(counts.index) if i in (0, len(steps) - 1) or steps[i] != steps[i + 1]]
        assert sorted(mine["threshold"]) == sorted([*kept, float("inf")])
