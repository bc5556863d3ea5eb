"""The analysis questions on the survey schema, as compositions of operators.

Each function takes DataFrames and returns a dict of result DataFrames
(nothing is collected except where an operator needs fixed-size sums).
Column names are the survey's fixed names (:mod:`ratestat.functions.constants`).

Caveats kept from the original analysis (documented, parameterised):
alphas are chosen on the same 20 % used to report R^2; the Youden threshold
is tuned on the test set; the threshold is applied with a strict ``>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.functions import constants as K
from ratestat.operators import (chartdata, classify, clean, derive, describe, effects, gram,
                                hypothesis, modelprep)
from ratestat.operators.common import broadcast_if_small, col
from ratestat.session import materialize
from ratestat.operators.common import with_one_row

ADJ_RATING = K.adjusted(K.RATING)
ADJ_DIFFICULTY = K.adjusted(K.DIFFICULTY)
NORM_TAGS = [K.normalized(t) for t in K.TAG_COLUMNS]


def adjusted_table(raw: DataFrame, also_require=(), checkpoint: bool = True) -> DataFrame:
    """Cleaning (dropna rating -> dedupe -> [dropna extra] -> tag bound),
    shrinkage, tag normalisation, totals, fixed 55-column order."""
    c = clean.clean_survey(raw.drop("row_idx") if "row_idx" in raw.columns else raw,
                           K.RATING, K.N_RATINGS, K.TAG_COLUMNS, also_require)
    adj = derive.bayes_adjust(c, [K.RATING, K.DIFFICULTY], K.N_RATINGS)
    adj = derive.normalize_by(adj, K.TAG_COLUMNS, K.N_RATINGS, suffix=K.NORMALIZED_SUFFIX)
    adj = derive.tag_totals(adj, K.TAG_COLUMNS, K.N_RATINGS, K.TOTAL_TAGS, K.TAGS_PER_RATING)
    adj = adj.select(*[col(c) for c in K.adjusted_column_order()])
    return materialize(adj) if checkpoint else adj


def row_key(df: DataFrame) -> DataFrame:
    """Add ``_key``: a digest of the whole (deduplicated) row in which a null
    keeps its place, used when the table has no id column."""
    row = F.to_json(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]), {"ignoreNullFields": "false"})
    return df.withColumn("_key", F.md5(row))


def gender_groups(adj: DataFrame) -> DataFrame:
    return clean.exclusive_groups(adj, K.MALE, K.FEMALE, labels=("male", "female"))


def audits(raw: DataFrame) -> dict[str, DataFrame]:
    body = raw.drop("row_idx") if "row_idx" in raw.columns else raw
    return {
        "duplicates": clean.count_duplicate_rows(clean.drop_missing(body, [K.RATING])),
        "flag_overlap": clean.flag_overlap(body, K.MALE, K.FEMALE),
        "rows": clean.row_count(body),
    }


def q1_rating(adj: DataFrame, alpha: float = K.ALPHA) -> dict[str, DataFrame]:
    g = gender_groups(adj)
    test = hypothesis.ttest_gated(g, "grp", ADJ_RATING, "male", "female", alpha, "greater")
    return {
        "describe": describe.group_describe(g, "grp", ADJ_RATING),
        "test": test.withColumn("verdict", derive.verdict(F.col("p_value"), alpha, "lt")),
        "histogram": chartdata.histogram_fixed(g, "grp", ADJ_RATING,
                                               chartdata.arange_edges(0.75, 5.25, 0.1)),
    }


def q2_spread(adj: DataFrame, alpha: float = K.ALPHA) -> dict[str, DataFrame]:
    g = gender_groups(adj)
    lev = hypothesis.levene(g, "grp", ADJ_RATING)
    return {"levene": lev.withColumn("differs", F.col("p_value") <= alpha),
            "box": chartdata.box_stats(g, "grp", ADJ_RATING)}


def q3_effects(adj: DataFrame, replicates: int = K.BOOT_REPLICATES, draws: int = K.BOOT_DRAWS,
               seed=K.SEED, key: str | None = None) -> dict[str, DataFrame]:
    g = gender_groups(adj if key else row_key(adj))
    key = key or "_key"
    reps = materialize(effects.bootstrap_effects(effects.bootstrap_replicates(
        g, "grp", ADJ_RATING, key, ["male", "female"], replicates, draws, seed)))
    return {"replicates": reps,
            "ci": effects.bootstrap_ci(reps, ["d_average", "var_ratio"]),
            "hist_d": chartdata.histogram_auto(reps, None, "d_average", 50),
            "hist_ratio": chartdata.histogram_auto(reps, None, "var_ratio", 50)}


def q4_tags(adj: DataFrame, alpha: float = K.ALPHA) -> dict[str, DataFrame]:
    g = gender_groups(adj).filter(col(K.N_RATINGS) >= K.MIN_RATINGS_FOR_TAGS)
    long = g.select("grp", *[col(c) for c in NORM_TAGS]).unpivot(
        ["grp"], [col(c) for c in NORM_TAGS], "column_name", "value").filter(
        F.col("value") <= K.TAG_VALUE_CAP)
    res = hypothesis.mannwhitney(long, "grp", "value", "male", "female", by=["column_name"])
    res = materialize(res.select(
        derive.strip_suffix(F.col("column_name"), K.NORMALIZED_SUFFIX).alias("tag"),
        "column_name", "u1", "z", "p_value", "log10_p", "method",
        derive.verdict(F.col("p_value"), alpha, "le").alias("verdict")))
    ordered = res.orderBy(F.col("log10_p").asc_nulls_last(), F.col("tag"))
    return {"results": ordered,
            "most": ordered.limit(3),
            "least": res.orderBy(F.col("log10_p").desc_nulls_first(), F.col("tag").desc()).limit(3),
            "histogram": chartdata.histogram_fixed(
                long.withColumn("grp_tag", F.concat_ws("|", "column_name", "grp")),
                "grp_tag", "value", chartdata.arange_edges(-0.05, 1.15, 0.1))}


def q5_difficulty(adj: DataFrame, alpha: float = K.ALPHA) -> dict[str, DataFrame]:
    g = gender_groups(adj)
    welch = hypothesis.ttest(g, "grp", ADJ_DIFFICULTY, "male", "female", equal_var=False)
    return {"describe": describe.group_describe(g, "grp", ADJ_DIFFICULTY),
            "levene": hypothesis.levene(g, "grp", ADJ_DIFFICULTY),
            "welch": welch.withColumn("verdict", derive.verdict(F.col("p_value"), alpha, "le")),
            "kde": chartdata.kde_grid(g, "grp", ADJ_DIFFICULTY)}


def q6_effect(adj: DataFrame, replicates: int = K.BOOT_REPLICATES, seed=K.SEED,
              key: str | None = None) -> dict[str, DataFrame]:
    g = gender_groups(adj if key else row_key(adj))
    key = key or "_key"
    reps = materialize(effects.bootstrap_effects(effects.bootstrap_replicates(
        g, "grp", ADJ_DIFFICULTY, key, ["male", "female"], replicates, None, seed)))
    return {"cohens_d": effects.cohens_d(g, "grp", ADJ_DIFFICULTY, "male", "female"),
            "ci": effects.bootstrap_ci(reps, ["d_pooled"]),
            "hist": chartdata.histogram_auto(reps, None, "d_pooled", 30, density=True)}


Q7_FEATURES = [ADJ_DIFFICULTY, K.N_RATINGS, K.AGAIN, K.ONLINE, K.PEPPER, K.MALE, K.FEMALE]
Q10_FEATURES = [*NORM_TAGS, ADJ_DIFFICULTY, K.N_RATINGS, ADJ_RATING, K.AGAIN, K.ONLINE,
                K.MALE, K.FEMALE]


def ridge_question(adj_b: DataFrame, features, target, scale, alphas: DataFrame, seed,
                   key: str, with_vif: bool = True) -> dict[str, DataFrame]:
    """Shared skeleton of Q7-Q9: VIF, correlations, nulls, exact split,
    train-only scaling of ``scale``, one Gram pass, sweep, best alpha,
    coefficients, strongest predictor."""
    split = modelprep.exact_split(adj_b, key, seed)
    frame = materialize(modelprep.standardize(split, scale, F.col("is_test") == 0))
    sweep = materialize(gram.ridge_sweep(frame, features, target, "is_test", alphas))
    best = gram.best_alpha(sweep)
    out = {"corr": describe.corr_matrix(adj_b, features),
           "nulls": clean.null_counts(adj_b, features),
           "sweep": sweep, "best": best,
           "coefficients": gram.coefficient_table(best, features),
           "strongest": gram.strongest_predictor(best, features)}
    if with_vif:
        out["vif"] = gram.vif(adj_b, features)
    return out


def _keyed(adj_b: DataFrame, key: str | None):
    if key:
        return adj_b, key
    return row_key(adj_b), "_key"


def q7_numeric(adj_b: DataFrame, seed=K.SEED, key: str | None = None):
    df, key = _keyed(adj_b, key)
    alphas = gram.alpha_grid(df.sparkSession, "arange", 100, 0.0)
    return ridge_question(df, Q7_FEATURES, ADJ_RATING, Q7_FEATURES[:4], alphas, seed, key)


def q8_tags(adj_b: DataFrame, seed=K.SEED, key: str | None = None):
    df, key = _keyed(adj_b, key)
    alphas = gram.alpha_grid(df.sparkSession, "arange", 100, 0.0)
    return ridge_question(df, NORM_TAGS, ADJ_RATING, NORM_TAGS, alphas, seed, key)


def q9_difficulty(adj_b: DataFrame, seed=K.SEED, key: str | None = None):
    df, key = _keyed(adj_b, key)
    alphas = gram.alpha_grid(df.sparkSession, "logspace", 200, 0.0, 3.0)
    return ridge_question(df, NORM_TAGS, ADJ_DIFFICULTY, NORM_TAGS, alphas, seed, key,
                          with_vif=False)


def q10_pepper(adj_b: DataFrame, seed=K.SEED, key: str | None = None, threshold: float = 0.5,
               inclusive: bool = False) -> dict[str, DataFrame]:
    df, key = _keyed(adj_b, key)
    split = modelprep.exact_split(df, key, seed)
    frame = materialize(modelprep.standardize(split, Q10_FEATURES[:25], F.col("is_test") == 0))
    train = frame.filter(F.col("is_test") == 0)
    test = frame.filter(F.col("is_test") == 1)
    fit = materialize(classify.logistic_fit(train, Q10_FEATURES, K.PEPPER, C=1.0))
    scored = materialize(classify.logistic_proba(test, fit, Q10_FEATURES))
    points = classify.roc_points(scored, "proba", K.PEPPER)
    best = classify.youden(points)
    t = best.select(F.coalesce(F.col("threshold"), F.lit(float("inf"))).alias("_t"))
    labelled = with_one_row(scored, t)
    pred = ((F.col("proba") >= F.col("_t")) if inclusive else (F.col("proba") > F.col("_t")))
    conf = classify.confusion(labelled, K.PEPPER, pred.cast("int"))
    fixed = classify.confusion(scored, K.PEPPER, derive.threshold_labels("proba", threshold, inclusive))
    return {"balance": describe.class_balance(train, K.PEPPER),
            "corr": describe.corr_matrix(df, Q10_FEATURES),
            "nulls": clean.null_counts(df, Q10_FEATURES),
            "fit": fit, "roc": points, "auc": classify.roc_auc(scored, "proba", K.PEPPER),
            "youden": best, "confusion": conf, "report": classify.class_report(conf),
            "report_fixed_threshold": classify.class_report(fixed)}


def extra_states(adj: DataFrame, geo: DataFrame, region_map: DataFrame,
                 whitelist=K.US_STATE_CODES, alpha: float = K.ALPHA) -> dict[str, DataFrame]:
    """State means -> whitelist -> choropleth table over every geo unit;
    region lookup -> one-way ANOVA and box summary by region."""
    means = describe.group_mean(adj, K.STATE, ADJ_RATING, ADJ_RATING).withColumnRenamed(
        K.STATE, "State")
    kept = materialize(clean.whitelist_filter(means, "State", list(whitelist)))
    merged = geo.join(broadcast_if_small(kept), "State", "left")
    bounds = merged.agg(F.min(col(ADJ_RATING)).alias("vmin"), F.max(col(ADJ_RATING)).alias("vmax"))
    choro = with_one_row(merged, bounds).select(
        "State", "name", col(ADJ_RATING),
        F.try_divide(col(ADJ_RATING) - F.col("vmin"), F.col("vmax") - F.col("vmin")).alias("scaled"))
    with_region = derive.lookup(kept, "State", region_map, region_map.columns[0],
                                region_map.columns[1], out="Region")
    anova = hypothesis.anova(with_region.filter(F.col("Region").isNotNull()), "Region", ADJ_RATING)
    return {"state_means": kept, "choropleth": choro, "regions": with_region,
            "anova": anova.withColumn("verdict", derive.verdict(F.col("p_value"), alpha, "le")),
            "box": chartdata.box_stats(with_region, "Region", ADJ_RATING)}
