"""Which features drive a score, and the sentences that say so."""

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import md5
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.functions.columns import fixed
from moneytrail.functions.ranking import smallest_hashes
from moneytrail.operators.anomaly import Forest, Mixtures, Walk, mean_path
from moneytrail.operators.quality import finite_or_zero
from moneytrail.scratch import materialize_counted, sorted_join

TOP = 5
#: Orders of features and background accounts that forest contributions are sampled from.
PERMUTATIONS, BACKGROUND, SEED = 16, 8, 42

# What the features are called in a sentence.
DESCRIPTIONS = {
    "velocity_7d": "Transaction velocity",
    "total_sent_30d": "30-day outflow",
    "total_received_30d": "30-day inflow",
    "txn_count_30d": "Transaction frequency",
    "unique_counterparties_30d": "Counterparty diversity",
    "avg_txn_amount": "Average transaction amount",
    "std_txn_amount": "Transaction amount variability",
    "max_single_txn": "Largest single transaction",
    "night_txn_ratio": "Night-time transaction ratio",
    "sent_received_ratio": "Send/receive imbalance",
    "days_since_last_txn": "Days since last activity",
    "account_age_days": "Account age",
    "in_degree": "Incoming connections",
    "out_degree": "Outgoing connections",
    "betweenness_centrality": "Network centrality",
    "clustering_coefficient": "Neighbourhood density",
    "pagerank_score": "Network importance",
    "is_in_cycle": "Cycle participation",
    "hop_count_to_flagged": "Distance to flagged accounts",
}

# What the patterns are called in a sentence.
PATTERN_PHRASES = {
    "CIRCULAR_ROUND_TRIP": "circular round-tripping",
    "LAYERING": "fund layering through intermediaries",
    "STRUCTURING": "structuring (transactions below ₹50,000 threshold)",
    "DORMANT_ACTIVATION": "dormant account sudden activation",
    "PROFILE_MISMATCH": "profile mismatch (high-value credits to low-income profile)",
}
# The closing sentence of a narrative by tier.
ADVICE = {
    "CRITICAL": "Recommendation: Freeze account immediately and file STR with FIU-IND.",
    "HIGH": "Recommendation: Immediate review by senior investigator required.",
}


def _named(value: Column, names: dict[str, str]) -> Column:
    return reduce(lambda c, k: c.when(value == k, names[k]), names, F).otherwise(value)


def readable(feature: Column, value: Column, raises: Column) -> Column:
    """``<what> is 12 (increases risk)`` for large values, ``<what> = 0.50 (...)`` for others."""
    said = F.when(F.abs(value) > 10, F.concat(F.lit(" is "), fixed(value, 0))).otherwise(
        F.concat(F.lit(" = "), fixed(value, 2))
    )
    return F.concat(
        _named(feature, DESCRIPTIONS), said, F.lit(" ("), F.when(raises, "increases").otherwise("decreases"), F.lit(" risk)")
    )


def top_features(contributions: dict[str, Column], values: dict[str, Column], top: int = TOP) -> Column:
    """The ``top`` contributions of a row by size, as an array of structs; feature order settles ties."""
    items = F.array(*[
        F.struct(
            (-F.abs(share)).alias("order"), F.lit(i).alias("place"), F.lit(name).alias("feature"),
            share.alias("share"), values[name].cast("double").alias("value"),
        )
        for i, (name, share) in enumerate(contributions.items())
    ])

    def item(x, i):
        raises = x["share"] > 0
        return F.struct(
            (i + 1).alias("rank"),
            x["feature"].alias("feature"),
            F.round(x["share"], 4).alias("shap_value"),
            F.round(x["value"], 2).alias("actual_value"),
            F.when(raises, "increases_risk").otherwise("decreases_risk").alias("direction"),
            readable(x["feature"], x["value"], raises).alias("readable"),
        )

    return F.transform(F.slice(F.array_sort(items), 1, top), item)


def explain_linear(wide: DataFrame, weights: dict[str, dict[str, float]], top: int = TOP, only: DataFrame | None = None) -> DataFrame:
    """Exact Shapley values of a linear score: weight times distance from the mean.

    ``weights`` maps each base feature to the weights of its own column and of its hop means; their
    contributions are added up. Means are taken over all accounts; ``only`` names the ``account_id``s to explain, by
    default all.
    """
    used = sorted({c for parts in weights.values() for c in parts})
    means = wide.agg(F.struct(*[F.avg(c).alias(c) for c in used]).alias("means")).scalar()
    explained = wide if only is None else wide.join(only.select("account_id"), "account_id", "left_semi")
    with_means = explained.withColumn("means", means)
    shares = {
        feature: sum((F.lit(float(w)) * (F.col(c) - F.col(f"means.{c}")) for c, w in parts.items()), F.lit(0.0))
        for feature, parts in weights.items()
    }
    values = {feature: F.col(feature) for feature in weights}
    return with_means.select("account_id", top_features(shares, values, top).alias("explanation"))


def model_weights(model) -> dict[str, dict[str, float]]:
    """Weights of a trained node model, grouped by base feature."""
    by_input = dict(zip(model.inputs, model.regression.coefficients.toArray()))
    return {
        c: {i: float(w) for i, w in by_input.items() if i == c or i.startswith(f"{c}_h")} for c in model.columns
    }


def split(accounts: DataFrame, n: int) -> DataFrame:
    """``accounts``, ``n`` at most, over enough tasks for work that takes long per row; files of few bytes would make few."""
    cores = accounts.sparkSession.sparkContext.defaultParallelism
    return accounts.repartition(max(1, min(-(-n // 256), max(4 * cores, -(-n // 16384)))), "account_id")


def gathered(batches: Iterable[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have so many rows, so that work per batch counts little."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held)
            held.clear()
    if sum(map(len, held)):
        yield pd.concat(held)


def explain_forest(matrix: DataFrame, trees: DataFrame, columns: list[str], drawn: int, top: int = TOP) -> DataFrame:
    """Contributions to the isolation score by ablation: what the score loses if a feature is set to its mean.

    The matrix is standardised, so the mean is 0.
    """
    forest = Forest(trees)
    expected = mean_path(drawn) or 1.0
    shares = [f"share_{i}" for i in range(len(columns))]

    def run(batches):
        for pdf in gathered(batches, Mixtures.ROWS):
            x, nth = np.unique(pdf[columns].to_numpy(dtype=float), axis=0, return_inverse=True)
            given = np.zeros_like(x)
            for at in range(0, len(x), Forest.SLICE):
                part = x[at:at + Forest.SLICE]
                full, *without = (np.exp2(-paths / expected) for paths in Walk(forest, part, np.zeros(x.shape[1])).without())
                given[at:at + Forest.SLICE] = np.stack([full - w for w in without], axis=1)
            # equal accounts have equal shares
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(given[nth.ravel()], columns=shares)], axis=1)

    clean = finite_or_zero(matrix.select("account_id", *columns), columns)
    schema = "account_id string, " + ", ".join(f"`{c}` double" for c in [*columns, *shares])
    scored = split(clean, matrix.count()).mapInPandas(run, schema)
    return scored.select("account_id", top_features(
        {c: F.col(s) for c, s in zip(columns, shares)}, {c: F.col(c) for c in columns}, top
    ).alias("explanation"))


def permutations_of(columns: list[str], count: int | None, seed: int) -> list[list[int]]:
    """``count`` orders of the columns, each followed by its reverse, by hashes of seed, number and name; without a count all."""
    if count is None:
        return [list(p) for p in permutations(range(len(columns)))]
    orders: list[list[int]] = []
    for m in range((count + 1) // 2):
        order = sorted(range(len(columns)), key=lambda j: md5(f"{seed}:{m}:{columns[j]}".encode()).digest())
        orders += [order, order[::-1]]
    return orders


def forest_contributions(matrix: DataFrame, trees: DataFrame, columns: list[str], drawn: int, count: int | None = PERMUTATIONS,
                         background: int = BACKGROUND, seed: int = SEED, only: DataFrame | None = None) -> DataFrame:
    """Shapley values of the isolation score: account_id, base, score, and ``shares``, one per column.

    A feature's share is the mean of what it adds to the score when the features of an account take the place of those of a
    background account one by one, over sampled orders of the features. ``base`` is the mean score of the ``background``
    accounts, those with the smallest hashes of their ids, so that shares add up to score - base. Every pair of an order and
    its reverse meets one of them in turn; without a ``count`` all orders meet all of them, which is exact and meant for few
    features. ``only`` names the ``account_id``s to explain, by default all. Repeatable: orders and background come from ``seed``.
    """
    forest = Forest(trees)
    expected = mean_path(drawn) or 1.0
    clean, n = materialize_counted(finite_or_zero(matrix.select("account_id", *columns), columns), "explained")
    # bounded by ``background``, whatever the number of accounts
    behind = smallest_hashes(clean, "account_id", background, seed).toPandas().sort_values("account_id")[columns].to_numpy(dtype=float)
    behind = list(behind)
    orders = permutations_of(columns, count, seed)
    if count is None:
        walks = [(order, z) for order in orders for z in behind]
    else:
        # whole rounds through the background, so that its rows count alike
        rounds = -(-max(1, len(orders) // 2) // max(1, len(behind))) * len(behind)
        orders = permutations_of(columns, 2 * rounds, seed)
        walks = [(order, behind[i // 2 % len(behind)]) for i, order in enumerate(orders)]

    places = np.array([np.argsort(order) for order, _ in walks], dtype=int).reshape(-1, len(columns))
    mixed = Mixtures(forest, places + 1, np.array([z for _, z in walks], dtype=float).reshape(-1, len(columns)))

    def contributions(x: np.ndarray) -> np.ndarray:
        shares = np.zeros_like(x)
        for rows, chosen, paths in mixed.mean_paths(x):
            added = np.diff(np.exp2(-paths / expected), axis=2)
            for n, place in enumerate(places[chosen]):
                shares[rows] += added[:, n, place]
        return shares / max(1, len(walks))

    def run(batches):
        base = float(np.exp2(-forest.mean_paths(np.array(behind)) / expected).mean()) if len(behind) else 0.0
        for pdf in gathered(batches, Mixtures.ROWS):
            # equal accounts have equal shares
            x, nth = np.unique(pdf[columns].to_numpy(dtype=float), axis=0, return_inverse=True)
            score, shares, nth = np.exp2(-forest.mean_paths(x) / expected), contributions(x), nth.ravel()
            yield pd.DataFrame({"account_id": pdf["account_id"].to_numpy(), "base": base, "score": score[nth], "shares": list(shares[nth])})

    explained = clean if only is None else clean.join(only.select("account_id"), "account_id", "left_semi")
    return split(explained, n).mapInPandas(run, "account_id string, base double, score double, shares array<double>")


def explain_forest_shapley(matrix: DataFrame, trees: DataFrame, columns: list[str], drawn: int, top: int = TOP,
                           only: DataFrame | None = None, **sampling) -> DataFrame:
    """The strongest features of ``forest_contributions`` per account, as ``explain_forest`` gives them."""
    found = forest_contributions(matrix, trees, columns, drawn, only=only, **sampling)
    clean = finite_or_zero(matrix.select("account_id", *columns), columns)
    shares = {c: F.get("shares", F.lit(i)) for i, c in enumerate(columns)}
    return found.join(sorted_join(clean), "account_id").select(
        "account_id", top_features(shares, {c: F.col(c) for c in columns}, top).alias("explanation")
    )


def anomaly_text(account: Column, score: Column, explanation: Column) -> Column:
    """``Account X flagged with anomaly score 0.71. Key factors: ...`` with the first three features."""
    def factor(x):
        return F.concat(
            x["feature"], F.lit(" ("), F.replace(x["direction"], F.lit("_"), F.lit(" ")), F.lit(", SHAP: "),
            fixed(x["shap_value"], 3), F.lit(")"),
        )

    return F.concat(
        F.lit("Account "), account, F.lit(" flagged with anomaly score "), fixed(score, 2), F.lit(". Key factors: "),
        F.array_join(F.transform(F.slice(explanation, 1, 3), factor), "; "), F.lit("."),
    )


def narrative(df: DataFrame) -> DataFrame:
    """A few sentences per account from its scores, patterns and strongest features.

    Reads ``account_id, risk_score, risk_tier, triggered_patterns, gnn_fraud_prob, anomaly_score`` and, if there
    are any, ``gnn_top`` and ``anomaly_top``, the readable form of the strongest feature of each model.
    """
    for name in ("gnn_top", "anomaly_top"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    p, a, tier = F.col("gnn_fraud_prob"), F.col("anomaly_score"), F.col("risk_tier")
    head = F.concat(
        F.lit("Account "), F.col("account_id"), F.lit(" is flagged "), tier, F.lit(" (score: "),
        fixed(F.col("risk_score"), 0), F.lit("/100)."),
    )
    percent = fixed(p * 100, 0)
    model = F.when(p > 0.5, F.when(
        F.col("gnn_top").isNotNull(),
        F.concat(F.lit("The GNN model detected structural risk (fraud probability: "), percent,
                 F.lit("%). Top signal: "), F.col("gnn_top"), F.lit(".")),
    ).otherwise(F.concat(
        F.lit("The GNN model indicates "), percent, F.lit("% fraud probability based on account neighbourhood analysis.")
    )))
    outlier = F.when(a > 0.5, F.when(
        F.col("anomaly_top").isNotNull(),
        F.concat(F.lit("Anomaly detection flagged unusual behaviour: "), F.col("anomaly_top"), F.lit(".")),
    ).otherwise(F.concat(
        F.lit("Anomaly detection score: "), fixed(a, 2),
        F.lit(" — behavioral patterns deviate significantly from baseline."),
    )))
    phrases = F.array_join(F.transform("triggered_patterns", lambda x: _named(x, PATTERN_PHRASES)), ", ")
    rules = F.when(F.size("triggered_patterns") > 0, F.concat(F.lit("AML patterns triggered: "), phrases, F.lit(".")))
    advice = reduce(lambda c, t: c.when(tier == t, ADVICE[t]), ADVICE, F)
    return df.select("account_id", F.concat_ws(" ", head, model, outlier, rules, advice).alias("narrative"))
