"""Learned classifiers over feature tables: encoding, candidate models, grouped folds, tree scoring, single-metric rules."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators import sets
from lintel.operators.windows import running_totals
from lintel.session import written


def vocabulary(df: DataFrame, column: str) -> list[str]:
    """Distinct values in order: the code of a value is its place."""
    return [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]  # a category's values


def encoded(df: DataFrame, vocabularies: dict[str, list[str]], severity: str | None = None) -> DataFrame:
    """Codes as doubles; values that the vocabulary lacks get the first code; severities are ordinal."""
    codes = {}
    for c, words in vocabularies.items():
        at = F.array_position(F.array(*[F.lit(w) for w in words]), F.col(c)) if words else F.lit(0)
        codes[f"{c}_code"] = F.greatest(F.coalesce(at, F.lit(0)) - 1, F.lit(0)).cast("double")
    if severity:
        level = F.lower(severity)
        codes[f"{severity}_code"] = F.when(level == "high", 2.0).when(level == "medium", 1.0).otherwise(0.0)
    return df.withColumns(codes)


def candidates(features: list[str], label: str, seed: int = 7) -> dict[str, Pipeline]:
    """Logistic regression on scaled logs, a forest, and boosted trees."""
    raw = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")
    logs = VectorAssembler(inputCols=[f"log_{f}" for f in features], outputCol="logs", handleInvalid="keep")
    scaled = StandardScaler(inputCol="logs", outputCol="scaled", withMean=True)
    return {
        "logistic": Pipeline(stages=[logs, scaled, LogisticRegression(featuresCol="scaled", labelCol=label, regParam=0.01)]),
        "forest": Pipeline(stages=[raw, RandomForestClassifier(featuresCol="raw", labelCol=label, numTrees=40, seed=seed)]),
        "boosted": Pipeline(stages=[raw, GBTClassifier(featuresCol="raw", labelCol=label, maxIter=20, maxDepth=3, seed=seed)]),
    }


def regressors(features: list[str], label: str, seed: int = 7) -> dict[str, Pipeline]:
    raw = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")
    models = {"linear": LinearRegression(featuresCol="raw", labelCol=label, regParam=0.01), "forest": RandomForestRegressor(featuresCol="raw", labelCol=label, numTrees=40, seed=seed), "boosted": GBTRegressor(featuresCol="raw", labelCol=label, maxIter=20, maxDepth=3, seed=seed)}
    return {k: Pipeline(stages=[raw, m]) for k, m in models.items()}


def with_logs(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f"log_{f}": F.log1p(F.greatest(F.col(f).cast("double"), F.lit(0.0))) for f in features})


def out_of_fold(df: DataFrame, pipeline: Pipeline, group: str, folds: int = 5, seed: int = 7, label: str | None = None) -> DataFrame:
    """Append `probability1`, each row scored by a model that saw none of its group. Models are chosen by this, never by test rows.

    label: deal groups so that its classes have about the same share in each fold, else by hash."""
    if label is None:
        cut = sets.folds_by_group(df, group, folds, seed)
    else:
        dealt = sets.stratified_folds(df, group, label, folds, seed=seed).select(F.col("group").alias("__group"), "fold")
        cut = df.join(dealt, F.coalesce(F.col(group).cast("string"), F.lit("")) == F.col("__group")).drop("__group")
    cut = written(cut, "folds")
    parts = [cut.withColumn("probability1", F.lit(0.0)).limit(0)]
    for k in range(folds):
        test = cut.filter(F.col("fold") == k)
        if not test.isEmpty():
            parts.append(pipeline.fit(cut.filter(F.col("fold") != k)).transform(test).withColumn("probability1", vector_to_array("probability")[1]).select(*df.columns, "fold", "probability1"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tree_score(trees: list[dict], features: dict[str, Column], rate: float = 0.1, start: float = 0.0, kind: str = "float", mean: bool = False) -> Column:
    """Probability of an ensemble as one expression. A tree is {"leaf": v} or {"feature", "threshold", "left", "right"}; values up to the threshold go left.

    kind: the type in which values and thresholds are compared. mean: leaves are probabilities, their mean is the result."""

    def value(t: dict) -> Column:
        if "leaf" in t:
            return F.lit(float(t["leaf"]))
        return F.when(features[t["feature"]].cast(kind) <= F.lit(float(t["threshold"])).cast(kind), value(t["left"])).otherwise(value(t["right"]))

    total = F.lit(float(start))
    for t in trees:
        total = total + rate * value(t)
    return total / (rate * len(trees)) if mean else 1.0 / (1.0 + F.exp(-total))


def fitted_tree(node, features: list[str], leaf) -> dict:
    """A fitted tree's node as a tree of tree_score(); leaf: what a leaf of the model is worth. Splits must be by a threshold."""
    if node.getClass().getSimpleName() == "LeafNode":
        return {"leaf": leaf(node)}
    split = node.split()
    left, right = (fitted_tree(n, features, leaf) for n in (node.leftChild(), node.rightChild()))
    return {"feature": features[split.featureIndex()], "threshold": split.threshold(), "left": left, "right": right}


def fitted_classifier(model, features: list[str]) -> dict:
    """A fitted forest or boosted ensemble of two classes (or a pipeline that ends in one) as a classifier of export_trees()."""
    model = model.stages[-1] if hasattr(model, "stages") else model
    jvm = model._java_obj
    roots = [t.rootNode() for t in jvm.trees()]
    if "GBT" in type(model).__name__:
        # the margin counts twice in the probability; a tree's weight goes into its leaves
        weights = list(jvm.treeWeights())
        trees = [fitted_tree(r, features, lambda n, w=w: 2.0 * w * n.prediction()) for r, w in zip(roots, weights, strict=True)]
        return {"trees": trees, "rate": 1.0, "start": 0.0, "kind": "double"}

    def share(n) -> float:
        stats = list(n.impurityStats().stats())
        return stats[1] / sum(stats) if sum(stats) else 0.0

    return {"trees": [fitted_tree(r, features, share) for r in roots], "rate": 1.0, "start": 0.0, "kind": "double", "mean": True}


def score_of(classifier: dict, features: dict[str, Column]) -> Column:
    return tree_score(classifier["trees"], features, classifier.get("rate", 0.1), classifier.get("start", 0.0), classifier.get("kind", "float"), classifier.get("mean", False))


def compared(df: DataFrame, pipelines: dict[str, Pipeline], label: str, group: str, folds: int = 5, seed: int = 7) -> DataFrame:
    """(model, auc, accuracy, rows) of each pipeline and of `majority`, which gives every row its fold's share of ones elsewhere; from rows that a model hasn't seen."""
    from lintel.operators.metrics import roc_auc

    found = None
    for name, pipeline in pipelines.items():
        scored = out_of_fold(df, pipeline, group, folds, seed, label).select(F.col(label).cast("int").alias("y"), F.col("probability1").alias("p"), "fold")
        scored = written(scored, "scored")
        parts = {name: scored}
        if found is None:
            ones = scored.groupBy("fold").agg(F.sum("y").alias("o"), F.count(F.lit(1)).alias("n"))
            whole = ones.agg(F.sum("o").alias("all_o"), F.sum("n").alias("all_n"))
            shares = ones.crossJoin(F.broadcast(whole)).select("fold", F.try_divide(F.col("all_o") - F.col("o"), F.col("all_n") - F.col("n")).alias("share"))  # a row a fold
            parts["majority"] = scored.join(F.broadcast(shares), "fold").select("y", F.coalesce("share", F.lit(0.0)).alias("p"), "fold")
        for n, rows in parts.items():
            right = rows.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("rows"))
            row = roc_auc(rows, F.col("p"), F.col("y")).select(F.lit(n).alias("model"), "auc").crossJoin(F.broadcast(right))  # one row each
            found = row if found is None else found.unionByName(row)
    return found


def winner(comparison: DataFrame) -> str:
    """The model with the best ranking of rows it hasn't seen; of equal ones the first by name. The majority wins if nothing ranks better."""
    best = comparison.orderBy(F.desc(F.when(F.col("model") == "majority", 0.5).otherwise(F.col("auc"))), F.col("model") != "majority", "model").first()
    return best["model"]


FORMAT = {"format": "boosted-trees", "version": 1}


def store_of(path: str):
    """(file system, path in it) of an address of any store that pyarrow reads, or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def export_trees(path: str, classifiers: dict[str, dict]) -> None:
    """Write classifiers as JSON: by smell {"trees", "rate", "start", "threshold", "enabled"}."""
    store, place = store_of(path)
    with store.open_output_stream(place) as f:
        f.write(json.dumps({**FORMAT, "classifiers": classifiers}).encode())


def load_trees(path: str) -> dict[str, dict]:
    """Classifiers of a JSON file; another format or version raises."""
    store, place = store_of(path)
    with store.open_input_stream(place) as f:
        found = json.loads(f.read())
    if any(found.get(k) != v for k, v in FORMAT.items()):
        raise ValueError(f"{path} is not a model of this format and version")
    return found["classifiers"]


def learned_smells(classifiers: dict[str, dict], experimental: bool = False) -> list[str]:
    """Smells with an enabled classifier; experimental: with any."""
    return sorted(k for k, c in classifiers.items() if experimental or c.get("enabled", True))


def model_findings(df: DataFrame, classifiers: dict[str, dict], features: dict[str, Column], experimental: bool = False) -> DataFrame:
    """A row for each entity and smell whose probability reaches the smell's threshold: df's columns, smell, probability. One pass for all smells."""
    names = learned_smells(classifiers, experimental)
    if not names:
        return df.withColumns({"smell": F.lit(""), "probability": F.lit(0.0)}).limit(0)
    scored = F.array(
        *[
            F.struct(F.lit(n).alias("smell"), score_of(c, features).alias("probability"), F.lit(float(c.get("threshold", 0.5))).alias("least"))
            for n, c in ((n, classifiers[n]) for n in names)
        ]
    )
    found = df.select(*df.columns, F.explode(scored).alias("__s")).filter("__s.probability >= __s.least")
    return found.select(*df.columns, F.col("__s.smell").alias("smell"), F.col("__s.probability").alias("probability"))


def single_metric_rule(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The best rule `feature >= x` or `feature <= x` by F1: feature, direction, threshold, f1. Sorted running counts, once a feature and direction."""
    best = None
    total = df.agg(F.sum(label)).first()[0] or 0
    for pos, f in enumerate(features):
        counts = df.filter(F.col(f).isNotNull()).groupBy(F.col(f).cast("double").alias("x")).agg(F.sum(label).alias("ones"), F.count(F.lit(1)).alias("rows"))
        for way in (">=", "<="):
            run = running_totals(counts, "x", ["ones", "rows"], descending=way == ">=")
            found = run.select(F.lit(pos).alias("pos"), F.lit(f).alias("feature"), F.lit(way).alias("direction"), F.col("x").alias("threshold"), F.try_divide(2.0 * F.col("run_ones"), F.col("run_rows") + F.lit(float(total))).alias("f1"))
            best = found if best is None else best.unionByName(found)
    return best.orderBy(F.desc("f1"), "pos", F.desc("direction"), "threshold").limit(1).drop("pos")
