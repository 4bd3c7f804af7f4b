"""Training: pairs with hard negatives, an identity model, a target model, calibration."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.functions import text as X
from onomast.operators import evaluate, retrieval, scoring
from onomast.operators.settle import settle

#: What the target model sees of a root: its score, that of a second model (or its own, and whether
#: there is one), the strongest rival's, the gap, exactness, collisions, mentions, depth.
TARGET = ("own", "second", "has_second", "runner", "gap", "exact", "inverse_collisions", "support", "depth")
ROUNDS = 160
BINS = 32
#: Rows of one task when trees are grown.
PART_ROWS = 16384


@dataclass
class Model:
    identity: PipelineModel | None
    target: PipelineModel | None
    calibrator: object | None
    threshold: float
    plain_threshold: float
    version: str


def partition(adm_party_id: Column) -> Column:
    """0, 1 or 2, from the first 8 hex digits of the id (of its hash, if it has no such), for fitting,
    calibrating and choosing a threshold."""
    own = F.substring(F.replace(adm_party_id, F.lit("-"), F.lit("")), 1, 8)
    digits = F.when(own.rlike("^[0-9a-fA-F]{8}$"), own).otherwise(F.substring(F.sha2(adm_party_id, 256), 1, 8))
    return (F.conv(digits, 16, 10).cast("long") % 3).cast("int")


def weighed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copies``: how many a row stands for (one, if it does not say)."""
    return rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1).cast("long"))


def pairs(labels: DataFrame, verified: DataFrame, negatives: int = 3) -> DataFrame:
    """``mention_text, party_id, name, label, copies``: true pairs and near wrong ones, of every record.

    The wrong ones are each name's nearest verified names by character cosine, without its
    own and without names of the same base. Records that write one party alike have the same
    pairs, which are made once and carry their number.
    """
    train = labels.filter("scorable and split = 'TRAIN'").select("adm_party_id", "raw_name", "expected").filter(X.record_case(F.col("raw_name")) == "PLAIN")
    written = train.groupBy("raw_name", "expected").agg(F.count(F.lit(1)).alias("copies"))
    truth = written.join(verified.select(F.col("party_id").alias("expected"), F.col("party_name").alias("name")), "expected").select(F.col("raw_name").alias("mention_text"), F.col("expected").alias("party_id"), "name", F.lit(1).alias("label"), "copies")
    names = verified.select(F.col("party_name").alias("name")).distinct()
    texts = train.groupBy(F.col("raw_name").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    near = retrieval.cosine_top(texts, names, "char", 0.0, max(negatives + 3, 10), settle(retrieval.fit(texts, "char")))
    wrong = truth.select("mention_text", F.col("party_id").alias("own"), F.col("name").alias("own_name"), "copies").join(near.withColumnRenamed("text", "mention_text"), "mention_text").join(verified.select("party_id", F.col("party_name").alias("name")), "name")
    wrong = wrong.filter((F.col("party_id") != F.col("own")) & (X.base(X.normalize(F.col("name"))) != X.base(X.normalize(F.col("own_name")))))
    wrong = wrong.withColumn("rn", F.row_number().over(Window.partitionBy("mention_text", "own").orderBy("rank", "party_id"))).filter(F.col("rn") <= negatives)
    return truth.unionByName(wrong.select("mention_text", "party_id", "name", F.lit(0).alias("label"), "copies"))


def matrix(rows: DataFrame, idf: DataFrame, grams: dict[str, DataFrame]) -> DataFrame:
    """Features of pairs, as at inference but for reciprocal ranks taken as the first where a cosine passes its floor.

    They depend on the two texts alone, so they are computed once for each two.
    """
    cfg = retrieval.Retrieval()
    out = rows.select("mention_text", "name").distinct().withColumn("type", F.lit("official")).withColumn("collisions", F.lit(1).cast("long")).withColumn("confidence", F.lit(None).cast("double")).withColumn("embedding", F.lit(None).cast("double"))
    for kind in ("char", "word"):
        out = out.join(retrieval.pair_cosine(out, kind, grams[kind], "mention_text", "name", kind), ["mention_text", "name"])
    first = 1.0 / (cfg.k + 1)
    same = (X.normalize(F.col("mention_text")) != "") & (X.normalize(F.col("mention_text")) == X.normalize(F.col("name")))
    out = out.withColumns({kind: F.when(same, 1.0).otherwise(F.col(kind)) for kind in ("char", "word")})
    out = out.withColumn("rrf", F.when(F.col("char") >= cfg.char_floor, first).otherwise(0.0) + F.when(F.col("word") >= cfg.word_floor, first).otherwise(0.0))
    return rows.join(settle(scoring.score(settle(scoring.named(out)), idf)), ["mention_text", "name"])


def learn(labels: DataFrame, verified: DataFrame, mentions: DataFrame, rounds: int = ROUNDS, version: str = "") -> Model:
    """All of it: pairs (synthetic ones, if labels give fewer than 20 or one class), candidates, models.

    ``mentions`` (text) fit the grams' statistics, as they do at inference.
    """
    texts = retrieval.distinct_texts(mentions)
    grams = {kind: settle(retrieval.fit(texts, kind)) for kind in retrieval.GRAMS}
    idf = settle(scoring.token_idf(verified.select(F.col("party_name").alias("name"))))
    rows = settle(pairs(labels, verified))
    sizes = rows.groupBy("label").agg(F.sum("copies").alias("n")).collect()
    if len(sizes) < 2 or sum(r["n"] for r in sizes) < 20:
        rows = synthetic(verified)
    return fit(matrix(rows, idf, grams), matrix(settle(candidates(labels, verified)), idf, grams), rounds=rounds, version=version)


def synthetic(verified: DataFrame) -> DataFrame:
    """Pairs for a catalog without labels: each name with its own writings, and with the two next names."""
    from onomast.operators.settle import numbered

    names = settle(numbered(verified.select(F.col("party_name").alias("name")).distinct(), [F.col("name")], "at"))
    n = names.count()
    own = names.select("at", "name", F.explode(F.array(F.col("name"), X.normalize(F.col("name")), F.replace("name", F.lit(" "), F.lit("")))).alias("mention_text")).withColumn("label", F.lit(1))
    others = names.select(F.col("at").alias("other"), F.col("name").alias("wrong"))
    wrong = names.withColumn("other", F.explode(F.array(*[F.pmod(F.col("at") + i, F.lit(max(1, n))) for i in (1, 2)]))).join(others, "other").select("at", F.col("wrong").alias("name"), F.col("name").alias("mention_text"), F.lit(0).alias("label"))
    rows = own.unionByName(wrong)
    return rows.select(F.concat(F.lit("synthetic-"), F.col("at").cast("string")).alias("adm_party_id"), "mention_text", F.col("name").alias("party_id"), "name", "label")


def candidates(labels: DataFrame, verified: DataFrame, most: int = 10) -> DataFrame:
    """The same columns and ``adm_party_id`` for CALIBRATION rows: each plain name with its ``most`` nearest verified names and its own.

    Records of one part (``partition``) that write one party alike are one, which carries their number.
    """
    rows = labels.filter("scorable and split = 'CALIBRATION'").filter(X.record_case(F.col("raw_name")) == "PLAIN")
    written = rows.groupBy(partition(F.col("adm_party_id")).alias("part"), "raw_name", "expected").agg(F.min("adm_party_id").alias("adm_party_id"), F.count(F.lit(1)).alias("copies"))
    truth = written.join(verified.select(F.col("party_id").alias("expected"), F.col("party_name").alias("name")), "expected").select("adm_party_id", F.col("raw_name").alias("mention_text"), "expected", F.col("expected").alias("party_id"), "name", "copies")
    texts = truth.groupBy(F.col("mention_text").alias("text")).agg(F.sum("copies").alias("copies"))
    names = verified.select(F.col("party_name").alias("name")).distinct()
    near = retrieval.cosine_top(texts, names, "char", 0.0, most, settle(retrieval.fit(texts, "char")))
    others = truth.select("adm_party_id", "mention_text", "expected", "copies").join(near.select(F.col("text").alias("mention_text"), "name"), "mention_text").join(verified.select("party_id", F.col("party_name").alias("name")), "name")
    every = truth.unionByName(others.select(truth.columns)).dropDuplicates(["adm_party_id", "party_id"])
    return every.select("adm_party_id", "mention_text", "party_id", "name", (F.col("party_id") == F.col("expected")).cast("int").alias("label"), "copies")


def with_rivals(rows: DataFrame) -> DataFrame:
    """The columns of ``TARGET`` for each candidate, against the strongest other of its record."""
    whole = Window.partitionBy("adm_party_id")
    placed = rows.withColumn("rn", F.row_number().over(whole.orderBy(F.desc("score"), "party_id")))
    first, second = F.max("score").over(whole), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))).over(whole), F.lit(0.0))
    placed = placed.withColumn("runner", F.when(F.col("rn") == 1, second).otherwise(first))
    one = F.lit(1.0)
    return placed.withColumns({"own": F.col("score"), "second": F.col("score"), "has_second": F.lit(0.0), "gap": F.col("score") - F.col("runner"), "inverse_collisions": one, "support": one, "depth": one})


def probability(model: PipelineModel, rows: DataFrame, out: str) -> DataFrame:
    scored = model.transform(rows)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "v", *map(_bin, scoring.FEATURES))


def apply(model: Model, proposals: DataFrame) -> DataFrame:
    """``proposals`` with the identity model's ``score``, capped and raised as the rules' is; ``rules_score`` keeps that."""
    kept = proposals.withColumn("rules_score", F.col("score"))
    if model.identity is None:
        return kept
    return probability(model.identity, kept.drop("score"), "score").withColumn("score", scoring.identity(F.col("score")))


def target(model: Model):
    """A target score as ``decide.ranked`` takes it: logistic model and calibrator as one expression."""
    if model.target is None and model.calibrator is None:
        return None

    def of(own: Column, runner: Column) -> Column:
        value = scoring.target(own, runner)
        if model.target is not None:
            stage = model.target.stages[-1]
            seen = {"own": own, "second": own, "has_second": F.lit(0.0), "runner": runner, "gap": own - runner, "exact": F.col("exact"), "inverse_collisions": 1.0 / F.greatest(F.lit(1), F.col("collisions")), "support": F.col("support"), "depth": F.size("path")}
            z = F.lit(float(stage.intercept))
            for name, weight in zip(TARGET, stage.coefficients.toArray().tolist(), strict=True):
                z = z + F.lit(weight) * seen[name]
            value = 1.0 / (1.0 + F.exp(-z))
        return value if model.calibrator is None else calibrated(model.calibrator, value)

    return of


def calibrated(calibrator, value: Column) -> Column:
    """The isotonic regression's line through its boundaries, level beyond them."""
    xs, ys = calibrator.boundaries.toArray().tolist(), calibrator.predictions.toArray().tolist()
    out = F.lit(ys[-1])
    for (x0, y0), (x1, y1) in reversed(list(zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=True), strict=False))):
        line = F.lit(y0) if x1 <= x0 else F.lit(y0) + (value - x0) * ((y1 - y0) / (x1 - x0))
        out = F.when(value < x1, line).otherwise(out)
    return F.when(value <= xs[0], F.lit(ys[0])).otherwise(out)


def _decisions(rows: DataFrame) -> DataFrame:
    """Each record's best candidate: ``score, correct, copies``."""
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy("adm_party_id").orderBy(F.desc("p"), "party_id")))
    return best.filter("rn = 1").select(F.col("p").alias("score"), (F.col("label") == 1).alias("correct"), "copies")


def _bin(feature: str) -> str:
    return f"{feature}_bin"


def cuts(rows: DataFrame, features: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Where each feature may be split, by all ``rows`` and their ``copies``: between all its values, or at ``bins`` quantiles.

    Spark's trees would look for these places in a sample of about 10,000 rows.
    """
    each = rows.select("copies", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("f"))
    by = each.groupBy("f.feature", "f.value").agg(F.sum("copies").alias("n"))
    whole = Window.partitionBy("feature")
    up = whole.orderBy("value")
    middle = F.sum("n").over(up) - F.col("n") / 2
    placed = by.withColumns({"kinds": F.count(F.lit(1)).over(whole), "slot": F.floor(middle * bins / F.sum("n").over(whole))})
    placed = placed.withColumns({"next": F.lead("value").over(up), "next_slot": F.lead("slot").over(up)})
    between = (F.col("value") + F.col("next")) / 2
    cut = F.when(between > F.col("value"), between).otherwise(F.col("next"))
    found: dict[str, list[float]] = {f: [] for f in features}
    for r in placed.filter(F.col("next").isNotNull() & ((F.col("kinds") <= bins) | (F.col("slot") != F.col("next_slot")))).select("feature", cut.alias("cut")).collect():
        found[r["feature"]].append(r["cut"])
    return {f: sorted(c) for f, c in found.items()}


def boosted(rows: DataFrame, features: list[str], rounds: int) -> PipelineModel:
    """Gradient boosting on all ``rows``: features are cut into bins, and rows alike in all of them are one of their weight."""
    inf = float("inf")
    own = [_bin(f) for f in features]
    found = cuts(rows, features)  # a feature of one value is cut at 0, which leaves it one
    binned = Bucketizer(inputCols=features, outputCols=own, splitsArray=[[-inf, *(found[f] or [0.0]), inf] for f in features])
    vector = VectorAssembler(inputCols=own, outputCol="v")
    alike = settle(binned.transform(rows).groupBy(*own, "label").agg(F.sum("copies").cast("double").alias("copies")))
    n = alike.count()
    dealt = alike.repartition(max(1, n // PART_ROWS), *own).sortWithinPartitions(*own, "label")
    # a round's tasks would carry all rounds before it, so every tenth is written where there is a folder for that;
    # at no more rows than the square of maxBins, Spark takes them all for its splits; a feature has its bins either way
    trees = GBTClassifier(featuresCol="v", labelCol="label", weightCol="copies", maxIter=rounds, stepSize=0.08, maxDepth=4, maxBins=max(BINS, math.isqrt(n) + 1), seed=42, checkpointInterval=10)
    return PipelineModel([binned, vector, trees.fit(vector.transform(dealt))])


def reached(scores: DataFrame, chosen: float) -> float:
    """``chosen``, a score rounded to four digits, or the least score that rounds to it, if that lies below: it was counted in."""
    least = scores.filter(F.round("score", 4) == F.lit(chosen)).agg(F.min("score").alias("s")).first()["s"]
    return chosen if least is None else min(chosen, least)


def fit(rows: DataFrame, calibration: DataFrame | None = None, target_precision: float = 0.98, fallback: float = 0.90, minimum: int = 100, rounds: int = ROUNDS, version: str = "") -> Model:
    """``rows``: the feature matrix of training pairs with label; ``calibration``: that of ``candidates``.

    The identity model learns from all training pairs, by their ``copies``. Calibration records are dealt into three
    parts by their id: the target model learns from the first, the isotonic calibrator from the
    second, the third chooses the threshold; if a part has fewer than five records, all choose
    the threshold. Too few pairs (20) or one class only: rules alone.
    """
    rows = settle(weighed(rows))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("copies").alias("n")).collect()}
    if len(sizes) < 2 or sum(sizes.values()) < 20:
        return Model(None, None, None, fallback, fallback, version)
    identity = boosted(rows, [c for c in scoring.FEATURES if c in rows.columns], rounds)
    model = Model(identity, None, None, fallback, fallback, version)
    if calibration is None:
        return model
    held = settle(with_rivals(probability(identity, weighed(calibration).drop("score"), "score")).withColumn("part", partition(F.col("adm_party_id"))))
    counts = {r["part"]: r["n"] for r in held.select("part", "adm_party_id", "copies").distinct().groupBy("part").agg(F.sum("copies").alias("n")).collect()}
    if min(counts.get(i, 0) for i in range(3)) < 5:
        held = held.withColumn("part", F.lit(2))
    first = held.filter("part = 0")
    classes = {r["label"]: r["n"] for r in first.groupBy("label").agg(F.sum("copies").alias("n")).collect()}
    plain = F.greatest(F.lit(0.0), scoring.target(F.col("own"), F.col("runner")))
    if len(classes) == 2:
        weight = F.when(F.col("label") == 1, F.lit(sum(classes.values()) / (2 * classes[1]))).otherwise(F.lit(sum(classes.values()) / (2 * classes[0])))
        model.target = Pipeline(stages=[VectorAssembler(inputCols=list(TARGET), outputCol="v"), LogisticRegression(featuresCol="v", labelCol="label", weightCol="w", maxIter=500)]).fit(first.withColumn("w", weight * F.col("copies")))
        judged = settle(probability(model.target, held, "p"))
    else:
        judged = held.withColumn("p", plain)
    second = settle(_decisions(judged.filter("part = 1")))
    told = second.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.count_distinct("correct").alias("classes"), F.count_distinct(F.round("score", 6)).alias("scores")).first()
    if told["n"] >= 20 and told["classes"] == 2 and told["scores"] >= 3:
        model.calibrator = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="copies").fit(second.select(F.col("score").alias("p"), F.col("correct").cast("double").alias("label"), F.col("copies").cast("double").alias("copies")))
    third = _decisions(judged.filter("part = 2"))
    third = settle(third if model.calibrator is None else third.withColumn("score", calibrated(model.calibrator, F.col("score"))))
    n = third.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    chosen = evaluate.threshold(third, target_precision, min(minimum, max(5, n // 2)), fallback)
    model.threshold = model.plain_threshold = reached(third, chosen)
    return model


def save(spark: SparkSession, model: Model, path: str) -> None:
    for name in ("identity", "target", "calibrator"):
        part = getattr(model, name)
        if part is not None:
            part.write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"threshold": model.threshold, "plain_threshold": model.plain_threshold, "version": model.version, "features": scoring.FEATURES, "parts": [n for n in ("identity", "target", "calibrator") if getattr(model, n) is not None]}),)], "value string").write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str, version: str | None = None) -> Model | None:
    """A saved model, or None if there is none; another data version or feature list is an error.

    A part that was not saved, or cannot be read, is left to the rules.
    """
    from pyspark.ml.regression import IsotonicRegressionModel

    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    except Exception:  # noqa: BLE001
        return None
    if (version is not None and meta["version"] != version) or meta["features"] != list(scoring.FEATURES):
        raise RuntimeError("the model was trained on other data or features")
    parts = {}
    for name, kind in (("identity", PipelineModel), ("target", PipelineModel), ("calibrator", IsotonicRegressionModel)):
        try:
            parts[name] = kind.load(f"{path}/{name}") if name in meta["parts"] else None
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"{name} of the model could not be loaded; the rules decide instead: {e}", stacklevel=2)
            parts[name] = None
    return Model(parts["identity"], parts["target"], parts["calibrator"], meta["threshold"], meta["plain_threshold"], meta["version"])
