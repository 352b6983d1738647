"""Customer segmentation (G1-G4): standardise, K-means with restarts, PCA.

The assembled, scaled feature vectors are written once and every restart and
the PCA read that copy; each K-means iteration is one distributed pass with
map-side partial sums per centre.  Cluster ids are arbitrary, so everything
downstream reports by risk rank (``attrita.operators.segments``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame

from attrita import config as C
from attrita.ml.models import ROWS_PER_TRAINING_PARTITION, assembler, encoder_stages, laid_out
from attrita.session import checkpoint_dir

#: Vectors in so many partitions at most stay as they are.
KEPT_PARTITIONS = 16


@dataclass
class Segmentation:
    prep: PipelineModel
    kmeans: KMeansModel
    pca: PCAModel
    training_cost: float
    seed: int

    def assign(self, feats: DataFrame, cluster_col: str = "cluster") -> DataFrame:
        out = self.kmeans.transform(self.prep.transform(feats))
        return out.withColumnRenamed("prediction", cluster_col)

    @property
    def explained_variance(self) -> list[float]:
        return [float(x) for x in self.pca.explainedVariance]


def prep_pipeline() -> Pipeline:
    """G1: one-hot (drop first), assemble, standardise with mean."""
    return Pipeline(stages=encoder_stages() + [
        assembler(),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)])


def segment_customers(feats: DataFrame, k: int = C.N_CLUSTERS, restarts: int = C.KMEANS_RESTARTS,
                      seed: int = C.SEED, max_iter: int = 300, parallelism: int = 4,
                      key: str = "customer_id") -> Segmentation:
    """Best of ``restarts`` K-means fits (lowest within-cluster cost,
    ties to the smaller seed) and a 2-component PCA of the same scaled vectors.

    Restarts are independent fits over one written copy of the vectors; up to
    ``parallelism`` of them run as concurrent Spark jobs (as CrossValidator's
    ``parallelism`` does), so small clusters of work overlap on the executors.
    Hundreds of iterations each run a task a partition, so vectors in more than
    ``KEPT_PARTITIONS`` are laid out by ``key``, as training rows are.  The copy
    is not persisted: each fit then keeps the vectors itself, decoded once and
    not again in each iteration.
    """
    prep = prep_pipeline().fit(feats)
    checkpoint_dir(feats.sparkSession)
    scaled = prep.transform(feats).select(key, "scaled").checkpoint()
    if scaled.rdd.getNumPartitions() > KEPT_PARTITIONS:
        scaled = laid_out(scaled, ROWS_PER_TRAINING_PARTITION["kmeans"], key)

    def fit(s: int):
        km = KMeans(k=k, seed=s, maxIter=max_iter, featuresCol="scaled", initMode="k-means||").fit(scaled)
        return km.summary.trainingCost, s, km

    seeds = [seed + r for r in range(restarts)]
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, restarts))) as pool:
        fits = list(pool.map(fit, seeds))
    best_cost, best_seed, best = min(fits, key=lambda t: (t[0], t[1]))
    pca = PCA(k=2, inputCol="scaled", outputCol="pca").fit(scaled)
    return Segmentation(prep, best, pca, float(best_cost), best_seed)


def silhouette(seg: Segmentation, feats: DataFrame) -> float:
    """Squared-Euclidean silhouette of the assignment."""
    out = seg.assign(feats, "prediction_cluster")
    ev = ClusteringEvaluator(featuresCol="scaled", predictionCol="prediction_cluster")
    return float(ev.evaluate(out))


def scaled_array() -> Column:
    """The standardised features of an assigned row, as an array (what ``operators.centres`` works on)."""
    return vector_to_array("scaled")


def pca_projection(seg: Segmentation, feats: DataFrame) -> DataFrame:
    """2-D coordinates per customer with its cluster (for a scatter)."""
    out = seg.pca.transform(seg.assign(feats))
    arr = vector_to_array("pca")
    return out.select("customer_id", "cluster", arr[0].alias("pc1"), arr[1].alias("pc2"))
