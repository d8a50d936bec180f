"""Trees of summaries: layers of clustered chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import providers as P
from graphloom.functions import vectors as V
from graphloom.lineage import cut


def soft_clusters(vectors: DataFrame, most: int, threshold: float = 0.1, seed: int = 224, id_col: str = "id") -> DataFrame:
    """(id, cluster) by a Gaussian mixture: the number of components by the least BIC, every component likelier than the threshold."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = cut(vectors.select(id_col, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.size("embedding").alias("d")))
    n, d = rows.agg(F.count("*"), F.max("d")).first()
    best = None
    for k in range(1, max(1, min(most, n - 1)) + 1) if n > 2 else [1]:
        if k == 1:
            continue
        model = GaussianMixture(k=k, seed=seed, maxIter=30).fit(rows)
        import math

        bic = -2 * model.summary.logLikelihood + math.log(n) * (k * (d + d * (d + 1) / 2) + k - 1)
        if best is None or bic < best[0]:
            best = (bic, model)
    if best is None:
        return rows.select(id_col, F.lit(0).alias("cluster"))
    p = best[1].transform(rows).select(id_col, F.posexplode(vector_to_array("probability")).alias("cluster", "p"), F.col("prediction"))
    return p.filter((F.col("p") > threshold) | (F.col("cluster") == F.col("prediction"))).select(id_col, "cluster")


def balanced_clusters(vectors: DataFrame, k: int, seed: int = 1, rounds: int = 5, id_col: str = "id") -> DataFrame:
    """(id, cluster) by k-means with at most ceil(n / k) members each: those farthest from a full centre go to the nearest with room."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(id_col, "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    spark = vectors.sparkSession
    centre = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")
    n = rows.count()
    room = -(-n // max(1, centre.count()))
    near = cut(rows.select(id_col, "embedding").join(F.broadcast(centre)).select(id_col, "cluster", V.dot(F.zip_with("embedding", "c", lambda a, b: a - b), F.zip_with("embedding", "c", lambda a, b: a - b)).alias("d")))
    placed, left = None, near
    for _ in range(rounds + k):
        want = left.groupBy(id_col).agg(F.min(F.struct("d", "cluster")).alias("b")).select(id_col, "b.cluster", "b.d")
        used = placed.groupBy("cluster").agg(F.count("*").alias("u")) if placed is not None else spark.createDataFrame([], "cluster int, u long")
        w = W.partitionBy("cluster").orderBy("d", id_col)
        take = cut(want.join(used, "cluster", "left").withColumn("r", F.row_number().over(w)).filter(F.col("r") + F.coalesce("u", F.lit(0)) <= room).select(id_col, "cluster"))
        placed = cut(placed.unionByName(take)) if placed is not None else take
        full = placed.groupBy("cluster").agg(F.count("*").alias("u")).filter(F.col("u") >= room).select("cluster")
        left = cut(left.join(placed.select(id_col), id_col, "left_anti").join(full, "cluster", "left_anti"))
        if left.isEmpty():
            break
    return placed


def build(leaves: DataFrame, cluster: Callable[[DataFrame], DataFrame], summary: Callable[[Column], Column], layers: int = 3, provider: P.EmbeddingProvider | None = None) -> DataFrame:
    """Tree nodes (layer, id, content, children) from leaves (id, content): each layer's clusters are summarised and embedded for the next one.

    ``cluster`` gives (id, cluster) of a layer, ``summary`` is a column function over a cluster's joined texts.
    """
    at = cut(leaves.select(F.lit(0).alias("layer"), F.col("id").cast("string").alias("id"), "content", F.array().cast("array<string>").alias("children")))
    out = at
    for layer in range(1, layers + 1):
        if at.count() <= 1:
            break
        vectors = cut(P.embed(at.select("id", "content"), "content", provider))
        member = cluster(vectors.select("id", "embedding")).join(at.select("id", "content"), "id")
        rows = F.array_sort(F.collect_list(F.struct("id", "content")))
        up = member.groupBy("cluster").agg(rows.alias("r")).select(F.lit(layer).alias("layer"), F.concat_ws("/", F.lit(f"t{layer}"), F.col("cluster").cast("string")).alias("id"), summary(F.array_join(F.transform("r", lambda x: x["content"]), "\n")).alias("content"), F.transform("r", lambda x: x["id"]).alias("children"))
        up = cut(up)
        if up.count() >= at.count():
            break
        out, at = out.unionByName(up), up
    return out


def split_large(member: DataFrame, sizes: DataFrame, most: int, cluster: Callable[[DataFrame], DataFrame], vectors: DataFrame, depth: int = 20) -> DataFrame:
    """Clusters whose members' token counts (id, tokens) sum to over ``most`` are clustered again, at most ``depth`` times."""
    done, left = None, member.select("id", F.col("cluster").cast("string").alias("cluster"))
    for _ in range(depth):
        total = left.join(sizes, "id").groupBy("cluster").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
        big = cut(total.filter((F.col("t") > most) & (F.col("n") > 1)).select("cluster"))
        fine = cut(left.join(big, "cluster", "left_anti"))
        done = fine if done is None else done.unionByName(fine)
        names = [r["cluster"] for r in big.collect()]  # clusters of one layer that are too large: few
        if not names:
            return done
        new = None
        for name in names:
            own = left.filter(F.col("cluster") == name).select("id")
            part = cluster(vectors.join(own, "id", "left_semi")).select("id", F.concat_ws(".", F.lit(name), F.col("cluster").cast("string")).alias("cluster"))
            new = part if new is None else new.unionByName(part)
        left = cut(new)
    return done.unionByName(left)
