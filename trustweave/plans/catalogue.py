"""Queries of the library over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs, faults
from ..operators import audit, clusters, features, kernels, pipeline, sampling, stats, tiles
from ..operators.arrays import collected
from ..operators.student import build_targets, fit_landmark, fit_linear
from ..operators.teacher import fit_teacher
from ..sources import archives, images, model_store, records
from ..sources.shared import Store, shared_dir
from ..streaming import monitor
from . import experiments

SEED, PER_CLASS, LANDMARKS = 7, 5, 16


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, e, view_a, view_b, joint) of the embeddings: halves of length one and both together."""
    e = exprs.doubles("embedding")
    half = lambda a: exprs.row_normalize(F.slice("e", a, 32))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", e.alias("e"))
    return rows.withColumn("view_a", half(1)).withColumn("view_b", half(33)).withColumn("joint", exprs.joint(F.col("view_a"), F.col("view_b")))


def _places(df: DataFrame, v: str) -> DataFrame:
    return df.select("id", F.posexplode(v).alias("i", "x")).select("id", "i", (F.round("x", 6) + 0.0).alias("x"))


def trusted(spark, sf_dir):
    return sampling.balanced_sample(views(spark, sf_dir).select("id", "label"), PER_CLASS, SEED)


def row_normalize(spark, sf_dir):
    return _places(views(spark, sf_dir), "view_a")


def joint_concat(spark, sf_dir):
    return _places(views(spark, sf_dir), "joint")


def softmax_t(spark, sf_dir):
    return _places(views(spark, sf_dir).select("id", exprs.softmax(F.col("e"), 0.1).alias("p")), "p")


def onehot(spark, sf_dir):
    return _places(views(spark, sf_dir).select("id", exprs.one_hot(F.col("label"), 10).alias("p")), "p")


def argmax_first(spark, sf_dir):
    return views(spark, sf_dir).select("id", exprs.argmax(F.transform("e", lambda x: F.round(x, 1))).alias("place"))


def entropy(spark, sf_dir):
    return views(spark, sf_dir).select("id", F.round(exprs.normalized_entropy(F.transform("e", lambda x: x * x), 64), 6).alias("h"))


def standardize_pop(spark, sf_dir):
    m, d = stats.column_moments(views(spark, sf_dir), "e")
    numbers = lambda x: F.array(*map(F.lit, x.tolist()))
    return _places(views(spark, sf_dir).select("id", exprs.standardize(F.col("e"), numbers(m), numbers(d + 0.01)).alias("x")), "x")


def covariance(spark, sf_dir):
    """Covariances (ddof 1) of the places of the whole embeddings, by merged moments."""
    c = stats.moments(views(spark, sf_dir).select("id", "e"), "e", cross=True, rows=64).covariance()
    return spark.createDataFrame([(int(i), int(j), round(float(c[i, j]), 6) + 0.0) for i, j in zip(*np.triu_indices(len(c)), strict=True)], "i int, j int, c double")


def blend_views(spark, sf_dir):
    return _places(views(spark, sf_dir).select("id", exprs.blend(F.col("view_a"), F.col("view_b"), 0.75).alias("x")), "x")


def sqrt_places(spark, sf_dir):
    return _places(views(spark, sf_dir).select("id", exprs.square_root(F.transform("e", F.abs)).alias("x")), "x")


def patch_norm(spark, sf_dir):
    return _places(views(spark, sf_dir).select("id", exprs.patch_normalize(F.transform("e", lambda x: x * 255)).alias("x")), "x")


def _known(spark, sf_dir):
    """(id, label, t): t is whether the row is trusted."""
    t = trusted(spark, sf_dir).select("id", F.lit(True).alias("t"))
    return views(spark, sf_dir).select("id", "label").join(t, "id", "left").withColumn("t", F.coalesce("t", F.lit(False)))


def flipped_labels(spark, sf_dir):
    return _known(spark, sf_dir).select("id", exprs.flipped(F.col("label"), 10, ~F.col("t")).alias("label"))


def sentinel_labels(spark, sf_dir):
    return _known(spark, sf_dir).select("id", exprs.sentinel(F.col("label"), F.col("t")).alias("label"))


def payload(spark, sf_dir):
    """Bytes of what a client sends, by the classes that the table has."""
    classes = views(spark, sf_dir).select("label").distinct().count()
    return spark.createDataFrame([(w, n, exprs.payload_bytes(w, classes, n)) for w in (64, 880, 6400) for n in (4, 8)], "width int, bytes_each int, bytes long")


def label_bincount(spark, sf_dir):
    return stats.label_counts(views(spark, sf_dir), "label", 12)


def gather_trusted(spark, sf_dir):
    return _places(sampling.only_trusted(views(spark, sf_dir), trusted(spark, sf_dir)), "joint")


def loose_sample(spark, sf_dir):
    return sampling.sample(views(spark, sf_dir).select("id", "label"), 32, 11)


def equal_split(spark, sf_dir):
    return sampling.equal_split(views(spark, sf_dir), 7, SEED, rows=64)


def _marks(spark, sf_dir):
    return sampling.landmarks(views(spark, sf_dir), LANDMARKS, SEED).select("id", F.col("joint").alias("v"))


def landmark_sample(spark, sf_dir):
    return _marks(spark, sf_dir).select("id")


def rbf_landmarks(spark, sf_dir):
    rows = views(spark, sf_dir).select("id", F.col("joint").alias("v"))
    return kernels.anchor_similarities(rows, _marks(spark, sf_dir), 0.5).select("id", "anchor", F.round("d2", 6).alias("d2"), F.round("k", 6).alias("k"))


def nearest_centroid(spark, sf_dir):
    rows = views(spark, sf_dir).select("id", F.col("joint").alias("v"))
    return kernels.nearest(rows, _marks(spark, sf_dir)).select("id", "centroid", F.round("d2", 6).alias("d2"))


def first_m_per_class(spark, sf_dir):
    return sampling.first_rows(views(spark, sf_dir).select("id", "label"), 3)


def untrusted_anti(spark, sf_dir):
    return sampling.untrusted(views(spark, sf_dir).select("id", "label"), trusted(spark, sf_dir))


def _cells(of: tiles.Tiles, right: bool = False):
    """(client, i, j, v) of the upper triangles, or of the right-hand sides."""
    return of.entries(right).withColumn("v", F.round("v", 6) + 0.0)


#: Rows and columns of the tiles of these queries, so that their matrices have several.
SMALL_TILE = 24


def _with_targets(spark, sf_dir):
    return views(spark, sf_dir).withColumn("q", exprs.one_hot(F.col("label"), 10)).withColumn("client", F.pmod("id", F.lit(4)))


def gram_upper(spark, sf_dir):
    return _cells(tiles.tiled_statistics(_with_targets(spark, sf_dir), "joint", "q", tile=SMALL_TILE)).drop("client")


def gram_weighted(spark, sf_dir):
    t = trusted(spark, sf_dir).select("id", F.lit(True).alias("t"))
    rows = _with_targets(spark, sf_dir).join(t, "id", "left").withColumn("w", exprs.row_weight(F.coalesce("t", F.lit(False)), 10.0))
    return _cells(tiles.tiled_statistics(rows, "joint", "q", "w", tile=SMALL_TILE)).drop("client")


def client_gram(spark, sf_dir):
    return _cells(tiles.tiled_statistics(_with_targets(spark, sf_dir), "view_b", "q", None, "client", tile=SMALL_TILE))


def client_gram_sum(spark, sf_dir):
    """The clients' sums added up on the executors."""
    return _cells(tiles.tiled_statistics(_with_targets(spark, sf_dir), "view_b", "q", None, "client", tile=SMALL_TILE, rows=40).combined()).drop("client")


def rhs_targets(spark, sf_dir):
    return _cells(tiles.tiled_statistics(_with_targets(spark, sf_dir), "joint", "q", tile=SMALL_TILE), True).select("i", F.col("j").alias("c"), "v")


def lineitem_gram(spark, sf_dir):
    """Batch products over lineitem: 4 x 4 sums and a right-hand side by return flag. All values are whole numbers (cents and
    hundredths), so every engine and machine gives the same sums."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flags = F.array(*[F.when(F.col("l_returnflag") == x, 1.0).otherwise(0.0) for x in "ANR"])
    whole = lambda c, by: F.round(F.col(c) * by)
    phi = F.array(whole("l_quantity", 1), F.floor(F.col("l_extendedprice") / 100).cast("double"), whole("l_discount", 100), whole("l_tax", 100))
    rows = rows.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("id"), phi.alias("phi"), flags.alias("q"))
    s = stats.statistics(rows, "phi", "q")
    m = np.concatenate([s.a, s.b], 1)
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(4) for j in range(7)], "i int, j int, v double")


def documents_labels(spark, sf_dir):
    """Documents by source with how many are labelled and how many are good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return docs.join(known, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"))


def apportion(spark, sf_dir):
    labels = views(spark, sf_dir).select("label")
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    shares = n.withColumn("client", F.explode(F.array(*map(F.lit, range(4))))).withColumn("p", (F.col("client") + 1) / 10)
    return sampling.apportion(shares).select("label", "client", "count")


def _shares(spark):
    return spark.createDataFrame([(c, k, (k + 1) / 10) for c in range(10) for k in range(4)], "label int, client int, p double")


def client_counts(spark, sf_dir):
    return client_owners(spark, sf_dir).groupBy("client", "label").agg(F.count(F.lit(1)).alias("n"))


def client_owners(spark, sf_dir):
    return sampling.owners(views(spark, sf_dir).select("id", "label"), _shares(spark), SEED, rows=64)


def cumulative_cuts(spark, sf_dir):
    return sampling.owners(views(spark, sf_dir).select("id", "label"), _shares(spark), SEED, exact=False)


def largest_clients(spark, sf_dir):
    return sampling.largest_clients(cumulative_cuts(spark, sf_dir), 2)


def _scored(spark, sf_dir, clients: int):
    return views(spark, sf_dir).select(F.pmod("id", F.lit(clients)).alias("client"), exprs.argmax(F.slice("e", 1, 10)).alias("prediction"), "label")


def client_accuracy(spark, sf_dir):
    return experiments.client_accuracy(_scored(spark, sf_dir, 7)).withColumn("accuracy", F.round("accuracy", 6))


def worst_client(spark, sf_dir):
    by = experiments.client_accuracy(_scored(spark, sf_dir, 7))
    return by.agg(F.round(F.min("accuracy"), 6).alias("worst"), F.round(F.var_samp("accuracy"), 6).alias("variance"), F.count(F.lit(1)).alias("clients"))


def participation(spark, sf_dir):
    """Mean accuracy of the clients that take part in each of three repeats, summed up by rate."""
    by = experiments.client_accuracy(_scored(spark, sf_dir, 10))
    results = None
    for rate in (0.5, 0.8, 1.0):
        for repeat in range(3):
            one = by.join(sampling.active_clients(by.select("client"), rate, repeat, SEED), "client").agg(F.avg("accuracy").alias("accuracy")).withColumn("rate", F.lit(rate))
            results = one if results is None else results.unionByName(one)
    return experiments.participation_summary(results).select("rate", F.round("mean_accuracy", 6).alias("mean_accuracy"), F.round("min_accuracy", 6).alias("min_accuracy"))


def agreement(spark, sf_dir):
    pick = lambda a: views(spark, sf_dir).select("id", exprs.argmax(F.slice("e", a, 10)).alias("prediction"))
    return experiments.agreement(pick(1), pick(11)).select(F.round("agreement", 6).alias("agreement"))


def _class_means(spark, sf_dir):
    rows = views(spark, sf_dir).groupBy("label").agg(F.avg(F.get("e", F.lit(0))).alias("left"), F.avg(F.get("e", F.lit(1))).alias("right"))
    return rows.select(F.pmod("label", F.lit(2)).alias("per_class"), F.col("label").alias("seed"), "left", "right")


def result_mismatches(spark, sf_dir):
    a = _class_means(spark, sf_dir)
    b = a.withColumn("left", F.when(F.col("seed") < 3, F.col("left") + 1).otherwise(F.col("left") + 1e-12))
    return experiments.mismatches(a, b, ["per_class", "seed"], "left").select("per_class", "seed", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def paired_summary(spark, sf_dir):
    s = experiments.summary(_class_means(spark, sf_dir), "left", "right")
    return s.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


def centroid_update(spark, sf_dir):
    """One round of the clustering, from the first eight rows."""
    rows = views(spark, sf_dir).select("id", "joint")
    c = clusters.lloyd(rows, collected(rows.orderBy("id").limit(8), "joint")[0], 1, vector="joint", rows=64)
    return spark.createDataFrame([(k, i, round(float(c[k, i]), 6) + 0.0) for k, i in np.ndindex(c.shape)], "centroid int, i int, x double")


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, bytes): the UTF-8 bytes of all texts in pieces of 3,072, the last one of a text filled up with zeros."""
    body = F.col("text").cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.octet_length("text") > 0).select("doc_id", body.alias("b"))
    n = F.ceil(F.octet_length("b") / 3072).cast("int")
    each = docs.select("doc_id", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    piece = F.rpad(F.substring("b", F.col("k") * 3072 + 1, F.lit(3072)), 3072, F.lit(b"\x00"))
    return each.select((F.col("doc_id") * 1000 + F.col("k")).alias("id"), F.pmod("doc_id", F.lit(10)).cast("int").alias("label"), piece.alias("bytes"))


def image_layout(spark, sf_dir):
    """Bytes by row, column and channel as values by channel, row and column, summed up with their places."""
    raw = features.from_blobs(_blobs(spark, sf_dir).select("id", "bytes"), raw=True)
    made = features.from_rows(features.from_bytes(raw))
    return made.select("id", F.round(exprs.total(F.transform("pixels", lambda x, i: x * i)), 4).alias("s"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def image_records(spark, sf_dir):
    """All pieces of the texts written as files of records, and read as whole numbers and as labels only."""
    at = _folder(spark, "images")
    records.write_fixed(_blobs(spark, sf_dir), at, images.RECORD)
    places = lambda x, i: x.cast("long") * (i + 1)
    rows = images.read_records(spark, at, raw=True).select("file", "record", F.aggregate(F.transform("pixels", places), F.lit(0).cast("long"), lambda s, x: s + x).alias("s"))
    return rows.join(records.read_fixed(spark, at, images.RECORD, labels=True), ["file", "record"]).select("label", "s")


def csv_round_trip(spark, sf_dir):
    at = _folder(spark, "csv")
    images.write_csv(spark.read.parquet(f"{sf_dir}/labels.parquet"), at)
    return images.read_csv(spark, at, "doc_id long, quality int, toxic int")


def cached_features(spark, sf_dir):
    """Block means written on the first call and read on the second, which must not make them again."""
    at = _folder(spark, "cache")

    def again():
        raise RuntimeError("made twice")

    images.cached(spark, at, lambda: block_mean(spark, sf_dir))
    return images.cached(spark, at, again)


def _pixels(spark, sf_dir):
    """Images whose pixels are the bytes of the texts; they become numbers in the tasks that use them."""
    return _blobs(spark, sf_dir).select("id", F.col("bytes").alias("pixels"))


def block_mean(spark, sf_dir):
    return _places(features.color_means(_pixels(spark, sf_dir)), "c")


def color_stats(spark, sf_dir):
    m, s = stats.column_moments(features.color_means(_pixels(spark, sf_dir)), "c")
    return spark.createDataFrame([(i, round(float(a), 6), round(float(b), 6)) for i, (a, b) in enumerate(zip(m, s, strict=True))], "i int, mean double, std double")


def grad_hist(spark, sf_dir):
    return features.fit_color(_pixels(spark, sf_dir)).transform(_pixels(spark, sf_dir), single=False).select("id", F.round(exprs.total(F.col("view_a")), 3).alias("s"))


LANDMARK = Config(student="landmark", landmarks=64)


def _classes(df: DataFrame, v: str, *more: str) -> DataFrame:
    """A row for each class of vector v."""
    return df.select("id", *more, F.posexplode(v).alias("c", v)).withColumn(v, F.round(v, 6) + 0.0)


def _features(spark, sf_dir):
    return views(spark, sf_dir).select("id", "view_a", "view_b", "joint")


def teacher_scores(spark, sf_dir):
    v = _features(spark, sf_dir)
    return _classes(fit_teacher(v, trusted(spark, sf_dir)).scores(v, block=7), "raw")


def teacher_scores_two_views(spark, sf_dir):
    v = _features(spark, sf_dir)
    return _classes(fit_teacher(v, trusted(spark, sf_dir), LANDMARK).scores(v), "raw")


def teacher_by_steps(spark, sf_dir):
    """Scores of a teacher whose dual weights come from conjugate gradients over blocks of the kernel matrix."""
    v = _features(spark, sf_dir)
    return _classes(fit_teacher(v, trusted(spark, sf_dir), direct=0).scores(v, block=20), "raw")


def teacher_probabilities(spark, sf_dir):
    v = _features(spark, sf_dir)
    return _classes(pipeline.fit(v, trusted(spark, sf_dir)).teacher_probabilities(v), "p")


def targets(spark, sf_dir):
    v, t = _features(spark, sf_dir), trusted(spark, sf_dir)
    return _classes(build_targets(fit_teacher(v, t).probabilities(v), t, 10), "q", "is_trusted")


def _weights(spark, w):
    return spark.createDataFrame([(i, c, round(float(w[i, c]), 6) + 0.0) for i, c in np.ndindex(w.shape)], "i int, c int, w double")


def student_weights(spark, sf_dir):
    return _weights(spark, fit_linear(_with_targets(spark, sf_dir), trusted=trusted(spark, sf_dir)).weights)


def central_weights(spark, sf_dir):
    return _weights(spark, tiles.central_ridge(_with_targets(spark, sf_dir), "joint", "q", 1.0))


def landmark_features(spark, sf_dir):
    marks = sampling.landmarks(views(spark, sf_dir), 64, LANDMARK.landmark_seed)
    rows = kernels.landmark_map(_features(spark, sf_dir), collected(marks, "joint")[0], LANDMARK.landmark_gamma)
    return _places(rows, "phi")


def landmark_weights(spark, sf_dir):
    return _weights(spark, fit_landmark(_with_targets(spark, sf_dir), LANDMARK).weights)


def predictions(spark, sf_dir):
    v = _features(spark, sf_dir)
    return pipeline.fit(v, trusted(spark, sf_dir)).predict(v).select("id", "prediction")


def predictions_landmark(spark, sf_dir):
    v = _features(spark, sf_dir)
    return pipeline.fit(v, trusted(spark, sf_dir), LANDMARK).predict(v).select("id", "prediction")


def stored_model(spark, sf_dir):
    """Scores of a model that was saved and loaded by its fingerprint."""
    v, at = _features(spark, sf_dir), _folder(spark, "model")
    mark = model_store.save(spark, pipeline.fit(v, trusted(spark, sf_dir)), at)
    return _classes(model_store.load(spark, at, mark).scores(v), "scores")


def archived_model(spark, sf_dir):
    """Scores of a model that was written as an archive and read back by its fingerprint."""
    v, at = _features(spark, sf_dir), _folder(spark, "archive")
    mark = archives.save(spark, pipeline.fit(v, trusted(spark, sf_dir), LANDMARK), at)
    return _classes(archives.load(spark, at, mark).scores(v), "scores")


def monitoring(spark, sf_dir):
    v, t = _features(spark, sf_dir), trusted(spark, sf_dir)
    clients = spark.range(10).select(F.col("id").alias("client"), (F.col("id") < 8).alias("active"))
    m = experiments.monitoring(v, pipeline.fit(v, t), t, views(spark, sf_dir).select("id", "label"), clients)
    names = ["class_coverage", "disagreement", "worst_class", "worst_accuracy", "participation"]
    return spark.createDataFrame([tuple(round(m[n], 6) if isinstance(m[n], float) else m[n] for n in names)], "class_coverage double, disagreement double, worst_class int, worst_accuracy double, participation double")


def mutation_audit(spark, sf_dir):
    """Two fits whose untrusted labels differ, with how many of these do."""
    v, t = _features(spark, sf_dir), trusted(spark, sf_dir)
    labels = _known(spark, sf_dir).select("id", F.col("label").cast("string").alias("label"))
    other = sentinel_labels(spark, sf_dir)
    r = audit.mutation_audit(v, t, labels, other, Config()).frame
    mutated = labels.join(other.select("id", F.col("label").alias("o")), "id").filter("label <> o").count()
    same = (F.col("target_hash_a") == F.col("target_hash_b")) & (F.col("weight_hash_a") == F.col("weight_hash_b"))
    return r.select(F.lit(mutated).cast("long").alias("mutated"), "target_max_diff", F.col("student_weight_max_diff").alias("weight_max_diff"), same.alias("same_digests"), "passed")


def federated_audit(spark, sf_dir):
    """Weights out of the sums of seven clients, and out of all rows at once."""
    rows = _with_targets(spark, sf_dir).withColumn("client", F.pmod("id", F.lit(7)))
    parts = tiles.tiled_statistics(rows, "joint", "q", None, "client", tile=32).kept(Store(spark, "clients"))
    federated, central = tiles.combine_tiles(parts, 1.0, direct=32), tiles.central_ridge(rows, "joint", "q", 1.0)
    d = audit.federated_audit(rows, 1.0, "joint")
    both = _weights(spark, federated).withColumnRenamed("w", "federated").join(_weights(spark, central).withColumnRenamed("w", "central"), ["i", "c"])
    return both.withColumn("max_weight_diff", F.lit(round(d, 9)))


def _marked(events: DataFrame) -> DataFrame:
    """Events as rows to monitor: the type as the teacher's class of five, a class out of the value as the student's; every
    97th event is trusted."""
    kind = F.pmod(F.ascii("event_type") + F.length("event_type"), F.lit(5)).cast("int")
    return events.select("ts", F.col("user_id").alias("client"), kind.alias("teacher"), F.pmod(F.floor("value"), F.lit(5)).cast("int").alias("student"), F.when(F.pmod("event_id", F.lit(97)) == 0, kind).alias("trusted"))


def monitor_windows(spark, sf_dir):
    """Windows of six hours that closed while all events were read as a stream, by a watermark of an hour."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    clients = table.select("user_id").distinct().count()
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = _folder(spark, "monitor")
    monitor.start(_marked(stream), f"{at}/windows", f"{at}/state", 5, clients, "6 hours", "1 hour").awaitTermination()
    rows = spark.read.parquet(f"{at}/windows")
    whole = lambda c: F.round(c, 6).alias(c)
    return rows.select(F.unix_seconds("start").alias("start"), "rows", "trusted", whole("class_coverage"), whole("disagreement"), "active", whole("participation"))


def refusals(spark, sf_dir):
    """Rules, offenders and first offenders of the embeddings with faults planted by id."""
    rows, at = views(spark, sf_dir), lambda m, k: F.pmod("id", F.lit(m)) == k
    odd = lambda x: F.concat(F.slice("e", 1, 63), F.array(F.lit(x).cast("double")))
    v = F.when(at(50, 1), F.lit(None)).when(at(50, 2), odd(None)).when(at(50, 3), odd(float("nan"))).when(at(50, 4), odd(float("inf"))).when(at(50, 5), F.slice("e", 1, 63)).otherwise(F.col("e"))
    y = F.when(at(40, 7), F.lit(None)).when(at(40, 8), F.col("label") + 0.5).when(at(40, 9), F.lit(float("nan"))).when(at(40, 11), F.lit(99.0)).when(at(40, 12), F.lit(-1.0)).otherwise(F.col("label"))
    w = F.when(at(30, 1), F.lit(0.0)).when(at(30, 2), F.lit(None)).when(at(30, 3), F.lit(-1.0)).when(at(30, 4), F.lit(float("inf"))).otherwise(F.lit(1.0))
    bad = rows.select("id", v.alias("e"), y.cast("double").alias("label"), w.alias("w"))
    given = bad.select("id", "label").unionByName(bad.filter(at(100, 0)).select("id", "label")).unionByName(bad.filter(at(70, 0)).select((F.col("id") + 1_000_000).alias("id"), "label"))
    plain = rows.select("id", F.col("label").cast("string").alias("label"))
    parts = {
        "rows": faults.faults(bad, faults.vector_rules("e", 64) | faults.weight_rules("w")),
        "trusted": faults.trusted_faults(given, rows, 10),
        "classes": faults.availability_faults(rows.select("label"), 50, 12),
        "labels": faults.label_faults(plain, plain.withColumn("label", F.when(at(25, 3), F.lit("?")).otherwise(F.col("label"))), trusted(spark, sf_dir)),
    }
    out = None
    for name, one in parts.items():
        one = one.select(F.lit(name).alias("of"), "rule", "offenders", F.col("first").cast("long").alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


#: Budgets and seeds of the grid's query.
BUDGETS, SEEDS = (2, 4), (3, 8)


def budget_grid(spark, sf_dir):
    """Accuracies by budget and seed on a fifth of the rows, held out, of fits on the others."""
    rows = views(spark, sf_dir)
    part = lambda own: rows.filter((F.pmod("id", F.lit(5)) == 0) == own)
    few = lambda df: (df.select("id", "view_a", "view_b", "joint"), df.select("id", "label"))
    r = experiments.grid(*few(part(False)), *few(part(True)), Config(), list(BUDGETS), list(SEEDS))
    return r.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


def client_sizes(spark, sf_dir):
    """Customers as clients, orders as their rows: smallest, largest, clients, and those without a row."""
    clients = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("client"))
    owned = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("client"))
    by = experiments.client_sizes(owned, clients)
    return by.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("clients"), F.sum((F.col("n") == 0).cast("long")).alias("without"))


_NAMES = [
    row_normalize, joint_concat, softmax_t, onehot, argmax_first, entropy, standardize_pop, blend_views, sqrt_places, patch_norm, flipped_labels, sentinel_labels, payload, label_bincount,
    gather_trusted, loose_sample, equal_split, landmark_sample, rbf_landmarks, nearest_centroid, first_m_per_class, untrusted_anti, gram_upper, gram_weighted, client_gram, client_gram_sum,
    rhs_targets, lineitem_gram, documents_labels, apportion, client_counts, client_owners, cumulative_cuts, largest_clients, client_accuracy, worst_client, participation, agreement,
    result_mismatches, paired_summary, centroid_update, covariance, block_mean, color_stats, image_layout, image_records, csv_round_trip, cached_features, grad_hist, teacher_scores, teacher_by_steps,
    teacher_scores_two_views, teacher_probabilities, targets, student_weights, central_weights, landmark_features, landmark_weights, predictions, predictions_landmark, stored_model, archived_model,
    monitoring, mutation_audit, federated_audit, budget_grid, refusals, monitor_windows, client_sizes,
]


def queries():
    return {f.__name__: f for f in _NAMES} | {"trusted_sample": lambda spark, sf_dir: trusted(spark, sf_dir)}


_E = """
e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, greatest(sqrt(list_sum(list_transform(e[1:32], lambda x: x * x))), 1e-12) AS na, greatest(sqrt(list_sum(list_transform(e[33:64], lambda x: x * x))), 1e-12) AS nb FROM e),
w AS (SELECT id, label, e, list_transform(e[1:32], lambda x: x / na) AS view_a, list_transform(e[33:64], lambda x: x / nb) AS view_b FROM n),
v AS (SELECT *, list_transform(list_concat(view_a, view_b), lambda x: x / sqrt(2.0)) AS joint FROM w),
t AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || id), id) AS rk FROM e) WHERE rk <= 5),
m AS (SELECT id, joint AS a FROM v ORDER BY md5('7:' || id), id LIMIT 16)"""
_D2 = "list_sum(list_transform(list_zip(joint, a), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _each(v):
    return f"WITH {_E}, x AS (SELECT id, unnest({v}) AS x, generate_subscripts({v}, 1) - 1 AS i FROM v) SELECT id, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x FROM x"


def _gram(v, client="", weight="1.0", source="v"):
    c = f"{client} AS client, " if client else ""
    k = "client, " if client else ""
    return f"""p AS (SELECT id, {c}{weight} AS w, unnest({v}) AS x, generate_subscripts({v}, 1) - 1 AS i FROM {source}),
g AS (SELECT {'a.client, ' if client else ''}a.i AS i, b.i AS j, sum(a.w * a.x * b.x) AS v FROM p a JOIN p b ON a.id = b.id AND a.i <= b.i GROUP BY {k and 'a.client, '}a.i, b.i)"""


def _distance(x, y):
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _solved(name, rows):
    """CTEs that solve a system of positive definite rows (i, row with its right-hand sides behind) by elimination."""
    return f"""{name}_g(k, m) AS (SELECT 0, (SELECT list(row ORDER BY i) FROM {rows}) UNION ALL
  SELECT k + 1, list_transform(m, lambda r, p: CASE WHEN p = k + 1 THEN list_transform(r, lambda x: x / r[k + 1])
    ELSE list_transform(list_zip(r, m[k + 1]), lambda z: z[1] - r[k + 1] / m[k + 1][k + 1] * z[2]) END) FROM {name}_g WHERE k < len(m)),
{name} AS (SELECT unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda r: r[len(m) + 1:])) AS x FROM {name}_g WHERE k = len(m))"""


def _teacher(n="", known="t", blend=True):
    """CTEs of a teacher fitted on table known (id, label): raw scores s{n}, probabilities p{n}, targets q{n} (id, c, ...)."""
    parts = [f"tr{n} AS (SELECT row_number() OVER (ORDER BY id) AS i, {known}.label AS y, view_a, view_b, joint FROM {known} JOIN v USING (id))"]
    for view, gamma in (("view_a", 4.0), ("view_b", 0.25), ("joint", 0.5))[: 3 if blend else 2]:
        k = f"{view}{n}"
        parts.append(f"k_{k} AS (SELECT a.i AS i, a.y AS y, b.i AS j, exp(-{gamma}::DOUBLE * {_distance(f'a.{view}', f'b.{view}')}) + CASE WHEN a.i = b.i THEN 0.1::DOUBLE ELSE 0 END AS k FROM tr{n} a, tr{n} b)")
        parts.append(f"r_{k} AS (SELECT i, list_concat(list(k ORDER BY j), list_transform(range(10), lambda c: CASE WHEN c = any_value(y) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS row FROM k_{k} GROUP BY i)")
        parts.append(_solved(f"a_{k}", f"r_{k}"))
        parts.append(f"e_{k} AS (SELECT v.id, exp(-{gamma}::DOUBLE * {_distance(f'v.{view}', f'tr.{view}')}) AS k, a.x AS x FROM v, tr{n} tr JOIN a_{k} a USING (i))")
        parts.append(f"s_{k} AS (SELECT id, c, sum(k * x[c + 1]) AS s FROM e_{k}, (SELECT unnest(range(10)) AS c) GROUP BY id, c)")
    two = "0.75::DOUBLE * a.s + 0.25::DOUBLE * b.s"
    joint = f" JOIN s_joint{n} j USING (id, c)" if blend else ""
    parts.append(f"s{n} AS (SELECT id, c, {f'0.5::DOUBLE * j.s + 0.5::DOUBLE * ({two})' if blend else two} AS raw FROM s_view_a{n} a JOIN s_view_b{n} b USING (id, c){joint})")
    parts.append(f"x{n} AS (SELECT id, c, exp((raw - max(raw) OVER (PARTITION BY id)) / {0.05 if blend else 0.1}::DOUBLE) AS x FROM s{n})")
    parts.append(f"p{n} AS (SELECT id, c, x / sum(x) OVER (PARTITION BY id) AS p FROM x{n})")
    parts.append(f"q{n} AS (SELECT p.id, c, k.id IS NOT NULL AS is_trusted, CASE WHEN k.id IS NULL THEN p ELSE CASE WHEN k.label = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS q FROM p{n} p LEFT JOIN {known} k ON k.id = p.id)")
    return ", ".join(parts)


_HOT = "h AS (SELECT id, c, CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q FROM e, (SELECT unnest(range(10)) AS c))"
_MAP = f"""lm AS (SELECT joint AS a, id FROM v ORDER BY md5('29002:' || id), id LIMIT 64),
lk AS (SELECT v.id, list(exp(-0.5::DOUBLE * {_distance('v.joint', 'lm.a')}) ORDER BY lm.id) AS k FROM v, lm GROUP BY v.id),
f AS (SELECT v.id, list_transform(list_concat(joint, k), lambda x: x / sqrt(2.0::DOUBLE)) AS joint FROM v JOIN lk USING (id))"""


def _student(n="", q="q", rows="v", ridge=0.03, weight="CASE WHEN id IN (SELECT id FROM t) THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END", by=""):
    """CTEs of the weights w{n} (i, x) and predictions y{n} of a ridge regression of table q (id, c, q); by: sums of groups of
    rows first."""
    group = f"{by}, " if by else ""
    k = f"{by} AS g, " if by else ""
    cells = f"SELECT {k}a.i AS i, b.i AS j, sum(a.w * a.x * b.x) AS v FROM d{n} a JOIN d{n} b USING (id) GROUP BY {group}a.i, b.i"
    right = f"SELECT {k}i, c, sum(w * x * q) AS v FROM d{n} JOIN {q} USING (id) GROUP BY {group}i, c"
    return f"""d{n} AS (SELECT id, {weight} AS w, unnest(joint) AS x, generate_subscripts(joint, 1) AS i FROM {rows}),
ga{n} AS (SELECT i, j, sum(v) AS v FROM ({cells}) GROUP BY i, j), gb{n} AS (SELECT i, c, sum(v) AS v FROM ({right}) GROUP BY i, c),
gr{n} AS (SELECT i, list(v + CASE WHEN i = j THEN {ridge}::DOUBLE ELSE 0 END ORDER BY j) AS a FROM ga{n} GROUP BY i), gs{n} AS (SELECT i, list(v ORDER BY c) AS b FROM gb{n} GROUP BY i),
gt{n} AS (SELECT i, list_concat(a, b) AS row FROM gr{n} JOIN gs{n} USING (i)), {_solved(f"sw{n}", f"gt{n}")},
z{n} AS (SELECT id, c, sum(d.x * w.x[c + 1]) AS s FROM d{n} d JOIN sw{n} w USING (i), (SELECT unnest(range(10)) AS c) GROUP BY id, c),
y{n} AS (SELECT id, CAST(c AS INT) AS prediction FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY s DESC, c) AS rk FROM z{n}) WHERE rk = 1)"""


def _rate(n, scores):
    """CTE of the share of held-out rows whose largest score (id, c, s) is their class."""
    return f"a_{n} AS (SELECT avg(CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY s DESC, c) AS rk FROM ({scores})) JOIN e USING (id) WHERE rk = 1)"


def _weighed(n, q, rows="vt", weight="1.0::DOUBLE"):
    """CTEs of a student on training rows and its rate on the held-out ones."""
    return f"{_student(n, q, rows, weight=weight)}, {_rate(n, f'SELECT id, c, sum(d.x * w.x[c + 1]) AS s FROM dh d JOIN sw{n} w USING (i), (SELECT unnest(range(10)) AS c) GROUP BY id, c')}"


def _grid():
    hot = lambda of: f"SELECT id, c, CASE WHEN c = {of} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q FROM e, (SELECT unnest(range(10)) AS c) WHERE id % 5 <> 0"
    parts = ["vt AS (SELECT * FROM v WHERE id % 5 <> 0)", "dh AS (SELECT id, unnest(joint) AS x, generate_subscripts(joint, 1) AS i FROM v WHERE id % 5 = 0)", f"hl AS ({hot('label')})", _weighed("al", "hl")]
    rows = []
    for b in BUDGETS:
        for s in SEEDS:
            k = f"{b}_{s}"
            parts.append(f"t{k} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{s}:' || id), id) AS rk FROM e WHERE id % 5 <> 0) WHERE rk <= {b})")
            parts.append(f"hf{k} AS ({hot(f'CASE WHEN id IN (SELECT id FROM t{k}) THEN label ELSE 9 - label END')})")
            parts.append(f"vk{k} AS (SELECT * FROM vt WHERE id IN (SELECT id FROM t{k}))")
            parts += [_teacher(k, f"t{k}"), _rate(f"te{k}", f"SELECT id, c, raw AS s FROM s{k} WHERE id % 5 = 0"), _rate(f"ke{k}", f"SELECT id, c, s FROM s_joint{k} WHERE id % 5 = 0")]
            parts += [_weighed(f"st{k}", f"q{k}", weight=f"CASE WHEN id IN (SELECT id FROM t{k}) THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END"), _weighed(f"to{k}", "hl", f"vk{k}"), _weighed(f"fl{k}", f"hf{k}")]
            one = ", ".join(f"round((SELECT a FROM a_{n}), 6) AS {name}_accuracy" for n, name in ((f"te{k}", "teacher"), (f"ke{k}", "kernel"), (f"st{k}", "student"), (f"to{k}", "trusted_only"), ("al", "all_label"), (f"fl{k}", "flipped")))
            rows.append(f"SELECT CAST({b} AS INT) AS per_class, CAST({s} AS BIGINT) AS seed, CAST({b * 10} AS INT) AS trusted, {one}")
    return f"WITH RECURSIVE {_E}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


def _refusals():
    """Faults as SQL: each by the table that has it."""
    f = lambda of, rule, bad, table, key="id": f"SELECT '{of}' AS of, '{rule}' AS rule, count(*) AS offenders, CAST(min({key}) AS BIGINT) AS first FROM {table} WHERE {bad}"
    rows = [f("rows", f"e {r}", f"id % 50 = {k}", "e") for r, k in (("is null", 1), ("holds nulls", 2), ("holds NaN", 3), ("holds infinite values", 4), ("has not 64 values", 5))]
    rows += [f("rows", "w is null", "id % 30 = 2", "e"), f("rows", "w is not finite", "id % 30 = 4", "e"), f("rows", "w is not positive", "id % 30 IN (1, 3)", "e")]
    rows += [f("trusted", f"id {r}", "false", "given") for r in ("is null", "is not finite", "has a fraction")]
    rows += [f("trusted", f"label {r}", b, "given") for r, b in (("is null", "y IS NULL"), ("is not finite", "isnan(y)"), ("has a fraction", "NOT isnan(y) AND y <> floor(y)"), ("is below 0", "y < 0"), ("is 10 or more", "NOT isnan(y) AND y >= 10"))]
    rows += ["SELECT 'trusted', 'no trusted row', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END, CAST(NULL AS BIGINT) FROM given"]
    rows += [f("trusted", "id is trusted twice", "n > 1", "(SELECT id, count(*) AS n FROM given GROUP BY id)"), f("trusted", "id is not among the examples", "id NOT IN (SELECT id FROM e)", "(SELECT DISTINCT id FROM given)")]
    rows += [f("classes", "class has not 50 rows", "n < 50", "(SELECT label, count(e.id) AS n FROM (SELECT unnest(range(12)) AS label) LEFT JOIN e USING (label) GROUP BY label)", "label"), f("labels", "trusted labels differ", "id % 25 = 3", "t")]
    y = "CASE id % 40 WHEN 7 THEN NULL WHEN 8 THEN label + 0.5::DOUBLE WHEN 9 THEN 'nan'::DOUBLE WHEN 11 THEN 99 WHEN 12 THEN -1 ELSE label END"
    given = f"y AS (SELECT id, {y} AS y FROM e), given AS (SELECT id, y FROM y UNION ALL SELECT id, y FROM y WHERE id % 100 = 0 UNION ALL SELECT id + 1000000, y FROM y WHERE id % 70 = 0)"
    return f"WITH {_E}, {given} {' UNION ALL '.join(rows)}"


def _by_class(table, v, more=""):
    return f"SELECT id, {more}CAST(c AS INT) AS c, round({v}, 6) + 0.0 AS {v} FROM {table}"


def _each_weight(n="", name="w"):
    return f"SELECT CAST(i - 1 AS INT) AS i, CAST(c AS INT) AS c, round(x[c + 1], 6) + 0.0 AS {name} FROM sw{n}, (SELECT unnest(range(10)) AS c)"


_BYTES = """blob AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''),
piece AS (SELECT doc_id * 1000 + k AS id, doc_id % 10 AS label, rpad(substr(h, k * 6144 + 1, 6144), 6144, '0') AS h FROM blob, unnest(range((len(h) + 6143) // 6144)) AS g(k)),
byte AS (SELECT id, label, k, CAST('0x' || substr(h, 2 * k + 1, 2) AS INT) AS b FROM piece, range(3072) AS g(k))"""
_AT = "CAST(CAST('0x' || substr(h, 2 * (k + {0}) + 1, 2) AS INT) AS FLOAT) / CAST(255 AS FLOAT)"
_GREY = f"""{_BYTES},
g AS (SELECT id, k // 32 AS r, k % 32 AS c, CAST(0.299 AS FLOAT) * ({_AT.format(0)}) + CAST(0.587 AS FLOAT) * ({_AT.format(1024)}) + CAST(0.114 AS FLOAT) * ({_AT.format(2048)}) AS x FROM piece, range(1024) AS g(k)),
n AS (SELECT id, r, c, lead(x) OVER (PARTITION BY id, r ORDER BY c) - lag(x) OVER (PARTITION BY id, r ORDER BY c) AS dx,
  lead(x) OVER (PARTITION BY id, c ORDER BY r) - lag(x) OVER (PARTITION BY id, c ORDER BY r) AS dy FROM g),
d AS (SELECT id, (r - 1) // 4 AS r, (c - 1) // 4 AS c, sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) AS s, CAST(atan2(CAST(dy AS DOUBLE), CAST(dx AS DOUBLE)) AS FLOAT) AS a
  FROM n WHERE r BETWEEN 1 AND 30 AND c BETWEEN 1 AND 30),
b AS (SELECT id, r, c, s, least(CAST(floor((CASE WHEN a < 0 THEN a + pi() WHEN a >= CAST(pi() AS FLOAT) THEN 0 ELSE a END) * (9 / pi())) AS INT), 8) AS bin FROM d),
h AS (SELECT id, r, c, bin, sqrt(sum(s)) AS h FROM b GROUP BY id, r, c, bin)"""


_ARGMAX = "list_position(e[1:10], list_max(e[1:10])) - 1"
_PIX = f"{_BYTES}, q AS (SELECT id, k // 1024 * 16 + (k % 1024 // 32) // 8 * 4 + (k % 32) // 8 AS i, CAST(CAST(b AS FLOAT) / CAST(255 AS FLOAT) AS DOUBLE) AS x FROM byte), b AS (SELECT id, i, avg(x) AS x FROM q GROUP BY id, i)"


def oracle_sql():
    own = "list_position(list_transform(e, lambda x: round(x, 1)), list_max(list_transform(e, lambda x: round(x, 1)))) - 1"
    deal = f"WITH {_E}, s AS (SELECT label, count(*) AS n FROM e GROUP BY label), c AS (SELECT label, n, client, n * ((client + 1) / 10.0::DOUBLE) AS raw FROM s, (SELECT unnest(range(4)) AS client)), f AS (SELECT *, CAST(floor(raw) AS BIGINT) AS whole FROM c), r AS (SELECT *, n - sum(whole) OVER (PARTITION BY label) AS rest, row_number() OVER (PARTITION BY label ORDER BY raw - whole DESC, client) AS rk FROM f), d AS (SELECT label, CAST(client AS INT) AS client, CAST(whole + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS count FROM r) "
    owned = ", s2 AS (SELECT label, client, count, coalesce(sum(count) OVER (PARTITION BY label ORDER BY client ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM d), k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || id), id) - 1 AS rk FROM e), o AS (SELECT id, k.label, client FROM k JOIN s2 ON s2.label = k.label AND rk >= lo AND rk < lo + count) "
    cuts = f"WITH {_E}, s AS (SELECT label, count(*) AS n FROM e GROUP BY label), c AS (SELECT label, n, CAST(client AS INT) AS client, sum((client + 1) / 10.0::DOUBLE) OVER (PARTITION BY label ORDER BY client) AS p FROM s, (SELECT unnest(range(4)) AS client)), h AS (SELECT *, CASE WHEN client = 3 THEN n ELSE CAST(floor(p * n) AS BIGINT) END AS hi FROM c), s2 AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY label ORDER BY client), 0) AS lo FROM h), k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || id), id) - 1 AS rk FROM e), o AS (SELECT id, k.label, client FROM k JOIN s2 ON s2.label = k.label AND rk >= lo AND rk < hi) "
    means = f"WITH {_E}, cm AS (SELECT label % 2 AS per_class, label AS seed, avg(e[1]) AS l, avg(e[2]) AS r FROM e GROUP BY label)"
    return {
        "row_normalize": _each("view_a"),
        "joint_concat": _each("joint"),
        "softmax_t": f"WITH {_E}, s AS (SELECT id, list_transform(e, lambda x: exp((x - list_max(e)) / 0.1::DOUBLE)) AS s FROM e), x AS (SELECT id, unnest(s) / list_sum(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM s) SELECT id, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x FROM x",
        "onehot": "SELECT vec_id AS id, CAST(c AS INT) AS i, CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM embeddings, (SELECT unnest(range(10)) AS c)",
        "argmax_first": f"WITH {_E} SELECT id, CAST({own} AS INT) AS place FROM e",
        "entropy": f"WITH {_E} SELECT id, round(-list_sum(list_transform(list_filter(list_transform(e, lambda x: x * x), lambda y: y > 0), lambda z: z * ln(z))) / ln(64), 6) AS h FROM e",
        "standardize_pop": f"WITH {_E}, x AS (SELECT id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM e), a AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY i) SELECT id, CAST(i AS INT) AS i, round((x - m) / (s + 0.01::DOUBLE), 6) + 0.0 AS x FROM x JOIN a USING (i)",
        "blend_views": _each("list_transform(list_zip(view_a, view_b), lambda z: 0.75::DOUBLE * z[1] + 0.25::DOUBLE * z[2])"),
        "sqrt_places": _each("list_transform(e, lambda x: sqrt(abs(x)))"),
        "patch_norm": f"WITH {_E}, c AS (SELECT id, list_transform(e, lambda x: x * 255 - list_avg(e) * 255) AS c FROM e), x AS (SELECT id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)) / 64 + 10.0::DOUBLE)) AS c FROM c), y AS (SELECT id, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS i FROM x) SELECT id, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x FROM y",
        "flipped_labels": f"WITH {_E} SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN label ELSE 9 - label END AS label FROM e",
        "sentinel_labels": f"WITH {_E} SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN CAST(label AS VARCHAR) ELSE 'NOT-FOR-TRAINING' END AS label FROM e",
        "payload": "SELECT CAST(w AS INT) AS width, CAST(n AS INT) AS bytes_each, CAST((w * (w + 1) // 2 + w * (SELECT count(DISTINCT label) FROM embeddings)) * n AS BIGINT) AS bytes FROM (SELECT unnest([64, 880, 6400]) AS w), (SELECT unnest([4, 8]) AS n)",
        "label_bincount": "SELECT CAST(c AS INT) AS label, (SELECT count(*) FROM embeddings WHERE label = c) AS n FROM (SELECT unnest(range(12)) AS c)",
        "gather_trusted": f"WITH {_E}, x AS (SELECT id, unnest(joint) AS x, generate_subscripts(joint, 1) - 1 AS i FROM v WHERE id IN (SELECT id FROM t)) SELECT id, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x FROM x",
        "loose_sample": f"WITH {_E} SELECT id, label FROM e ORDER BY md5('11:' || id), id LIMIT 32",
        "equal_split": f"WITH {_E} SELECT id, CAST(ntile(7) OVER (ORDER BY md5('7:' || id), id) - 1 AS INT) AS client FROM e",
        "landmark_sample": f"WITH {_E} SELECT id FROM m",
        "rbf_landmarks": f"WITH {_E}, d AS (SELECT v.id, m.id AS anchor, {_D2} AS d2 FROM v, m) SELECT id, anchor, round(d2, 6) AS d2, round(exp(-0.5 * d2), 6) AS k FROM d",
        "nearest_centroid": f"WITH {_E}, d AS (SELECT v.id, m.id AS anchor, {_D2} AS d2 FROM v, m) SELECT id, centroid, round(d2, 6) AS d2 FROM (SELECT id, anchor AS centroid, d2, row_number() OVER (PARTITION BY id ORDER BY d2, anchor) AS rk FROM d) WHERE rk = 1",
        "first_m_per_class": f"WITH {_E} SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS rk FROM e) WHERE rk <= 3",
        "trusted_sample": f"WITH {_E} SELECT id, label FROM t",
        "untrusted_anti": f"WITH {_E} SELECT id, label FROM e WHERE id NOT IN (SELECT id FROM t)",
        "gram_upper": f"WITH {_E}, {_gram('joint')} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v, 6) + 0.0 AS v FROM g",
        "gram_weighted": f"WITH {_E}, {_gram('joint', '', 'CASE WHEN id IN (SELECT id FROM t) THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END')} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v, 6) + 0.0 AS v FROM g",
        "client_gram": f"WITH {_E}, {_gram('view_b', 'id % 4')} SELECT client, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v, 6) + 0.0 AS v FROM g",
        "client_gram_sum": f"WITH {_E}, {_gram('view_b')} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v, 6) + 0.0 AS v FROM g",
        "rhs_targets": f"WITH {_E}, x AS (SELECT label, unnest(joint) AS x, generate_subscripts(joint, 1) - 1 AS i FROM v) SELECT CAST(i AS INT) AS i, label AS c, round(sum(x), 6) + 0.0 AS v FROM x GROUP BY i, label",
        "lineitem_gram": "WITH r AS (SELECT [round(l_quantity), floor(l_extendedprice / 100), round(l_discount * 100), round(l_tax * 100)] AS f, l_returnflag AS g FROM lineitem), x AS (SELECT list_concat(f, [CASE WHEN g = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN g = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN g = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END]) AS y FROM r) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, sum(y[i + 1] * y[j + 1]) AS v FROM x, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(7)) AS j) GROUP BY i, j",
        "documents_labels": "SELECT source, count(*) AS n, count(quality) AS labelled, CAST(coalesce(sum(quality), 0) AS BIGINT) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
        "apportion": deal + "SELECT label, client, count FROM d",
        "client_counts": deal + "SELECT client, label, count AS n FROM d WHERE count > 0",
        "client_owners": deal + owned + "SELECT id, label, client FROM o",
        "cumulative_cuts": cuts + "SELECT id, label, client FROM o",
        "largest_clients": cuts + "SELECT client, count(*) AS n FROM o GROUP BY client ORDER BY n DESC, client LIMIT 2",
        "client_accuracy": f"WITH {_E} SELECT id % 7 AS client, count(*) AS n, round(avg(CASE WHEN {_ARGMAX} = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM e GROUP BY 1",
        "worst_client": f"WITH {_E}, x AS (SELECT id % 7 AS client, avg(CASE WHEN {_ARGMAX} = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM e GROUP BY 1) SELECT round(min(a), 6) AS worst, round(var_samp(a), 6) AS variance, count(*) AS clients FROM x",
        "participation": f"WITH {_E}, x AS (SELECT id % 10 AS client, avg(CASE WHEN {_ARGMAX} = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM e GROUP BY 1), r AS (SELECT rate, rep, a, row_number() OVER (PARTITION BY rate, rep ORDER BY md5('7:' || rep || ':' || client), client) AS rk, count(*) OVER (PARTITION BY rate, rep) AS n FROM x, (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE, 1.0::DOUBLE]) AS rate), (SELECT unnest(range(3)) AS rep)), pm AS (SELECT rate, rep, avg(a) AS a FROM r WHERE rk <= greatest(1, round_even(rate * n, 0)) GROUP BY rate, rep) SELECT rate, round(avg(a), 6) AS mean_accuracy, round(min(a), 6) AS min_accuracy FROM pm GROUP BY rate",
        "agreement": f"WITH {_E} SELECT round(avg(CASE WHEN list_position(e[1:10], list_max(e[1:10])) = list_position(e[11:20], list_max(e[11:20])) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement FROM e",
        "result_mismatches": f"{means} SELECT per_class, seed, round(l, 6) AS a, round(l + 1, 6) AS b FROM cm WHERE seed < 3",
        "paired_summary": f"""{means}, d AS (SELECT *, l - r AS d FROM cm), k AS (SELECT per_class, d, rank() OVER (PARTITION BY per_class ORDER BY abs(d)) AS rk FROM d),
wr AS (SELECT per_class, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS plus, sum(rk) AS every FROM k GROUP BY per_class),
a AS (SELECT per_class, b, sum(CASE WHEN (b >> CAST(rk - 1 AS INT)) & 1 = 1 THEN rk ELSE 0 END) AS s FROM k, (SELECT CAST(unnest(range(32)) AS INT) AS b) GROUP BY per_class, b),
sr AS (SELECT per_class, least(1.0::DOUBLE, 2.0::DOUBLE * sum(CASE WHEN s <= least(plus, every - plus) THEN 1 ELSE 0 END) / 32) AS p FROM a JOIN wr USING (per_class) GROUP BY per_class),
g AS (SELECT per_class, count(*) AS n, avg(l) AS lm, stddev_samp(l) AS ls, avg(r) AS rm, avg(d) AS gain, stddev_samp(d) AS sd, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS wins,
  sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS ties, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS losses, max(l) AS top FROM d GROUP BY per_class),
x AS (SELECT *, sd / sqrt(5) AS err, atan(gain / (sd / sqrt(5)) / 2) AS th, sqrt(4 * 0.975::DOUBLE * 0.025::DOUBLE) AS ra FROM g),
y AS (SELECT *, 2 * sqrt(cos(acos(ra) / 3) / ra - 1) AS tq FROM x)
SELECT per_class, n, round(lm, 6) AS left_mean, round(ls, 6) AS left_std, round(rm, 6) AS right_mean, round(gain, 6) AS gain, round(sd, 6) AS gain_std, round(gain - tq * err, 6) AS gain_low,
  round(gain + tq * err, 6) AS gain_high, CAST(wins AS BIGINT) AS wins, CAST(ties AS BIGINT) AS ties, CAST(losses AS BIGINT) AS losses, round(top, 6) AS left_max,
  round(1 - abs(sin(th)) * (1 + cos(th) * cos(th) / 2), 6) AS p_value, round(p, 6) AS signed_rank_p FROM y JOIN sr USING (per_class)""",
        "centroid_update": f"WITH {_E}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, joint AS a FROM (SELECT id, joint FROM v ORDER BY id LIMIT 8)), d AS (SELECT v.id, k, joint, row_number() OVER (PARTITION BY v.id ORDER BY {_distance('joint', 'a')}, k) AS rk FROM v, c), x AS (SELECT k, unnest(joint) AS x, generate_subscripts(joint, 1) - 1 AS i FROM d WHERE rk = 1) SELECT CAST(k AS INT) AS centroid, CAST(i AS INT) AS i, round(avg(x), 6) + 0.0 AS x FROM x GROUP BY k, i",
        "image_layout": f"WITH {_BYTES} SELECT id, round(sum(b / 255.0::DOUBLE * (k % 3 * 1024 + k // 3)), 4) AS s FROM byte GROUP BY id",
        "image_records": f"WITH {_BYTES} SELECT CAST(label AS INT) AS label, CAST(sum(b * (k + 1)) AS BIGINT) AS s FROM byte GROUP BY id, label",
        "csv_round_trip": "SELECT doc_id, quality, toxic FROM labels",
        "cached_features": f"WITH {_PIX} SELECT id, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x FROM b",
        "grad_hist": f"WITH {_GREY}, u AS (SELECT id, greatest(sqrt(sum(h * h)), 1e-12) AS n, sum(h) AS s FROM h GROUP BY id) SELECT id, round(s / n, 3) AS s FROM u",
        "teacher_scores": f"WITH RECURSIVE {_E}, {_teacher()} {_by_class('s', 'raw')}",
        "teacher_by_steps": f"WITH RECURSIVE {_E}, {_teacher()} {_by_class('s', 'raw')}",
        "teacher_scores_two_views": f"WITH RECURSIVE {_E}, {_teacher(blend=False)} {_by_class('s', 'raw')}",
        "teacher_probabilities": f"WITH RECURSIVE {_E}, {_teacher()} {_by_class('p', 'p')}",
        "targets": f"WITH RECURSIVE {_E}, {_teacher()} {_by_class('q', 'q', 'is_trusted, ')}",
        "student_weights": f"WITH RECURSIVE {_E}, {_HOT}, {_student(q='h')} {_each_weight()}",
        "central_weights": f"WITH RECURSIVE {_E}, {_HOT}, {_student(q='h', ridge=1.0, weight='1.0::DOUBLE')} {_each_weight()}",
        "landmark_features": f"WITH {_E}, {_MAP}, x AS (SELECT id, unnest(joint) AS x, generate_subscripts(joint, 1) - 1 AS i FROM f) SELECT id, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x FROM x",
        "landmark_weights": f"WITH RECURSIVE {_E}, {_HOT}, {_MAP}, {_student(q='h', rows='f', ridge=1.0, weight='1.0::DOUBLE')} {_each_weight()}",
        "predictions": f"WITH RECURSIVE {_E}, {_teacher()}, {_student()} SELECT id, prediction FROM y",
        "predictions_landmark": f"WITH RECURSIVE {_E}, {_MAP}, {_teacher(blend=False)}, {_student(rows='f', ridge=1.0, weight='1.0::DOUBLE')} SELECT id, prediction FROM y",
        "stored_model": f"WITH RECURSIVE {_E}, {_teacher()}, {_student()} SELECT id, CAST(c AS INT) AS c, round(s, 6) + 0.0 AS scores FROM z",
        "archived_model": f"WITH RECURSIVE {_E}, {_MAP}, {_teacher(blend=False)}, {_student(rows='f', ridge=1.0, weight='1.0::DOUBLE')} SELECT id, CAST(c AS INT) AS c, round(s, 6) + 0.0 AS scores FROM z",
        "monitoring": f"WITH RECURSIVE {_E}, {_teacher()}, {_student()}, tp AS (SELECT id, c FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY p DESC, c) AS rk FROM p) WHERE rk = 1), b AS (SELECT label, avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM y JOIN e USING (id) GROUP BY label) SELECT (SELECT count(DISTINCT label) FROM t) / 10.0::DOUBLE AS class_coverage, round((SELECT avg(CASE WHEN c <> prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM tp JOIN y USING (id)), 6) AS disagreement, label AS worst_class, round(a, 6) AS worst_accuracy, 0.8::DOUBLE AS participation FROM b ORDER BY a, label LIMIT 1",
        "mutation_audit": f"""WITH RECURSIVE {_E}, la AS (SELECT id, CAST(label AS VARCHAR) AS label FROM e), lb AS (SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN CAST(label AS VARCHAR) ELSE 'NOT-FOR-TRAINING' END AS label FROM e),
ta AS (SELECT id, TRY_CAST(la.label AS INT) AS label FROM la JOIN (SELECT id FROM t) USING (id)), tb AS (SELECT id, TRY_CAST(lb.label AS INT) AS label FROM lb JOIN (SELECT id FROM t) USING (id)),
{_teacher('1', 'ta')}, {_student('1', 'q1')}, {_teacher('2', 'tb')}, {_student('2', 'q2')},
td AS (SELECT max(abs(a.q - b.q)) AS d FROM q1 a JOIN q2 b USING (id, c)), wd AS (SELECT max(abs(a.x[c + 1] - b.x[c + 1])) AS d FROM sw1 a JOIN sw2 b USING (i), (SELECT unnest(range(10)) AS c)),
mu AS (SELECT count(*) AS n FROM la JOIN lb USING (id) WHERE la.label <> lb.label)
SELECT mu.n AS mutated, round(td.d, 6) + 0.0 AS target_max_diff, round(wd.d, 6) + 0.0 AS weight_max_diff, td.d < 1e-9 AND wd.d < 1e-9 AS same_digests, td.d < 1e-9 AND wd.d < 1e-9 AS passed FROM td, wd, mu""",
        "federated_audit": f"WITH RECURSIVE {_E}, {_HOT}, {_student('1', 'h', ridge=1.0, weight='1.0::DOUBLE', by='id % 7')}, {_student('2', 'h', ridge=1.0, weight='1.0::DOUBLE')}, f AS ({_each_weight('1', 'federated')}), c AS ({_each_weight('2', 'central')}) SELECT f.i, f.c, federated, central, round(max(abs(federated - central)) OVER (), 9) + 0.0 AS max_weight_diff FROM f JOIN c ON f.i = c.i AND f.c = c.c",
        "budget_grid": _grid(),
        "refusals": _refusals(),
        "monitor_windows": """WITH x AS (SELECT CAST(epoch(ts) AS BIGINT) AS s, epoch(ts) AS p, user_id, (ascii(event_type) + length(event_type)) % 5 AS a, (CAST(floor(value) AS BIGINT) % 5 + 5) % 5 AS b, event_id % 97 = 0 AS t FROM events),
w AS (SELECT *, CAST(floor(p / 21600) AS BIGINT) * 21600 AS start FROM x)
SELECT start, count(*) AS rows, count(*) FILTER (t) AS trusted, round(count(DISTINCT CASE WHEN t THEN a END) / 5.0::DOUBLE, 6) AS class_coverage, round(avg(CASE WHEN a <> b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS disagreement,
  count(DISTINCT user_id) AS active, round(count(DISTINCT user_id) / (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) FROM events), 6) AS participation
FROM w GROUP BY start HAVING start + 21600 <= (SELECT max(p) FROM x) - 3600""",
        "covariance": f"WITH {_E}, p AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM range(64) AS a(i), range(64) AS b(j) WHERE i <= j) SELECT i, j, round(covar_samp(e[i + 1], e[j + 1]), 6) + 0.0 AS c FROM e, p GROUP BY i, j",
        "block_mean": f"WITH {_PIX} SELECT id, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x FROM b",
        "color_stats": f"WITH {_PIX} SELECT CAST(i AS INT) AS i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM b GROUP BY i",
        "client_sizes": "WITH u AS (SELECT c_custkey, count(o_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT min(n) AS smallest, max(n) AS largest, count(*) AS clients, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS without FROM u",
    }
