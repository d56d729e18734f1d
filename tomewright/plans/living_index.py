"""An inverted file that takes in new vectors without being built anew.

A cell is a set of pieces, one folder each, and a version of the index is the list of live pieces with their radius,
size and mean. New vectors go to the stored centres and become new pieces; a cell is rewritten only where it
holds an older vector of a new id or too many pieces. Centres stay until the vectors have drifted from them.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tomewright.operators.inverted_file import nearest_cells, train_cells
from tomewright.session import durable
from tomewright.sources import versions
from tomewright.sources.sinks import FILE_ROWS

#: Pieces a cell may have; one more and they are merged into one. Bounds the list of pieces by cells.
MAX_PIECES = 8
#: Versions a running reader may still need.
KEPT_VERSIONS = 3

_PIECE = ["cell", "generation"]


def build(vectors: DataFrame, path: str, n_cells: int) -> None:
    """First version of an index over ``vectors(vec_id, embedding, ...)``, which must hold a vector.

    Null ids and vectors take no part; of several rows with one id the one that sorts lowest stays. Columns named
    ``cell`` or ``generation`` are left out, others are kept; later batches must have the same.
    """
    if versions.current(vectors.sparkSession, path) is not None:
        raise ValueError(f"{path} holds an index")
    _train(_one_per_id(vectors), path, n_cells, 1)


def ingest(vectors: DataFrame, path: str, max_drift: float = 0.1) -> float:
    """Add ``vectors`` as a new version and return the drift; a vector of a known id takes the older one's place.

    Written are the new vectors and the cells that held one of their ids or have too many pieces; of the others
    only ids are read. While centres stay, several ingests give the members and cells of a single one.
    Once drift exceeds that of the last training by ``max_drift``, all cells are trained and written anew.
    An empty batch changes no member. A run that dies before its end leaves the current version as it was.
    """
    spark = vectors.sparkSession
    now = versions.current(spark, path)
    pieces, centres = _tables(spark, path, now)
    new = durable(nearest_cells(_one_per_id(vectors), "embedding", centres, 1))
    ids = new.select("vec_id")
    members = _live(spark, path, pieces)
    replaced = members.join(ids, "vec_id", "left_semi").select("cell").distinct()
    counts = pieces.groupBy("cell").agg(F.count("*").alias("n"))
    full = counts.join(new.select("cell").distinct(), "cell").where(F.col("n") >= MAX_PIECES).select("cell")
    merged = durable(replaced.union(full).distinct())
    kept = members.join(F.broadcast(merged), "cell", "left_semi").join(ids, "vec_id", "left_anti")
    written = _write_pieces(kept.drop("generation").unionByName(new), centres, path)
    _publish(pieces.join(merged, "cell", "left_anti").unionByName(written), centres, path, now + 1)
    found = drift(spark, path)
    base = centres.agg(F.max("base_drift")).first()[0]
    if found - base > max_drift:
        pieces, centres = _tables(spark, path, now + 1)
        _train(_live(spark, path, pieces).drop("cell", "generation"), path, centres.count(), now + 2)
        found = drift(spark, path)
    _forget(spark, path)
    return found


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(members, balls)`` of the current or a kept version, as the searches by cell take them."""
    pieces, centres = _tables(spark, path, versions.current(spark, path) if version is None else version)
    balls = centres.select("cell", "centroid").join(
        pieces.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n_members").alias("n_members")), "cell"
    )
    return _live(spark, path, pieces).drop("generation"), balls


def drift(spark: SparkSession, path: str) -> float:
    """Mean over all vectors of 1 - cosine between the centre of their cell and the cell's mean; 0 without vectors."""
    return _drift(*_tables(spark, path, versions.current(spark, path)))


def _drift(pieces: DataFrame, centres: DataFrame) -> float:
    weighted = pieces.select("cell", "n_members", F.posexplode("mean").alias("axis", "x"))
    sums = weighted.groupBy("cell", "axis").agg(F.sum(F.col("x") * F.col("n_members")).alias("s"))
    axes = centres.select("cell", F.posexplode("centroid").alias("axis", "c"))
    size = pieces.groupBy("cell").agg(F.sum("n_members").alias("n"))
    length = F.sqrt(F.sum(F.col("s") * F.col("s")) * F.sum(F.col("c") * F.col("c")))
    cosine = F.coalesce(F.try_divide(F.sum(F.col("s") * F.col("c")), length), F.lit(0.0))
    away = sums.join(axes, ["cell", "axis"]).groupBy("cell").agg((1 - cosine).alias("d"))
    return away.join(size, "cell").agg(F.coalesce(F.sum(F.col("d") * F.col("n")) / F.sum("n"), F.lit(0.0))).first()[0]


def _one_per_id(vectors: DataFrame) -> DataFrame:
    others = [c for c in vectors.columns if c not in ("vec_id", *_PIECE)]
    lowest = F.min(F.struct("embedding", *[c for c in others if c != "embedding"])).alias("row")
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(lowest).select(
        "vec_id", *[F.col("row")[c].alias(c) for c in others]
    )


def _train(vectors: DataFrame, path: str, n_cells: int, number: int) -> None:
    centres = durable(train_cells(vectors, "embedding", n_cells))
    pieces = durable(_write_pieces(nearest_cells(vectors, "embedding", centres, 1), centres, path))
    _publish(pieces, centres.select("cell", "centroid").withColumn("base_drift", F.lit(_drift(pieces, centres))), path, number)


def _write_pieces(members: DataFrame, centres: DataFrame, path: str) -> DataFrame:
    """Write ``members`` as one new piece of each of their cells, large ones in slices, and describe the pieces."""
    generation = uuid.uuid4().hex
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("__n"))
    spread = members.join(F.broadcast(sizes), "cell").withColumn("__slice", F.pmod(F.xxhash64("vec_id"), F.col("__n")))
    (
        spread.withColumn("generation", F.lit(generation)).repartition("cell", "__slice").drop("__n", "__slice")
        .write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*_PIECE).parquet(f"{path}/vectors")
    )
    back = _stored(members.sparkSession, path, members).where(F.col("generation") == generation)
    return back.join(centres.select("cell", "centroid"), "cell").groupBy(*_PIECE).agg(
        F.max(_distance("embedding", "centroid")).alias("radius"), F.count("*").alias("n_members"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding")))).alias("mean"),
    )


def _distance(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    fields = [f for f in like.schema.fields if f.name not in _PIECE]
    typed = StructType([*fields, StructField("cell", LongType()), StructField("generation", StringType())])
    return spark.read.schema(typed).parquet(f"{path}/vectors")


def _live(spark: SparkSession, path: str, pieces: DataFrame) -> DataFrame:
    """Vectors of the live pieces; folders of others are not read. At most ``MAX_PIECES`` rows a cell are sent."""
    every = spark.read.parquet(f"{path}/vectors")
    return _stored(spark, path, every).join(F.broadcast(pieces.where("n_members > 0").select(*_PIECE)), _PIECE, "left_semi")


def _tables(spark: SparkSession, path: str, number: int) -> tuple[DataFrame, DataFrame]:
    at = versions.folder(path, number)
    return spark.read.parquet(f"{at}/pieces"), spark.read.parquet(f"{at}/centres")


def _publish(pieces: DataFrame, centres: DataFrame, path: str, number: int) -> None:
    at = versions.folder(path, number)
    pieces.select(*_PIECE, "radius", "n_members", "mean").write.mode("overwrite").parquet(f"{at}/pieces")
    centres.write.mode("overwrite").parquet(f"{at}/centres")
    versions.point_to(pieces.sparkSession, path, number)


def _forget(spark: SparkSession, path: str) -> None:
    """Remove versions before the last ``KEPT_VERSIONS`` and the pieces that only they name."""
    now = versions.current(spark, path)
    numbers = [n for n in versions.started(spark, path) if n <= now]
    old, kept = numbers[:-KEPT_VERSIONS], numbers[-KEPT_VERSIONS:]
    if not old:
        return
    named = [spark.read.parquet(*[f"{versions.folder(path, n)}/pieces" for n in some]).select(*_PIECE).distinct() for some in (old, kept)]
    for piece in named[0].join(named[1], _PIECE, "left_anti").toLocalIterator():
        versions.remove(spark, f"{path}/vectors/cell={piece.cell}/generation={piece.generation}")
    for n in old:
        versions.remove(spark, versions.folder(path, n))
