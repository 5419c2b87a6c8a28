"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact reranking.

Rotations learned on a bounded sample turn unit vectors into balanced binary codes. The
code is cut into substrings, one table for each. Two vectors are candidates if a substring
differs in at most two bits: each vector files its substring and all its one-bit variants, so
that such pairs meet in an equality join, where a pair is kept at one place only. Candidates
within a Hamming radius are reranked by the cosine of the original vectors. Vectors of each
length have rotations and tables of their own; the pairs of rare lengths are compared as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .components import components

THRESHOLD = 0.9
#: Vectors that the rotations are fitted on, and rounds of the fit.
FIT_SAMPLE = 20_000
FIT_ROUNDS = 40
#: Share of pairs at the threshold that the tables may miss, from which their number follows.
MISS = 0.03
#: Candidates further apart than the mean at the threshold plus so many deviations are not reranked.
DEVIATIONS = 3.5
#: Vectors of one length up to which their pairs are compared without codes.
FEW = 64


def unit_vectors(df: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, unit, key) of all rows: unit length in double precision, key of the raw values.

    Null, empty and zero vectors, those with null or non-finite components and those without
    an id are not usable: their dim, unit and key are null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, units, keys = [], [], []
            for i, v in zip(batch.column(0), batch.column(1)):
                values = v.values if v.is_valid and i.is_valid else None
                x = None if values is None or not len(values) or values.null_count else values.to_numpy(zero_copy_only=False).astype(np.float64)
                if x is None or not np.isfinite(x).all() or not x.any():
                    x = None
                else:
                    y = x / np.abs(x).max()  # no overflow in the squares
                dims.append(None if x is None else len(x))
                units.append(None if x is None else y / np.sqrt((y * y).sum()))
                keys.append(None if x is None else xxhash.xxh3_128_digest((x + 0.0).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.binary())],
                ["vec_id", "dim", "unit", "key"],
            )

    return df.select(F.col(ident).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(
        run, "vec_id long, dim int, unit array<double>, key binary"
    )


def learn_rotation(x: np.ndarray, seed: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """A dim x dim projection whose signs are balanced, de-correlated bits of little quantisation error.

    Principal axes, then rounds that alternate between the nearest binary codes and the
    orthogonal rotation that fits them best.
    """
    dim = x.shape[1]
    axes = np.linalg.eigh(x.T @ x / max(len(x), 1))[1][:, ::-1]
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def table_plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """Bits of a substring, number of tables, Hamming radius for ``n`` vectors.

    A substring has about log2(n) bits, so that a bucket holds few unrelated vectors at any
    n. At the threshold a bit differs with probability arccos(t) / pi; the number of tables
    follows from the chance that all of them miss a pair.
    """
    bits = min(max(math.ceil(math.log2(max(n, 2))), 10), 30)
    p = math.acos(threshold) / math.pi
    hit = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    tables = max(1, math.ceil(math.log(MISS) / math.log(1 - hit)))
    whole = bits * tables
    return bits, tables, math.ceil(whole * p + DEVIATIONS * math.sqrt(whole * p * (1 - p)))


def codes(vectors: DataFrame, projections: np.ndarray, bits: int, tables: int) -> DataFrame:
    """(vec_id, s0, s1, ...): the substrings of each vector's code; projections: dim x (bits * tables)."""
    weights = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(1)
            x = units.flatten().to_numpy().reshape(len(units), -1) if len(units) else np.empty((0, len(projections)))
            on = (x @ projections >= 0).reshape(len(x), tables, bits)
            subs = (on @ weights).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(subs[:, t]) for t in range(tables))], ["vec_id", *(f"s{t}" for t in range(tables))]
            )

    columns = ", ".join(f"s{t} int" for t in range(tables))
    return vectors.select("vec_id", "unit").mapInArrow(run, f"vec_id long, {columns}")


def candidates(coded: DataFrame, bits: int, tables: int, radius: int) -> DataFrame:
    """Pairs (a < b) within the radius of which a substring differs in two bits or less, each pair once."""
    subs = [f"s{t}" for t in range(tables)]
    flips = F.array(F.lit(0), *[F.lit(1 << k) for k in range(bits)])
    filed = F.array(*[F.struct(F.lit(t).alias("t"), F.col(s).alias("sub")) for t, s in enumerate(subs)])
    rows = coded.withColumn("x", F.explode(filed)).select("vec_id", *subs, "x.t", "x.sub", F.explode(flips).alias("flip"))
    rows = rows.withColumn("bucket", F.col("sub").bitwiseXOR(F.col("flip")))
    a, b = rows.alias("a"), rows.alias("b")

    def apart(t: int) -> Column:
        return F.bit_count(F.col(f"a.s{t}").bitwiseXOR(F.col(f"b.s{t}")))

    differ = F.col("a.sub").bitwiseXOR(F.col("b.sub"))
    lowest = differ.bitwiseAND(-differ)
    # of the buckets where a pair meets, the one reached by the lowest differing bit counts, in the first table that holds it
    once = F.col("a.flip") == F.when(F.bit_count(differ) == 2, lowest).otherwise(F.lit(0))
    first = F.lit(True)
    for t in range(tables - 1):
        first = first & ((F.col("a.t") <= t) | (apart(t) > 2))
    near = sum((apart(t) for t in range(1, tables)), apart(0)) <= radius
    met = a.join(
        b, (F.col("a.t") == F.col("b.t")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.vec_id") < F.col("b.vec_id"))
        & once & first & near,
    )
    return met.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"))


def _cosine(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def near_links(
    vectors: DataFrame, threshold: float = THRESHOLD, sample: int = FIT_SAMPLE, seed: int = 7, pick: str = "vec_id"
) -> DataFrame:
    """Links (a < b, cosine) found between the rows of ``vectors`` (vec_id, unit), all of one dimension.

    The sample goes by a hash of column ``pick``, which both ends bring along. Reads ``vectors`` several times: pass a checkpointed frame.
    """
    n = vectors.count()
    bits, tables, radius = table_plan(n, threshold)
    share = min(1.0, 1.2 * sample / max(n, 1))
    order = F.xxhash64(F.lit(seed), F.col(pick))
    picked = vectors.filter((F.pmod(order, F.lit(1_000_000)) / F.lit(1e6)) < share).orderBy(order, pick, "unit").limit(sample)
    fitted = np.array([r["unit"] for r in picked.select("unit").collect()], np.float64)
    if not len(fitted):
        return vectors.sparkSession.createDataFrame([], "a long, b long, cosine double, pick_a long, pick_b long")
    turns = [learn_rotation(fitted, seed + k) for k in range(math.ceil(bits * tables / fitted.shape[1]))]
    coded = checkpointed(codes(vectors, np.concatenate(turns, 1)[:, : bits * tables], bits, tables))
    pairs = checkpointed(candidates(coded, bits, tables, radius))
    left = vectors.select(F.col("vec_id").alias("a"), F.col("unit").alias("x"), F.col(pick).alias("pick_a"))
    right = vectors.select(F.col("vec_id").alias("b"), F.col("unit").alias("y"), F.col(pick).alias("pick_b"))
    got = pairs.join(left, "a").join(right, "b").select("a", "b", _cosine("x", "y").alias("cosine"), "pick_a", "pick_b")
    return got.filter(F.col("cosine") >= threshold)


def all_links(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a < b, and rep of both) between the rows of ``reps`` (vec_id, rep, dim, unit; checkpointed), for every dim present.

    Lengths with more than ``FEW`` vectors go through ``near_links`` one after the other, all
    others through one join by dim.
    """
    counts = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").collect()}
    many = sorted(d for d, n in counts.items() if n > FEW)
    links = reps.sparkSession.createDataFrame([], "a long, b long, rep_a long, rep_b long")
    for d in many:
        of = reps.filter(F.col("dim") == d).select("vec_id", "rep", "unit")
        links = links.union(near_links(of, threshold, pick="rep").select("a", "b", "pick_a", "pick_b"))
    if len(many) < len(counts):
        rare = reps.filter(~F.col("dim").isin(many)) if many else reps
        left = rare.select("dim", F.col("vec_id").alias("a"), F.col("unit").alias("x"), F.col("rep").alias("rep_a"))
        right = rare.select("dim", F.col("vec_id").alias("b"), F.col("unit").alias("y"), F.col("rep").alias("rep_b"))
        near = left.join(right, "dim").filter((F.col("a") < F.col("b")) & (_cosine("x", "y") >= threshold))
        links = links.union(near.select("a", "b", "rep_a", "rep_b"))
    return links


def near_duplicates(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Equal vectors are one class with one representative, so copies are never compared; a
    link between classes counts for all their members. Vectors of different lengths never
    link. Unusable vectors and null ids link with nothing and are kept (null id: null
    component). Rows that share an id are vectors of their own with equal ids, each of them
    with its class's counts; a component is named by its least id.
    """
    rows = checkpointed(unit_vectors(df, ident, vector))
    usable, rest = rows.filter("key IS NOT NULL"), rows.filter("key IS NULL")
    classes = usable.groupBy("key", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = checkpointed(classes.withColumn("class", F.monotonically_increasing_id()))  # fixed by the checkpoint
    reps = usable.join(classes.select("key", "class", F.col("rep").alias("vec_id")), ["key", "vec_id"]).dropDuplicates(["key"])
    reps = checkpointed(reps.select(F.col("class").alias("vec_id"), F.col("vec_id").alias("rep"), "dim", "unit"))
    links = checkpointed(all_links(reps, threshold))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("class").alias("b"), "size")
    across = both.join(sizes, "b").groupBy(F.col("a").alias("class")).agg(F.sum("size").alias("across"))
    # a node is (least id, class), so that the least node of a component has its least id
    node = lambda end: F.struct(F.col(f"rep_{end}").alias("rep"), F.col(end).alias("class")).alias(end)
    groups = components(links.select(node("a"), node("b"))).select("id.class", F.col("component.rep").alias("component_id"))
    per_class = classes.join(across, "class", "left").join(groups, "class", "left").select(
        "key", (F.col("size") - 1 + F.coalesce("across", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    out = usable.select("vec_id", "key").join(per_class, "key").select("vec_id", "n_links", "component_id")
    out = out.union(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def op2_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
