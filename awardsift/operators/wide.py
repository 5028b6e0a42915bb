"""Principal components and correlated pairs of very wide, mostly sparse feature vectors.

No matrix of features x features exists anywhere. Components come from randomised block subspace iteration (Halko,
Martinsson and Tropp, 2011): a block of a few directions is multiplied by the covariance again and again, with the
centring done implicitly, so zeros stay zeros. Correlated pairs are found from columns that share a row early
in a common order of rows: the products of these heads are added up, norms bound what the rest of two columns can add, and each pair that may
still pass is then computed exactly.

One pass over the rows multiplies a block. A block of at most ``BLOCK_BYTES`` is sent to the tasks; a larger one stays a
table and is joined, so the width has no limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint, measure, ship_package, store
from .vectors import parts

# Largest block of directions that is sent to every task, and that the driver holds.
BLOCK_BYTES = 64 * 1024 * 1024
# Directions beyond those asked for; they speed up convergence.
EXTRA = 10
# Eigenvalues below this part of the largest are taken for zero.
TINY = 1e-13
# Cells that are multiplied with a block at a time, if a row has no more.
SLICE = 1 << 17
# Columns that meet all others in one pass.
AT_ONCE = 32
BANDS = 16
# Bands of rows in which heads end, if their norms by column and band are sent to the tasks.
CUTS = 32
# Columns of a block; a task adds up the products of two blocks at a time, 4 bytes a pair, ``CHUNK`` products at a time.
TILE = 8192
CHUNK = 1 << 21


@dataclass
class Wide:
    """Stored vectors with the sums of their columns: ``rows`` (row, type, size, indices, values), ``columns`` (col, nnz, low, mean, var)."""

    rows: DataFrame
    columns: DataFrame
    n: int
    width: int
    limit: int = BLOCK_BYTES
    means: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def of(cls, df: DataFrame, features: str = "features", limit: int = BLOCK_BYTES) -> Wide:
        """Two passes: the rows are stored with a number each, then counted by column."""
        vector = parts(df, features)
        size = F.coalesce(vector["size"], F.size(vector["values"]))
        at = F.when(vector["type"] == 0, vector["indices"]).otherwise(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1))
        rows = store(df.where(vector.isNotNull()).select(
            F.monotonically_increasing_id().alias("row"), size.alias("size"), at.alias("at"), vector["values"].alias("x")))
        n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
        own = cls(rows, rows, n, width, limit)
        x = F.col("x")
        sums = own.cells().groupBy("col").agg(F.count(x).alias("nnz"), F.min(x).alias("low"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
        mean = F.col("s") / F.lit(float(max(n, 1)))
        square = F.col("q") / F.lit(float(max(n, 1)))
        var = square - mean * mean
        own.columns = store(sums.select("col", "nnz", "low", mean.alias("mean"), F.when(var > square * 1e-12, var).otherwise(0.0).alias("var")))
        return own

    def cells(self) -> DataFrame:
        """(row, col, x, filled) of all values that are not zero; ``filled`` counts the places of the row."""
        every = self.rows.select("row", F.size("at").alias("filled"), F.explode(F.arrays_zip("at", "x")).alias("c"))
        return every.select("row", F.col("c.at").alias("col"), F.col("c.x").alias("x"), "filled").where("x != 0")

    def fits(self, block: int) -> bool:
        return self.width * block * 8 <= self.limit

    def total(self) -> float:
        """Sum of the variances of all columns."""
        return (self.columns.agg(F.sum("var")).first()[0] or 0.0) * self.n / max(self.n - 1, 1)

    def dense_means(self) -> np.ndarray:
        if self.means is None:
            self.means = np.zeros(self.width)
            found = self.columns.select("col", "mean").toArrow()
            self.means[found["col"].to_numpy()] = found["mean"].to_numpy()
        return self.means

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance (over n - 1) times a block that fits: one pass, one row per task and column that it holds."""
        spark, width, block = self.rows.sparkSession, self.width, q.shape[1]
        ship_package(spark)
        shared = spark.sparkContext.broadcast((q, self.dense_means() @ q))
        kind = "col int, " + ", ".join(f"z{k} double" for k in range(block))
        sums = [F.sum(f"z{k}").alias(f"z{k}") for k in range(block)]
        found = self.rows.select("at", "x").mapInArrow(_products(shared, width), kind).groupBy("col").agg(*sums).toArrow()
        out = np.zeros_like(q)
        out[found["col"].to_numpy()] = np.column_stack([found[f"z{k}"].to_numpy() for k in range(block)])
        shared.destroy()
        return out / (self.n - 1)

    def times_table(self, q: DataFrame, block: int) -> DataFrame:
        """The same for a block (col, q0, q1, ...) of any width: joins on column, row and column again."""
        names = range(block)
        shift = self.columns.join(q, "col").agg(*[F.coalesce(F.sum(F.col("mean") * F.col(f"q{k}")), F.lit(0.0)).alias(f"s{k}") for k in names]).first()
        cells = self.cells().select("row", "col", "x")
        ahead = cells.join(q, "col").groupBy("row").agg(*[F.sum(F.col("x") * F.col(f"q{k}")).alias(f"y{k}") for k in names])
        back = cells.join(ahead, "row", "left").groupBy("col").agg(
            *[(F.sum(F.col("x") * (F.coalesce(f"y{k}", F.lit(0.0)) - F.lit(shift[k]))) / F.lit(self.n - 1.0)).alias(f"z{k}") for k in names])
        return store(back)


def _products(shared, width: int):
    """Sums of the rows' products by column. Rows go in slices of ``SLICE`` cells, whose directions are read and added up together."""
    def add(batches):
        q, shift = shared.value
        block = q.shape[1]
        total, touched = np.zeros((block, width)), np.zeros(width, bool)
        for batch in batches:
            at, values = batch.column(0), batch.column(1)
            counts = np.diff(at.offsets.to_numpy())
            counts = counts[counts > 0]
            cols, x = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.flatten().to_numpy(zero_copy_only=False)
            touched[cols] = True
            ends = np.cumsum(counts)
            k = 0
            while k < len(counts):
                start = ends[k] - counts[k]
                m = max(int(np.searchsorted(ends, start + SLICE, "right")), k + 1)
                own, c, v = counts[k:m], cols[start : ends[m - 1]], x[start : ends[m - 1]]
                part = q[c]
                part *= v[:, None]
                y = (np.add.reduceat(part, ends[k:m] - own - start, axis=0) - shift).T.copy()
                for j in range(block):
                    total[j] += np.bincount(c, np.repeat(y[j], own) * v, minlength=width)
                k = m
        found = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(total[k, found]) for k in range(block))],
                                         names=["col", *(f"z{k}" for k in range(block))])
    return add


@dataclass
class Components:
    """The first components: their variances, how far each may be off, the total variance, and ``axes`` (col, a0, a1, ...)."""

    variances: list[float]
    bounds: list[float]
    total: float
    axes: DataFrame


def _seeded(width: int, block: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, block))


def _whiten(gram: np.ndarray) -> np.ndarray:
    """The matrix T for which Z T has orthonormal columns, given Z'Z; directions without length are dropped."""
    values, vectors = np.linalg.eigh(gram)
    good = values > TINY * max(values.max(initial=0.0), 0.0)
    return (vectors[:, good] / np.sqrt(values[good]))[:, ::-1]


def _gram(left: DataFrame, a: str, b: str, rows: int, columns: int, symmetric: bool) -> np.ndarray:
    """Products of the columns a0.. and b0.. of a table, summed over its rows: one row of at most block * block numbers."""
    wanted = [(i, j) for i in range(rows) for j in range(columns) if not symmetric or i <= j]
    found = left.agg(*[F.coalesce(F.sum(F.col(f"{a}{i}") * F.col(f"{b}{j}")), F.lit(0.0)) for i, j in wanted]).first()
    out = np.zeros((rows, columns))
    for (i, j), value in zip(wanted, found):
        out[i, j] = value
        if symmetric:
            out[j, i] = value
    return out


def _turned(table: DataFrame, name: str, turn: np.ndarray, out: str) -> DataFrame:
    def mixed(k: int) -> Column:
        return sum((F.col(f"{name}{j}") * F.lit(float(turn[j, k])) for j in range(turn.shape[0])), F.lit(0.0))

    return table.select("col", *[mixed(k).alias(f"{out}{k}") for k in range(turn.shape[1])])


def components(data: Wide, k: int = 2, rounds: int = 200, tolerance: float = 1e-11, seed: int = 42) -> Components:
    """The first ``k`` principal components, or as many as there are.

    Rounds end when no variance moves by more than ``tolerance`` of the total, or after ``rounds``. ``bounds`` says how far each variance
    can be from a true one at most (the length of the residual); it is part of the result, so a slow case is seen.
    """
    total = data.total()
    block = min(k + EXTRA, data.width, max(data.n - 1, 0))
    if block < 1 or total <= 0:
        return Components([], [], total, data.rows.sparkSession.createDataFrame([], "col int"))
    return (_by_array if data.fits(block) else _by_table)(data, min(k, block), block, total, rounds, tolerance, seed)


def _settled(new: np.ndarray, old: np.ndarray | None, total: float, tolerance: float) -> bool:
    return old is not None and len(old) == len(new) and bool(np.all(np.abs(new - old) <= tolerance * total))


def _by_array(data: Wide, k: int, block: int, total: float, rounds: int, tolerance: float, seed: int) -> Components:
    q, old = np.linalg.qr(_seeded(data.width, block, seed))[0], None
    for _ in range(rounds):
        z = data.times(q)
        values, turn = np.linalg.eigh(q.T @ z)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        if _settled(values[:k], old, total, tolerance):
            break
        old = values[:k]
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        q = u[:, s > TINY * s[0]]
        k = min(k, q.shape[1])
    bounds = np.linalg.norm(z[:, :k] - q[:, :k] * values[:k], axis=0)
    used = np.flatnonzero(np.abs(q[:, :k]).max(axis=1) > 0)
    table = pa.table({"col": pa.array(used, pa.int32()), **{f"a{i}": q[used, i] for i in range(k)}})
    return Components(np.maximum(values[:k], 0).tolist(), bounds.tolist(), total, data.rows.sparkSession.createDataFrame(table))


def _by_table(data: Wide, k: int, block: int, total: float, rounds: int, tolerance: float, seed: int) -> Components:
    # the start is a row's share of a normal block, by hash, so it is the same everywhere
    def draw(j: int) -> Column:
        one, two = [(F.pmod(F.xxhash64("col", F.lit(seed), F.lit(j), F.lit(p)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1)) for p in (0, 1)]
        return F.sqrt(-2.0 * F.ln(one)) * F.cos(F.lit(2 * math.pi) * two)

    z, width = store(data.columns.select("col", *[draw(j).alias(f"z{j}") for j in range(block)])), block
    old = None
    for _ in range(rounds):
        for _ in range(2):  # twice, since the first time squares the condition
            turn = _whiten(_gram(z, "z", "z", width, width, True))
            width = turn.shape[1]
            z = store(_turned(z, "z", turn, "z"))
        q = z.select("col", *[F.col(f"z{j}").alias(f"q{j}") for j in range(width)])
        z = data.times_table(q, width)
        both = q.join(z, "col")
        inner = _gram(both, "q", "z", width, width, False)
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        k = min(k, width)
        if _settled(values[:k], old, total, tolerance):
            break
        old = values[:k]
    axes = store(_turned(q, "q", turn[:, :k], "a"))
    images = _turned(z, "z", turn[:, :k], "z")
    off = axes.join(images, "col").agg(*[F.sqrt(F.sum(F.pow(F.col(f"z{i}") - F.col(f"a{i}") * F.lit(float(values[i])), 2))) for i in range(k)]).first()
    return Components(np.maximum(values[:k], 0).tolist(), list(off), total, axes)


def variance(df: DataFrame, features: str = "features", k: int = 10, limit: int = BLOCK_BYTES) -> DataFrame:
    """component, variance_ratio, cumulative_ratio, components_for_95 (null if the first ``k`` do not reach it), error_bound.

    Empty when there are fewer than 2 rows or features, or all columns are constant.
    """
    data = Wide.of(df, features, limit)
    rows, running, reached = [], 0.0, None
    if data.n >= 2 and data.width >= 2:
        found = components(data, k)
        for i, (value, bound) in enumerate(zip(found.variances, found.bounds), 1):
            running += value / found.total
            reached = i if reached is None and running >= 0.95 else reached
            rows.append((i, value / found.total, running, bound / found.total))
    kind = "component int, variance_ratio double, cumulative_ratio double, error_bound double"
    return df.sparkSession.createDataFrame(rows, kind).withColumn("components_for_95", F.lit(reached).cast("int"))


def project(df: DataFrame, features: str = "features", k: int = 2, limit: int = BLOCK_BYTES) -> DataFrame:
    """Add pc1 ... pck, the coordinates of the centred vectors along the first components (signs are arbitrary)."""
    names = [f"pc{i + 1}" for i in range(k)]
    stored = store(df.withColumn("_id", F.monotonically_increasing_id()))
    data = Wide.of(stored, features, limit)
    found = components(data, k) if data.n >= 2 and data.width >= 2 else Components([], [], 0.0, None)
    have = len(found.variances)
    if not have:
        return df.withColumns({name: F.lit(None).cast("double") for name in names}).limit(0)
    axes = checkpoint(found.axes)
    centre = data.columns.join(broadcast_if_small(axes), "col").agg(*[F.sum(F.col("mean") * F.col(f"a{i}")) for i in range(have)]).first()
    vector = parts(stored, features)
    size = F.coalesce(vector["size"], F.size(vector["values"]))
    at = F.when(vector["type"] == 0, vector["indices"]).otherwise(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1))
    cells = stored.select("_id", F.explode(F.arrays_zip(at.alias("at"), vector["values"].alias("x"))).alias("c")).select("_id", F.col("c.at").alias("col"), F.col("c.x").alias("x"))
    placed = cells.join(broadcast_if_small(axes), "col").groupBy("_id").agg(*[F.sum(F.col("x") * F.col(f"a{i}")).alias(f"_y{i}") for i in range(have)])
    out = stored.join(placed, "_id", "left")
    return out.select(*[f"`{c}`" for c in df.columns], *[
        (F.coalesce(f"_y{i}", F.lit(0.0)) - F.lit(centre[i])).alias(names[i]) if i < have else F.lit(None).cast("double").alias(names[i]) for i in range(k)])


def correlated(df: DataFrame, features: str = "features", limit: float = 0.9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (i > j, r) of features with a Pearson correlation whose absolute value is above ``limit``; exact.

    Let m be a column's mean over its deviation. Columns with a negative value or m above a bound that depends on ``limit`` are *full*: at least
    a fixed share of their places is filled, so a row of average length allows only so many of them. They are multiplied with all columns, ``AT_ONCE``
    in a pass. The others never correlate below ``-limit``; above it the cosine of two of them, uncentred, is at least
    ``limit * cos(a) * cos(b) + sin(a) * sin(b)`` with m = tan(a), and the least value of this over all partners bounds the norm of
    what may follow the first row that they share (``_candidates``).
    """
    if not 0 < limit < 1:
        raise ValueError("the limit must be between 0 and 1")
    data = Wide.of(df, features, block_bytes)
    empty = df.sparkSession.createDataFrame([], "i int, j int, r double")
    if data.n < 2 or data.width < 2:
        return empty
    most = 0.99 * math.sqrt(limit)
    slope = F.abs("mean") / F.sqrt("var")
    varied = store(data.columns.where("var > 0").select("col", "nnz", "mean", F.sqrt("var").alias("dev"), ((F.col("low") < 0) | (slope > most)).alias("full"),
                                                        F.atan(slope).alias("angle")))
    pairs = _sparse_pairs(data, varied, limit)
    full = varied.where("full").select("col")
    # column numbers only, in passes: a thousand million of them would not fit, but neither would a row that fills half of its places
    for part in _in_turn(full):
        pairs = pairs.union(_full_pairs(data, varied, part, limit))
    return pairs


def _in_turn(full: DataFrame):
    """The numbers of the full columns, ``AT_ONCE`` at a time, fetched as they are needed."""
    batch: list[int] = []
    for row in full.orderBy("col").toLocalIterator():
        batch.append(row.col)
        if len(batch) == AT_ONCE:
            yield batch
            batch = []
    if batch:
        yield batch


def _full_pairs(data: Wide, varied: DataFrame, chosen: list[int], limit: float) -> DataFrame:
    """Pairs with one of the chosen columns: the covariance times unit vectors."""
    spark, block = data.rows.sparkSession, len(chosen)
    if data.fits(block):
        units = np.zeros((data.width, block))
        units[chosen, range(block)] = 1.0
        z = data.times(units)
        used = np.flatnonzero(np.abs(z).max(axis=1) > 0)
        table = checkpoint(spark.createDataFrame(pa.table({"col": pa.array(used, pa.int32()), **{f"z{k}": z[used, k] for k in range(block)}})))
    else:
        units = spark.createDataFrame([(c, *(1.0 if c == d else 0.0 for d in chosen)) for c in chosen], "col int, " + ", ".join(f"q{k} double" for k in range(block)))
        table = data.times_table(units, block)
    long = table.select("col", F.explode(F.array(*[F.struct(F.lit(c).alias("other"), F.col(f"z{k}").alias("z")) for k, c in enumerate(chosen)])).alias("p")).select("col", "p.*")
    own = varied.select("col", "dev", "full")
    theirs = F.broadcast(varied.where(F.col("col").isin(chosen)).select(F.col("col").alias("other"), F.col("dev").alias("dev2")))
    r = F.col("z") * F.lit((data.n - 1) / data.n) / (F.col("dev") * F.col("dev2"))
    # two full columns meet twice, in the passes of both
    met = long.join(own, "col").join(theirs, "other").where("col != other AND (NOT full OR col < other)").withColumn("r", r)
    return met.where(F.abs("r") > limit).select(F.greatest("col", "other").alias("i"), F.least("col", "other").alias("j"), "r")


def _bounds(varied: DataFrame, limit: float) -> DataFrame:
    """(col, nnz, angle, bound) of the sparse columns: the least cosine, uncentred, with which one can pass together with any other."""
    sparse = varied.where("NOT full")
    widest = sparse.agg(F.max("angle")).first()[0] or 0.0
    a, t = F.col("angle"), F.lit(limit)
    bound = F.least(t * F.cos(a), t * F.cos(a) * math.cos(widest) + F.sin(a) * math.sin(widest)) * (1 - 1e-9)
    return sparse.select("col", "nnz", "angle", bound.alias("bound"))


def _fine(filled: Column) -> Column:
    """Bands of rows: those with few filled places first, then by hash; ``BANDS`` for each doubling."""
    return (F.floor(F.log2(filled.cast("double"))) * BANDS + F.pmod(F.xxhash64("row"), F.lit(BANDS))).cast("int")


def _candidates(data: Wide, varied: DataFrame, limit: float) -> DataFrame:
    """(col, col2), col > col2: the pairs of sparse columns that may pass.

    Rows are ordered by bands. Two columns can only pass if the first band they share begins while both still have a norm of at least
    their bound, so both keep that band in their head. Up to the band that ends the shorter of both heads the product of the columns is that
    of the heads; what follows adds at most the product of the norms that are left.
    """
    own = _bounds(varied, limit)
    return (_by_tile if data.fits(CUTS) else _by_join)(data, own, limit)


def _by_join(data: Wide, own: DataFrame, limit: float) -> DataFrame:
    """Candidates of any width: heads are joined on the row. A band is summed before it is ordered: no task holds a column."""
    cells = data.cells().withColumn("band", _fine(F.col("filled")))
    lengths = cells.groupBy("col", "band").agg(F.sum(F.col("x") * F.col("x")).alias("q")).join(own, "col")
    per = lengths.groupBy("col", "bound", "angle").agg(F.sum("q").alias("all"), F.sort_array(F.collect_list(F.struct("band", "q"))).alias("bands"))
    # at most BANDS entries for each doubling of the width
    before = F.transform("bands", lambda b, k: F.struct(b["band"].alias("band"), F.aggregate(F.slice("bands", 1, k), F.lit(0.0), lambda s, c: s + c["q"]).alias("ahead")))
    kept = F.filter(before, lambda b: F.sqrt(F.greatest(1.0 - b["ahead"] / F.col("all"), F.lit(0.0))) >= F.col("bound"))
    per = store(per.withColumn("last", F.array_max(F.transform(kept, lambda b: b["band"]))))
    heads = store(cells.join(per.select("col", "last"), "col").where("band <= last").select("row", "col", "x"))
    met = heads.join(heads.select("row", F.col("col").alias("col2"), F.col("x").alias("x2")), "row").where("col > col2")
    dots = met.groupBy("col", "col2").agg(F.sum(F.col("x") * F.col("x2")).alias("dot"))
    one, two = [per.select(F.col("col").alias(f"col{c}" if c == 2 else "col"), *[F.col(n).alias(f"{n}{c}") for n in ("angle", "all", "bands", "last")]) for c in (1, 2)]

    def left(c: int) -> Column:
        ahead = F.aggregate(F.filter(f"bands{c}", lambda b: b["band"] <= F.least("last1", "last2")), F.lit(0.0), lambda s, b: s + b["q"])
        return F.sqrt(F.greatest(1.0 - ahead / F.col(f"all{c}"), F.lit(0.0)))

    least = F.lit(limit) * F.cos("angle1") * F.cos("angle2") + F.sin("angle1") * F.sin("angle2")
    return dots.join(one, "col").join(two, "col2").where(F.col("dot") / F.sqrt(F.col("all1") * F.col("all2")) + left(1) * left(2) >= least - 1e-9).select("col", "col2")


def _by_tile(data: Wide, own: DataFrame, limit: float) -> DataFrame:
    """Candidates if ``CUTS`` numbers a column fit: the products of two blocks of columns are added up in one task, and no pair is shuffled.

    Each cell of a head goes to as many tasks as there are blocks; the pairs that rows make are never written.
    """
    spark, width = data.rows.sparkSession, data.width
    ship_package(spark)
    rows = data.rows.where(F.size("at") > 0).withColumn("fine", _fine(F.size("at")))
    cut, ahead = {}, 0  # bands of about as many cells each; at most BANDS rows come here for each doubling of the width
    sizes = rows.groupBy("fine").agg(F.sum(F.size("at")).alias("cells")).orderBy("fine").collect()
    for fine, cells in sizes:
        cut[fine] = CUTS * ahead // sum(r.cells for r in sizes)
        ahead += cells
    if not cut:
        return spark.createDataFrame([], "col int, col2 int")
    rows = rows.select(F.element_at(F.create_map(*[F.lit(v) for item in cut.items() for v in item]), F.col("fine")).alias("band"), "at", "x")
    found = own.toArrow()
    at = found["col"].to_numpy()
    count, angle, bound = np.zeros(width), np.zeros(width), np.full(width, 2.0)
    count[at], angle[at], bound[at] = [found[c].to_numpy() for c in ("nnz", "angle", "bound")]
    sparse = count > 0
    shared = spark.sparkContext.broadcast(sparse)
    kind = "col int, " + ", ".join(f"e{k} double" for k in range(CUTS))
    sums = rows.mapInArrow(_energies(shared, width), kind).groupBy("col").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(CUTS)]).toArrow()
    upto = np.zeros((width, CUTS))
    upto[sums["col"].to_numpy()] = np.column_stack([sums[f"e{k}"].to_numpy() for k in range(CUTS)])
    shared.destroy()
    upto = np.cumsum(upto, axis=1)
    whole = np.where(sparse, upto[:, -1], 1.0)
    upto /= whole[:, None]
    left = np.sqrt(np.maximum(1 - np.column_stack((np.zeros(width), upto)), 0))
    last = (left[:, :-1] >= bound[:, None]).sum(axis=1) - 1
    norm = np.where(sparse, 1 / np.sqrt(whole), 0.0)
    shared = spark.sparkContext.broadcast((last.astype(np.int8), left[:, 1:].astype(np.float32), norm, np.cos(angle), np.sin(angle), count))
    blocks = -(-width // TILE)
    side = -(-width // blocks)
    sides = ", ".join(f"row{k} binary, at{k} binary, x{k} binary" for k in (1, 2))
    dealt = rows.mapInArrow(_deal(shared, blocks), f"tile int, {sides}")
    # several partitions a tile, since hashes collide
    tiles = dealt.repartition(2 * blocks * (blocks + 1), "tile").sortWithinPartitions("tile")
    return tiles.mapInArrow(_add_up(shared, blocks, side, limit), "col int, col2 int")


def _cells(at: pa.Array, x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(len(counts)), counts), at.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)


def _energies(shared, width: int):
    def add(batches):
        sparse, total = shared.value, np.zeros(width * CUTS)
        for batch in batches:
            row, cols, x = _cells(batch.column(1), batch.column(2))
            own = sparse[cols]
            np.add.at(total, cols[own].astype(np.int64) * CUTS + batch.column(0).to_numpy()[row[own]], x[own] * x[own])
        total = total.reshape(width, CUTS)
        found = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(total[found, k]) for k in range(CUTS))],
                                         names=["col", *(f"e{k}" for k in range(CUTS))])
    return add


def _deal(shared, blocks: int):
    """Cells of heads by tile: row numbers of the batch, places in the block and values of both blocks; a block with itself has one side."""
    def deal(batches):
        last = shared.value[0]
        for batch in batches:
            row, cols, x = _cells(batch.column(1), batch.column(2))
            kept = (x != 0) & (batch.column(0).to_numpy()[row] <= last[cols])
            row, cols, x = row[kept], cols[kept], x[kept]
            order = np.argsort(cols % blocks, kind="stable")  # blocks take columns in turn, so neighbours are spread
            cuts = np.searchsorted((cols % blocks)[order], np.arange(blocks + 1))
            parts = []
            for own in (order[s:e] for s, e in zip(cuts, cuts[1:])):
                parts.append((row[own].astype(np.int32).tobytes(), (cols[own] // blocks).astype(np.uint16).tobytes(), x[own].tobytes()) if len(own) else None)
            for p in range(blocks):
                met = [(p * blocks + q, *parts[p], *(parts[q] if p != q else (None,) * 3)) for q in range(p + 1) if parts[p] and parts[q]]
                if met:
                    tile, *sides = zip(*met)
                    yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), *(pa.array(s, pa.binary()) for s in sides)],
                                                     names=["tile", *(f"{n}{k}" for k in (1, 2) for n in ("row", "at", "x"))])
    return deal


def _add_up(shared, blocks: int, side: int, limit: float):
    """The pairs of a tile that may pass; rows come sorted by tile. Only products of cells that share a row are computed."""
    def add(batches):
        tile, total = None, np.zeros(side * side, np.float32)
        norm = shared.value[2]
        for batch in batches:
            for own, *sides in zip(*(c.to_pylist() for c in batch.columns)):
                if own != tile:
                    if tile is not None:
                        yield from _passing(total, shared.value, tile, blocks, side, limit)
                        total[:] = 0
                    tile = own
                p, q = divmod(tile, blocks)
                both = sides[:3], sides[3:] if p != q else sides[:3]
                (row, at, x), (row2, at2, x2) = [[np.frombuffer(v, t) for v, t in zip(s, (np.int32, np.uint16, np.float64))] for s in both]
                x, x2 = x * norm[at.astype(np.int64) * blocks + p], x2 * norm[at2.astype(np.int64) * blocks + q]
                begin, end = np.searchsorted(row2, row, "left"), np.searchsorted(row2, row, "right")
                if p == q:  # each pair of a row once
                    end = np.arange(len(row))
                ahead = np.concatenate(([0], np.cumsum(end - begin)))
                k = 0
                while k < len(row):
                    m = max(int(np.searchsorted(ahead, ahead[k] + CHUNK, "right")) - 1, k + 1)
                    size = end[k:m] - begin[k:m]
                    one = np.repeat(np.arange(k, m), size)
                    two = np.arange(len(one)) + np.repeat(begin[k:m] - (ahead[k:m] - ahead[k]), size)
                    high, low = at[one].astype(np.int64), at2[two].astype(np.int64)
                    if p == q:
                        high, low = np.maximum(high, low), np.minimum(high, low)
                    np.add.at(total, high * side + low, (x[one] * x2[two]).astype(np.float32))
                    k = m
        if tile is not None:
            yield from _passing(total, shared.value, tile, blocks, side, limit)
    return add


def _passing(total: np.ndarray, shared: tuple, tile: int, blocks: int, side: int, limit: float):
    last, left, _, cos, sin, count = shared
    p, q = divmod(tile, blocks)
    for start in range(0, side * side, CHUNK):
        found = np.flatnonzero(total[start : start + CHUNK]) + start
        col, col2 = found // side * blocks + p, found % side * blocks + q
        until = np.minimum(last[col], last[col2])
        # a sum of that many products in single precision is off by 2 ** -24 a step at most
        slack = 1e-5 + 2.0**-24 * np.minimum(count[col], count[col2])
        may = total[found] + left[col, until].astype(float) * left[col2, until] + slack >= limit * cos[col] * cos[col2] + sin[col] * sin[col2]
        col, col2 = col[may], col2[may]
        if len(col):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(col, col2), pa.int32()), pa.array(np.minimum(col, col2), pa.int32())], names=["col", "col2"])


def _sparse_pairs(data: Wide, varied: DataFrame, limit: float) -> DataFrame:
    own, theirs = [varied.select(F.col("col").alias(c), F.col("mean").alias(m), F.col("dev").alias(d))
                   for c, m, d in (("col", "m1", "d1"), ("col2", "m2", "d2"))]
    candidates = store(_candidates(data, varied, limit))
    size = measure(candidates)
    met = broadcast_if_small(candidates, size)
    wanted = broadcast_if_small(candidates.select(F.explode(F.array("col", "col2")).alias("col")).distinct(), size)
    cells = data.cells().select("row", "col", "x").join(wanted, "col", "left_semi")
    sums = (cells.join(met, "col").join(cells.select("row", F.col("col").alias("col2"), F.col("x").alias("x2")), ["row", "col2"])
            .groupBy("col", "col2").agg(F.sum(F.col("x") * F.col("x2")).alias("dot")))
    r = (F.col("dot") / F.lit(float(data.n)) - F.col("m1") * F.col("m2")) / (F.col("d1") * F.col("d2"))
    return sums.join(own, "col").join(theirs, "col2").withColumn("r", r).where(F.col("r") > limit).select(F.col("col").alias("i"), F.col("col2").alias("j"), "r")
