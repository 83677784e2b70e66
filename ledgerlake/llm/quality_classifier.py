"""Quality classifier: kernel ridge regression by random Fourier features, isotonically calibrated.

Shape statistics of the whole text (``textstats.FEATURES``) are standardised, clipped and mapped to
``D`` cosines with Gaussian frequencies, whose inner products approximate a Gaussian kernel. Each
partition of the fitting rows adds up its normal equations, as it lies; a tree adds ``PARTS`` sums to one until the
driver adds the last ``PARTS`` matrices of D + 1 rows, whatever the number of rows. Ridge scores of rows kept apart from
the fit are then counted in ``CELLS`` cells, and pooling adjacent violators over those counts turns
a score into the share of label 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import small_batches, staged, text_or_empty
from ledgerlake.llm.textstats import FEATURES, features

D, WIDTH, RIDGE, CLIP = 256, 3.0, 1e-3, 6.0
PARTS, CELLS = 32, 1000


def text_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _x) with the feature array of every whole text; null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_t"))
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["_id", "_x"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _x array<double>")


class Fourier:
    """The feature map: standardise, clip, project, cosine; the last column is the constant."""

    def __init__(self, mean, spread, seed: int):
        import numpy as np
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.asarray(mean, float), np.asarray(spread, float)
        self.frequency = rng.normal(size=(len(self.mean), D)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, D)

    def __call__(self, x):
        import numpy as np
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        return np.hstack([np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / D), np.ones((len(x), 1))])


def _equations(rows: DataFrame, fourier: Fourier):
    """Sums of z z' and z y over all rows, added up by partition."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        total = np.zeros((D + 1, D + 2))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
            if len(x):
                z = fourier(x)
                total += z.T @ np.hstack([z, batch.column(1).to_numpy(zero_copy_only=False).reshape(-1, 1)])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["_g", "total"])

    def add(key, parts):
        import numpy as np
        import pandas as pd
        total = sum(np.frombuffer(t) for t in parts.sort_values("_at")["total"])
        return pd.DataFrame({"_g": [key[0]], "total": [total.tobytes()]})

    sums = staged(rows.select("_x", "_y").mapInArrow(run, "_g bigint, total binary"), "quality-sums")
    while sums.count() > PARTS:  # a tree of sums, PARTS at a time
        grouped = sums.withColumn("_at", F.col("_g")).withColumn("_g", F.call_function("div", F.col("_g"), F.lit(PARTS)))
        sums = staged(grouped.groupBy("_g").applyInPandas(add, "_g bigint, total binary"), "quality-sums")
    total = sum(np.frombuffer(r["total"]).reshape(D + 1, D + 2) for r in sums.orderBy("_g").collect())
    return total[:, :-1], total[:, -1]


def pool_adjacent(values, weights):
    """Isotonic (non-decreasing) weighted fit of ``values``."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [v for v, _, n in blocks for _ in range(n)]


class Model:
    """Ridge weights and the calibration as knots (cell middles and their shares)."""

    def __init__(self, fourier=None, weights=None, constant: float = 0.5):
        self.fourier, self.weights, self.constant, self.knots = fourier, weights, constant, None

    def raw(self, x):
        import numpy as np
        if self.weights is None:
            return np.full(len(x), self.constant)
        return np.clip(self.fourier(x) @ self.weights, 0.0, 1.0)

    def score(self, x):
        import numpy as np
        s = self.raw(x)
        return s if self.knots is None else np.interp(s, *self.knots)


def fit(rows: DataFrame, calibrate, seed: int = 0) -> Model:
    """Fit on (_id, _x, _y) rows; those for which the column expression ``calibrate`` holds only calibrate.

    No fitting rows, or one label only, give a constant model.
    """
    import numpy as np
    train, apart = rows.where(~calibrate), rows.where(calibrate)
    moments = train.select("_y", *[F.col("_x")[i].alias(f"x{i}") for i in range(len(FEATURES))]).agg(
        F.count(F.lit(1)), F.sum("_y"), *[f(f"x{i}") for i in range(len(FEATURES)) for f in (F.avg, F.stddev_pop)]).first()
    n, ones = moments[0], moments[1] or 0
    if not 0 < ones < n:
        return Model(constant=0.5 if not n else float(ones) / n)
    fourier = Fourier(moments[2::2], [max(s, 1e-3) for s in moments[3::2]], seed)
    a, b = _equations(train, fourier)
    model = Model(fourier, np.linalg.solve(a + RIDGE * n * np.eye(D + 1), b))
    raw = _apply(apart, model.raw, "_y double")
    cell = F.least(F.floor(F.col("_score") * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = sorted((r[0], r[1], r[2]) for r in raw.groupBy(cell.alias("_c")).agg(F.sum("_y"), F.count(F.lit(1))).collect())
    if cells:
        # half a row of each label at either end keeps shares off 0 and 1 where few rows calibrate
        shares = pool_adjacent([(y + 0.5 * ones / n) / (k + 0.5) for _, y, k in cells], [k for _, _, k in cells])
        model.knots = ([(c + 0.5) / CELLS for c, _, _ in cells], shares)
    return model


def _apply(rows: DataFrame, function, keep: str) -> DataFrame:
    """The columns that ``keep`` names (with types) and ``_score``, by Arrow batches."""
    names = [k.split()[0] for k in keep.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
            score = function(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], names=[*names, "_score"])

    return rows.select("_x", *names).mapInArrow(run, f"{keep}, _score double")


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = 0.3, seed: int = 0) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted.

    Only labels of documents whose ``remainder`` is not 0 are learnt: remainder 1 calibrates, the
    others fit. Scores rest on the text alone. Null and empty texts are scored like others; null
    labels are no labels; a document labelled twice counts twice. Without usable labels all scores
    are equal. An empty table gives no rows. Other columns are ignored.
    """
    rows = staged(text_features(docs, id_col, text_col), "quality-features")
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_l"), F.col(label_col).cast("double").alias("_y"))
    learnt = rows.join(known, F.col("_id") == F.col("_l")).where(remainder(F.col("_id")) != 0).select("_id", "_x", "_y")
    learnt = staged(learnt, "quality-labelled")
    model = fit(learnt, remainder(F.col("_id")) == 1, seed)
    scored = _apply(rows, model.score, f"_id {rows.schema['_id'].dataType.simpleString()}")
    return scored.select(F.col("_id").alias(id_col), (remainder(F.col("_id")) == 0).alias("held_out"),
                         F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
