"""Quality classifier with hierarchical empirical Bayes: document evidence plus shrunken host and path posteriors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from orrery.llm.common import cut, table

SAMPLE_ROWS = 20_000  # labelled rows that the document classifier is fitted on, at most
CLIP = 8.0  # standardised features count up to here, in fitting and in scoring
ASCII_UPPER, LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS, SPACES = b"0123456789", b" \t\n\r\x0b\x0c"
NAMES = ["log_words", "distinct", "repeats", "upper", "symbols", "digits", "pipes", "marks", "stops", "word_len", "long_words", "no_words"]


def features(text: str | None) -> list[float]:
    """Surface measures of a whole text (null: empty), each of bounded size."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    kept = lambda drop: len(data.translate(None, drop))
    letters = size - kept(LETTERS)
    spaces, digits = size - kept(SPACES), size - kept(DIGITS)
    odd = size - letters - spaces - digits
    same = sum(map(bytes.__eq__, words, words[1:]))
    marks = sum(map(data.count, (b"!", b"?")))
    plain = sum(map(data.count, (b".", b",", b"'", b"-", b"|"))) + marks
    return [
        float(np.log1p(n)), len(set(words)) / n**0.75, same / n, (size - kept(ASCII_UPPER)) / max(1, letters), max(0, odd - plain) / n, digits / n,
        data.count(b"|") / n, marks / n, data.count(b".") / n, min(20.0, letters / n), sum(len(w) > 25 for w in words) / n, 0.0,
    ]


def features_column(text: Column) -> Column:
    @F.arrow_udf(ArrayType(DoubleType()))
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return of(text)


@dataclass
class Model:
    mean: list[float]
    scale: list[float]
    weight: list[float]  # intercept first
    base: float  # share of good rows in the sample

    def log_odds(self, x: Column) -> Column:
        """Log odds of being good, beyond the base rate."""
        each = [F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(w).alias("w")) for m, s, w in zip(self.mean, self.scale, self.weight[1:], strict=True)]
        terms = F.zip_with(x, F.array(*each), lambda v, q: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (v - q["m"]) / q["s"])) * q["w"])
        return F.aggregate(terms, F.lit(self.weight[0] - float(np.log(self.base / (1 - self.base)))), lambda s, t: s + t)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Model:
    """Ridge logistic regression by Newton steps. Labels of one kind only (or none) give a model without evidence."""
    base = float((y.sum() + 0.5) / (len(y) + 1))
    if len(y) == 0 or y.min() == y.max():
        return Model([0.0] * len(NAMES), [1.0] * len(NAMES), [float(np.log(base / (1 - base)))] + [0.0] * len(NAMES), base)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -CLIP, CLIP)])
    w, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean.tolist(), scale.tolist(), w.tolist(), base)


def _rate(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), c))))


def site_posteriors(rows: DataFrame, base: float) -> DataFrame:
    """(host, path, s, n, hs, hn, a, b, mu, host_rate, path_rate) from rows(host, path, p): p is a row's chance of being good.

    A host's rate is shrunk to the global rate mu, a path's to its host's, by prior weights a and b that the method of
    moments takes from the spread of the rates between sites: few rows leave a site at its parent's rate.
    """
    paths = cut(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    total = hosts.select(F.sum("hs"), F.sum("hn")).first()
    mu = min(0.999, max(0.001, (total[0] or 0.0) / total[1] if total[1] else base))

    def weight(df: DataFrame, s: str, n: str, centre: Column) -> float:
        """Beta prior weight: between-site variance of the rates, less what sampling alone gives."""
        c, k = df.select(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - centre, 2)).alias("v"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k")).select(F.col("v") / F.col("n"), F.col("n") / F.col("k")).first()
        between = max(1e-6, (c or 0.0) - mu * (1 - mu) / max(1.0, k or 1.0))
        return float(min(1e5, max(1.0, mu * (1 - mu) / between - 1)))

    a = weight(hosts, "hs", "hn", F.lit(mu))
    hosts = hosts.withColumn("host_rate", (F.col("hs") + a * mu) / (F.col("hn") + a))
    both = paths.join(hosts, "host")
    b = weight(both, "s", "n", F.col("host_rate"))
    rate = (F.col("s") + b * F.col("host_rate")) / (F.col("n") + b)
    return cut(both.select("host", "path", "s", "n", "hs", "hn", F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(mu).alias("mu"), "host_rate", rate.alias("path_rate")), "quality-sites")


def _sample(known: DataFrame, rows: int) -> DataFrame:
    """At most so many rows of known(doc_id, ...), the smallest by a hash of doc_id; no task sends on much more than its share."""
    n, h = known.count(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if n > rows:
        known = known.filter(h < int((1 << 30) * min(1.0, 1.2 * rows / n)) + 1)
    return known.orderBy(h, "doc_id").limit(rows)


NEW = ["evidence", "host_rate", "path_rate", "quality", "keep"]


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS, with_text: bool = True) -> DataFrame:
    """docs plus evidence (log odds from the text), host_rate, path_rate, quality (posterior chance) and keep.

    The classifier is fitted on at most sample_rows labelled rows (the smallest by a hash of doc_id); the site
    rates come from all rows, for each row from all others, so that its own text counts once. Texts are measured once and
    written with their rows (without the text column, if with_text is false), whatever their length. Null texts count
    as empty, null hosts and paths as empty names; labels with null doc_id or quality are ignored, repeated ones
    averaged. Repeated rows each count. No usable labels: the evidence is 0, all rows stay. No rows: no rows.
    Columns of docs that have one of the new names are replaced; others may have any name.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    carried = [c for c in docs.columns if c not in NEW and (with_text or c != "text")]
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), name(host).alias("host"), name(path).alias("path"), features_column(F.col("text").cast("string")).alias("x"))
    seen = cut(seen, "quality-features")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    labelled = cut(seen.select("doc_id", "x").join(known, "doc_id"), "quality-labelled")
    sample = _sample(labelled, sample_rows).select("x", "y").toPandas()
    model = fit(np.array(sample["x"].tolist(), float).reshape(-1, len(NAMES)), (sample["y"].to_numpy(float) > 0.5).astype(float))
    logit = float(np.log(model.base / (1 - model.base)))
    evidence = model.log_odds(F.col("x"))
    sites = site_posteriors(seen.select("host", "path", _rate(evidence + logit).alias("p")), model.base)
    out = seen.join(sites.drop("host_rate", "path_rate"), ["host", "path"]).withColumn("evidence", evidence).withColumn("p", _rate(F.col("evidence") + logit))
    out = out.withColumn("host_rate", (F.col("hs") - F.col("p") + F.col("a") * F.col("mu")) / (F.col("hn") - 1 + F.col("a")))
    out = out.withColumn("path_rate", (F.col("s") - F.col("p") + F.col("b") * F.col("host_rate")) / (F.col("n") - 1 + F.col("b")))
    rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_rate")))
    out = out.withColumn("quality", _rate(F.col("evidence") + F.log(rate / (1 - rate)))).withColumn("keep", F.col("quality") >= threshold)
    return out.select(*[F.col("row").getField(c).alias(c) for c in carried], *NEW)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_text=False)
    return out.select("doc_id", "source", "lang", "evidence", "host_rate", "path_rate", "quality", "keep")
