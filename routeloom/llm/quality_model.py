"""Quality classifier: document evidence combined with what is known of its site, by hierarchical empirical Bayes.

A logistic model of counts of words, symbols and repetition, fitted to at most ``fit_rows`` labelled documents, gives
each document a probability.  These are summed per host and per path.  A host's rate is drawn to the global one, and a
path's to its host's, as if by a number of further documents that follows from how much rates differ between sites
beyond what the sites' sizes explain: sparse sites say little, large ones much.  A document's odds are then its own
evidence (its odds over those of the corpus) times the odds of its path, in which it does not count itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, kept, map_batches, record, text_of
from .quality_rules import base_counts, some_of
from .words import Words, repeated, words

_LARGEST = 1e6  # further documents at most: sites that do not differ
_NAMES = ["words", "word_chars", "symbols", "repeats", "dup_lines", "same_as_before", "digits", "upper", "stops", "again"]


def features(w: Words) -> np.ndarray:
    """A row of shares and means per text."""
    base = base_counts(w)
    n = np.maximum(base["n_words"], 1)
    chars = np.maximum(base["word_chars"], 1)
    after = np.flatnonzero((w.text[1:] == w.text[:-1]) & (w.hash[1:] == w.hash[:-1])) + 1
    again = repeated(w.text, w.hash)[1]
    d = w.data
    lines = w.count_bytes(d == 10) + 1
    columns = [
        np.log1p(base["n_words"]),
        np.log(chars / n),
        np.log1p(10 * base["n_symbols"] / n),
        base["n_repeat_words"] / n,
        base["n_dup_lines"] / lines,
        w.per_text(w.text[after]) / n,
        w.count_bytes((d >= 48) & (d <= 57)) / chars,
        w.count_bytes((d >= 65) & (d <= 90)) / chars,
        w.count_bytes((d == 46) | (d == 44)) / n,
        w.per_text(w.text[again]) / n,
    ]
    return np.stack(columns, axis=1)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the constant first) of a logistic model with a small quadratic penalty, by Newton steps.

    If only one outcome is there, all weights are zero but the constant.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(_NAMES)), np.ones(len(_NAMES)))
    weights = np.zeros(len(_NAMES) + 1)
    rate = (y.sum() + 1) / (len(y) + 2)
    weights[0] = np.log(rate / (1 - rate))
    if 0 < y.sum() < len(y):
        z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
        penalty = np.diag([1e-6] + [1.0] * len(_NAMES))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ weights)
            weights += step
            if abs(step).max() < 1e-6:
                break
    return mean, scale, weights


def train(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fits on about ``fit_rows`` labelled documents at most, chosen by a hash of their id; conflicting labels count as bad."""
    of = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    of = some_of(of, fit_rows)

    def work(batches: Batches) -> Batches:
        for batch in batches:
            rows = features(words(batch.column(1)))
            yield record(y=batch.column(0), x=pa.array(rows.tolist(), pa.list_(pa.float64())))

    labelled = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(of), "doc_id").select(F.col("quality").cast("double").alias("y"), "text")
    rows = map_batches(labelled, work, "y double, x array<double>").toArrow()  # fit_rows rows of ten numbers
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(_NAMES))
    return fit(x, rows["y"].to_numpy().astype(float))


def documents_scored(docs: DataFrame, model: tuple, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, text_sha256, p): each document by itself."""
    mean, scale, weights = model

    def work(batches: Batches) -> Batches:
        for batch in batches:
            z = (features(words(batch.column(4))) - mean) / scale
            logit = np.clip(weights[0] + z @ weights[1:], -12, 12)
            yield record(doc_id=batch.column(0), host=batch.column(1), path=batch.column(2), text_sha256=batch.column(3), p=1 / (1 + np.exp(-logit)))

    text = text_of()
    part = F.coalesce(host.cast("string"), F.lit("")), F.coalesce(path.cast("string"), F.lit(""))
    prepared = docs.select("doc_id", part[0].alias("host"), part[1].alias("path"), F.sha2(text, 256).alias("text_sha256"), text.alias("text"))
    return map_batches(prepared, work, "doc_id bigint, host string, path string, text_sha256 string, p double")


def strength(sites: DataFrame, within: float) -> float:
    """How many documents' weight the rate above a site has; ``sites`` has n, s (sum of p) and rate (the one above).

    From the variance of sites' means about the rate above, less what their sizes explain.
    """
    r = sites.agg(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("rate")) ** 2).alias("q"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") ** 2).alias("n2"),
        F.avg(F.col("rate") * (1 - F.col("rate"))).alias("v"),
    ).first()
    if not r.n or r.k < 2 or r.n - r.n2 / r.n <= 0:
        return _LARGEST
    between = (r.q - (r.k - 1) * within) / (r.n - r.n2 / r.n)
    return float(min(_LARGEST, max(1.0, r.v / between - 1))) if between > 0 else _LARGEST


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, text_sha256, host, path, p_document, p_site, score, kept (score at least one half) of every row.

    The host is ``source`` and the path within it ``lang`` unless given; for tables with URLs see ``site_of``.  Null
    hosts and paths are one site named by the empty text; null text is judged as the empty text.  Repeated rows count
    each.  Without labels every document gets probability one half and is kept.  No rows give no rows.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    scored = kept(documents_scored(docs, train(docs, labels, fit_rows), host, path), "scored")
    n, s = F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")
    paths = kept(scored.groupBy("host", "path").agg(n, s, F.sum(F.col("p") ** 2).alias("s2")), "sites")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") ** 2 / F.col("n")).alias("between")).first()
    if not whole.n:
        whole_rate, within = 0.5, 0.25
    else:
        whole_rate, within = whole.s / whole.n, max(1e-9, (whole.s2 - whole.between) / max(1, whole.n - whole.k))
    rate = F.lit(whole_rate)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    m_host = strength(hosts.withColumn("rate", rate), within)
    host_rate = (F.col("host_s") + m_host * rate) / (F.col("host_n") + m_host)
    sites = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    m_path = strength(sites.withColumn("rate", host_rate), within)

    p = F.col("p")
    joined = scored.join(sites.drop("s2"), ["host", "path"])  # one row per site on the right: a hot site's rows can be split
    above = (F.col("host_s") - p + m_host * rate) / (F.col("host_n") - 1 + m_host)
    site = (F.col("s") - p + m_path * above) / (F.col("n") - 1 + m_path)
    odds = p / (1 - p) * (1 - rate) / rate * F.col("p_site") / (1 - F.col("p_site"))
    found = joined.withColumn("p_site", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), site))).withColumn("score", odds / (1 + odds))
    return found.select("doc_id", "text_sha256", "host", "path", p.alias("p_document"), "p_site", "score", (F.col("score") >= 0.5).alias("kept"))


def site_of(url: str) -> tuple[Column, Column]:
    """Host and first path segment of a URL column."""
    return F.lower(F.parse_url(F.col(url), F.lit("HOST"))), F.regexp_extract(F.parse_url(F.col(url), F.lit("PATH")), "^/([^/]*)", 1)
