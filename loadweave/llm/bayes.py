"""Quality by hierarchical empirical Bayes: document, path and host evidence.

The document classifier of quality.py gives each document a calibrated probability. Hosts and the
paths below them get posterior means: a path's share is shrunk toward its host's, a host's toward
the global share, by prior strengths estimated from the spread between the groups of a parent (method of
moments). A document's own evidence is left out of its groups' posteriors; its posterior log-odds
are those of its path plus its own, which weigh n / (n + SHORT) for n words. So a single-document site
falls back to the global share, and a few words don't condemn a document.
All group sums are aggregations; groups meet documents in joins that carry no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality import Model, document_evidence

REJECT_BELOW = 0.5
FLOOR = 1e-6
EVIDENCE = 12.0  # bound on a document's own log-odds, beyond which the classifier isn't calibrated
TILT = 3.0  # bound on the log-odds of the site
SHORT = 8.0  # words at which a document's own evidence weighs half


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), p))
    return F.log(q / (1 - q))


def strength(groups: DataFrame) -> float:
    """Prior strength (pseudo-documents) of groups (n, s, q: number, sum and sum of squares of p; parent_n, parent_s): the
    variance of p inside groups over that between the groups of a parent, beyond what sampling
    gives (method of moments; the credibility ratio of Buehlmann and Straub). One global aggregation;
    between 1 and 10 000, and 20 where no parent has two groups."""
    n, s = F.col("n"), F.col("s")
    own = F.try_divide(n, F.col("parent_n"))  # sums to 1 over a parent's groups
    r = groups.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("q") - s * s / n).alias("inside"),
        F.sum(n * (s / n - F.try_divide("parent_s", "parent_n")) ** 2).alias("spread"),
        F.sum(n * own).alias("n2"),
        F.sum(own).alias("parents"),
    ).first()
    if not r["k"] or r["k"] - r["parents"] < 0.5 or r["n"] <= r["k"]:
        return 20.0
    within = max(0.0, r["inside"]) / (r["n"] - r["k"])
    between = (r["spread"] - (r["k"] - r["parents"]) * within) / (r["n"] - r["n2"])
    return float(min(10_000.0, max(1.0, within / between))) if between > 0 else 10_000.0


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(..., host, path, p, n_words) -> adds global_share, host_posterior, path_posterior and posterior."""
    total = evidence.agg(F.count("*"), F.coalesce(F.sum("p"), F.lit(0.0))).first()
    mean = float(min(1 - FLOOR, max(FLOOR, total[1] / total[0]))) if total[0] else 0.5
    paths = materialize(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    parent = hosts.select(F.col("host").alias("h_host"), F.col("n").alias("parent_n"), F.col("s").alias("parent_s"))
    host_k = strength(hosts.select("*", F.lit(total[0]).alias("parent_n"), F.lit(total[1]).alias("parent_s")))
    path_k = strength(paths.join(parent, F.col("host").eqNullSafe(F.col("h_host"))))
    h = hosts.select(F.col("host").alias("h_host"), F.col("n").alias("h_n"), F.col("s").alias("h_s"))
    groups = paths.join(h, F.col("host").eqNullSafe(F.col("h_host"))).select(
        F.col("host").alias("g_host"), F.col("path").alias("g_path"), F.col("n").alias("g_n"), F.col("s").alias("g_s"), "h_n", "h_s"
    )
    met = evidence.join(groups, F.col("host").eqNullSafe(F.col("g_host")) & F.col("path").eqNullSafe(F.col("g_path")))
    host_post = (F.col("h_s") - F.col("p") + host_k * mean) / (F.col("h_n") - 1 + host_k)
    met = met.withColumn("host_posterior", host_post)
    path_post = (F.col("g_s") - F.col("p") + path_k * F.col("host_posterior")) / (F.col("g_n") - 1 + path_k)
    met = met.withColumn("path_posterior", path_post)
    site = F.greatest(F.lit(-TILT), F.least(F.lit(TILT), _logit(F.col("path_posterior"))))
    own = F.greatest(F.lit(-EVIDENCE), F.least(F.lit(EVIDENCE), _logit(F.col("p")))) * F.col("n_words") / (F.col("n_words") + SHORT)
    return met.select(
        *evidence.columns, F.lit(mean).alias("global_share"), "host_posterior", "path_posterior", (1 / (1 + F.exp(-(own + site)))).alias("posterior")
    )


def classify(docs: DataFrame, model: Model, host: Column | None = None, path: Column | None = None, reject_below: float = REJECT_BELOW) -> DataFrame:
    """One row per row of docs(doc_id, text, source, lang, ...): doc_id, host, path, p, n_words,
    host_posterior, path_posterior, posterior, kept (posterior >= reject_below).

    host and path default to source and lang: documents without a URL have no finer site. A null
    host or path is a group of its own. Null text is empty and judged by its site alone.
    Null or repeated doc_ids are rows like others; an empty table gives no rows."""
    named = docs.select(
        "doc_id", "text", (F.col("source") if host is None else host).cast("string").alias("host"), (F.col("lang") if path is None else path).cast("string").alias("path")
    )
    evidence = materialize(document_evidence(named, model, "doc_id", "host", "path"))
    return site_posteriors(evidence).withColumn("kept", F.col("posterior") >= reject_below)


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the documents that classify() rejects. A doc_id goes if any of its rows is
    rejected; rows with a null doc_id stay."""
    gone = classify(docs, model).where(~F.col("kept")).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
