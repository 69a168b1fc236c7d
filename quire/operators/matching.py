"""Templates of whole jobs in two passes: strict, then, for jobs without a match and with a payer's hint, a wider one.

pages: job_id, page_number, hash, payer_hint. samples: sample_id, version_id, payer, hash, phash_threshold, min_score,
orb_min_matches. orb: job_id, page_number, sample_id, orb_score and inliers, from the feature matcher; a pair that is not
there has no features and no match.

Each different hash of pages is compared once with the samples of its payer, block by block, and keeps its nearest ones only;
pages of jobs that match strictly never meet the wider pass. Null hashes match nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.blocks import arrow, in_blocks, near_hashes
from quire.operators.search import BLOCK, match_score
from quire.sources.scratch import stored

#: Best pairs of a job that are looked at.
TOP = 8
#: How much wider hashes are compared in the second pass, how many more inliers it takes, and how much higher a score.
WIDER, STRICTER, BOOST = 2.5, 1.5, 0.05


def _compared(most: int):
    def compare(samples: pa.Table, pages: pa.Table) -> pa.Table:
        """Of each page's hash the first ``TOP`` samples of a block by distance, then by id."""
        samples = samples.sort_by("sample_id")
        ids, h, limit = (samples.column(c).to_numpy() for c in ("sample_id", "hash", "limit"))
        q = pages.column("hash").to_numpy()
        key, found = pages.column("part").combine_chunks(), []
        for i, j, apart in near_hashes(q, h, most):
            keep = apart <= limit[j]
            i, j, apart = i[keep], j[keep], apart[keep]
            order = np.lexsort((j, apart, i))
            i, j, apart = i[order], j[order], apart[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < TOP
            found.append((i[first], ids[j[first]], apart[first]))
        out = arrow(found, ["i", "sample_id", "distance"], [pa.int64(), pa.int64(), pa.int32()])
        i = out.column("i").to_numpy()
        return pa.table({"part": key.take(pa.array(i)), "hash": pa.array(q[i], pa.int64()), "sample_id": out.column("sample_id"), "distance": out.column("distance")})

    return compare


def _nearest(pages: DataFrame, samples: DataFrame, most: int) -> DataFrame:
    """part, hash, sample_id and distance: of each different hash of pages and payer that is asked for, the first ``TOP`` samples.

    A page's pairs beyond its own first ``TOP`` are not among its job's. ``part`` is the payer's name after "=", or "*" for
    all samples. Of samples with equal hashes and limits no more than ``TOP`` are compared.
    """
    named = F.concat(F.lit("="), F.col("_payer"))
    parts = samples.where("_sh IS NOT NULL").select("sample_id", F.col("_sh").alias("hash"), F.col("_limit").alias("limit"), F.explode(F.array_compact(F.array(F.lit("*"), named))).alias("part"))
    alike = Window.partitionBy("part", "hash", "limit").orderBy("sample_id")
    parts = parts.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= TOP).drop("_n")
    asked = pages.where("hash IS NOT NULL").select("part", "hash").distinct()
    met = in_blocks(parts, asked, "sample_id", "hash", _compared(most), "part string, hash long, sample_id long, distance int", BLOCK, BLOCK)
    w = Window.partitionBy("part", "hash").orderBy("distance", "sample_id")
    return met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= TOP).drop("_n")


def _pass(pages: DataFrame, samples: DataFrame, orb: DataFrame, wider: float, stricter: float, boost: float) -> DataFrame:
    """The best match of each job: job_id, version_id, sample_id, page_number, score, distance."""
    limit = F.floor(F.col("phash_threshold") * wider).cast("int")
    most = samples.agg(F.max(limit)).first()[0]
    if most is None:
        return pages.sparkSession.createDataFrame([], "job_id long, version_id long, sample_id long, page_number int, score double, distance int")
    s = samples.where("phash_threshold IS NOT NULL").select("sample_id", "version_id", F.col("payer").alias("_payer"), F.col("hash").alias("_sh"), "phash_threshold", "min_score", "orb_min_matches", limit.alias("_limit"))
    p = pages.withColumn("part", F.coalesce(F.concat(F.lit("="), F.col("_hint")), F.lit("*")))
    near = stored(_nearest(p, s, int(most)), "near-hashes")
    met = p.join(near, ["part", "hash"])
    w = Window.partitionBy("job_id").orderBy("distance", "page_number", "sample_id")
    top = met.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= TOP).join(s, "sample_id")
    scored = top.join(orb, ["job_id", "page_number", "sample_id"])
    scored = scored.withColumn("score", match_score(F.col("orb_score"), F.col("distance"), F.col("phash_threshold")))
    good = scored.where((F.col("inliers") >= F.floor(F.col("orb_min_matches") * stricter)) & (F.col("score") >= F.col("min_score") + boost))
    best = good.groupBy("job_id").agg(F.max(F.struct("score", (-F.col("_place")).alias("minus"), "version_id", "sample_id", "page_number", "distance")).alias("b"))
    return best.select("job_id", "b.version_id", "b.sample_id", "b.page_number", "b.score", "b.distance")


def matched(pages: DataFrame, samples: DataFrame, orb: DataFrame) -> DataFrame:
    """Per job with a match: version_id, sample_id, page_number, score, distance, and ``wide``, whether it took the second pass.

    A hint that some sample's payer answers narrows both passes to that payer; others are searched among all samples, once.
    """
    payers = samples.select(F.col("payer").alias("_known")).where("payer IS NOT NULL").distinct()
    p = pages.select("job_id", "page_number", "hash", "payer_hint").join(payers, F.col("payer_hint") == F.col("_known"), "left").withColumnRenamed("_known", "_hint")
    strict = stored(_pass(p, samples, orb, 1.0, 1.0, 0.0), "strict-matches")
    rest = stored(p.where("_hint IS NOT NULL").join(strict.select("job_id"), "job_id", "left_anti"), "unmatched-pages")
    wide = _pass(rest, samples, orb, WIDER, STRICTER, BOOST)
    return strict.withColumn("wide", F.lit(False)).unionByName(wide.withColumn("wide", F.lit(True)))
