"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldchirp.operators.rangescan import running
from fieldchirp.scratch import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ONE = 1 << 24  # a whole copy in the fixed-point arithmetic of expected copies


def source_key(col) -> Column:
    """Case, surrounding blanks and hyphen or underscore make no difference; blank is null."""
    c = F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(" \t\r\n")))
    return F.when(c != "", F.translate(c, "-", "_"))


def token_count(tokenizer: str):
    """Column function: tokens of a text under the tokenizer file, whole texts, specials as ordinary text."""

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count


def source_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Expected copies per source: (source, target_share, max_repeats, size, n_docs, copies, copies_fp).

    ``total_tokens`` is the size of the mix.  By default it is the largest
    size at which every source that has documents meets its share (relative
    to the others that have some) within its repeats.  Beyond that, capped
    sources give all they may, and the report shows the shortfall.
    A source listed twice counts with the sum of its shares and the least of
    its repeats; null or negative shares count as 0.
    """
    t = targets.select(source_key("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("s"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("r"))
    t = t.where("source is not null").groupBy("source").agg(F.sum("s").alias("target_share"), F.min("r").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"))
    plan = t.join(have, "source", "left").fillna(0, ["size", "n_docs"])
    # One row: the share that sources with documents hold, and the size at which the first cap binds.
    limit = plan.where("size > 0 and target_share > 0").agg(F.sum("target_share").alias("held"), F.min(F.col("max_repeats") * F.col("size") / F.col("target_share")).alias("reach"))
    held, reach = limit.first()
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.lit((reach or 0.0) * (held or 0.0))
    want = F.when((F.col("size") > 0) & (F.lit(held or 0.0) > 0), F.col("target_share") / F.lit(held or 1.0) * total / F.col("size")).otherwise(0.0)
    copies = F.least(want, F.col("max_repeats").cast("double"))
    return plan.withColumn("copies", copies).withColumn("copies_fp", F.least(F.round(F.col("copies") * ONE), F.col("max_repeats") * ONE).cast("long"))


def mix_sources(
    docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: int | None = None, seed: int = 17, doc_id: str = "doc_id", partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Draw documents so that sources meet their shares of all tokens.

    Returns (draws, report).  draws: (doc id, source, n_tokens, n_copies), one
    row per document used.  report: (source, target_share, max_repeats,
    n_docs, size, copies, drawn_docs, drawn_tokens, actual_share), a row for
    every target and every other source of the documents, null among them,
    that isn't used.

    Systematic sampling: the expected copies of a source's documents are
    prefix-summed in the order of their sizes, one random offset per source is
    added, and a document is emitted once for each whole number crossed.
    Copies are fixed-point integers, so the draw is the same on any
    partitioning; a source of any size is spread over tasks.  Null texts have
    no tokens and come first; repeated texts are documents of their own.
    """
    count = token_count(tokenizer)
    sized = docs.select(F.col(doc_id).alias(doc_id), source_key("source").alias("source"), count(F.col("text")).alias("n_tokens"))
    sized = materialize(sized, "mix-sized")
    plan = materialize(source_plan(sized, targets, total_tokens), "mix-plan")
    # The targets are a list kept by hand; the plan has one row for each.
    small = plan.where("copies_fp > 0").select("source", "copies_fp")
    weighed = sized.join(small, "source")
    placed = running(weighed, ["source"], ["n_tokens", doc_id], {"upto": "copies_fp"}, partitions=partitions, name="mix")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(ONE))
    whole = lambda c: F.floor((c + offset) / F.lit(ONE))
    n = whole(F.col("upto")) - whole(F.col("upto") - F.col("copies_fp"))
    draws = materialize(placed.select(doc_id, "source", "n_tokens", n.cast("int").alias("n_copies")).where("n_copies > 0"), "mix-draws")
    drawn = draws.groupBy("source").agg(F.sum("n_copies").alias("drawn_docs"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("drawn_tokens"))
    everything = draws.agg(F.sum(F.col("n_copies") * F.col("n_tokens"))).first()[0] or 0
    others = sized.join(plan.select("source"), "source", "left_anti").groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"))
    report = plan.unionByName(others.withColumn("copies", F.lit(0.0)), allowMissingColumns=True).join(drawn, "source", "left").fillna(0, ["drawn_docs", "drawn_tokens"])
    share = F.col("drawn_tokens") / F.lit(everything) if everything else F.lit(0.0)
    report = report.select("source", "target_share", "max_repeats", "n_docs", "size", "copies", "drawn_docs", "drawn_tokens", share.alias("actual_share"))
    return draws, report
