"""Streams of reads: running tables, and the meeting of mates within a watermark, with or without those that wait in vain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X


def running_insert_sizes(stream: DataFrame) -> DataFrame:
    """Histogram of insert sizes by orientation, for output mode complete."""
    keep = X.flag(X.PAIRED) & ~X.flag(X.UNMAPPED | X.MATE_UNMAPPED) & ~X.flag(X.FIRST) & ~X.flag(X.SECONDARY | X.SUPPLEMENTARY | X.QC_FAIL | X.DUPLICATE) & (F.col("tlen") != 0)
    rows = stream.filter(keep).select(X.pair_orientation().alias("pair_orientation"), F.abs(F.col("tlen").cast("long")).alias("insert_size"))
    return rows.filter("pair_orientation IS NOT NULL").groupBy("pair_orientation", "insert_size").agg(F.count(F.lit(1)).alias("n"))


def meet_mates(stream: DataFrame, time: str, wait: str = "10 minutes") -> DataFrame:
    """First and second reads of a name that arrive within ``wait`` of each other; state of reads that wait longer is dropped."""
    rows = stream.filter(~X.flag(X.SECONDARY | X.SUPPLEMENTARY)).withWatermark(time, wait)
    one = rows.filter(X.flag(X.FIRST)).select(F.col("qname"), F.col("ref_id").alias("ref1"), F.col("pos0").alias("pos1"), F.col(time).alias("t1"))
    two = rows.filter(X.flag(X.LAST)).select(F.col("qname").alias("q2"), F.col("ref_id").alias("ref2"), F.col("pos0").alias("pos2"), F.col(time).alias("t2"))
    near = F.expr(f"qname = q2 AND t2 BETWEEN t1 - INTERVAL {wait} AND t1 + INTERVAL {wait}")
    return one.join(two, near).drop("q2")


PAIRED = "qname string, kind string, ref1 int, pos1 long, ref2 int, pos2 long"


def overlapping_mates(stream: DataFrame, time: str, wait_seconds: int = 600) -> DataFrame:
    """(qname, kind, ref1, pos1, ref2, pos2), a row a read or pair: kind is pair, orphan or alone.

    A read that can have a mate, both mapped to one reference, is held by its name until the mate comes, and then leaves with it as a pair (first by its
    place); after wait_seconds of event time beyond the watermark without a mate it leaves as an orphan, by a timer. Reads
    that can have none, secondary and supplementary ones excepted, which are left out, and reads without a name leave at once,
    alone. A name holds one read at a time, so state grows with the reads that wait. A third read of a name waits again.
    """
    primary = stream.filter(~X.flag(X.SECONDARY | X.SUPPLEMENTARY))
    can = X.flag(X.PAIRED) & ~X.flag(X.UNMAPPED | X.MATE_UNMAPPED) & F.coalesce(F.col("ref_id") == F.col("mate_ref_id"), F.lit(False)) & F.col("qname").isNotNull() & F.col(time).isNotNull()
    nothing = lambda kind: F.lit(None).cast(kind)
    alone = primary.filter(~can).select("qname", F.lit("alone").alias("kind"), F.col("ref_id").cast("int").alias("ref1"), F.col("pos0").cast("long").alias("pos1"), nothing("int").alias("ref2"), nothing("long").alias("pos2"))
    waiting = primary.filter(can).select("qname", F.col("ref_id").cast("int").alias("ref"), F.col("pos0").cast("long").alias("pos"), F.col(time).alias("at"), F.unix_millis(time).alias("ms")).withWatermark("at", f"{wait_seconds} seconds")
    wait = wait_seconds * 1000

    def meet(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        row = lambda kind, a, b=(None, None): (key[0], kind, *a, *b)
        out, held = [], state.getOption
        if state.hasTimedOut:
            out.append(row("orphan", held[:2]))
            state.remove()
        else:
            for batch in batches:
                for read in zip(batch["ref"].tolist(), batch["pos"].tolist(), batch["ms"].tolist()):
                    if held is None:
                        held = read
                    else:
                        out.append(row("pair", *sorted((held[:2], read[:2]))))
                        held = None
            if held is not None:
                state.update(held)
                state.setTimeoutTimestamp(max(held[2] + wait, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        made = pd.DataFrame(out, columns=["qname", "kind", "ref1", "pos1", "ref2", "pos2"])
        yield made.astype({"ref1": "Int32", "pos1": "Int64", "ref2": "Int32", "pos2": "Int64"})

    met = waiting.groupBy("qname").applyInPandasWithState(meet, PAIRED, "ref int, pos long, at long", "append", "EventTimeTimeout")
    return met.unionByName(alone)
