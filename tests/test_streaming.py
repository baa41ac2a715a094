"""Mates in a stream: pairs, orphans by timer, reads alone."""

import datetime

from readqc.streaming import overlapping_mates

KIND = "qname string, flags int, ref_id int, mate_ref_id int, pos0 long, at timestamp"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def read(name, flags, pos, seconds, ref=0, mate=0):
    return (name, flags, ref, mate, pos, START + datetime.timedelta(seconds=seconds))


BATCHES = [
    [read("a", 99, 10, 0), read("b", 99, 50, 5), read("c", 99, 70, 6), read("x", 0, 5, 7, mate=None), read("d", 99, 1, 8, mate=1), read(None, 99, 2, 8), read("c", 99 + 2048, 71, 9)],
    [read("a", 147, 5, 60), read("c", 147, 90, 61), read("c", 99, 95, 62), read("u", 4 + 1, None, 63, ref=None, mate=None)],
    [read("e", 99, 500, 4000), read("e", 147, 400, 4001)],
    [read("f", 99, 600, 9000)],
    [read("g", 99, 700, 20_000), read("b", 147, 51, 20_001)],
]


def test_pairs_orphans_and_reads_alone(spark, tmp_path):
    """Each batch is a file; the timers of earlier reads fire when the watermark has passed them, also without a read of their name."""
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={i}"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    before = spark.conf.get("spark.sql.session.timeZone")
    query = overlapping_mates(stream, "at").writeStream.format("memory").queryName("mates").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        got = sorted(map(str, (tuple(r) for r in spark.table("mates").collect())))
    finally:
        query.stop()
    want = [
        ("a", "pair", 0, 5, 0, 10), ("c", "pair", 0, 70, 0, 90), ("e", "pair", 0, 400, 0, 500), ("b", "orphan", 0, 50, None, None), ("c", "orphan", 0, 95, None, None), ("f", "orphan", 0, 600, None, None),
        ("x", "alone", 0, 5, None, None), ("d", "alone", 0, 1, None, None), (None, "alone", 0, 2, None, None), ("u", "alone", None, None, None, None),
    ]
    assert before and got == sorted(map(str, want))  # g and the late b wait still
