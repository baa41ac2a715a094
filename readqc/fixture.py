"""Deterministic reads over the driver's tables, by SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.expressions import parse_cigar
from .sources.bam_writer import write_bam, write_bcf
from .store import claimed, stored, write_text

_reads: dict[tuple[str, str], DataFrame] = {}
_files: dict[tuple[str, str, str], str] = {}
HEADER = ("@HD\tVN:1.6", "@RG\tID:a\tSM:orders")
CONTIG_LENGTH = 19_456
CHUNK = "CASE WHEN ({k}) % 29 = 0 THEN 'NNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNN' ELSE translate(md5('chr' || CAST({c} AS VARCHAR(9)) || ':' || CAST({k} AS VARCHAR(9))), '0123456789abcdef', 'ACGTACGTACGTACGT') END"
_DIV = "CAST(FLOOR({a} / 32.0) AS BIGINT)"


def reads_sql() -> str:
    """SELECT of reads from orders; cigar is text, quals Phred+33."""
    k = _DIV.format(a="pos0")
    two = f"({CHUNK.format(c='ref_id + 1', k=k)} || {CHUNK.format(c='ref_id + 1', k=k + ' + 1')})"
    return f"""
SELECT read_id, qname, flags, ref_id, contig, pos0, mapq, mate_ref_id, mate_pos0, tlen, cigar, quals, nm, mq, has_sa,
  CASE WHEN mut = 0 THEN ref32 ELSE substr(ref32, 1, CAST(mut - 1 AS INT)) || translate(substr(ref32, CAST(mut AS INT), 1), 'ACGT', 'CGTN') || substr(ref32, CAST(mut + 1 AS INT), 32) END AS seq
FROM (
  SELECT *, substr({two}, CAST(pos0 % 32 AS INT) + 1, 32) AS ref32 FROM (
    SELECT k * 2 + rnum - 1 AS read_id, 'q' || CAST(k AS VARCHAR(19)) AS qname,
      CAST(CASE WHEN k % 23 = 0 THEN CASE WHEN rnum = 1 THEN 0 ELSE 16 END
        ELSE 1 + CASE WHEN rnum = 1 THEN 64 ELSE 128 END + CASE WHEN k % 19 = 0 THEN 0 ELSE 2 END
          + CASE WHEN k % 19 = 0 THEN 0 WHEN rnum = 1 THEN 32 ELSE 16 END
          + CASE WHEN k % 47 = 0 THEN CASE WHEN rnum = 2 THEN 4 ELSE 8 END ELSE 0 END END
        + CASE WHEN k % 11 = 0 THEN 1024 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 512 ELSE 0 END
        + CASE WHEN k % 37 = 0 AND rnum = 2 THEN 2048 ELSE 0 END + CASE WHEN k % 41 = 0 AND rnum = 2 THEN 256 ELSE 0 END AS INT) AS flags,
      CAST(k % 3 AS INT) AS ref_id, 'chr' || CAST(k % 3 + 1 AS VARCHAR(9)) AS contig,
      CASE WHEN rnum = 1 THEN p ELSE p + isz - 32 END AS pos0,
      CAST(CASE WHEN k % 31 = 0 THEN NULL ELSE (k * 13) % 61 END AS INT) AS mapq,
      CAST(CASE WHEN k % 23 = 0 THEN NULL ELSE k % 3 END AS INT) AS mate_ref_id,
      CASE WHEN k % 23 = 0 THEN NULL WHEN rnum = 1 THEN p + isz - 32 ELSE p END AS mate_pos0,
      CAST(CASE WHEN k % 23 = 0 THEN 0 WHEN rnum = 1 THEN isz ELSE -isz END AS INT) AS tlen,
      CASE (k + rnum) % 8 WHEN 0 THEN '32M' WHEN 1 THEN '4S28M' WHEN 2 THEN '14M2I16M' WHEN 3 THEN '14M3D18M' WHEN 4 THEN '28M4S' WHEN 5 THEN '10M100N22M' WHEN 6 THEN '3H4S20=1X7M' ELSE '12M1P4I16M2H' END AS cigar,
      translate(md5('q/q' || CAST(k AS VARCHAR(19)) || '/' || CAST(rnum AS VARCHAR(1))), '0123456789abcdef', '#+05:?ABCDEFGHIJ') AS quals,
      (k * 5 + rnum * 3) % 33 AS mut, CASE WHEN (k * 5 + rnum * 3) % 33 = 0 THEN 0 ELSE 1 END AS nm,
      CASE WHEN k % 3 = 0 OR k % 23 = 0 THEN NULL ELSE (k * 13) % 61 END AS mq, k % 43 = 0 AS has_sa
    FROM (SELECT o_orderkey AS k, 64 + (o_orderkey * 7919 + o_custkey * 104729) % 19000 AS p, 34 + (o_custkey * 31 + o_orderkey) % 80 AS isz FROM orders) o
    CROSS JOIN (SELECT CAST(1 AS BIGINT) AS rnum UNION ALL SELECT CAST(2 AS BIGINT) AS rnum) r
  ) a
) b"""


TARGETS_SQL = "SELECT 'chr' || CAST(p_partkey % 3 + 1 AS VARCHAR(9)) AS contig, (p_partkey * 97) % 19000 AS start0, (p_partkey * 97) % 19000 + 20 + p_size AS end0, 't' || CAST(p_partkey AS VARCHAR(19)) AS name FROM part WHERE p_partkey % 9 = 0"
BAITS_SQL = "SELECT 'chr' || CAST(p_partkey % 3 + 1 AS VARCHAR(9)) AS contig, (p_partkey * 97) % 19000 - 10 + p_partkey % 7 AS start0, (p_partkey * 97) % 19000 + 30 + p_size AS end0, 'b' || CAST(p_partkey AS VARCHAR(19)) AS name FROM part WHERE p_partkey % 9 = 0 AND (p_partkey * 97) % 19000 >= 10"
VARIANTS_SQL = "SELECT 'chr' || CAST(event_id % 3 + 1 AS VARCHAR(9)) AS contig, (event_id * 131) % 19456 AS start0, (event_id * 131) % 19456 + 1 + event_id % 3 AS end0, 'v' || CAST(event_id AS VARCHAR(19)) AS name FROM events WHERE event_id % 50 = 0"


class Tables:
    """The fixture's tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def _sql(self, sql: str, table: str) -> DataFrame:
        return self.spark.sql(sql.replace(f"FROM {table}", "FROM {" + table + "}"), **{table: self.spark.read.parquet(f"{self.dir}/{table}.parquet")})

    @property
    def reads(self) -> DataFrame:
        """Written once a session and folder, in as many files as the session has cores, as a converted alignment file would be."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _reads:
            orders = self.spark.read.parquet(f"{self.dir}/orders.parquet")
            n = max(1, min(self.spark.sparkContext.defaultParallelism, orders.count() // 2000))
            made = self.spark.sql(reads_sql().replace("FROM orders", "FROM {orders}"), orders=orders.repartition(n))
            _reads[key] = stored(made.withColumn("cigar", parse_cigar("cigar")), "reads")
        return _reads[key]

    @property
    def contigs(self) -> DataFrame:
        return self.spark.createDataFrame([(i, f"chr{i + 1}", CONTIG_LENGTH) for i in range(3)], "ref_id int, contig string, length long")

    @property
    def ref(self) -> DataFrame:
        c, k = "(id % 3 + 1)", "CAST(FLOOR(id / 3) AS BIGINT)"
        rows = self.spark.range(3 * CONTIG_LENGTH // 32)
        return rows.select(F.expr(f"'chr' || CAST({c} AS VARCHAR(9))").alias("contig"), F.expr(f"{k} * 32").alias("start0"), F.expr(CHUNK.format(c=c, k=k)).alias("seq"))

    @property
    def targets(self) -> DataFrame:
        return self._sql(TARGETS_SQL, "part")

    @property
    def baits(self) -> DataFrame:
        return self._sql(BAITS_SQL, "part")

    @property
    def variants(self) -> DataFrame:
        return self._sql(VARIANTS_SQL, "events")

    def file(self, name: str) -> str:
        """The path of one of the tables in a format of the sources, written once a session and folder: reads.bam, reads.sam, reads.sam.gz, ref.fa, targets.bed, baits.interval_list, variants.vcf, variants.bcf."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _files:
            path = f"{claimed(self.spark, 'files')}/{name}"
            self._write(name, path)
            _files[key] = path
        return _files[key]

    def _write(self, name: str, path: str) -> None:
        if name == "reads.bam":
            write_bam(self.reads, self.contigs, path, HEADER)
        elif name == "variants.bcf":
            write_bcf(self.variants, self.contigs, path)
        elif name.startswith("reads.sam"):
            sinks.sam_lines(self.reads, self.contigs, HEADER).write.text(path, compression="gzip" if name.endswith(".gz") else "none")
        elif name == "ref.fa":
            out, index = "", ""
            for c in self.contigs.orderBy("ref_id").collect():
                bases = "".join(r.seq for r in self.ref.filter(F.col("contig") == c.contig).orderBy("start0").collect())  # three contigs of CONTIG_LENGTH
                out += f">{c.contig} of the fixture\n"
                index += f"{c.contig}\t{len(bases)}\t{len(out)}\t60\t61\n"
                out += "".join(f"{bases[i : i + 60]}\n" for i in range(0, len(bases), 60))
            write_text(self.spark, path, out)
            write_text(self.spark, path + ".fai", index)
        elif name == "targets.bed":  # every third one has no name of its own
            named = F.when(F.col("start0") % 3 == 0, ".").otherwise(F.col("name"))
            self.targets.select(F.concat_ws("\t", "contig", F.col("start0").cast("string"), F.col("end0").cast("string"), named).alias("value")).write.text(path)
        elif name == "baits.interval_list":
            head = self.spark.createDataFrame([(i, x) for i, x in enumerate([HEADER[0], *(f"@SQ\tSN:{r.contig}\tLN:{r.length}" for r in self.contigs.orderBy("ref_id").collect())])], "at long, value string")
            body = self.baits.select((F.lit(9) + F.col("start0")).alias("at"), F.concat_ws("\t", "contig", (F.col("start0") + 1).cast("string"), F.col("end0").cast("string"), F.lit("+"), "name").alias("value"))
            head.union(body).orderBy("at").select("value").write.text(path)
        else:  # a record's span is that of its REF, or ends at END
            size = (F.col("end0") - F.col("start0")).cast("int")
            long = F.col("start0") % 2 == 0
            fields = ["contig", (F.col("start0") + 1).cast("string"), "name", F.when(long, "A").otherwise(F.repeat(F.lit("A"), size)), F.lit("C"), F.lit("."), F.lit("."), F.when(long, F.concat(F.lit("AC=1;END="), F.col("end0").cast("string"))).otherwise("AC=1")]
            self.variants.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
