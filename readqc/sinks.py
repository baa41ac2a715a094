"""Sinks: one TSV a table, table documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import TABLES, decimals, describe
from .store import write_text


def formatted(df: DataFrame, table: str) -> DataFrame:
    """All columns as text: doubles with the table's decimals (exact value, ties to even), null as empty."""
    cols = []
    for name, kind in df.dtypes:
        text = F.call_function("format_number", F.col(name), F.lit("0." + "0" * decimals(table, name))) if kind == "double" else F.col(name).cast("string")
        cols.append(F.coalesce(text, F.lit("")).alias(name))
    return df.select(*cols)


#: Tables that grow with targets: they are written by the executors, as a folder of parts in order.
LARGE = ("per_target", "per_base")


def write_tsv(df: DataFrame, table: str, prefix: str) -> str:
    """prefix + suffix, with a header: one file, empty without rows, or for a table of LARGE a folder of parts, each with the header."""
    path = prefix + TABLES[table][0]
    text = formatted(df, table)
    if table in LARGE:
        text.toDF(*(c.lower() for c in df.columns)).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")
        return path
    rows = ["\t".join(row) for row in text.toLocalIterator()]  # a table of statistics: its rows don't grow with the reads
    write_text(df.sparkSession, path, "".join(f"{x}\n" for x in (["\t".join(c.lower() for c in df.columns)] + rows if rows else [])))
    return path


def sam_lines(reads: DataFrame, contigs: DataFrame, header: tuple[str, ...] = ()) -> DataFrame:
    """(value): reads as lines of SAM in the order of read_id, after the header. contigs has one row a contig."""
    given = contigs.orderBy("ref_id").collect()
    head = [*header, *(f"@SQ\tSN:{r.contig}\tLN:{r.length}" for r in given)]
    names = F.array(*[F.lit(r.contig) for r in given])
    cigar = F.array_join(F.transform("cigar", lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    star = lambda c: F.when(c.isNull() | (c == ""), "*").otherwise(c)
    place = lambda c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("string")
    mate = F.when(F.col("mate_ref_id").isNull(), "*").when(F.col("mate_ref_id").eqNullSafe(F.col("ref_id")), "=").otherwise(F.element_at(names, (F.col("mate_ref_id") + 1).cast("int")))
    fields = [star(F.col("qname")), F.col("flags").cast("string"), star(F.col("contig")), place("pos0"), F.coalesce("mapq", F.lit(255)).cast("string"), star(cigar), mate, place("mate_pos0"), F.coalesce("tlen", F.lit(0)).cast("string"), star(F.col("seq")), star(F.col("quals"))]
    tags = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:i:"), F.col(c).cast("string"))) for t, c in (("NM", "nm"), ("MQ", "mq"))] + [F.when(F.col("has_sa"), "SA:Z:x")]
    lines = reads.select((F.col("read_id") + len(head)).alias("at"), F.concat_ws("\t", *fields, *tags).alias("value"))
    top = reads.sparkSession.createDataFrame(list(enumerate(head)), "at long, value string")
    return top.union(lines).orderBy("at").select("value")


def docs(tables: dict[str, DataFrame], markdown: bool = False) -> str:
    """The sixteen tables in order, with their files and columns."""
    kinds, out = {"string": "text", "double": "number", "int": "count", "bigint": "count"}, []
    for name, (suffix, _, _, what) in TABLES.items():
        fields = [(col, kinds[kind], f", {decimals(name, col)} decimals" if kind == "double" else "", describe(name, col)) for col, kind in tables[name].dtypes]
        if markdown:
            out.append(f"## {name}\n\n`{suffix}`: {what}\n\n| Column | Type | Meaning |\n|---|---|---|\n" + "".join(f"| `{c}` | {k}{d} | {t} |\n" for c, k, d, t in fields))
        else:
            width = max(len(c) for c, *_ in fields)
            out.append(f"{name} ({suffix})\n  {what}\n" + "".join(f"  {c:<{width}}  {k}{d}: {t}\n" for c, k, d, t in fields))
    return "\n".join(out)


def docs_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, n, s, w) for i, (n, (s, _, _, w)) in enumerate(TABLES.items())], "position int, name string, suffix string, description string")
