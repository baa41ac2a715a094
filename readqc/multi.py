"""Several programs over one scan of the reads (alignment, basic, isize and gcbias; the others scan for themselves), and the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import schema, sinks
from .plans import coverage, errors, facts, hybcap, simple
from .sources import text
from .store import stored


@dataclass
class Inputs:
    reads: DataFrame | None
    contigs: DataFrame | None = None
    ref: DataFrame | None = None
    baits: DataFrame | None = None
    targets: DataFrame | None = None
    sample: str = "sample"
    panel: str = "panel"
    options: dict[str, dict] = field(default_factory=dict)


#: What each program needs besides reads.
NEEDS = {"alignment": (), "basic": (), "isize": (), "wgs": ("ref",), "gcbias": ("ref", "contigs"), "hybcap": ("baits", "targets", "contigs"), "error": ("ref",)}

_PLACE = ("ref_id", "contig", "pos0", "mate_ref_id", "mate_pos0", "tlen", "cigar")
#: Columns of reads that each program uses, for sources that decode no others.
COLUMNS = {
    "alignment": ("flags", *_PLACE, "mapq", "seq", "quals", "nm", "mq", "has_sa"), "basic": ("flags", "seq", "quals"), "isize": ("flags", "ref_id", "pos0", "mate_ref_id", "mate_pos0", "tlen", "cigar"), "wgs": ("read_id", "qname", "flags", *_PLACE, "mapq", "quals"),
    "gcbias": ("flags", "ref_id", "contig", "pos0", "cigar", "mapq", "seq", "quals", "nm"), "hybcap": ("read_id", "qname", "flags", *_PLACE, "mapq", "seq", "quals"), "error": ("read_id", "qname", "flags", *_PLACE, "mapq", "seq", "quals", "nm"),
}


def columns_of(tools: list[str]) -> list[str]:
    """The union of the columns that several programs use."""
    used = {c for t in tools for c in COLUMNS[t]}
    return [c.split(" ")[0] for c in schema.READS.replace("op:string,len:int", "").split(", ") if c.split(" ")[0] in used]


def scanned(tools: list[str], x: Inputs) -> DataFrame | None:
    """Facts for those of the programs that share them, stored: the one scan of the reads for all of their tables."""
    sharing = [t for t in facts.SHARED if t in tools]
    return stored(facts.facts(x.reads, sharing, x.options), "facts", by="t") if sharing else None


def tables(tool: str, x: Inputs, shared: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of one program, lazily but for what its tables share; shared: scanned() with this program."""
    o = dict(x.options.get(tool, {}))
    if missing := [n for n in NEEDS[tool] if getattr(x, n) is None]:
        raise ValueError(f"{tool} needs {', '.join(missing)}")
    shared = scanned([tool], x) if shared is None else shared
    if tool == "alignment":
        return {"alignment_summary": simple.alignment_from(shared, x.sample)}
    if tool == "basic":
        counts = facts.base_counts(shared)
        return {n: getattr(simple, n)(x.reads, counts) for n in ("base_distribution_by_cycle", "mean_quality_by_cycle", "quality_score_distribution")}
    if tool == "isize":
        hist = facts.size_counts(shared)
        return {"insert_size_metrics": simple.insert_size_metrics(x.reads, **o, hist=hist), "insert_size_histogram": simple.insert_size_histogram(x.reads, hist=hist)}
    if tool == "wgs":
        cap, span = {k: o.pop(k) for k in ("coverage_cap",) if k in o}, {k: o.pop(k) for k in ("intervals",) if k in o}
        runs = stored(coverage.depth_runs(x.reads, **o), "depth")
        return {"wgs_metrics": coverage.wgs_metrics(x.reads, x.ref, x.sample, **span, **cap, runs=runs, **o), "wgs_coverage": coverage.depth_histogram(x.reads, x.ref, **span, **cap, runs=runs)}
    if tool == "gcbias":
        bins = stored(coverage.gcbias_bins(x.reads, x.ref, x.contigs, o.get("window", 100), facts.start_counts(shared, x.contigs)), "gc")
        return {"gcbias_detail": coverage.gcbias_detail(x.reads, x.ref, x.contigs, x.sample, **o, bins=bins), "gcbias_summary": coverage.gcbias_summary(x.reads, x.ref, x.contigs, x.sample, **o, bins=bins, kept=facts.cluster_counts(shared))}
    if tool == "hybcap":
        near, per_target, per_base = o.pop("near", 250), o.pop("per_target_coverage", False), o.pop("per_base_coverage", False)
        got = hybcap.Captured(x.reads, hybcap.merged_targets(x.targets), **o)
        out = {"hybcap_metrics": hybcap.hybcap_metrics(x.reads, x.baits, x.targets, x.contigs, x.ref, x.sample, x.panel, near, got, **o)}
        if per_target:
            out["per_target"] = hybcap.per_target(x.reads, x.targets, x.ref, got)
        if per_base:
            out["per_base"] = hybcap.per_base(x.reads, x.targets, got)
        return out
    counts = stored(errors.counted(x.reads, x.ref, **o), "strata")
    return {"error_mismatch": errors.mismatch(counts), "error_overlap": errors.overlap(counts), "error_indel": errors.indel(counts)}


def run(tools: list[str], x: Inputs) -> dict[str, DataFrame]:
    """Tables of several programs; repeated programs count once."""
    if unknown := [t for t in tools if t not in NEEDS]:
        raise ValueError(f"unknown program: {unknown[0]}")
    out: dict[str, DataFrame] = {}
    shared = scanned(tools, x)
    for tool in dict.fromkeys(tools):
        out |= tables(tool, x, shared)
    return out


def _flag(value: str) -> bool:
    if value.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false expected")
    return value.lower() == "true"


def _whole(value: str) -> int:
    if not value.isdigit():
        raise argparse.ArgumentTypeError("a whole number from 0 up expected")
    return int(value)


def _depth(value: str) -> int:
    if not value.isdigit() or int(value) > coverage.MOST_DEPTH:
        raise argparse.ArgumentTypeError(f"a whole number up to {coverage.MOST_DEPTH} expected")
    return int(value)


#: Options of each program: name on the command line, type, and the argument of its function (not: the opposite is passed on).
OPTIONS = {
    "alignment": (("max-insert-size", _whole, "max_insert_size"), ("min-mapq", _whole, "min_mapq")),
    "basic": (),
    "isize": (("include-duplicates", _flag, "include_duplicates"), ("min-frac", float, "min_frac"), ("deviations", float, "deviations")),
    "wgs": (("intervals", str, "intervals"), ("include-duplicates", _flag, "include_duplicates"), ("exclude-unpaired-reads", _flag, "exclude_unpaired"), ("min-mapq", _whole, "min_mapq"), ("min-bq", _whole, "min_bq"), ("coverage-cap", _depth, "coverage_cap")),
    "gcbias": (("exclude-duplicates", _flag, "exclude_duplicates"), ("window-size", _whole, "window"), ("min-mapq", _whole, "min_mapq"), ("exclude-supplementary", _flag, "exclude_supplementary")),
    "hybcap": (
        ("baits", str, "baits"), ("targets", str, "targets"), ("panel-name", str, "panel"), ("include-duplicates", _flag, "include_duplicates"), ("near-distance", _whole, "near"), ("min-mapping-quality", _whole, "min_mapq"), ("min-base-quality", _whole, "min_bq"),
        ("dont-clip-overlapping-reads", _flag, "not clip"), ("include-indels", _flag, "include_indels"), ("per-target-coverage", _flag, "per_target_coverage"), ("per-base-coverage", _flag, "per_base_coverage"),
    ),
    "error": (("vcf", str, "mask"), ("intervals", str, "intervals"), ("min-mapq", _whole, "min_mapq"), ("min-bq", _whole, "min_bq"), ("include-duplicates", _flag, "include_duplicates"), ("max-isize", _whole, "max_isize"), ("stratify-by", str, "groups")),
}


def parser(tool: str) -> argparse.ArgumentParser:
    """The command line of one program; multi takes the options of all as --program::option."""
    p = argparse.ArgumentParser(prog=f"readqc {tool}", allow_abbrev=False)
    if tool == "docs":
        p.add_argument("-o", "--output")
        p.add_argument("--format", choices=["text", "markdown"], default="text")
        return p
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-r", "--reference", required=any("ref" in NEEDS[t] for t in [tool] if t != "multi"))
    if tool == "multi":
        p.add_argument("--tools", nargs="+", choices=list(NEEDS), default=["alignment", "basic", "isize"])
    for of in NEEDS if tool == "multi" else [tool]:
        for name, kind, target in OPTIONS[of]:
            short = ["-L"] if (tool, name) == ("wgs", "intervals") else []
            more = {"nargs": "?", "const": True} if kind is _flag else {"nargs": "+"} if name == "stratify-by" else {}
            p.add_argument(f"--{of}::{name}" if tool == "multi" else f"--{name}", *short, dest=f"{of}::{target}", type=kind, default=None, required=tool == "hybcap" and name in ("baits", "targets"), **more)
    return p


def main(argv: list[str] | None = None) -> None:
    import sys

    from .session import session

    argv = sys.argv[1:] if argv is None else argv
    names = [*NEEDS, "multi", "docs"]
    if not argv or argv[0] not in names:
        raise SystemExit(f"usage: readqc {{{','.join(names)}}} [options]")
    tool = argv[0]
    a = vars(parser(tool).parse_args(argv[1:]))
    if tool == "docs":
        text_out = sinks.docs(documented(session()), markdown=a["format"] == "markdown")
        if a["output"]:
            with open(a["output"], "w", encoding="utf-8") as f:
                f.write(text_out)
        else:
            print(text_out, end="")
        return
    given = {k: v for k, v in a.items() if "::" in k and v is not None}
    options: dict[str, dict] = {}
    for key, value in given.items():
        of, target = key.split("::")
        options.setdefault(of, {})[target.removeprefix("not ")] = not value if target.startswith("not ") else value
    tools = a["tools"] if tool == "multi" else [tool]
    spark: SparkSession = session()
    kind = text.detect_format(a["input"])
    if kind == "bam":
        from .sources.bam import bam_contigs, read_header

        contigs, head = bam_contigs(spark, a["input"]), read_header(spark, a["input"])[0]
    else:
        head = text.sam_header(spark, a["input"]) if kind == "sam" else []
        contigs = text.contigs_of(spark, head)
    ref = text.fasta(spark, a["reference"]) if a["reference"] else None
    if ref is not None:
        text.check_contigs(contigs, text.fasta_index(spark, a["reference"]))
    x = Inputs(None, contigs, ref, sample=text.sample_of(a["input"], head), options=options)
    hyb = options.get("hybcap", {})
    if hyb.get("baits"):
        x.panel = hyb.pop("panel", None) or text.sample_of(hyb["baits"], [])
        x.baits = text.intervals(spark, hyb.pop("baits"), contigs)
    if hyb.get("targets"):
        x.targets = text.intervals(spark, hyb.pop("targets"), contigs)
    for of in ("wgs", "error"):
        if options.get(of, {}).get("intervals"):
            options[of]["intervals"] = text.intervals(spark, options[of]["intervals"], contigs)
    if options.get("error", {}).get("mask"):
        options["error"]["mask"] = text.vcf(spark, options["error"]["mask"])
    inside = options.get("error", {}).get("intervals")
    if tools == ["error"] and kind == "bam" and inside is not None:
        from .sources.bam import bam_intervals

        x.reads = bam_intervals(spark, a["input"], inside, columns_of(tools))
    else:
        x.reads = text.reads(spark, a["input"], columns_of(tools))
    if len(set(tools)) > 1 and kind in ("sam", "bam"):
        x.reads = stored(x.reads, "reads")  # one decode for all programs, of which each then reads its columns
    for name, df in run(tools, x).items():
        print(sinks.write_tsv(df, name, a["output"]))


def documented(spark: SparkSession) -> dict[str, DataFrame]:
    """All sixteen tables, over no reads, for their columns."""
    empty = lambda kind: spark.createDataFrame([], kind)
    x = Inputs(empty(schema.READS), empty(schema.CONTIGS), empty(schema.REFERENCE), empty(schema.INTERVALS), empty(schema.INTERVALS), options={"hybcap": {"per_target_coverage": True, "per_base_coverage": True}})
    return run(list(NEEDS), x)


if __name__ == "__main__":
    main()
