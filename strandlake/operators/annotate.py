"""Signal annotation.

Labels and runs of a read are worked out from its row alone, by stretches of its CIGAR and for a batch of rows at once:
no base or sample becomes a row, nothing is joined or shuffled. M must be resolved first (tracks.resolve_matches) where identity counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import cigar as cg
from ..functions.arrays import once
from ..schemas import ON_REF

#: Bases of the 5' and 3' adapters on a reference, and annotation codes.
LEAD, TAIL = 36, 41
ADAPTER, THREE_SPLINT, FIVE_SPLINT, FIRST_CLASS = 0, 1, 2, 3


def gates(alignments: DataFrame, lead: int = LEAD, tail: int = TAIL, inner: int = 15) -> DataFrame:
    """Rows fit for labelling, with ref_end and the fragment flag."""
    mapped = (F.col("flag").bitwiseAND(F.lit(4 | 256 | 2048)) == 0) & (F.col("mapq") != 0) & ~F.col("is_split") & (F.col("ns") < 1_000_000)
    rows = once(alignments.where(mapped), "ref_end", F.col("pos") + cg.total("cigar", *ON_REF))
    span = F.abs(F.greatest("pos", F.lit(lead)) - F.least("ref_end", F.col("ref_len") - tail))
    return rows.where(span >= inner).withColumn("fragment", (F.col("pos") > lead) | (F.col("ref_end") < F.col("ref_len") - tail))


_STRETCH = "array<struct<label: int, q: int, n: int>>"


def label_stretches(lead: int = LEAD, tail: int = TAIL) -> Column:
    """P18, W7 as array of (label, q, n): labels of the n bases from q on, in sequence order, over columns
    class_code, ref_len, pos, ref_end, cigar.

    An aligned base is labelled by its reference position, and by the 3' splint once the last one is reached.
    Inserted and clipped bases go by the aligned base before them, or by the 5' splint if the alignment has not begun."""
    return batches.column(batches.label_stretches, _STRETCH, "cigar", "pos", "ref_end", "ref_len", F.col("class_code").cast("int"), F.lit(lead), F.lit(tail), F.lit(THREE_SPLINT), F.lit(FIVE_SPLINT))


def base_labels(alignments: DataFrame, lead: int = LEAD, tail: int = TAIL) -> DataFrame:
    """read_id, query_pos, label of each base, from rows with class_code, ref_len, pos, ref_end, cigar."""
    rows = alignments.select("read_id", F.explode(label_stretches(lead, tail)).alias("s"))
    return rows.select("read_id", F.explode(F.sequence(F.col("s.q"), F.col("s.q") + F.col("s.n") - 1)).alias("query_pos"), "s.label")


def with_region_identity(alignments: DataFrame, lead: int = LEAD, tail: int = TAIL) -> DataFrame:
    """Adds region_identity over reference positions lead to ref_len - tail, insertions between them
    included; null where the read covers none."""
    counts = cg.region_counts("cigar", "pos", F.lit(lead), F.col("ref_len") - tail + 1)
    n = F.col("_t.cov") + F.col("_t.ins")
    return once(alignments, "_t", counts).withColumn("region_identity", F.when(n > 0, F.col("_t.match") / n)).drop("_t")


def signal_runs(stretches: Column) -> Column:
    """Array of (label, n) over the samples of a read, from its label stretches and columns mv, ts. Bases
    come in signal order, the reverse of the sequence; base places use move index - 1; samples before the first
    base are adapter. Neighbours of one label are one run."""
    return batches.column(batches.signal_runs, "array<struct<label: int, n: int>>", stretches, "mv", "ts", F.lit(ADAPTER))


def display_name(name: str | Column, suffix: str = "") -> Column:
    """The last part of a name after `_`, its fields p1-p2 (encoder) and p3-p4 (decoder)."""
    n = F.col(name) if isinstance(name, str) else name
    fields = F.split(F.element_at(F.split(n, "_"), -1), "-")
    two = lambda a, b: F.concat_ws("-", F.try_element_at(fields, F.lit(a)), F.try_element_at(fields, F.lit(b)))
    return F.struct(F.concat(two(1, 2), F.lit(suffix)).alias("encoder"), two(3, 4).alias("decoder"))


def nearest_variant(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """Reads (read_id, family, seq) to the variant of the family at the least edit distance (P23); a
    tie drops the read. variants (family, variant, seq) is small."""
    rows = reads.join(variants.select("family", "variant", F.col("seq").alias("variant_seq")), "family")
    rows = rows.withColumn("dist", F.levenshtein("seq", "variant_seq"))
    found = rows.groupBy("read_id").agg(F.min("dist").alias("least"), F.min_by("variant", "dist").alias("variant"), F.sort_array(F.collect_list("dist")).alias("all"))
    return found.where((F.size("all") == 1) | (F.try_element_at("all", F.lit(2)) > F.col("least"))).select("read_id", "variant", F.col("least").alias("dist"))


def matching_variant(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """Reads whose bases at all diagnostic sites (family, variant, pos, base) match exactly one
    variant; pairs has read_id, family, ref_pos, base."""
    need = sites.groupBy("family", "variant").agg(F.count("*").alias("need"))
    s = sites.select("family", "variant", F.col("pos").alias("ref_pos"), F.col("base").alias("want"))
    hits = pairs.join(s, ["family", "ref_pos"]).where("base = want").groupBy("read_id", "family", "variant").agg(F.count("*").alias("n"))
    full = hits.join(need, ["family", "variant"]).where("n = need")
    return full.groupBy("read_id").agg(F.count("*").alias("k"), F.min("variant").alias("variant")).where("k = 1").drop("k")


def annotate_reads(alignments: DataFrame, min_identity: float = 0.9, lead: int = LEAD, tail: int = TAIL, inner: int = 15) -> DataFrame:
    """read_id, fragment, class_code, rle of the reads that pass the gates. alignments has seq, mv, ts, ns,
    flag, mapq, is_split, pos, cigar, ref_len and class_code."""
    good = with_region_identity(gates(alignments, lead, tail, inner), lead, tail).where(F.col("region_identity") >= min_identity)
    return good.select("read_id", "fragment", "class_code", signal_runs(label_stretches(lead, tail)).alias("rle"))


def annotated_per_class(annotations: DataFrame) -> DataFrame:
    """A33."""
    return annotations.groupBy("class_code").agg(F.count("*").alias("reads"))
