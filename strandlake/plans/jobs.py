"""Queries of the alignment, annotation, source, scoring and streaming families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import scoring
from ..operators import align, annotate, compare
from ..sources import tables as src
from ..session import work_dir
from ..streaming import reads as stream
from . import bindings as b
from .statistics import rounded

QUERIES: dict = {}
SQL: dict = {}


def simple(name: str, make, sql: str | None = None, places: int = 5) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir), places)
    if sql:
        SQL[name] = sql


# Alignment: references are the letters of benchmark texts; a read holds a reference with an edit, between
# flanks made from the digest of a document.
ACGT = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
HEX = ("0123456789abcdef", "ACGTACGTACGTACGT")
_dna = lambda c: F.translate(F.regexp_replace(F.lower(F.col(c)), "[^a-z]", ""), *ACGT)
_SQL_DNA = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{ACGT[0]}', '{ACGT[1]}')"


def refs(spark, sf_dir):
    items = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("ref_idx"), _dna("text").alias("seq"))
    return items.select("ref_idx", F.concat(F.lit("ref"), F.col("ref_idx").cast("string")).alias("ref_name"), "seq", F.length("seq").alias("len"))


def reads(spark, sf_dir):
    """Every document gives a read; its class is doc_id modulo the number of references, every fifth read is
    called wrong at first."""
    classes = b.table(spark, sf_dir, "benchmark").count()
    own = F.translate(F.sha2(F.coalesce("text", F.lit("")), 256), *HEX)
    docs = b.table(spark, sf_dir, "documents").select("doc_id", own.alias("own"), (F.col("doc_id") % classes).cast("int").alias("ref_idx"))
    rows = docs.join(refs(spark, sf_dir).select("ref_idx", F.col("seq").alias("ref")), "ref_idx")
    at = (F.col("doc_id") % 30 + 20).cast("int")
    body = F.concat(F.substring(F.col("ref"), F.lit(1), at), F.substring("own", 7, 1), F.substring(F.col("ref"), at + 2 + (F.col("doc_id") % 2).cast("int"), F.length("ref")))
    head, tail = F.substring(F.col("own"), F.lit(1), (F.col("doc_id") % 9 + 3).cast("int")), F.substring(F.col("own"), F.lit(15), (F.col("doc_id") % 7 + 2).cast("int"))
    rows = rows.withColumn("seq", F.concat(head, body, tail)).withColumn("tail", F.length(tail)).withColumn("body", F.length(body))
    mv = F.concat(F.array(F.lit(5)), F.flatten(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.when(i % 4 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1))))))
    rows = rows.withColumn("mv", mv).withColumn("ts", F.lit(10))
    p = align.base_positions("mv", "ts")
    region = ar.let(p, lambda x: F.struct(x[F.col("tail")].alias("start"), (x[F.col("tail") + F.col("body") - 1] + 4).alias("end")))
    other = (F.col("ref_idx") + 1) % classes
    top3 = F.when(F.col("doc_id") % 5 == 0, F.array(other, F.col("ref_idx"), (other + 1) % classes)).otherwise(F.array(F.col("ref_idx"), other, (other + 1) % classes))
    lost = F.col("doc_id") % 17 == 0
    region = F.when(lost, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))).otherwise(region)
    return rows.select(F.col("doc_id").cast("string").alias("read_id"), "seq", "mv", "ts", F.lit(5000).cast("bigint").alias("ns"), (F.col("doc_id") % 23 == 0).alias("is_split"), region.alias("region"), top3.alias("top3"), F.col("ref_idx").alias("truth"))


def _text(c):
    names = {0: "M", 1: "I", 2: "D", 4: "S", 7: "=", 8: "X"}
    letter = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))
    return F.array_join(F.transform(c, lambda e: F.concat(e["len"].cast("string"), letter[e["op"]])), "")


_SQL_POSITIONS = "list_transform(list_filter(range(1, len(mv)), lambda i: mv[i + 1] = 1), lambda i: i * mv[1] + ts)"
_MOVES = """m as (select """ + b.LINE_ID + """ as read_id, repeat('ACGTTGCA', 3)[1:10 + (l_partkey % 9)::int] as seq, 10 as ts, (l_suppkey % 40 + 5)::int as lo, (l_suppkey % 40 + 5 + l_quantity)::int as hi,
  list_prepend(5, flatten(list_transform(range(1, 11 + (l_partkey % 9)::int), lambda i: case when i % 3 = 0 then [1, 0] else [1] end))) as mv from lineitem)"""


def _moves(spark, sf_dir):
    items = b.dealt_lines(spark, sf_dir)
    n = (10 + F.col("l_partkey") % 9).cast("int")
    mv = F.concat(F.array(F.lit(5)), F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i % 3 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1))))))
    lo = (F.col("l_suppkey") % 40 + 5).cast("int")
    return items.select(b.line_id().alias("read_id"), F.substring(F.repeat(F.lit("ACGTTGCA"), 3), F.lit(1), n).alias("seq"), F.lit(10).alias("ts"), lo.alias("lo"), (lo + F.col("l_quantity").cast("int")).alias("hi"), mv.alias("mv"))


simple("p7_base_positions", lambda s, d: _moves(s, d).select("read_id", F.posexplode(align.base_positions("mv", "ts")).alias("k", "p")), f"with {_MOVES} select read_id, unnest(range(0, len(p)))::int as k, unnest(p)::int as p from (select read_id, {_SQL_POSITIONS} as p from m)")
simple(
    "p8_cut_region",
    lambda s, d: _moves(s, d).select("read_id", align.cut_region(F.col("seq"), align.base_positions("mv", "ts"), F.greatest("lo", "ts"), F.col("hi")).alias("c")).select("read_id", "c.sub", F.when(F.length("c.sub") > 0, F.col("c.three_clip")).alias("three_clip"), F.when(F.length("c.sub") > 0, F.col("c.five_clip")).alias("five_clip")),
    f"with {_MOVES}, q as (select read_id, seq, hi, greatest(lo, ts) as s, {_SQL_POSITIONS} as p from m), r as (select *, greatest(len(list_filter(p, lambda x: x < s)) - 1, 0) as a, len(list_filter(p, lambda x: x <= hi)) as z, len(list_filter(p, lambda x: x < s)) < len(p) and len(list_filter(p, lambda x: x <= hi)) > 0 as hit from q), "
    "t as (select *, case when hit then reverse(reverse(seq)[(a + 1)::int:z::int]) else '' end as sub from r) select read_id, sub, (case when sub <> '' then a end)::int as three_clip, (case when sub <> '' then greatest(0, len(p) - z) end)::int as five_clip from t",
)
QUERIES["l1_glocal"] = lambda s, d: _edits(align.glocal(_pairs(s, d), "seq", "ref_seq"))
QUERIES["l2_local"] = lambda s, d: _edits(align.local(_pairs(s, d), "seq", "ref_seq"))


def _pairs(spark, sf_dir):
    r = reads(spark, sf_dir)
    return r.join(refs(spark, sf_dir).select(F.col("ref_idx").alias("truth"), F.col("seq").alias("ref_seq")), "truth").select("read_id", "seq", "ref_seq")


def _edits(aligned):
    from ..functions import cigar as cg

    return aligned.select("read_id", _text(cg.encode("ops")).alias("cigar"), "q_start", "q_end", "r_start", "r_end", "hits")


def _shown(df, *more):
    return rounded(df.select("read_id", "ref_idx", "mapped", "pos", "mapq", "flag", _text("cigar").alias("cigar"), "ed", "fragment", "identity", "matches", *more))


def _calls(r):
    return r.select("read_id", "top3", "region")


QUERIES["l3_align_candidates"] = lambda s, d: (lambda r: _shown(align.align_candidates(align.candidate_rows(r.drop("region", "top3"), _calls(r), refs(s, d), 2)), "rank"))(reads(s, d))
QUERIES["l4_best_of_two"] = lambda s, d: (lambda r: _shown(align.best_of_two(align.align_candidates(align.candidate_rows(r.drop("region", "top3"), _calls(r), refs(s, d), 2))), "rank", "swapped"))(reads(s, d))
QUERIES["l5_rescue"] = lambda s, d: (lambda r: _shown(align.rescue(align.candidate_rows(r.drop("region", "top3"), _calls(r), refs(s, d), 3)), "rescue_rank"))(reads(s, d))
QUERIES["l6_f13_f14_align_reads"] = lambda s, d: (lambda r: _shown(align.with_read_columns(align.align_reads(r.drop("region", "top3"), _calls(r), refs(s, d)), r), "swapped", "rescue_rank"))(reads(s, d))


def s11(spark, sf_dir):
    r = reads(spark, sf_dir)
    path = work_dir(spark)
    aligned = align.align_reads(r.drop("region", "top3"), _calls(r), refs(spark, sf_dir), secondary=False)
    align.sorted_for_output(aligned.where("mapped")).write.parquet(path)
    return spark.read.parquet(path).groupBy("ref_idx").agg(F.count("*").alias("reads"), F.min("pos").alias("first"), F.max("pos").alias("last"))


QUERIES["s11_sorted_sink"] = s11


def candidates(spark, sf_dir):
    r = reads(spark, sf_dir)
    return align.candidate_rows(r.drop("region", "top3"), _calls(r), refs(spark, sf_dir), 3).groupBy("ref_idx", "rank").agg(F.count("*").alias("reads"))


simple(
    "j1_j2_f3_candidates",
    candidates,
    """with n as (select count(*) as k from benchmark), r as (select doc_id, (doc_id % k)::int as c, k from documents, n where doc_id % 23 <> 0 and doc_id % k in (select item_id from benchmark)),
  t as (select unnest(case when doc_id % 5 = 0 then [(c + 1) % k, c, (c + 2) % k] else [c, (c + 1) % k, (c + 2) % k] end) as ref_idx, unnest([1, 2, 3]) as rank from r)
  select ref_idx::int as ref_idx, rank, count(*) as reads from t where ref_idx in (select item_id from benchmark) group by ref_idx, rank""",
)

# Annotation on the made alignments, with short adapters.
LEAD, TAIL, SPAN, LENGTH = 6, 8, 8, 36


def annotated_input(spark, sf_dir, rows=b.resolved):
    """Gates and labels only ask which sides an operation uses up, so for them rows may have M."""
    rows = rows(spark, sf_dir)
    n = F.length("seq")
    mv = F.concat(F.array(F.lit(5)), F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i % 3 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1))))))
    return rows.select("read_id", "label", "flag", "mapq", "is_split", F.lit(1000).cast("bigint").alias("ns"), "pos", "cigar", F.lit(LENGTH).alias("ref_len"), (F.col("ref_idx") - 60).alias("class_code"), "seq", mv.alias("mv"), (F.col("mapq") + 3).alias("ts"))


_REF_END = "pos + coalesce(list_sum(list_transform(list_filter(cigar, lambda o: o.op in (0, 2, 3, 7, 8)), lambda o: o.len)), 0)"
_GATES = f"fit as (select *, {_REF_END} as ref_end, pos > {LEAD} or {_REF_END} < {LENGTH - TAIL} as fragment, ref_idx - 60 as class_code from alignments where flag & 2308 = 0 and mapq <> 0 and not is_split and abs(greatest(pos, {LEAD}) - least({_REF_END}, {LENGTH - TAIL})) >= {SPAN})"
simple("f8_f9_f11_gates", lambda s, d: annotate.gates(annotated_input(s, d, b.alignments), LEAD, TAIL, SPAN).select("read_id", "ref_end", "fragment"), f"with {b.ALIGNMENTS}, {_GATES} select read_id, ref_end, fragment from fit")
_LABELS = f"""{b.PAIRS}, {_GATES}, along as (select p.read_id, p.query_pos, p.ref_pos, fit.class_code, max((p.ref_pos = fit.pos)::int) over w as seen, max((p.ref_pos >= fit.ref_end - 1)::int) over w as past, max(case when p.ref_pos >= 0 then p.ref_pos end) over w as before from pairs p join fit using (read_id) where p.query_pos >= 0 window w as (partition by p.read_id order by p.query_pos rows unbounded preceding)),
  labels as (select read_id, query_pos, case when ref_pos < 0 then case when seen = 0 then 2 when past = 1 then 1 when before < {LEAD} then 2 when before > {LENGTH - TAIL} then 1 else class_code end else case when ref_pos < {LEAD} then 2 when past = 1 or ref_pos > {LENGTH - TAIL} then 1 else class_code end end as label from along)"""
simple("p18_w7_base_labels", lambda s, d: annotate.base_labels(annotate.gates(annotated_input(s, d, b.alignments), LEAD, TAIL, SPAN), LEAD, TAIL).groupBy("read_id", "label").agg(F.count("*").alias("bases"), F.min("query_pos").alias("first")), f"with {_LABELS} select read_id, label, count(*) as bases, min(query_pos) as first from labels group by read_id, label")
_REGION = f"good as (select read_id, (count(*) filter (where op = 7))::double / count(*) as region_identity from pairs where op in (1, 2, 7, 8) and case when op = 1 then after_pos else ref_pos end between {LEAD} and {LENGTH - TAIL} group by read_id)"
simple("p21_f10_region_identity", lambda s, d: annotate.with_region_identity(annotated_input(s, d), LEAD, TAIL).where("region_identity >= 0.8").select("read_id", "region_identity"), f"with {b.PAIRS}, {_REGION} select read_id, round(region_identity, 5) as region_identity from good where region_identity >= 0.8")
_RUNS = f""", moves as (select read_id, mapq + 3 as ts, class_code, fragment, coalesce(list_sum(list_transform(list_filter(cigar, lambda o: o.op in (0, 1, 4, 7, 8)), lambda o: o.len)), 0)::int as bases from fit join good using (read_id) where region_identity >= 0.9),
  places as (select read_id, ts, bases, k, ts + (k + k // 3) * 5 as p, ts + (bases + bases // 3) * 5 as total from (select *, unnest(range(0, bases))::int as k from moves)),
  told as (select places.read_id, k, label, coalesce(lead(p) over (partition by places.read_id order by k), total) - p as n from places join labels on labels.read_id = places.read_id and labels.query_pos = bases - 1 - k union all select read_id, -1, 0, p from places where k = 0 and p > 0),
  marked as (select *, coalesce((lag(label) over (partition by read_id order by k) <> label)::int, 0) as new from told), runs as (select read_id, label, n, (sum(new) over (partition by read_id order by k rows unbounded preceding))::int as run from marked)"""
simple(
    "l8_p19_annotate_reads",
    lambda s, d: ar.once(annotate.annotate_reads(annotated_input(s, d), 0.9, LEAD, TAIL, SPAN), "rle", F.col("rle")).select("read_id", "fragment", F.posexplode("rle").alias("run", "r")).select("read_id", "fragment", "run", "r.label", "r.n"),
    f"with {_LABELS}, {_REGION}{_RUNS} select runs.read_id, moves.fragment, run, label, sum(n)::int as n from runs join moves using (read_id) group by all",
)
simple("a33_annotated_per_class", lambda s, d: annotate.annotated_per_class(annotate.annotate_reads(annotated_input(s, d), 0.9, LEAD, TAIL, SPAN)), f"with {_LABELS}, {_REGION}{_RUNS} select class_code, count(*) as reads from moves group by class_code")
simple(
    "p22_display_names",
    lambda s, d: b.table(s, d, "customer").select("c_custkey", annotate.display_name(F.concat(F.lit("run_x_a-"), F.regexp_replace("c_name", "#", "-"), F.lit("-d-e"))).alias("n")).select("c_custkey", "n.encoder", "n.decoder"),
    "select c_custkey, split_part(t, '-', 1) || '-' || split_part(t, '-', 2) as encoder, split_part(t, '-', 3) || '-' || split_part(t, '-', 4) as decoder from (select c_custkey, split_part('run_x_a-' || replace(c_name, '#', '-') || '-d-e', '_', -1) as t from customer)",
)
# Variants: names of parts as reads and their types as variants, in families by size.
_V = "x as (select p_partkey::varchar as read_id, p_size % 2 as family, lower(p_name) as seq from part), v as (select distinct p_size % 2 as family, p_type as variant, lower(p_type) as seq from part)"


def _part_names(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("read_id"), (F.col("p_size") % 2).alias("family"), F.lower("p_name").alias("seq"))


def _part_types(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select((F.col("p_size") % 2).alias("family"), F.col("p_type").alias("variant"), F.lower("p_type").alias("seq")).distinct()


simple("l7_p23_nearest_variant", lambda s, d: annotate.nearest_variant(_part_names(s, d), _part_types(s, d)), f"with {_V}, d as (select read_id, variant, levenshtein(x.seq, v.seq) as dist from x join v using (family)), m as (select *, min(dist) over (partition by read_id) as least from d) select read_id, min(variant) as variant, min(dist)::int as dist from m where dist = least group by read_id having count(*) = 1")
#: Diagnostic places of a variant, from 0.
SITES = (0, 2)


def matching(spark, sf_dir):
    bases = lambda df, *keep: df.select(*keep, "family", F.posexplode(F.split(F.translate(F.regexp_replace("seq", "[^a-z]", ""), *ACGT), "")).alias("pos", "base")).where("base <> ''")
    r = bases(_part_names(spark, sf_dir), "read_id").withColumnRenamed("pos", "ref_pos")
    return annotate.matching_variant(r, bases(_part_types(spark, sf_dir), "variant").where(F.col("pos").isin(*SITES)))


_SITE = f"translate(regexp_replace({{}}.seq, '[^a-z]', '', 'g'), '{ACGT[0]}', '{ACGT[1]}')"
simple("l7_matching_variant", matching, f"with {_V} select read_id, min(variant) as variant from x join v using (family) where " + " and ".join(f"{_SITE.format('x')}[{k + 1}] = {_SITE.format('v')}[{k + 1}]" for k in SITES) + " group by read_id having count(*) = 1")

# Sources and sinks
simple("s1_scan_signals", lambda s, d: src.scan(s, f"{d}/embeddings.parquet", "vec_id bigint, embedding array<float>").select("vec_id", F.size("embedding").alias("samples")), "select vec_id, len(embedding)::int as samples from embeddings")
simple("s2_s8_selected_reads", lambda s, d: src.select_reads(b.signals(s, d), b.table(s, d, "labels").select(F.col("doc_id").cast("string").alias("read_id"))).select("read_id"), "select vec_id::varchar as read_id from embeddings where vec_id in (select doc_id from labels)")
simple("s3_recursive_scan", lambda s, d: src.scan(s, d, "event_id bigint, event_type string", "events.parquet", True).groupBy("event_type").agg(F.count("*").alias("records"), F.max("event_id").alias("last")), "select event_type, count(*) as records, max(event_id) as last from events group by event_type")
simple("s8_file_of_read", lambda s, d: src.with_file(src.scan(s, f"{d}/events.parquet")).groupBy("file").agg(F.count_distinct("event_id").alias("reads")), "select 'events.parquet' as file, count(distinct event_id) as reads from events")


def s8(spark, sf_dir):
    """Ten ids spread over the archive of events."""
    events, path = b.table(spark, sf_dir, "events"), work_dir(spark)
    src.write_indexed(events, path, key="event_id")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    ids = [low + (high - low) * k // 9 for k in range(10)]
    return src.look_up(spark, path, ids, "event_id").select("event_id", "event_type")


simple("s8_indexed_look_up", s8, "with r as (select min(event_id) as low, max(event_id) as high from events) select event_id, event_type from events where event_id in (select low + (high - low) * k // 9 from r, range(10) t(k))")


def s11_interval(spark, sf_dir):
    """Lines as alignments at the place of their part, one reference per flag."""
    path = work_dir(spark)
    rows = b.table(spark, sf_dir, "lineitem").select(b.line_id().alias("read_id"), F.ascii("l_returnflag").alias("ref_idx"), F.col("l_partkey").cast("int").alias("pos"), (F.col("l_partkey") + F.col("l_quantity")).cast("int").alias("ref_end"))
    src.write_coordinate_sorted(rows, path, 64)
    return src.read_interval(spark, path, ord("N"), 50, 90)


simple("s11_interval_scan", s11_interval, f"select {b.LINE_ID} as read_id, ascii(l_returnflag) as ref_idx, l_partkey::int as pos, (l_partkey + l_quantity)::int as ref_end from lineitem where l_returnflag = 'N' and l_partkey < 90 and l_partkey + l_quantity > 50")


def s4(spark, sf_dir):
    rows = b.alignments(spark, sf_dir).withColumn("ref_name", F.col("label")).withColumn("seq", F.lit("ACGT"))
    path = work_dir(spark)
    tags = F.concat(F.col("value"), F.lit("\tmv:B:c,5,1,0,1\tts:i:10\tns:i:4000"))
    src.to_sam(rows).select(tags.alias("value")).write.text(path)
    parsed = src.read_sam(spark, path)
    return parsed.select("read_id", "flag", "ref_name", "pos", "mapq", F.size("cigar").alias("parts"), F.element_at("cigar", 1)["op"].alias("op"), F.element_at("mv", 1).alias("stride"), "ts", "ns", "is_split")


simple("s4_sam_scan", s4, f"with {b.ALIGNMENTS} select read_id, flag, label as ref_name, pos, mapq, len(cigar)::int as parts, cigar[1].op as op, 5 as stride, 10 as ts, 4000::bigint as ns, false as is_split from alignments")


def s5(spark, sf_dir):
    path = work_dir(spark)
    ordered = refs(spark, sf_dir).repartitionByRange("ref_idx").sortWithinPartitions("ref_idx")
    lines = ordered.select(F.concat(F.lit(">"), "ref_name", F.lit(" made\n"), F.substring("seq", 1, 50), F.lit("\n"), F.expr("substring(seq, 51)")))
    lines.write.text(path)  # files are in order, and so are their records
    return src.read_fasta(spark, path)


simple("s5_s15_fasta_scan", s5, f"select (row_number() over (order by item_id) - 1)::int as ref_idx, 'ref' || item_id as ref_name, {_SQL_DNA} as seq, len({_SQL_DNA})::int as len from benchmark")
simple("s6_union_results", lambda s, d: src.union_results(b.scores(s, d), ar.compress(b.scores(s, d))).groupBy("kind").agg(F.count("*").alias("records"), F.count("classification").alias("full"), F.count("top3").alias("summaries")), "select 0 as kind, count(*) as records, count(*) as full, 0::bigint as summaries from embeddings union all select 1, count(*), 0, count(*) from embeddings")


def s7(spark, sf_dir):
    """Every event stands for an archive."""
    events = b.table(spark, sf_dir, "events")
    meta = events.select(F.col("event_id").cast("string").alias("run_id"), F.lit("m").alias("model_name"), F.lit("t").alias("model_type"), F.lit(54).alias("chunk_size"), F.when(F.col("event_id") % 2 == 0, "float16").otherwise("float32").alias("float_dtype"), (F.col("user_id") % 7).alias("num_classes"))
    checked = src.require_compatible(meta)
    return src.check_metadata(checked).crossJoin(checked.agg(F.sum("num_classification_classes").alias("classes")))


simple("s7_metadata_guard", s7, "select 1::bigint as model_name, 1::bigint as model_type, 1::bigint as chunk_size, count(distinct event_id % 2) as float_dtype, sum(user_id % 7)::bigint as classes from events")
simple("s9_archive_summary", lambda s, d: src.archive_summary(b.table(s, d, "events").withColumn("file", F.col("event_type"))), "select event_type as file, count(*) as records from events group by rollup (event_type)")


def s10(spark, sf_dir):
    path = work_dir(spark)
    shards = src.with_shards(b.signals(spark, sf_dir), "read_id", 100)
    shards.write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("records")).select(F.col("shard").cast("bigint").alias("shard"), "records")


simple("s10_sharded_sink", s10, "select n // 100 as shard, count(*) as records from (select row_number() over (order by vec_id) - 1 as n from embeddings) group by 1")


def s12(spark, sf_dir):
    path = work_dir(spark)
    src.write_report(compare.run_summary(b.side(spark, sf_dir, 1)).select("mean_identity", "mean_length"), path, 4)
    return spark.read.option("sep", "\t").option("header", "true").csv(path)


simple("s12_report_sink", s12, f"with {b.SIDES} select printf('%.4f', avg(identity)) as mean_identity, printf('%.4f', avg(length)) as mean_length from a")


def s13(spark, sf_dir):
    path = work_dir(spark)
    found = annotate.annotate_reads(annotated_input(spark, sf_dir), 0.9, LEAD, TAIL, SPAN)
    codes = b.table(spark, sf_dir, "lineitem").select("l_returnflag").distinct().select((F.ascii("l_returnflag") - 60).alias("code"), F.col("l_returnflag").alias("name"))
    src.write_annotations(codes, found, path)
    notes = spark.read.parquet(f"{path}/annotations")
    return notes.join(spark.read.parquet(f"{path}/annotation_codes"), F.col("class_code") == F.col("code")).groupBy("name").agg(F.count("*").alias("reads"))


simple("s13_annotation_sink", s13, f"with {_LABELS}, {_REGION}{_RUNS} select chr(class_code + 60) as name, count(*) as reads from moves group by class_code")


def s14(spark, sf_dir):
    """Brands as classes, written as JSON and read back as dimensions."""
    names = b.table(spark, sf_dir, "part").select("p_brand").distinct()
    pairs = names.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", F.lower("p_brand"))))).alias("value"))  # a dimension
    order = names.agg(F.to_json(F.sort_array(F.collect_list("p_brand"))).alias("value"))
    return src.label_map(pairs).withColumnRenamed("label", "shown").join(src.label_order(order).withColumnRenamed("label", "ref_name"), "ref_name")


simple("s14_j3_label_dimensions", s14, "select ref_name, lower(ref_name) as shown, (row_number() over (order by ref_name) - 1)::int as ord from (select distinct p_brand as ref_name from part)")

# Scoring
_T = [[(1.0 if (i + k) % 3 == 0 else -0.5) for i in range(64)] for k in range(4)]


def u1(spark, sf_dir):
    import numpy as np

    templates = np.array(_T)

    def fn(padded, lengths):
        return {"classification": padded @ templates[:, : padded.shape[1]].T, "segmentation": padded.reshape(len(padded), -1, 4)}

    scored = scoring.score_reads(b.signals(spark, sf_dir), fn, 128, 4, save_raw=False)
    return scored.select("read_id", F.element_at("top3", 1).alias("class_1"), "num_chunks", F.col("region.start").alias("region_start"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * case when (i - 1 + {k}) % 3 = 0 then 1.0 else -0.5 end))"
_ALL = "[" + ", ".join(_DOT.format(k=k) for k in range(4)) + "]"
_FIRST4 = "list_position(list_transform(range(16), lambda i: (list_position(embedding[i * 4 + 1:i * 4 + 4], list_max(embedding[i * 4 + 1:i * 4 + 4])) - 1)::int), 0)"
# Classes 0 and 3 share a template, and a float product cannot tell them apart: both count as 0.
simple("u1_score_reads", lambda s, d: u1(s, d).withColumn("class_1", F.col("class_1") % 3), f"select vec_id::varchar as read_id, ((list_position(t, list_max(t)) - 1) % 3)::int as class_1, 16 as num_chunks, case when coalesce(f, 0) > 0 then (f - 1) * 4 else -1 end as region_start from (select vec_id, {_ALL} as t, {_FIRST4} as f from embeddings)")
simple("u1_template_scores", lambda s, d: b.signals(s, d).select("read_id", F.posexplode(scoring.template_scores("signal", _T)).alias("k", "v")), f"select read_id, unnest([0, 1, 2, 3]) as k, round(unnest(t), 5) as v from (select vec_id::varchar as read_id, {_ALL} as t from embeddings)")


# Streaming: run to the end of what is there.
def _finish(df, mode="append"):
    spark = df.sparkSession
    out, state = work_dir(spark), work_dir(spark)

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def r1(spark, sf_dir):
    arriving = stream.arriving(spark, f"{sf_dir}/embeddings.parquet*", "vec_id bigint, embedding array<float>")
    signals = arriving.select(F.col("vec_id").cast("string").alias("read_id"), F.col("embedding").cast("array<double>").alias("signal"))
    done = _finish(stream.preprocess(signals, 7, 6))
    return done.select("read_id", "n_tokens", F.element_at("signal", 1).alias("first"), F.element_at("signal", 42).alias("last"))


_Z = "with x as (select vec_id::varchar as read_id, list_transform(embedding[1:42], lambda v: v::double) as s from embeddings), y as (select *, list_sum(s) / 42 as m, list_sum(list_transform(s, lambda v: v * v)) / 42 as q from x)"
simple("r1_stream_preprocess", r1, f"{_Z} select read_id, 6 as n_tokens, round((s[1] - m) / sqrt(q - m * m + 1e-8), 5) as first, round((s[42] - m) / sqrt(q - m * m + 1e-8), 5) as last from y")


def _events(spark, sf_dir):
    return stream.arriving(spark, f"{sf_dir}/events.parquet*", spark.read.parquet(f"{sf_dir}/events.parquet").schema)


def r2(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.concat_ws("-", "user_id", "event_type").alias("read_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _finish(stream.one_result_per_read(rows, "ts", "10000 days")).select("read_id")


simple("r2_one_result_per_read", r2, "select distinct user_id::varchar || '-' || event_type as read_id from events")


def r3(spark, sf_dir):
    counted = _finish(stream.class_counts(_events(spark, sf_dir).withColumnRenamed("event_type", "label")), "complete")
    return counted.groupBy("label").agg(F.max("reads").alias("reads"))


simple("r3_running_class_counts", r3, "select event_type as label, count(*) as reads from events group by event_type")


def r4(spark, sf_dir):
    out, state = work_dir(spark), work_dir(spark)
    stream.write_shards(_events(spark, sf_dir), out, state, 500).awaitTermination()
    written = spark.read.parquet(out).select("event_type", F.col("_metadata.file_path").alias("file"))
    per = written.groupBy("file").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("records"), (F.max("n") <= 500).alias("within"))


def r4_exact(spark, sf_dir):
    out, state = work_dir(spark), work_dir(spark)
    events = _events(spark, sf_dir).select("event_id", "event_type")
    stream.write_exact_shards(events, out, state, 500, "event_id").awaitTermination()
    return stream.read_shards(spark, out, "event_id bigint, event_type string").groupBy("shard").agg(F.count("*").alias("records"))


simple("r4_exact_shards", r4_exact, "select shard, count(*) as records from (select (row_number() over (order by event_id) - 1) // 500 as shard from events) group by shard")
simple("r4_stream_shards", r4, "select count(*)::bigint as records, true as within from events")
