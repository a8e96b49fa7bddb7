"""Row types of the logical tables, as Spark DDL."""

SIGNALS = "read_id string, signal array<float>"
SCORES = "read_id string, num_chunks int, chunk_size int, classification array<float>, segmentation array<array<float>>, fragmentation array<float>"
CALLS = "read_id string, top3 array<int>, region struct<start: int, end: int>, fragmented boolean, num_chunks int, chunk_size int"
CIGAR = "array<struct<op: int, len: int>>"
READS = "read_id string, seq string, qual string, mv array<int>, ts int, ns bigint, is_split boolean"
REFS = "ref_idx int, ref_name string, seq string, len int"
ALIGNMENTS = f"{READS}, flag int, ref_idx int, ref_name string, pos int, mapq int, cigar {CIGAR}, ed int, predicted_fragment boolean, fragment boolean, swapped boolean, rescue_rank int"
RUN_METADATA = (
    "run_id string, chunk_size int, max_seq_len int, model_type string, model_name string, num_classification_classes int, num_segmentation_classes int, "
    "label_names map<string, string>, batch_size int, device string, float_dtype string, timestamp string, model_checkpoint string, pod5_paths array<string>, "
    "num_reads_processed bigint, total_inference_time double"
)
#: CIGAR operation codes, as SAM numbers them. ALIGNED is a match or a mismatch, told by comparing bases (cigar.resolve_aligned).
ALIGNED, INSERTION, DELETION, SKIPPED, SOFT_CLIP, HARD_CLIP, PADDING, MATCH, MISMATCH = range(9)
LETTERS = "MIDNSHP=X"
#: Operations that use up read bases, that use up reference bases, that cover reference bases (a skipped stretch
#: covers none), and that use up neither.
ON_READ, ON_REF = (ALIGNED, INSERTION, SOFT_CLIP, MATCH, MISMATCH), (ALIGNED, DELETION, SKIPPED, MATCH, MISMATCH)
COVERS, UNPLACED = (ALIGNED, DELETION, MATCH, MISMATCH), (HARD_CLIP, PADDING)
