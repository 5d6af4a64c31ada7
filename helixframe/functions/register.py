"""The same expressions as SQL functions of a session, scalar ones and table functions.

Bodies are SQL, so that Catalyst inlines them; a test holds each against the
Column builder of the same meaning.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_BRACKET = r"[\\[\\]]([^\\[\\]]*):(\\d+)[\\[\\]]"
_ALLELES = r"split(substring_index(genotype, ':', 1), '[/|]')"
_ON_REF, _ON_QUERY = "'M', 'D', 'N', '=', 'X'", "'M', 'I', 'S', '=', 'X'"

FUNCTIONS = {
    # sequences, paths and scores
    "reverse_complement(seq STRING) RETURNS STRING": "CASE WHEN seq RLIKE '[^ACGTNacgtn]' THEN raise_error('not a nucleotide') ELSE reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) END",
    "region_text(contig STRING, start BIGINT, stop BIGINT) RETURNS STRING": "concat(contig, ':', start, '-', stop)",
    "quantized(w DOUBLE, q DOUBLE) RETURNS DOUBLE": "CASE WHEN q <> 0 THEN round(w / q) * q ELSE w END",
    "length_bin(n BIGINT) RETURNS INT": "cast(floor(log2(n + 1)) AS INT)",
    "alignment_score(unmatched DOUBLE) RETURNS INT": "cast(round(unmatched * 1000) + 1 AS INT)",
    "alignment_identity(m BIGINT, x BIGINT, i BIGINT, d BIGINT) RETURNS DOUBLE": "try_divide(cast(m AS DOUBLE), m + x + i + d)",
    "identity_bin(i DOUBLE) RETURNS INT": "CASE WHEN i > 1 THEN cast(raise_error('identity over 1') AS INT) WHEN i = 1 THEN 5 ELSE cast(floor(least(5D, greatest(0D, -log2(greatest(1e-9D, 1 - i)) - 2))) AS INT) END",
    "zero_padded(n BIGINT, width INT) RETURNS STRING": "lpad(cast(n AS STRING), width, '0')",
    "flipped_path(path STRING) RETURNS STRING": r"array_join(transform(reverse(regexp_extract_all(path, '([<>][^<>]+)', 1)), s -> concat(CASE WHEN left(s, 1) = '>' THEN '<' ELSE '>' END, substr(s, 2))), '')",
    "canonical_path(path STRING) RETURNS STRING": "least(path, flipped_path(path))",
    # records
    "info_value(info STRING, name STRING) RETURNS STRING": "nullif(regexp_extract(concat(';', info), concat(';', name, '=([^;]*)'), 1), '')",
    "is_symbolic_alt(alt STRING) RETURNS BOOLEAN": "alt RLIKE '^<.*>$'",
    "is_missing_alt(alt STRING) RETURNS BOOLEAN": "alt IS NULL OR alt IN ('.', '*', '')",
    "is_precise(info STRING) RETURNS BOOLEAN": "contains(concat(';', info, ';'), ';PRECISE;')",
    "symbolic_tag(alt STRING, stop BIGINT, length BIGINT) RETURNS STRING": "CASE WHEN alt RLIKE '^<.*>$' THEN concat(regexp_replace(alt, '>$', ''), ':artificial:', stop, ':', length, '>') ELSE alt END",
    "symbolic_untag(alt STRING) RETURNS STRING": "regexp_replace(alt, ':artificial:[^>]*>$', '>')",
    "ploidy(contig STRING) RETURNS INT": "CASE WHEN upper(regexp_replace(contig, '^(chr|CHR|Chr)', '')) IN ('X', 'Y', 'M', 'MT') THEN 1 ELSE 2 END",
    # genotypes
    "gt_ploidy(genotype STRING) RETURNS INT": f"CASE WHEN {_ALLELES}[0] = '' THEN 0 ELSE size({_ALLELES}) END",
    "gt_allele(genotype STRING, k INT) RETURNS INT": f"try_cast(try_element_at({_ALLELES}, k) AS INT)",
    "n_ref_calls(genotype STRING) RETURNS INT": f"size(filter({_ALLELES}, x -> x = '0'))",
    "n_alt_calls(genotype STRING) RETURNS INT": f"size(filter({_ALLELES}, x -> x NOT IN ('0', '.', '')))",
    "is_phased(genotype STRING) RETURNS BOOLEAN": "NOT contains(substring_index(genotype, ':', 1), '/')",
    # breakends
    "mate_contig(alt STRING) RETURNS STRING": f"regexp_replace(nullif(regexp_extract(alt, '{_BRACKET}', 1), ''), '^CHR', 'chr')",
    "mate_pos(alt STRING) RETURNS INT": f"try_cast(regexp_extract(alt, '{_BRACKET}', 2) AS INT)",
    "is_single_breakend(alt STRING) RETURNS BOOLEAN": r"NOT alt RLIKE '[\\[\\]]' AND (startswith(alt, '.') OR endswith(alt, '.'))",
    "is_valid_breakend(alt STRING) RETURNS BOOLEAN": rf"(NOT alt RLIKE '[\\[\\]]' AND (startswith(alt, '.') OR endswith(alt, '.'))) OR alt RLIKE '^([A-Za-z.]*){_BRACKET}([A-Za-z.]*)$'",
    "breakend_side(alt STRING) RETURNS INT": "CASE WHEN alt RLIKE '^[A-Za-z]' THEN 1 WHEN alt RLIKE '[A-Za-z]$' THEN 2 ELSE 0 END",
    "mate_side(alt STRING) RETURNS INT": "CASE WHEN contains(alt, ']') THEN 1 WHEN contains(alt, '[') THEN 2 ELSE 0 END",
    "breakend_bases(alt STRING) RETURNS STRING": r"""CASE WHEN alt RLIKE '^[A-Za-z]' THEN substr(regexp_replace(alt, '[\\[\\]][^\\[\\]]*[\\[\\]]|[.]', ''), 2)
        WHEN alt RLIKE '[A-Za-z]$' THEN left(regexp_replace(alt, '[\\[\\]][^\\[\\]]*[\\[\\]]|[.]', ''), length(regexp_replace(alt, '[\\[\\]][^\\[\\]]*[\\[\\]]|[.]', '')) - 1) END""",
}

#: Table functions, for LATERAL joins: a row for each step of a path, operation of a CIGAR, key of an INFO.
TABLES = {
    "path_steps(path STRING) RETURNS TABLE (step INT, node STRING, rev BOOLEAN)": "SELECT pos, substr(s, 2), left(s, 1) = '<' FROM posexplode(regexp_extract_all(path, '([<>][^<>]+)', 1)) AS t(pos, s)",
    "cigar_operations(cigar STRING, ref_start INT) RETURNS TABLE (op_rank INT, op STRING, op_len INT, r0 INT, r1 INT, q0 INT, q1 INT)": f"""
        SELECT k, op, len, cast(ref_start + r - rl AS INT), cast(ref_start + r AS INT), cast(q - ql AS INT), cast(q AS INT) FROM (
            SELECT k, op, len, rl, ql, sum(rl) OVER (ORDER BY k) AS r, sum(ql) OVER (ORDER BY k) AS q FROM (
                SELECT k, op, len, CASE WHEN op IN ({_ON_REF}) THEN len ELSE 0 END AS rl, CASE WHEN op IN ({_ON_QUERY}) THEN len ELSE 0 END AS ql FROM (
                    SELECT k, right(x, 1) AS op, cast(left(x, length(x) - 1) AS INT) AS len FROM posexplode(regexp_extract_all(cigar, '([0-9]+[MIDNSHP=X])', 1)) AS t(k, x))))""",
    "info_fields(info STRING) RETURNS TABLE (name STRING, value STRING)": "SELECT substring_index(p, '=', 1), substr(p, instr(p, '=') + 1) FROM explode(filter(split(info, ';'), p -> instr(p, '=') > 1)) AS t(p)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Creates all functions in the session; their names."""
    every = FUNCTIONS | TABLES
    for head, body in every.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in every]
