"""SQL functions of a session, made of native expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_OPS = "array<struct<op:string,len:bigint>>"

#: Name with parameters, type, expression.
FUNCTIONS = [
    ("cigar_parse(cg STRING)", _OPS, "zip_with(regexp_extract_all(cg, r'([0-9]+)([MIDNSHPX=])', 2), regexp_extract_all(cg, r'([0-9]+)([MIDNSHPX=])', 1), (o, n) -> named_struct('op', o, 'len', cast(n as bigint)))"),
    ("cigar_text(c " + _OPS + ")", "STRING", "array_join(transform(c, x -> concat(cast(x.len as string), x.op)), '')"),
    ("cigar_query_span(c " + _OPS + ")", "BIGINT", "aggregate(c, 0L, (s, x) -> s + if(x.op in ('M', 'I', 'S', '=', 'X'), x.len, 0L))"),
    ("cigar_target_span(c " + _OPS + ")", "BIGINT", "aggregate(c, 0L, (s, x) -> s + if(x.op in ('M', 'D', 'N', '=', 'X'), x.len, 0L))"),
    ("cigar_matches(c " + _OPS + ")", "BIGINT", "aggregate(c, 0L, (s, x) -> s + if(x.op in ('M', '=', 'X'), x.len, 0L))"),
    ("strip_sample(name STRING)", "STRING", "regexp_replace(name, '^id=[^|]*[|]', '')"),
    ("graph_node_id(name STRING)", "BIGINT", "try_cast(regexp_extract(name, '^(?:[^s]*s)?(-?[0-9]+)', 1) as bigint)"),
    ("make_subpath(name STRING, first BIGINT, last BIGINT)", "STRING", "concat(name, ':', cast(first + 1 as string), '-', cast(last as string))"),
    ("reverse_complement(seq STRING)", "STRING", "reverse(translate(seq, 'ACGTUNacgtun', 'TGCAANtgcaan'))"),
    ("ranges_overlap(a BIGINT, b BIGINT, c BIGINT, d BIGINT)", "BOOLEAN", "a < d AND c < b"),
]


def register(spark: SparkSession) -> None:
    for name, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
