"""SQL functions for a session: the library's expressions under names that SQL texts can use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from huetide.functions.color import TO_CONE, TO_LAB


def _sum(weights: tuple[float, ...], values: list[str]) -> str:
    return "(" + " + ".join(f"({w}D) * {v}" for w, v in zip(weights, values, strict=True)) + ")"


_DIGITS = "upper(regexp_replace(trim(h), '^#+', ''))"
_SIX = f"CASE length({_DIGITS}) WHEN 3 THEN regexp_replace({_DIGITS}, '(.)', '$1$1') ELSE {_DIGITS} END"
_CHANNELS = [f"CAST(conv(substring(d, {k}, 2), 16, 10) AS DOUBLE) / 255" for k in (1, 3, 5)]
_LIGHT = ", ".join(f"'l{k}', CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE power(({c} + 0.055) / 1.055, 2.4) END" for k, c in enumerate(_CHANNELS))
_CONES = ", ".join(f"'c{k}', cbrt({_sum(w, ['x.l0', 'x.l1', 'x.l2'])})" for k, w in enumerate(TO_CONE))
_LAB = ", ".join(f"'{n}', {_sum(w, ['c.c0', 'c.c1', 'c.c2'])}" for n, w in zip("lab", TO_LAB, strict=True))
_LONG = "greatest(length(a), length(b))"
_DIGIT = {c: f"CAST(conv(substring(lpad({c}, {_LONG}, '0'), k, 1), 16, 10) AS INT)" for c in "ab"}
_AROUND = "transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> transform(sequence(-1, 1), k -> named_struct('i', i, 'j', j, 'k', k))))"

#: Signature and body; bodies are SQL expressions, so they are optimised with the query that uses them.
FUNCTIONS = {
    "slug(s STRING) RETURNS STRING": "trim(BOTH '-' FROM regexp_replace(lower(s), '[^a-z0-9]+', '-'))",
    "hex_of(r BIGINT, g BIGINT, b BIGINT) RETURNS STRING": "concat('#', lpad(hex(r), 2, '0'), lpad(hex(g), 2, '0'), lpad(hex(b), 2, '0'))",
    "linear_channel(c DOUBLE) RETURNS DOUBLE": "CASE WHEN c / 255 <= 0.04045 THEN c / 255 / 12.92 ELSE power((c / 255 + 0.055) / 1.055, 2.4) END",
    "colour_distance(l1 DOUBLE, a1 DOUBLE, b1 DOUBLE, l2 DOUBLE, a2 DOUBLE, b2 DOUBLE) RETURNS DOUBLE": "sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2))",
    # 3 or 6 digits with or without #, null if it isn't a colour; arrays of one give each step's values a name, so that none is worked out again
    "hex_to_oklab(h STRING) RETURNS STRUCT<l: DOUBLE, a: DOUBLE, b: DOUBLE>": f"CASE WHEN {_DIGITS} RLIKE '^([0-9A-F]{{3}}|[0-9A-F]{{6}})$' THEN transform(transform(transform(array({_SIX}), d -> named_struct({_LIGHT})), x -> named_struct({_CONES})), c -> named_struct({_LAB}))[0] END",
    # bits in which two hexadecimal numbers differ, the shorter one filled with zeros
    "hash_distance(a STRING, b STRING) RETURNS INT": f"CASE WHEN {_LONG} > 0 THEN aggregate(sequence(1, {_LONG}), 0, (n, k) -> n + bit_count({_DIGIT['a']} ^ {_DIGIT['b']})) END",
    "url_host(url STRING) RETURNS STRING": "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))",
}
#: Functions that give tables: the cell of a grid that a point lies in, and the 26 around.
TABLES = {
    "explode_neighbours(x DOUBLE, y DOUBLE, z DOUBLE, width DOUBLE) RETURNS TABLE(cx BIGINT, cy BIGINT, cz BIGINT)": "SELECT CAST(floor(x / width) AS BIGINT) + d.i, CAST(floor(y / width) AS BIGINT) + d.j, CAST(floor(z / width) AS BIGINT) + d.k "
    f"FROM (SELECT explode(flatten(flatten({_AROUND}))) AS d)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for signature, body in (FUNCTIONS | TABLES).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
