"""Vector expressions that stay in the JVM (higher-order array functions, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squared_l2(a, b) -> Column:
    """Sum of squared differences, in double, summed in array order."""
    diff2 = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diff2, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_distance(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - dot(a, b) / (l2_norm(a) * l2_norm(b))


def normalize(a) -> Column:
    """L2-normalised float vector; a zero vector stays zero."""
    n = l2_norm(a)
    return F.transform(_c(a), lambda v: F.when(n > 0, v.cast("double") / n).otherwise(F.lit(0.0)).cast("float"))


def vector_literal(a, decimals: int = 6) -> Column:
    """Text literal ``[v1,v2,...]`` with fixed decimals (the vector-store wire format)."""
    fmt = f"%.{decimals}f"
    return F.concat(F.lit("["), F.array_join(F.transform(_c(a), lambda v: F.format_string(fmt, v.cast("double"))), ","), F.lit("]"))


def parse_vector_literal(s) -> Column:
    return F.from_json(_c(s), "array<float>")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside lambdas Spark would compute an expression
    again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_embedding(tokens, dim: int = 64) -> Column:
    """Bag-of-words vector of a token array: counts per bucket (four hex digits of md5, modulo
    ``dim``), scaled to length one; no token gives the zero vector."""
    buckets = F.transform(_c(tokens), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dim)
    # one text of all buckets: what the removal of a bucket's mark takes off is its count.  A mark is one
    # character or, if there are too many buckets for that, the number between commas of its own
    short = dim < 128
    mark = (lambda b: F.char(b.cast("long") + 1)) if short else (lambda b: F.concat(F.lit(","), b.cast("string"), F.lit(",")))
    marked = F.array_join(F.transform(buckets, mark), "")

    def count(text: Column, i: int) -> Column:
        one = chr(i + 1) if short else f",{i},"
        return ((F.length(text) - F.length(F.replace(text, F.lit(one), F.lit("")))) / len(one)).cast("int")

    def scaled(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n * n).cast("double"))
        return _let(norm, lambda x: F.transform(counts, lambda n: F.when(x > 0, n.cast("double") / x).otherwise(F.lit(0.0))))

    return _let(marked, lambda m: _let(F.array(*[count(m, i) for i in range(dim)]), scaled))


def hashed_embedding_sql(tokens: str, dim: int = 64) -> str:
    """DuckDB twin of :func:`hashed_embedding`."""
    digit = lambda j: f"(instr('0123456789abcdef', substr(md5(t), {j}, 1)) - 1)"
    bucket = f"({digit(1)} * 4096 + {digit(2)} * 256 + {digit(3)} * 16 + {digit(4)}) % {dim}"
    counts = f"list_transform(range({dim}), lambda i: len(list_filter(bs, lambda b: b = i)))"
    return (f"(SELECT CASE WHEN list_sum(cs) > 0 THEN list_transform(cs, lambda n: CAST(n AS DOUBLE) / "
            f"sqrt(CAST(list_sum(list_transform(cs, lambda m: m * m)) AS DOUBLE))) ELSE list_transform(cs, lambda n: 0.0) END "
            f"FROM (SELECT {counts} AS cs FROM (SELECT list_transform({tokens}, lambda t: {bucket}) AS bs)))")
