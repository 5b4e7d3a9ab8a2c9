"""JVM-side column functions. Vectors are array columns; arithmetic is in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_OF, TAIL_OF = "head of ", "tail of "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_text(seed: object, *keys: Column | str) -> Column:
    """md5 of seed and keys: a seeded order that any SQL engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def hash_number(seed: object, *keys: Column | str) -> Column:
    """A seeded 60-bit whole number."""
    return F.conv(F.substring(hash_text(seed, *keys), 1, 15), 16, 10).cast("long")


def edge_part(edge: Column, part: int) -> Column:
    """head (0), name (1) or tail (2) of head:name:tail; anything but three parts is an error."""
    p = F.split(edge, ":")
    return F.when(F.size(p) == 3, F.get(p, part)).otherwise(F.raise_error(F.concat(F.lit("not head:name:tail: "), edge)))


def directed_tail(edge: Column) -> Column:
    """Node type that a directed edge name leads to: 'head of h:n:t' to t, 'tail of h:n:t' to h."""
    bad = F.raise_error(F.concat(F.lit("no direction: "), edge))
    return F.when(edge.startswith(HEAD_OF), F.element_at(F.split(edge, ":"), -1)).when(edge.startswith(TAIL_OF), F.substring(F.get(F.split(edge, ":"), 0), len(TAIL_OF) + 1, 1 << 20)).otherwise(bad)


def directed_head(edge: Column) -> Column:
    """Node type that a directed edge name comes from."""
    bad = F.raise_error(F.concat(F.lit("no direction: "), edge))
    return F.when(edge.startswith(TAIL_OF), F.element_at(F.split(edge, ":"), -1)).when(edge.startswith(HEAD_OF), F.substring(F.get(F.split(edge, ":"), 0), len(HEAD_OF) + 1, 1 << 20)).otherwise(bad)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_normalize(v: Column) -> Column:
    """v over its norm; a zero vector stays zero."""
    return let(doubles(v), lambda d: let(F.sqrt(dot(d, d)), lambda n: F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps)."""

    def scaled(d: Column) -> Column:
        n = F.size(d)
        return let(total(d) / n, lambda m: let(total(F.transform(d, lambda x: (x - m) * (x - m))) / n, lambda var: F.transform(d, lambda x: (x - m) / F.sqrt(var + eps))))

    return let(doubles(v), scaled)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def cosine_bank(x: Column, width: int) -> Column:
    """cos(x * 10^(-2 + 3 i / (width - 1))) for i below width."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.cos(x.cast("double") * F.pow(F.lit(10.0), F.lit(-2.0) + F.lit(3.0) * i / (width - 1))))


def one_hot(index: Column, width: Column | int) -> Column:
    """array<boolean> of that width, true at index."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.transform(F.sequence(F.lit(0), w - 1), lambda i: i == index)


def true_or_false(text: str) -> bool:
    """The boolean words of a command line."""
    word = text.strip().lower()
    if word in ("true", "t", "yes", "y", "1"):
        return True
    if word in ("false", "f", "no", "n", "0"):
        return False
    raise ValueError(f"not a boolean: {text}")
