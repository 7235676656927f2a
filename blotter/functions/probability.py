"""Expressions over a probability array column.

The class count is known when a plan is built, so sums over classes are
written out term by term: they compile into the generated stage code, while
the higher-order array functions would be interpreted row by row. Above
``UNROLL`` classes the array functions are used instead. Expressions are
built as SQL text, one call for all terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNROLL = 64
# Smallest probability the logarithm sees: the double machine epsilon.
EPSILON = 2.220446049250313e-16


def quoted(name: str) -> str:
    return f"`{name}`"


def number(value: float) -> str:
    """A double in SQL text, exact."""
    return f"double('{float(value)!r}')"


def numbers(values) -> str:
    return "array(" + ", ".join(number(v) for v in values) + ")"


def terms(template: str, n: int, joiner: str = " + ") -> str:
    """``template`` with {i} filled for every class, joined."""
    return joiner.join(template.format(i=i) for i in range(n))


def total_sql(name: str, n: int) -> str:
    p = quoted(name)
    if n <= UNROLL:
        return terms(p + "[{i}]", n)
    return f"aggregate({p}, 0D, (a, x) -> a + x)"


def mapped(name: str, n: int, template: str) -> Column:
    """A new array with ``template`` applied per entry; {x} is the entry."""
    p = quoted(name)
    if n <= UNROLL:
        return F.expr("array(" + ", ".join(template.format(x=f"{p}[{i}]") for i in range(n)) + ")")
    return F.expr(f"transform({p}, x -> {template.format(x='x')})")


def normalise(df: DataFrame, n: int, empty: str = "raise", name: str = "probability") -> DataFrame:
    """Divide ``name`` by its row total; a zero row raises or becomes uniform."""
    if empty not in ("raise", "uniform"):
        raise ValueError("empty must be 'raise' or 'uniform'")
    sized = df.withColumn("_size", F.expr(total_sql(name, n)))
    if empty == "uniform":
        other = F.expr(f"array_repeat({number(1.0 / n)}, {n})")
    else:
        other = F.expr("cast(raise_error('a prediction row has zero total probability') as array<double>)")
    scaled = mapped(name, n, "{x} / _size")
    return sized.withColumn(name, F.when(F.col("_size") > 0, scaled).otherwise(other)).drop("_size")


def align(df: DataFrame, model_classes: list, all_classes: list, empty: str = "raise", name: str = "probability") -> DataFrame:
    """Reorder ``name`` to the global classes, absent classes 0.0, and renormalise."""
    unknown = [c for c in model_classes if c not in set(all_classes)]
    if unknown:
        raise KeyError(f"model classes outside the class list: {unknown}")
    place = {c: i for i, c in enumerate(model_classes)}
    cells = [f"coalesce({quoted(name)}[{place[c]}], 0D)" if c in place else "0D" for c in all_classes]
    return normalise(df.withColumn(name, F.expr(f"array({', '.join(cells)})")), len(all_classes), empty, name)


def confidence(name: str = "probability") -> Column:
    return F.array_max(name)


def predicted(name: str = "probability") -> Column:
    """Index of the largest probability; the lowest index wins a tie."""
    p = quoted(name)
    return F.expr(f"cast(array_position({p}, array_max({p})) - 1 as int)")


def true_sql(name: str, label: str) -> str:
    return f"element_at({quoted(name)}, cast({quoted(label)} as int) + 1)"


def neg_log(name: str = "probability", label: str = "label") -> Column:
    return F.expr(f"-ln(least(greatest({true_sql(name, label)}, {number(EPSILON)}), {number(1 - EPSILON)}))")


def in_top_k(n: int, k: int = 3, name: str = "probability", label: str = "label") -> Column:
    """1 when fewer than k classes stand before the label; the highest index wins a tie."""
    p, y, mine = quoted(name), quoted(label), true_sql(name, label)
    ahead = "cast({x} > " + mine + " or ({x} = " + mine + " and {i} > " + y + ") as int)"
    if n <= UNROLL:
        places = " + ".join(ahead.format(x=f"{p}[{i}]", i=i) for i in range(n))
    else:
        places = f"aggregate(transform({p}, (x, i) -> {ahead.format(x='x', i='i')}), 0, (a, x) -> a + x)"
    return F.expr(f"cast({places} < {min(k, n)} as int)")


def brier(n: int, name: str = "probability", label: str = "label") -> Column:
    """Squared distance to the one-hot target, summed over classes."""
    p = quoted(name)
    if n <= UNROLL:
        squares = terms(p + "[{i}] * " + p + "[{i}]", n)
    else:
        squares = f"aggregate({p}, 0D, (a, x) -> a + x * x)"
    return F.expr(f"{squares} - 2 * {true_sql(name, label)} + 1D")


def softmax(df: DataFrame, n: int, source: str, name: str = "probability") -> DataFrame:
    """Exponentials of ``source`` relative to its largest entry, normalised."""
    top = df.withColumn("_top", F.array_max(source))
    return normalise(top.withColumn(name, mapped(source, n, "exp({x} - _top)")), n, "raise", name).drop("_top")
