"""Array columns: softmax, divergence, padding, averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    # bound to a name first, or the sum is taken again for every element
    bound = F.array(F.struct(e.alias("e"), total(e).alias("sum")))
    return F.transform(bound, lambda b: F.transform(b["e"], lambda x: x / b["sum"]))[0]


def mean_of(probabilities: list[Column]) -> Column:
    """Mean of several teachers' probabilities, place by place."""
    out = probabilities[0]
    for p in probabilities[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return F.transform(out, lambda x: x / len(probabilities))


def divergence(p: Column, q: Column, temperature: float = 1.0) -> Column:
    """KL(p || q) T^2, logs kept above 1e-9."""
    terms = F.zip_with(p, q, lambda a, b: a * (F.ln(F.greatest(a, F.lit(1e-9))) - F.ln(F.greatest(b, F.lit(1e-9)))))
    return total(terms) * temperature**2


def pad(labels: Column, size: Column, value: int = -100) -> Column:
    return F.concat(labels, F.array_repeat(F.lit(value).cast("int"), F.greatest(size - F.size(labels), F.lit(0))))


def shift_right(labels: Column, start: int, blank: int, ignored: int = -100) -> Column:
    """The decoder's inputs: start first, then the labels but the last, ignored ones as blank."""
    kept = F.transform(labels, lambda x: F.when(x == ignored, blank).otherwise(x))
    return F.concat(F.array(F.lit(start)), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))


def moving_average(values: Column, decay: float) -> Column:
    """Fold of an ordered array with warm-up: the k-th update (from 0) has rate min(decay, (1 + k) / (10 + k))."""
    state = F.struct(F.lit(0).alias("k"), F.element_at(values, 1).cast("double").alias("held"))

    def step(s, x):
        rate = F.least(F.lit(decay), (1.0 + s["k"]) / (10.0 + s["k"]))
        return F.struct((s["k"] + 1).alias("k"), (rate * s["held"] + (1.0 - rate) * x).alias("held"))

    return F.when(F.size(values) > 0, F.aggregate(values, state, step)["held"])


def pixel(values: Column) -> Column:
    return F.transform(values, lambda v: (v / 255.0 - 0.449) / 0.226)


def gamma_table(power: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.least(F.lit(255.0), F.bround(255.0 * F.pow(v / 255.0, F.lit(power)))).cast("int"))


def norm_step(gradient: Column, radius: float) -> Column:
    """A step of the given length along a gradient."""
    size = F.sqrt(total(F.transform(gradient, lambda g: g * g)))
    return F.transform(gradient, lambda g: g * radius / (size + 1e-12))
