"""The row-local kernels as SQL functions, and two table functions.

``register`` adds temporary functions to the session.  The scalar ones are SQL
expressions, which the optimiser inlines, so ``spark.sql`` plans the same arrays
as the Column forms in ``native``.  The table functions say their own columns:
``top_channels(x, k)`` gives the k largest channels of a spectrum, and
``resampled(x, low, high, n)`` a column for each of n places between two
channels, whose number its arguments tell.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Standard deviations below this count as this.
FLOOR = 1e-3

# Bound values stand in a list of one, so that they are worked out once a row.
_FUNCTIONS = {
    "spectrum_mean(x array<double>) returns double": "try_divide(aggregate(x, 0d, (a, v) -> a + v), size(x))",
    "spectrum_snv(x array<double>) returns array<double>": f"""element_at(transform(array(spectrum_mean(x)), m ->
        element_at(transform(array(greatest(sqrt(aggregate(x, 0d, (a, v) -> a + (v - m) * (v - m)) / size(x)), {FLOOR}d)), d -> transform(x, v -> (v - m) / d)), 1)), 1)""",
    "spectrum_unit(x array<double>) returns array<double>": "element_at(transform(array(greatest(sqrt(aggregate(x, 0d, (a, v) -> a + v * v)), 1e-12d)), n -> transform(x, v -> v / n)), 1)",
    "spectrum_differences(x array<double>) returns array<double>": "zip_with(slice(x, 2, greatest(size(x) - 1, 0)), slice(x, 1, greatest(size(x) - 1, 0)), (b, a) -> b - a)",
    "spectrum_softmax(x array<double>) returns array<double>": """element_at(transform(array(array_max(x)), m -> element_at(transform(array(transform(x, v -> exp(v - m))), e ->
        element_at(transform(array(aggregate(e, 0d, (a, v) -> a + v)), s -> transform(e, v -> v / s)), 1)), 1)), 1)""",
    "spectrum_argmax(x array<double>) returns bigint": "array_position(x, array_max(x)) - 1",
}


def _arguments(given: tuple[AnalyzeArgument, ...], numbers: int, name: str) -> list:
    """The values of the constants after the spectrum."""
    if len(given) != numbers + 1 or not isinstance(given[0].dataType, ArrayType):
        raise ValueError(f"{name} takes a spectrum and {numbers} constants")
    values = [a.value for a in given[1:]]
    if any(v is None for v in values):
        raise ValueError(f"{name} takes constants after the spectrum")
    return values


class TopChannels:
    """(ch, value) of the k largest channels, ties to the smaller; null and NaN
    channels do not count."""

    @staticmethod
    def analyze(*given: AnalyzeArgument) -> AnalyzeResult:
        if _arguments(given, 1, "top_channels")[0] < 0:
            raise ValueError("top_channels takes a k of at least 0")
        return AnalyzeResult(StructType().add("rank", LongType()).add("ch", LongType()).add("value", DoubleType()))

    def eval(self, x: list[float] | None, k: int) -> Iterator[tuple]:
        known = [(-v, c) for c, v in enumerate(x or []) if v is not None and v == v]
        for rank, (v, c) in enumerate(sorted(known)[:k], 1):
            yield rank, c, -v


class Resampled:
    """One row of n columns w0, w1, ...: the spectrum at n even places between
    two channels, linear between neighbours, its ends held beyond them."""

    @staticmethod
    def analyze(*given: AnalyzeArgument) -> AnalyzeResult:
        *_, n = _arguments(given, 3, "resampled")
        schema = StructType()
        for k in range(int(n)):
            schema = schema.add(f"w{k}", DoubleType())
        return AnalyzeResult(schema)

    def eval(self, x: list[float] | None, low: float, high: float, n: int) -> Iterator[tuple]:
        out = []
        for k in range(n):
            at = min(max(low + (high - low) * k / max(1, n - 1), 0.0), len(x) - 1.0) if x else 0.0
            a = int(at)
            ends = (x[a], x[min(a + 1, len(x) - 1)]) if x else (None, None)
            t = at - a
            out.append(None if ends[0] is None or (t and ends[1] is None) else ends[0] + t * (ends[1] - ends[0]) if t else ends[0])
        yield tuple(float(v) if v is not None else None for v in out)


def register(spark: SparkSession) -> list[str]:
    """Add the functions to the session; returns their names."""
    for head, body in _FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    spark.udtf.register("top_channels", udtf(TopChannels))
    spark.udtf.register("resampled", udtf(Resampled))
    return [*[head.split("(")[0] for head in _FUNCTIONS], "top_channels", "resampled"]
