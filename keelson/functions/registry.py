"""Functions for SQL, and recognisers by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_SEGMENT = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])


@F.udtf
class segments:  # noqa: N801
    """segments(dur, dt): the segments of dt seconds of a video of that length, the last cut. None for no length; dt must be a positive constant."""

    @staticmethod
    def analyze(dur: AnalyzeArgument, dt: AnalyzeArgument) -> AnalyzeResult:
        for name, a in (("dur", dur), ("dt", dt)):
            if not isinstance(a.dataType, T.NumericType):
                raise ValueError(f"segments: {name} must be a number, not {a.dataType.simpleString()}")
        if not dt.isConstantExpression or dt.value is None or float(dt.value) <= 0:
            raise ValueError("segments: dt must be a positive constant")
        return AnalyzeResult(_SEGMENT)

    def eval(self, dur: float, dt: float) -> Iterator[tuple]:
        if dur is not None:
            dur, dt = float(dur), float(dt)
            for i in range(int(np.ceil(dur / dt))):
                yield i, i * dt, min((i + 1) * dt, dur)


@F.pandas_udf(T.DoubleType())
def area(x: pd.Series, y: pd.Series) -> float:
    """Aggregate: the area under the points (x, y) in order of x, by trapezoids; rows with a null take no part. A group is held whole, so it
    has to be a curve's points."""
    known = (x.notna() & y.notna()).to_numpy()
    a, b = x.to_numpy(float)[known], y.to_numpy(float)[known]
    order = np.lexsort((b, a))
    return float(np.trapezoid(b[order], a[order])) if len(a) else None


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("segments", segments)
    spark.udf.register("area", area)


#: Recognisers by name: a "module:attribute" that gives, from its settings, a function of a list of inputs that returns scores of the labels.
Recogniser = Callable[[list], list[list[float]]]


class Recognisers:
    """A registry of recognisers. What an entry names is imported where it runs, once a task."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, dict]] = {}

    def add(self, name: str, target: str, **settings) -> None:
        if target.count(":") != 1:
            raise ValueError(f"{target} isn't of the form module:attribute")
        self.known[name] = (target, settings)

    def column(self, name: str, value: Column, k: int = 5, digits: int | None = None) -> Column:
        """The k labels with the highest scores, first ones on ties, as top_ids, with top_scores. With digits, scores are rounded (halves away from zero) before they are compared."""
        if name not in self.known:
            raise KeyError(f"no recogniser {name}; there are {', '.join(sorted(self.known)) or 'none'}")
        target, settings = self.known[name]
        kind = T.StructType([T.StructField("top_ids", T.ArrayType(T.IntegerType())), T.StructField("top_scores", T.ArrayType(T.DoubleType()))])

        @F.pandas_udf(kind)
        def recognised(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            module, attribute = target.split(":")
            run = getattr(import_module(module), attribute)(**settings)
            for batch in batches:
                out = []
                for row in run(batch.to_list()):
                    scores = np.asarray(row, float) if digits is None else rounded(np.asarray(row, float), digits)
                    best = np.argsort(-scores, kind="stable")[:k]
                    out.append((best.tolist(), scores[best].tolist()))
                yield pd.DataFrame(out, columns=["top_ids", "top_scores"])

        return recognised(value)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled)
    return np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, x)


def centroids(means: list[list[float]]) -> Recogniser:
    """A recogniser of vectors by their inner product with a mean for each label."""
    matrix = np.asarray(means, float)
    return lambda vectors: (np.asarray([np.asarray(v, float) for v in vectors]) @ matrix.T).tolist()
