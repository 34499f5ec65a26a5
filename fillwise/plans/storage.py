"""What a bin accumulates, as aggregate columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Storage:
    """``name`` is one of double, int64, weight (sum and sum of squares), sparse (sum; only filled bins exist)."""

    name: str = "weight"

    @property
    def variance(self) -> bool:
        return self.name == "weight"

    @property
    def columns(self) -> list[str]:
        return ["value", "variance"] if self.variance else ["value"]

    def aggregates(self, weight: Column | None) -> list[Column]:
        """The aggregates of a fill; without a weight every fill counts 1."""
        if self.name == "int64":
            if weight is not None:
                raise ValueError("integer storage takes no weight")
            return [F.count(F.lit(1)).alias("value")]
        if weight is None:
            count = F.count(F.lit(1)).cast("double")
            return [count.alias("value"), *([count.alias("variance")] if self.variance else [])]
        return [F.sum(weight).alias("value"), *([F.sum(weight * weight).alias("variance")] if self.variance else [])]


WEIGHT, DOUBLE, INT64, SPARSE = Storage("weight"), Storage("double"), Storage("int64"), Storage("sparse")


def storage_of(name: str | Storage) -> Storage:
    """A storage by its name.  atomic_int64 is int64 (sums are exact anyway); mean and unlimited ones are refused."""
    if isinstance(name, Storage):
        return name
    known = {"weight": WEIGHT, "double": DOUBLE, "int64": INT64, "atomic_int64": INT64, "sparse": SPARSE}
    if name in ("mean", "weighted_mean"):
        raise NotImplementedError(f"{name} storage")
    if name not in known:
        raise TypeError(f"unknown storage: {name}")
    return known[name]


def sparse(fill_fraction: float = 0.1) -> Storage:
    """Sparse storage; the expected fill is of no use to a hash aggregation that spills, and is ignored."""
    return SPARSE
