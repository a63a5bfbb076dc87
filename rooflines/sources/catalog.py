"""A catalog of named datasets: register, list, describe and load with checked splits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Loader = Callable[..., DataFrame]


@dataclass(frozen=True)
class Dataset:
    name: str
    load: Loader
    splits: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    about: dict = field(default_factory=dict)


class Catalog:
    def __init__(self):
        self._known: dict[str, Dataset] = {}

    def register(self, name: str, splits: tuple[str, ...] = (), categories: tuple[str, ...] = (), **about) -> Callable[[Loader], Loader]:
        def add(load: Loader) -> Loader:
            if name in self._known:
                raise ValueError(f"{name} is registered already")
            self._known[name] = Dataset(name, load, splits, categories, about)
            return load

        return add

    def names(self) -> list[str]:
        return sorted(self._known)

    def info(self, name: str) -> Dataset:
        if name not in self._known:
            raise ValueError(f"no dataset {name}; there are: {', '.join(self.names()) or 'none'}")
        return self._known[name]

    def load(self, spark: SparkSession, name: str, split: str | None = None, **options) -> DataFrame:
        """The dataset, also as a temporary view of its name. split must be one of the dataset's."""
        found = self.info(name)
        if found.splits:
            split = split or found.splits[0]
            if split not in found.splits:
                raise ValueError(f"{name} has no split {split}; it has: {', '.join(found.splits)}")
            options["split"] = split
        df = found.load(spark, **options)
        df.createOrReplaceTempView(name)
        return df
