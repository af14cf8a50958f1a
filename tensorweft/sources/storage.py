"""Tensors in storage: Parquet with a JSON description beside it, and a catalog of live tensors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tensorweft.operators.tensor import Tensor, TensorError


def save(t: Tensor, path: str, overwrite: bool = False) -> None:
    """path/body (Parquet) and path/meta (a line of JSON), written by Spark to any store it knows."""
    spark = t.df.sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    t.df.write.mode(mode).parquet(f"{path}/body")
    meta = {"name": t.name, "dims": t.dims, "extents": t.extents, "kind": t.kind}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Tensor:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Tensor(spark.read.parquet(f"{path}/body"), tuple(meta["dims"]), tuple(meta["extents"]), meta["kind"], meta["name"])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass
class Catalog:
    """Live tensors by name, with where they stand: created, defined (has values) and updated."""

    tensors: dict[str, Tensor] = field(default_factory=dict)
    state: dict[str, str] = field(default_factory=dict)

    def create(self, t: Tensor, name: str | None = None, defined: bool = False) -> Tensor:
        name = name or t.name
        if name in self.tensors:
            raise TensorError(f"{name} is there already")
        self.tensors[name], self.state[name] = t.named(name), "defined" if defined else "created"
        return self.tensors[name]

    def put(self, name: str, t: Tensor) -> Tensor:
        known = name in self.tensors
        self.tensors[name], self.state[name] = t.named(name), "updated" if known else "defined"
        return self.tensors[name]

    def get(self, name: str, needs_values: bool = True) -> Tensor:
        if name not in self.tensors:
            raise TensorError(f"no such tensor: {name}")
        if needs_values and self.state[name] == "created":
            raise TensorError(f"{name} was created but never given values")
        return self.tensors[name]

    def status(self, name: str) -> str:
        return self.state.get(name, "absent")

    def destroy(self, name: str) -> None:
        if name not in self.tensors:
            raise TensorError(f"no such tensor: {name}")
        self.tensors.pop(name).df.unpersist()
        del self.state[name]
