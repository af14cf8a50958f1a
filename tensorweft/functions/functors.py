"""Named methods, predicates, readers and external data that programs and operations refer to."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column

from tensorweft.operators.elementwise import transform
from tensorweft.operators.reduce import argmax
from tensorweft.operators.tensor import VALUE, Tensor, TensorError, c, dense, from_function, settled


def _largest(t: Tensor) -> tuple[complex | float, tuple[int, ...]] | None:
    """The element of the largest modulus with its coordinates; of equals that with the smallest ones."""
    row = argmax(t).first()
    if row is None:
        return None
    return complex(row["re"], row["im"]) if t.complex else row["v"], tuple(row[d] for d in t.dims)


#: Readers that are always there, under the names that programs know them by (fixed values).
READERS: dict[str, Callable[[Tensor], object]] = {
    "_RetrieveScalar_": Tensor.get_scalar,
    "_RetrieveTensor_": Tensor.to_numpy,
    "_TensorMax_": _largest,
    "_PrintTensor_": Tensor.show,
}


@dataclass
class Registry:
    """methods: f(value column, *coordinate columns) to a column. blocks: f(DataFrame of coordinates and values) to one.

    readers: f(tensor) to anything; what they bring to the driver is theirs to bound.
    """

    methods: dict[str, Callable[..., Column]] = field(default_factory=dict)
    blocks: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = field(default_factory=dict)
    predicates: dict[str, Callable[..., Column]] = field(default_factory=dict)
    data: dict[str, complex | float] = field(default_factory=dict)
    readers: dict[str, Callable[[Tensor], object]] = field(default_factory=READERS.copy)

    def register_method(self, name: str, f: Callable[..., Column]) -> None:
        self._free(name)
        self.methods[name] = f

    def register_block_method(self, name: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
        self._free(name)
        self.blocks[name] = f

    def unregister_method(self, name: str) -> None:
        if name not in self.methods and name not in self.blocks:
            raise TensorError(f"no such method: {name}")
        self.methods.pop(name, None)
        self.blocks.pop(name, None)

    def register_reader(self, name: str, f: Callable[[Tensor], object]) -> None:
        self._free(name)
        self.readers[name] = f

    def read(self, t: Tensor, name: str) -> object:
        """What the reader of that name makes of t."""
        if name not in self.readers:
            raise TensorError(f"no such reader: {name}")
        return self.readers[name](t)

    def register_predicate(self, name: str, f: Callable[..., Column]) -> None:
        self.predicates[name] = f

    def register_data(self, name: str, value: complex | float) -> None:
        self.data[name] = value

    def unregister_data(self, name: str) -> None:
        self.data.pop(name)

    def _free(self, name: str) -> None:
        if len(name) > 64:
            raise TensorError("method names have 64 characters at most")
        if name in self.methods or name in self.blocks or name in self.readers:
            raise TensorError(f"{name} is registered already")

    # -- application

    def initialise(self, t: Tensor, name: str) -> Tensor:
        """Every element by a method; it gets a zero value and the coordinates."""
        if name in self.methods:
            from pyspark.sql import functions as F

            f = self.methods[name]
            made = from_function(t.df.sparkSession, t.dims, t.known(), lambda *at: f(F.lit(0.0), *at), "R8", t.name)
            return made if t.kind == "R8" else _kind(made, t.kind)
        return self.apply_blocks(dense(t), self.blocks[name])

    def apply(self, t: Tensor, name: str, keeps_zero: bool = False) -> Tensor:
        """t with each element replaced by the method's value of it."""
        if name in self.methods:
            return transform(t, self.methods[name], keeps_zero)
        return self.apply_blocks(t if keeps_zero else dense(t), self.blocks[name])

    @staticmethod
    def apply_blocks(t: Tensor, f: Callable[[pd.DataFrame], pd.DataFrame]) -> Tensor:
        """f over Arrow batches of rows, coordinates and values as columns; coordinates must come back as they are."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield f(part)

        t = settled(t)
        return t.with_df(t.df.mapInPandas(run, t.df.schema).select(*map(c, t.dims), *t.values))

    def traverse(self, t: Tensor, f: Callable[[Iterator], None]) -> None:
        """f over the rows of each partition, for what it does outside."""
        t.df.foreachPartition(f)


def _kind(t: Tensor, kind: str) -> Tensor:
    from tensorweft.operators.elementwise import cast

    assert VALUE[kind]
    return cast(t, kind)
