"""The engine's session: start and stop, asynchronous tasks, deferred operations, statistics and switches.

Operations only build plans; sync() runs them. A task runs one action on a thread of its own, so that several plans are
under way at a time and share the executors; a task that waits for others is given them as `after`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tensorweft.operators.algebra import add_pattern, contract
from tensorweft.operators.blocked import contract_blocked
from tensorweft.operators.elementwise import initialise
from tensorweft.operators.tensor import Tensor, TensorError
from tensorweft.plans import network
from tensorweft.plans import pattern as P

ALGORITHMS = ("coordinates", "blocks", "auto")
#: Share of nonzero elements from which blocks pay.
DENSE = 0.3


@dataclass
class Task:
    name: str
    future: Future
    began: float = 0.0
    ended: float = 0.0

    @property
    def status(self) -> str:
        """scheduled, running, completed or failed"""
        if not self.future.done():
            return "running" if self.began else "scheduled"
        return "failed" if self.future.exception() else "completed"

    @property
    def seconds(self) -> float:
        return (self.ended or time.time()) - self.began if self.began else 0.0

    def wait(self, timeout: float | None = None):
        return self.future.result(timeout)


@dataclass
class Deferred:
    """An operation that is put together first and run later: arguments in any order, then a pattern, then a task.

    Two arguments are contracted, one is added, more are a network; the first argument set, number 0, is what the result
    is added to (none: the result alone). Its result is kept by the executors until it is cleared.
    """

    runtime: Runtime
    name: str = "operation"
    arguments: dict[int, Tensor] = field(default_factory=dict)
    pattern: P.Pattern | None = None
    factor: complex | float = 1.0
    task: Task | None = None
    result: Tensor | None = None

    def argument(self, number: int, t: Tensor) -> Deferred:
        self._still()
        self.arguments[number] = t
        return self

    def specify(self, p: P.Pattern | str, factor: complex | float = 1.0) -> Deferred:
        self._still()
        self.pattern, self.factor = P.parse(p) if isinstance(p, str) else p, factor
        return self

    @property
    def status(self) -> str:
        """empty, partial (something is missing), specified, or the task's"""
        if self.task:
            return self.task.status
        if not self.arguments and self.pattern is None:
            return "empty"
        return "specified" if self.pattern is not None and set(self.arguments) - {0} == set(range(1, len(self.pattern.inputs) + 1)) else "partial"

    def execute(self, after: Sequence[Deferred] = ()) -> Task:
        """Starts the operation, once those before it are done."""
        if self.status != "specified":
            raise TensorError(f"{self.name} is {self.status}")
        if waiting := [x.name for x in after if x.task is None]:
            raise TensorError(f"{waiting} weren't started")
        p, into = self.pattern, self.arguments.get(0)
        inputs = [self.arguments[i] for i in range(1, len(p.inputs) + 1)]
        if len(inputs) == 1:
            self.result = add_pattern(p, *inputs, into=into, factor=self.factor)
        elif len(inputs) == 2:
            self.result = self.runtime.contract(p, *inputs, into=into, factor=self.factor)
        else:
            self.result = network.contract_network(p, *inputs, into=into, factor=self.factor)
        self.task = self.runtime.submit(self.result.df.cache().count, self.name, [x.task for x in after])
        return self.task

    def output(self, timeout: float | None = None) -> Tensor:
        """The result, once it is there."""
        if self.task is None:
            raise TensorError(f"{self.name} wasn't started")
        self.task.wait(timeout)
        return self.result

    def clear(self) -> Deferred:
        """Back to an empty one; a task that is under way is waited for."""
        if self.task is not None:
            wait([self.task.future])
            self.result.df.unpersist()
        self.arguments, self.pattern, self.factor, self.task, self.result = {}, None, 1.0, None, None
        return self

    def _still(self) -> None:
        if self.task is not None:
            raise TensorError(f"{self.name} was started already")


@dataclass
class Runtime:
    spark: SparkSession
    algorithm: str = "auto"
    zero_on_create: bool = False
    tasks: list[Task] = field(default_factory=list)
    flops: float = 0.0
    operations: int = 0

    def __post_init__(self):
        self._pool = ThreadPoolExecutor(max_workers=8)

    @classmethod
    def start(cls, name: str = "tensors", master: str | None = None, **conf: str) -> Runtime:
        """A session with adaptive plans; what the cluster sets stays as it is."""
        builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
        builder = builder.master(master) if master else builder
        for k, v in conf.items():
            builder = builder.config(k, v)
        return cls(builder.getOrCreate())

    def stop(self, session: bool = True) -> None:
        self.wait_all()
        self._pool.shutdown()
        if session:
            self.spark.stop()

    # -- switches

    def set_algorithm(self, name: str) -> None:
        if name not in ALGORITHMS:
            raise TensorError(f"no such algorithm: {name}")
        self.algorithm = name

    def log_level(self, level: str) -> None:
        self.spark.sparkContext.setLogLevel(level)

    def create(self, dims: Sequence[str], extents: Sequence[int], kind: str = "R8", name: str = "T") -> Tensor:
        t = Tensor.zeros(self.spark, dims, extents, kind, name)
        return initialise(t, 0.0) if self.zero_on_create else t

    # -- operations with statistics

    def contract(self, p: P.Pattern | str, left: Tensor, right: Tensor, **how) -> Tensor:
        """By coordinates or by blocks; auto takes blocks for real tensors with most elements of a known volume."""
        p = P.parse(p) if isinstance(p, str) else p
        sizes = network.label_sizes(p, (left, right))
        self.flops += network.flops([o.labels for o in (p.dest, *p.inputs)], sizes, left.complex or right.complex)
        self.operations += 1
        plain = not (how or p.batch() or left.complex or right.complex or left.volume is None or right.volume is None)
        if self.algorithm == "blocks" or (self.algorithm == "auto" and plain and all(self._dense(t) for t in (left, right))):
            return contract_blocked(p, left, right)
        return contract(p, left, right, **how)

    @staticmethod
    def _dense(t: Tensor) -> bool:
        """By the optimiser's estimate of the rows, without running anything; unknown sizes count as sparse."""
        rows = t.df._jdf.queryExecution().optimizedPlan().stats().rowCount()
        return bool(t.volume) and rows.isDefined() and int(str(rows.get())) >= DENSE * t.volume

    def defer(self, name: str = "operation") -> Deferred:
        return Deferred(self, name)

    # -- tasks

    def submit(self, action: Callable[[], object], name: str = "task", after: Sequence[Task] = ()) -> Task:
        def run():
            for t in after:
                t.wait()
            task.began = time.time()
            try:
                return action()
            finally:
                task.ended = time.time()

        task = Task(name, None)  # type: ignore[arg-type]
        task.future = self._pool.submit(run)
        self.tasks.append(task)
        return task

    def sync(self, *tensors: Tensor, timeout: float | None = None) -> bool:
        """Run the tensors' plans and keep their rows for later plans; with none given, wait for all tasks.

        False if the time is over before they are; they go on.
        """
        tasks = [self.submit(t.df.cache().count, t.name) for t in tensors] or self.tasks
        return not wait([t.future for t in tasks], timeout).not_done

    def wait_all(self) -> None:
        for t in self.tasks:
            t.wait()

    def status(self) -> dict[str, int]:
        out = {"scheduled": 0, "running": 0, "completed": 0, "failed": 0}
        for t in self.tasks:
            out[t.status] += 1
        return out

    def statistics(self) -> dict[str, float]:
        done = [t for t in self.tasks if t.ended]
        context = self.spark.sparkContext
        return {"operations": self.operations, "flops": self.flops, "tasks": len(self.tasks), "task_seconds": sum(t.seconds for t in done), "parallelism": context.defaultParallelism}

    @staticmethod
    def place(t: Tensor) -> Tensor:
        """Keep the rows near the executors."""
        t.df.cache()
        return t

    @staticmethod
    def discard(t: Tensor) -> Tensor:
        t.df.unpersist()
        return t
