"""Costs of operations, and the order in which the pairs of a network are contracted.

A network of up to EXACT tensors gets the cheapest order by dynamic programming over subsets; larger ones the pair that
costs least next. Costs are floating-point operations of the dense problem, 2 a multiply-add for real kinds and 8 for
complex ones. Every pair is summed right away over the labels that nothing needs any more.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import prod

from tensorweft.operators.tensor import Tensor, TensorError
from tensorweft.plans import pattern as P

EXACT = 10
#: Extent that an unknown one counts as where nothing is known of the rows either, and the most that rows make of one.
UNKNOWN, MOST = 1000, 10**9


def flops(labels: Sequence[Sequence[str]], sizes: dict[str, int], complex_kind: bool = False) -> float:
    """Of one operation: the product of the extents of all distinct labels, by the cost of a multiply-add."""
    return (8.0 if complex_kind else 2.0) * prod(sizes[x] for x in {x for ls in labels for x in ls})


def moved_bytes(labels: Sequence[Sequence[str]], sizes: dict[str, int], kind: str = "R8") -> float:
    """Bytes of all operands' dense bodies."""
    return float(sum(prod(sizes[x] for x in ls) for ls in labels) * {"R4": 4, "R8": 8, "C4": 8, "C8": 16}[kind])


def intensity(labels: Sequence[Sequence[str]], sizes: dict[str, int], kind: str = "R8") -> float:
    """Operations a byte."""
    return flops(labels, sizes, kind[0] == "C") / moved_bytes(labels, sizes, kind)


def estimated_rows(t: Tensor) -> float | None:
    """By the optimiser's size of the plan, without running anything; None where it has none."""
    size = int(str(t.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >= 1 << 60 else size / (8 * (1 + t.rank + len(t.values)))


def label_sizes(p: P.Pattern, tensors: Sequence[Tensor]) -> dict[str, int]:
    """Extents of all labels. Unknown ones of a tensor share its estimated rows; of several tensors the largest share holds."""
    out: dict[str, int] = {}
    for o, t in zip(p.inputs, tensors, strict=True):
        for x, n in zip(o.labels, t.extents, strict=True):
            if n is not None and out.setdefault(x, n) != n:
                raise TensorError(f"label {x} has extents {out[x]} and {n}")
    guess: dict[str, int] = {}
    for o, t in zip(p.inputs, tensors, strict=True):
        unknown = {x for x in o.labels if x not in out}
        rows = estimated_rows(t) if unknown else None
        if rows is not None:
            share = (rows / prod(max(1, out[x]) for x in set(o.labels) - unknown)) ** (1 / len(unknown))
            guess |= {x: max(guess.get(x, 2), min(MOST, int(share))) for x in unknown}
    return {x: out[x] if x in out else guess.get(x, UNKNOWN) for o in p.inputs for x in o.labels}


def _kept(own: frozenset[int], p: P.Pattern) -> tuple[str, ...]:
    """Labels of the product of some inputs that the destination or other inputs still need."""
    needed = set(p.dest.labels).union(*(o.labels for i, o in enumerate(p.inputs) if i not in own))
    return tuple(dict.fromkeys(x for i in sorted(own) for x in p.inputs[i].labels if x in needed))


def plan(p: P.Pattern, sizes: dict[str, int]) -> list[tuple[frozenset[int], frozenset[int]]]:
    """Pairs of input sets, in the order of contraction."""
    n = len(p.inputs)
    labels = lambda s: p.inputs[next(iter(s))].labels if len(s) == 1 else _kept(s, p)
    pair_cost = lambda a, b: flops([labels(a), labels(b)], sizes)
    if n <= EXACT:
        best: dict[frozenset[int], tuple[float, tuple | None]] = {frozenset([i]): (0.0, None) for i in range(n)}
        for size in range(2, n + 1):
            for chosen in combinations(range(n), size):
                whole = frozenset(chosen)
                found: tuple[float, tuple | None] = (float("inf"), None)
                for k in range(1, size // 2 + 1):
                    for part in combinations(chosen, k):
                        a = frozenset(part)
                        b = whole - a
                        cost = best[a][0] + best[b][0] + pair_cost(a, b)
                        if cost < found[0]:
                            found = (cost, (a, b))
                best[whole] = found
        order: list = []

        def visit(s: frozenset[int]) -> None:
            if (split := best[s][1]) is not None:
                visit(split[0])
                visit(split[1])
                order.append(split)

        visit(frozenset(range(n)))
        return order
    left, order = [frozenset([i]) for i in range(n)], []
    while len(left) > 1:
        a, b = min(combinations(left, 2), key=lambda ab: (pair_cost(*ab), sorted(ab[0]), sorted(ab[1])))
        order.append((a, b))
        left = [s for s in left if s not in (a, b)] + [a | b]
    return order


def total_flops(p: P.Pattern, sizes: dict[str, int]) -> float:
    labels = lambda s: p.inputs[next(iter(s))].labels if len(s) == 1 else _kept(s, p)
    return sum(flops([labels(a), labels(b)], sizes) for a, b in plan(p, sizes))


def contract_network(p: P.Pattern | str, *tensors: Tensor, into: Tensor | None = None, factor: complex | float = 1.0) -> Tensor:
    """D(i,j) += A(...) * B(...) * C(...) ...: pairwise, each pair summed at once."""
    from tensorweft.operators.algebra import add, add_pattern, contract
    from tensorweft.operators.elementwise import conjugate, scale

    p = P.check_network(P.parse(p) if isinstance(p, str) else p)
    tensors = tuple(conjugate(t) if o.conj != p.dest.conj else t for o, t in zip(p.inputs, tensors, strict=True))
    held = {frozenset([i]): t.relabel(o.labels) for i, (o, t) in enumerate(zip(p.inputs, tensors, strict=True))}
    whole = frozenset(range(len(tensors)))
    for a, b in plan(p, label_sizes(p, tensors)):
        x, y = held.pop(a), held.pop(b)
        out = p.dest.labels if a | b == whole else _kept(a | b, p)
        pair = P.Pattern(P.Operand("D", tuple(out)), (P.Operand("L", x.dims), P.Operand("R", y.dims)))
        held[a | b] = _summed_pair(pair, x, y, contract)
    done = held[whole]
    if len(tensors) == 1:
        done = add_pattern(P.Pattern(P.Operand("D", p.dest.labels), (P.Operand("L", done.dims),)), done)
    done = scale(done, factor * p.factor) if factor * p.factor != 1 else done
    return done.named(p.dest.name) if into is None or p.assign == "=" else add(done, into)


def _summed_pair(pair: P.Pattern, x: Tensor, y: Tensor, contract) -> Tensor:
    """A pair may have labels that are summed in one input alone (all its partners are inside): sum them first."""
    from tensorweft.operators.tensor import c, summed

    left, right = set(pair.inputs[0].labels), set(pair.inputs[1].labels)
    alone = [d for d in pair.contracted() if (d in left) != (d in right)]
    if not alone:
        return contract(pair, x, y)
    reduced = []
    for t in (x, y):
        dims = tuple(d for d in t.dims if d not in alone)
        if dims != t.dims:
            t = Tensor(summed([t.df.select(*map(c, dims), *t.values)], dims, t.kind), dims, tuple(n for d, n in zip(t.dims, t.extents) if d in dims), t.kind, t.name)
        reduced.append(t)
    pair = P.Pattern(pair.dest, tuple(P.Operand(o.name, t.dims) for o, t in zip(pair.inputs, reduced)))
    return contract(pair, *reduced)
