"""A tensor factorised into the shape of a network: T(i,j,k,l) = A(i,a) B(a,j,b) C(b,k,c) D(c,l).

One factor after the other is split off by a singular value decomposition: its labels that the rest of the tensor has make
the rows, and what it shares with the factors to come, its bond, is as long as those labels together. Factors go in such
an order that the others stay connected, the shortest bond first, so a network with loops is no special case: the rest
carries a loop's labels on. A factor of bond labels alone, such as S(d) in A(i,d) S(d) B(d,j), gets the singular values of
that bond; other bonds leave them to the rest, so that every factor but the last has orthonormal columns.

Products equal the tensor where bonds are as long as the ranks they cut; shorter ones keep the largest values of each
split (the best there for its bond, not always for the network as a whole), longer ones are filled with zeros. An empty
tensor gives factors without rows. A bond's smaller side has linalg.SIDE elements at most.
"""

from __future__ import annotations

from math import prod

from tensorweft.operators.elementwise import conjugate, permute, scale, unfold
from tensorweft.operators.linalg import svd
from tensorweft.operators.tensor import Tensor, TensorError
from tensorweft.plans import pattern as P


def _nodes(p: P.Pattern) -> tuple[list[int], dict[frozenset[str], int]]:
    """Inputs that are factors, and by their bond those that hold singular values."""
    open_labels = set(p.dest.labels)
    names = [o.name for o in p.inputs]
    if len(set(names)) < len(names):
        raise P.PatternError("a factor may stand in a network once")
    if any(o.repeated for o in p.inputs) or p.dest.repeated:
        raise P.PatternError("labels may not repeat within a factor")
    uses = {x: [i for i, o in enumerate(p.inputs) if x in o.labels] for o in p.inputs for x in o.labels}
    middles = {frozenset(o.labels): i for i, o in enumerate(p.inputs) if o.labels and all(x not in open_labels and len(uses[x]) == 3 for x in o.labels)}
    nodes = [i for i in range(len(p.inputs)) if i not in middles.values()]
    for x, where in uses.items():
        n = sum(i in nodes for i in where)
        if n != (1 if x in open_labels else 2):
            raise P.PatternError(f"label {x} is in {n} factors")
    if open_labels - set(uses):
        raise P.PatternError(f"no factor has {sorted(open_labels - set(uses))}")
    return nodes, middles


def _connected(nodes: list[int], p: P.Pattern) -> bool:
    seen, todo = set(), nodes[:1]
    while todo:
        i = todo.pop()
        seen.add(i)
        todo += [j for j in nodes if j not in seen and set(p.inputs[i].labels) & set(p.inputs[j].labels)]
    return len(seen) == len(nodes)


def _kept(t: Tensor) -> Tensor:
    """t by way of the shared checkpoint folder, where one is set: later splits then start from it."""
    return t.with_df(t.df.checkpoint()) if t.df.sparkSession.sparkContext.getCheckpointDir() else t


def _bonded(t: Tensor, bond: list[str], extents: list[int]) -> Tensor:
    """The label _b, filled with zeros up to the bond's length, as the bond's labels."""
    t = Tensor(t.df, t.dims, tuple(prod(extents) if d == "_b" else n for d, n in zip(t.dims, t.extents)), t.kind, t.name)
    return unfold(t, "_b", bond, extents)


def factorise(p: P.Pattern | str, t: Tensor, extents: dict[str, int]) -> list[Tensor]:
    """The factors of t in the order of the pattern's inputs; extents: the lengths of the labels that t hasn't."""
    p = P.parse(p) if isinstance(p, str) else p
    nodes, middles = _nodes(p)
    if not nodes or not _connected(nodes, p):
        raise P.PatternError("a network of connected factors is needed")
    if not p.factor:
        raise TensorError("a network times zero has no factors")
    inner = [x for i in nodes for x in p.inputs[i].labels if x not in p.dest.labels]
    if missing := [x for x in inner if extents.get(x, 0) < 1]:
        raise TensorError(f"no lengths of {sorted(set(missing))}")
    rest = t.relabel(p.dest.labels)
    rest = scale(rest, 1 / p.factor) if p.factor != 1 else rest
    made: dict[int, Tensor] = {}
    left = list(nodes)
    while len(left) > 1:

        def bond_of(i: int) -> list[str]:
            return [x for x in p.inputs[i].labels if any(x in p.inputs[j].labels for j in left if j != i)]

        now = min((i for i in left if _connected([j for j in left if j != i], p)), key=lambda i: (prod(extents[x] for x in bond_of(i)), left.index(i)))
        bond = bond_of(now)
        own = [x for x in rest.dims if x in p.inputs[now].labels]
        others = [x for x in rest.dims if x not in own]
        size = dict(zip(rest.dims, rest.known()))
        lengths = [extents[x] for x in bond]
        k = min(prod(lengths), prod(size[x] for x in own), prod(size[x] for x in others))
        middle = middles.pop(frozenset(bond), None)
        split = P.Pattern(P.Operand("D", rest.dims), (P.Operand("L", (*own, "_b")), P.Operand("R", ("_b", *others))))
        a, s, b = svd(split, rest, k, absorb="right" if middle is None else "none")
        made[now] = permute(_bonded(a, bond, lengths), list(p.inputs[now].labels))
        if middle is not None:
            made[middle] = permute(_bonded(s.relabel(["_b"]), bond, lengths), list(p.inputs[middle].labels))
        left.remove(now)
        rest = _bonded(b, bond, lengths)
        rest = _kept(rest) if len(left) > 1 else rest
    if middles:
        raise P.PatternError(f"no single bond has the labels of {[p.inputs[i].name for i in middles.values()]}")
    made[left[0]] = permute(rest, list(p.inputs[left[0]].labels))
    return [(conjugate(made[i]) if o.conj != p.dest.conj else made[i]).named(o.name) for i, o in enumerate(p.inputs)]
