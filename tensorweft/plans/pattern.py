"""Index notation: `D(a,b) += L(c,a) * R(c,b)` and its relatives, parsed and checked.

A `+` between a name and its parenthesis conjugates the operand; a `+` behind a label marks it as contravariant, which
is recorded and otherwise of no effect. Labels are separated by `,` or `|`. `T()` is a scalar. A factor may stand behind
a last `*`; a `*` with nothing behind it is ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_RANK = 56
MAX_LENGTH = 1024
MAX_NAME = 64

_OPERAND = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*(\+?)\s*\(([^()]*)\)\s*")
_ASSIGN = re.compile(r"\s*(\+=|-=|\*=|/=|=)\s*")
_LABEL = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)(\+?)\Z")
_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eEdD][+-]?\d+)?)\s*\Z")


class PatternError(ValueError):
    """A pattern that isn't index notation, or that the operation asked for doesn't allow."""


@dataclass(frozen=True)
class Operand:
    name: str
    labels: tuple[str, ...]
    conj: bool = False
    contravariant: tuple[bool, ...] = ()

    @property
    def rank(self) -> int:
        return len(self.labels)

    @property
    def repeated(self) -> bool:
        return len(set(self.labels)) < len(self.labels)


@dataclass(frozen=True)
class Pattern:
    dest: Operand
    inputs: tuple[Operand, ...]
    assign: str = "+="
    factor: float = 1.0
    text: str = field(default="", compare=False)

    @property
    def kind(self) -> str:
        return classify(self)

    def contracted(self) -> tuple[str, ...]:
        """Labels on the right only, in order of appearance."""
        return tuple(dict.fromkeys(x for o in self.inputs for x in o.labels if x not in self.dest.labels))

    def shared(self) -> tuple[str, ...]:
        """Labels that both inputs of a pair have."""
        left, right = self.inputs
        return tuple(x for x in left.labels if x in right.labels)

    def batch(self) -> tuple[str, ...]:
        """Labels that the destination and both inputs have."""
        return tuple(x for x in self.shared() if x in self.dest.labels)


def _operand(m: re.Match) -> Operand:
    name, conj, inside = m.groups()
    if len(name) > MAX_NAME:
        raise PatternError(f"name longer than {MAX_NAME}: {name}")
    labels, marks = [], []
    if inside.strip():
        for part in re.split(r"[,|]", inside):
            found = _LABEL.match(part.strip())
            if not found:
                raise PatternError(f"not a label: {part!r}")
            labels.append(found[1])
            marks.append(bool(found[2]))
    if len(labels) > MAX_RANK:
        raise PatternError(f"rank above {MAX_RANK}")
    return Operand(name, tuple(labels), bool(conj), tuple(marks))


def parse(text: str) -> Pattern:
    """Any right side of one or more operands; see the check_ functions for what an operation allows."""
    if len(text) > MAX_LENGTH:
        raise PatternError(f"pattern longer than {MAX_LENGTH}")
    m = _OPERAND.match(text)
    if not m:
        raise PatternError(f"no destination: {text!r}")
    dest, at = _operand(m), m.end()
    a = _ASSIGN.match(text, at)
    if not a:
        raise PatternError(f"no assignment behind the destination: {text!r}")
    at, inputs, factor = a.end(), [], 1.0
    while True:
        m = _OPERAND.match(text, at)
        if not m:
            n = _NUMBER.match(text, at)
            if inputs and n:
                factor, at = float(n[1].lower().replace("d", "e")), len(text)
                break
            if inputs and not text[at:].strip():
                break
            raise PatternError(f"operand expected at {at}: {text!r}")
        inputs.append(_operand(m))
        at = m.end()
        if text[at:].strip() == "":
            break
        if text[at] != "*":
            raise PatternError(f"* expected at {at}: {text!r}")
        at += 1
    if dest.repeated:
        raise PatternError("a label stands twice in the destination")
    return Pattern(dest, tuple(inputs), a[1], factor, text)


def classify(p: Pattern) -> str:
    """copy, permute, trace, scalar, scale, outer, inner, hadamard, khatri_rao, contraction, hyper or network."""
    if len(p.inputs) > 2:
        return "network"
    if len(p.inputs) == 1:
        one = p.inputs[0]
        if one.repeated or set(one.labels) - set(p.dest.labels):
            return "trace"
        return "copy" if one.labels == p.dest.labels else "permute"
    left, right = p.inputs
    if not left.labels and not right.labels:
        return "scalar"
    if not left.labels or not right.labels:
        return "scale"
    shared, batch, summed = set(p.shared()), set(p.batch()), set(p.contracted())
    if not shared:
        return "outer"
    if not summed:
        return "hadamard" if set(left.labels) == set(right.labels) else "khatri_rao"
    if not p.dest.labels:
        return "inner"
    return "hyper" if batch else "contraction"


def check_pair(p: Pattern) -> Pattern:
    """Contractions: two inputs; no label twice in one; labels on the right only stand once in each of them."""
    if len(p.inputs) != 2:
        raise PatternError(f"two inputs expected, {len(p.inputs)} found")
    for o in p.inputs:
        if o.repeated:
            raise PatternError(f"a label stands twice in {o.name}; traces have an operation of their own")
    left, right = (set(o.labels) for o in p.inputs)
    for x in p.contracted():
        if x not in left or x not in right:
            raise PatternError(f"label {x} stands on the right only, and in one input only")
    for x in p.dest.labels:
        if x not in left | right:
            raise PatternError(f"label {x} of the destination is in no input")
    return p


def check_unary(p: Pattern) -> Pattern:
    """Copies and additions: one input with exactly the destination's labels."""
    if len(p.inputs) != 1:
        raise PatternError(f"one input expected, {len(p.inputs)} found")
    one = p.inputs[0]
    if one.repeated or set(one.labels) != set(p.dest.labels) or one.rank != p.dest.rank:
        raise PatternError(f"{one.name} must have the labels of {p.dest.name}, once each")
    return p


def check_trace(p: Pattern) -> Pattern:
    """Traces: labels that repeat may stay (a diagonal) or be summed; single ones must stay."""
    if len(p.inputs) != 1:
        raise PatternError(f"one input expected, {len(p.inputs)} found")
    one = p.inputs[0]
    for x in set(one.labels):
        if one.labels.count(x) == 1 and x not in p.dest.labels:
            raise PatternError(f"label {x} stands once and isn't in the destination")
    for x in p.dest.labels:
        if x not in one.labels:
            raise PatternError(f"label {x} of the destination isn't in {one.name}")
    return p


def check_network(p: Pattern) -> Pattern:
    """Networks: no label twice in one operand; a label that is summed stands in two inputs or more."""
    for o in p.inputs:
        if o.repeated:
            raise PatternError(f"a label stands twice in {o.name}")
    for x in p.contracted():
        if sum(x in o.labels for o in p.inputs) < 2:
            raise PatternError(f"label {x} stands on the right only, and in one input only")
    for x in p.dest.labels:
        if not any(x in o.labels for o in p.inputs):
            raise PatternError(f"label {x} of the destination is in no input")
    return p
