"""Tensor programs: scopes of declarations and tensor operations, interpreted into DataFrame expressions.

    entry: main
    scope main group(demo)
     space(real): basis=[0:9]
     subspace(basis): low=[0:3], high=[4:9]
     index(low): i,j
     index(high): a,b
     V(a,i) = method("fill")
     T(i,j) += V(a,i) * V(a,j) * 0.5 : [i<=j]
     save T: tag("result")
    end scope main

A label stands for the range of its subspace; a tensor keeps the ranges that it was created with, and naming it with
labels of other ranges means that slice, in reads and in writes. A label that isn't declared takes the range of the
tensor's dimension. Literal ranges (10:34) are dimensions of the unnamed space. `=` overwrites, `+=` and `-=` add, `*=` and `/=` scale;
`=>` defers a method to the first use, or makes the name a placeholder of a network that uses expand. A tensor assigned to
such a placeholder is factorised into the network's factors, whose bonds have the ranges declared for their labels; a line
A+(i,c) * A(i,d) = DELTA(c,d) makes sure that a factor's columns are orthonormal, or zero. Conditions behind a last colon keep the elements that meet them: [i<j<k], [a>=b], [predicate:a,b]. Scopes see their own tensors only;
export and import pass them on, to the groups named and with the rights given.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tensorweft.functions.functors import Registry
from tensorweft.operators import elementwise as E
from tensorweft.operators.algebra import add, add_pattern, contract
from tensorweft.operators.factorise import factorise
from tensorweft.operators.tensor import Tensor, TensorError, as_complex, c, modulus, settled
from tensorweft.plans import pattern as P
from tensorweft.plans.network import contract_network
from tensorweft.sources.storage import load, save


class ProgramError(ValueError):
    pass


_NAME = r"[A-Za-z][A-Za-z0-9_]*"
_TENSOR = re.compile(rf"({_NAME})(\+?)\(([^()]*)\)")
_RANGE = re.compile(r"\[\s*(\w+)\s*:\s*(\w+)\s*\]")


@dataclass(frozen=True)
class Range:
    space: str
    lo: int
    hi: int

    @property
    def extent(self) -> int:
        return self.hi - self.lo + 1


@dataclass(frozen=True)
class Ref:
    """A tensor as written: its name, labels, and for each label the range if the text gives one."""

    name: str
    labels: tuple[str, ...]
    ranges: tuple[Range | None, ...]
    conj: bool = False


@dataclass
class Held:
    tensor: Tensor | None
    ranges: tuple[Range, ...]
    network: tuple[Ref, list[Ref], complex] | None = None
    deferred: str | None = None
    writable: bool = True
    exported: str | None = None


@dataclass
class Frame:
    name: str
    groups: tuple[str, ...]
    kind: str = "R8"
    spaces: dict[str, Range] = field(default_factory=dict)
    labels: dict[str, Range] = field(default_factory=dict)
    tensors: dict[str, Held] = field(default_factory=dict)


_KINDS = (
    ("create", rf"CREATE_ARRAY\s+{_TENSOR.pattern}|{_TENSOR.pattern}\s*=\s*\?"),
    ("delete", rf"DELETE_ARRAY\s+.+|(?:destroy\s+|~).+"),
    ("scaling", rf"{_TENSOR.pattern}\s*[*/]=\s*[^()]+"),
    ("contraction", rf"{_TENSOR.pattern}\s*[+-]?=\s*{_TENSOR.pattern}(?:\s*\*\s*{_TENSOR.pattern})+(?:\s*\*\s*[^()]+)?"),
    ("addition", rf"{_TENSOR.pattern}\s*[+-]=\s*{_TENSOR.pattern}(?:\s*\*\s*[^()]+)?"),
    ("assignment", rf"{_TENSOR.pattern}\s*=\s*.+"),
)


def recognise(statement: str) -> str | None:
    """What a statement is: create, delete, scaling, contraction, addition or assignment; None for others."""
    return next((kind for kind, text in _KINDS if re.fullmatch(text, statement.strip())), None)


class Program:
    """Interprets a text; tensors of the entry scope stay to be looked at in `tensors` after run()."""

    def __init__(self, spark: SparkSession, text: str, registry: Registry | None = None, storage: str | None = None):
        self.spark, self.registry, self.storage = spark, registry or Registry(), storage
        self.exchange: dict[str, tuple[Held, dict[str, str], str]] = {}
        self.entry, self.scopes = self._scopes(text)
        self.tensors: dict[str, Tensor] = {}

    # ------------------------------------------------------------ structure

    @staticmethod
    def _lines(text: str) -> list[str]:
        out = []
        for line in text.splitlines():
            quoted, kept = False, []
            for ch in line:
                quoted ^= ch == '"'
                if ch == "#" and not quoted:
                    break
                kept.append(ch)
            if (line := "".join(kept).strip()):
                out.append(line)
        return out

    def _scopes(self, text: str) -> tuple[str, dict[str, tuple[tuple[str, ...], list[str]]]]:
        entry, scopes, now = None, {}, None
        for line in self._lines(text):
            if m := re.fullmatch(rf"entry\s*:\s*({_NAME})", line):
                if entry or scopes:
                    raise ProgramError("one entry, before all scopes")
                entry = m[1]
            elif m := re.fullmatch(rf"scope\s+({_NAME})\s*group\(([^)]*)\)", line):
                if now:
                    raise ProgramError(f"scope {m[1]} inside of {now}")
                now = m[1]
                scopes[now] = (tuple(g.strip() for g in m[2].split(",") if g.strip()), [])
            elif m := re.fullmatch(rf"end\s+scope\s+({_NAME})", line):
                if now != m[1]:
                    raise ProgramError(f"end of {m[1]} in {now}")
                now = None
            elif now:
                scopes[now][1].append(line)
            else:
                raise ProgramError(f"outside of a scope: {line}")
        if now or not entry or entry not in scopes:
            raise ProgramError(f"scope {now} has no end" if now else f"no entry scope {entry}")
        return entry, scopes

    def run(self) -> dict[str, Tensor]:
        frame = self._call(self.entry)
        self.tensors = {n: self._value(frame, n).tensor for n, h in frame.tensors.items() if h.network is None}
        return self.tensors

    def _call(self, name: str) -> Frame:
        if name not in self.scopes:
            raise ProgramError(f"no such scope: {name}")
        groups, lines = self.scopes[name]
        frame = Frame(name, (name, "GLOBAL", *groups))
        for line in lines:
            try:
                self._statement(frame, line)
            except (TensorError, P.PatternError, KeyError) as e:
                raise ProgramError(f"{name}: {line}: {e}") from e
        return frame

    # ------------------------------------------------------------ statements

    def _statement(self, f: Frame, line: str) -> None:
        if m := re.fullmatch(r"space\(\s*(real|complex)\s*(?:\|\s*(?:real|complex)\s*)?\)\s*:(.*)", line):
            f.kind = "C8" if m[1] == "complex" else f.kind
            for name, lo, hi in self._ranges(m[2]):
                f.spaces[name] = f.labels[name] = Range(name, lo, hi)
        elif m := re.fullmatch(rf"subspace\(\s*({_NAME})?\s*\)\s*:(.*)", line):
            for name, lo, hi in self._ranges(m[2]):
                space = m[1] or ""
                if space and not (f.spaces[space].lo <= lo and hi <= f.spaces[space].hi):
                    raise ProgramError(f"{name} isn't in {space}")
                f.spaces[name] = f.labels[name] = Range(f.spaces[space].space if space else "", lo, hi)
        elif m := re.fullmatch(rf"index\(\s*({_NAME})\s*\)\s*:(.*)", line):
            if m[1] not in f.spaces:
                raise ProgramError(f"no such subspace: {m[1]}")
            for label in m[2].split(","):
                f.labels[label.strip()] = f.spaces[m[1]]
        elif m := re.fullmatch(r"index\s*:(.*)", line):
            for pair in m[1].split(","):
                new, old = (x.strip() for x in pair.split("="))
                f.labels[new] = f.labels[old]
        elif m := re.fullmatch(r"(load|save|import)\s+(.+?)\s*:\s*tag\(\s*\"([^\"]*)\"\s*\)", line):
            getattr(self, f"_{m[1]}")(f, m[2], m[3])
        elif m := re.fullmatch(r"export\s+(.+?)\s*:\s*tag\(\s*\"([^\"]*)\"\s*\)\s*(?:to\(([^)]*)\))?", line):
            self._export(f, m[1], m[2], m[3])
        elif m := re.fullmatch(rf"invoke\s+({_NAME})", line):
            self._call(m[1])
        elif m := re.fullmatch(r"(?:destroy\s+|~)(.+)", line):
            for x in re.findall(rf"{_NAME}(?:\([^()]*\))?", m[1]):
                self._destroy(f, x)
        else:
            self._operation(f, line)

    def _ranges(self, text: str):
        for m in re.finditer(rf"({_NAME})\s*=\s*{_RANGE.pattern}", text):
            lo, hi = self._integer(m[2]), self._integer(m[3])
            if lo < 0 or hi < lo:
                raise ProgramError(f"no range: [{lo}:{hi}]")
            yield m[1], lo, hi

    def _integer(self, word: str) -> int:
        return int(word) if word.isdigit() else int(self._data(word).real)

    def _data(self, name: str) -> complex:
        if name not in self.registry.data:
            raise ProgramError(f"no external data {name}")
        return complex(self.registry.data[name])

    def _number(self, text: str) -> complex:
        text = text.strip()
        if m := re.fullmatch(r"\{\s*([^,]+),\s*([^}]+)\}", text):
            return complex(float(m[1]), float(m[2]))
        try:
            return complex(float(text.lower().replace("d", "e")))
        except ValueError:
            return self._data(text)

    def _ref(self, f: Frame, text: str) -> Ref:
        m = _TENSOR.fullmatch(text.strip())
        if not m:
            raise ProgramError(f"no tensor: {text!r}")
        labels, ranges = [], []
        for k, part in enumerate(x.strip() for x in m[3].split(",") if x.strip()):
            if r := re.fullmatch(r"(\w+)\s*:\s*(\w+)", part):
                labels.append(f"_lit{k}_{r[1]}_{r[2]}")
                ranges.append(Range("", self._integer(r[1]), self._integer(r[2])))
            elif part.isdigit():
                labels.append(f"_lit{k}_{part}")
                ranges.append(Range("", int(part), int(part)))
            else:
                label = part.rstrip("+")
                labels.append("l_" + label)  # any label may be a column's name so
                ranges.append(f.labels.get(label))
        return Ref(m[1], tuple(labels), tuple(ranges), bool(m[2]))

    # ------------------------------------------------------------ tensors and slices

    def _value(self, f: Frame, name: str) -> Held:
        if name not in f.tensors:
            raise ProgramError(f"{name} isn't defined in {f.name}")
        h = f.tensors[name]
        if h.deferred:
            h.tensor, h.deferred = self.registry.initialise(h.tensor, h.deferred), None
        if h.network:
            dest, inputs, factor = h.network
            h = Held(self._evaluate(f, dest, inputs, factor, dict(zip(dest.labels, h.ranges))), h.ranges)
        if h.tensor is None:
            raise ProgramError(f"{name} has no values yet")
        return h

    def _read(self, f: Frame, ref: Ref) -> tuple[Tensor, tuple[Range, ...]]:
        h = self._value(f, ref.name)
        if len(ref.labels) != len(h.ranges):
            raise ProgramError(f"{ref.name} has {len(h.ranges)} dimensions")
        wanted = tuple(r or own for r, own in zip(ref.ranges, h.ranges))
        for r, own in zip(wanted, h.ranges):
            if not (own.lo <= r.lo and r.hi <= own.hi):
                raise ProgramError(f"[{r.lo}:{r.hi}] isn't in {ref.name}'s [{own.lo}:{own.hi}]")
        t = h.tensor
        if wanted != h.ranges:
            t = E.slice_of(t, [r.lo - own.lo for r, own in zip(wanted, h.ranges)], [r.extent for r in wanted])
        return t, wanted

    def _write(self, f: Frame, ref: Ref, ranges: tuple[Range, ...], make: Callable[[Tensor | None], Tensor]) -> None:
        """make gets the slice as it is (None if there is none) and gives the new one."""
        h = f.tensors.get(ref.name)
        if h is not None and not h.writable:
            raise ProgramError(f"{ref.name} was imported read-only")
        if h is None or (h.tensor is None and h.ranges == ranges) or h.network:
            f.tensors[ref.name] = Held(make(None), ranges, exported=h.exported if h else None)
        else:
            if h.deferred or h.tensor is not None:
                h = self._value(f, ref.name)
            whole = tuple((r.lo, r.hi) for r in ranges) == tuple((r.lo, r.hi) for r in h.ranges)
            if whole:
                h.tensor = make(h.tensor)
            else:
                offsets = [r.lo - own.lo for r, own in zip(ranges, h.ranges)]
                extents = [r.extent for r in ranges]
                base = h.tensor if h.tensor is not None else Tensor.zeros(self.spark, [f"d{i}" for i in range(len(ranges))], [r.extent for r in h.ranges], f.kind, ref.name)
                h.tensor = E.insert(base, make(E.slice_of(base, offsets, extents)), offsets)
        held = f.tensors[ref.name]
        if held.exported is not None:
            self.exchange[held.exported][0].tensor = held.tensor

    def _zeros(self, f: Frame, ref: Ref, ranges: tuple[Range, ...]) -> Tensor:
        return Tensor.zeros(self.spark, ref.labels, [r.extent for r in ranges], f.kind, ref.name)

    def _full_ranges(self, f: Frame, ref: Ref, others: dict[str, Range] | None = None) -> tuple[Range, ...]:
        own = f.tensors[ref.name].ranges if ref.name in f.tensors else (None,) * len(ref.labels)
        out = []
        for label, r, mine in zip(ref.labels, ref.ranges, own):
            r = r or (others or {}).get(label) or mine
            if r is None:
                raise ProgramError(f"label {label} of {ref.name} has no range")
            out.append(r)
        return tuple(out)

    def _restricted(self, t: Tensor, labels: tuple[str, ...], ranges: tuple[Range, ...], conditions: str) -> Tensor:
        t = t.relabel(labels)
        value = {x.removeprefix("l_"): c(x) + r.lo for x, r in zip(labels, ranges)}
        for inside in re.findall(r"\[([^\]]*)\]", conditions):
            if m := re.fullmatch(rf"\s*({_NAME})\s*:(.*)", inside):
                test = self.registry.predicates[m[1]]
                t = E.restrict(t, test(*[value[x.strip()] for x in m[2].split(",")]))
                continue
            parts = re.split(r"(<=|>=|<|>)", inside.replace(" ", ""))
            for a, relation, b in zip(parts[::2], parts[1::2], parts[2::2]):
                x, y = value[a], value[b]
                t = E.restrict(t, {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[relation])
        return t

    # ------------------------------------------------------------ operations

    def _operation(self, f: Frame, line: str) -> None:
        if m := re.fullmatch(rf"\s*({_TENSOR.pattern})\s*\*\s*({_TENSOR.pattern})\s*=\s*(DELTA\([^()]*\))\s*", line):
            self._orthonormal(f, self._ref(f, m[1]), self._ref(f, m[5]), self._ref(f, m[9]))
            return
        m = re.match(r"\s*([^=+*/~>-]+?\+?\([^()]*\))\s*(\+=|-=|\*=|/=|=>|=)\s*(.*)\Z", line)
        if not m:
            raise ProgramError(f"no statement: {line}")
        dest, op, right = self._ref(f, m[1]), m[2], m[3]
        conditions = ""
        if k := re.search(r"(?:\A|[^\[\w]|\))\s*:\s*(\[.*)\Z", right):
            at = right.rindex(":", 0, k.start(1))
            right, conditions = right[:at].strip(), k[1]
        elif k := re.search(r"^([^\":]*(?:\"[^\"]*\"[^\":]*)?):\s*(\[.*|sparse\(.*)\Z", right):
            right, conditions = k[1].strip(), k[2]
        if method := re.fullmatch(r"method\(\s*\"([^\"]*)\"\s*\)", right.strip()):
            ranges = self._full_ranges(f, dest)
            if op == "=>":
                f.tensors[dest.name] = Held(self._zeros(f, dest, ranges), ranges, deferred=method[1])
            else:
                self._write(f, dest, ranges, lambda _: self._restricted(self.registry.initialise(self._zeros(f, dest, ranges), method[1]), dest.labels, ranges, conditions))
            return
        if right.strip() == "?":
            f.tensors[dest.name] = Held(None, self._full_ranges(f, dest))
            return
        found = list(_TENSOR.finditer(right))
        if not found:
            number = self._number(right)
            ranges = self._full_ranges(f, dest)
            if op == "/=":
                op, number = "*=", 1 / number
            if op == "*=":
                self._write(f, dest, ranges, lambda old: E.scale(old, number))
            elif op == "=":
                kind = "C8" if number.imag or f.kind == "C8" else f.kind
                from tensorweft.operators.tensor import full

                made = full(self.spark, dest.labels, [r.extent for r in ranges], number, kind, dest.name) if number else Tensor.zeros(self.spark, dest.labels, [r.extent for r in ranges], kind, dest.name)
                self._write(f, dest, ranges, lambda _: self._restricted(made, dest.labels, ranges, conditions))
            else:
                raise ProgramError(f"{op} with a number")
            return
        inputs = [self._ref(f, x[0]) for x in found]
        rest = right[found[-1].end() :].strip()
        factor = self._number(rest[1:]) if rest.startswith("*") and rest[1:].strip() else 1.0
        if op == "=>":
            ranges = self._full_ranges(f, dest, self._ranges_of(f, inputs))
            f.tensors[dest.name] = Held(None, ranges, network=(dest, inputs, factor))
            return
        if op in ("*=", "/="):
            raise ProgramError(f"{op} takes a number")
        if op == "-=":
            factor = -factor
        if op == "=" and dest.name in f.tensors and f.tensors[dest.name].network and len(inputs) == 1 and set(dest.labels) == set(inputs[0].labels):
            if conditions:
                raise ProgramError("conditions on a factorisation")
            self._factorise(f, dest, inputs[0], factor)
            return
        known = self._ranges_of(f, inputs)
        if len(inputs) == 1 and (set(dest.labels) != set(inputs[0].labels)) and len(set(inputs[0].labels)) == len(inputs[0].labels):
            made, ranges = self._folded(f, dest, inputs[0], known)
        else:
            ranges = self._full_ranges(f, dest, known)
            made = self._evaluate(f, dest, inputs, factor, dict(zip(dest.labels, ranges)))
        made = self._restricted(made, dest.labels, ranges, conditions) if conditions else made

        def update(old: Tensor | None) -> Tensor:
            if op == "=" or old is None:
                return made
            return add(made, old) if made.complex == old.complex else add(as_complex(made), as_complex(old))

        self._write(f, dest, ranges, update)

    def _ranges_of(self, f: Frame, inputs: list[Ref]) -> dict[str, Range]:
        out: dict[str, Range] = {}
        for ref in inputs:
            own = f.tensors[ref.name].ranges if ref.name in f.tensors else ()
            for label, r, mine in zip(ref.labels, ref.ranges, own):
                out.setdefault(label, r or mine)
        return out

    def _evaluate(self, f: Frame, dest: Ref, inputs: list[Ref], factor: complex, ranges: dict[str, Range]) -> Tensor:
        tensors = [self._read(f, ref)[0] for ref in inputs]
        operand = lambda r: P.Operand(r.name, r.labels, r.conj)
        p = P.Pattern(operand(dest), tuple(map(operand, inputs)), "=")
        factor = factor.real if isinstance(factor, complex) and not factor.imag else factor
        if len(inputs) > 2:
            return contract_network(p, *tensors, factor=factor)
        if len(inputs) == 2:
            return contract(p, *tensors, factor=factor)
        if inputs[0].labels and len(set(inputs[0].labels)) < len(inputs[0].labels):
            t = E.trace(p, tensors[0])
            return t if factor == 1 else E.scale(t, factor)
        return add_pattern(p, tensors[0], factor=factor)

    def _factorise(self, f: Frame, dest: Ref, source: Ref, factor: complex) -> None:
        shape, parts, own = f.tensors[dest.name].network
        t, ranges = self._read(f, source)
        t = E.permute(t.relabel(source.labels), list(dest.labels))
        if t.known() != tuple(r.extent for r in f.tensors[dest.name].ranges):
            raise ProgramError(f"{source.name} has extents {t.known()}")
        if not own:
            raise ProgramError("a network times zero has no factors")
        lengths = self._ranges_of(f, parts) | {x: r for ref in parts for x, r in zip(ref.labels, ref.ranges) if r}
        operand = lambda r: P.Operand(r.name, r.labels, r.conj)
        t = E.scale(t, factor / own) if factor != own else t
        made = factorise(P.Pattern(operand(shape), tuple(map(operand, parts)), "="), t, {x: r.extent for x, r in lengths.items() if r})
        for ref, part in zip(parts, made):
            at = {**lengths, **dict(zip(shape.labels, f.tensors[dest.name].ranges))}
            self._write(f, ref, tuple(at[x] for x in ref.labels), lambda _, part=part: part)

    def _orthonormal(self, f: Frame, left: Ref, right: Ref, delta: Ref) -> None:
        """Products of different columns are 0, a column's with itself is 1, or 0 where it has no elements."""
        known = self._ranges_of(f, [left, right])
        ranges = tuple(known.get(x) or r for x, r in zip(delta.labels, delta.ranges))
        if len(delta.labels) != 2 or None in ranges:
            raise ProgramError("DELTA has two labels of known ranges")
        t = self._evaluate(f, delta, [left, right], 1.0, dict(zip(delta.labels, ranges)))
        size = modulus(t)
        wrong = F.when(c(t.dims[0]) == c(t.dims[1]), F.least(size, F.abs(size - 1))).otherwise(size)
        found = settled(t).df.select(F.max(wrong)).first()[0]
        if found is not None and not found <= 1e-8:
            raise ProgramError(f"{left.name}'s columns aren't orthonormal")

    def _folded(self, f: Frame, dest: Ref, source: Ref, known: dict[str, Range]) -> tuple[Tensor, tuple[Range, ...]]:
        t, ranges = self._read(f, source)
        t = t.relabel(source.labels)
        new, gone = [x for x in dest.labels if x not in source.labels], [x for x in source.labels if x not in dest.labels]
        extents = dict(zip(source.labels, (r.extent for r in ranges)))
        if len(new) == 1 and len(gone) > 1:
            t = E.fold(t, gone, new[0])
            r = f.labels.get(new[0].removeprefix("l_")) or Range("", 0, t.extents[t.dims.index(new[0])] - 1)
            if r.extent != t.extents[t.dims.index(new[0])]:
                raise ProgramError(f"{new[0]} has extent {r.extent}")
            made = {**dict(zip(source.labels, ranges)), new[0]: r}
        elif len(gone) == 1 and len(new) > 1:
            made = {**dict(zip(source.labels, ranges)), **{x: f.labels[x.removeprefix("l_")] for x in new}}
            t = E.unfold(t, gone[0], new, [made[x].extent for x in new])
        else:
            raise ProgramError(f"labels of {dest.name} and {source.name} don't fit: {extents}")
        return E.permute(t, list(dest.labels)), tuple(made[x] for x in dest.labels)

    # ------------------------------------------------------------ storage and exchange

    def _path(self, tag: str) -> str:
        if not self.storage:
            raise ProgramError("no storage folder was given")
        return f"{self.storage.rstrip('/')}/{quote(tag, safe='')}"

    def _save(self, f: Frame, text: str, tag: str) -> None:
        t = self._read(f, self._ref(f, text))[0] if "(" in text else self._value(f, text.strip()).tensor
        save(t, self._path(tag), overwrite=True)

    def _load(self, f: Frame, text: str, tag: str) -> None:
        ref, t = self._ref(f, text), load(self.spark, self._path(tag))
        ranges = tuple(r or Range("", 0, n - 1) for r, n in zip(ref.ranges, t.known()))
        if len(ref.labels) != t.rank or any(r.extent != n for r, n in zip(ranges, t.known())):
            raise ProgramError(f"{tag} has extents {t.extents}")
        f.tensors[ref.name] = Held(t.relabel(ref.labels).named(ref.name), ranges)

    def _export(self, f: Frame, text: str, tag: str, to: str | None) -> None:
        if tag in self.exchange:
            raise ProgramError(f"{tag} is exported already")
        rights = {}
        for part in (to or "").split(","):
            if part.strip():
                group, _, access = part.strip().partition(":")
                rights[group.strip()] = access.strip() or "r"
        if "(" in text:
            ref = self._ref(f, text)
            t, ranges = self._read(f, ref)
            held = Held(t, ranges)
            if f.tensors[ref.name].ranges == ranges:
                f.tensors[ref.name].exported = tag
        else:
            whole = self._value(f, text.strip())
            held = Held(whole.tensor, whole.ranges)
            f.tensors[text.strip()].exported = tag
        self.exchange[tag] = (held, rights, f.name)

    def _import(self, f: Frame, text: str, tag: str) -> None:
        if tag not in self.exchange:
            raise ProgramError(f"nothing is exported as {tag}")
        held, rights, _ = self.exchange[tag]
        granted = [rights[g] for g in f.groups if g in rights]
        if rights and not granted:
            raise ProgramError(f"{f.name} may not import {tag}")
        ref = self._ref(f, text)
        if len(ref.labels) != len(held.ranges):
            raise ProgramError(f"{tag} has {len(held.ranges)} dimensions")
        for label, r in zip(ref.labels, held.ranges):
            f.labels.setdefault(label.removeprefix("l_"), r)
        f.tensors[ref.name] = Held(held.tensor, held.ranges, writable=not rights or "w" in granted, exported=tag if not rights or "w" in granted else None)

    def _destroy(self, f: Frame, text: str) -> None:
        if "(" not in text:
            del f.tensors[text.strip()]
            return
        ref = self._ref(f, text)
        h = self._value(f, ref.name)
        ranges = tuple(r or own for r, own in zip(ref.ranges, h.ranges))
        if ranges == h.ranges:
            del f.tensors[ref.name]
        else:
            h.tensor = E.restrict(h.tensor, ~E.inside(h.tensor, [r.lo - own.lo for r, own in zip(ranges, h.ranges)], [r.extent for r in ranges]))
