import pytest

from tensorweft.plans import pattern as P


def test_marks_and_separators():
    p = P.check_pair(P.parse("D(ia1,ib2)+=L(ib2|k2+,c3)*R+(c3+,ia1,k2)"))
    assert p.inputs[1].conj and not p.inputs[0].conj
    assert p.inputs[0].labels == ("ib2", "k2", "c3") and p.inputs[0].contravariant == (False, True, False)
    assert p.contracted() == ("k2", "c3") and p.kind == "contraction"


@pytest.mark.parametrize("text, kind", [
    ("D(a,b)+=L(a,b)", "copy"), ("D(a,b)+=L(b,a)", "permute"), ("T()+=X(a,a)", "trace"), ("T(a)+=X(c,a,c)", "trace"), ("D()+=L()*R()", "scalar"), ("D(a)+=K()*L(a)", "scale"),
    ("D(i,j)+=L(i)*R(j)", "outer"), ("H(a,b)+=L(a,b)*R(b,a)", "hadamard"), ("H(a,b,c)+=L(a,c)*Y(c,b)", "khatri_rao"), ("E()+=D+(a,b)*D(a,b)", "inner"), ("D(a,b)+=L(a,c)*R(c,b)", "contraction"),
    ("D(i,j,k)+=L(k,a,i,b)*R(b,k,a,j)", "hyper"), ("N(a,d)+=A(a,b)*B(b,c)*C(c,d)", "network"),
])
def test_kinds(text, kind):
    assert P.parse(text).kind == kind


def test_tolerated():
    assert len(P.parse("D(a,b,r,s)+=V(a,q,r,s)*C(q,b)*").inputs) == 2
    assert P.parse("D(a) = L(a) * -1.5d1").factor == -15.0
    assert P.parse("T()+=L()").dest.labels == ()


@pytest.mark.parametrize("text", ["", "D(a)", "D(a)+=", "D(a+=L(a)", "D(a)+=L(a", "D(a,a)+=L(a,a)", "D(a,)+=L(a)", "D(1a)+=L(1a)", "D(a)+=L(a)+R(a)", "D(a)L(a)", "D(a)+=L(a)*x", "D(" + ",".join(f"a{i}" for i in range(57)) + ")+=L()", "D(a)+=" + "L" * 65 + "(a)", "D(a)+=L(a)" + " " * 1024])
def test_not_patterns(text):
    with pytest.raises(P.PatternError):
        P.parse(text)


@pytest.mark.parametrize("check, text", [
    (P.check_pair, "D(a)+=L(a,b)"), (P.check_pair, "D(a)+=L(a,b,b)*R(b)"), (P.check_pair, "D(a)+=L(a,b)*R(c)"), (P.check_pair, "D(a)+=A(a)*B()*C()"), (P.check_pair, "D(z)+=L(a)*R(a)"),
    (P.check_unary, "D(a)+=L(a,b)"), (P.check_unary, "D(a,b)+=L(a)"), (P.check_trace, "T()+=L(a)"), (P.check_trace, "T(b)+=L(a,a)"), (P.check_network, "D(a)+=A(a,b)*B(c)*C(c)"),
])
def test_refused(check, text):
    with pytest.raises(P.PatternError):
        check(P.parse(text))
