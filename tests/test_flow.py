import pytest
from corvina.plans import c_dataflow, c_syntax


def flow(text):
    tree = c_syntax.Tree(text)
    return c_dataflow.analyse(tree, tree.functions()[0])[0]


def pairs(f):
    return sorted((f.names[f.definitions[d]["binding"]], f.definitions[d]["kind"]) for d, _ in f.edges)


def named(f, rows, table):
    return sorted(f.names[getattr(f, table)[i]["binding"]] for i in rows)


def test_straight_line():
    f = flow("int f(int x){int y=x;return y;}")
    assert pairs(f) == [("x", "parameter"), ("y", "declaration")] and not f.issues
    assert c_dataflow.dead_stores(f) == [] == c_dataflow.unresolved(f)


def test_the_old_value_is_read():
    f = flow("int f(int x){ x = x + 1; return x; }")
    assert pairs(f) == [("x", "assignment"), ("x", "parameter")]
    f = flow("int f(int x){ x += 1; x++; return x; }")
    assert pairs(f) == [("x", "compound_assignment"), ("x", "inc_dec"), ("x", "parameter")]


def test_branches_join_and_loops_carry():
    f = flow("int f(int a){ int x = 1; if (a) x = 2; return x; }")
    assert pairs(f) == [("a", "parameter"), ("x", "assignment"), ("x", "declaration")]
    f = flow("int f(int n){ int s = 0; while (n) { s = s + n; n--; } return s; }")
    assert pairs(f).count(("s", "assignment")) == 2 and pairs(f).count(("n", "inc_dec")) == 3


def test_dead_unused_unresolved():
    f = flow("int f(int a, int b){ int x = 1; x = 2; int unused; int *p = &b; return g + x; }")
    assert named(f, c_dataflow.dead_stores(f), "definitions") == ["p", "x"]
    assert {f.names[b] for b in c_dataflow.unused(f)} == {"a", "p", "unused"}
    assert named(f, c_dataflow.unresolved(f), "uses") == ["g"]


def test_scopes_shadow():
    f = flow("int f(int x){ { int x = 2; x = 3; } return x; }")
    assert pairs(f) == [("x", "parameter")]


def test_weak_writes_and_pointers():
    f = flow("int f(int i){ int a[2] = {0, 0}; a[i] = 1; return a[0]; }")
    assert ("a", "declaration") in pairs(f) and ("a", "memory_write") in pairs(f)
    f = flow("void f(int *p){ *p = 1; }")
    assert {x["kind"] for x in f.issues} >= {"unknown_memory_effect"}


def test_unread_operands():
    f = flow("int f(int x, int y){ return sizeof x + sizeof(y); }")
    assert f.uses == []


def summaries(text, policy="unknown"):
    return c_dataflow.summaries(c_syntax.Tree(text), policy)


CHAIN = "int g(int a,int b){ if (b) return a; return 0; } int h(int q){ int w = q; return g(w, 3); } int k(int q){ return h(q); } int loop(int x){ return loop(x); }"


def test_summaries_and_verdicts():
    made = summaries(CHAIN)
    assert [(m.name, m.complete, m.returns) for m in made] == [("g", True, {0, 1}), ("h", True, {0}), ("k", True, {0}), ("loop", True, set())]
    got = c_dataflow.reaches(made, "k", 0, "g")
    assert got["verdict"] == "yes" and got["path"] == [("k", 0), ("h", 0), ("g", 0)]
    assert c_dataflow.reaches(made, "g", 0, "k")["verdict"] == "no"
    assert c_dataflow.reaches(made, "g", 0, "g")["path"] == [("g", 0)]
    assert c_dataflow.reaches(made, "none", 0, "g")["uncertainty"] == ["missing_source"]
    assert c_dataflow.reaches(made, "g", 9, "k")["verdict"] == "no"


def test_what_is_unknown_stays_unknown():
    made = summaries("int f(int x){ return ext(x); } int d(int x){ return 1; } int d(int y){ return y; } int c(int x){ return d(x); }")
    got = c_dataflow.reaches(made, "f", 0, "zz")
    assert got["verdict"] == "unknown" and got["uncertainty"] == ["incomplete_summary", "missing_callee"]
    assert c_dataflow.reaches(made, "d", 0, "f")["uncertainty"] == ["ambiguous_source"]
    assert "ambiguous_callee" in c_dataflow.reaches(made, "c", 0, "zz")["uncertainty"]
    assert summaries("int f(int x){ return ext(x); }", "taint_return")[0].returns == {0}
    assert summaries("int f(int x){ return ext(x); }", "assume_pure_no_flow")[0].complete
    with pytest.raises(ValueError):
        summaries("", "maybe")


def test_builtins_are_known():
    made = summaries("int f(int x){ return __builtin_expect(x, 1); } int g(int x){ return __builtin_constant_p(x); } int h(int x){ return __builtin_clzll(x, x); }")
    assert [(m.complete, m.returns) for m in made] == [(True, {0}), (True, set()), (False, set())]
    assert len(c_dataflow.BUILTINS) == 22


def test_reaching_by_number():
    made = summaries("int d(int x){ return 1; } int d(int y){ return g(y); } int g(int z){ return z; } int c(int x){ return d(x); }")
    assert c_dataflow.reaches_by_id(made, 1, 0, 2)["path"] == [(1, 0), (2, 0)]
    assert c_dataflow.reaches_by_id(made, 0, 0, 2)["verdict"] == "no"
    assert c_dataflow.reaches_by_id(made, 3, 0, 2) == {"verdict": "unknown", "path": [], "explored": 1, "uncertainty": ["ambiguous_callee", "incomplete_summary"]}
    assert c_dataflow.reaches_by_id(made, 1, 0, 9)["uncertainty"] == ["missing_sink"]
