import json
import random

import pytest

from corvina.operators import annotations, exports, lowered
from corvina.plans import c_lower
from corvina.plans.c_syntax import Tree

TEXT = """unsigned int total(unsigned int hdr, unsigned int body, unsigned int limit) {
    unsigned int sum = hdr + body;
    if (sum > limit) { return 1; }
    return 0;
}
int checks(int len, unsigned long n, unsigned char bits, unsigned short s) {
    s += 2;
    if (len < n) { return 1u << bits; }
    return n < 0 ? -len : len;
}
"""


def ops(text, name=None):
    tree = Tree(text)
    f = next(f for f in tree.functions() if name in (None, tree.name_of(f)))
    return c_lower.operations(tree, f)


def shape(made):
    return [(o["kind"], o["op"], o["type"], o["inputs"]) for o in made]


def test_a_check_of_lengths():
    made, _ = ops(TEXT, "total")
    assert shape(made)[:11] == [
        ("load", "hdr", "unsigned int", []), ("load", "body", "unsigned int", []), ("binary", "+", "unsigned int", [0, 1]), ("store", "=", "unsigned int", [2]), ("load", "sum", "unsigned int", []),
        ("load", "limit", "unsigned int", []), ("compare", ">", "int", [4, 5]), ("branch", "if", "void", [6]), ("const", "1", "int", []), ("convert", "assignment", "unsigned int", [8]), ("return", "return", "void", [9]),
    ]


def test_conversions_of_each_kind():
    made, _ = ops(TEXT, "checks")
    found = {(o["op"], o["from"], o["to"]) for o in made if o["kind"] == "convert"}
    assert found == {("promotion", "unsigned short", "int"), ("assignment", "int", "unsigned short"), ("usual_arithmetic", "int", "unsigned long"), ("promotion", "unsigned char", "int"), ("assignment", "unsigned int", "int")}
    assert all(set(c_lower.CONVERSIONS) >= {o["op"]} for o in made if o["kind"] == "convert") and {o["kind"] for o in made} <= set(c_lower.KINDS)


def test_arms_are_guarded_and_stand_in_their_own_blocks():
    made, orders = ops(TEXT, "checks")
    select = next(o for o in made if o["kind"] == "select")
    test, yes, no = select["inputs"]
    assert made[test]["kind"] == "compare" and made[yes]["guards"] == [(test, True)] and made[no]["guards"] == [(test, False)] and not select["guards"]
    assert len({made[yes]["block"], made[no]["block"], select["block"]}) == 3
    assert (yes, no, "exclusive") in orders


@pytest.mark.parametrize(
    ("body", "reason"),
    [
        ("return (char) a;", "unsupported_form"),
        ("return sizeof a;", "unsupported_form"),
        ("return elsewhere;", "unsupported_form"),
        ("return 1.5;", "unsupported_form"),
        ("a = a++;", "unsequenced_effects"),
        ("a = b++;", "unsequenced_effects"),
        ("return (*p = a) + *p;", "unsequenced_effects"),
        ("return a + a++;", "unsequenced_effects"),
        ("p[a] = a++;", "unsequenced_effects"),
        ("g(a++, a);", "unsequenced_effects"),
        ("int t[2] = {1, 2};", "braced_initializer"),
        ("a = (b++, b);", None),
        ("a = g(b++);", None),
        ("a = b = 3;", None),
        ("a = ++b;", None),
        ("return a && b++ || a--;", None),
        ("return a ? b++ : b--;", None),
        ("a = g(1) + g(2);", None),
        ("p[a] += b;", None),
        ("return a + b++;", None),
    ],
)
def test_declined_roots_are_one_unknown_with_a_reason(body, reason):
    made, _ = ops(f"int f(int a, int b, int *p) {{ {body} {'' if 'return' in body else 'return 0;'} }}")
    unknown = [o for o in made if o["kind"] == "unknown"]
    assert [o["reason"] for o in unknown] == ([reason] if reason else [])
    assert reason is None or unknown[0] is made[0]


def test_calls_may_come_in_either_order_and_sequence_points_hold():
    made, orders = ops("int f(int a, int b) { a = g(1) + g(2); return (a++, b) && a; }")
    calls = [i for i, o in enumerate(made) if o["kind"] == "call"]
    assert (*calls, "indeterminate") in orders
    step = next(i for i, o in enumerate(made) if o["kind"] == "store" and i > calls[1] + 4)
    later = [i for i, o in enumerate(made) if o["op"] == "b" or o["op"] == "a" and i > step]
    assert all((step, i, "sequenced") in orders for i in later[:1])


def test_members_arrays_results_and_typedefs_have_types():
    text = "typedef unsigned char byte; struct q { int a; byte *b, c[4]; struct q *next; struct { int z; } in; }; short g(int x); struct r { struct q q; };"
    made, _ = ops(text + "int f(struct q *p, struct r s, int i) { int t[3]; byte *k[2]; i = p->next->c[1]; i = g(i) + s.q.a; i = t[i] + *k[1]; return p->b - s.q.b; }")
    loads = [(o["op"], o["type"]) for o in made if o["kind"] == "load" and o["access"] != "scalar"]
    assert loads == [(".", "struct q *"), ("[]", "unsigned char"), (".", "int"), ("[]", "int"), ("[]", "unsigned char *"), ("*", "unsigned char"), (".", "unsigned char *"), (".", "unsigned char *")]
    assert [o["type"] for o in made if o["kind"] == "call"] == ["short"] and [o["type"] for o in made if o["op"] == "-"] == ["long"]
    assert [(o["type"], o.get("name")) for o in made if o["op"] == "decay"] == [("unsigned char *", None), ("int *", "t"), ("unsigned char * *", "k")]


def test_scopes_and_loops():
    made, _ = ops("int f(int n) { int s = 0; for (int i = 0; i < n; i++) { int n = i; s += n; } do s--; while (s); switch (n) { case 1: return n; } while (n) n--; return s; }")
    assert [o["op"] for o in made if o["kind"] == "branch"] == ["for", "do_while", "switch", "while"]
    inner = {o["declared"] for o in made if o.get("name") == "n"}
    assert len(inner) == 2 and all(i < k for k, o in enumerate(made) for i in o["inputs"])


def test_random_expressions_follow_their_inputs():
    r = random.Random(4)

    def expression(depth):
        if not depth:
            return r.choice(["a", "b", "c", "7", "p[1]", "*p"])
        x, y, z = (expression(depth - 1) for _ in range(3))
        return r.choice([f"({x} {r.choice(['+', '-', '*', '<<', '<', '==', '&&', '||', '|'])} {y})", f"(-{x})", f"(!{x})", f"({x} ? {y} : {z})", f"g({x}, {y})", f"({x}, {y})"])

    for _ in range(60):
        made, orders = ops(f"long f(int a, unsigned short b, unsigned long c, char *p) {{ return {expression(3)}; }}")
        assert made[-1]["kind"] == "return" and all(v < i for i, o in enumerate(made) for v in o["inputs"])
        taken = {v for o in made for v in o["inputs"]}
        assert taken == set(range(len(made) - 1))  # each value is taken
        assert all(a < b for a, b, _ in orders)
        for o in made:
            for c, _ in o["guards"]:
                assert made[c]["kind"] not in ("store", "branch")


@pytest.mark.parametrize("text", ["", "int f(", "int f(int a) { a +; ; b[; }", "int f() { return ((((; }", "int f(x) int x; { return x; }", "int f(void) { goto *p; }", "}}}", "int f(int a) { return a ? : 2; }"])
def test_odd_texts(text):
    tree = Tree(text)
    for f in tree.functions():
        c_lower.operations(tree, f)


def test_views_in_all_formats_with_facts(spark):
    text = "// fact: capacity(p) = n\nint at(char *p, unsigned long n) { { char *p = 0; *p = 1; } return p[n - 1]; }\nint casts(int n) { return (char) n; }"
    sources = spark.createDataFrame([("s", text), ("empty", None)], "source_id string, text string")
    made = lowered.lowered(sources).cache()
    views = lowered.views(made, annotations.facts(sources, marker="fact"))
    graphs = {r.name: json.loads(r.text) for r in exports.render(views, "json").collect()}
    nodes = graphs["at"]["nodes"]
    told = [n for n in nodes if "facts" in n]
    assert [(n["name"], n["facts"], n["facts_source"], n["kind"]) for n in told] == [("p", "capacity=n", "comment", "load")]
    lo, hi = map(int, told[0]["declared"].split(":"))
    assert text.encode()[lo:hi] == b"p" and lo < text.index("{")
    last = next(n for n in nodes if n["op"] == "[]")
    assert [(e["source"], e["index"]) for e in graphs["at"]["edges"] if e["target"] == last["id"]] == [(int(v), str(i)) for i, v in enumerate(last["inputs"].split(","))]
    assert [(n["kind"], n["op"], n["type"], n["reason"]) for n in graphs["casts"]["nodes"]] == [("unknown", "return", "unknown", "unsupported_form")]
    lo, hi = map(int, graphs["casts"]["nodes"][0]["span"].split(":"))
    assert text.encode()[lo:hi] == b"(char) n"
    for fmt in exports.FORMATS:
        assert len({r.text for r in exports.render(views, fmt).collect()}) == 2
    assert lowered.operations(made).filter("function = 'at'").count() == len(nodes)
