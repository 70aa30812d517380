import pytest
from corvina.operators import annotations
from corvina.plans import c_loops, c_syntax
from corvina.session import AnalysisSession, register
from pyspark.sql import functions as F


def loops(body):
    tree = c_syntax.Tree(f"void f(int n, int m) {{ {body} }}")
    return [(x["bound_kind"], x["induction"], x["start"], x["bound"], x["step"]) for x in c_loops.loops(tree, tree.functions()[0])]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("for (int i = 0; i < 16; i++) g(i);", ("constant", "i", 0, "16", 1)),
        ("for (i = 0x10; i >= 2; i -= 2) g(i);", ("constant", "i", 16, "2", -2)),
        ("for (i = 0; i <= n; i = i + 3) g(i);", ("parameter", "i", 0, "n", 3)),
        ("for (i = 0; i <= n; i++) n--;", ("runtime", "i", None, None, 1)),
        ("for (i = m; i < 9; i++) ;", ("runtime", "i", None, None, 1)),
        ("for (i = 0; i < 9; i++) i = 2;", ("runtime", "i", None, None, 1)),
        ("for (i = 0; i < 9; i++) g(&i);", ("runtime", "i", None, None, 1)),
        ("for (i = 0; i == 9; i++) ;", ("runtime", "i", None, None, 1)),
        ("for (i = 0; i < 9 && n; i++) ;", ("runtime", "i", None, None, 1)),
        ("for (;;) ;", ("none", None, None, None, None)),
        ("while (n > 0) { n--; m++; }", ("runtime", "n", None, None, -1)),
        ("do { n += 2; n++; } while (n < 9);", ("runtime", None, None, None, None)),
    ],
)
def test_loop_bounds(body, expected):
    assert loops(body) == [expected]


def test_facts():
    text = "// @fact capacity(p) = n\n// @fact: unroll = 0x8\n// @fact strlen(z) = 3\n// @fact nonsense\nint f(char *p, int n) { // @fact unroll = 2\n return 0; }\nchar *s = \"// @fact unroll = 9\";\n// @fact unroll = 4\n"
    found, problems = c_loops.facts(c_syntax.Tree(text))
    assert [(x["kind"], x["parameter"], x["value"]) for x in found] == [("capacity", "p", "n"), ("unroll", None, "0x8")]
    assert [p["message"] for p in problems] == ["f has no parameter z", "this fact can't be read", "no function follows this fact", "no function follows this fact"]
    found, problems = c_loops.facts(c_syntax.Tree(text), [{"function": "f", "kind": "unroll", "value": 5}, {"function": "g", "kind": "unroll", "value": 5}])
    assert ("unroll", "5", "given") in [(x["kind"], x["value"], x["origin"]) for x in found] and problems[-1]["message"] == "no such function"


def test_identity_and_rendering():
    assert annotations.identity("") == "cbf29ce48422232584222325cbf29ce4-0"
    assert annotations.identity("a") != annotations.identity("b") and annotations.identity("é").endswith("-2")
    assert annotations.rendered("int a\nb ? c", "error", "bad", 8, 9) == "error: bad\n 2 | b ? c\n   |   ^"


def test_preprocessing():
    assert annotations.preprocess_one("int a;")["status"] == "not-needed"
    for text in ("#include <a.h>\nint a;", "# include \\\n <a.h>\n#pragma once\n#line 3\n", "x # define\n", "#defined\n"):
        got = annotations.preprocess_one(text)
        assert (got["status"], got["text"], got["includes_removed"]) == ("not-needed", text, False)
    assert list(annotations._directives(["# if A \\", "&& B", "int a;", "\t#\telse", "#"])) == [(0, 2, "if"), (3, 4, "else"), (4, 5, "")]
    got = annotations.preprocess_one("#include <x.h>\n#define A 1\nint f(void) { return A; }\n", compiler="no-such-compiler")
    assert got["status"] == "unavailable" and got["text"].startswith("#include")
    got = annotations.preprocess_one("#include <x.h>\n#define A 1\nint f(void) { return A; }\n")
    assert got["status"] in ("unavailable", "preprocessed", "failed")
    if got["status"] == "preprocessed":
        assert "return 1" in got["text"] and got["includes_removed"]


def test_session_and_table_functions(spark):
    session = AnalysisSession.of_text(spark, "int f(int x) { if (x) return g(x); return 0; }\nint broken(")
    assert session.hotspots(limit=1).first().cyclomatic == 2
    assert session.files.first().functions == 1 and session.diagnostics.count() > 0
    assert session.loops.count() == 0 and session.call_summaries().first().complete is False
    assert session.export("cdg", "mermaid").first().text.startswith("flowchart")
    nodes = session.ast.collect()
    assert nodes[0].tag == "func_def" and nodes[0].subtree_end == len(nodes)
    for n in nodes[1:]:
        assert nodes[n.parent].node < n.node < nodes[n.parent].subtree_end
    with pytest.raises(ValueError):
        session.export("nothing")
    session.close()
    register(spark)
    spark.createDataFrame([("int a(void) { return 1; }",)], "text string").createOrReplaceTempView("texts")
    got = spark.sql("select f.name, t.kind, n.kind as node, e.kind as edge from texts, lateral c_functions(text) f, lateral c_tokens(text) t, lateral c_cfg_nodes(text) n, lateral c_cfg_edges(text) e where t.idx = 1 and n.id = 2 and e.ord = 0").collect()
    assert [tuple(r) for r in got] == [("a", "identifier", "return", "fall")]


def test_lines_and_columns(spark):
    row = spark.createDataFrame([(7, [0, 3, 6])], "at int, starts array<int>").select(annotations.line_column(F.col("at"), F.col("starts")).alias("x")).first().x
    assert (row.line, row.column) == (3, 2)


def blocks(body):
    from corvina.plans import c_parity

    tree = c_syntax.Tree(f"int f(int a, int b) {{ {body} }}")
    return c_parity.blocks(tree, tree.functions()[0])


def test_parity_blocks():
    assert len(blocks("a = 1; b = 2; return a;")["nodes"]) == 1 and blocks("return a;")["degenerate"]
    b = blocks("if (a > 1) b = 1; return b;")
    assert (len(b["nodes"]), len(b["edges"])) == (3, 3)
    loop = blocks("while (a > 1) a--; return a;")
    assert (len(loop["nodes"]), (1, 2) in loop["edges"] and (2, 1) in loop["edges"]) == (4, True)
    jump = blocks("if (a > 1) goto out; b = 1; out: return b;")
    assert len(jump["nodes"]) == 3  # the jump and its label are no blocks
    endless = blocks("while (1) { a++; }")
    assert all(d != 9 for _, d in endless["edges"]) and any(s == d for s, d in endless["edges"])


@pytest.mark.parametrize("representation", ["ast", "cfg", "cdg", "ddg", "pdg"])
def test_representations(spark, representation):
    import json

    session = AnalysisSession.of_text(spark, "int f(int x) { int y = x; if (y) return y; return 0; }")
    data = json.loads(session.export(representation, "json").first().text)
    assert data["nodes"] and data["edges"] and data["graph"]["name"] == "f"
    session.close()


def test_conversions():
    from corvina.functions import c_types

    assert c_types.usual("char", "short") == "int" and c_types.usual("unsigned int", "long") == "long"
    assert c_types.usual("long", "unsigned long long") == "unsigned long long" and c_types.usual("unsigned long", "long long") == "unsigned long long"
    assert c_types.usual("int", "float") == "float" and c_types.usual("long double", "float") == "long double" and c_types.usual("int", "struct s") is None
    for a in c_types.INTEGERS:
        for b in c_types.INTEGERS:
            assert c_types.usual(a, b) == c_types.usual(b, a) or c_types.INTEGERS[a][0] == c_types.INTEGERS[b][0]


def test_literal_types(spark):
    from corvina.functions import c_types

    cases = {"1": "int", "2147483648": "long", "0xffffffff": "unsigned int", "1u": "unsigned int", "1UL": "unsigned long", "0x8000000000000000": "unsigned long", "010": "int", "5l": "long"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.k for r in df.select("t", c_types.literal_type(F.col("t")).alias("k")).collect()} == cases


def test_declared_types(spark):
    from corvina.operators import declared

    text = "int f(const char *s, unsigned long n, struct p *q, int (*cb)(int), undefined8 u) { static volatile int a[2][3]; T *t; { char a; } typedef int z; }"
    rows = declared.declared_types(spark.createDataFrame([("x", text)], "source_id string, text string"))
    got = [(r.name, r.role, r.type, r.pointer_depth, r.array_rank) for r in rows.orderBy("lo").collect()]
    assert got[:3] == [("s", "parameter", "char", 1, 0), ("n", "parameter", "unsigned long", 0, 0), ("q", "parameter", "struct p", 1, 0)]
    assert ("a", "local", "int", 0, 2) in got and ("t", "local", "T", 1, 0) in got and not any(x[0] == "z" for x in got)
    assert [(r.name, r.shapes) for r in declared.type_conflicts(rows).collect()] == [("a", ["char  ", "int  [][]"])]


def test_mutations_are_seeded(spark):
    from corvina.operators import evaluation

    text = "int f(void) { return 1; }"
    assert evaluation.mutate(text, 5, 3) == evaluation.mutate(text, 5, 3) and evaluation.mutate("", 1)[1] == "insert"
    df = spark.createDataFrame([("a", text), ("b", None)], "source_id string, text string")
    assert evaluation.mutated(df, [1, 2], 3).count() == 12
