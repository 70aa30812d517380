"""How often the text formats work out what they need."""

import pytest

from corvina.operators import annotations, exports, lowered
from corvina.plans import stage


def test_graphml_works_its_keys_out_once(spark):
    sources = spark.createDataFrame([("1", "int f(int a) { while (a) { if (a > 1) a--; } return a; }")], "source_id string, text string")
    rows = exports.render(exports.cfg_views(stage.functions(stage.parse(sources))), "graphml")
    # those of nodes and those of edges; within a lambda they would be worked out for every attribute
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 2
    # label, start, end and expression_internal of nodes, label and back of edges
    assert rows.first().text.count("<key id=") == 6


ONE = "// fact: capacity(%s) = %d\n// fact: strlen(b) = a\nint f_%d(int a, unsigned char b, struct s *v_%d)\n{\n    a += b;\n    v_%d->n = 1;\n    return a && g_%d(b++, 1) ? a : v_%d->m_%d;\n}\n"
TEXTS = ["", 'int f(char *p) { return *"a\0b" + p[1] + "x\0y"; }', "int x;", "{ broken", 'int f(char *p) { return p["a\\n"] + *"\\"" ; }', "int f(int a) { /* x */ return 'x' + a; }\n// fact: capacity(a) = 3\nint é(int a) { a = 2; }", "// fact: capacity(z) = 3\nint f(int a) { int a_1[2] = {1}; return 1 < a > 2 & 3; }"]


@pytest.mark.parametrize("fmt", exports.FORMATS)
def test_operations_are_written_as_joined_views_are(spark, fmt):
    texts = [*TEXTS, *(ONE % (p, n * n, n, m, m, n, m, n) for n in (1, 20, 300, 7, 4_000) for m in (2, n) for p in ("a", "b", f"v_{m}", "none"))]
    texts += [ONE % ("a", n, n, n, n, n, n, n) + "\n" + ONE % ("b", n, 2, 3, 3, 4, 3, 5) for n in (1, 12, 12, 123)]
    sources = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "source_id string, text string").coalesce(1)
    wanted = exports.render(lowered.views(lowered.lowered(sources), annotations.facts(sources, marker="fact")), fmt)
    found = lowered.rendered(sources, fmt, marker="fact")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
