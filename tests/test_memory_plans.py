"""How often memory's operators do their work."""

from collections import Counter

import pyarrow as pa

from corvina.operators import memory
from corvina.plans import c_memory, stage
from corvina.plans.c_syntax import Tree

TEXT = "void touch_%d(int *q)\n{\n    *q = 1;\n}\nint order_%d(int *in, int b)\n{\n    int x = 0;\n    int *p = &x;\n    *p = %d;\n    b = *p;\n    touch_%d(in);\n    return x;\n}\n"


def test_flows_ask_for_targets_and_accesses_once(spark):
    sources = spark.createDataFrame([("1", TEXT % (1, 1, 7, 1)), ("2", TEXT % (20, 20, 77, 20))], "source_id string, text string")
    functions = stage.written(memory.steps(sources))
    rows = memory.flows(functions, memory.points_to(functions))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    found = {(r.source_id, r.write, r.read, r.read_region, r.via) for r in rows.collect()}
    assert {r[1:] for r in found if r[0] == "1"} == {r[1:] for r in found if r[0] == "2"} and any(r[4] == "same" for r in found)


def test_rows_leave_in_few_batches():
    arrow = pa.schema([("n", pa.int32())])
    sizes = [b.num_rows for b in memory._batches(({"n": n} for n in range(12_000)), arrow)]
    assert sum(sizes) == 12_000 and len(sizes) == 3


def test_steps_of_alike_texts_are_those_read_alone():
    for _ in range(3):
        for n in (1, 20, 300, 4_000):
            text = TEXT % (n, n, n % 9 + 1, n)
            tree = Tree(text)
            assert c_memory.functions(text) == [{"function": tree.name_of(f)} | c_memory.steps(tree, f) for f in tree.functions()]


WALK = "int walk_%d(struct n *p, int b)\n{\n    struct n *q = p;\n    union u { int a; struct { int c; } d; } w, *v = &w;\n    q->v = 5;\n    w.a = %d;\n    while (b) { p = p->next; q->next->next->v = b; b--; }\n    b = v->d.c + *w_%d;\n    return q->v;\n}\n"
SWAP = "void swap_%d(int *p, int **r, struct s *m)\n{\n    int t[%d], *o = t;\n    *r = p; t[1] = *p; m->in.a = *o; m->in = *m->k;\n    touch_%d(*r); swap_%d(o, &p, m); other(&m->in, t);\n    *p = m->in.a;\n}\n"


def test_what_is_solved_within_a_text_is_what_joins_give(spark):
    texts = ["", "int x;", "{ broken", 'void f(char *c) { c = "text"; *c = 1; }']
    for n in (1, 2, 20, 300, 2, 77):
        texts += [TEXT % (n, n, n, n), TEXT % (n, n, 5, 9) + SWAP % (n, n, n, n), WALK % (n, n, 3), SWAP % (n, n, n, n) * 2, SWAP % (n, 4, n, n) + WALK % (n, 9, n)]
    sources = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "source_id string, text string").coalesce(1)
    functions = stage.written(memory.steps(sources))
    targets = memory.points_to(functions)
    flows = memory.flows(functions, targets)
    node = {(r.source_id, r.function_id, s.ord): s.node for r in functions.collect() for s in r.steps}
    wanted = {
        "targets": [tuple(r) for r in targets.collect()], "effects": [(r.source_id, r.function_id, r.parameter, r.op) for r in memory.effects(functions, targets).collect()],
        "flows": [(r.source_id, r.function_id, r.write, r.read, r.region, r.read_region, r.via) for r in flows.collect()],
    }
    for what, rows in wanted.items():
        found = memory.within(sources, what)
        assert rows and sorted(rows) == sorted((*r[:2], *r[3:]) for r in found.collect()), what
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan
    counted = Counter((*r[:2], node[r[0], r[1], r[2]], node[r[0], r[1], r[3]], *r[4:]) for r in wanted["flows"])
    assert counted == {(*r[:2], *r[3:-1]): r.n for r in memory.within(sources, "counted").collect()}
    nested = [(r.source_id, r.function_id, *x) for r in memory.within(sources, "flows", nested=True).collect() for x in r.found]
    assert sorted(nested) == sorted(wanted["flows"])
