import hashlib
import itertools
import random

import numpy as np
import pytest
from corvina.operators import evaluation, graphs
from corvina.plans import c_depend, c_graph, c_measure, c_syntax


def graph(body, syntactic=False):
    tree = c_syntax.Tree(f"int f(int a, int b) {{ {body} }}")
    return c_graph.graph_of(tree, tree.functions()[0], syntactic)


def edges(g):
    return sorted((g.kinds[s] + str(s), g.kinds[d] + str(d), k, b) for s, d, k, b in g.edges)


@pytest.mark.parametrize(
    ("body", "nodes", "n_edges", "cyclomatic", "back"),
    [
        ("", 2, 1, 1, 0),
        ("return a;", 3, 2, 1, 0),
        ("if (a) return 1; return 0;", 5, 5, 2, 0),
        ("if (a) ; a = 1;", 4, 4, 2, 0),
        ("while (a) a--;", 4, 4, 2, 1),
        ("do a--; while (a);", 4, 4, 2, 1),
        ("for (;;) { if (a) break; }", 5, 6, 3, 1),
        ("for (int i = 0; i < a; i++) { if (i) continue; b++; }", 8, 9, 3, 1),
        ("switch (a) { case 1: b = 1; case 2: b = 2; break; default: b = 3; }", 10, 11, 3, 0),
        ("switch (a) { case 1: b = 1; }", 5, 5, 2, 0),
        ("if (a && b) a = 1;", 6, 7, 3, 0),
        ("a = b ? 1 : 2;", 7, 7, 2, 0),
        ("int x; static int y; ; return;", 3, 2, 1, 0),
        ("goto end; a = 1; end: return a;", 5, 4, 1, 0),
        ("again: a--; if (a) goto again;", 6, 6, 2, 1),
        ("while (a && b) a--;", 8, 10, 4, 1),
        ("int n = a; int v[n]; v[0] = 1;", 5, 4, 1, 0),
    ],
)
def test_graph_measures(body, nodes, n_edges, cyclomatic, back):
    m = graph(body).metrics()
    assert (m["n_nodes"], m["n_edges"], m["cyclomatic"], m["back_edges"]) == (nodes, n_edges, cyclomatic, back)
    assert m["unreachable_nodes"] == 0


def test_duff_and_nested_labels():
    g = graph("switch (a) { case 0: do { b++; case 1: b--; } while (a); }")
    assert g.metrics()["unreachable_nodes"] == 0 and g.kinds.count("case") == 2
    g = graph("if (a) goto in; while (b) { in: b--; } return b;")
    assert all(g.live())


def test_computed_goto():
    g = graph("void *t[2] = {&&x, &&y}; goto *t[a]; x: return 1; y: return 2;")
    assert "indirect_dispatch" in g.kinds and g.kinds.count("label") == 2
    assert graph("goto *p;").kinds[2] == "diverge"

    def targets(body):
        g = graph(body)
        n = g.kinds.index("indirect_dispatch")
        return sum(e[0] == n for e in g.edges)

    labels = "x: return 1; y: return 2; z: return 3;"
    assert targets("static void *t[] = {&&x, &&y}; void *u = &&z; goto *t[a]; " + labels) == 2
    assert targets("static void *t[] = {&&x, &&y}; void *u = &&z; goto *t[1]; " + labels) == 1
    assert targets("void *t[] = {&&x, &&y}; void *u = &&z; t[0] = u; goto *t[a]; " + labels) == 3
    assert targets("void *p = &&x; void *q = &&y; goto *p; " + labels) == 1
    assert targets("void *p = &&x; if (a) p = &&y; goto *p; " + labels) == 2


def test_strays_diverge():
    for body in ("break;", "continue;", "goto nowhere;"):
        g = graph(body)
        assert g.kinds[2] == "diverge" and g.notes
        assert g.metrics()["dead_end_nodes"] == 0


def test_unreachable_statements_by_the_second_build():
    u = c_measure.unit("int f(void) { return 1; a(); b(); }")["functions"][0]
    assert u["unreachable_statements"] == 2
    assert graph("while (1) { break; a = 2; }", True).metrics()["unreachable_nodes"] == 1


def test_cognitive_rules():
    def score(body):
        return c_measure.unit(f"int f(int a) {{ {body} }}")["functions"][0]["cognitive"]

    assert score("if (a) b(); else if (c) d(); else e();") == 3
    assert score("if (a) { while (b) { if (c) d(); } }") == 6
    assert score("x = a && b && c;") == 1 and score("x = a && b || c;") == 2
    assert score("while (a ? b : c) d();") == 2
    assert score("switch (a) { case 1: if (b) c(); }") == 3
    assert score("goto x; x: ;") == 1


def reach(n, es, start, banned):
    near = {}
    for s, d in es:
        near.setdefault(s, []).append(d)
    seen, stack = set(), [start] if start != banned else []
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += [y for y in near.get(x, []) if y != banned]
    return seen


def test_post_dominators_by_definition():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(2, 8)
        es = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 12))]
        es = [e for e in es if e[0] != 1]
        ipdom, stuck = c_depend.post_dominators(n, es)
        if stuck:
            continue
        for x in range(n):
            want = {y for y in range(n) if y == x or 1 not in reach(n, es, x, y)}
            chain, y = {x}, ipdom[x]
            while y >= 0:
                chain.add(y)
                y = ipdom[y]
            assert chain == want


def test_control_dependence_by_definition():
    rng = random.Random(2)
    for _ in range(100):
        n = rng.randrange(3, 8)
        es = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2, 12))})
        es = [e for e in es if e[0] != 1]
        ipdom, stuck = c_depend.post_dominators(n, es)
        if stuck:
            continue

        def after(x, ipdom=ipdom):
            out = {x}
            while ipdom[x] >= 0:
                x = ipdom[x]
                out.add(x)
            return out

        want = {(s, x, "e") for s, d in es for x in range(n) if x in after(d) and not (x in after(s) and x != s)}
        assert set(c_depend.control_dependence(n, [(s, d, "e") for s, d in es], ipdom)) == want


def test_endless_loops_are_rooted():
    ipdom, stuck = c_depend.post_dominators(4, [(0, 2), (2, 3), (3, 2)])
    assert stuck == [0, 2] and ipdom == [-1, -1, -1, 2]


def test_edit_distance_over_all_assignments():
    rng = random.Random(3)

    def shape():
        return [(rng.randrange(3), rng.randrange(3), i == 0, i == 1) for i in range(rng.randrange(1, 5))]

    def cost(a, b):
        if a is None and b is None:
            return 0
        if a is None or b is None:
            return 1 + sum((a or b)[:2])
        return abs(a[0] - b[0]) + abs(a[1] - b[1]) + 100_000 * (a[2:] != b[2:])

    for _ in range(60):
        x, y = shape(), shape()
        left, right = x + [None] * len(y), y + [None] * len(x)
        best = min(sum(cost(a, b) for a, b in zip(left, p, strict=True)) for p in itertools.permutations(right)) if len(left) <= 6 else None
        got, rough = c_depend.edit_distance(x, y, 1, 1)
        assert not rough and got == c_depend.edit_distance(y, x, 1, 1)[0]
        assert best is None or got == best
    assert c_depend.edit_distance([(0, 0, False, False)] * 201, [], 5, 1) == (205, True)


def test_chains_and_slices():
    assert c_depend.chains(6, [(0, 2), (2, 3), (3, 4), (4, 1), (4, 5)]) == [0, 1, 2, 2, 2, 5]
    assert c_depend.backward_slice(4, [(0, 1), (1, 2), (3, 2)], 2) == [0, 1, 2, 3]
    with pytest.raises(KeyError):
        c_depend.backward_slice(2, [], 5)


def test_graphs_alike_against_all_renamings():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(1, 6)
        a = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 7))]
        roles = [rng.choice("xy") for _ in range(n)]
        if rng.random() < 0.5:
            names = rng.sample(range(n), n)
            b, other = [(names[s], names[d]) for s, d in a], [roles[names.index(i)] for i in range(n)]
        else:
            b, other = [(rng.randrange(n), rng.randrange(n)) for _ in a], [rng.choice("xy") for _ in range(n)]
        want = any(sorted((p[s], p[d]) for s, d in a) == sorted(b) and all(roles[i] == other[p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert c_depend.isomorphic(roles, a, other, b, 5.0) is want
    ring = [(i, (i + 1) % 40) for i in range(40)]
    assert c_depend.isomorphic(["x"] * 40, ring, ["x"] * 40, ring, 0.0) is None


def test_serialised_graphs(spark):
    rows = [("a", '{"nodes":[0,1,2],"edges":[[0,1],[0,1]],"entry":[0],"exit":[1],"degenerate":false}'), ("b", '{"nodes":[0],"edges":[],"entry":[0],"exit":[0],"degenerate":true}'), ("c", "no graph"), ("d", None)]
    got = {r.name: ([tuple(n) for n in r.nodes], r.n_edges) for r in graphs.from_serialized(spark.createDataFrame(rows, "name string, json string")).collect()}
    assert got == {"a": ([(0, 1, True, False), (1, 0, False, True), (0, 0, False, False)], 1), "b": ([(0, 0, True, True)], 0)}
    bad = spark.createDataFrame([("a", '{"nodes":[0],"edges":[[0,7]],"entry":[0],"exit":[0],"degenerate":false}')], "name string, json string")
    with pytest.raises(Exception, match="node 7"):
        graphs.from_serialized(bad).collect()
    sources = spark.createDataFrame([("s", "int f(int a) { if (a) return 1; return 0; } int g(void) { return 1; }")], "source_id string, text string")
    text = {r.name: r.json for r in graphs.parity_json(graphs.parity_blocks(sources)).collect()}
    assert text["g"] == '{"nodes":[0],"edges":[],"entry":[0],"exit":[0],"degenerate":true}'
    assert text["f"].startswith('{"nodes":[0,1,2],"edges":[[0,1],[0,2]],"entry":[0]')


def test_manifest_problems(spark):
    text = "some source"
    digest = hashlib.sha256(text.encode()).hexdigest()
    rows = [(1, "p", digest, 0, 4), (2, "p", digest, 3, 6), (3, "p", digest, 6, 99), (4, "p", "0" * 64, 6, 7), (5, "q", digest, 0, 1), (6, "p", "X", 8, 8), (7, "p", digest, 9, 10), (7, "p", digest, 10, 11), (8, None, None, None, None)]
    manifest = spark.createDataFrame(rows, "id int, source_path string, source_sha256 string, start_byte int, end_byte int")
    sources = spark.createDataFrame([("p", text)], "source_path string, content string")
    got = sorted((r.id, r.problem) for r in evaluation.manifest_problems(manifest, sources).collect())
    assert got == [(2, "overlap"), (3, "bad_slice"), (3, "overlap"), (4, "hash_drift"), (5, "missing_source"), (6, "bad_slice"), (6, "malformed_hash"), (7, "duplicate_id"), (7, "overlap"), (8, "bad_slice"), (8, "malformed_hash"), (8, "missing_source")]
    assert evaluation.manifest_problems(manifest.limit(0), sources).count() == 0


def test_problems_of_alike_sources_are_found_once_and_are_those_of_each_alone(spark, monkeypatch):
    from corvina.plans import c_alike, stage
    from corvina.sources import corpus

    rows = [(str(n), f"int order_{n}(int a, int b)\n{{\n    int total = 0;\n    {corpus.BRANCHES[n % 8].replace('#', '0')}\n    return total;\n}}\n", "false" if n % 3 else None) for n in range(1, 60)]
    sources = spark.createDataFrame(rows, "source_id string, text string, lost string").coalesce(1)
    parsed = stage.functions(stage.parse(sources)).join(sources.select("source_id", "lost"), "source_id")
    wanted = sorted(map(tuple, graphs.problems(parsed, "lost").collect()))
    assert wanted and sorted(map(tuple, graphs.problems(stage.Unparsed(sources), "lost").collect())) == wanted

    solved = []
    reader = c_alike.Reader(lambda tree, *given: (solved.append(given) or [{"function_id": 0, "name": tree.name_of(f)} for f in tree.functions()], len(tree.functions())), numbers=True)
    told = [c_alike.per_text(reader, text, (lost,)) for _, text, lost in rows]
    assert len(solved) < len(rows) and [t[0]["name"] for t in told] == [f"order_{n}" for n in range(1, 60)]


def test_equal_nodes_are_matched_before_others(monkeypatch):
    rng = random.Random(5)
    sizes = []
    assign = c_depend.assign
    monkeypatch.setattr(c_depend, "assign", lambda cost: sizes.append(len(cost)) or assign(cost))
    for _ in range(200):
        x, y = ([(rng.randrange(4), rng.randrange(3), i == 0 and rng.random() < 0.8, i == 1) for i in range(rng.randrange(7))] for _ in range(2))
        x2, y2 = np.array(x, np.int64).reshape(len(x), 4), np.array(y, np.int64).reshape(len(y), 4)
        cost = np.full((len(x) + len(y),) * 2, 10**9)
        cost[: len(x), : len(y)] = np.abs(x2[:, None, :2] - y2[None, :, :2]).sum(2) + c_depend.ROLE_PENALTY * (x2[:, None, 2:] != y2[None, :, 2:]).any(2)
        cost[np.arange(len(x)), len(y) + np.arange(len(x))] = 1 + x2[:, :2].sum(1)
        cost[len(x) + np.arange(len(y)), np.arange(len(y))] = 1 + y2[:, :2].sum(1)
        cost[len(x) :, len(y) :] = 0
        assert c_depend.edit_distance(x, y, 0, 0) == (assign(cost) if x or y else 0, False)
    sizes.clear()
    assert c_depend.edit_distance(x, x[::-1], 0, 0) == (0, False) and not sizes


def test_large_graphs_have_exact_distances(spark):
    rng = random.Random(11)
    for size in (3, 9, 40):
        for _ in range(20):
            x, y = ([(rng.randrange(6), rng.randrange(4), i == 0, i == 1) for i in range(rng.randrange(1, size))] for _ in range(2))
            x2, y2 = np.array(x, np.int64).reshape(len(x), 4), np.array(y, np.int64).reshape(len(y), 4)
            cost = np.full((len(x) + len(y),) * 2, 10**9)
            cost[: len(x), : len(y)] = np.abs(x2[:, None, :2] - y2[None, :, :2]).sum(2) + c_depend.ROLE_PENALTY * (x2[:, None, 2:] != y2[None, :, 2:]).any(2)
            cost[np.arange(len(x)), len(y) + np.arange(len(x))] = 1 + x2[:, :2].sum(1)
            cost[len(x) + np.arange(len(y)), np.arange(len(y))] = 1 + y2[:, :2].sum(1)
            cost[len(x) :, len(y) :] = 0
            assert c_depend.edit_distance(x, y, 0, 0, None) == (c_depend.assign(cost), False)
    # one node has a degree more, another one less: sizes and edges are equal
    node = {"in": 1, "out": 1, "is_entry": False, "is_exit": False}
    left, right = [node] * 5_000, [node | {"in": 2}, node | {"in": 0}] + [node] * 4_998
    schema = "pair_id string, left array<struct<`in`:int,out:int,is_entry:boolean,is_exit:boolean>>, right array<struct<`in`:int,out:int,is_entry:boolean,is_exit:boolean>>, left_edges int, right_edges int"
    rows = spark.createDataFrame([("x", left, right, 5_000, 5_000)], schema)
    assert [tuple(r) for r in graphs.similarity(rows).collect()] == [("x", 2, False)]
