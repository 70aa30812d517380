"""Pieces of texts that are alike are read once; what is told of each is what reading it alone gives."""

import pytest

from corvina.plans import c_alike, c_measure
from corvina.plans.c_syntax import Tree

BODY = "int order_%d(int a, int b)\n{\n    int total = 0;\n    if (a > %d) {\n        total = total + %d;\n    }\n    total = total + supplier_%d(a, %d) + supplier_%d(a);\n    // note %s\n    return total;\n}\n"
TEXTS = [
    "\n".join(BODY % (n, n % 7 + 1, n % 11 + 1, 12 - n % 3, n, 9 + n % 5, "x" * (n % 4)) for n in range(k, k + 5)) for k in (1, 8, 98, 997, 12_345)
] + [
    "int f_1(void)\n{\n    goto L_2;\nL_2:\n    return 1 ...5;\n}\n", "int f_1(void)\n{\n    return x_10 + x_10;\n}\nint f_2(void)\n{\n    return x_10 + x_3;\n}\n",
    "struct s\n{\n    int a;\n}\n*f_1(void)\n{\n    return 0;\n}\n", "int f_1(int a)\n{\n    return a[3;\n}\nint g_2(void)\n{\n    return 1];\n}\n", "", "\n}\n", "int f_0(void)\n{\n    return 007 + 7 + 0x7 + 7u + 1e7;\n}\n",
    "int a_1; // 12\nint f_1(void)\n{\n    return 12; // é\n}\n", "[ int f_1(void)\n{\n}\n ] int g_1(void)\n{\n}\n",
]


@pytest.mark.parametrize("graphs", [True, False, "counts"])
def test_told_again_as_read_alone(graphs):
    for _ in range(3):  # unknown, met once, known
        for text in TEXTS:
            assert c_measure.unit(text, graphs) == c_measure._whole(Tree(text), graphs)


def test_alike_pieces_are_read_once():
    read = []

    def make(tree):
        read.append(tree.text)
        return [{"name": tree.name_of(f), "lo": tree.span(f)[0]} for f in tree.functions()], None

    reader = c_alike.Reader(make, numbers=True)
    texts = [f"int order_{n}(int a)\n{{\n    return a + {n * n};\n}}\n" for n in range(1, 2_000)]
    told = [reader.read("\n" + t + t)[0] for t in texts]
    assert len(read) <= 9
    assert told[1_500] == [{"name": "order_1501", "lo": 1}, {"name": "order_1501", "lo": 1 + len(texts[1_500])}]


def test_what_is_kept_is_bounded():
    reader = c_alike.Reader(lambda tree: ([{"name": tree.name_of(f)} for f in tree.functions()], None), kept=3)
    for _ in range(3):
        for n in range(20):
            assert reader.read(f"int f{'x' * n}_4(void)\n{{\n}}\n")[0] == [{"name": f"f{'x' * n}_4"}]
    assert len(reader.known) <= 3 and len(reader.former) <= 3


def test_operations_of_alike_texts_are_those_read_alone():
    from corvina.plans import c_lower

    for _ in range(3):
        for n in (1, 20, 300, 4_000):
            for number in (7, 4_000_000_000):  # types hang on numbers
                text = f"// fact: capacity(b_{n}) = {n}\nint f_{n}(long b_{n})\n{{\n    b_{n} += {number};\n    return b_{n} && g_{n + 1}(b_{n}++) ? {number} : 2;\n}}\n"
                assert c_lower.functions(text) == c_lower._read(Tree(text))[0]
    assert len(c_lower._reader.known) > 0


def test_damaged_texts_read_by_pieces_are_those_read_whole(monkeypatch):
    from corvina.operators.evaluation import mutate

    read = []
    whole = c_measure._whole
    for n in range(150):
        text, _ = mutate("\n".join(BODY % (k, 7, 9, k, 3, k, "") for k in range(n + 1, n + 9)), n, 1 + n % 4)
        wanted = whole(Tree(text), "counts")
        monkeypatch.setattr(c_measure, "_whole", lambda tree, *a: read.append(len(tree.text)) or whole(tree, *a))
        assert c_measure.unit(text, "counts") == wanted
        monkeypatch.setattr(c_measure, "_whole", whole)
    assert sum(read) < 150 * 8 * len(BODY) * 0.8


CALLS = [
    "int f_1(int a, int b)\n{\n    return g_30(a) + g_4(b, h_4(a));\n}\n", "int f_2(int a, int b)\n{\n    return g_3(a) + g_40(b, h_40(a));\n}\n", "int g_3(int a)\n{\n    return a;\n}\nint f_4(int a)\n{\n    return g_3(a);\n}\n",
    "int g_5(int a)\n{\n    if (a > 3) {\n        return 1;\n    }\n    return __builtin_expect(a, 2);\n}\n", "int f_6(int a)\n{\n    return a[;\n}\n", "int f_7(int a)\n{\n    return a;\n}\nint f_7(int a)\n{\n    return f_7(1);\n}\n", "",
]


@pytest.mark.parametrize("policy", ["unknown", "taint_return", "assume_pure_no_flow"])
def test_summaries_by_function_are_those_of_the_text(policy):
    from corvina.operators import flow
    from corvina.plans import c_dataflow

    for _ in range(3):
        for text in [*CALLS, CALLS[0] + CALLS[1], *(CALLS[0].replace("f_1", f"f_{n}") for n in range(50, 60))]:
            assert flow._summaries(text, policy) == c_dataflow.summaries(Tree(text), policy)


def _sources(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_id string, text string").coalesce(1)


BOUNDS = [f"int f_{n}(int n, int m)\n{{\n    {'if (m) n = 3; ' * (n % 3)}\n    int a_{n}[n * m][4], b[n + {n}][n];\n    n = 5;\n    {{ int m = n; int c[m]; }}\n    return a_{n}[0][1] + b[n][0];\n}}\n" for n in range(1, 40)]


def test_captures_in_one_pass_are_those_of_the_join(spark):
    from corvina.operators import flow

    sources = _sources(spark, [*BOUNDS, BOUNDS[0] + BOUNDS[1] + BOUNDS[31], "int é(int n) { int a[n]; }"])
    wanted = sorted(map(tuple, flow.bound_captures(flow.data_flow(sources), flow.runtime_bounds(sources)).collect()))
    assert len(wanted) > 100 and sorted(map(tuple, flow.captured(sources).collect())) == wanted


def test_names_resolved_within_a_pass_are_those_of_the_join(spark):
    from corvina.operators import symbols

    texts = [f"typedef int T_{n}; enum e {{ A, B }}; T_{n} g; int f_{n}(T_{n} x, int y) {{ {'{ T_%d x = 3; ' % n * (n % 3)}y = x + {n}; {'} ' * (n % 3)}for (int g = A; g < B; g++) y = g; return x + g + missing_{n}; }}" for n in range(1, 30)]
    sources = _sources(spark, [*texts, "int é; int f(int x)\n{\n    return é + x;\n}\nint g(void)\n{\n    return f(é);\n}\n"])
    key = lambda r: tuple((v is not None, v) for v in r)
    wanted = sorted(map(tuple, symbols.resolved(symbols.index(sources)).collect()), key=key)
    assert len(wanted) > 100 and sorted(map(tuple, symbols.resolved_within(sources).collect()), key=key) == wanted


def test_fields_of_flows_are_those_of_whole_flows(spark):
    from corvina.operators import flow

    sources = _sources(spark, [*BOUNDS, BOUNDS[0] + BOUNDS[1]])
    pick = ["source_id", "function_id", "function", "dead_stores", "unused"]
    assert sorted(map(str, flow.data_flow(sources, ["dead_stores", "unused"]).select(*pick).collect())) == sorted(map(str, flow.data_flow(sources).select(*pick).collect()))


def test_graphs_without_places_sizes_and_blocks_of_alike_sources(spark):
    from corvina.operators import graphs
    from corvina.plans import c_parity, stage

    texts = [*BOUNDS, BOUNDS[3] + BOUNDS[4]]
    sources = _sources(spark, texts)
    whole = stage.functions(stage.parse(sources))
    rows = {(r.source_id, r.function_id): r for r in whole.collect()}
    got = graphs.unplaced(stage.Unparsed(sources)).collect()
    assert len(got) == len(rows)
    for r in got:
        old = rows[r.source_id, r.function_id]
        assert r.name == old.name and [(n.id, n.kind, n.internal, n.live, n.ends) for n in r.cfg_nodes] == [(n.id, n.kind, n.internal, n.live, n.ends) for n in old.cfg_nodes] and r.cfg_edges == old.cfg_edges
    best = lambda df, *size: {(r.source_id, r.name) for r in graphs.best_by_name(df, *size).collect()}
    assert best(graphs.sizes(stage.Unparsed(sources)), "n_nodes") == best(whole)
    assert all(r.isomorphic for r in graphs.isomorphic(stage.Unparsed(sources), stage.Unparsed(sources)).collect())
    for r in graphs.parity_blocks(_sources(spark, BOUNDS)).collect():
        tree = Tree(BOUNDS[int(r.source_id)])
        b = c_parity.blocks(tree, tree.functions()[0])
        assert (r.nodes, [tuple(e) for e in r.edges], r.degenerate) == (b["nodes"], b["edges"], b["degenerate"]) and r.name == tree.name_of(tree.functions()[0])


def test_one_pass_operators_find_what_whole_texts_give(spark):
    from pyspark.sql import functions as F

    from corvina.operators import annotations, declared, graphs
    from corvina.plans import stage

    one = "long order_%d(int a, struct s_%d *v)\n{\n    for (int i = 0; i < %d; i++) { if (a && v->m_%d) a = a + %d; }\n    while (a < %d) a--;\n    return a + %d;\n}\n"
    texts = ["", "int x;", "{ broken", 'int f(char *p) { for (;;) return p["a"]; }', "/* x */ int é(int a) { do a--; while (a > 08); }", "int f(void) { goto *x; l: return 1 +; "]
    texts += [f"struct s_{k} {{ unsigned m_{k}; }};\n" + "\n".join(one % (n + i, k, m, k, n, i + 1, m) for i in range(3)) for n in (1, 9, 10, 400) for k in (1, n) for m in (3, 5_000_000_000)]
    texts += [texts[-1] + "int f(int b) { switch (b) { case 1: b = 'x'; } }\n"]
    sources = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "source_id string, text string").coalesce(1)

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    tokens = stage.token_kinds(sources)
    assert rows(tokens) == rows(stage.tokens(stage.parse(sources, graphs=False, tokens=True)).groupBy("kind").agg(F.count("*").alias("n")))
    assert "Generate" not in tokens._jdf.queryExecution().optimizedPlan().toString()
    assert rows(annotations.loop_counts(sources)) == rows(annotations.loop_bounds(sources).groupBy("loop", "bound_kind").agg(F.count("*").alias("n")))
    assert rows(declared.typed_operations(sources, places=False)) == rows(declared.typed_operations(sources).drop("lo", "hi"))
    nodes = graphs.nodes(sources)
    assert rows(nodes) == rows(stage.cfg_nodes(stage.parse(sources)).drop("lo", "hi"))
    assert "Generate" not in nodes._jdf.queryExecution().optimizedPlan().toString()


def test_early_readers_make_what_is_alike_once():
    made = []
    reader = c_alike.Reader(lambda tree: (made.append(tree) or [{"name": tree.name_of(f)} for f in tree.functions()], None), numbers=True, early=True)
    told = [reader.read(f"int f_{n}(int a)\n{{\n    return {n};\n}}\n")[0][0]["name"] for n in (3, 17, 256)]
    assert told == ["f_3", "f_17", "f_256"] and len([t for t in made if t.functions()]) == 1


def test_totals_of_damaged_texts_are_those_of_whole_ones(spark, monkeypatch):
    from corvina.operators import evaluation
    from corvina.plans import stage

    one = "int order_%d(int a, int b)\n{\n    int total = %d;\n    while (total < %d) {\n        total = total + 1;\n    }\n    if (a > 1 && b) {\n        total = supplier_%d(a, 7);\n    }\n    return total;\n}\n"
    rows = [(str(k), "\n".join(one % (n, n % 3, k, n * k) for n in range(1, 2 + k % 5))) for k in range(60)]
    sources = spark.createDataFrame([*rows, ("x", None), ("y", "int x;")], "source_id string, text string").coalesce(1)
    damaged = evaluation.mutated(sources, [1, 4], 2).cache()

    def whole(text: str) -> tuple:
        u = c_measure._whole(Tree(text or ""), "counts")
        return len(u["functions"]), sum(f["n_nodes"] for f in u["functions"]), sum(f["n_edges"] for f in u["functions"]), len(u["diagnostics"])

    wanted = sorted((r.source_id, r.severity, *whole(r.text)) for r in damaged.collect())
    assert sorted(map(tuple, stage.totals(damaged, ["severity"]).collect())) == wanted and any(r[-1] for r in wanted)
    # only what the totals hold is made: no measures
    monkeypatch.setattr(c_measure, "shape", None)
    held = []
    monkeypatch.setattr(stage, "mapped", lambda df, run, schema: held.append(run) or df)
    stage.totals(sources)
    import pyarrow as pa

    batch = next(held[0](iter([pa.RecordBatch.from_pydict({"source_id": ["1"], "text": [rows[4][1] + "int f( {"]})])))
    assert batch.to_pylist()[0]["n_functions"] >= 5
