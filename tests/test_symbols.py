import pytest

from corvina.operators import evaluation, symbols


def resolved(spark, text):
    rows = symbols.resolved(symbols.index(spark.createDataFrame([("s", text)], "source_id string, text string"))).collect()
    return {(r.name, r.lo): (r.kind, r.depth, r.declared_lo) for r in rows}


def at(text, name, n):
    """Where the n-th mention of a name stands."""
    place = -1
    for _ in range(n):
        place = text.index(name, place + 1)
    return place


def test_the_innermost_declaration_wins(spark):
    text = "int v; enum { E = 1 }; typedef long w; int f(int p) { int k = v; { w v = k + E; enum { E }; k = v + E; } for (int v = 0; v < p; v++) k = v; return v + q; }"
    got = resolved(spark, text)
    kinds = {n: got["v", at(text, "v", n)][:2] for n in range(1, text.count("v") + 1) if ("v", at(text, "v", n)) in got}
    assert list(kinds.values()) == [("object", 0), ("local", 3), ("local", 3), ("local", 3), ("local", 3), ("object", 0)]
    assert [got["E", at(text, "E", n)][1] for n in (2, 4)] == [0, 3]
    assert got["w", at(text, "w", 2)][:2] == ("typedef", 0) and got["q", at(text, "q", 1)] == (None, None, None)
    assert got["p", at(text, " p;", 1) + 1][0] == "parameter"


def test_a_declaration_is_seen_after_its_declarator(spark):
    text = "int x; int f(void) { int y = x; int x = x; return x + f(); }"
    got = resolved(spark, text)
    assert [v[:2] for k, v in sorted(got.items(), key=lambda i: i[0][1]) if k[0] == "x"] == [("object", 0), ("local", 2), ("local", 2)]
    assert got["f", at(text, "f(", 2)][:2] == ("function", 0)


@pytest.mark.parametrize("text", [None, "", "int f(", "}{", "enum {", "typedef;", "int f(a, b) int a; { return a + c; }", "x = é;"])
def test_odd_texts(spark, text):
    resolved(spark, text)


def test_totals_of_runs_are_those_of_the_manifest(spark):
    manifest = spark.createDataFrame([(1, "a", ["f", "f", "g"], 0, 10), (2, "b", ["h"], 5, 9), (3, "a", None, 0, 1)], "id int, family string, expected array<string>, start_byte int, end_byte int")
    results = spark.createDataFrame([("r", 1, "ok", ["f"], True, None, 7), ("r", 2, "error", None, None, False, None), ("r", 9, "ok", ["z"], True, True, 1)], "run_id string, id int, status string, found array<string>, syntax_complete boolean, cfg_complete boolean, covered_bytes int")
    got = {r.family: r for r in evaluation.run_summary(manifest, results).collect()}
    assert {k: (r.specimens, r.results, r.statuses, r.expected, r.expected_found, r.input_bytes) for k, r in got.items()} == {"all": (3, 2, "error=1,ok=1", 4, 2, 15), "a": (2, 1, "ok=1", 3, 2, 11), "b": (1, 1, "error=1", 1, 0, 4)}
    assert (got["all"].syntax_complete_true, got["all"].syntax_complete_unavailable, got["all"].cfg_complete_false, got["all"].covered_bytes, got["all"].without_functions) == (1, 1, 1, 7, 1)
    assert evaluation.run_summary(manifest, results.limit(0)).count() == 0


def test_bounds_capture_what_reaches_them(spark):
    from corvina.operators import flow

    text = "int f(int n, int m) { n = m + 1; if (m) n = 2; int a[n * 2][m], k[4]; n = 5; return a[0][1] + k[n]; }"
    sources = spark.createDataFrame([("s", text), ("none", None)], "source_id string, text string")
    bounds = flow.runtime_bounds(sources)
    assert [(r.array, text[r.lo : r.hi]) for r in bounds.collect()] == [("a", "[n * 2]"), ("a", "[m]")]
    got = {(r.array, r.variable, getattr(r, "def")) for r in flow.bound_captures(flow.data_flow(sources), bounds).collect()}
    assert got == {("a", "n", 2), ("a", "n", 3), ("a", "m", 1)}
    inner = "int m; int f(int n) { int a[n + m]; return a[n]; }"
    assert resolved(spark, inner)["m", at(inner, "m", 2)][0] == "object"
