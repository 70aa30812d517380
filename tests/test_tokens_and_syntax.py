import random

import pytest
from corvina.plans import c_measure, c_syntax, c_tokens
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = "int f ( ) { } ; if else while for do switch case : return x y 1 0x1F 'c' \"s\" /* */ // \n # , * & && || ? = + - . -> [ ] goto break continue struct sizeof é @ \\ \0 \"".split(" ")


def kinds(text):
    return [t.kind for t in c_tokens.tokenize(text)[0]]


def names(text):
    tree = c_syntax.Tree(text)
    return [tree.name_of(f) for f in tree.functions()]


def test_tokens():
    assert kinds("a += 0x1F + 1.5e-3 - 'x' \"s\\\"t\" L'w' u8\"z\"") == ["identifier", "+=", "integer", "+", "float", "-", "character", "string", "character", "string"]
    assert kinds("__const const __inline__ x->y ... :: ## <<= a/**/b // end") == ["const", "const", "inline", "identifier", "->", "identifier", "...", "::", "##", "<<=", "identifier", "identifier"]
    assert kinds("int x@<eax>; `") == ["int", "identifier", "register_annotation", ";", "unknown"]
    assert kinds("0x1p3 1u .5 1...2") == ["float", "integer", "float", "float"]


def test_open_comment_goes_on_at_the_next_function():
    text = "int a(void) { return 1; } /* lost\nint b(void) {\n return 2; }\n"
    assert names(text) == ["a", "b"]
    assert [n.message for n in c_syntax.Tree(text).notes] == ["unterminated comment"]


def test_byte_positions_and_lines():
    u = c_measure.unit("// é😀\nint f(void)\n{ return 1; }\n", tokens=True)
    f = u["functions"][0]
    text = "// é😀\nint f(void)\n{ return 1; }\n".encode()
    assert text[f["lo"] : f["hi"]] == b"int f(void)\n{ return 1; }"
    assert (f["first_line"], f["last_line"]) == (2, 3)
    assert (u["lines"], u["code_lines"], u["blank_lines"], u["other_lines"]) == (4, 2, 1, 1)
    assert all(text[t["lo"] : t["hi"]].decode() == t["lexeme"] for t in u["tokens"])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("int f(int a, char *b) { return a; }", ["f"]),
        ("static unsigned long long __fastcall g(void) {}", ["g"]),
        ("int old(a, b) int a; char *b; { return a; }", ["old"]),
        ("main() { return 0; }", ["main"]),
        ("int (*pick(int k))(int) { return 0; }", ["pick"]),
        ("int proto(int); struct s { int a; }; int x = 3, y[2] = {1, 2};", []),
        ("int left(void) { return 1; } int broken( int x { return 1; } int right(void) { return 2; }", ["left", "broken", "right"]),
        ("__attribute__((noinline)) int f(void) __attribute__((pure)) { return 1; }", ["f"]),
        ("typedef int t; t h(t x) { t y = x; return y; }", ["h"]),
        ("int a(void) { if (x) { }\nint b(void) { return 2 }", ["a"]),
        ("void stop() __noreturn\n{ exit(1); }\nint next(void) { return 0; }", ["stop", "next"]),
        ("unsigned long uint64_t turn(uint32_t a) __pure(unsigned int a) { return a; }", ["turn"]),
        ("void entryConvention _begin(undefined8 a) { g(a); }", ["_begin"]),
        ("undefined1 [16] make(void) { return 0; }", ["make"]),
        ("void __spoils<R1,R2> shake(char a1) { g(a1); }", ["shake"]),
        ("int Base::op(int x) { return x; }", ["Base::op"]),
        ("lost comment words, isn't it; some more of them */\nvoid after(int a)\n{ g(a); }", ["after"]),
        ("int t[] = { 1 }; struct s { int (*f)(int); } v; int h(void) { return 1; }", ["h"]),
        ("undefined8 FUN_00101139(long param_1, code *p) { (*p)(param_1); return 0; }", ["FUN_00101139"]),
    ],
)
def test_functions_are_found(text, expected):
    assert names(text) == expected


def tags(text):
    tree = c_syntax.Tree(f"void f(void) {{ {text} }}")
    return [n.tag for n in tree.functions()[0].first("compound_stmt").walk()][1:]


def test_tree_shapes():
    assert tags("a + b - c * d;") == ["expr_stmt", "binary_expr", "name_ref", "name_ref", "binary_expr", "name_ref", "name_ref"]
    assert tags("x = y = 1;") == ["expr_stmt", "assign_expr", "name_ref", "assign_expr", "name_ref", "literal"]
    assert tags("p = (int *)q;") == ["expr_stmt", "assign_expr", "name_ref", "cast_expr", "type_name", "name_ref"]
    assert tags("f(a)(b)[1]->c++;") == ["expr_stmt", "postfix_expr", "name_ref", "call_args", "name_ref", "call_args", "name_ref", "index_suffix", "literal", "member_suffix", "inc_dec_suffix"]
    assert tags("A * b;") == ["decl", "decl_specifiers", "declarator", "pointer_operator", "decl_name"]
    assert tags("sizeof(int) + sizeof x;")[1:4] == ["binary_expr", "sizeof_type", "type_name"]
    assert tags("if (a) b; else c;") == ["if_stmt", "name_ref", "expr_stmt", "name_ref", "expr_stmt", "name_ref"]
    assert "stmt_expr" in tags("x = ({ int y = 1; y; });")
    assert tags("goto *t[i];")[0] == "goto_stmt" and "label_addr" in tags("void *t = &&l; l: ;")


def test_deep_nesting():
    deep = "int f(void) { return " + "(" * 20000 + "1" + ")" * 20000 + "; }"
    u = c_measure.unit(deep)
    assert u["functions"][0]["ast_nodes"] > 20000
    assert c_measure.unit("{" * 5000)["functions"] == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map(" ".join))
def test_any_text_is_read(text):
    one, two = c_measure.unit(text, tokens=True), c_measure.unit(text, tokens=True)
    assert one == two
    tree = c_syntax.Tree(text)
    assert tree.root.hi == len(tree.tokens)
    for n in tree.root.walk():
        assert n.lo <= n.hi and all(n.lo <= k.lo and k.hi <= max(n.hi, k.lo) for k in n.kids)
    for f in one["functions"]:
        assert f["cfg_nodes"][0]["kind"] == "entry" and all(n["live"] or n["kind"] == "exit" for n in f["cfg_nodes"])


def test_damaged_sources():
    rng = random.Random(7)
    base = "int f(int a) { for (int i = 0; i < a && a; i++) { switch (i) { case 1: g(i); break; default: goto out; } } out: return a ? 1 : 0; }\n" * 3
    for _ in range(200):
        text = list(base)
        for _ in range(rng.randrange(1, 12)):
            k = rng.randrange(len(text))
            text[k] = rng.choice("{}();,*&'\"/ \n#x1\0é")
        c_measure.unit("".join(text))


def names(text):
    return [f["name"] for f in c_measure.unit(text)["functions"]]


def test_reading_goes_on_after_an_open_comment():
    rest = "int second(void) { return 1; }\nstatic int third(int n)\n{\n  if (n) return 2;\n  return 3;\n}\n"
    for begin in ("int first(void) { /* open\n", "int first(void) { if (1) { go(/* open\n", "int first(void) { int k = /* open\n", "int first(int a) { while (a) { a--; /* open { ( [\n"):
        assert names(begin + rest) == ["first", "second", "third"], begin
    assert names("/* open\n" + rest) == ["second", "third"]
    assert names("int first(void) { return 0; } /* open, and no function") == ["first"]


def test_measures_are_the_same_with_and_without_graphs():
    text = "int f(int a, int b) { if (a && b) { for (;;) { if (a) break; g(a, b ? 1 : 2); } } switch (a) { case 1: return 2; default: goto end; } end: return 0; }"
    whole, flat, bare = (c_measure.unit(text, g)["functions"][0] for g in (True, "counts", False))
    assert all(flat[k] == v for k, v in bare.items()) and all(whole[k] == flat[k] for k in flat.keys() & whole.keys())
    assert flat["n_nodes"] == len(whole["cfg_nodes"]) and flat["n_edges"] == len(whole["cfg_edges"])
