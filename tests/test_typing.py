import pytest
from corvina.plans import c_typing
from corvina.plans.c_syntax import Tree


def operations(body, parameters="int a, unsigned int u, char c, long n, double d, float f, char *p, int *q, struct s *s"):
    tree = Tree(f"void f({parameters}) {{ {body} }}")
    return [(r["op"], r["type"], [(x["type"], x["converted"]) for x in r["operands"]]) for r in c_typing.operations(tree, tree.functions()[0])]


@pytest.mark.parametrize(
    ("expression", "last"),
    [
        ("a + u;", ("+", "unsigned int", [("int", "unsigned int"), ("unsigned int", None)])),
        ("c + c;", ("+", "int", [("char", "int"), ("char", "int")])),
        ("n + u;", ("+", "long", [("long", None), ("unsigned int", "long")])),
        ("(f * a);", ("*", "float", [("float", None), ("int", "float")])),
        ("f / 2.0;", ("/", "double", [("float", "double"), ("double", None)])),
        ("p + a;", ("+", "char *", [("char *", None), ("int", None)])),
        ("a + p;", ("+", "char *", [("int", None), ("char *", None)])),
        ("q - q;", ("-", "long", [("int *", None), ("int *", None)])),
        ("p - d;", ("-", None, [("char *", None), ("double", None)])),
        ("a < n;", ("<", "int", [("int", "long"), ("long", None)])),
        ("c << n;", ("<<", "int", [("char", "int"), ("long", None)])),
        ("a && p;", ("&&", "int", [("int", None), ("char *", None)])),
        ("!p;", ("!", "int", [("char *", None)])),
        ("~c;", ("~", "int", [("char", "int")])),
        ("~d;", ("~", None, [("double", None)])),
        ("*q;", ("*", "int", [("int *", None)])),
        ("&a;", ("&", "int *", [("int", None)])),
        ("q[c];", ("[]", "int", [("int *", None), ("char", None)])),
        ("s->x;", ("member", None, [("struct s *", None)])),
        ("a ? c : n;", ("?:", "long", [("char", "long"), ("long", None)])),
        ("a ? p : p;", ("?:", "char *", [("char *", None), ("char *", None)])),
        ("(unsigned char) a;", ("cast", "unsigned char", [("int", "unsigned char")])),
        ("(char *) q;", ("cast", "char *", [("int *", "char *")])),
        ("(T) q;", ("cast", None, [("int *", None)])),
        ("c = n;", ("=", "char", [("long", "char")])),
        ("c += n;", ("+=", "char", [("char", "long"), ("long", None)])),
        ("a = g(c);", ("=", "int", [(None, None)])),
        ("n = sizeof(a) + 1;", ("=", "long", [("unsigned long", "long")])),
        ("d = 'x' + 1u;", ("=", "double", [("unsigned int", "double")])),
        ("{ long a; a + 1; } a + 1;", ("+", "int", [("int", None), ("int", None)])),
        ("{ long a; c = a + 1; }", ("=", "char", [("long", "char")])),
        ("int m[3]; m[0];", ("[]", "int", [("int *", None), ("int", None)])),
        ("unknown + 1;", ("+", None, [(None, None), ("int", None)])),
        ("short k = n;", ("=", "short", [("long", "short")])),
        ("a - c - n;", ("-", "long", [("int", "long"), ("long", None)])),
    ],
)
def test_types_of_operations(expression, last):
    assert operations(expression)[-1] == last


def test_names_and_literals():
    names = {"unsigned": "unsigned int", "long int": "long", "long unsigned int long": "unsigned long long", "short signed": "short", "const volatile char": "char", "struct x": "struct x", "enum e": "unsigned int", "size_t": None, "": None, "double long": "long double"}
    assert {k: c_typing.named(k.split()) for k in names} == names
    literals = {"0": "int", "2147483647": "int", "2147483648": "long", "0x80000000": "unsigned int", "1u": "unsigned int", "1L": "long", "1ul": "unsigned long", "0xffffffffffffffff": "unsigned long", "9999999999999999999": None, "1.": "double", "1e3f": "float", "2.0L": "long double", "0x1F": "int", "'a'": "int", '"s"': "char *", "09": None}
    assert {k: c_typing.literal(k) for k in literals} == literals


def test_odd_texts():
    for body in ("*;", "a +;", "(int) ;", "a ? : b;", "= 3;", "p[;", "sizeof;", "int = 4;", "switch (a) { case 1: b = ; }", "({ int z = 1; z; }) + a;"):
        operations(body)
    assert operations("", "") == []
