"""Brace languages: masking, scopes, spans, calls and levels of detail."""

from __future__ import annotations

import pytest

from quillmesh.operators import braces

L = braces.LANGUAGES


def nodes(text, lang):
    return [(r[1], r[2], r[4], r[5]) for r in braces.declared(text, L[lang]) if r[0] == "node"]


@pytest.mark.parametrize(("lang", "text", "left"), [
    ("rust", 'let a = "{ // }"; /* a /* b */ c */ x', "let a =  ;   x"),
    ("rust", "let c = '{'; fn f<'a>(x: &'a str)", "let c =  ; fn f<'a>(x: &'a str)"),
    ("rust", 'r##"a "# { "## b', "  b"),
    ("go", "x := `a\n{ \\` + y", "x :=  \n + y"),
    ("typescript", "a(`x ${b({c: `}`})} {`) + /[/{]/.test(d)", "a(b({c: })) + .test(d)"),
    ("java", '"a\\"{" + \'}\' + """\n {" """ + x', "  +   +  \n + x"),
    ("c", "#define A { \\\n  }\nint x; // {", " \n\nint x;  "),
    ("swift", '"a \\(b("}") + "c") {" + #"{ \\(x)"# + d', "b() +  +   + d"),
    ("rust", '"never ends {', '"never ends {'),
    ("swift", '/* never ends {\n', "\n"),
])
def test_masking_leaves_code(lang, text, left):
    squeezed = lambda s: "".join(s.split(" "))
    assert squeezed(braces.masked(text, L[lang])) == squeezed(left)


def test_scopes_and_owners():
    assert nodes("mod m {\n  pub mod n {\n    fn f() { if x { y() } }\n  }\n  fn g() {}\n}\nimpl<T> Tr<T> for a::B {\n  async fn h(&self)\n  {\n  }\n}", "rust") == [
        ("module", "m", 1, 6), ("module", "m.n", 2, 4), ("function", "m.n.f", 3, 3), ("function", "m.g", 5, 5), ("method", "B.h", 8, 10)]
    assert nodes("class A {\n constructor(x) { this.x = x }\n get y() { return 1 }\n}\nif (a) { b() }\nconst f = async (x) => x + 1\nwhile (c) { d() }", "typescript") == [
        ("class", "A", 1, 4), ("method", "A.constructor", 2, 2), ("method", "A.y", 3, 3), ("function", "f", 6, 6)]
    assert nodes("namespace n {\nclass A : public B {\n void f(int x);\n};\n}\nvoid n::g(int (*cb)(int)) const {\n  h(1);\n}\nint x = k(2);\n", "c") == [
        ("module", "n", 1, 5), ("class", "n.A", 2, 4), ("method", "n.g", 6, 8)]
    assert nodes("class A {\n  @Test(x = 1)\n  public A(int b) throws E, F { super(b); }\n  Foo f = new Foo(3);\n  enum K { X }\n}", "java") == [
        ("class", "A", 1, 6), ("method", "A.A", 2, 3), ("enum", "A.K", 5, 5)]


@pytest.mark.parametrize("lang", sorted(L))
def test_odd_texts(lang):
    for text in (None, "", "}}}}", "{{{{(((", "\n" * 50, "fn fn fn", "class", "'\"`/*", "\x00 "):
        braces.declared(text, L[lang])
    long_ = "some words (here and\n there), \"then more. it's { " * 4000
    assert braces.declared(long_, L[lang]) is not None


def test_calls_mean_the_file_first_and_then_the_only_one(spark):
    files = spark.createDataFrame([("a.rs", "rust", "fn f() { g(); h(); k(); z::w(); }\nfn g() {}"), ("b.rs", "rust", "fn g() {}\nfn h() {}\nfn k() {}"),
        ("c.rs", "rust", "fn k() {}\nfn p() { g() }"), ("d.go", "go", "func h() {}"), ("e.txt", "text", "fn q() {}")], "path string, language string, text string")
    got = {(r.path, r.target): (r.definition, r.reach) for r in braces.calls(braces.graph(files)).collect()}
    assert got == {("a.rs", "g"): ("sym:g@a.rs:2", "file"), ("a.rs", "h"): ("sym:h@b.rs:2", "language"), ("a.rs", "k"): (None, "none"),
        ("a.rs", "z::w"): (None, "none"), ("c.rs", "g"): (None, "none")}


def test_levels_of_files_without_symbols(spark):
    files = spark.createDataFrame([("a.rs", "rust", "let x = 1;\n// y"), ("b.rs", "rust", None)], "path string, language string, text string")
    got = {r.path: r.skeleton for r in braces.details(files, braces.graph(files), 2).collect()}
    assert got == {"a.rs": "let x = 1;\n// y", "b.rs": None}


DOC = """# A
`x/y.py` then [z](../z.md)
### C
## B ❌
**Status**: half ** done
    # D [n](http://a.b/n.md)
`1.2` `a b` `a b/c.d` `two.py`, ``three.py``
##no heading
```a.py``` `late.py`
"""


def test_sections_nest_and_hold_what_is_in_them(spark):
    from quillmesh.operators import markdown

    docs = spark.createDataFrame([("docs/a.md", DOC), ("b.md", None), ("c.md", ""), ("d.md", "no heading `q.py`")], "path string, text string")
    got = {r.name: (r.depth, r.parent, r.start_line, r.end_line, r.tree_end, r.refs, r.links, r.marks) for r in markdown.sections(docs).collect()}
    assert got == {"A": (1, None, 1, 2, 5, 1, 1, []), "C": (3, "sec:a@docs/a.md:1", 3, 3, 3, 0, 0, []), "B ❌": (2, "sec:a@docs/a.md:1", 4, 5, 5, 0, 0, ["status:half", "❌"]),
        "D [n](http://a.b/n.md)": (1, None, 6, 10, 10, 2, 0, [])}
    files = spark.createDataFrame([("x/y.py",), ("docs/two.py",)], "path string")
    out = {(r.target, r.section, r.known) for r in markdown.edges(docs, files).where("kind <> 'contains'").collect()}
    d = "sec:d__n__http___a_b_n_md_@docs/a.md:6"
    assert out == {("file:x/y.py", "sec:a@docs/a.md:1", True), ("file:z.md", "sec:a@docs/a.md:1", False), ("file:a b/c.d", d, False), ("file:docs/two.py", d, True),
        ("file:q.py", None, False)}
    assert [tuple(r) for r in markdown.mentions(docs, files).orderBy("path").collect()] == [("docs/a.md", "docs/two.py"), ("docs/a.md", "x/y.py")]
