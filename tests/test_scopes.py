"""Odd sources of languages with braces."""

from seamark.operators import scopes


def names(source, language):
    return [(s.node_type, s.name, s.scope) for s in scopes.symbols_of(source, language) if s.node_type != "field_declaration"]


def test_comments_and_strings_open_nothing():
    java = 'class A { // class B {\n /* } class C { */ String s = "class D { \\" }"; char c = \'{\'; void m() { } }\n'
    assert names(java, "java") == [("class_declaration", "A", ()), ("method_declaration", "m", ("A",))]
    assert names('class T { String s = """\n class X { " \n"""; void n() { } }', "java")[-1] == ("method_declaration", "n", ("T",))


def test_templates_nest():
    source = "function f() { return `a ${ g({b: `}${h(() => { return 1; })}{`}) } class No {`; }\nclass K { m() { } }\n"
    assert names(source, "script") == [("function_declaration", "f", ()), ("class_declaration", "K", ()), ("method_definition", "m", ("K",))]


def test_blocks_are_no_methods():
    source = "class A { void run() { if (x) { } while (y()) { } switch (z) { default: } new Thread(w) { public void run() { } }; } }"
    assert names(source, "java") == [("class_declaration", "A", ()), ("method_declaration", "run", ("A",))]


def test_open_ends():
    assert names("class A { void m() {", "java") == [("class_declaration", "A", ()), ("method_declaration", "m", ("A",))]
    assert names("} } class B { }", "java") == [("class_declaration", "B", ())]
    assert names("", "go") == [] and names("`never closed {", "script") == []


def test_rows(spark):
    files = spark.createDataFrame([("a/Big-x.java", "class A {\n  int n;\n}\n"), ("b.py", "class B: pass"), ("c.go", None)], "file_path string, content string")
    rows = scopes.scoped_symbols(files).orderBy("line_start").collect()
    assert [(r["node_id"], r["type"], r["parent"], r["line_end"]) for r in rows] == [("Big_x::A::1", "class", None, 3), ("Big_x::n::2", "variable", "A", 2)]
    assert len(scopes.SYMBOL_TYPES) >= 28 and scopes.scope_chunks(files).count() == 1
