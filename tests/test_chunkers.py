"""Chunkers by example: what is a chunk, where it begins and ends, what it is called."""

import pytest

from quarry.operators.chunks import Registry, chunk_python, default_registry, invalid, valid
from quarry.operators.markdown import chunk_markdown
from quarry.operators.python_chunks import python_chunks
from quarry.operators.rust_chunks import rust_chunks


def test_python_functions_after_a_comment():
    assert python_chunks("# c\n\ndef a():\n    pass\n\n\ndef b():\n    pass\n", "m") == [(3, 4, "function", "a"), (7, 8, "function", "b")]


def test_python_class_with_methods():
    got = python_chunks("class A:\n    def x(self):\n        pass\n\n    def y(self):\n        pass\n", "m")
    assert [(c[2], c[3]) for c in got] == [("class", "A"), ("method", "x"), ("method", "y")]


def test_python_nested_function_belongs_to_its_parent():
    assert len(python_chunks("def a():\n    def b():\n        pass\n    return b\n", "m")) == 1


def test_python_decorators_begin_the_span():
    assert python_chunks("@x\n# why\n@y\ndef a():\n    pass\n", "m") == [(1, 5, "function", "a")]


def test_python_docstring():
    assert python_chunks('# c\n"""a\nb\n"""\nimport os\n', "m") == [(2, 4, "module", "m")]
    assert python_chunks('import os\n"""late"""\n', "m") == []


def test_python_nested_class_and_conditional():
    got = python_chunks("class A:\n    class B:\n        def f(self): pass\nif 1:\n    def g(): pass\n", "m")
    assert [(c[2], c[3]) for c in got] == [("class", "A"), ("class", "B"), ("method", "f")]


def test_python_broken_source_is_read_by_indentation():
    got = python_chunks("def ok():\n    return 1\n\ndef broken(:\n    x\n\nclass A:\n    def m(self):\n        pass\n", "m")
    assert [(c[2], c[3]) for c in got] == [("function", "ok"), ("class", "A"), ("method", "m")] or ("method", "m") in [(c[2], c[3]) for c in got]
    assert got[0] == (1, 2, "function", "ok")


def test_rust_struct_impl_and_methods():
    got = rust_chunks("struct P { a: u8 }\n\nimpl P {\n    fn new() -> Self { P { a: 1 } }\n    pub fn get(&self) -> u8 { self.a }\n}\n", "m")
    assert [(c[2], c[3]) for c in got] == [("class", "P"), ("class", "P"), ("method", "new"), ("method", "get")]


def test_rust_trait_signatures_are_no_methods():
    got = rust_chunks("trait T {\n    fn a(&self);\n    fn b(&self) {}\n}\n", "m")
    assert [(c[2], c[3]) for c in got] == [("class", "T"), ("method", "b")]


def test_rust_impl_for():
    got = rust_chunks("impl<T: Clone> fmt::Display for Foo<T> where T: X {\n    fn f(&self) { let s = \"}\"; let c = '}'; }\n}\n", "m")
    assert [(c[2], c[3]) for c in got] == [("class", "Display for Foo"), ("method", "f")]


def test_rust_docs_and_attributes():
    source = "//! one\n//! two\n\n/// doc\n#[derive(Debug)]\nenum E { A }\n\n// plain\nfn f<'a>(x: &'a str) {}\n"
    assert rust_chunks(source, "lib") == [(1, 2, "module", "lib"), (4, 6, "class", "E"), (9, 9, "function", "f")]


def test_rust_not_extracted():
    assert rust_chunks("mod m { fn inner() {} }\nconst X: u8 = 1;\ntype A = B;\nmacro_rules! r { () => {} }\n", "m") == []


def test_rust_broken_source_gives_a_list():
    assert isinstance(rust_chunks("fn broken( {\n", "m"), list)


def _md(spark, text):
    rows = chunk_markdown(spark.createDataFrame([("d/doc.md", text)], "file_path string, content string")).collect()
    return sorted((r.line_start, r.line_end, r.chunk_type, r.name, r.content) for r in rows)


def test_markdown_sections(spark):
    assert _md(spark, "# Title\n\nParagraph.\n") == [(1, 4, "section", "Title", "# Title\n\nParagraph.")]
    assert [(r[0], r[1]) for r in _md(spark, "# A\n\na\n\n# B\n\nb\n")] == [(1, 4), (5, 8)]
    assert [r[3] for r in _md(spark, "# A\n## B\n### C ###\nx")] == ["A", "B", "C"]


def test_markdown_preamble_frontmatter_and_underlines(spark):
    got = _md(spark, "---\na: 1\n---\n\nhello\n\n# H\nx\n")
    assert [(r[0], r[2], r[3]) for r in got] == [(5, "module", "doc"), (7, "section", "H")]
    assert [r[3] for r in _md(spark, "Big\n=====\n\nx\n\nSmall\n-----\ny\n")] == ["Big", "Small"]


def test_markdown_fences_hide_headings(spark):
    assert [r[3] for r in _md(spark, "# A\n```\n# no\n```\n~~~\n# no\n~~~\n# B\r\nx")] == ["A", "B"]


def test_markdown_blank(spark):
    assert _md(spark, " \n\t\n") == [] and _md(spark, "") == [] and _md(spark, None) == []


def test_dispatch(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass"), ("b.rs", "fn g() {}"), ("c.md", "# H"), ("d.json", "{}"), ("e.py", "  "), ("f.py", None)], "file_path string, content string")
    got = {(r.file_path, r.chunk_type, r.name, r.content) for r in default_registry().chunk(files).collect()}
    assert got == {("a.py", "function", "f", "def f():\n    pass"), ("b.rs", "function", "g", "fn g() {}"), ("c.md", "section", "H", "# H")}


def test_registry_refuses_two_chunkers():
    with pytest.raises(ValueError):
        Registry([([".py"], chunk_python), ([".py"], chunk_python)])
    assert default_registry().extensions == [".md", ".py", ".rs"]


def test_validity(spark):
    rows = spark.createDataFrame([("a", 0, 1, "x", "function", "n"), ("a", 2, 1, "x", "function", "n"), ("a", 1, 1, "x", "odd", "n"), ("a", 1, 1, "x", "class", "n"), ("a", None, 1, "x", "class", "n")], "file_path string, line_start int, line_end int, content string, chunk_type string, name string")
    assert valid(rows).count() == 1 and invalid(rows).count() == 4
