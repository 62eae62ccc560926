"""Signatures and bodies of the island grammars at the places where patterns alone go wrong."""

from __future__ import annotations

import pytest

from orewright.operators.codelib import Source, calls, scopes


@pytest.mark.parametrize(
    ("lang", "text", "names"),
    [
        ("ts", "class A {\n  make(a = f(g(1))) {\n  }\n  other(a = f(1)) {}\n}\n", ["make", "other"]),
        ("ts", "const deep = (a = f(g(h(1))), b: Map<string, Array<[number, () => void]>>): Promise<{ a: string }> => {\n}\n", ["deep"]),
        ("ts", "function typed<T extends Record<string, (x: number) => T>>(a: T): { b: number } {\n}\n", ["typed"]),
        ("ts", "const held: (a: number) => void = (a) => { };\nlet x: number\nconst y = async a => { }\n", ["held", "y"]),
        ("ts", "if (f(a)) {\n}\nfor (const x of g(h(1))) {\n}\ncall(a);\n", []),
        ("ts", "class A {\n  get size(): { n: number } | null {\n  }\n  abstract no(a: string): void;\n}\n", ["size"]),
        ("rust", "impl A {\n  pub fn at<const N: usize, F: Fn(u8) -> [u8; 4]>(a: [u8; 4], f: F) -> [u8; 4] where F: Send { a }\n}\nfn last() {}\n", ["at", "last"]),
        ("go", "func (r *Set[K, V]) Any(a func(int) (int, error)) (map[string]interface{}, error) {\n}\nvar f = func(a int) {}\nfunc Last[T any](a T) struct{ x int } {\n}\n", ["Any", "Last"]),
        ("python", "def one(a: dict[str, int] = {'b': 1}, *, c=lambda x: (x, 1)) -> dict[str, int]:\n    return a\nasync def two[T](a: T): pass\n", ["one", "two"]),
        ("rust", "fn open(a: u8 {", []),
    ],
)
def test_signatures(lang, text, names):
    for t in (text, text.replace("\n", "\r\n"), text.replace("\n", " \t\n")):
        assert [f.name for f in Source(t, lang).functions()] == names


def test_bodies_end_at_their_brace():
    rust = "fn at(a: [u8; 4]) -> [u8; 4] { a }\nfn b();\nfn c() { { } }"
    assert [rust[s:e] for _, s, e in scopes(rust, "rust")] == ["fn at(a: [u8; 4]) -> [u8; 4] { a }", "fn b();", "fn c() { { } }"]
    go = "func A() interface{} {\n  x()\n}\nfunc B() {}\n"
    assert [go[s:e] for _, s, e in scopes(go, "go")] == ["func A() interface{} {\n  x()\n}", "func B() {}"]
    assert list(calls(go, "go")) == [("A", "x", 2)]


@pytest.mark.parametrize("lang", ["rust", "ts", "go", "python"])
@pytest.mark.parametrize("text", ["", "fn", "func", "func (", "def f(", "const a =", "const a: ", "fn f<", "class A {\n a<", "\x00", "/*", '"', "func (a) (", "let x: {"])
def test_broken_texts(lang, text):
    assert isinstance(list(Source(text, lang).functions()), list)
