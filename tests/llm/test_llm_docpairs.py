from __future__ import annotations

import pytest

from orewright.llm import docpairs as D

RUST = '''//! module
use a::b;

/// Adds two numbers.
#[inline]
pub fn add(a: u32) -> u32 { a }

// /// Not documentation.
// fn old(x: u32) -> u32 { x }

fn bare() { let s = "fn fake(x) { } /// s"; }

/// Doc of the struct.
pub struct S { a: u32 }

impl S {
    #[doc = "Says \\"hi\\"."]
    pub(crate) async fn attr(&self) { r#"}"#; }

    /** Block words. */
    unsafe fn block(&self) {}

    /// TODO
    fn todo(&self) {}

    //// four slashes
    fn four(&self) {}
    /// first
    // plain
    /// second
    fn two(&self, c: char) -> char { '}' }
}
'''
TS = '''/** Sums. */
export async function sum(a: number) { return `}${a}`; }

/* plain */
function plain(a) { }

/** Arrow words. */
export const arrow = (a: number[], b = 1) => {
  return a;
};

class A {
  /**
   * Method words.
   */
  @traced({ a: 1 })
  async run(x: number) { if (x) { call(x); } }

  quiet(x) { return "/** no */ function no() {}"; }
}
'''
GO = '''package x

// Alpha does it.
func Alpha(a int) int { return a }

// Gone.

func Beta(a int) {}

//go:noinline
func Gamma() {}

/*
Delta text.
*/
func (r *T) Delta() {}

// Type words.
type T struct { a int }
'''
PY = '''# comment
@deco(a=1)
def one(a,
        b=")"):
    """One words."""
    return 1

async def two(): "Inline words."

def three():
    # words before
    x = """not a docstring"""
    return x

class C:
    """Class words."""

    def four(self) -> dict[str, int]:
        r\'\'\'Raw
        words.\'\'\'

    def five(self):
        b"bytes"

    def six(self):
        f"fmt"
    def seven(self):
        "joined".join([])
'''


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("rust", RUST, {"add": "Adds two numbers.", "bare": "", "attr": 'Says "hi".', "block": "Block words.", "todo": "TODO", "four": "", "two": "first\nsecond"}),
        ("ts", TS, {"sum": "Sums.", "plain": "", "arrow": "Arrow words.", "run": "Method words.", "quiet": ""}),
        ("go", GO, {"Alpha": "Alpha does it.", "Beta": "", "Gamma": "", "Delta": "Delta text."}),
        ("python", PY, {"one": "One words.", "two": "Inline words.", "three": "", "four": "Raw\nwords.", "five": "", "six": "", "seven": ""}),
    ],
)
def test_islands(lang, text, want):
    for t in (text, text.replace("\n", "\r\n")):
        got = {name: doc.replace("\r", "") for name, _, _, doc, _ in D.functions(t, lang)}
        assert got == want
        for name, line, end, _, _ in D.functions(t, lang):
            assert name in t[line:end]


def test_code_reaches_its_end():
    code = {n: RUST[line:end] for n, line, end, _, _ in D.functions(RUST, "rust")}
    assert code["two"].endswith("{ '}' }") and code["attr"].endswith('r#"}"#; }')


@pytest.mark.parametrize(
    ("doc", "name", "want"),
    [("", "f", False), ("-----\n***", "f", False), ("TODO: write docs", "f", False), ("FIXME", "f", False), ("Описание позже", "f", False), ("No description.", "f", False), ("The push hit.", "push_hit", False), ("Push Hit", "pushHit", False), ("TODO: x\nWraps at 3.", "f", True), ("Wraps at 3.", "f", True), ("Pushes a hit", "push_hit", True), ("Later stages wait.", "f", True), ("None if empty.", "f", True)],
)
def test_telling(doc, name, want):
    assert D.telling(doc, name) is want


def test_operator(spark, rows):
    files = spark.createDataFrame([("a.rs", "rust", RUST, "s"), ("b.py", None, PY, "s"), ("c.txt", None, "fn x() {}", "s"), ("d.rs", "rust", None, "s"), ("e.rs", "rust", "", "s"), (None, "rust", RUST, "s"), ("g.rs", "rust", "/// Long words.\nfn g() {" + "let a = 1;\n" * 50_000 + "}", "s")], "path string, lang string, text string, symbol string")
    byte = {n: len(RUST[:line].encode()) for n, line, *_ in D.functions(RUST, "rust")}
    d = [
        (1, "add", "fn", "a.rs", 99, byte["add"]), (1, "add", "fn", "a.rs", 99, byte["add"]), (2, "bare", "fn", "a.rs", 11, byte["bare"]), (3, "attr", "method", "a.rs", None, None), (4, "one", "def", "b.py", 3, None),
        (5, "todo", "method", "a.rs", None, byte["todo"]), (6, "S", "struct", "a.rs", 14, None), (7, "none", "fn", "a.rs", 1, 0), (8, None, "fn", "a.rs", 1, 0), (9, "two", "fn", None, 1, 0), (10, "g", "fn", "g.rs", 2, None), (11, "x", "fn", "c.txt", 1, 0),
    ]
    defs = spark.createDataFrame([(*r, "t") for r in d], "def_id bigint, symbol string, kind string, file string, line int, byte bigint, text string")
    got = D.documented(defs, files)
    assert rows(got.select("def_id", "doc")) == sorted([(1, "Adds two numbers."), (3, 'Says "hi".'), (4, "One words."), (10, "Long words.")], key=repr)
    assert rows(D.documented(defs.limit(0), files)) == [] and rows(D.documented(defs, files.limit(0))) == []


def test_same_name_twice(spark, rows):
    text = "/// First words.\nfn new() {}\n\nfn new() {}\n\n/// Third words.\nfn new() {}\n"
    files = spark.createDataFrame([("a.rs", "rust", text)], "path string, lang string, text string")
    defs = spark.createDataFrame([(1, "new", "fn", "a.rs", None, None), (2, "new", "fn", "a.rs", 4, None), (3, "new", "fn", "a.rs", None, None)], "def_id bigint, symbol string, kind string, file string, line int, byte bigint")
    assert rows(D.documented(defs, files).select("def_id", "doc")) == [(1, "First words."), (3, "Third words.")]


@pytest.mark.parametrize(("lang", "text"), [("rust", RUST), ("ts", TS), ("go", GO), ("python", PY)])
@pytest.mark.parametrize("blank", [" ", "\t", " \t  "])
def test_blanks_at_line_ends_change_nothing(lang, text, blank):
    def docs(t):
        return [(n, "\n".join(x.strip() for x in d.splitlines())) for n, _, _, d, _ in D.functions(t, lang)]

    assert docs(text.replace("\n", blank + "\n")) == docs(text)


def test_gaps_of_any_length():
    for n in (1, 300, 450, 20_000):
        assert [d for *_, d, _ in D.functions("/// Doc words.\n" + "\n" * n + "fn f() {}\n", "rust")] == ["Doc words."]
        assert [d for *_, d, _ in D.functions("def f():\n    'Doc words.'" + " " * n + "\n    return 1\n", "python")] == ["Doc words."]
        assert [d for *_, d, _ in D.functions("def f():\n    'Doc words.'" + " " * n + ".x\n", "python")] == [""]
    assert [d for *_, d, _ in D.functions("/// One.  \n/// Two. \n// a note \n\nfn f() {}\n", "rust")] == ["One.\nTwo."]


@pytest.mark.parametrize(
    ("doc", "want"),
    [("TODO: cover by a test", True), ("FIXME: overflows at 3", True), ("TODO: tidy up", True), ("TODO: проверить границы", True), ("TODO: document this", False), ("TODO(ann): describe", False), ("todo - add docs here", False), ("TODO: описать", False), ("XXX", False), ("TODO: TBD", False), ("TODO: Beschreibung ergänzen", False)],
)
def test_work_to_do_is_no_placeholder(doc, want):
    assert D.telling(doc, "f") is want
