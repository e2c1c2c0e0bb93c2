"""Declarations by tokens: forms of each language, what must not count, and time on hostile texts."""

import time

import pytest

from quarrylight.operators import ingest as I
from quarrylight.operators import lexer

TEXTS = {
    "typescript": (
        """// class Ghost {}
export default abstract class Store<T extends { a: number }> extends Base<T> implements X {
  private readonly cache = new Map<string, number>();
  #secret(a: string): { ok: boolean } { return { ok: a < "}" }; }
  constructor(private x: number) { super(); }
  static async *walk<K>(a: K, cb: (x: number) => void = () => {}): AsyncGenerator<K> { if (a) { call(a); } }
  get size(): number { return this.cache.size; }
  plain(text = 'class No {') { while (text) { go(text) } }
}
interface Shape { area(): number; name: string }
enum Color { Red, Green }
type Pair<A, B> = { a: A; b: B };
export async function* recall(q: string) { return q; }
const add = (a: number, b: number): number => a + b, other = 1;
const typed: (x: number) => string = async x => `function no() {} ${x}`;
let old = function () {};
var generic = <T,>(x: T) => x;
const notOne = add(1, 2);
const flag: boolean = a < b;
export const api = { load(id) { return fetch(id); }, url: "x", save: function () {} };
foo.function(1); obj.class = 2;
const last = (x
  : string) => x;
""",
        ["Store", "secret", "walk", "size", "plain", "Shape", "Color", "Pair", "recall", "add", "typed", "old", "generic", "load", "last"],
    ),
    "go": (
        """package m
type Store struct{ a func(int) }
type (
	Left struct { x int }
	Right[T any] interface { Do(T) }
	alias = int
)
// func ghost() {}
var s = `func no() {}` + "type No struct"
func Map[K comparable](x K) K { return func() K { return x }() }
func (s *Store) Recall(q string) string { return q }
""",
        ["Store", "Left", "Right", "Map", "Recall"],
    ),
    "rust": (
        """/* fn ghost() {} */
pub struct Store<'a> { x: &'a str }
enum Kind { A, B }
pub trait Keep { type Item; fn keep(&self) -> u8; }
impl<'a> Store<'a> { pub(crate) async fn recall(&self, c: char) -> u8 { if c == '"' { 1 } else { r#"fn no() {"#; 2 } } }
mod inner { union U { a: u8 } }
macro_rules! make { () => {} }
type Alias = u8;
""",
        ["Store", "Kind", "Keep", "Item", "keep", "recall", "inner", "U", "make", "Alias"],
    ),
    "java": (
        """@Named("class No {")
public class Store<T extends Comparable<T>> extends Base {
    private final Map<String, List<Integer>> cache = new HashMap<>(1);
    public Store(int a) throws java.io.IOException, Bad { super(a); }
    @Override public <K> Map<K, int[]> recall(String q, int[] b) throws Bad { return find(q); }
    int[] many() { if (a) { call(1); } for (;;) { } return make(2); }
    abstract void later();
    interface Keeper { String remember(String text); }
    enum Kind { A(1) { void odd() { } }, B }
    record Point(int x, int y) { }
    Runnable run = () -> {}; Function<A, B> one = x -> x;
    int record = 3;
    String s = \"\"\"
        void no() { }
        \"\"\";
}
""",
        ["Store", "Store", "recall", "many", "later", "Keeper", "remember", "Kind", "odd", "Point", "run", "one"],
    ),
}


@pytest.mark.parametrize("language", sorted(TEXTS))
def test_forms_of_each_language(language):
    text, names = TEXTS[language]
    found = lexer.declarations(text, language)
    got = [n for n, _ in found]
    assert got == names
    assert all(text[at:].startswith(n) for n, at in found)


HOSTILE = ["const a : ", "a<", "a(", "{", "}", "/*", '"', "`", "'", "class ", "type a<", "const a = (", "throws ", "f() : ", "r#\"", "x: {", "class A { f(): ", "int a() throws b.", "<", ">", "=> ", "const a: (x", "\\", "é漢 "]


@pytest.mark.parametrize("language", sorted(lexer.QUOTED))
def test_time_is_linear(language):
    """Twice the text takes about twice the time, and nothing fails; 200 KB of each hostile form."""
    for form in HOSTILE:
        took = []
        for n in (100_000, 200_000):
            text = (form * (n // len(form) + 1))[:n]
            began = time.perf_counter()
            lexer.declarations(text, language)
            took.append(time.perf_counter() - began)
        assert took[1] < 3.2 * took[0] + 0.15, (form, took)


def test_inferred_patterns():
    assert I.inferred_symbol("a.c", "struct Foo { int x; };") == "Foo"
    assert I.inferred_symbol("a.txt", "enum Kind { A }") == "Kind"
    assert I.inferred_symbol("a.txt", "const go = function () {}") == "go" and I.inferred_symbol("a.txt", "const go = <T>(x) => x") == "go"
    assert len(I.INFERRED) == 12
