from ledgerloom.parsers.base import parse_files, parse_guarded, parser_for, register, symbols_of
from ledgerloom.sources.aliases import load_aliases, resolve_alias, strip_jsonc

import json

import pytest

GO = '''package main

import (
	"fmt"
	"os"
)

type Store struct {
	path string
}

const Limit = 3

var wait = 5

func Open(path string, flags ...int) (*Store, error) {
	return nil, nil
}

func (s *Store) Close() error { fmt.Println(os.Args); return nil }

type Set[K comparable] map[K]struct{}

func Each(f func(int, string) bool, m map[string][]int) chan<- int { return nil }
'''
TS = '''import { a } from "./a";
import "./side";
import {
  b,
} from '../lib/b/index.ts';

/* const hidden = 1; */
const text = `const nope = ${a({ x: 1 })} {`;
export const N = 1;
export const add = (x: number, y: number) => {
  const inner = 2;
  return x + y;
};
export interface Shape {
  area(scale: number): number;
}
export type Either =
  | { ok: true }
  | { ok: false };
export abstract class Base<T> {
  private items: T[] = [];
  constructor(x: number) { if (x) { run(); } }
  async load(id: string): Promise<void> {
    const local = require("pkg");
  }
}
export default async function main() {
  await import("./lazy");
}
let regex = /[/"]{2}/.test(text);
'''


def test_go():
    status, symbols, imports = parse_guarded("cmd/x.go", GO, {})
    assert status == "ok" and imports == ["fmt", "os"]
    found = {s.name: s for s in symbols}
    assert [s.kind for s in symbols] == ["type", "const", "var", "func", "method", "type", "func"]
    assert found["Open"].signature == "func Open(path string, flags ...int) (*Store, error)"
    assert found["Close"].signature == "func s *Store Close() (error)"
    assert found["Store"].signature == "type Store struct{...}" and (found["Store"].line_start, found["Store"].line_end) == (8, 10)
    assert found["Each"].signature == "func Each(f func(int, string) (bool), m map[string][]int) (chan<- int)"


def test_broken_go_keeps_what_it_can():
    assert [s.name for s in parse_guarded("b.go", "package b\n\nfunc Incomplete(x int {\n", {})[1]] == ["Incomplete"]
    assert parse_guarded("e.go", "package e\n", {}) == ("ok", [], [])


def test_typescript():
    status, symbols, imports = parse_guarded("src/feature/x.ts", TS, {})
    assert status == "ok"
    assert imports == ["src/feature/a", "src/lib/b", "pkg", "src/feature/lazy"]  # the bare import isn't caught
    assert [(s.kind, s.name) for s in symbols] == [
        ("const", "text"), ("const", "N"), ("func", "add"), ("type", "Shape"), ("method", "area"), ("type", "Either"), ("type", "Base"), ("method", "constructor"), ("method", "load"), ("func", "main"), ("var", "regex"),
    ]
    found = {s.name: s for s in symbols}
    assert (found["Either"].line_start, found["Either"].line_end) == (17, 19)
    assert found["add"].line_end == 13 and found["Base"].line_end == 26


def test_components():
    svelte = '<script context="module">\n  export const V = 1;\n</script>\n<p>hi</p>\n<script>let a = 1;</script>\n<script lang="ts">\nimport x from "$lib/x";\nfunction go() {\n}\n</script>\n'
    _, symbols, imports = parse_guarded("a.svelte", svelte, {"$lib/*": "src/lib/*"})
    assert [(s.name, s.line_start, s.line_end) for s in symbols] == [("V", 2, 2), ("a", 5, 5), ("go", 8, 9)] and imports == ["src/lib/x"]
    astro = '---\nimport L from "../L.astro";\nconst page = 1;\n---\n<html></html>\n'
    _, symbols, imports = parse_guarded("src/pages/a.astro", astro, {})
    assert [(s.name, s.line_start) for s in symbols] == [("page", 3)] and imports == ["src/L"]


def test_guard_and_registry(spark):
    assert parser_for("a/b.MTS")[0] == "typescript" and parser_for("a.css") is None
    with pytest.raises(ValueError):
        register("go", ("go2",), None)
    register("slow", ("slow",), lambda p, t, a: __import__("time").sleep(5))
    assert parse_guarded("x.slow", "", {}, 0.2)[0] == "timeout"
    rows = spark.createDataFrame([("a.go", GO), ("b.ts", TS), ("c.css", "x"), ("d.ts", None)], "file_path string, content string")
    parsed = parse_files(rows)
    assert dict(parsed.select("file_path", "status").collect()) == {"a.go": "ok", "b.ts": "ok", "c.css": "unsupported", "d.ts": "ok"}
    assert symbols_of(parsed).count() == 18


def test_aliases(tmp_path):
    aliases = {"@core/*": "src/core/*", "@core/di/*": "src/vendor/di/*", "exact": "src/exact.ts", "a*a": "x/*"}
    cases = {"@core/bff/proxy": "src/core/bff/proxy", "@core/di/container": "src/vendor/di/container", "exact": "src/exact.ts", "@core": None, "svelte": None, "a": None}
    assert {k: resolve_alias(k, aliases) for k in cases} == cases
    text = '{ // c\n "compilerOptions": { "baseUrl": "src", /* x */ "paths": { "@/*": ["./*"], "u": ["http://h//x",], }, }, }'
    assert json.loads(strip_jsonc(text))["compilerOptions"]["paths"]["u"] == ["http://h//x"]
    (tmp_path / "tsconfig.json").write_text(text)
    assert load_aliases(str(tmp_path))["@/*"] == "src/*"


def test_typescript_by_grammar():
    """Declarations are told by their grammar: where lines break doesn't matter, nor what literals hold."""
    source = """
const a = `x ${ { b: `${1}` }.b } y
function inTemplate() {}
`, other = 2;
export const VERSION = "1.0";
const re = /[/"'`]\\/{/g, half = 4 / 2 / 1;
export default class extends Base {}
export class Box<T extends { id: string }> extends mixin({ x: 1 }) implements Thing {
  static #hidden() {}
  @log({ level: 1 }) private async *load<K>(
    key: K,
  ): Promise<{ ok: boolean }> {
    function inner() {}
  }
  value = () => { const nope = 1; };
  get size(): number { return this.a ? 1 : 2 }
  static { const nope = 2; }
  ready?(): void;
}
declare function overload(x: number): string
function overload(x: any): { y: number } { return { y: x } }
export namespace Deep.Er { export const inside = 1; function f() { const g = 1 } }
type Fn = (x: number) =>
  | string
  | number
const enum Level { Low, High }
let later: Map<string, number> = new Map()
const pick = async <T,>(x: T): Promise<T> => x
const { destructured } = obj;
if (a) {
  var hoisted = function () { const no = 1; };
}
"""
    symbols = parse_guarded("x.ts", source, {})[1]
    assert [(s.kind, s.name) for s in symbols] == [
        ("const", "a"), ("const", "VERSION"), ("const", "re"), ("type", "Box"), ("method", "load"), ("method", "size"), ("method", "ready"), ("func", "overload"), ("func", "overload"),
        ("type", "Deep"), ("const", "inside"), ("func", "f"), ("type", "Fn"), ("type", "Level"), ("var", "later"), ("func", "pick"), ("func", "hoisted"),
    ]
    found = {s.name: s for s in symbols}
    assert found["VERSION"].signature == 'export const VERSION = "";' and found["a"].signature == "const a = `${"
    assert (found["load"].line_start, found["load"].line_end) == (10, 14) and (found["Fn"].line_start, found["Fn"].line_end) == (23, 25)
    assert found["Box"].line_end == 19 and found["a"].line_end == 4 and found["re"].signature == "const re = //g, half = 4 / 2 / 1;"


def test_typescript_imports():
    source = """import type { A } from "./a"; import B, {
  C,
} from './b/index.ts'
import "./side"
import d = require("./d");
export * as ns from "pkg"; export { e } from "./e"
export const from = "./no";
export const lazy = async () => (await import("./lazy")).default; // import x from "./comment"
const s = `${require("./inside")}`, t = 'import q from "./text"';
import * as again from "./a"
"""
    assert parse_guarded("src/x.ts", source, {})[2] == ["src/a", "src/b", "src/d", "pkg", "src/e", "src/lazy", "src/inside"]


def test_broken_typescript_ends():
    for source in ("class A { b( {", "const x = `${", "function f(", "}}}} const y = 1", "type T = {", "a ? /x : 1", "class { @", "export", "<p>don't</p>\nconst z = 1", "interface I { [k: string]: ( }", "enum", "@", "class A { ] }"):
        assert parse_guarded("x.ts", source, {}, 2)[0] == "ok", source
    assert [s.name for s in parse_guarded("x.tsx", "}}}} const y = 1;\n", {})[1]] == ["y"]


def test_table_functions(spark, sf_dir):
    """The parsers in SQL, over a partitioned table and as a lateral function, equal ``parse_files``."""
    from pyspark.sql import functions as F

    from ledgerloom.parsers.base import parse_files, register_functions, symbols_of

    register_functions(spark)
    script = "<script lang='ts'>\nexport function f%d(x: number) { return x }\nexport const K = %d\n</script>\n"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.format_string("p/%d.svelte", "page_id").alias("file_path"), F.concat(F.format_string(script, "page_id", "page_id"), "html").alias("content"))
    odd = spark.createDataFrame([("a.go", "package p\n\nfunc A() {}\n"), ("b.txt", "x"), ("c.go", None), (None, "x")], "file_path string, content string")
    rows = pages.union(odd)
    rows.createOrReplaceTempView("source_files")
    want = sorted(map(repr, symbols_of(parse_files(rows)).select("file_path", "name", "kind", "line_start", "line_end", "signature").collect()))
    for sql in (
        "SELECT file_path, name, kind, line_start, line_end, signature FROM parse_symbols(TABLE(source_files) PARTITION BY file_path) WHERE name IS NOT NULL",
        "SELECT f.file_path, s.* FROM source_files f, LATERAL parse_text(f.file_path, f.content) s",
    ):
        assert sorted(map(repr, spark.sql(sql).collect())) == want and len(want) > 100
    status = {r["file_path"]: r["status"] for r in spark.sql("SELECT * FROM parse_symbols(TABLE(source_files)) WHERE name IS NULL").collect()}
    assert status["b.txt"] == "unsupported" and status["c.go"] == "ok"
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM parse_symbols(TABLE(SELECT 1 AS x))").collect()


def test_a_small_table_is_parsed_by_many_tasks(spark):
    """what is parsed is dealt evenly, whatever few tasks the table would be read by."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 400, 1, 1).select(F.format_string("src/%d.ts", "id").alias("file_path"), F.format_string("export const N%d = 1;\n", "id").alias("content"))
    parsed = parse_files(rows)
    tasks = parsed.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) <= 110
    assert sorted(r["name"] for r in symbols_of(parsed).collect()) == sorted(f"N{i}" for i in range(400))
