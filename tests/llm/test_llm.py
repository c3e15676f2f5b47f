"""Operators for text and code on small fixtures."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.llm import documented, ebnf, gll, grammars, handwritten, lexers, packing, parsing, personal, tagger, tokens

PATH = tokens.tokenizer_path()


def docs(spark, rows):
    return spark.createDataFrame([(k, t, p, "r", 1) for k, (t, p) in enumerate(rows)], "doc_id long, text string, file_path string, repo string, pair int")


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_equal_whole_text_encoding_and_decode_back(text):
    table = tokens.word_table(PATH)
    ids, counts = table.encode([text, "", text])
    whole = table.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == whole + whole and counts.tolist() == [len(whole), 0, len(whole)]
    assert table.lengths([text]).tolist() == [len(whole)]
    pieces = tokens.id_bytes(PATH)
    assert b"".join(pieces[i] for i in whole).decode() == text
    at = tokens.char_offsets(np.array(whole, np.int64), PATH)
    assert (np.diff(at) >= 0).all() and (not len(at) or at[-1] < len(text))


@pytest.mark.parametrize("text", ["don't we'll I've x's 's  's \t's", "a  b\n\n  c \n", "<|endoftext|> is text", "'", "''s 'S", "数据 naïve ½ x²", "  ", "\x1c \x85 end"])
def test_ids_of_odd_texts(text):
    table = tokens.word_table(PATH)
    assert table.encode([text])[0].tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_split_rules_and_equal_hashes_are_encoded_whole(tmp_path, monkeypatch):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    assert tokens.splits_as_here(PATH)
    spec["normalizer"] = {"type": "Lowercase"}
    other = str(tmp_path / "other.json")
    json.dump(spec, open(other, "w", encoding="utf-8"))
    table, texts = tokens.WordTable(other), ["Hello  World", "", "don't"]
    whole = [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = table.encode(texts)
    assert table.whole and ids.tolist() == [x for r in whole for x in r] and counts.tolist() == table.lengths(texts).tolist() == [len(r) for r in whole]
    same = tokens.WordTable(PATH)
    same.encode(["ab cd"])
    same.at = {h: 0 for h in same.at}  # as if all words had one hash
    assert same.words(["cd"]) is None or same.encode(["ab cd"])[0].tolist() == same.tokenizer.encode("ab cd", add_special_tokens=False).ids
    assert same.encode(["ab cd"])[0].tolist() == same.tokenizer.encode("ab cd", add_special_tokens=False).ids


def test_encode_and_decode_tables(spark):
    df = spark.createDataFrame([(1, "héllo", 5), (2, None, 5), (3, "", 5), (4, "x " * 30_000, 5)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode(df, PATH).collect()}
    assert got[2] == [] and got[3] == [] and len(got[4]) > 20_000
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df, PATH), PATH).collect()}
    assert back == {1: "héllo", 2: "", 3: "", 4: "x " * 30_000}
    assert tokens.encode(df.limit(0), PATH).count() == 0
    cut = spark.createDataFrame([(1, got[1][:2])], "doc_id long, ids array<int>")
    assert tokens.decode(cut, PATH).first().text.startswith("h")


@given(st.dictionaries(st.integers(0, 60), st.integers(1, 40), max_size=25), st.integers(3, 60))
@settings(max_examples=300, deadline=None)
def test_plan_fills_no_window_beyond_capacity(counts, capacity):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    plan, windows = packing.plan_windows(counts, capacity)
    used = np.zeros(max(windows, 1), int)
    seen = dict.fromkeys(counts, 0)
    for size, lo, hi, window, per in sorted(plan):
        assert lo == seen[size]
        seen[size] = hi
        for r in range(lo, hi):
            used[window + (r - lo) // per] += size
    assert seen == counts and (used <= capacity).all()
    assert windows >= -(-sum(s * n for s, n in counts.items()) // capacity)


def test_pack_tables(spark):
    sizes = spark.createDataFrame([(k, n, "x") for k, n in enumerate([7, 7, 3, 3, 0, None, 25, 10, 5, 5, 1])], "doc_id long, n_tokens long, piece string")
    rows = packing.pack(sizes, {"w": 10}).collect()
    fill = {}
    for r in rows:
        fill[r.window_no] = fill.get(r.window_no, 0) + r.n_tokens
    assert max(fill.values()) <= 10 and sum(fill.values()) == 66 and len(fill) == 7
    assert sorted((r.piece, r.start_token, r.n_tokens) for r in rows if r.doc_id == 6) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert packing.pack(sizes.limit(0), {"w": 10}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sizes, {"w": 0})
    same = packing.pack(spark.range(500).select(F.col("id").alias("doc_id"), F.lit(4).alias("n_tokens")), {"w": 10})
    assert packing.report(same, {"w": 10}).first().windows == 250


def test_plan_of_a_wide_capacity_is_quick_and_hot_sizes_are_parted(spark):
    import random
    import time

    r = random.Random(3)
    counts = {s: r.randint(1, 40) for s in range(1, 131_073)} | {131_072: 9_000_000, 0: 5_000_000}
    began = time.process_time()
    plan, windows = packing.plan_windows(counts, 131_072)
    assert time.process_time() - began < 8 and len(plan) < 600_000
    assert sum(hi - lo for _, lo, hi, *_ in plan) == sum(counts.values()) and windows >= sum(s * n for s, n in counts.items()) / 131_072
    # equal sizes, ranked in a hundred parts
    same = packing.pack(spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(7).alias("n_tokens")), {"w": 10}, part=1_000)
    assert same.select("window_no").distinct().count() == 100_000


GOOD = {
    "a.js": "import x from './y.js';\nexport const f = async (a, {b, c} = {}) => `t ${a.b ? `n ${c}` : 'd'}`\nlet r = /[/'\"]+/g, q = a / 2 / b\nclass A { static #p = 1; get v() { return this.#p } }\nfor (const k of r) { if (k) continue; else break }\n",
    "b.ts": "export interface E<T> { readonly a?: T; m(k: string): void }\nabstract class C<T> extends B<T> implements E<T> { constructor(private x: number) { super() } abstract go(): void; }\nconst v = x as unknown as Map<string, number[]>;\n",
    "C.java": 'package a.b;\nimport java.util.*;\n@Fix(a = {1, 2})\npublic final class C<T extends A & B> {\n  <R> List<R> f(final int... x) throws E { for (int i = 0; i < 3; i++) { g((a, b) -> a + b, String::valueOf); } return x[0] > 1 ? null : new ArrayList<>() {}; }\n  enum K { A, B; }\n}\n',
    "d.py": 'import a.b as c\nfrom . import d\n@x.y(1)\nasync def f(a, *b, k: int = 1, **c) -> "t":\n    """doc"""\n    x = [i for i in a if i] + {1: 2}["k":]\n    raise E("a, b") from None\nif x: pass\nelse:\n    try:\n        y = lambda z: z\n    except (A, B) as e:\n        print(f"{e}")\n',
    "E.cs": 'using System;\nnamespace A.B\n{\n    [Obsolete("x")]\n    public class C<T> : D where T : new()\n    {\n        public int P { get; set; } = 1;\n        string F(ref int a) => $"{a}}}" + @"c:\\x\\";\n        void G() { var d = new Dictionary<string, int> { ["a"] = 1 }; foreach (var x in d) { y?.Z(); } }\n    }\n}\n',
    "f.gradle": "plugins {\n    id 'x' version '1'\n}\ndependencies {\n    api 'a:b:1'\n    implementation(project(':c')) { exclude group: 'g' }\n}\ntasks.register('t') { doLast { println \"n ${project.name}\" } }\n",
    "g.json": '{"a": [1, -2.5e3, true, null], "b": {"c": "\\u00e9"}}',
}
BAD = {
    "a.js": ["function f( {", "if (a > 8) {\n", "let x = [1, ;", "f((6;\n", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "const a;\n", "x = “y”;", "/* open", "let s = 'a\n", "using System;\n", "try { a() } b()"],
    "b.ts": ["class A {\n  if a > 8) {\n}\n", "import java.io.IOException;\n", "const x: = 1;"],
    "C.java": ["class A { int f() { return 1; }", "using System;\nnamespace A { }", "class A { int x = load((6; }", 'class A { String s = "a; }', "<html><body></body></html>"],
    "d.py": ["if x\n    pass\n", "def f():\nx = 1\n", "print 'a'\n", "raise E, 'x'\n", "  x = 1\ny = 2\n z = 3\n", "import a = b\n", "x = (1,\n", "'''open\n", "def f(a):\n    if a:\n        x\n      y\n"],
    "E.cs": ["class A { void F() { }", "package a.b;\n", 'class A { string s = "x; }'],
    "f.gradle": ["a {\n", "x = 'a\n", "<<<<<<< ours\na\n"],
    "g.json": ["{'a': 1}", '{"a": 1,}', '{"a": 1', '[1 2]', '{"a"}', '["a": 1]', "// c\n{}", '{"a": 01}'],
}


def test_parse_faults(spark):
    rows = [(t, p) for p, t in GOOD.items()] + [(t.replace("\n", "\r\n"), p) for p, t in GOOD.items()] + [(None, "x.py"), (" \n", "x.java"), ("((", "x.txt"), ("((", None)]
    good = len(rows)
    rows += [(t, p) for p, ts in BAD.items() for t in ts]
    df = docs(spark, rows)
    got = {r.doc_id for r in parsing.faults(df.union(df)).collect()}
    assert not {rows[k] for k in got if k < good}
    assert not {rows[k] for k in range(good, len(rows)) if k not in got}
    assert parsing.faults(df.limit(0)).count() == 0
    deep = docs(spark, [("x = " + "(" * 5000 + ")" * 5000 + ";\n", "a.js"), ("x = " + "(" * 5000 + ")" * 4999 + ";\n", "a.js")])
    assert [r.doc_id for r in parsing.faults(deep).collect()] == [1]
    r = parsing.rates(df, parsing.faults(df)).where("language = 'json'").first()
    assert (r.files, r.invalid) == (2 + len(BAD["g.json"]), len(BAD["g.json"]))


def test_templates_of_any_depth_are_lexed():
    deep = "`a${f({b: `c${`d${`e${`f${1}`}`}`}`})}g`"
    assert len(lexers.plain_templates(f"x = {deep};")) == len(f"x = {deep};") and lexers.plain_templates("`${a}` + `b`") == "`${a}` + `b`"
    code = lexers.lex([f"let x = {deep} + '`${{' ; // `${{`\n", "let y = `${a{`;"], "javascript")[0].tolist()
    n = lexers.classes()
    assert code.count(n["str"]) == 2 and code.count(n["ERR"]) > 0 and code.index(n["ERR"]) > code.index(n["EOF"])


def test_grammar_relations():
    g = ebnf.Grammar('S = "a" { B } [ "c" ] "d" ; B = "b" | S ;')
    assert g.first["S"] == {"a"} and ("b", "c") in g.adjacent("S") and ("a", "d") in g.adjacent("S") and ("d", "EOF") in g.adjacent("S") and ("c", "b") not in g.adjacent("S")
    assert ("try", "{", "catch") in grammars.productions("java")
    assert all(lexers.classes()[a] < 512 for a in lexers.classes())


def test_gll_is_ambiguous_and_left_recursive():
    r = gll.Recogniser(ebnf.Grammar('S = S "+" S | name ;'), "S")
    assert r.name_at(["id", "+", "id", "+", "id"]) is not None and r.name_at(["id", "+"]) is None


def test_documented_functions():
    js = "/** Adds the two given numbers. */\nexport const add = async (a, b = {c: 1}) => {\n  return a;\n};\n/** @param x */\nfunction no(x) {}\n// Adds the two given numbers.\nfunction not(x) {}\nclass A {\n  /** Gives the value back\n   * unchanged. */\n  static get(v) { return v; }\n  /** TODO describe this one here */\n  f() {}\n}\nvar s = '/** Not a real comment here */ function g() {}';\n"
    assert [(n, line) for n, line, *_ in documented.functions(js, "javascript")] == [("add", 2), ("get", 12)]
    assert documented.functions(js, "javascript")[0][3].endswith("return a;\n}")
    java = "class A {\n/** Reads the next whole row. */\n@Fix({1})\npublic <T> Map<String, T[]> next(int a) throws E {\n}\n/** Reads the next whole row. */\nint field;\n/** Reads the next whole row. */\nvoid decl();\n/** {@inheritDoc} */\nvoid h() { }\n/** Open to the end here. */\nvoid open() { \n"
    assert [(n, line) for n, line, *_ in documented.functions(java, "java")] == [("next", 4)]
    py = 'class A:\n    async def f(\n        self,\n    ) -> int:\n        """Gives the number of rows.\n\n        :param x: none\n        """\n        return 1\n\ndef g(): \'Too short\'\ndef h():\n    x = """Not a doc string at all"""\n'
    got = documented.functions(py, "python")
    assert [(n, line, d) for n, line, d, *_ in got] == [("f", 2, "Gives the number of rows.")] and got[0][3].endswith("return 1")
    cs = '/// <summary>\n/// Counts all rows of it.\n/// </summary>\n/// <param name="a">the a of the call</param>\n[Obsolete("x")]\npublic static int CountRows<T>(int a) where T : new() => 1;\n/// <inheritdoc/>\nvoid F() { }\n'
    assert [(n, line) for n, line, *_ in documented.functions("class A {\n" + cs + "}", "csharp")] == [("CountRows", 7)]


FUNCTIONS = {
    "a.js": (["(a, {b, c} = {}, ...d) { for (const k of a) { if (k) continue; else break } return b ? `t ${`n ${`m ${`l ${c}`}`}`}` : [1, 2,, 3] }", "(a) { try { await_(a) } catch { }\n let x = y => ({a, get b() { return 1 }})\n do x++; while (x < 9)\n return }", "(a) { switch (a) { case 1: b(); break; default: return } x: for (;;) { break x } }"], ["(a,,b) { return a }", "(a) { return a + * ; let let = ; }", "(a) { if a > 8) { } }", "(a) { else { } }", "(a) { return [a; }"]),
    "b.ts": (["<T extends B>(a?: T, b: Map<string, number[]> = new Map()): a is T { const v = a as unknown as T; return v!.x!.y<T>(b) satisfies Z }"], ["(a: , b) { }", "(a: string) { const x: = 1; }"]),
}


@pytest.mark.parametrize("path", FUNCTIONS)
def test_functions_of_scripts_must_derive(path):
    language = lexers.known([path])[0]
    doc = "/** Adds up all the given rows. */\nfunction f{0}{1}\n"
    good, bad = FUNCTIONS[path]
    text = "".join(doc.format(k, x) for k, x in enumerate([*good, *bad])) + "/** Broken to its end, this one. */ function g( {"
    assert [n for n, *_ in documented.sound_functions([text], language)[0]] == [f"f{k}" for k in range(len(good))]


def test_functions_of_other_languages_must_derive():
    java = "class A { {{{\n" + "".join(f"/** Adds up all the given rows. */\n{x}\n" for x in ["<T> int a(final int... x) throws E { for (int i = 0; i < 3; i++) g((p, q) -> p + q, String::valueOf); return x instanceof F f ? null : new ArrayList<>() {}; }", "int b(int int, String) { return 1; }", "int c(int x) { if (x > 1) return 1; else }", "void d() { try (var r = open()) { r.x(); } catch (A | B e) { throw e; } finally { } }"])
    assert [n for n, *_ in documented.sound_functions([java], "java")[0]] == ["a", "d"]
    cs = "class A {{{{\n" + "".join(f"/// <summary>Adds up all the given rows.</summary>\n{x}\n" for x in ["int A(ref int x, string y = \"a\") { if (x is Foo f && y as B != null) return x switch { 1 => 2, _ => 3 }; return 0; }", "int B<T>(T x) where T : new() => x?.Y ?? new T { Z = 1 };", "int C(int x y) { return x; }", "int D() { return x +; }"])
    assert [n for n, *_ in documented.sound_functions([cs], "csharp")[0]] == ["A", "B"]
    py = "x = (\n" * 0 + "class A:\n" + "".join(f"    def {x}\n" for x in ['a(self, *b, k: int = 1, **c) -> int:\n        """Adds up all the given rows."""\n        with open(k) as f, g:\n            return [i for i in b if i][1:]\n        try: pass\n        except (A, B) as e:\n            raise E from e', 'b(a b, ):\n        """Adds up all the given rows."""\n        return 1', 'c(a):\n        """Adds up all the given rows."""\n        return a +', 'd(a):\n        """Adds up all the given rows."""\n        if a:\n        return a', 'e(a):\n        """Adds up all the given rows."""'])
    assert [n for n, *_ in documented.sound_functions([py], "python")[0]] == ["a", "e"]
    members = "class A {\n/** Removes the row of a key. */\ndelete(k) { }\n/** Gives back what is there. */\nstatic async *in(k) { yield* k }\n}\nfor (const k of x) { /** Only while there are rows. */ if (k) { } }"
    assert [n for n, *_ in documented.sound_functions([members], "javascript")[0]] == ["delete", "in"]


def test_nested_brackets_are_read_in_parts():
    g = ebnf.Grammar('P = { S } ; S = "a" ";" | "{" { S } "}" | "[" [ "b" { "," "b" } ] "]" ; ')
    own = gll.Nested(g, "P", "S", by_line=False)
    derives = lambda t: own.derives(t.split(), [False] * len(t.split()))
    assert derives("a ; { a ; { } a ; } [ b , b , b , b ]") and derives("") and derives("[ ]")
    assert not derives("{ a }") and not derives("{ a ;") and not derives("a ; }") and not derives("[ b , , b ]") and not derives("[ b , b , ]") and not derives("( )")
    deep = "{ " * 3000 + "} " * 3000
    assert derives(deep) and not derives(deep + "}") and derives("[ " + "b , " * 20_000 + "b ]")


@pytest.mark.parametrize("text, name, want", [("Prunes the closure bundle.", "pruneClosureBundle", True), ("Auto-generated method stub.", "f", True), ("See base class for the details.", "f", True), ("Gives the rows in order.", "rows", False), ("", "f", True), ("Applies a filter to rows", "apply_filter", False)])
def test_trivial_descriptions(text, name, want):
    assert documented.trivial(text, name) is want


def test_pairs_drop_templates(spark):
    own = "/** Shared by many of them. */\nfunction f{0}() {{ }}\n"
    rows = [("".join(own.format(k) for k in range(5)) + "/** Only this one has it. */\nfunction g() { }\n/** Broken at the end here. */\nfunction h() {", "a.js"), (None, "b.js"), ("", "c.java")]
    df = docs(spark, rows)
    assert [r.method_name for r in documented.pairs(df.union(df), max_repeats=4).collect()] == ["g"]
    assert documented.pairs(df.limit(0)).count() == 0


def test_templates_are_known_by_what_does_not_differ():
    assert documented.template("Gives the rowSet of 12 tokens for 'a b'.", "tokensOf") == "gives the # # # # for #."
    assert documented.template("Returns the name of this object.", "getName") == documented.template("Returns the size of this object.", "size") == "returns the # of this object."
    assert documented.template("Walks the rows in order.", "go") != documented.template("Walks the cells in order.", "go")


def test_templates_do_not_depend_on_copies_or_size(spark):
    def corpus(size):
        rows = [(f"/** Walks the {''.join(chr(97 + int(d)) for d in str(k))} rows in their order. */\nfunction own{k}() {{ return {k}; }}\n", f"a{k}.js") for k in range(20 * size)]
        rows += [(f"/** Shared by many of them. */\nfunction same{k}() {{ }}\n", f"b{k}.js") for k in range(5 * size)]
        return docs(spark, rows + [("/** Copied to many places whole. */\nfunction copied() { return 1; }\n" + " " * (k % 2), f"c{k}.js") for k in range(30)])

    for size in (1, 6):
        names = [r.method_name for r in documented.pairs(corpus(size)).collect()]
        assert names.count("copied") == 30 and len(names) == 30 + 20 * size and not any(n.startswith("same") for n in names)


def test_handwritten_labels_and_shapes():
    lines = handwritten.opening_lines("#!/bin/x\n// Code generated by x. DO NOT EDIT.\n\n/* a\n * a\n*/\nvar a; // @generated\n")
    assert lines == ["#!/bin/x", "// Code generated by x. DO NOT EDIT.", "/* a", "* a", "*/"] and handwritten.opening_lines("") == []
    assert handwritten.notice(lines[1]) and handwritten.notice("/*! lib 1.2.3 | licence */") and not handwritten.notice("// Kept apart from the generated code on purpose.")
    assert handwritten.tool_named("r/node_modules/x/a.js") and handwritten.tool_named("r/a/b_pb2.py") and not handwritten.tool_named("r/codegen/distance/min_a.js")
    assert handwritten.shaped("x = [" + "0x1234, " * 100 + "]") and not handwritten.shaped("const s = 'some words in a row';\n" * 40) and not handwritten.shaped("")
    masked = handwritten.text_features("// Code generated by x. DO NOT EDIT.\nvar abc = 1;")
    assert (masked == handwritten.text_features("var abc = 1;")).all()
    assert abs(handwritten._dense(handwritten._sparse(masked)) - masked).max() < 1e-3


def test_handwritten_line_scores_equal_those_of_their_ngrams():
    weights = np.random.default_rng(2).normal(size=handwritten.TEXT_BUCKETS).astype(np.float32)
    lines = ["// Code generated by x", "ab", "", "ünïcode ünïcode ünïcode", "aaaaaaaaaaaaaaaaaaa", "// Code generated by x"]
    assert np.allclose(handwritten.line_scores(lines, weights), [float(handwritten.ngrams(x) @ weights) for x in lines], atol=1e-4)
    assert handwritten.line_scores([], weights).tolist() == [] and handwritten.line_scores(["a"], weights).tolist() == [0.0]


def test_handwritten_openings_are_scored_line_by_line(spark):
    licence = "".join(f"// Permission number {k} is granted to copy, merge and publish this work provided that part {k * 7} of the terms is kept.\n" for k in range(120))
    body = "\n".join(f"const value{x} = compute(other{x});" for x in range(30))
    rows = [(f"// Code generated by weave{k}. DO NOT EDIT.\n//   Manual changes are lost on the next run.\n{body}{k}", f"r{k % 12}/src/app/g{k}.js") for k in range(80)]
    rows += [(f"{licence}// Part {k} of the row reader\n{body}{k}", f"r{k % 12}/src/lib/h{k}.js") for k in range(80)]
    rows += [(f"// Kept apart from the generated part {k} on purpose.\n{body}", f"r{k % 12}/src/lib/k{k}.js") for k in range(20)]
    rows += [(f"{licence}// This code was generated by a mill, please DO NOT EDIT it here\n{body}", "r1/src/lib/late.js")]
    df = docs(spark, rows)
    paths = [df.select(F.col("file_path"), F.col("file_path").alias("judged"))]
    models = handwritten.fit(df, paths)
    found = {r.file_path for r in handwritten.found(df, paths, models).where("reason = 'notice'").collect()}
    assert found == {p for _, p in rows if "/g" in p} | {"r1/src/lib/late.js"}
    assert models[2].report["recall"] == 1.0 and set(models[2].report) == {"rows", "precision", "recall", "found_alone", "labelled_alone"}


def test_handwritten_tables(spark):
    rows = []
    for k in range(240):
        d = ("node_modules/l", "src/app", "vendor/q", "lib/util")[k % 4]
        body = "a=" + ",".join(str(x * k % 9999) for x in range(400)) if k % 6 == 5 else "\n".join(f"const value{x} = compute(other{x}, {k});" for x in range(30))
        rows.append((k, body, f"r{k % 12}/{d}/f{k}.js", f"r{k % 12}", 0))
    rows += [(900, None, "r1/src/app/null.js", "r1", 0), (901, "", ".\\r1\\vendor\\x.js", None, 0), (902, "// @generated\nlet a = 1;", "r2/src/app/g.js", "r2", 0), (903, "x", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file_path string, repo string, label int")
    paths = [df.select(handwritten.clean_path(F.col("file_path")).alias("file_path"), handwritten.clean_path(F.col("file_path")).alias("judged"))]
    found = {r.file_path for r in handwritten.found(df, paths, handwritten.fit(df, paths)).collect()}
    want = {p for k, _, p, _, _ in rows if k < 900 and (k % 4 in (0, 2) or k % 6 == 5)} | {"r1/vendor/x.js", "r2/src/app/g.js"}
    assert len(found ^ want) <= 4, (found ^ want)
    none = df.limit(0)
    empty = [none.select(F.col("file_path"), F.col("file_path").alias("judged"))]
    assert handwritten.found(none, empty, handwritten.fit(none, empty)).count() == 0


def test_tagger_gradient_and_learning():
    t = tagger.Tagger.fresh(5, 3, 1)
    for p in t.params():
        p[...] = p.astype(np.float64)
    ids, gold = tagger.pad([tagger.encode("ab1 c"), tagger.encode("x2")]), tagger.pad([[0, 1, 2, 0, 1], [1, 2]])
    loss, grads = t._loss(ids, gold)
    rng = np.random.default_rng(0)
    for p, g in zip(t.params(), grads):
        d = rng.normal(size=p.shape).astype(np.float32) * (1 if p.ndim < 3 or p.shape[1] != tagger.SYMBOLS else 1)
        if p is t.table:
            d[:, tagger.PAD] = 0
        e = 1e-2
        p += e * d
        up = t._loss(ids, gold)[0]
        p -= 2 * e * d
        down = t._loss(ids, gold)[0]
        p += e * d
        assert abs((up - down) / (2 * e) - float((g * d).sum())) < 0.05 * max(1.0, abs(float((g * d).sum())))
    texts = [f"call {k}{k} or not {k}" for k in range(40)]
    tags = [[1 if c.isdigit() else 0 for c in x] for x in texts]
    t = tagger.Tagger.fresh(8, 3, 2)
    losses = t.train(texts, tags, 25, batch=10, rate=0.03)
    assert losses[-1] < 0.2 * losses[0]
    assert t.decode(tagger.pad([tagger.encode("so 77 x")]))[0].tolist() == [0, 0, 0, 1, 1, 0, 0]


def test_personal_forms():
    text = "Mail a.b+c@x.example or d at ops dot x dot example, git@git.x.example:r.git, p@1.2.3; call +1 (555) 555-0123 or 0044-20-7946-0713, Build 3031-717-7717; SSN 912-34-5678, 12 Old-Mill Lane, Torfgasse 7."
    got = [(text[a:b], k) for a, b, k in personal.known_forms(text)]
    assert got == [("a.b+c@x.example", "email"), ("d at ops dot x dot example", "email"), ("+1 (555) 555-0123", "phone"), ("0044-20-7946-0713", "phone"), ("912-34-5678", "id_number"), ("12 Old-Mill Lane", "street_address"), ("Torfgasse 7", "street_address")]
    long = "x " * 500 + "Reported by Ann Bexley now. " * 30
    spans = personal.windows(long)
    assert spans and all(b - a <= personal.LONGEST for a, b in spans) and spans[-1][1] > len(long) - 40


def test_personal_windows_lie_around_whatever_looks_like_a_mention():
    cases = ["Thanks, Anna Keller for it", "Please Anna Keller do", "2024-05-01 555-123-4567", "see EMP-1234.", "mail a@1host.example now", "7 Merge Ann Bexley", "by Łukasz Żak", "of Ludwig van Beethoven", "Иван Петров"]
    assert all(personal.windows(t) for t in cases)
    assert not personal.windows("plain words, 12 of them and List<String> f(int a) on 2024-05-01") and not personal.windows("")
    word = st.sampled_from(["Thanks,", "Anna", "Keller", "J.", "2024-05-01", "555-123-4567", "(415) 555-0100", "EMP-1234", "12 Old-Mill Lane", "Torfgasse 7", "Am", "a.b@x.example", "a at x dot example", "Merge", "Cross", "+49 30 555123", "AB 12 34 56 C", "Calle de la Luna, 4", "Flat 2,"])

    @given(st.lists(st.tuples(word, st.sampled_from([" ", "\n", ", "])), max_size=12))
    @settings(max_examples=200, deadline=None)
    def held(parts):
        text = "".join(a + b for a, b in parts)
        spans = personal.windows(text)
        kept = [m.span() for f in (*personal.FORMS.values(), personal.NAME) for m in f.finditer(text) if "\n" not in m[0]]
        assert all(any(x < b and a < y for x, y in spans) for a, b in kept)

    held()


def test_personal_texts_are_read_from_end_to_end():
    class Marker:
        """Tags every Q and what follows it up to a Z as a name."""

        def tags(self, texts):
            out = []
            for t in texts:
                row, on = [], False
                for c in t:
                    row.append(9 if c == "Q" else 10 if on else 0)
                    on = c == "Q" or on and c != "Z"
                out.append(row if any(row) else None)
            return out

    text = "  // ask QMARIA ROSSIZ\r\n\n\tor in lower case qx\n" + "x = 1\n" * 40 + "y" * 500 + " QANNA BELLZ " + "z" * 300 + "\u2028QA BZ"
    assert not personal.windows(text)
    known = {}
    got = personal.decode([text, "", "x = 1"], Marker(), known=known)
    assert [text[a:b] for a, b, *_ in got[0]] == ["QMARIA ROSSIZ", "QANNA BELLZ", "QA BZ"] and got[1:] == [[], []]
    assert known["x = 1"] is None and personal.decode([text], Marker(), known=known)[0] == got[0]

    @given(st.text(alphabet="aZ1 .\n\t\r\u2028é", max_size=60), st.integers(1, 9))
    @settings(max_examples=200, deadline=None)
    def covered(part, times):
        text = part * times * 3
        spans = personal.pieces(text)
        inside = {k for a, b in spans for k in range(a, b)}
        assert {k for k, c in enumerate(text) if not c.isspace()} <= inside and all(0 < b - a <= personal.LONGEST for a, b in spans)

    covered()


def test_tagger_reads_as_its_search_does():
    model = tagger.Tagger.fresh(6, 5, 3)
    model.bias[0] = 1.0
    model.trans[:] = np.random.default_rng(5).normal(0, 0.3, model.trans.shape)
    texts = ["", "a", "Anna Keller", "数据 naïve ½ x²\x00", "Ωмега 12", "long " * 20, "Żak 😀\ud800"][1:]
    ids = tagger.encoded(texts)
    assert (ids == tagger.pad([tagger.encode(t) for t in texts])).all()
    slow = model._join(model._forward(ids, False)[0]) @ model.out + model.bias
    live = ids.T != tagger.PAD
    assert np.allclose(model.scores(ids)[live], slow[live], atol=1e-4)
    for bias in (0.0, 1.0, 3.0):
        model.bias[0] = bias
        for t, row, fast in zip(texts, model.decode(ids), model.tags(texts)):
            assert row[: len(t)].tolist() == (fast or [0] * len(t))


def test_tagger_reads_what_texts_share_once(monkeypatch):
    model = tagger.Tagger.fresh(6, 5, 4)
    texts = [f"import org.example.{k};" for k in ("a", "ab", "b", "ab", "x" * 30)] + ["é", "import", "a;"]
    ids = tagger.encoded(texts)
    slow = (model._join(model._forward(ids, False)[0]) @ model.out + model.bias)[ids.T != tagger.PAD]
    for step in (tagger._step(), tagger._numpy_step):
        read = []

        def counted(x, step=step):
            read.append(len(x["ids"]))
            return step(x)

        monkeypatch.setattr(tagger, "_step", lambda counted=counted: counted)
        assert np.allclose(model.scores(ids)[ids.T != tagger.PAD], slow, atol=1e-4)
        assert sum(read) == len({t[:k] for t in texts for k in range(1, len(t) + 1)}) + len({t[k:] for t in texts for k in range(len(t))})
        monkeypatch.setattr(tagger, "TOGETHER", 3)
        assert model.tags(texts) == [model.tags([t])[0] for t in texts] and model.tags([]) == []


def test_personal_spans_are_snapped_to_what_was_decoded():
    def snap(text, said, kind="person_name"):
        a = text.index(said)
        return [text[x:y] for x, y in personal.snap(kind, a, a + len(said), text)]

    for name in ("Emma Cross", "Bryan Ferry", "Fiona O'Brien", "Gino D’Angelo", "Łukasz Żak", "Slavoj Žižek", "Ludwig van Beethoven", "Иван Петров"):
        text = f"As said, reported by {name}'s team (see below)."
        assert snap(text, name) == [name] and any(a <= text.index(name) and text.index(name) + len(name) <= b for a, b in personal.windows(text))
    assert snap("Bitte K. Plevmann fragen", "K. Plevmann") == ["K. Plevmann"] and snap("Kenji H. Feskovic saw", "enji H. Feskovic ") == ["Kenji H. Feskovic"]
    assert snap("cc Linnea Grauvwood, Plevovic, Odile", "Linnea Grauvwood, Plevovic, Odile") == ["Linnea Grauvwood", "Plevovic, Odile"]
    assert snap("cc Morkvik, Edvard, R. Sand", "Morkvik, Edvard, R. Sand") == ["Morkvik, Edvard", "R. Sand"] and snap("cc Plevovic, Odile", "Plevovic, Odile") == ["Plevovic, Odile"]
    assert snap("call `compareDigest`", "compareDigest") == [] and snap("x 12", "12", "phone") == [] and snap("at 1 2", "1 2", "id_number") == []
    assert snap("Tel. +1 (555) 555-0123, ask", "1 (555) 555-01", "phone") == ["+1 (555) 555-0123"] and snap("Tel. 12 34 56 78 90 x", "12 34 56 78 90", "phone") == ["12 34 56 78 90"]


def test_personal_lexicon_and_labels_come_from_where_words_stand():
    texts = [f"{g} {f} saw it. Bitte {g} {f} fragen. We keep the Graph Store. {f}, {g[0]}. did" for g in ("Petra", "Oskar", "Hana", "Emil") for f in ("Zarnwood", "Feskley", "Oxtmann", "Corvane")]
    given_names, family = personal.names_of(texts)
    assert given_names == {"Petra", "Oskar", "Hana", "Emil"} and family == {"Zarnwood", "Feskley", "Oxtmann", "Corvane"}
    text = "Bitte Petra Corvane fragen, cc Feskley, Hana, J. Oxtmann; Graph Store"
    found = personal.label(text, (given_names, family))
    assert [text[a:b] for a, b, _ in found] == ["Petra Corvane", "Feskley, Hana", "J. Oxtmann"]
    other, moved = personal.other_names(text, found, ["Store"], np.random.default_rng(1))
    assert len(moved) == 3 and all("Store" in other[a:b] for a, b, _ in moved) and other.endswith("; Graph Store")
    assert personal.names_of([]) == (set(), set()) and personal.other_names("x", [], ["Store"], np.random.default_rng(1)) == ("x", [])


def test_personal_tables(spark):
    given_names, families = ["Petra", "Oskar", "Hana", "Emil"], ["Zarnwood", "Feskley", "Oxtmann", "Corvane"]
    rows = []
    for k in range(160):
        name = f"{given_names[k % 4] if k % 5 else given_names[k % 4][0] + '.'} {families[k // 4 % 4]}"
        rows.append((k, f"The pass still drops a row here. Reported by {name} (+1 (555) 555-0{100 + k}).\nMail {name[0].lower()}{k}@x.example about it, see Merge Window.", 1))
    rows += [(900, None, 1), (901, "", 1), (902, rows[3][1].replace("\n", "\r\n"), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_char int")
    model = personal.train(personal.sample_windows(df), rounds=20)
    got = {}
    for r in personal.mentions(df, model).collect():
        got.setdefault(r.doc_id, set()).add((r.pii_type, r.start_char))
    right = sum({("person_name", t.index("by ") + 3), ("phone", t.index("+1")), ("email", t.index("Mail ") + 5)} == got.get(k) for k, t, _ in rows if t)
    assert right >= 150
    clean = {r.doc_id: r.text for r in personal.redact(df, model).collect()}
    assert clean[900] is None and clean[901] == "" and sum("[EMAIL]" in (x or "") and "[PHONE]" in x and "[PERSON_NAME]" in x for x in clean.values() if x) >= 150
    assert personal.mentions(df.limit(0), model).count() == 0
