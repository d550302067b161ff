"""Source code text derived from the ``part`` table, and what cleaning must leave of it.

The driver tables hold no source code. Each part becomes one file in one of 15
languages, assembled from pieces whose kind is known. Both engines assemble the
same text; the expected result of a cleaning step is the assembly without the
pieces that step removes, so the SQL never parses anything.

Placeholders: ``{id}`` part key, ``{w}`` part name, ``{b}`` brand.
A removed piece leaves the line end it had.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.spans import quote
from sheaf.sources.tables import spread, to_corpus

CODE, IMPORT, COMMENT, DOC, LOG, ACC = "code", "import", "comment", "doc", "log", "acc"
# a line of which a logging call is a part: (kind, line, trailing comment or "", line without the call)
PART_LOG = "part_log"

# language -> extension and pieces; a piece is (kind, text) or (kind, text, trailing comment)
FILES: list[tuple[str, str, list[tuple]]] = [
    (
        "go",
        "go",
        [
            (CODE, "package p{id}   "),
            (CODE, "\n\n"),
            (IMPORT, 'import (\n\t"fmt"\n\t"log"\n)'),
            (IMPORT, 'import "os"'),
            (DOC, "/// Doc of {w}"),
            (DOC, "// Doc keeps {b}"),
            (COMMENT, '// plain {w} with a " quote and (a bracket'),
            (COMMENT, "/* block {w}\n   log.Print(1)\n*/"),
            (CODE, 'var url = "http://{b}/*x*/"'),
            (CODE, "var raw = `// not {w}\nlog.Print(2)`"),
            (ACC, 'func GetName() string {\n\treturn "{w}"\n}'),
            (ACC, "func setSize(n int) {\n\tif n > 0 {\n\t\tsize = n\n\t}\n}"),
            (CODE, "func (s *S) GetKept() int { return 1 }"),
            (CODE, "func run() {"),
            (LOG, '\tlog.Printf("start {w}; (%d", {id})'),
            (LOG, '\tlogger.Info(\n\t\t"{b}",\n\t\tfunc() int { return 1 }(),\n\t)'),
            (LOG, '\tfmt.Println("x", "// y")'),
            (CODE, "\tcatalog.add({id})"),
            (CODE, "\tcount++", "// up"),
            (CODE, "}"),
        ],
    ),
    (
        "java",
        "java",
        [
            (CODE, "package a.b;"),
            (IMPORT, "import java.util.List;"),
            (DOC, "/**\n * Doc of {w}.\n */"),
            (CODE, "class P{id} {  "),
            (COMMENT, "    // plain {w}'s"),
            (COMMENT, "    /* block { \n   {w} */"),
            (CODE, '    String u = "http://{b}\\"//";', "/* tail */"),
            (CODE, "    char q = '\"';"),
            (ACC, "    @Override\n    public String getName() { return name; }"),
            (ACC, "    public boolean isOpen()\n    {\n        return open;\n    }"),
            (ACC, "    public void setName(String name) {\n        this.name = name;\n    }"),
            (CODE, "    abstract int getKept();"),
            (CODE, "    void run(int n) {\n"),
            (LOG, '        log.info("a; (" + n);'),
            (LOG, '        System.out.println(\n            "{w}",\n            f(n, () -> { return 1; })\n        );'),
            (CODE, "        catalog.put(n);"),
            (CODE, "        return getName();"),
            (CODE, "    }\n}"),
        ],
    ),
    (
        "python",
        "py",
        [
            (IMPORT, "import os"),
            (IMPORT, "from a.b import (\n    c,\n    d,\n)"),
            (COMMENT, "# plain {w}'s ("),
            (CODE, "class P{id}:"),
            (CODE, '    """Doc of {w}\n    # kept, print(1)\n    """\n'),
            (ACC, "    @property\n    def name(self):\n        return self._name"),
            (ACC, "    def get_size(self, a,\n                 b):\n        if a:\n            return 1\n\n        return b"),
            (ACC, "    def set_size(self, n):\n        self.n = n"),
            (CODE, "    @cached"),
            (CODE, "    def getting(self):"),
            (CODE, "        u = '#{b}'", "# tail"),
            (LOG, "        print('a; (', {id})"),
            (LOG, '        logger.info(\n            "{w}",\n            [1, 2],\n        )'),
            (COMMENT, "        # indented"),
            (CODE, "        printer.run(1)   "),
            (CODE, "        return u"),
        ],
    ),
    (
        "javascript",
        "js",
        [
            (IMPORT, "import { a,\n  b } from './{id}.js';"),
            (DOC, "/** Doc of {w} */"),
            (COMMENT, "// plain {w}'s"),
            (COMMENT, "/* block\n {w} */"),
            (CODE, "class P{id} {"),
            (ACC, "  get name() {\n    return this._n;\n  }"),
            (ACC, "  set name(v) { this._n = v; }"),
            (CODE, "  getKept() { return 1; }\n\n"),
            (CODE, "  run(s) {"),
            (LOG, "    console.log(`a ${s ? `// b` : '('}`);"),
            (LOG, "    console.error('{w}', {\n      a: 1,\n    });"),
            (CODE, "    const r = s.replace(/\"\\/\\/[/\"]/g, '//{b}');", "// tail"),
            (CODE, "    return r;\t"),
            (CODE, "  }\n}"),
        ],
    ),
    (
        "typescript",
        "ts",
        [
            (IMPORT, "import a from 'a{id}';"),
            (DOC, "/** Doc of {w} */"),
            (COMMENT, "// plain {w}"),
            (CODE, "export class P{id} {"),
            (ACC, "  get name(): string {\n    return this._n;\n  }"),
            (CODE, "  run(): void {"),
            (LOG, "    logger.debug('{b}');"),
            (CODE, "    this.n = 'http://{w}';", "/* tail */"),
            (CODE, "  }\n}"),
        ],
    ),
    (
        "html",
        "html",
        [
            (CODE, "<html>"),
            (IMPORT, '  <link rel="stylesheet" href="{id}.css">'),
            (IMPORT, "  <script>var a = '<!-- {w} -->';</script>"),
            (DOC, "  <!-- plain {w}\n  two -->"),
            (CODE, "  <p>{w}</p>", "<!-- tail -->"),
            (CODE, "</html>"),
        ],
    ),
    (
        "css",
        "css",
        [
            (IMPORT, "@import 'a{id}.css';"),
            (DOC, "/* plain {w} */"),
            (CODE, 'p { content: "/* {b} */"; }   '),
        ],
    ),
    (
        "cpp",
        "cpp",
        [
            (IMPORT, "#include <vector>"),
            (IMPORT, "using namespace std;"),
            (DOC, "/// Doc of {w}"),
            (COMMENT, "// plain {w}'s"),
            (COMMENT, "/** not a doc here\n */"),
            (ACC, "std::string P::getName() const {\n    return name;\n}"),
            (ACC, "bool isOpen() const\n{\n    return open;\n}"),
            (ACC, "void setName(std::string value) {\n    name = value;\n}"),
            (CODE, "int getValue(int index) { return v[index]; }"),
            (CODE, "void run() {"),
            (LOG, '    std::cout << "a; (" \n        << {id} << std::endl;'),
            (LOG, '    fprintf(stderr, "{w}");'),
            (CODE, '    auto r = R"(// {w} ")";', "// tail"),
            (CODE, "    long n = 1'000'000;"),
            (CODE, "}"),
        ],
    ),
    (
        "csharp",
        "cs",
        [
            (IMPORT, "using System;"),
            (DOC, "/// <summary>{w}</summary>"),
            (CODE, "public class P{id}\n{"),
            (COMMENT, "    // plain {w}"),
            (ACC, "    public int Size { get; set; }"),
            (ACC, "    public string Name\n    {\n        get { return name; }\n        set { name = value; }\n    }"),
            (ACC, "    [Pure]\n    public int GetSize()\n    {\n        return size;\n    }"),
            (ACC, "    public void SetSize(int n) { size = n; }"),
            (CODE, "    private int kept;"),
            (CODE, "    public void Run()\n    {"),
            (LOG, '        Console.WriteLine("a; (");'),
            (LOG, '        Debug.Log(\n            "{w}");'),
            (CODE, '        var p = @"c:\\{b}\\";', "// tail"),
            (CODE, "        var x = my.Property.ToString();\n    }\n}"),
        ],
    ),
    (
        "php",
        "php",
        [
            (CODE, "<h1># {w} // kept</h1>"),
            (CODE, "<?php"),
            (IMPORT, "use A\\B;"),
            (IMPORT, "require_once 'a{id}.php';"),
            (DOC, "/** Doc of {w} */"),
            (COMMENT, "# plain {w}"),
            (COMMENT, "// other"),
            (CODE, "class P{id} {"),
            (ACC, "    public function getName() {\n        return $this->name;\n    }"),
            (ACC, "    public function setName($n)\n    {\n        $this->name = $n;\n    }"),
            (CODE, "    function run() {"),
            (LOG, "        error_log('a; (');"),
            (LOG, "        var_dump(\n            $x\n        );"),
            (CODE, "        $u = \"http://{b}\";", "// tail"),
            (CODE, "        $h = <<<EOT\n# kept {w}\nEOT;"),
            (CODE, "    }\n}\n?>\n# html {w}"),
        ],
    ),
    (
        "ruby",
        "rb",
        [
            (IMPORT, "require 'a{id}'"),
            (DOC, "# kept {w}"),
            (COMMENT, "=begin\nplain {w}\n=end"),
            (CODE, "class P{id}"),
            (ACC, "  attr_reader :name,\n              :size"),
            (ACC, "  def get_name\n    if @a\n      1\n    end\n  end"),
            (ACC, "  def set_name(n); @n = n; end"),
            (CODE, "  def run\n    items.each do |i|"),
            (LOG, '      puts "a; ({w} #{i}"'),
            (LOG, '      Rails.logger.info("x",\n                        1)'),
            (CODE, "      p = '#{b}'"),
            (CODE, "    end\n  end\nend"),
        ],
    ),
    (
        "bash",
        "sh",
        [
            (DOC, "#!/bin/bash"),
            (IMPORT, "source ./a{id}.sh"),
            (DOC, "# kept {w}"),
            (CODE, "x=${#name}"),
            (LOG, 'echo "Debug: {w} $x"'),
            (LOG, 'echo "failed {b}" >&2'),
            (LOG, "logger -t app done"),
            (CODE, 'echo "{w}"   '),
            (CODE, "echo a > out.txt"),
        ],
    ),
    (
        "swift",
        "swift",
        [
            (IMPORT, "import Foundation"),
            (DOC, "/// Doc of {w}"),
            (COMMENT, "/* outer /* inner {w} */ still */"),
            (COMMENT, "// plain {w}"),
            (CODE, "class P{id} {"),
            (ACC, "    var name: String {\n        get { return n }\n        set { n = newValue }\n    }"),
            (ACC, "    func getSize() -> Int {\n        return size\n    }"),
            (ACC, "    func setSize(_ n: Int) {\n        size = n\n    }"),
            (CODE, "    var kept: Int { size * 2 }"),
            (CODE, "    func run() {"),
            (LOG, '        print("a ( \\(x ?? "// b")")'),
            (LOG, '        NSLog(\n            "{w}"\n        )'),
            (CODE, '        let u = "http://{b}"', "// tail"),
            (CODE, "    }\n}"),
        ],
    ),
    (
        "kotlin",
        "kt",
        [
            (IMPORT, "import a.b.C"),
            (DOC, "/** Doc of {w} */"),
            (COMMENT, "// plain {w}'s"),
            (CODE, "class P{id} {"),
            (ACC, "    var name: String\n        get() = field\n        set(value) {\n            field = value\n        }"),
            (CODE, "    val plain: Int = 2"),
            (ACC, "    fun getSize(): Int = size"),
            (ACC, "    fun setSize(n: Int) {\n        size = n\n    }"),
            (CODE, "    val kept: Int = 1"),
            (CODE, "    fun run() {"),
            (LOG, '        println("a ( ${if (x) "// b" else "{w}"}")'),
            (LOG, '        logger.info(\n            "{b}"\n        )'),
            (CODE, '        val u = """http://{b}\n// kept"""'),
            (CODE, "        get(0)", "// tail"),
            (CODE, "    }\n}"),
        ],
    ),
    (
        "sql",
        "sql",
        [
            (IMPORT, "CREATE EXTENSION hstore;"),
            (DOC, "-- kept {w}"),
            (COMMENT, "/* plain {w}\n*/"),
            (CODE, "select '/* {b} */', 'it''s', x  ", "/* tail */"),
            (CODE, "from t where a = 'p{id}';"),
        ],
    ),
]

_DEEP = "(" * 70 + "{id}" + ")" * 70

# pieces that every second file of a language has besides
MORE: dict[str, list[tuple]] = {
    "go": [
        (PART_LOG, 'func note() { log.Println("{w}; }") }', "", "func note() {  }"),
        (PART_LOG, "if n > {id} { a(); logger.Info(n); b() }", "", "if n > {id} { a(); b() }"),
        (LOG, f"log.Print{_DEEP}"),
        (CODE, f"keep{_DEEP}"),
    ],
    "java": [
        (PART_LOG, 'class L{id} { void f(int x) { if (x > 1) log.info("{w})"); g(); } }', "", "class L{id} { void f(int x) { if (x > 1) ; g(); } }"),
        (PART_LOG, "class M{id} { void f() { a(); System.out.println({id}); b(); } }", "", "class M{id} { void f() { a(); b(); } }"),
        (LOG, f"log.info{_DEEP};"),
        (CODE, "class N{id} {"),
        (ACC, "\n".join(f"  @Note{i}" for i in range(70)) + "\n  public int getNote() {\n    return {id};\n  }"),
        (CODE, "}"),
    ],
    "python": [
        (PART_LOG, 'x = {id}; print("{w}; (")', "", "x = {id}; "),
        (PART_LOG, "if x: print(x)", "# {w}", "if x: pass"),
        (PART_LOG, "while x[1:2]: logger.info(x, {1: 2})", "", "while x[1:2]: pass"),
        (LOG, f"print{_DEEP}"),
        (ACC, "\n".join(f"@note{i}({i})" for i in range(70)) + "\n@property\ndef noted(self):\n    return {id}"),
    ],
    "javascript": [
        (PART_LOG, 'try { a() } catch (e) { console.error(e, "{w}}") }', "", "try { a() } catch (e) {  }"),
        (PART_LOG, "a(); console.log(`${id}`, {w: [1, 2]}); b()", "", "a(); b()"),
        (PART_LOG, "if (a && " + "b && " * 500 + "c) console.log({id});", "", "if (a && " + "b && " * 500 + "c) ;"),
        (LOG, f"console.log{_DEEP};"),
    ],
    "typescript": [
        (PART_LOG, 'if (a) { console.log("{w}") } else { logger.warn({id}) }', "", "if (a) {  } else {  }"),
        (CODE, 'const kept = () => console.log("{b}");'),
    ],
    "cpp": [
        (PART_LOG, 'int f{id}() { printf("{w};"); return {id}; }', "", "int f{id}() { return {id}; }"),
        (PART_LOG, "for (int i = 0; i < {id}; i++) printf(i);", "", "for (int i = 0; i < {id}; i++) ;"),
    ],
    "csharp": [(PART_LOG, 'class L{id} { void F() { Console.WriteLine("{w}}"); G(); } }', "", "class L{id} { void F() { G(); } }")],
    "swift": [
        (PART_LOG, 'func note() { print("{w}}"); g() }', "", "func note() { g() }"),
        (ACC, " ".join(f"@note{i}" for i in range(18)) + " func getNote() -> Int {\n  return {id}\n}"),
    ],
    "kotlin": [
        (PART_LOG, 'fun note() { println("{w}}"); g() }', "", "fun note() { g() }"),
        (PART_LOG, "while (x) println({id})", "", "while (x) ;"),
        (CODE, 'if (x) println("{b}") else y()'),
    ],
}

# every 53rd file gets a bracket without a partner and must come through unchanged
BROKEN_EVERY = 53
# in these the added line is not code, or brackets are not paired
NOT_PARSED = ("html", "bash", "php")
PLACE = re.compile(r"(\{id\}|\{w\}|\{b\})")


def pieces_of(variant: int) -> tuple[str, str, list[tuple]]:
    """Language, extension and pieces of the files whose part key leaves ``variant`` when divided by ``VARIANTS``."""
    language, ext, pieces = FILES[variant % len(FILES)]
    return language, ext, pieces + (MORE.get(language, []) if variant >= len(FILES) else [])


VARIANTS = 2 * len(FILES)


def piece_text(piece: tuple) -> str:
    return piece[1] + (" " + piece[2] if len(piece) > 2 and piece[2] else "") + "\n"


def kept_text(language: str, piece: tuple, remove: set[str], docs_are_comments: bool) -> str:
    """A piece after the given kinds are removed; its line end stays."""
    kind, text = piece[0], piece[1]
    if kind == PART_LOG:
        text = piece[3] if LOG in remove else text
        return kept_text(language, (CODE, text, *[c for c in piece[2:3] if c]), remove, docs_are_comments)
    gone = kind in remove or (kind == DOC and COMMENT in remove and docs_are_comments)
    if gone:
        return "\n"
    if len(piece) > 2:
        # these languages document with every comment, so a trailing one is kept too
        trailing_doc = language == "html" and not docs_are_comments
        return text + " " + ("" if COMMENT in remove and not trailing_doc else piece[2]) + "\n"
    return text + "\n"


def _assemble(template: str, text_type: str, quote: Callable[[str], str]) -> str:
    values = {"{id}": f"CAST(p_partkey AS {text_type})", "{w}": "p_name", "{b}": "p_brand"}
    parts = [values.get(p) or quote(p) for p in PLACE.split(template) if p]
    return "(" + " || ".join(parts or ["''"]) + ")"


def _sql(template: str) -> str:
    return _assemble(template, "VARCHAR", lambda p: "'" + p.replace("'", "''") + "'")


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus columns plus ``file_id``."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")
    part = spread(part, "p_partkey")
    texts, suffixes = [], []
    for i in range(VARIANTS):
        language, ext, pieces = pieces_of(i)
        body = _assemble("".join(piece_text(p) for p in pieces), "STRING", quote)
        if language not in NOT_PARSED:
            body += f" || IF(p_partkey % {BROKEN_EVERY} = 0, 'broken(\\n', '')"
        texts.append(f"WHEN {i} THEN {body}")
        suffixes.append(f"WHEN {i} THEN '{ext}'")
    case = f"CASE p_partkey % {VARIANTS} "
    content, suffix = (F.expr(case + " ".join(arms) + " END") for arms in (texts, suffixes))
    path = F.concat(
        F.lit("src/"), F.col("p_brand"), F.lit("/P"), F.col("p_partkey").cast("string"), F.lit("."), suffix
    )
    return to_corpus(part.withColumn("file_id", F.col("p_partkey")), path, content, keep=["file_id"])


def code_sql(remove: set[str] = frozenset(), docs_are_comments: bool = False) -> str:
    """SQL of the same files with the pieces of the given kinds removed."""
    text, ext, lang = ([f"CASE p_partkey % {VARIANTS}"] for _ in range(3))
    ok = []
    for i in range(VARIANTS):
        language, suffix, pieces = pieces_of(i)
        whole = _sql("".join(piece_text(p) for p in pieces))
        left = _sql("".join(kept_text(language, p, set(remove), docs_are_comments) for p in pieces))
        if language in NOT_PARSED:
            text.append(f"WHEN {i} THEN {left}")
            ok.append(str(i))
        else:
            text.append(
                f"WHEN {i} THEN CASE WHEN p_partkey % {BROKEN_EVERY} = 0 THEN {whole} || 'broken(\n' ELSE {left} END"
            )
        ext.append(f"WHEN {i} THEN '{suffix}'")
        lang.append(f"WHEN {i} THEN '{language}'")
    fine = f"(p_partkey % {BROKEN_EVERY} <> 0 OR p_partkey % {VARIANTS} IN ({', '.join(ok)}))"
    return (
        "SELECT p_partkey AS file_id, 'src/' || p_brand || '/P' || CAST(p_partkey AS VARCHAR) || '.' || "
        + " ".join(ext)
        + " END AS path, "
        + " ".join(lang)
        + " END AS language, "
        + " ".join(text)
        + f" END AS content, {fine} AS fine FROM part"
    )
