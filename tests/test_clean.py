import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators.clean import clean
from sheaf.operators.comments import remove_comments
from sheaf.operators.whitespace import collapse_blank_lines, drop_blank_lines, trim_lines
from sheaf.options import CleanOptions

OFF = dict(
    remove_comments=False,
    preserve_doc_comments=False,
    remove_logging=False,
    remove_accessors=False,
    optimize_whitespace=False,
    remove_empty_lines=False,
)


def opts(**on):
    return CleanOptions(**{**OFF, **on})


@pytest.fixture
def clean_all(spark):
    """Clean (language, text) pairs in one job."""

    def run(pairs, options):
        rows = [(i, lang, text) for i, (lang, text) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "i int, language string, content string")
        out = clean(df, options).orderBy("i").collect()
        return [(r.content, r.clean_status) for r in out]

    return run


def test_goldens(clean_all):
    # fixed values: inputs and results that have to come out like this
    pairs = [
        ("go", "package main\n// This is a comment\nfunc main() {}\n/* Block comment */\n"),
        ("go", "package main\n\n\nfunc main() {\n\n\n}\n\n"),
    ]
    options = opts(remove_comments=True, optimize_whitespace=True, remove_empty_lines=True)
    assert clean_all(pairs, options) == [
        ("package main\nfunc main() {}\n", "cleaned"),
        ("package main\nfunc main() {\n}\n", "cleaned"),
    ]


def test_doc_comments_stay(clean_all):
    pairs = [("go", "package main\n// Regular comment\n/// Doc comment\n// Doc word\nfunc main() {}\n")]
    [(text, _)] = clean_all(pairs, opts(remove_comments=True, preserve_doc_comments=True))
    assert text == "package main\n\n/// Doc comment\n// Doc word\nfunc main() {}\n"


def test_java_logging_and_getters(clean_all):
    body = 'class Cart {\nint sum(int a) {\nlog.warn("low");\nSystem.err.println(a);\nreturn a;\n}\n}'
    [(text, _)] = clean_all([("java", body)], opts(remove_logging=True))
    assert text == "class Cart {\nint sum(int a) {\n\n\nreturn a;\n}\n}"
    body = "class Cart {\n    private int getTotal() { return total; }\n    void add(int x) {}\n}"
    [(text, _)] = clean_all([("java", body)], opts(remove_accessors=True))
    assert text == "class Cart {\n\n    void add(int x) {}\n}"


def test_a_removed_body_leaves_an_empty_statement(clean_all):
    pairs = [
        ("javascript", "for (const a of x)\n  console.log(a);\nsave(x);\n"),
        ("cpp", 'while (x--)\n  printf("a");\ndone();\n'),
        ("java", "if (x > 1)\n  log.info(1,\n    2);\nelse\n  foo();\n"),
        ("java", "if (x) foo();\nelse\n  log.info(1);\nbar();\n"),
        ("javascript", "foo()\nconsole.log(1)\nbar()\n"),
    ]
    assert [t for t, _ in clean_all(pairs, opts(remove_logging=True))] == [
        "for (const a of x)\n  ;\nsave(x);\n",
        "while (x--)\n  ;\ndone();\n",
        "if (x > 1)\n  ;\nelse\n  foo();\n",
        "if (x) foo();\nelse\n  ;\nbar();\n",
        "foo()\n\nbar()\n",
    ]


def test_receivers_nested_comments_and_literals_without_small_limits(clean_all):
    nested = "/* " * 20 + "x" + " */" * 20
    pairs = [
        ("go", ".".join(f"a{i}" for i in range(300)) + ".log.Println(1)\nx()\n"),
        ("swift", nested + "\nlet a = 1\n"),
        ("kotlin", "/* " * 40 + " */" * 40 + "\nval a = 1\n"),
        ("javascript", 'function f(s) {\n  return /["]/.test("a//b"); // c\n}\n'),
        ("ruby", "x = %w[#x y]\nputs 1\n"),
    ]
    got = clean_all(pairs, opts(remove_logging=True, remove_comments=True))
    assert got[0] == ("\nx()\n", "cleaned")
    assert got[1] == ("\nlet a = 1\n", "cleaned")
    assert got[2] == (pairs[2][1], "failed")
    assert got[3] == ('function f(s) {\n  return /["]/.test("a//b"); \n}\n', "cleaned")
    assert got[4] == ("x = %w[#x y]\n\n", "cleaned")


@pytest.mark.parametrize("depth", [70, 5000])
def test_brackets_of_any_depth(clean_all, depth):
    deep = "(" * depth + "1" + ")" * depth
    mixed = "([{" * (depth // 3) + "}])" * (depth // 3)
    pairs = [
        ("java", f"void f() {{\n  log.info{deep};\n  g();\n}}\n"),
        ("javascript", f"console.log({mixed})\nx()\n"),
        ("python", f"print({deep})\nx()\n"),
        ("python", f"def get_x(self, a={deep}):\n    return 1\ny = 2\n"),
        ("java", "{\n" * depth + "log.info(1);\n" + "}\n" * depth),
        ("java", f"void setX(int x) {{\n  a{deep};\n}}\nint y;\n"),
        ("ruby", f"logger.info({deep})\nx\n"),
    ]
    got = clean_all(pairs, opts(remove_logging=True, remove_accessors=True))
    assert {status for _, status in got} == {"cleaned"}
    texts = [t for t, _ in got]
    assert texts[:4] == ["void f() {\n\n  g();\n}\n", "\nx()\n", "\nx()\n", "\ny = 2\n"]
    assert texts[4] == "{\n" * depth + "\n" + "}\n" * depth
    assert texts[5:] == ["\nint y;\n", "\nx\n"]


def test_brackets_must_pair_kind_by_kind(clean_all):
    bad = ["a)(b;", "(]", "x[)](;", "}{", "((a)", "(" * 200 + "]" * 200, "([" * 90 + ")]" * 90, ")" + "()" * 300 + "("]
    good = ["", "()", "([{}])[]" * 50, "(" * 300 + "[]" * 9 + ")" * 300, "{}" * 999]
    got = clean_all([("java", f"x {b}\n") for b in bad + good], opts())
    assert [s for _, s in got] == ["failed"] * len(bad) + ["cleaned"] * len(good)


def _pairs_up(text):
    stack = []
    for c in text:
        if c in "([{":
            stack.append(")]}"["([{".index(c)])
        elif not stack or stack.pop() != c:
            return False
    return not stack


def test_pairing_against_a_stack(clean_all):
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        kinds = rng.choice(["()", "()[]{}"])
        text = "".join(rng.choice(kinds) for _ in range(rng.randrange(1, 9)))
        if rng.random() < 0.7:  # grow pairs around and beside
            text = ""
            for _ in range(rng.randrange(1, 60)):
                o = rng.randrange(3)
                text = rng.choice([f"{'([{'[o]}{text}{')]}'[o]}", text + "([{"[o] + ")]}"[o]])
            if rng.random() < 0.4:
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice("()[]{}") + text[at + 1 :]
        texts.append(text)
    got = clean_all([("go", f"x{t}\n") for t in texts], opts())
    assert [s == "cleaned" for _, s in got] == [_pairs_up(t) for t in texts]


def test_any_number_of_lines_above_an_accessor(clean_all):
    decorators = "".join(f"@d{i}\n" for i in range(70))
    notes = "".join(f"  @N{i}\n" for i in range(70))
    attributes = " ".join(f"@a{i}" for i in range(18))
    pairs = [
        ("python", decorators + "@property\ndef x(self):\n    return 1\ny = 2\n"),
        ("python", decorators + "def get_x(self):\n    return 1\ny = 2\n"),
        ("python", decorators + "def run(self):\n    return 1\n"),
        ("java", f"class A {{\n{notes}  public int getX() {{\n    return x;\n  }}\n}}\n"),
        ("java", f"class A {{\n{notes}  public void run() {{\n    x();\n  }}\n}}\n"),
        ("swift", f"{attributes} func getX() -> Int {{\n  return x\n}}\nlet y = 1\n"),
    ]
    got = clean_all(pairs, opts(remove_accessors=True))
    assert {status for _, status in got} == {"cleaned"}
    texts = [t for t, _ in got]
    assert texts[0] == texts[1] == "\ny = 2\n" and texts[2] == pairs[2][1]
    assert texts[3] == "class A {\n\n}\n" and texts[4] == pairs[4][1] and texts[5] == "\nlet y = 1\n"


def test_headers_of_any_length_and_indentation(clean_all):
    pairs = [
        ("javascript", "if (" + "a && " * 600 + "b)\n  console.log(1)\nsave()\n"),
        ("kotlin", " " * 210 + "while (x)" + " " * 90 + "\n" + " " * 214 + "println(1)\nsave()\n"),
        ("java", "if (x)" + "\t" * 99 + "\n  log.info(1);\nsave();\n"),
        ("javascript", "else" + " " * 99 + "\n  console.log(1)\nsave()\n"),
    ]
    for text, status in clean_all(pairs, opts(remove_logging=True)):
        assert status == "cleaned" and text.split("\n")[1].strip() == ";" and "save" in text.split("\n")[2]


# language, text, what is left of it
INSIDE_LINES = [
    ("go", 'func main() { log.Println("test") }\n', "func main() {  }\n"),
    ("go", "func f() {\n\tx()\n\tlog.Println(1); y()\n}\n", "func f() {\n\tx()\n\ty()\n}\n"),
    ("go", "for i := 0; i < 3; log.Println(i) { a() }\n", None),
    ("javascript", "try { x() } catch (e) { console.error(e); }\n", "try { x() } catch (e) { }\n"),
    ("javascript", "a(); console.log(`y${1}`, {a: [1, 2]}); b();\n", "a(); b();\n"),
    ("javascript", "x.forEach(e => { console.log(\n  e,\n  1); });\n", "x.forEach(e => { });\n"),
    ("javascript", 'const s = "{ console.log(1) }"; f();\n', None),
    ("javascript", "const f = () => console.log(1);\n", None),
    ("javascript", "if (x)\n  console.log(1); foo()\n", None),
    ("java", 'if (x) log.info("a");\nb();\n', "if (x) ;\nb();\n"),
    ("java", "if (a) b(); else log.info(1); c();\n", "if (a) b(); else ; c();\n"),
    ("java", "for (int i = 0; log.isOn(); i++) log.x(i);\n", "for (int i = 0; log.isOn(); i++) ;\n"),
    ("java", 'void f() { log.info("a;}{"); /* ; log.x( */ g(); }\n', "void f() { /* ; log.x( */ g(); }\n"),
    ("java", "{" * 80 + " log.info(1); " + "}" * 80, "{" * 80 + " " + "}" * 80),
    ("java", "catalog.x(); mylog.info(1);\n", None),
    ("python", "x = 1; print(x)\n", "x = 1; \n"),
    ("python", "if x[1:2]: print(x)\ny\n", "if x[1:2]: pass\ny\n"),
    ("python", "d = {1: print(x)}\n", None),
    ("kotlin", 'if (x) println("a") else y()\n', None),
    ("kotlin", 'fun f() { println("a"); g() }\n', "fun f() { g() }\n"),
    ("swift", 'func f() { print("a"); g(); }\n', "func f() { g(); }\n"),
    ("cpp", 'int main() { printf("x"); return 0; }\n', "int main() { return 0; }\n"),
    ("csharp", 'void F() { Console.WriteLine("x"); G(); }\n', "void F() { G(); }\n"),
    ("php", '<?php function f() { error_log("x"); g(); }\n', "<?php function f() { g(); }\n"),
]


def test_calls_inside_a_line(clean_all):
    got = clean_all([(lang, text) for lang, text, _ in INSIDE_LINES], opts(remove_logging=True))
    assert got == [(text if left is None else left, "cleaned") for _, text, left in INSIDE_LINES]


def test_unparsable_texts_are_left_alone(clean_all):
    pairs = [("go", "package main\nfunc main() {"), ("go", ""), (None, "a // b"), ("java", "x(\ue003); // c")]
    got = clean_all(pairs, CleanOptions())
    assert [s for _, s in got] == ["failed", "failed", "unchanged", "failed"]
    assert [t for t, _ in got] == [t for _, t in pairs]


# language, statement, is it logging
LOGGING = [
    ("go", 'log.Println("x")', True),
    ("go", 'logger.Info("x")', True),
    ("go", 's.logger.Warn("x")', True),
    ("go", 'fmt.Printf("x")', True),
    ("go", 'Debug("x")', True),
    ("go", "catalog.Add(1)", False),
    ("go", "process(1)", False),
    ("java", 'Logger.getLogger("a").info("x");', True),
    ("java", 'System.err.println("x");', True),
    ("java", 'logger.debug("x");', True),
    ("java", 'service.run("x");', False),
    ("java", "catalog.put(1);", False),
    ("python", "print('Debug message')", True),
    ("python", "print(f'Value is {value}')", True),
    ("python", "logging.info('x')", True),
    ("python", "logger.debug('x')", True),
    ("python", "process_data('input')", False),
    ("python", "obj.process()", False),
    ("python", "printer.execute('message')", False),
    ("javascript", "console.log('x');", True),
    ("javascript", "logger.info('x')", True),
    ("javascript", "myconsole.log('x')", False),
    ("typescript", "console.warn('x');", True),
    ("cpp", 'cout << "Log message" << endl;', True),
    ("cpp", 'std::cerr << "x";', True),
    ("cpp", 'printf("Debug: %s\\n", message);', True),
    ("cpp", 'fprintf(stderr, "x");', True),
    ("cpp", 'log("Message");', True),
    ("cpp", 'process("data");', False),
    ("csharp", 'Console.WriteLine("test");', True),
    ("csharp", 'Debug.Log("test");', True),
    ("csharp", 'Trace.WriteLine("test");', True),
    ("csharp", 'MyMethod("test");', False),
    ("csharp", "var x = myObject.Property.ToString();", False),
    ("php", "error_log('x');", True),
    ("php", "print_r($x);", True),
    ("php", "var_dump($x);", True),
    ("php", "echo 'x';", False),
    ("ruby", 'puts "x"', True),
    ("ruby", "p value", True),
    ("ruby", "logger.info('x')", True),
    ("ruby", "p = 1", False),
    ("ruby", "outputs('test')", False),
    ("bash", 'echo "Debug: x"', True),
    ("bash", 'printf "Debug: %s" x', True),
    ("bash", "logger x", True),
    ("bash", 'echo "failed" >&2', True),
    ("bash", 'echo "hello"', False),
    ("bash", "echo a > out.txt", False),
    ("swift", 'print("x")', True),
    ("swift", 'debugPrint("x")', True),
    ("swift", 'NSLog("x")', True),
    ("swift", 'logger.debug("x")', True),
    ("swift", 'process("x")', False),
    ("kotlin", 'println("x")', True),
    ("kotlin", 'Logger.d("x")', True),
    ("kotlin", "process(1)", False),
    ("sql", "select 1;", False),
    ("css", "p { a: b; }", False),
]


def test_logging_rules(clean_all):
    # a statement between two others, in the form each language needs
    pairs = [(lang, f"a1()\n{text}\nb1()\n") for lang, text, _ in LOGGING]
    pairs = [(lang, t.replace("1()", "1();") if lang in ("java", "cpp", "csharp", "php") else t) for lang, t in pairs]
    got = clean_all(pairs, opts(remove_logging=True))
    for (lang, text, gone), (_, before), (after, status) in zip(LOGGING, pairs, got):
        assert status == "cleaned"
        assert after == (before.replace(text, "") if gone else before), (lang, text)


# language, declaration, is it an accessor
ACCESSORS = [
    ("go", 'func GetName() string {\n\treturn "x"\n}', True),
    ("go", "func setName(n string) {\n\tname = n\n}", True),
    ("go", "func (s *S) GetName() string {\n\treturn s.n\n}", False),
    ("go", "func process() {\n}", False),
    ("java", "public String getName() {\n    return name;\n}", True),
    ("java", "@Override\npublic boolean isValid() { return valid; }", True),
    ("java", "private static List<Map<String, Integer>> getAll(int a,\n    int b) throws IOException\n{\n    return all;\n}", True),
    ("java", "public void setName(String n) {\n    this.n = n;\n}", True),
    ("java", "public void process() {\n    run();\n}", False),
    ("java", "abstract String getName();", False),
    ("python", "@property\ndef name(self):\n    return self._name", True),
    ("python", '@property\ndef name(self):\n    """Get the name value."""\n    return self._name', True),
    ("python", "def get_name(self):\n    return self._name", True),
    ("python", "def set_value(self, value):\n    if value < 0:\n        raise ValueError('x')\n    self._value = value", True),
    ("python", "@deprecated('x',\n  1)\ndef get_old(self):\n    return 1", True),
    ("python", "async def get_item(self, index):\n    return self.items[index]", True),
    ("python", "def getting_started():\n    pass", False),
    ("python", "def process_data(self):\n    return self.data.process()", False),
    ("javascript", "get name() {\n  return this._n;\n}", True),
    ("javascript", "set name(v) { this._n = v; }", True),
    ("javascript", "getName() { return 1; }", False),
    ("typescript", "get name(): string { return this._n; }", True),
    ("cpp", "string getName() const {\n    return name;\n}", True),
    ("cpp", "void setName(string value) {\n    name = value;\n}", True),
    ("cpp", "bool isValid() const {\n    return valid;\n}", True),
    ("cpp", "void process() {\n    doWork();\n}", False),
    ("cpp", "int getValue(int index) {\n    return values[index];\n}", False),
    ("csharp", "public int MyProperty { get; set; }", True),
    ("csharp", "public int MyProperty { get; }", True),
    ("csharp", "public int MyProperty { set { value = value; } }", True),
    ("csharp", "public List<int> Items { get; } = new();", True),
    ("csharp", "public int GetValue() { return value; }", True),
    ("csharp", "public void SetValue(int v) { value = v; }", True),
    ("csharp", "public void Process() { Run(); }", False),
    ("csharp", "public int x;", False),
    ("csharp", "public class Foo\n{\n    int y;\n}", False),
    ("php", "public function getName() {\n    return 1;\n}", True),
    ("php", "private function getName() {\n    return 1;\n}", False),
    ("ruby", "attr_accessor :name", True),
    ("ruby", "def get_name\n  @name\nend", True),
    ("ruby", "def set_name(n)\n  if n\n    @name = n\n  end\nend", True),
    ("ruby", "def process\n  items.each do |i|\n    i\n  end\nend", False),
    ("swift", "var name: String {\n    get { return _name }\n    set { _name = newValue }\n}", True),
    ("swift", "func getName() -> String {\n    return name\n}", True),
    ("swift", "func process() {\n    doWork()\n}", False),
    ("swift", "var area: Int {\n    w * h\n}", False),
    ("kotlin", 'var name: String\n    get() = "x"', True),
    ("kotlin", "var name: String\n    get() = field\n    set(value) {\n        field = value\n    }", True),
    ("kotlin", "@JsonProperty\nvar name: String\n    get() = field", True),
    ("kotlin", "fun getName(): String {\n    return name\n}", True),
    ("kotlin", "fun setName(value: String) {\n    name = value\n}", True),
    ("kotlin", "fun process() {\n    run()\n}", False),
    ("kotlin", "val a = map\nget(0)", False),
]


def test_accessor_rules(clean_all):
    pairs = [(lang, f"\n{text}\n") for lang, text, _ in ACCESSORS]
    got = clean_all(pairs, opts(remove_accessors=True))
    for (lang, text, gone), (after, status) in zip(ACCESSORS, got):
        assert status == "cleaned"
        assert after == ("\n\n" if gone else f"\n{text}\n"), (lang, text)


def test_a_statement_that_shares_its_line_goes_alone(clean_all):
    pairs = [("java", "void f() {\n  log.info(1); g();\n  if (a) { log.info(2); }\n}\n"), ("bash", 'echo "Debug" && rm x\n')]
    got = clean_all(pairs, opts(remove_logging=True))
    assert [t for t, _ in got] == ["void f() {\n  g();\n  if (a) { }\n}\n", pairs[1][1]]


def test_outermost_span_wins(clean_all):
    text = "public int getA() {\n    log.info(1);\n    return 1;\n}\nint b;\n"
    [(out, _)] = clean_all([("java", text)], opts(remove_accessors=True, remove_logging=True))
    assert out == "\nint b;\n"
    # a header that turns out not to be an accessor hides nothing
    text = "public int getA() {\n    log.info(1);\n    throw x;\n}\n"
    [(out, _)] = clean_all([("java", text)], opts(remove_accessors=True, remove_logging=True))
    assert out == "public int getA() {\n\n    throw x;\n}\n"


def test_own_logging_prefix(clean_all):
    options = opts(remove_logging=True)
    options = CleanOptions(**{**options.__dict__, "logging_prefixes": {"java": ["audit.("]}})
    [(out, _)] = clean_all([("java", 'audit.("x")("(");\nkeep();\n')], options)
    assert out == "\nkeep();\n"


def test_span_at_the_end_without_line_end(clean_all):
    [(out, _)] = clean_all([("python", "a = 1\nprint(\n  1)")], opts(remove_logging=True))
    assert out == "a = 1\n"


def test_imports(clean_all):
    pairs = [
        ("go", 'import (\n\t"a"\n)\nvar x = 1\n'),
        ("python", "from a import (\n  b)\nx = 1\n"),
        ("cpp", "#include <a>\nusing namespace std;\nint x;\n"),
        ("csharp", "using A.B;\nusing (var x = y) { }\n"),
        ("javascript", "import x from 'y';\nimport('z');\n"),
        ("html", '<link rel="a">\n<p>x</p><script>var a;</script>\n'),
    ]
    got = [t for t, _ in clean_all(pairs, opts(remove_imports=True))]
    assert got == ["\nvar x = 1\n", "\nx = 1\n", "\n\nint x;\n", "\nusing (var x = y) { }\n", "\nimport('z');\n", "\n<p>x</p>\n"]


def test_default_doc_prefix_keeps_every_comment_of_some_languages(clean_all):
    pairs = [("html", "<!-- a -->\n"), ("css", "/* a */\n"), ("ruby", "# a\n"), ("bash", "# a\n"), ("sql", "-- a\n/* b */\n")]
    got = [t for t, _ in clean_all(pairs, opts(remove_comments=True, preserve_doc_comments=True))]
    assert got == ["<!-- a -->\n", "/* a */\n", "# a\n", "# a\n", "-- a\n\n"]
    got = [t for t, _ in clean_all(pairs, opts(remove_comments=True))]
    assert got == ["\n", "\n", "\n", "\n", "\n\n"]


def test_whitespace(column_of):
    v = F.col("v")
    rows = ["a  \n\t\n\n b\t", "", "\n\n", " \u00a0\r\n\u2003\nx", "a\n"]
    assert column_of(rows, trim_lines(v)) == ["a\n\n\n b", "", "\n\n", " \u00a0\r\n\u2003\nx", "a\n"]
    assert column_of(rows, drop_blank_lines(v)) == ["a\n b\n", "\n", "\n", "x\n", "a\n"]
    assert column_of(rows, collapse_blank_lines(v)) == ["a\n\n b\n", "\n", "\n", " \u00a0\r\nx\n", "a\n\n"]


def test_cleaning_twice_changes_nothing(spark):
    from checks.code_corpus import code_corpus
    from conftest import SMALL

    once = clean(code_corpus(spark, SMALL)).where("clean_status = 'cleaned'").drop("clean_status")
    twice = clean(once.withColumnRenamed("content", "first").withColumn("content", F.col("first")))
    assert twice.where("content <> first").count() == 0


def test_invalid_utf8_passes_through(spark):
    df = spark.sql("select 'go' as language, cast(X'2F2F20FFFE0A00' as string) as content")
    for out in (clean(df).drop("clean_status"), remove_comments(df)):
        assert bytes(out.select(F.col("content").cast("binary")).first()[0]) == b"\x2f\x2f\x20\xff\xfe\x0a\x00"


def test_long_literals_and_nesting_do_not_overflow(spark):
    """Whole texts of several hundred kilobytes in every language: long strings, comments, lines, bodies."""
    big = 300_000
    shapes = {
        "string": '"' + "x\\\\y" * (big // 4) + '"\n',
        "single": "'" + "x" * big + "'\n",
        "block": "/* " + "* x \n" * (big // 5) + " */\n",
        "hash": "# " + "x" * big + "\n",
        "line": "// " + "x" * big + "\n",
        "unclosed": '"' + "x" * big + "\n",
        "spaces": " " * big + "x\n",
        "blanks": "\n" * big,
        "body": "void setX(int x) {\n" + "  a(1);\n" * (big // 8) + "}\n",
        "calls": 'log.info("x");\n' * (big // 15),
        "args": "print(\n" + "  1,\n" * (big // 5) + ")\n",
        "ticks": "`" + "x\n" * (big // 2) + "`\n",
        "triple": '"""' + 'x"\n' * (big // 3) + '"""\n',
        "markup": "<!-- " + "x - \n" * (big // 5) + "-->\n",
        "deco": "@a\n" * (big // 3) + "def get_x(self):\n    pass\n",
        "names": "a.b " * (big // 4) + "\n",
        "dots": "a." * (big // 2) + "\n",
        "words": "public static " * (big // 14) + "\n",
        "generics": "public List<" * (big // 12) + "\n",
        "nested": "print" + "(" * (big // 2) + ")" * (big // 2) + "\n",
        "curly": "void setX(int x) " + "{" * (big // 2) + "}" * (big // 2) + "\n",
        "heads": "public void setX(int x)\n" * (big // 24),
        "equals": "import a =\n" * (big // 11),
        "template": "`${" * (big // 6) + "}`" * (big // 6) + "\n",
    }
    from sheaf.functions.languages import LANGUAGES

    rows = [(lang, shape, text) for lang in LANGUAGES for shape, text in shapes.items()]
    df = spark.createDataFrame(rows, "language string, shape string, content string").repartition(16)
    done = clean(df, CleanOptions(preserve_doc_comments=False, remove_imports=True))
    assert done.where("content is not null").count() == len(rows)
    calls = done.where("shape = 'calls' and language = 'java'").select("content").first()[0]
    assert calls == "\n"
