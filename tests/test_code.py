from __future__ import annotations

import pytest

from loamline.functions import java_code, python_code
from loamline.operators import code

SAMPLE = """
def sample(rows):
    out = []
    try:
        for r in rows:
            if r:
                if r.a:
                    if r.b:
                        out.append(r)
                    elif r.c:
                        with r:
                            pass
    except ValueError:
        raise
    return out
"""


def one(source):
    return python_code.read(source)["functions"][0]


def test_python_function():
    row = one(SAMPLE)
    assert (row["cyclomatic_complexity"], row["branch_count"], row["exception_paths"], row["max_nesting_depth"]) == (7, 4, 1, 7)


@pytest.mark.parametrize(("body", "value"), [("pass", 0), ("if a: pass", 1), ("if a:\n  if b: pass", 3), ("if a: pass\n else: pass", 2), ("if a: pass\n elif b: pass\n else: pass", 3), ("if a and b: pass", 2), ("for x in y:\n  pass\n else: pass", 2), ("while a or b: pass", 2), ("with a: pass", 1), ("try: pass\n except E: pass", 1)])
def test_python_cognitive(body, value):
    assert one(f"def f():\n {body}\n")["cognitive_complexity"] == value


@pytest.mark.parametrize(("body", "value"), [("int x = 1;", 0), ("if (a) {}", 1), ("if (a) { if (b) {} }", 3), ("if (a) {} else {}", 2), ("if (a) {} else if (b) {} else {}", 3), ("if (a) { for (;;) {} }", 3), ("if (a && b) {}", 2), ("try { } catch (E e) { }", 1)])
def test_java_cognitive(body, value):
    assert java_code.read(f"class A {{ void f() {{ {body} }} }}")["functions"][0]["cognitive_complexity"] == value


def test_lengths():
    got = python_code.read("def a():\n    pass\n\ndef b():\n    x = 1\n    y = 2\n    z = 3\n    return x\n")["functions"]
    assert [f["length"] for f in got] == [2, 5]


def test_broken_sources_have_no_rows():
    assert python_code.read("def f(:") is None and java_code.read("class A { void f( { }") is None
    assert python_code.read(None) == python_code.read("") == {"functions": [], "classes": [], "imports": []}
    assert java_code.read("") == {"functions": [], "classes": [], "imports": []}


def test_java_forms():
    got = java_code.read("""import a.b.Thing; import static c.D;
    @X(y = "}") public final class Foo<T extends Bar<T>> {
      private int a = 1, b; static Map<String, List<Integer>> m = new HashMap<>();
      Foo() { this.a = 1; }
      int getA() { return this.a; }
      int go(List<? extends T> z) { Runnable r = () -> { if (a > 1) { } }; return z == null ? a : switch (a) { case 1 -> 2; default -> { yield 3; } }; }
      void use() { this.a++; } abstract void none();
      enum E { A, B { void f() {} }; int q; } }
    record P(int x, Map<A, B> y) { P { if (x < 0) throw new X(); } int sum() { return x; } }
    enum Top { A; void m() { if (x) { } } }""")
    assert got["imports"] == ["D", "Thing"]
    assert {c["class_name"]: (c["field_count"], c["method_count"], c["property_count"], c["candidate_count"]) for c in got["classes"]} == {"Foo": (3, 5, 1, 3), "P": (2, 1, 0, 1)}
    assert {f["function_name"]: f["cyclomatic_complexity"] for f in got["functions"]} == {"Foo": 1, "getA": 1, "go": 3, "use": 1, "none": 1, "sum": 1}


CLASS = """
class A:
    kind = 0
    def __init__(self):
        self.x = 1
        self.y: int = 2
    @property
    def p(self): return self.x
    def act(self):
        if self.x: return 1
    def get(self): return self.z
"""


def files(spark, *rows):
    return code.parsed(code.sources(spark.createDataFrame(list(rows), "file_path string, source string"))).persist()


def test_class_metrics(spark):
    row = code.classes(files(spark, ("a.py", CLASS))).first()
    assert (row["field_count"], row["method_count"], row["behavior_method_count"], row["dunder_method_count"], row["property_count"]) == (2, 4, 1, 1, 1)
    assert (row["dbsi"], row["logic_density"], row["orchestration_pressure"], row["ams"]) == (0.6667, 0.5, 0.5, 0.3334)


def test_dbsi(spark):
    body = "class A:\n    a = 1\n    b = 2\n    c = 3\n" + "".join(f"    def m{i}(self):\n        if self.a: pass\n" for i in range(2))
    assert code.classes(files(spark, ("a.py", body))).first()["dbsi"] == 0.6


@pytest.mark.parametrize(("uses", "value"), [(("a", "b"), 0.0), (("a", "a"), 1.0), (("a", "a", "b"), 0.3333), (("a",), 1.0)])
def test_cohesion(spark, uses, value):
    body = "class A:\n" + "".join(f"    def m{i}(self): return self.{u}\n" for i, u in enumerate(uses))
    assert code.god_classes(files(spark, ("a.py", body))).first()["cohesion"] == value


def test_imports_and_reports(spark):
    read = files(spark, ("x/util.py", "def f():\n    pass\n"), ("b.py", "import util\nfrom util.y import z\n"), ("util.py", "import util"), ("c.txt", "no"), ("bad.py", "def ("))
    assert {r[0]: r[1] for r in code.touch_counts(read).collect()} == {"x/util.py": 2, "b.py": 0, "util.py": 0, "bad.py": 0}
    assert code.complexity_report(code.functions(read)).first()["total_functions"] == 1
    assert code.anemic_report(read).first()["total_classes"] == 0
    assert code.god_class_report(read, code.god_classes(read)).first()["god_class_percentage"] == 0.0


def test_deep_nesting_has_no_rows():
    from loamline.functions import python_code

    deep = "def f(x):\n    if x == 0:\n        pass\n" + "".join(f"    elif x == {i}:\n        pass\n" for i in range(900))
    assert python_code.read(deep) is None and len(python_code.read("def f(): pass")["functions"]) == 1
