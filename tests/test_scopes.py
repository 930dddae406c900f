"""C# types by scopes: the layout of a file does not matter, and what is quoted does not count."""

import re
import time

import pytest

from metaloom.operators import code, scopes

SOURCE = """using System; // class Gone { }
namespace Shop;
/* class AlsoGone { */
[Attr("class Quoted {")]
public sealed class Outer<T> : Base<int, string>, IThing<Dictionary<string, List<int>>> where T : class {
    public string Name { get; set; } = "}";
    private const string Raw = @"a""} class X { public int No { get; set; } }";
    public class Inner : IEquatable<Inner> { public int Depth { get; private set; } char c = '}'; }
    public int Count { get; init; }
    public Outer(string name, int n) { Name = $"{name}{{"; }
}
public record struct Point(int X, int Y) : IPoint;
public interface IPoint { int X { get; } }
class Last { public bool Done { get; set; } }
"""


def minified(text):
    return re.sub(r"\s+", " ", re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S))


def indented(text):
    return "\n".join((" " * (7 * k % 11)) + line for k, line in enumerate(text.replace("{", "\n{\n").replace("\n{\n{", "{{").split("\n")))


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("change", [lambda t: t, minified])
def test_types_and_members_whatever_the_layout(spark, change):
    files = spark.createDataFrame([("a.cs", change(SOURCE)), ("b.py", SOURCE), ("c.cs", None), ("d.cs", "")], "path string, text string")
    got = rows(code.classes(files), "name", "kind", "bases", "interfaces")
    assert got == [("IPoint", "interface", "", ""), ("Inner", "class", "", "IEquatable<Inner>"), ("Last", "class", "", ""), ("Outer", "class", "Base<int,string>", "IThing<Dictionary<string,List<int>>>"), ("Point", "record", "", "IPoint")]
    assert rows(code.properties(files), "entity", "name", "type", "setter") == [("Inner", "Depth", "int", "private"), ("Last", "Done", "bool", "public"), ("Outer", "Count", "int", "init"), ("Outer", "Name", "string", "public")]
    assert rows(scopes.types(files), "name", "depth") == [("IPoint", 0), ("Inner", 1), ("Last", 0), ("Outer", 0), ("Point", 0)]


@pytest.mark.parametrize("text", ["{" * 200_000, '"' * 200_000, "class A { " * 20_000, "'" * 200_001, "/*" * 100_000, 'class A : B<' * 20_000, "}" * 200_000])
def test_broken_files_take_linear_time(text):
    began = time.process_time()
    scopes.types_of(text)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("text", ["{" * 100_000, "class A { " * 20_000, "@a " * 100_000, "private " * 50_000 + ";", "(" * 200_000, "@a(@a(" * 60_000, "class A<" * 30_000 + "{", "class A { private int x; }" * 10_000, '"' * 200_000])
def test_broken_java_files_take_linear_time(text):
    began = time.process_time()
    scopes.java_types_of("class Z {" + text)
    assert time.process_time() - began < 5


def test_java_types_of_nulls_and_other_files(spark):
    files = spark.createDataFrame([("a.java", None), ("b.java", ""), ("c.cs", "class A { }"), ("d.java", "@interface N { } enum E implements I { A { int x() { return 1; } }, B; private int code; }")], "path string, text string")
    got = scopes.java_types(files).collect()
    assert [(r.path, r.kind, r.name, r.interfaces, [f.name for f in r.fields]) for r in got] == [("d.java", "enum", "E", ["I"], ["code"])]
