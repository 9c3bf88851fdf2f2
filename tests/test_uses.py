from __future__ import annotations

import pytest

from corpusloom.operators import extract
from corpusloom.operators.lexing import bare, code_only
from corpusloom.operators.uses import java_injections, java_uses, parse, python_uses

# language, text with ~ for each character of a comment and ^ for each within a string, and the text
MARKED = [
    ("javascript", "const u = `^^^^^^^^`; load(b); ~~~~", "const u = `http://x`; load(b); // c"),
    ("javascript", "a = b / c / d; x = /^^^^^^^^/g; y(); ~~~~~~~", "a = b / c / d; x = /\\/\\*[/\"]/g; y(); /* k */"),
    ("typescript", "z`^${ f(`^${g}^^^^^^`) ~~~~~~~~~ } ^^^^^`; ~~~~~~", "z`p${ f(`q${g} // no`) /* yes */ } // in`; // out"),
    ("javascript", "return /^^/.test(s) ~~~~", "return /'x/.test(s) // c"),
    ("php", "$a = <<<EOT\n^^^^^\n^^^^\nEOT;\n~~~~~\n#[Attr]\n$b = '^^^';", "$a = <<<EOT\n// no\n# no\nEOT;\n# yes\n#[Attr]\n$b = 'x//';"),
    ("rust", "fn f<'a>(x: &'a str) { let c = '^'; ~~~~~~~~~~~~~~~~~ let s = r#\"^^^^^^^^^\"#; } ~~~~", "fn f<'a>(x: &'a str) { let c = '\"'; /* a /* b */ c */ let s = r#\"// no \" \"\"#; } // y"),
    ("python", "x = '^^^^' ~~~~~\n'''^^^^'''\n", "x = '# no' # yes\n'''# no'''\n"),
    ("go", "a := `^^^^^\n` ~~~~~~", "a := `// no\n` // yes"),
    ("csharp", "p = @\"^^^\"; ~~~~~~\nq = @\"^^^^^^^^^^\";", "p = @\"c:\\\"; // yes\nq = @\"a\"\"b // no\";"),
    ("ruby", "x = <<-TXT\n^^^^^\nTXT\n~~~~~\n~~~~~~\n~~~\n~~~~\ny", "x = <<-TXT\n # no\nTXT\n# yes\n=begin\nyes\n=end\ny"),
    ("lua", "~~~~~~\n~~~ x = [==[^^^^^^^^^^]==] ~~~~", "--[[ a\n ]] x = [==[ -- no ]] ]==] -- y"),
    ("java", "s = \"\"\"\n^^^^^^^^^\n\"\"\"; ~~~~\nc='^'; ~~~~", "s = \"\"\"\n // no \" \n\"\"\"; // y\nc='\"'; // z"),
    ("cpp", "auto s = R\"x(^^^^^^^^^)x\"; ~~~~", "auto s = R\"x(// no )\" )x\"; // y"),
    ("haskell", "f x' = ~~~~~~~~~~~~~~~~~ \"^^^^^\" ~~~~", "f x' = {- a {- b -} c -} \"-- no\" -- y"),
    ("shell", "echo $# ~~~~~\ncat <<EOF\n^^^^\nEOF\n~~~", "echo $# # yes\ncat <<EOF\n# no\nEOF\n# y"),
    ("javascript", "x = '^^^\ny = 1 ~~~~", "x = 'abc\ny = 1 // c"),
    ("javascript", "`^^^", "`abc"), ("java", "~~~~~~", "/* a b"), ("c", "", ""),
]


@pytest.mark.parametrize("lang,marks,text", MARKED)
def test_comments_and_strings_keep_offsets(lang, marks, text):
    assert len(marks) == len(text), (len(marks), len(text))
    comments = "".join(" " if m == "~" and c != "\n" else c for m, c in zip(marks, text, strict=True))
    both = "".join(" " if m in "~^" and c != "\n" else c for m, c in zip(marks, text, strict=True))
    assert bare(text, lang) == comments
    assert code_only(text, lang) == both


def test_html_has_comments_in_marks_and_scripts():
    text = "<a href=http://x> <!-- y --> <script>var a='//'; // y\n</script>"
    assert bare(text, "html") == "<a href=http://x>" + " " * 12 + "<script>var a='//';" + " " * 5 + "\n</script>"


def test_lexer_is_linear():
    for text in ("/*" * 50_000, "`${" * 30_000, "'" * 100_000, "/" * 100_000, "{" * 100_000, "<<<A\n" * 5_000):
        for lang in ("javascript", "php", "rust", "python", "ruby"):
            assert len(code_only(text, lang)) == len(text)


def test_python_scopes():
    uses, words = python_uses(parse('''
import mod as b
from x import f, C, g, t
# b.old()
"b.fake()"
def h(b): return b.run()
def k(x=f(1)):
    f = 2
    return f(3) + b.go() + b.size
class D(C, b.Base): pass
z = [g for g in y if g(1)]
def w():
    from q import f
    return f()
def g(): pass
g()
lambda b: b.no()
try:
    t
except NameError:
    t = None
t(1)
def e():
    global b
    b = 1
    return b.kept()
for m in b.all(): m
'''))
    assert sorted(uses) == sorted([
        ("f", "f", "call"), ("f", "f", "call"), ("C", "C", "extends"), ("b", "Base", "extends"), ("b", "go", "call"), ("b", "size", "attribute"), ("t", "t", "call"), ("b", "kept", "call"), ("b", "all", "call"),
    ])
    assert words == ["C", "NameError", "b", "f", "m", "t", "y"]
    assert python_uses(parse("def (")) == ([], [])


def test_java_scopes():
    code = code_only('''
class U { // m.fake();
  private final Foo foo = new Foo(); Bar<List<X>> bar;
  U(Baz baz) { baz.start(1); this.bar = bar; }
  void go() { foo.run(2); String s = "m.text()"; Made made = new Made(); made.stop(); for (Item i : items) i.each(); for (Item j : items) { j.more(); } }
  void other(String foo) { foo.trim(); Util.help(); use(Util.MAX); }
  void again() { foo.last(); late.x(); }
  class Inner { Qux foo; void in() { foo.inner(); } }
  Late late;
}''', "java")
    calls = {(a, b) for a, b, k in java_uses(code) if k == "call"}
    assert calls == {("Baz", "start"), ("Foo", "run"), ("Made", "stop"), ("Item", "each"), ("Item", "more"), ("String", "trim"), ("Util", "help"), ("Foo", "last"), ("Late", "x"), ("Qux", "inner")}
    assert [(a, k) for a, _, k in java_uses(code) if k == "instantiate"] == [("Foo", "instantiate"), ("Made", "instantiate")]
    assert ("Util", "MAX", "class_usage") in java_uses(code)
    found = java_injections('class A { @Autowired private Repo repo; @Inject @Named("x") Svc svc;\n @Autowired\n public A(final One one, @Q("z") Map<String, Two> two, Three three) { }\n public A(Four four) { } }')
    assert [x[:2] for x in found] == [("Repo", "repo"), ("Svc", "svc"), ("One", "one"), ("Map", "two"), ("Three", "three")]


def test_no_call_from_comments_strings_or_hidden_names(spark):
    files = [
        ("b.py", "def old(): pass\n"), ("a.py", "import b\n# b.old()\ns = 'b.fake()'\ndef f(b):\n    return b.no()\n"), ("c.py", "import b\nb.old()\n"),
        ("x.js", "export function load() {}\n"), ("y.js", "import { load } from './x';\nconst u = `http://x`; load(b);\n// load(1)\nz = 'load(2)';\n"),
        ("p/Dep.java", "package p;\npublic class Dep { }\n"), ("p/Own.java", "package p;\nimport p.Dep;\nclass Own {\n  @Autowired\n  public Own(Dep dep) { dep.go(); }\n  // dep.no();\n  void f(Other dep) { dep.hidden(); }\n}\n"),
    ]
    known = extract.facts(spark.createDataFrame([("r", p, c) for p, c in files], "repo_id string, path string, content string"))
    calls = {(r["src"], r["dst"], r["symbol"], r["member"], r["kind"]) for r in extract.call_targets(extract.symbol_bindings(known), known).collect()}
    assert calls == {("c.py", "b.py", "b", "old", "call"), ("y.js", "x.js", "load", "load", "call"), ("p/Own.java", "p/Dep.java", "Dep", "go", "call"), ("p/Own.java", "p/Dep.java", "Dep", "dep", "inject")}
    bindings = extract.symbol_bindings(known)
    assert {(r["path"], r["symbol"]) for r in extract.cross_refs(bindings, known).collect()} == {("c.py", "b"), ("y.js", "load"), ("p/Own.java", "Dep")}


IMPORTS = [
    ("rust", "use crate::a::b as c;\nuse super::x::{One, Two as Zwei};\npub mod parts;\nmod inline { }\nuse std::fmt;\nuse self::y::*;\n", [("crate::a::b", "use", ["c"]), ("super::x", "use", ["One", "Zwei"]), ("self::parts", "mod", ["parts"]), ("self::y", "use", ["*"])]),
    ("csharp", "using System.Linq;\nusing static A.B;\nusing Z = C.D;\nusing (var f = open()) { }\nusing var g = open();\n", [("System.Linq", "using", ["Linq"]), ("A.B", "using", ["B"]), ("C.D", "using", ["Z"])]),
    ("cpp", "#include <vector>\n# include \"a/b.h\"\nint include = 3;\n", [("vector", "include", ["vector"]), ("a/b.h", "include", ["b"])]),
    ("ruby", "require 'json'\nrequire_relative(\"../x/y\")\nputs 'require z'\nload 'q.rb'\n", [("json", "require", ["json"]), ("../x/y", "require", ["y"]), ("q.rb", "load", ["q"])]),
    ("kotlin", "import a.b.C\nimport a.b.D as E\nimport a.f.*\nval import1 = 2\n", [("a.b.C", "import", ["C"]), ("a.b.D", "import", ["E"]), ("a.f.*", "import", ["*"])]),
    ("scala", "import a.b.{C, D => E}\nimport x.y._\n", [("a.b", "import", ["C", "E"]), ("x.y.*", "import", ["*"])]),
    ("lua", "local m = require 'a.b'\nlocal n = require(\"c\")\ndofile('d.lua')\n", [("a.b", "require", ["m"]), ("c", "require", ["n"]), ("d.lua", "dofile", ["d"])]),
    ("dart", "import 'package:a/b.dart' as c;\npart of 'd.dart';\n", [("package:a/b.dart", "import", ["c"]), ("d.dart", "part", ["d"])]),
    ("elixir", "alias A.B, as: C\nimport D.E\nalias F.{G, H}\n", [("A.B", "import", ["C"]), ("D.E", "import", ["E"]), ("F", "import", ["G", "H"])]),
    ("haskell", "import qualified Data.Map as M\nimport A.B qualified as Q\nimport C (d)\n", [("Data.Map", "import", ["M"]), ("A.B", "import", ["Q"]), ("C", "import", ["C"])]),
    ("zig", "const std = @import(\"std\");\n", [("std", "import", ["std"])]), ("r", "source('a.R'); library(dplyr)\n", [("a.R", "source", ["a"]), ("dplyr", "library", ["dplyr"])]),
    ("nim", "import a/b, c\ninclude d\n", [("a/b", "import", ["b"]), ("c", "import", ["c"]), ("d", "include", ["d"])]),
    ("shell", "source ./a.sh\n. 'b.sh'; ls\necho source x\n", [("./a.sh", "source", ["a"]), ("b.sh", "source", ["b"])]),
    ("clojure", "(ns x (:require [a.b :as c] [d.e :refer [f]]))", [("a.b", "require", ["c"]), ("d.e", "require", ["e"])]),
    ("erlang", "-include(\"a.hrl\").\n-include_lib(\"k/b.hrl\").\n", [("a.hrl", "include", ["a"]), ("k/b.hrl", "include", ["b"])]),
    ("solidity", "import \"./a.sol\";\nimport {B as C} from './b.sol';\nimport * as D from \"d.sol\";\n", [("./a.sol", "import", ["a"]), ("./b.sol", "import", ["C"]), ("d.sol", "import", ["D"])]),
    ("swift", "import Foundation\nimport class A.B\n", [("Foundation", "import", ["Foundation"]), ("A.B", "import", ["B"])]),
    ("perl", "use A::B;\nrequire C::D;\nuse 5.010;\n", [("A::B", "use", ["B"]), ("C::D", "require", ["D"])]),
    ("objc", "#import <UIKit/UIKit.h>\n#import \"A.h\"\n", [("UIKit/UIKit.h", "include", ["UIKit"]), ("A.h", "include", ["A"])]), ("groovy", "import static a.B\n", [("a.B", "import", ["B"])]),
]


@pytest.mark.parametrize("lang,text,want", IMPORTS)
def test_import_statements(lang, text, want):
    from corpusloom.operators.imports import statements

    assert list(statements(text, lang)) == want
