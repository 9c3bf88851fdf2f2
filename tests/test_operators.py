from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, endpoints, extract, graph, history, models, project, quality, rules, security
from corpusloom.sources import readers, sinks

FILES = "repo_id string, path string, content string"
EDGES = "repo_id string, src string, dst string"



def of(spark, rows):
    return spark.createDataFrame([("r", p, c) for p, c in rows], FILES)


def graph_of(spark, *pairs, alone=()):
    names = sorted({x for p in pairs for x in p} | set(alone))
    return spark.createDataFrame([("r", n, "") for n in names], FILES).select("repo_id", "path"), spark.createDataFrame([("r", a, b) for a, b in pairs], EDGES)


CYCLES = [
    ([("a", "b"), ("b", "a")], {"a > b"}),
    ([("c", "a"), ("a", "b"), ("b", "c")], {"a > b > c"}),
    ([("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")], {"a > b", "a > c"}),
    ([("a", "a"), ("x", "a")], set()),
    ([("t", "a"), ("a", "b"), ("b", "a")], {"a > b"}),
    ([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("c", "a")], {"a > b > c > d", "a > b > c"}),
]


@pytest.mark.parametrize("pairs,want", CYCLES)
def test_cycles(spark, pairs, want):
    _, edges = graph_of(spark, *pairs)
    assert {r["cycle"] for r in graph.detect_cycles(edges).collect()} == want
    assert {r["cycle"] for r in graph.short_cycles(edges).collect()} == want


def ring(n, name="n"):
    return [(f"{name}{i:04d}", f"{name}{(i + 1) % n:04d}") for i in range(n)]


def shortest_cycles(pairs):
    """For each edge on a cycle its shortest cycle by plain search, the least by names from the edge on."""
    out, after = set(), {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for a, b in pairs:
        ways, seen = {b: (b,)}, {b}
        while ways and a not in ways and a != b:
            more = {}
            for at, way in ways.items():
                for c in after.get(at, set()) - seen:
                    more[c] = min(more.get(c, (*way, c)), (*way, c))
            seen |= set(more)
            ways = more
        if a != b and a in ways:
            cycle = (a, *ways[a][:-1])
            k = cycle.index(min(cycle))
            out.add(" > ".join(cycle[k:] + cycle[:k]))
    return out


def test_cycles_of_any_length(spark):
    for n in (7, 40):
        _, edges = graph_of(spark, *ring(n), ("t", "n0000"), ("n0001", "u"))
        rows = graph.detect_cycles(edges).collect()
        assert [(r["cycle"], r["size"]) for r in rows] == [(" > ".join(f"n{i:04d}" for i in range(n)), n)]
    _, edges = graph_of(spark, *ring(7))
    assert rules.max_cycle_size(None, edges, {"type": "max_cycle_size", "max": 6}).count() == 1
    assert rules.max_cycle_size(None, edges, {"type": "max_cycle_size", "max": 7}).count() == 0
    _, edges = graph_of(spark, *ring(7), *[("n0003" if a == "m0000" else a, "n0003" if b == "m0000" else b) for a, b in ring(5, "m")])
    assert sorted(r["size"] for r in graph.detect_cycles(edges).collect()) == [5, 7]
    assert {(r["component"], r["size"]) for r in graph.cycle_members(edges).collect()} == {("m0001", 11)}


def test_cycles_equal_plain_search(spark):
    import random

    for seed in range(2):
        r = random.Random(seed)
        pairs = sorted({(f"f{r.randrange(14):02d}", f"f{r.randrange(14):02d}") for _ in range(24)})
        _, edges = graph_of(spark, *pairs)
        assert {x["cycle"] for x in graph.detect_cycles(edges).collect()} == shortest_cycles(pairs)


def test_long_cycles_over_short_ones(spark):
    both = lambda *names: [(a, b) for a in names for b in names if a != b]
    rule = {"type": "max_cycle_size", "max": 2}
    _, edges = graph_of(spark, *both("a", "b", "c"), *both("x", "y"), *both("y", "z"), *both("z", "w"))  # only the triangle has a cycle of three
    assert all(r["size"] == 2 for r in graph.detect_cycles(edges).collect())
    assert [r["related_file"] for r in rules.max_cycle_size(None, edges, rule).collect()] == ["a > b > c"]
    _, edges = graph_of(spark, *[p for a, b in ring(6) for p in ((a, b), (b, a))])  # a ring both ways
    assert [r["related_file"] for r in rules.max_cycle_size(None, edges, rule).collect()] == [" > ".join(f"n{i:04d}" for i in range(6))]
    assert rules.max_cycle_size(None, edges, rule | {"max": 6}).count() == 0


def count_tables(monkeypatch):
    from corpusloom.functions import staging

    made = []
    real = staging.stage_at
    for module in (graph, staging):
        monkeypatch.setattr(module, "stage_at", lambda df: made.append(1) or real(df))
    return made


def test_long_ring_in_few_rounds(spark, monkeypatch):
    made = count_tables(monkeypatch)
    _, edges = graph_of(spark, *ring(2000))
    rows = graph.cycle_members(edges)
    assert {(r["component"], r["size"]) for r in rows.select("component", "size").distinct().collect()} == {("n0000", 2000)} and rows.count() == 2000
    assert len(made) <= 40
    made.clear()
    _, edges = graph_of(spark, *ring(500), ("n0000", "n0250"), ("n0100", "a"), ("a", "b"), ("b", "n0050"), ("b", "b2"), ("b2", "b"), *[(f"t{i:03d}", f"t{i + 1:03d}") for i in range(300)], ("t300", "n0000"), ("n0400", "u"), ("u", "v"), ("v", "u"))
    got = {r["path"]: (r["component"], r["size"]) for r in graph.cycle_members(edges).collect()}
    assert len(made) <= 60
    assert got["n0000"] == got["b2"] == ("a", 503) and got["u"] == ("u", 2) and len(got) == 505


def test_components_equal_plain_search(spark):
    import random

    for seed in range(3):
        r = random.Random(100 + seed)
        pairs = sorted({(f"f{r.randrange(30):02d}", f"f{r.randrange(30):02d}") for _ in range(34 + 4 * seed)})
        _, edges = graph_of(spark, *pairs)
        reach = {}
        for a, b in pairs:
            reach.setdefault(a, set()).add(b)
        for k in sorted({x for p in pairs for x in p}):
            for a in list(reach):
                if k in reach[a]:
                    reach[a] |= reach.get(k, set())
        want = {}
        for a in reach:
            own = {a} | {b for b in reach[a] if a in reach.get(b, ())}
            if len(own) > 1:
                want[a] = (min(own), len(own))
        assert {x["path"]: (x["component"], x["size"]) for x in graph.cycle_members(edges).collect()} == want


def test_deep_layers_in_few_rounds(spark, monkeypatch):
    made = count_tables(monkeypatch)
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(1999)]
    nodes, edges = graph_of(spark, *chain)
    depth = {r["path"]: r["depth"] for r in graph.topological_layers(nodes, edges).collect()}
    assert depth == {f"n{i:04d}": 1999 - i for i in range(2000)} and len(made) <= 30
    made.clear()
    # every file also imports a common one, some import far ahead, and some are above a ring
    extra = [(f"n{i:04d}", "util") for i in range(300)] + [(f"n{i:04d}", f"n{i + 7:04d}") for i in range(0, 280, 9)] + [("n0000", "side"), ("side", "n0150")]
    loops = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("on1", "on2"), ("on2", "r1"), ("on1", "n0299")]
    nodes, edges = graph_of(spark, *chain[:299], *extra, *loops)
    depth = {r["path"]: r["depth"] for r in graph.topological_layers(nodes, edges).collect()}
    assert all(depth[f"n{i:04d}"] == 300 - i for i in range(300)) and depth["util"] == 0 and depth["side"] == 151
    assert all(depth[x] is None for x in ("r1", "r2", "r3", "on1", "on2"))


def test_layers_equal_plain_search(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        pairs = sorted({(f"f{r.randrange(40):02d}", f"f{r.randrange(40):02d}") for _ in range(45)} | {(f"g{i:02d}", f"g{i + 1:02d}") for i in range(20)} | {("g20", "f00"), ("f01", "g05")})
        after = {}
        for a, b in pairs:
            if a != b:
                after.setdefault(a, set()).add(b)
        nodes, edges = graph_of(spark, *pairs)
        names = {x for p in pairs for x in p}
        want = {n: 0 for n in names if n not in after}
        while fresh := {n for n in names if n not in want and all(b in want for b in after[n])}:
            want |= {n: 1 + max(want[b] for b in after[n]) for n in fresh}
        assert {x["path"]: x["depth"] for x in graph.topological_layers(nodes, edges).collect()} == {n: want.get(n) for n in names}


def test_call_rollup_lists_a_few(spark):
    calls = spark.createDataFrame([("r", f"s{i:03d}", "hub") for i in range(200)] + [("r", "s000", "hub"), ("r", "s1", "one")], "repo_id string, src string, dst string")
    got = {r["dst"]: (r["n_calls"], r["n_callers"], r["first_callers"]) for r in graph.call_rollup(calls).collect()}
    assert got == {"hub": (201, 200, "s000,s001,s002,s003,s004"), "one": (1, 1, "s1")}


def test_cycle_members_and_edges(spark):
    _, edges = graph_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("t", "a"), ("f", "f"))
    got = {(r["path"], r["component"], r["size"]) for r in graph.cycle_members(edges).collect()}
    assert got == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 2), ("e", "d", 2)}
    assert {(r["src"], r["dst"]) for r in graph.cycle_edges(edges).collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d")}


def test_layers_are_longest_paths(spark):
    nodes, edges = graph_of(spark, ("top", "mid"), ("mid", "low"), ("top", "low"), ("loop1", "loop2"), ("loop2", "loop1"), ("on", "loop1"), alone=["src/service/x.py"])
    depth = {r["path"]: r["depth"] for r in graph.topological_layers(nodes, edges).collect()}
    assert depth == {"low": 0, "mid": 1, "top": 2, "loop1": None, "loop2": None, "on": None, "src/service/x.py": 0}
    layer = {r["path"]: r["layer"] for r in graph.assign_layers(nodes, edges).collect()}
    assert layer["top"] == "domain" and layer["src/service/x.py"] == "application"
    counts = {(r["path"]): (r["imports"], r["imported_by"]) for r in graph.degrees(nodes, edges).collect()}
    assert counts["low"] == (0, 2) and counts["src/service/x.py"] == (0, 0)


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "repo_id string, path string"), spark.createDataFrame([], EDGES)
    for out in (graph.detect_cycles(edges), graph.cycle_members(edges), graph.topological_layers(nodes, edges), graph.degrees(nodes, edges), rules.check_rules(nodes, edges)):
        assert out.collect() == []


def test_comments_keep_the_published_counts(spark):
    rows = [("a.js", "/* one */\ncode\n*/\nx // no\n// yes\n"), ("b.py", "# a\n  # b\nx # c\n"), ("c.txt", "# no\n"), ("d.java", "/*\n * in\n */\ncode"), ("e.js", "")]
    got = {r["path"]: (r["total"], r["blank"], r["comment"], r["code"]) for r in quality.line_metrics(of(spark, rows)).collect()}
    assert got["a.js"][2] == 4 and got["b.py"][2] == 2 and got["c.txt"][2] == 0 and got["d.java"][2] == 3 and got["e.js"] == (1, 0, 0, 1)
    assert {r["blank"] for r in quality.line_metrics(of(spark, [("x.py", "a\n\n\nb")])).collect()} == {1}
    assert all(t == b + c + k for t, b, c, k in got.values())


def test_complexity_window_and_cap(spark):
    body = "def f():\n" + "    if x and y: pass\n" * 10
    got = quality.functions(of(spark, [("a.py", body), ("b.py", "def g():\n" + "if a or b:\n" * 400), ("c.js", "no functions")])).collect()
    assert {r["name"]: r["complexity"] for r in got} == {"f": 21, "g": 100}
    top = quality.complex_functions(of(spark, [("a.py", body)])).collect()
    assert [(r["name"], r["rank"]) for r in top] == [("f", 1)]
    assert quality.quality_summary(of(spark, [("a.py", body)])).first()["grade"] == "D"


def test_function_extents(spark):
    rows = [
        ("a.py", "def f(x):\n    if x:\n        return 1\n\n    # note\n    return 2\n\n\nclass C:\n    async def g(self):\n        pass\n\nx = 1\n"),
        ("B.java", "class B {\n    public int getX() { return x; }\n    public void setX(int v) { x = v; }\n    public String toString() { return s; }\n    public B(int a) {\n        if (a > 1) {\n            b = a;\n        }\n    }\n    private static int add(int a, int b) {\n        return a + b;\n    }\n}\n"),
        ("c.ts", "export const run = async (a) => {\n};\nfunction walk(b) { return b ? 1 : 2; }\n"), ("d.rb", "def total(x)\n  if x\n    while x\n    end\n  end\nend\n"),
        ("e.cs", "class E {\n    public int Add(int a) {\n        return a;\n    }\n    public override string ToString() {\n    }\n}\n"), ("f.go", "func (s *S) Run(n int) {\n}\nfunc Go(a int) {}\n"), ("g.php", "function show($a) { if ($a) {} }"),
    ]
    got = {(r["path"], r["name"]): (r["line"], r["end_line"], r["n_lines"], r["complexity"]) for r in quality.functions(of(spark, rows)).collect()}
    assert got == {
        ("a.py", "f"): (1, 6, 6, 2), ("a.py", "g"): (10, 11, 2, 1), ("B.java", "B"): (5, 9, 5, 2), ("B.java", "add"): (10, 12, 3, 1), ("c.ts", "run"): (1, 5, 4, 2), ("c.ts", "walk"): (3, 7, 4, 2),
        ("d.rb", "total"): (1, 5, 4, 2), ("e.cs", "Add"): (2, 4, 2, 1), ("f.go", "Run"): (1, 3, 2, 1), ("f.go", "Go"): (3, 5, 2, 1), ("g.php", "show"): (1, 5, 4, 2),
    }
    quality_of = {r["path"]: r for r in quality.file_quality(of(spark, rows)).collect()}
    assert (quality_of["a.py"]["n_functions"], quality_of["a.py"]["mean_lines"], quality_of["B.java"]["mean_lines"]) == (2, 4.0, 4.0)


AWS, JWT = "A1b2" * 5, ".".join(("eyJ" + "a" * 20, "b" * 20, "c" * 10))
# (file, text with a hit, text without)
SECURITY = [
    ("SEC-002", "a.py", "api_secret = 'abcdefgh12'", "api_secret = 'short'"), ("SEC-002", "a.py", "auth-token: \"abcdefgh12\"", "token: abcdefgh12"),
    ("SEC-002", "a.yml", "password = 'hunter22'", "password = 'changeme'"), ("SEC-002", "a.py", "pwd='abcd'", "pwd='abcd' # example"), ("SEC-002", "a.py", "private_key = '-----BEGIN x'", "private_key = 'x'"),
    ("SEC-002", "a.py", f"aws_secret_access_key = '{AWS}'", "aws_secret_access_key = 'x'"), ("SEC-002", "a.js", "sk-" + "a" * 20, "sk-" + "a" * 19), ("SEC-002", "a.go", "mysql://u:p@h", "mysql://h"),
    ("SEC-002", "a.ts", "ghs_" + "a" * 20, "ghs_" + "a" * 19), ("SEC-002", "a.ts", JWT, "eyJabc.def.ghi"),
    ("SEC-003", "a.py", "cur.execute(f'SELECT {x}')", "cur.execute('SELECT ?', x)"), ("SEC-003", "a.py", "cur.execute('a %s' % x)", "cur.execute(q)"),
    ("SEC-003", "A.java", "q = \"select a\" + b;\nst.executeQuery(q)", "q = \"select a\";\nst.executeQuery(q)"), ("SEC-003", "a.php", "mysqli_query($c, 'x')\npg_query(\"SELECT $a\")", "pg_query($q)"),
    ("SEC-004", "a.html", "x.innerHTML = y", "x.textContent = y"), ("SEC-004", "a.tsx", "dangerouslySetInnerHTML={x}", "innerHTML"), ("SEC-004", "a.php", "echo $_POST['x']", "echo htmlspecialchars($_POST['x'])"),
    ("SEC-005", "a.py", "subprocess.run(\n  c,\n  shell=True)", "subprocess.run(c, shell=False)"), ("SEC-005", "a.php", "passthru('ls')", "curl_exec($c)"),
    ("SEC-006", "a.py", "yaml.load(f)", "yaml.load(f, Loader=yaml.SafeLoader)"), ("SEC-006", "a.py", "marshal.loads(x)", "json.loads(x)"), ("SEC-006", "A.java", "new ObjectInputStream(in)", "new InputStream()"),
    ("SEC-006", "a.php", "unserialize ($x)", "serialize_x($x)"), ("SEC-007", "a.py", "DEBUG = True", "DEBUG = False"), ("SEC-007", "a.php", "error_reporting(E_ALL)", "error_reporting(0)"),
    ("SEC-008", "a.py", "hashlib.md5(x)", "hashlib.sha256(x)"), ("SEC-008", "A.java", "MessageDigest.getInstance(\"SHA-1\")", "MessageDigest.getInstance(\"SHA-256\")"), ("SEC-008", "a.js", "crypto.createCipheriv('rc4')", "'rc4'"),
]


def test_security_rules(spark):
    rows = [(f"{kind}/{i}/{name}", "line\n" + (hit if kind == "hit" else miss)) for i, (_, name, hit, miss) in enumerate(SECURITY) for kind in ("hit", "miss")]
    rows += [("vendor/b.py", "pickle.loads(d)"), ("x/.next/c.py", "pickle.loads(d)"), ("k.pem", "pickle.loads"), ("src/.env", "API_KEY='0123456789abcdef0'"), ("Dockerfile", "FROM x"), ("home/ID_RSA", "x")]
    got = {}
    for r in security.security_scan(of(spark, rows)).collect():
        got.setdefault(r["path"], set()).add(r["rule_id"])
        assert r["line"] >= 2
    assert got == {f"hit/{i}/{name}": {rule} for i, (rule, name, _, _) in enumerate(SECURITY)}
    assert {(r["path"], r["severity"]) for r in security.sensitive_files(of(spark, rows)).collect()} == {("k.pem", "high"), ("src/.env", "high"), ("Dockerfile", "medium"), ("home/ID_RSA", "medium")}
    assert len(security.security_scan(of(spark, [("a.js", "crypto.x('3DES')")])).collect()) == 2  # the longer name holds the shorter one
    masked = spark.createDataFrame([("x" * 30,), ("y" * 31,)], "t string").select(security.mask_secret(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in masked] == ["x" * 10 + "***", "y" * 20 + "***" + "y" * 5]


def test_hits_take_linear_time(spark):
    import time

    rows = [("a.py", "".join(f"@app.get('/r{i}')\ndef f{i}():\n    pass\n" for i in range(10_000)))]
    start = time.time()
    found = endpoints.endpoints(of(spark, rows)).collect()
    assert len(found) == 20_000 and max(r["line"] for r in found) == 29_998 and time.time() - start < 20


SPRING = """@RestController
@RequestMapping("/api/")
public class A {
    @GetMapping("/x")
    public List<String> all() { }
    @PostMapping
    public String add(@RequestBody String b) { }
    @PutMapping()
    public void put() { }
    @DeleteMapping(value = "{id}", produces = "x")
    public void drop() { }
    @PatchMapping(produces = "json")
    public void patch() { }
    @RequestMapping(value = "/old", method = RequestMethod.GET)
    public String old() { }
}"""
ENDPOINTS = [
    ("A.java", SPRING, {("spring", "GET", "/api/x", "all", 4), ("spring", "POST", "/api", "add", 6), ("spring", "PUT", "/api", "put", 8), ("spring", "DELETE", "/api/{id}", "drop", 10), ("spring", "PATCH", "/api", "patch", 12), ("spring", "GET", "/api/old", "old", 14)}),
    ("B.java", "@GET\n@Path(\"/feed\")\npublic String feed() {}\n@HEAD\npublic void head() {}", {("jaxrs", "GET", "/feed", "feed", 1), ("jaxrs", "HEAD", "/", "head", 4)}),
    ("b.py", "@app.route('/a', methods=['PUT', 'GET'])\ndef a(): pass\n@app.post('/b')\nasync def b(): pass\n@app.options('/c')\ndef c(): pass", {
        ("flask", "PUT", "/a", "a", 1), ("flask", "GET", "/a", "a", 1), ("flask", "POST", "/b", "b", 3), ("fastapi", "POST", "/b", "b", 3), ("fastapi", "OPTIONS", "/c", "c", 5)}),
    ("urls.py", "urlpatterns = [path('home/', views.home), re_path(r'^x$', X.as_view())]", {("django", "ANY", "home/", "views", 1), ("django", "ANY", "^x$", "X", 1)}),
    ("d.js", "router.use('/z', f)\napp.delete(`/q`, g)\nrouter.get('/k', h)", {("express", "ANY", "/z", "handler", 1), ("express", "DELETE", "/q", "handler", 2), ("express", "GET", "/k", "handler", 3), ("koa", "GET", "/k", "handler", 3)}),
    ("c.ts", "@Controller('cats')\nexport class C {\n  @Get('all')\n  findAll() {}\n  @All()\n  async rest() {}\n}", {("nestjs", "GET", "cats/all", "findAll", 3), ("nestjs", "ANY", "cats", "rest", 5)}),
    ("f.php", "Route::any('/s', 'C@run');\nRoute::apiResource('photos', [P::class]);\n#[Route('/l', name: 'l', methods: ['GET', 'POST'])]\npublic function listing() {}", {
        ("laravel", "ANY", "/s", "C@run", 1), ("laravel", "CRUD", "photos", "P", 2), ("symfony", "GET", "/l", "listing", 3), ("symfony", "POST", "/l", "listing", 3)}),
    ("e.go", 'r.GET("/p", h)\nr.Any("/q", g)', {("gin", "GET", "/p", "h", 1), ("echo", "GET", "/p", "h", 1), ("gin", "ANY", "/q", "g", 2)}),
    ("r.rb", "get '/carts', to: 'carts#index'\ndelete \"/x\"", {("rails", "GET", "/carts", "carts#index", 1), ("rails", "DELETE", "/x", "", 2)}),
    ("I.cs", '[Route("api/items")]\npublic class I {\n  [HttpGet]\n  public List<Item> All() { }\n  [HttpPost("add")]\n  public Item Add(Item a) { }\n}', {("aspnet", "GET", "api/items", "All", 3), ("aspnet", "POST", "api/items/add", "Add", 5)}),
    ("n.txt", "@app.get('/x')", set()), ("n.py", "x.get('/a')\nget('/b')", set()), ("n.java", "class N { void get() {} }", set()),
]


def test_endpoints(spark):
    found = endpoints.endpoints(of(spark, [x[:2] for x in ENDPOINTS]))
    got = {}
    for r in found.collect():
        got.setdefault(r["path"], set()).add((r["framework"], r["method"], r["route"], r["handler"], r["line"]))
    for name, _, want in ENDPOINTS:
        assert got.get(name, set()) == want, name
    counts = {r["method"]: r["n_endpoints"] for r in endpoints.endpoint_summary(found.where("path = 'b.py'"), dedupe=True).collect()}
    assert counts == {"PUT": 1, "GET": 1, "POST": 1, "OPTIONS": 1}
    paths = spark.createDataFrame([("/a/", "b"), ("", "b"), ("/a", ""), ("", ""), ("a", "/b")], "x string, y string").select(endpoints.join_path(F.col("x"), F.col("y")).alias("p")).collect()
    assert [r["p"] for r in paths] == ["/a/b", "/b", "/a", "/", "a/b"]


MODELS = [
    ("P.java", '@Entity\n@Table(name = "people")\npublic class Person {\n  @Id\n  private Long id;\n  @Column(length = 30, nullable = false)\n  private String name;\n  @OneToMany(cascade = {CascadeType.ALL})\n  private List<Pet> pets;\n  @Transient\n  private int age;\n}\n@Entity\nclass Pet {\n  private Person owner;\n}',
     {("jpa", "Person", "people", (("id", "BIGINT", True, True, 0, ""), ("name", "VARCHAR", False, False, 30, ""), ("pets", "LIST<PET>", True, False, 0, "Pet"))), ("jpa", "Pet", "Pet", (("owner", "PERSON", True, False, 0, ""),))}),
    ("m.py", "class BlogPost(models.Model):\n    title = models.CharField(max_length=9, null=True)\n    user = models.ForeignKey('User', on_delete=models.CASCADE)\n\n    class Meta:\n        db_table = 'posts'\n\n\nclass Tag(models.Model):\n    name = models.TextField(default='x')\n",
     {("django", "BlogPost", "posts", (("title", "CharField", True, False, 9, ""), ("user", "ForeignKey", False, False, 0, "User"))), ("django", "Tag", "tag", (("name", "TextField", False, False, 0, ""),))}),
    ("s.py", "class OrderLine(Base):\n    __tablename__ = 'lines'\n    id = Column(Integer, primary_key=True)\n    note = Column(String(40), nullable=False)\n    parts = relationship('Part')\n",
     {("sqlalchemy", "OrderLine", "lines", (("id", "Integer", True, True, 0, ""), ("note", "String", False, False, 40, ""), ("parts", "relationship", True, False, 0, "Part")))}),
    ("e.ts", "@Entity({ name: 'pics' })\nexport class Photo {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column({ nullable: true })\n  at: Date;\n  @ManyToOne(() => User)\n  user: User;\n}",
     {("typeorm", "Photo", "pics", (("id", "INTEGER", False, True, 0, ""), ("at", "TIMESTAMP", True, False, 0, ""), ("user", "ManyToOne", True, False, 0, "User")))}),
    ("j.js", "const U = sequelize.define('User', {\n  name: { type: DataTypes.STRING, allowNull: false },\n});\nconst Note = new mongoose.Schema({\n  body: { type: String },\n  by: { type: ObjectId, ref: 'User' },\n});",
     {("sequelize", "User", "User", (("name", "STRING", False, False, 0, ""),)), ("mongoose", "Note", "note", (("body", "STRING", True, False, 0, ""), ("by", "OBJECTID", True, False, 0, "User")))}),
    ("g.go", "type UserAccount struct {\n\tID int64 `gorm:\"primaryKey\"`\n\tEmail string `gorm:\"size:90;not null\"`\n}\ntype Plain struct {\n\tA int\n}", {("gorm", "UserAccount", "user_account", (("ID", "BIGINT", True, True, 0, ""), ("Email", "VARCHAR", False, False, 90, "")))}),
    ("b.php", "class BookShelf extends Model {\n  protected $fillable = ['title', 'year'];\n}\nclass B extends Model {\n  protected $table = 'bees';\n}", {("eloquent", "BookShelf", "bookshelf", (("title", "VARCHAR", True, False, 0, ""), ("year", "VARCHAR", True, False, 0, ""))), ("eloquent", "B", "bees", ())}),
    ("r.rb", "class LineItem < ApplicationRecord\nend", {("activerecord", "LineItem", "lineitem", ())}),
    ("n.py", "class A:\n    x = models.CharField()\n", set()),
]


def test_models(spark):
    got = {}
    found = models.orm_models(of(spark, [x[:2] for x in MODELS]))
    for r in found.collect():
        fields = tuple((f["name"], f["type"], f["nullable"], f["primary_key"], f["max_length"], f["relation_target"]) for f in r["fields"])
        got.setdefault(r["path"], set()).add((r["orm"], r["class_name"], r["table_name"], fields))
        assert r["n_fields"] == len(fields)
    for name, _, want in MODELS:
        assert got.get(name, set()) == want, name
    assert models.model_fields(found.where("orm = 'django'")).count() == 3


IMPORTS = [
    ("pkg/a.py", "\"\"\"What a does.\n\nMore.\"\"\"\nfrom pkg.b import f, g as h\nimport os, json as j\nfrom c import *\nfrom . import d\nfrom ..top import t\n# from pkg.z import q\nh(1)\n", {("pkg.b", "from"), ("os", "import"), ("json", "import"), ("c", "from"), (".d", "from"), ("..top", "from")}, {"pkg/b.py", "pkg/c.py", "pkg/d.py", "top.py"}),
    ("web/x.ts", "import D, { T, U as V } from './y'\nimport * as Z from '../web/z'\nimport './side'\nexport * from './y'\nconst { a, b: c } = require('./w');\nconst l = () => import('./lazy')\nV(1); Z.go(); new D(); Z.prop;\n", {
        ("./y", "import"), ("../web/z", "import"), ("./side", "side-effect"), ("./y", "export"), ("./w", "require"), ("./lazy", "dynamic")}, {"web/y.ts", "web/z/index.ts", "web/side.js", "web/w.js", "web/lazy.tsx"}),
    ("src/main/java/com/ex/A.java", "package com.ex;\nimport java.util.List;\nimport com.ex.model.User;\nimport static com.ex.util.Texts.trim;\nimport com.other.Thing;\nclass A extends Base {\n  @Autowired\n  private User user;\n  void f() { user.save(); new User(); }\n}", {
        ("java.util.List", "import"), ("com.ex.model.User", "import"), ("com.ex.util.Texts.trim", "static"), ("com.other.Thing", "import")}, {"src/main/java/com/ex/model/User.java", "src/main/java/com/ex/util/Texts.java", "lib/Thing.java"}),
    ("cmd/main.go", "package main\nimport \"fmt\"\nimport (\n\t\"os\"\n\tlog \"project/logger\"\n)\n", {("fmt", "import"), ("os", "import"), ("project/logger", "import")}, {"project/logger.go"}),
    ("app/a.php", "<?php\nuse App\\Models\\User;\nuse App\\{One, Two as Deux};\nrequire_once 'inc.php';\nclass A extends User { use Marks; }\nUser::find(1); Deux::LIMIT;", {("App\\Models\\User", "use"), ("App\\One", "use"), ("App\\Two", "use"), ("inc.php", "include")}, {"App/Models/User.php", "app/inc.php", "lib/Two.php"}),
    ("src/app.rs", "mod database;\nuse std::fmt;\nuse crate::models::User;\nuse self::database::open;\nuse super::other;\n", {("self::database", "mod"), ("crate::models::User", "use"), ("self::database::open", "use"), ("super::other", "use")}, {"src/database.rs", "src/models.rs", "src/other.rs"}),
    ("c/a.c", "#include <stdio.h>\n#include \"b.h\"\n#include \"shared/x.h\"\n", {("stdio.h", "include"), ("b.h", "include"), ("shared/x.h", "include")}, {"c/b.h", "shared/x.h"}),
    ("N/A.cs", "using System.Linq;\nusing static N.Tools.Text;\n", {("System.Linq", "using"), ("N.Tools.Text", "using")}, {"N/Tools.cs"}),
    ("k/A.kt", "import k.B\nimport k.c.D as E\n", {("k.B", "import"), ("k.c.D", "import")}, {"k/B.kt"}),
    ("rb/a.rb", "require 'json'\nrequire_relative 'b'\n# require 'no'\n", {("json", "require"), ("b", "require")}, {"rb/b.rb"}),
    ("lua/a.lua", "local x = require('m.n') -- require('z')\n", {("m.n", "require")}, {"m/n.lua"}),
    ("sh/a.sh", "source ./b.sh\n. c.sh\n", {("./b.sh", "source"), ("c.sh", "source")}, {"sh/b.sh"}),
    ("d/a.dart", "import 'dart:io';\nimport 'b.dart';\n", {("dart:io", "import"), ("b.dart", "import")}, {"d/b.dart"}),
    ("hs/A.hs", "import qualified Data.Map as M\nimport My.Mod\n", {("Data.Map", "import"), ("My.Mod", "import")}, {"My/Mod.hs"}),
    ("x/a.ex", "alias My.Thing\n", {("My.Thing", "import")}, {"lib/my/thing.ex"}),
    ("p/a.pl", "use strict;\nuse My::Mod;\n", {("strict", "use"), ("My::Mod", "use")}, {"lib/My/Mod.pm"}),
    ("s/a.sol", "import {A} from './b.sol';\n", {("./b.sol", "import")}, {"s/b.sol"}),
    ("z/a.zig", "const b = @import(\"b.zig\");\n", {("b.zig", "import")}, {"z/b.zig"}),
    ("cl/a.clj", "(ns a (:require [my.lib-one :as l]))\n", {("my.lib-one", "require")}, {"src/my/lib_one.clj"}),
    ("bad.py", "import os\ndef (:\n", set(), set()),
]


def test_imports_of_every_language(spark):
    present = {x[0] for x in IMPORTS} | {t for x in IMPORTS for t in x[3]} | {"lib/One.txt", "other/User.php"}
    texts = {x[0]: x[1] for x in IMPORTS}
    known = extract.facts(of(spark, [(p, texts.get(p, "")) for p in sorted(present)])).cache()
    raw, found = {}, {}
    for r in extract.raw_imports(known).collect():
        raw.setdefault(r["path"], set()).add((r["spec"], r["kind"]))
    for r in extract.resolve_imports(known).collect():
        found.setdefault(r["src"], set()).add(r["dst"])
    for name, _, specs, targets in IMPORTS:
        assert raw.get(name, set()) == specs, name
        assert found.get(name, set()) == targets, name
    external = {r["spec"] for r in extract.external_imports(known).collect()}
    assert {"os", "json", "java.util.List", "fmt", "System.Linq", "stdio.h", "strict"} <= external and "com.other.Thing" not in external
    bound = extract.symbol_bindings(known)
    names = {(r["path"], r["symbol"], r["dst"]) for r in bound.collect()}
    assert {("pkg/a.py", "h", "pkg/b.py"), ("pkg/a.py", "f", "pkg/b.py"), ("pkg/a.py", "*", "pkg/c.py"), ("web/x.ts", "V", "web/y.ts"), ("web/x.ts", "D", "web/y.ts"), ("web/x.ts", "c", "web/w.js"), ("web/x.ts", "Z", "web/z/index.ts"), ("app/a.php", "Deux", "lib/Two.php")} <= names
    assert ("pkg/a.py", "g", "pkg/b.py") not in names and ("web/x.ts", "U", "web/y.ts") not in names and ("web/x.ts", "b", "web/w.js") not in names
    refs = extract.cross_refs(bound, known)
    used = {(r["path"], r["symbol"]) for r in refs.collect()}
    assert {("pkg/a.py", "h"), ("pkg/a.py", "*"), ("web/x.ts", "V"), ("web/x.ts", "Z")} <= used and ("pkg/a.py", "f") not in used
    unused = {(r["src"], r["dst"]) for r in extract.unused_imports(known, extract.resolve_imports(known), bound, refs).collect()}
    assert ("pkg/a.py", "top.py") in unused and ("web/x.ts", "web/w.js") in unused and ("pkg/a.py", "pkg/b.py") not in unused and ("pkg/a.py", "pkg/c.py") not in unused
    assert not any(src.endswith(".java") for src, _ in unused)
    calls = {(r["src"], r["symbol"], r["member"], r["kind"]) for r in extract.call_targets(bound, known).collect()}
    assert {
        ("pkg/a.py", "h", "h", "call"), ("web/x.ts", "V", "V", "call"), ("web/x.ts", "Z", "go", "call"), ("web/x.ts", "D", "D", "instantiate"), ("web/x.ts", "Z", "prop", "attribute"),
        ("src/main/java/com/ex/A.java", "User", "save", "call"), ("src/main/java/com/ex/A.java", "User", "User", "instantiate"), ("src/main/java/com/ex/A.java", "User", "user", "inject"),
        ("app/a.php", "User", "User", "extends"), ("app/a.php", "User", "find", "static_call"), ("app/a.php", "Deux", "LIMIT", "static_prop"),
    } <= calls
    assert ("web/x.ts", "D", "D", "call") not in calls
    assert {r["path"]: r["purpose"] for r in extract.purpose(known).collect()}["pkg/a.py"] == "What a does."


EXPORTS = [
    ("a.py", "X = 1\ny: int = 2\nclass A: pass\nasync def f(): pass\ndef _g(): pass\n", {("var", "X"), ("var", "y"), ("class", "A"), ("fn", "f")}),
    ("a.ts", "export default class A {}\nexport async function f() {}\nexport const c = 1\nexport interface I {}\nexport default run;\n// export const no = 1", {("class", "A"), ("fn", "f"), ("var", "c"), ("interface", "I"), ("default", "run")}),
    ("A.java", "public class A {\n  public static int add(int a) { }\n}\ninterface I {}", {("class", "A"), ("fn", "add"), ("class", "I")}),
    ("server.go", "type Server struct {\n}\ntype Doer interface {\n}\nfunc NewServer() {}\nfunc (s *Server) Run() {}\nfunc low() {}", {("class", "Server"), ("class", "Doer"), ("fn", "NewServer")}),
    ("app.rs", "mod db;\npub struct App {}\npub enum Mode {}\npub trait Run {}\npub fn create() {}\nfn no() {}", {("mod", "db"), ("class", "App"), ("class", "Mode"), ("class", "Run"), ("fn", "create")}),
    ("a.php", "class A {}\ninterface B {}\ntrait C {}\nfunction d() {}", {("class", "A"), ("class", "B"), ("trait", "C"), ("fn", "d")}),
    ("a.rb", "module M\nclass A\ndef f\nend", {("mod", "M"), ("class", "A"), ("fn", "f")}), ("a.kt", "data class A(val x: Int)\nobject B\nfun f() {}", {("class", "A"), ("class", "B"), ("fn", "f")}),
    ("a.c", "struct s {\n};\nint main(int a) {\n}", {("class", "s"), ("fn", "main")}), ("a.cs", "namespace N\npublic class A {\npublic void F() {}\n}", {("mod", "N"), ("class", "A"), ("fn", "F")}),
    ("a.ex", "defmodule My.Mod do\n  def f(x)\nend", {("mod", "My.Mod"), ("fn", "f")}), ("a.r", "f <- function(x) x", {("fn", "f")}), ("a.sol", "contract C { function f() public {} }", {("class", "C"), ("fn", "f")}),
]


def test_exports_of_every_language(spark):
    got = {}
    for r in extract.exports(extract.facts(of(spark, [x[:2] for x in EXPORTS]))).collect():
        got.setdefault(r["path"], set()).add((r["kind"], r["name"]))
    for name, _, want in EXPORTS:
        assert got.get(name, set()) == want, name


def test_rules_without_names_count_apart(spark):
    nodes, edges = graph_of(spark, ("a", "b"), ("b", "c"))
    two = [{"type": "no_dependency", "from": "a", "to": "b"}, {"type": "no_dependency", "from": "b", "to": "c"}, {"type": "max_dependencies"}]
    got = rules.rule_summary(nodes, edges, two).first()
    assert (got["checked"], got["passed"], got["n_warning"]) == (3, 1, 2)
    ring = [(str(i), str((i + 1) % 6)) for i in range(6)]
    nodes, edges = graph_of(spark, *ring)
    assert rules.max_cycle_size(nodes, edges, {"type": "max_cycle_size", "max": 5}).count() == 1
    assert graph.cycle_edges(edges).count() == 6 and graph.detect_cycles(edges).count() == 1 and graph.short_cycles(edges).count() == 0 and graph.short_cycles(edges, 6).first()["bound"] == 6


def test_refresh_twice_changes_nothing(spark):
    now = of(spark, [("a.py", "1"), ("b.py", "2")])
    old = spark.createDataFrame([("r", "a.py", "0"), ("r", "gone.py", "0")], "repo_id string, path string, sha256 string")
    first = corpus.incremental_refresh(now, old)
    assert {r["path"]: r["status"] for r in first.collect()} == {"a.py": "changed", "b.py": "new"}
    assert corpus.changed_files(now, first).count() == 0 and corpus.stale_entries(now, old).count() == 1


def test_scan_and_lines(spark):
    rows = [("src/a.PY", "x\ny"), ("node_modules/b.js", ""), ("lib/c.min.js", ""), ("d.bin", ""), ("e.go", "a\n")]
    kept = corpus.scan_files(of(spark, rows))
    assert {r["path"] for r in kept.collect()} == {"src/a.PY", "e.go"}
    assert {r["path"]: r["n_lines"] for r in corpus.line_count(of(spark, rows)).collect()} == {"src/a.PY": 2, "node_modules/b.js": 0, "lib/c.min.js": 0, "d.bin": 0, "e.go": 1}
    assert corpus.dominant_language(of(spark, [("x.bin", "")])).first()["language"] == "python"
    assert corpus.dominant_language(of(spark, [("x.go", ""), ("y.java", "")])).first()["language"] == "go"
    for paths, first in ((("x.js", "y.java"), "java"), (("x.cpp", "y.c"), "c"), (("x.cs", "y.c"), "c")):  # one name begins the other
        assert corpus.dominant_language(of(spark, [(p, "") for p in paths])).first()["language"] == first


def test_history_limits(spark):
    commits = spark.range(700).select(F.lit("r").alias("repo_id"), F.col("id").alias("hash"), (F.col("id") % 3).alias("author"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit("m" * 100).alias("message"))
    assert history.newest(commits).count() == 500
    assert sum(r["commits"] for r in history.weekday_activity(commits).collect()) == 500 and history.weekday_activity(commits).count() == 7
    assert history.monthly_activity(commits).count() == 12
    assert history.recent_commits(commits).first()["message"] == "m" * 80
    assert history.contributors(commits).first()["contributors"] == 3


def test_project_profile(spark):
    rows = [("sub/pom.xml", "<artifactId>x</artifactId>"), ("package.json", '{"name":"n","version":"1","description":"d","dependencies":{"react":"1","pg":"postgres"}}'), ("index.js", ""), ("core/a", ""), ("api/b", "")]
    got = project.tech_stack(of(spark, rows)).first()
    assert (got["language"], got["build_tool"], got["frameworks"], got["databases"], got["project_type"]) == ("javascript", "npm/yarn/pnpm", "PostgreSQL,React", "PostgreSQL", "frontend")
    meta = project.project_metadata(of(spark, rows)).first()
    assert (meta["name"], meta["version"], meta["description"]) == ("n", "1", "d")
    assert project.detect_architecture(of(spark, rows)).first()["architecture"] == "component_based"
    assert [r["path"] for r in project.entry_points(of(spark, rows)).collect()] == ["index.js"]


def test_project_by_structure(spark):
    def one(op, *rows):
        return op(of(spark, [(p, c) for p, c in rows])).first()

    assert one(project.build_files, (".github/workflows/ci.yml", ""), ("docs/x", ""))["build_tool"] == "GitHub Actions"
    assert one(project.build_files, ("deploy/k8s/a.yml", ""), ("a/b/pom.xml", ""))["build_tool"] == "Kubernetes" and project.build_files(of(spark, [("a/b/pom.xml", "")])).count() == 0
    assert one(project.tech_stack, ("manage.py", ""), ("config.py", "redis://"))["frameworks"] == "Django"
    assert one(project.tech_stack, ("src/a/App.java", "@SpringBootApplication"), ("pom.xml", "<x/>"))["project_type"] == "java_backend"
    assert one(project.tech_stack, ("lib/a.csproj", ""))["project_type"] == "dotnet_backend" and one(project.tech_stack, ("x/b.vue", ""))["project_type"] == "frontend"
    assert one(project.detect_databases, (".env", "DB=postgres://"))["database"] == "PostgreSQL"
    assert one(project.detect_architecture, ("domain/a", ""), ("application/b", ""), ("infrastructure/c", ""))["architecture"] == "ddd"
    assert one(project.detect_architecture, ("x/a", ""))["architecture"] == "simple_layered" and one(project.detect_architecture, ("package.json", '"svelte"'))["architecture"] == "unknown"
    assert one(project.entry_points, ("src/main/java/x/Y.java", ""))["path"] == "src/main/java"


def test_branches_and_tags(spark):
    commits = spark.createDataFrame([("r", 1, "a", None, "m")], "repo_id string, hash int, author string, ts timestamp, message string")
    refs = spark.createDataFrame([("r", "branch", "main"), ("r", "branch", "dev"), *(("r", "tag", f"v{i:02}") for i in range(12))], "repo_id string, kind string, name string")
    got = history.repo_basics(commits, refs).first()
    assert got["branches"] == 2 and got["tags"] == [f"v{i:02}" for i in range(10)]


def test_prompts_leave_out_what_is_described(spark):
    got = corpus.prompt_table(of(spark, [("a.py", "x\n"), ("b.py", "y" * 9000)]), described=spark.createDataFrame([("r", "a.py")], "repo_id string, path string")).collect()
    assert [r["path"] for r in got] == ["b.py"] and got[0]["prompt"].startswith("File: b.py\nLanguage: python\nLines: 1\n") and got[0]["prompt"].endswith("... (truncated)")


def test_read_tree_and_write_report(spark, tmp_path):
    (tmp_path / "in/repo/src").mkdir(parents=True)
    (tmp_path / "in/repo/src/a.py").write_text("é = 1\n")
    got = readers.read_corpus(spark, f"file://{tmp_path}/in").collect()
    assert [tuple(r) for r in got] == [("repo", "src/a.py", "é = 1\n")]
    nodes, edges = graph_of(spark, ("a", "b"))
    layers = graph.assign_layers(nodes, edges)
    sinks.report_json(sinks.node_records(nodes, edges, layers), f"file://{tmp_path}/out")
    full = extract.facts(of(spark, [("a", "x\n"), ("b", "")]))
    records = sinks.node_records(nodes, edges, layers, full, full.select("repo_id", "path", F.lit("b").alias("dst"), F.lit("s").alias("symbol")), unused=edges)
    first = records.where("path = 'a'").first()
    assert (first["lines"], first["exports"], first["cross_refs"], first["unused_imports"]) == (1, [], {"b": ["s"]}, ["b"])
    back = spark.read.json(f"file://{tmp_path}/out").orderBy("path").collect()
    assert [(r["path"], r["imports"], r["imported_by"], r["layer"]) for r in back] == [("a", ["b"], [], "common"), ("b", [], ["a"], "foundation")]


def test_no_contents_in_exchanges(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    some = of(spark, [("a.py", "from b import c\n"), ("b.py", "")])
    text = plan(extract.resolve_imports(extract.facts(some)))
    assert all("content" not in line for line in text.splitlines() if "Exchange" in line)
    for one_pass in (security.security_scan, endpoints.endpoints, models.orm_models, quality.file_quality):
        text = plan(one_pass(some))
        assert "Exchange" not in text and text.count("MapInArrow") == 1
