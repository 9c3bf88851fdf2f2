"""A source-code corpus derived from the given tables, so that work grows with them.

Files come from parts, imports from parts that are ordered together, commits from orders. The same corpus is given as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage

DIRS = ("util", "domain", "service", "api", "core", "web", "model")
EXTS = ("py", "js", "java", "go", "php", "ts", "rb", "cs", "rs")

#: Bodies by extension; p_size picks one. All credentials are invented.
BODIES = {
    "py": (
        "# helper module\nimport pickle\n\ndef load(data):\n    if data and len(data) > 3:\n        return pickle.loads(data)\n    return None\n",
        "from flask import Flask\napp = Flask(__name__)\n\n@app.route('/items', methods=['GET', 'POST'])\ndef items():\n    return []\n\n@app.get('/items/one')\ndef one():\n    return 1\n",
        "class Account(models.Model):\n    name = models.CharField(max_length=40)\n    owner = models.ForeignKey('User', on_delete=models.CASCADE)\n\n    class Meta:\n        db_table = 'accounts'\n",
        "DEBUG = True\nAPI_KEY = 'Zk3v9Qw8Lm2xT7pR5sY1'\n# settings\n\n\nurlpatterns = [path('home/', views.home), path('about/', views.about)]\n",
        "import subprocess\n\nclass Runner:\n    def run(self, cmd):\n        for c in cmd:\n            while c:\n                subprocess.run(c, shell=True)\n\n\ndef _hidden():\n    pass\n",
        "from .base import Base, db as store\nimport os, json as j\n\nclass Order(Base):\n    __tablename__ = 'orders'\n    id = Column(Integer, primary_key=True)\n    owner_id = Column(Integer, ForeignKey('owners.id'), nullable=False)\n    lines = relationship('Line')\n\n\nclass Line(Base):\n    note = Column(String(40))\n",
        "import yaml\n\n@router.head('/files', tags=['x'])\nasync def files(a: int = 1):\n    ok = yaml.load(a, Loader=yaml.SafeLoader)\n    return yaml.load(a) if a and ok or a == 2 else None\n\n\npassword = 'correct-horse'\npasswd = 'changeme-now'\n",
        "def query(cur, name):\n    cur.execute(f\"SELECT * FROM t WHERE n = '{name}'\")\n    digest = hashlib.md5(name)\n    return yaml.load(name)\n",
    ),
    "js": (
        "// server\nconst app = express();\napp.get('/users', listUsers);\napp.post('/users', addUser);\n/* routes\n   end */\nexport function start(port) {\n  if (port > 0 && port < 9) { return port; }\n}\n",
        "export class View {\n  draw(x) {\n    this.el.innerHTML = x;\n    return x ? 1 : 2;\n  }\n}\nexport const size = 3;\n",
        "const User = sequelize.define('User', {\n  name: { type: DataTypes.STRING },\n});\nexport default User;\n",
        "import './setup.css';\nconst { Schema } = require('mongoose');\nconst pages = () => import('./pages');\nconst Note = new Schema({\n  body: { type: String, required: true },\n  owner: { type: ObjectId, ref: 'User' },\n});\nexport default Note;\n",
        "import React, { useState as state } from 'react';\nexport * from './parts';\nexport const Panel = (p) => { return p.a || p.b ? crypto.createHash('md5') : null; };\nrouter.patch(`/panel`, save);\n",
        "const password = 'hunter2secret';\nrouter.use('/admin', guard);\nfunction guard() { return true; }\n",
    ),
    "java": (
        "package app;\n\n@RestController\n@RequestMapping(\"/api\")\npublic class Orders {\n    @GetMapping(\"/list\")\n    public String list() { return \"\"; }\n    @PostMapping(\"/add\")\n    public String add() { return \"\"; }\n}\n",
        "package app;\n\n@Entity\n@Table(name = \"people\")\npublic class Person {\n    @Id\n    private Long id;\n    @Column(length = 30)\n    private String name;\n}\n",
        "package app;\n\nimport java.util.List;\nimport static org.junit.Assert.assertTrue;\nimport app.base.*;\n\n@Path(\"/v1\")\npublic class Feed extends Base implements Source {\n    @GET\n    @Path(\"/feed\")\n    public List<String> feed() {\n        String q = \"SELECT a FROM t WHERE b = \" + b;\n        return statement.executeQuery(q);\n    }\n    @DeleteMapping\n    public void clear() {\n        ObjectInputStream in = null;\n    }\n    @RequestMapping(method = RequestMethod.PUT, value = \"/put\")\n    public void put(int a, int b) {\n        for (int i = 0; i < a && i < b; i++) { run(); }\n    }\n}\n",
        "package app;\n\npublic class Store {\n    // reads\n    public int read(int a) {\n        if (a > 1 || a < -1) { return a; } else if (a == 0) { return 1; }\n        MessageDigest.getInstance(\"MD5\");\n        return 0;\n    }\n}\n",
    ),
    "go": (
        "package main\n\n// Server state\ntype Server struct {\n\tName string\n}\n\nfunc NewServer(n string) *Server {\n\tif n == \"\" {\n\t\treturn nil\n\t}\n\treturn &Server{n}\n}\n",
        "package main\n\nimport (\n\t\"fmt\"\n\tlog \"project/logger\"\n)\n\ntype Reader interface {\n\tRead() int\n}\n\nfunc Run(n int) int {\n\tfor n > 1 && n < 9 {\n\t\tn--\n\t}\n\tfmt.Println(n)\n\treturn n\n}\n",
        "package main\n\nfunc routes(r *gin.Engine) {\n\tr.GET(\"/ping\", ping)\n\tr.POST(\"/send\", send)\n}\n",
        "package main\n\ntype User struct {\n\tgorm.Model\n\tEmail string `gorm:\"size:90\"`\n}\n",
    ),
    "php": (
        "<?php\n// page\necho $_GET['q'];\n$r = mysqli_query($c, \"SELECT $q\");\nclass Page extends Base {\n  public function show($a) { if ($a) { return 1; } }\n}\n",
        "<?php\nRoute::get('/shop', 'ShopController@index');\nRoute::post('/shop', 'ShopController@store');\n$v = unserialize($data);\n",
        "<?php\nnamespace App;\nuse Lib\\Tool;\nuse Lib\\{One, Two as Deux};\n#[Route('/list', methods: ['GET', 'POST'])]\nfunction listing() { return shell_exec('ls'); }\nRoute::resource('photos', PhotoController::class);\nini_set('display_errors', 1);\ntrait Marks { }\ninterface Shape { }\n",
        "<?php\nclass Book extends Model {\n  protected $table = 'books';\n  protected $fillable = ['title', 'year'];\n}\n",
    ),
    "ts": (
        "@Controller('cats')\nexport class CatsController {\n  @Get('all')\n  findAll() { return []; }\n}\n",
        "@Entity('photos')\nexport class Photo {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column()\n  title: string;\n}\n",
        "// token holder\nexport interface Box { id: number }\nexport const token = 'ghp_abcdefghijklmnopqrstuvwxyz0123456789';\nexport function pick(a) { return a ?? 1; }\n",
    ),
    "rb": (
        "require 'json'\n\nmodule Shop\n  class Cart < ApplicationRecord\n    def total(x)\n      if x > 1\n        while x > 2\n          x -= 1\n        end\n      end\n      x\n    end\n  end\nend\n",
        "# routes\nget '/carts', to: 'carts#index'\npost '/carts', to: 'carts#create'\n\n\ndef helper\n  1\nend\n",
    ),
    "cs": (
        "using System.Linq;\n\nnamespace Shop\n{\n    [Route(\"api/items\")]\n    public class ItemsController\n    {\n        [HttpGet]\n        public List<Item> All() {\n            return items;\n        }\n        [HttpPost(\"add\")]\n        public Item Add(Item a, int n) {\n            if (n > 1 && n < 5) { return a; }\n            return null;\n        }\n        public override string ToString() {\n            return \"\";\n        }\n    }\n}\n",
        "using static System.Math;\n\npublic interface IShape { }\npublic enum Kind { A, B }\n",
    ),
    "rs": (
        "use std::fmt;\nuse crate::base::{One, Two};\nuse super::shared::Thing;\n\nmod parts;\n\npub struct App {\n    name: String,\n}\n\npub trait Run {\n    fn run(&self);\n}\n\npub fn create(n: u8) -> App {\n    App { name: String::new() }\n}\n",
        "// plain\npub enum Mode { A, B }\npub async fn later() {}\nfn hidden() {}\n",
    ),
}


#: What stands in a file for each import ({n}: the imported part), with comments, strings and names that hide the import's; and
#: what is added if the import is used.
USES = {
    "py": ("# f{n}(0)\nnote{n} = \"f{n}(1) # f{n}.x\"\ndef hide{n}(f{n}):\n    return f{n}(2) or f{n}.y\n\nkeep{n} = [f{n} for f{n} in note{n} if f{n}(3)]\n", "f{n}.run(4)\nprint(f{n}.Size)\n"),
    "js": ("// f{n}(0)\n/* f{n}(1) */\nconst re{n} = /f{n}(4)\\/\\/ f{n}.z/;\n", "const note{n} = `f{n}(2) http://x ${f{n}.run(3)} f{n}.y`;\n"),
    "java": (
        "class V{n} {\n    // m{n}.fake(0);\n    /* m{n}.fake(1); */\n    String s = \"m{n}.text(2) // no\";\n}\n",
        "class U{n} {\n    private m{n} held{n};\n    @Autowired\n    public U{n}(final m{n} given{n}, Other other) { given{n}.start(2); }\n"
        "    void go() { held{n}.run(3); String s = \"m{n}.text(4)\"; m{n} made = new m{n}(); made.stop(); }\n    void hidden(String held{n}) { held{n}.run(5); }\n}\n",
    ),
    "php": ("// m{n}::fake(0);\n# m{n}::fake(1);\n$t{n} = <<<TXT\nm{n}::text(2); // no\nTXT;\n$s{n} = 'm{n}::text(3) # no';\n", "m{n}::run(4);\n"),
    "rs": ("/* m{n}::fake(0); /* m{n}::fake(1); */ m{n}::fake(2); */\nlet s{n} = r#\"m{n}::text(3) // \" \"#;\n", "m{n}::run(4);\n"),
    "go": ("// m{n}.fake(0)\nvar s{n} = `m{n}.text(1) // \"`\n", "func g{n}() { m{n}.Run(2) }\n"),
    "rb": ("# m{n}.fake(0)\n=begin\nm{n}.fake(1)\n=end\ns{n} = <<~TXT\n  m{n}.text(2) # no\nTXT\n", "m{n}.run(3)\n"),
    "cs": ("// m{n}.fake(0);\nvar s{n} = @\"m{n}.text(1); // no \\\";\n", "m{n}.Run(2);\n"),
}
USES["ts"] = USES["js"]

#: By extension the comments of USES, as patterns.
USE_COMMENTS = {
    "py": r"# f\d+\(0\)", "js": r"// f\d+\(0\)|/\* f\d+\(1\) \*/", "ts": r"// f\d+\(0\)|/\* f\d+\(1\) \*/", "java": r"// m\d+\.fake\(0\);|/\* m\d+\.fake\(1\); \*/",
    "php": r"// m\d+::fake\(0\);|# m\d+::fake\(1\);", "rs": r"/\* m\d+::fake\(0\); /\* m\d+::fake\(1\); \*/ m\d+::fake\(2\); \*/", "go": r"// m\d+\.fake\(0\)",
    "rb": r"# m\d+\.fake\(0\)|=begin\nm\d+\.fake\(1\)\n=end", "cs": r"// m\d+\.fake\(0\);",
}

#: By extension member and kind of the uses that count, one each.
USE_SITES = {
    "py": (("run", "call"), ("Size", "class_usage")), "js": (("run", "call"),), "ts": (("run", "call"),), "php": (("run", "static_call"),), "rs": (("run", "static_call"),),
    "java": (("given{n}", "inject"), ("start", "call"), ("run", "call"), ("m{n}", "instantiate"), ("stop", "call")), "go": (("Run", "call"),), "rb": (("run", "call"),), "cs": (("Run", "call"),),
}


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, repo_id, dir, ext, path of every file."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    named = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    rows = part.select(
        F.col("p_partkey").alias("key"), (F.col("p_partkey") % 10).alias("repo_id"), named(DIRS, F.col("p_size") % 7).alias("dir"),
        named(EXTS, F.col("p_partkey") % len(EXTS)).alias("ext"), F.col("p_size").alias("size"),
    )
    return rows.withColumn("path", F.concat(F.lit("src/"), "dir", F.lit("/m"), F.col("key").cast("string"), F.lit("."), "ext"))


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst keys of one repository: the larger part of an order imports the smaller; some edges are turned round as well, and
    some paths of two edges are closed, which gives cycles. What all of these start from is written once."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").alias("k"))
    a, b = line.withColumnRenamed("k", "src"), line.withColumnRenamed("k", "dst")
    forward = stage(a.join(b, "l_orderkey").where("src > dst and src % 10 = dst % 10").select("src", "dst").distinct())
    back = forward.where("(src + dst) % 25 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    two = forward.select("src", F.col("dst").alias("mid")).join(forward.select(F.col("src").alias("mid"), "dst"), "mid")
    closing = two.where("(src + dst) % 25 = 4").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forward.union(back).union(closing).distinct()


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key_edges in a table, for queries that need edges and files."""
    return stage(key_edges(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """repo_id, src, dst paths. keys: ``keys``, if they are there."""
    files = part_files(spark, sf_dir)
    ends = lambda side: files.select(F.col("key").alias(side), F.col("path").alias(f"{side}_path"))
    found = (key_edges(spark, sf_dir) if keys is None else keys).join(ends("src"), "src").join(ends("dst"), "dst")
    return found.select((F.col("src") % 10).alias("repo_id"), F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))


def _import_lines(spark: SparkSession, sf_dir: str, parts: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """src, dst, ext and line: the import line of each edge between files of one language."""
    target = parts.select(F.col("key").alias("dst"), F.col("dir").alias("to_dir"), F.col("ext").alias("to_ext"))
    own = parts.select(F.col("key").alias("src"), "ext")
    same = (key_edges(spark, sf_dir) if keys is None else keys).join(own, "src").join(target, "dst").where("ext = to_ext")
    name = F.concat(F.lit("m"), F.col("dst").cast("string"))
    f = F.concat(F.lit("f"), F.col("dst").cast("string"))
    number = F.col("dst").cast("string")
    a, b, way = F.concat(F.lit("a"), number), F.concat(F.lit("b"), number), (F.col("src") + F.col("dst")) % 4
    beside = F.concat(F.lit("'../"), "to_dir", F.lit("/"), name, F.lit("'"))
    ways = {
        "py": (
            F.concat(F.lit("from src."), "to_dir", F.lit("."), name, F.lit(" import "), f), F.concat(F.lit("from src."), "to_dir", F.lit("."), name, F.lit(" import "), a, F.lit(", "), f),
            F.concat(F.lit("import src."), "to_dir", F.lit("."), name, F.lit(" as "), f), F.concat(F.lit("from src."), "to_dir", F.lit("."), name, F.lit(" import "), b, F.lit(" as "), f),
        ),
        "js": (
            F.concat(F.lit("import { "), f, F.lit(" } from "), beside, F.lit(";")), F.concat(F.lit("import { "), a, F.lit(", "), b, F.lit(" as "), f, F.lit(" } from "), beside, F.lit(";")),
            F.concat(F.lit("const "), f, F.lit(" = require("), beside, F.lit(");")), F.concat(F.lit("import * as "), f, F.lit(" from "), beside, F.lit(";")),
        ),
        "java": (F.concat(F.lit("import src."), "to_dir", F.lit("."), name, F.lit(";")),),
        "go": (F.concat(F.lit("import \"src/"), "to_dir", F.lit("/"), name, F.lit("\"")), F.concat(F.lit("import (\n\t\"src/"), "to_dir", F.lit("/"), name, F.lit("\"\n)"))),
        "php": (F.concat(F.lit("require_once "), F.replace(beside, name, F.concat(name, F.lit(".php"))), F.lit(";")), F.concat(F.lit("use src\\"), "to_dir", F.lit("\\"), name, F.lit(";"))),
        "rb": (F.concat(F.lit("require_relative "), beside),),
        "cs": (F.concat(F.lit("using src."), "to_dir", F.lit("."), name, F.lit(";")),),
        "rs": (F.concat(F.lit("use crate::"), "to_dir", F.lit("::"), name, F.lit(";")),),
    }
    ways["ts"] = ways["js"]
    line = F.coalesce(*(F.when((F.col("ext") == e) & (way % len(lines) == i), text) for e, lines in ways.items() for i, text in enumerate(lines)))
    return same.select("src", "dst", "ext", line.alias("line"))


def files(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """repo_id, path, content. keys: ``keys``, if they are there."""
    parts = part_files(spark, sf_dir)
    same = _import_lines(spark, sf_dir, parts, keys)
    name, f = F.concat(F.lit("m"), F.col("dst").cast("string")), F.concat(F.lit("f"), F.col("dst").cast("string"))
    call = F.when(F.col("ext").isin("py", "js", "ts"), F.concat(f, F.lit("(1);"))).when(F.col("ext").isin("php", "rs"), F.concat(name, F.lit("::run(1);"))).otherwise(F.concat(name, F.lit(".run(1);")))
    use = F.when((F.col("src") + F.col("dst")) % 3 == 0, call)
    texts = same.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "line"))).alias("l"), F.array_sort(F.collect_list(F.when(use.isNotNull(), F.struct("dst", use.alias("use"))))).alias("u"))
    texts = texts.select(
        F.col("src").alias("key"), F.concat(F.array_join("l.line", "\n"), F.lit("\n")).alias("head"), F.when(F.size("u") > 0, F.concat(F.array_join("u.use", "\n"), F.lit("\n"))).otherwise("").alias("tail")
    )
    bodies = spark.createDataFrame([(e, i, len(bs), b) for e, bs in BODIES.items() for i, b in enumerate(bs)], "ext string, turn int, turns int, body string")
    # a table of fixed size
    chosen = parts.join(F.broadcast(bodies), (parts["ext"] == bodies["ext"]) & (parts["size"] % F.col("turns") == F.col("turn"))).select("key", "repo_id", "path", "body")
    return chosen.join(texts, "key", "left").select("repo_id", "path", F.concat(F.coalesce("head", F.lit("")), "body", F.coalesce("tail", F.lit(""))).alias("content"))


def use_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, content of files that are made of imports and USES of them."""
    parts = part_files(spark, sf_dir)
    lines = _import_lines(spark, sf_dir, parts)

    def text(i: int):
        return F.coalesce(*(F.when(F.col("ext") == e, F.replace(F.lit(u[i]), F.lit("{n}"), F.col("dst").cast("string"))) for e, u in USES.items()))

    said = F.concat(text(0), F.when((F.col("src") + F.col("dst")) % 3 == 0, text(1)).otherwise(""))
    texts = lines.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "line", said.alias("said")))).alias("l"))
    texts = texts.select(F.col("src").alias("key"), F.concat(F.array_join("l.line", "\n"), F.lit("\n"), F.array_join("l.said", "")).alias("content"))
    return parts.join(texts, "key", "left").select("repo_id", "path", F.coalesce("content", F.lit("")).alias("content"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        (F.col("o_custkey") % 10).alias("repo_id"), F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"),
        F.col("o_orderdate").alias("ts"), F.concat("o_orderpriority", F.lit(" change "), F.repeat(F.lit("of the ledger "), 8)).alias("message"),
    )


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(F.col("l_orderkey").alias("hash"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("file"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values() -> str:
    return ", ".join(f"('{e}', {i}, {len(bs)}, {_quoted(b)})" for e, bs in BODIES.items() for i, b in enumerate(bs))


_LIST = lambda names: "[" + ", ".join(map(_quoted, names)) + "]"

#: Common table expressions part_files, key_edges and edges.
GRAPH_SQL = f"""
part_files AS (
  SELECT *, 'src/' || dir || '/m' || key || '.' || ext AS path FROM (
    SELECT p_partkey AS key, p_partkey % 10 AS repo_id, {_LIST(DIRS)}[p_size % 7 + 1] AS dir, {_LIST(EXTS)}[p_partkey % {len(EXTS)} + 1] AS ext, p_size AS size FROM part)),
lines_ AS (SELECT l_orderkey, l_partkey AS k FROM lineitem),
forward_ AS (SELECT DISTINCT a.k AS src, b.k AS dst FROM lines_ a JOIN lines_ b USING (l_orderkey) WHERE a.k > b.k AND a.k % 10 = b.k % 10),
key_edges AS (
  SELECT src, dst FROM forward_ UNION SELECT dst, src FROM forward_ WHERE (src + dst) % 25 = 0
  UNION SELECT b.dst, a.src FROM forward_ a JOIN forward_ b ON a.dst = b.src WHERE (a.src + b.dst) % 25 = 4),
edges AS (SELECT e.src % 10 AS repo_id, a.path AS src, b.path AS dst FROM key_edges e JOIN part_files a ON e.src = a.key JOIN part_files b ON e.dst = b.key)
"""

#: Common table expression files; needs GRAPH_SQL.
FILES_SQL = f"""
bodies(ext, turn, turns, body) AS (VALUES {_values()}),
heads AS (
  SELECT e.src AS key,
    string_agg(CASE
      WHEN a.ext = 'py' THEN CASE (e.src + e.dst) % 4 WHEN 2 THEN 'import src.' || b.dir || '.m' || e.dst || ' as f' || e.dst
        ELSE 'from src.' || b.dir || '.m' || e.dst || ' import ' || CASE (e.src + e.dst) % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' || e.dst || ', ' ELSE 'b' || e.dst || ' as ' END || 'f' || e.dst END
      WHEN a.ext IN ('js', 'ts') THEN CASE (e.src + e.dst) % 4 WHEN 0 THEN 'import {{ f' || e.dst || ' }} from ' WHEN 1 THEN 'import {{ a' || e.dst || ', b' || e.dst || ' as f' || e.dst || ' }} from '
        WHEN 2 THEN 'const f' || e.dst || ' = require(' ELSE 'import * as f' || e.dst || ' from ' END || chr(39) || '../' || b.dir || '/m' || e.dst || chr(39) || CASE WHEN (e.src + e.dst) % 4 = 2 THEN ');' ELSE ';' END
      WHEN a.ext = 'java' THEN 'import src.' || b.dir || '.m' || e.dst || ';'
      WHEN a.ext = 'go' THEN CASE WHEN (e.src + e.dst) % 2 = 0 THEN 'import "src/' || b.dir || '/m' || e.dst || '"' ELSE 'import (' || chr(10) || chr(9) || '"src/' || b.dir || '/m' || e.dst || '"' || chr(10) || ')' END
      WHEN a.ext = 'rb' THEN 'require_relative ' || chr(39) || '../' || b.dir || '/m' || e.dst || chr(39)
      WHEN a.ext = 'cs' THEN 'using src.' || b.dir || '.m' || e.dst || ';'
      WHEN a.ext = 'rs' THEN 'use crate::' || b.dir || '::m' || e.dst || ';'
      WHEN (e.src + e.dst) % 2 = 0 THEN 'require_once ' || chr(39) || '../' || b.dir || '/m' || e.dst || '.php' || chr(39) || ';'
      ELSE 'use src\\' || b.dir || '\\m' || e.dst || ';' END, chr(10) ORDER BY e.dst) || chr(10) AS head,
    coalesce(string_agg(CASE WHEN (e.src + e.dst) % 3 = 0 THEN CASE WHEN a.ext IN ('py', 'js', 'ts') THEN 'f' || e.dst || '(1);' WHEN a.ext IN ('php', 'rs') THEN 'm' || e.dst || '::run(1);' ELSE 'm' || e.dst || '.run(1);' END END, chr(10) ORDER BY e.dst) || chr(10), '') AS tail
  FROM key_edges e JOIN part_files a ON e.src = a.key JOIN part_files b ON e.dst = b.key WHERE a.ext = b.ext GROUP BY e.src),
files AS (
  SELECT p.key, repo_id, path, p.ext, b.turn, body, coalesce(head, '') AS head, coalesce(head, '') || body || coalesce(tail, '') AS content
  FROM part_files p JOIN bodies b ON p.ext = b.ext AND p.size % b.turns = b.turn LEFT JOIN heads h ON p.key = h.key)
"""

#: Common table expression use_files; needs GRAPH_SQL and FILES_SQL (its import lines).
USES_SQL = f"""
said(ext, always, used) AS (VALUES {', '.join(f'({_quoted(e)}, {_quoted(u[0])}, {_quoted(u[1])})' for e, u in USES.items())}),
tails AS (
  SELECT e.src AS key, string_agg(replace(always || CASE WHEN (e.src + e.dst) % 3 = 0 THEN used ELSE '' END, '{{n}}', e.dst::VARCHAR), '' ORDER BY e.dst) AS tail
  FROM key_edges e JOIN part_files a ON e.src = a.key JOIN part_files b ON e.dst = b.key JOIN said s ON s.ext = a.ext WHERE a.ext = b.ext GROUP BY e.src),
use_files AS (SELECT p.repo_id, p.path, p.ext, coalesce(h.head || t.tail, '') AS content FROM part_files p LEFT JOIN heads h USING (key) LEFT JOIN tails t USING (key))
"""

#: Common table expressions commits and commit_files.
HISTORY_SQL = """
commits AS (
  SELECT o_custkey % 10 AS repo_id, o_orderkey AS hash, o_custkey AS author, o_orderdate AS ts, o_orderpriority || ' change ' || repeat('of the ledger ', 8) AS message FROM orders),
commit_files AS (SELECT l_orderkey AS hash, 'm' || l_partkey AS file FROM lineitem)
"""
