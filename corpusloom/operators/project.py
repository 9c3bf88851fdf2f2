"""Profile of a repository from files(repo_id, path, content): build files, metadata, frameworks, databases, architecture, type.

Only files with known names are opened: names are filtered before contents are touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.corpus import basename

#: Build file or directory, project type, build tool, language.
BUILD_FILES = (
    ("pom.xml", "java", "Maven", "java"), ("build.gradle", "java", "Gradle", "java"), ("build.gradle.kts", "java", "Gradle Kotlin", "kotlin"), ("package.json", "node", "npm/yarn/pnpm", "javascript"),
    ("composer.json", "php", "Composer", "php"), ("requirements.txt", "python", "pip", "python"), ("setup.py", "python", "setuptools", "python"), ("setup.cfg", "python", "setuptools", "python"),
    ("pyproject.toml", "python", "pip/poetry", "python"), ("Pipfile", "python", "pipenv", "python"), ("Cargo.toml", "rust", "Cargo", "rust"), ("go.mod", "go", "Go Modules", "go"),
    ("CMakeLists.txt", "cpp", "CMake", "cpp"), ("Makefile", "generic", "Make", "c"), ("Gemfile", "ruby", "Bundler", "ruby"), ("Rakefile", "ruby", "Rake", "ruby"), ("build.sbt", "scala", "SBT", "scala"),
    ("mix.exs", "elixir", "Mix", "elixir"), ("rebar.config", "erlang", "Rebar", "erlang"), ("project.clj", "clojure", "Leiningen", "clojure"), ("Package.swift", "swift", "SwiftPM", "swift"),
    ("pubspec.yaml", "dart", "pub", "dart"), ("stack.yaml", "haskell", "Stack", "haskell"), ("cabal.project", "haskell", "Cabal", "haskell"), ("build.zig", "zig", "Zig Build", "zig"),
    ("Makefile.PL", "perl", "EUMM", "perl"), ("angular.json", "angular", "Angular CLI", "typescript"), ("next.config.js", "nextjs", "Next.js", "typescript"), ("next.config.mjs", "nextjs", "Next.js", "typescript"),
    ("next.config.ts", "nextjs", "Next.js", "typescript"), ("nuxt.config.js", "nuxt", "Nuxt.js", "typescript"), ("nuxt.config.ts", "nuxt", "Nuxt.js", "typescript"), ("svelte.config.js", "svelte", "SvelteKit", "typescript"),
    ("vite.config.js", "vite", "Vite", "javascript"), ("vite.config.ts", "vite", "Vite", "typescript"), ("webpack.config.js", "webpack", "Webpack", "javascript"), ("rollup.config.js", "rollup", "Rollup", "javascript"),
    ("tsconfig.json", "typescript", "TypeScript", "typescript"), ("Dockerfile", "docker", "Docker", "generic"), ("docker-compose.yml", "docker", "Docker Compose", "generic"),
    ("docker-compose.yaml", "docker", "Docker Compose", "generic"), (".drone.yml", "ci", "Drone CI", "generic"), (".github/workflows", "ci", "GitHub Actions", "generic"), (".gitlab-ci.yml", "ci", "GitLab CI", "generic"),
    ("Jenkinsfile", "ci", "Jenkins", "generic"), ("artisan", "laravel", "Artisan", "php"), ("symfony.lock", "symfony", "Symfony", "php"), ("manage.py", "django", "Django", "python"),
    ("alembic.ini", "python", "Alembic", "python"), ("migrations", "python", "Alembic/Django", "python"), ("ormconfig.json", "node", "TypeORM", "typescript"), ("prisma", "node", "Prisma", "typescript"),
    ("drizzle.config.ts", "node", "Drizzle", "typescript"), (".eslintrc.js", "node", "ESLint", "javascript"), (".eslintrc.json", "node", "ESLint", "javascript"), (".eslintrc.yaml", "node", "ESLint", "javascript"),
    (".prettierrc", "node", "Prettier", "javascript"), ("tailwind.config.js", "node", "Tailwind CSS", "javascript"), ("tailwind.config.ts", "node", "Tailwind CSS", "typescript"),
    ("postcss.config.js", "node", "PostCSS", "javascript"), ("babel.config.js", "node", "Babel", "javascript"), (".babelrc", "node", "Babel", "javascript"), ("jest.config.js", "node", "Jest", "javascript"),
    ("jest.config.ts", "node", "Jest", "typescript"), ("vitest.config.ts", "node", "Vitest", "typescript"), ("playwright.config.ts", "node", "Playwright", "typescript"), ("cypress.config.js", "node", "Cypress", "javascript"),
    ("cypress.config.ts", "node", "Cypress", "typescript"), ("nginx.conf", "infra", "Nginx", "generic"), ("nginx", "infra", "Nginx", "generic"), ("k8s", "infra", "Kubernetes", "generic"),
    ("kubernetes", "infra", "Kubernetes", "generic"), ("helm", "infra", "Helm", "generic"), ("terraform", "infra", "Terraform", "generic"), ("ansible", "infra", "Ansible", "generic"), ("Vagrantfile", "infra", "Vagrant", "generic"),
)

#: Root build file, keyword in its lower-cased text, framework. Plain libraries (of dates, colours, logging and the like) are
#: left to the caller, who may pass a longer table.
FRAMEWORKS = (
    ("pom.xml", "spring-boot", "Spring Boot"), ("pom.xml", "spring-cloud", "Spring Cloud"), ("pom.xml", "spring-security", "Spring Security"), ("pom.xml", "mybatis", "MyBatis"),
    ("pom.xml", "hibernate", "Hibernate"), ("pom.xml", "junit", "JUnit"), ("pom.xml", "thymeleaf", "Thymeleaf"), ("build.gradle", "spring-boot", "Spring Boot"), ("build.gradle", "spring-cloud", "Spring Cloud"),
    ("build.gradle", "ktor", "Ktor"), ("build.gradle", "kotlin", "Kotlin"), ("build.gradle", "android", "Android"), ("package.json", "react", "React"), ("package.json", "next", "Next.js"),
    ("package.json", "vue", "Vue.js"), ("package.json", "nuxt", "Nuxt.js"), ("package.json", "angular", "Angular"), ("package.json", "svelte", "Svelte"), ("package.json", "express", "Express"),
    ("package.json", "koa", "Koa"), ("package.json", "fastify", "Fastify"), ("package.json", "nestjs", "NestJS"), ("package.json", "electron", "Electron"), ("package.json", "react-native", "React Native"),
    ("package.json", "expo", "Expo"), ("package.json", "tailwindcss", "Tailwind CSS"), ("package.json", "typescript", "TypeScript"), ("package.json", "jest", "Jest"), ("package.json", "vitest", "Vitest"),
    ("package.json", "mocha", "Mocha"), ("package.json", "cypress", "Cypress"), ("package.json", "playwright", "Playwright"), ("package.json", "redux", "Redux"), ("package.json", "graphql", "GraphQL"),
    ("package.json", "apollo", "Apollo"), ("package.json", "vite", "Vite"), ("package.json", "webpack", "Webpack"), ("package.json", "prisma", "Prisma"), ("package.json", "typeorm", "TypeORM"),
    ("package.json", "sequelize", "Sequelize"), ("package.json", "mongoose", "Mongoose"), ("package.json", "mysql2", "MySQL"), ("package.json", "pg", "PostgreSQL"), ("package.json", "redis", "Redis"),
    ("package.json", "socket.io", "Socket.IO"), ("composer.json", "laravel", "Laravel"), ("composer.json", "symfony", "Symfony"), ("composer.json", "slim", "Slim"), ("composer.json", "laminas", "Laminas"),
    ("composer.json", "yii", "Yii"), ("composer.json", "cakephp", "CakePHP"), ("composer.json", "codeigniter", "CodeIgniter"), ("composer.json", "phpunit", "PHPUnit"), ("composer.json", "doctrine", "Doctrine"),
    ("requirements.txt", "django", "Django"), ("requirements.txt", "flask", "Flask"), ("requirements.txt", "fastapi", "FastAPI"), ("requirements.txt", "tornado", "Tornado"), ("requirements.txt", "aiohttp", "aiohttp"),
    ("requirements.txt", "sqlalchemy", "SQLAlchemy"), ("requirements.txt", "pydantic", "Pydantic"), ("requirements.txt", "pytest", "pytest"), ("requirements.txt", "celery", "Celery"),
    ("requirements.txt", "redis", "Redis"), ("requirements.txt", "pymongo", "MongoDB"), ("requirements.txt", "psycopg2", "PostgreSQL"), ("requirements.txt", "mysqlclient", "MySQL"),
    ("requirements.txt", "scrapy", "Scrapy"), ("requirements.txt", "numpy", "NumPy"), ("requirements.txt", "pandas", "Pandas"), ("requirements.txt", "scikit-learn", "scikit-learn"),
    ("requirements.txt", "tensorflow", "TensorFlow"), ("requirements.txt", "torch", "PyTorch"), ("requirements.txt", "transformers", "Transformers"), ("requirements.txt", "djangorestframework", "Django REST"),
    ("requirements.txt", "langchain", "LangChain"), ("requirements.txt", "llama-index", "LlamaIndex"), ("pyproject.toml", "django", "Django"), ("pyproject.toml", "flask", "Flask"),
    ("pyproject.toml", "fastapi", "FastAPI"), ("pyproject.toml", "litestar", "Litestar"), ("pyproject.toml", "poetry", "Poetry"), ("pyproject.toml", "ruff", "Ruff"), ("pyproject.toml", "mypy", "mypy"),
    ("pyproject.toml", "pytest", "pytest"), ("pyproject.toml", "sphinx", "Sphinx"), ("go.mod", "gin-gonic", "Gin"), ("go.mod", "echo", "Echo"), ("go.mod", "fiber", "Fiber"), ("go.mod", "chi", "Chi"),
    ("go.mod", "gorilla/mux", "Gorilla Mux"), ("go.mod", "gorm", "GORM"), ("go.mod", "sqlx", "sqlx"), ("go.mod", "redis", "Redis"), ("go.mod", "mongo-driver", "MongoDB"), ("go.mod", "cobra", "Cobra"),
    ("go.mod", "grpc", "gRPC"), ("go.mod", "testify", "Testify"), ("Cargo.toml", "actix-web", "Actix Web"), ("Cargo.toml", "rocket", "Rocket"), ("Cargo.toml", "axum", "Axum"), ("Cargo.toml", "warp", "Warp"),
    ("Cargo.toml", "tokio", "Tokio"), ("Cargo.toml", "serde", "Serde"), ("Cargo.toml", "diesel", "Diesel"), ("Cargo.toml", "sqlx", "sqlx"), ("Cargo.toml", "tonic", "Tonic"), ("Cargo.toml", "clap", "Clap"),
    ("Cargo.toml", "tauri", "Tauri"), ("Cargo.toml", "bevy", "Bevy"), ("Gemfile", "rails", "Ruby on Rails"), ("Gemfile", "sinatra", "Sinatra"), ("Gemfile", "rspec", "RSpec"), ("Gemfile", "sidekiq", "Sidekiq"),
    ("Gemfile", "pg", "PostgreSQL"), ("Gemfile", "mysql2", "MySQL"), ("Gemfile", "redis", "Redis"),
)

#: Keyword, database.
DATABASES = (
    ("mysql", "MySQL"), ("postgres", "PostgreSQL"), ("pgsql", "PostgreSQL"), ("sqlite", "SQLite"), ("mongo", "MongoDB"), ("redis", "Redis"), ("mariadb", "MariaDB"), ("oracle", "Oracle"), ("mssql", "SQL Server"),
    ("sqlserver", "SQL Server"), ("elasticsearch", "Elasticsearch"), ("cassandra", "Cassandra"), ("neo4j", "Neo4j"), ("dynamodb", "DynamoDB"), ("couchdb", "CouchDB"), ("firebase", "Firebase"),
    ("supabase", "Supabase"), ("clickhouse", "ClickHouse"), ("timescaledb", "TimescaleDB"), ("cockroachdb", "CockroachDB"), ("tidb", "TiDB"), ("oceanbase", "OceanBase"), ("h2", "H2"),
)

#: Root files beside build files that name databases.
CONFIG_FILES = (
    "application.yml", "application.yaml", "application.properties", "application-dev.yml", "application-prod.yml", ".env", ".env.example", ".env.local", ".env.development", "database.yml",
    "database.yaml", "config/database.yml", "settings.py", "config.py", "database.ini",
)

#: Architecture, directories of which at least two occur.
ARCHITECTURES = (
    ("mvc", ("controller", "model", "view", "controllers", "models", "views")),
    ("ddd", ("domain", "application", "infrastructure", "interfaces", "entity", "repository", "service", "valueobject")),
    ("clean", ("entities", "usecases", "interfaces", "frameworks", "use_cases", "interface_adapters")),
    ("hexagonal", ("ports", "adapters", "domain", "application", "infrastructure", "primary", "secondary")),
    ("layered", ("controller", "service", "repository", "dao", "mapper", "entity", "dto", "vo")),
    ("microservices", ("gateway", "discovery", "config-server", "auth-service", "user-service", "order-service")),
    ("modular_monolith", ("modules", "module", "bounded_context", "context")),
    ("cqrs", ("commands", "queries", "events", "command", "query", "event", "projection", "aggregate")),
    ("event_driven", ("events", "handlers", "listeners", "publishers", "subscribers", "consumers", "producers")),
)

#: Architecture by framework, where no pattern fits; a repository without frameworks is simply layered.
BY_FRAMEWORK = (("mvc", ("Spring Boot", "Django", "Laravel")), ("component_based", ("React", "Vue.js", "Angular")), ("rest_api", ("FastAPI", "Express", "Gin")))
PLAIN = "simple_layered"

#: Paths where programs start, files or directories.
ENTRY_POINTS = (
    "main.py", "app.py", "manage.py", "index.js", "index.ts", "server.js", "server.ts", "main.go", "main.rs", "index.php", "public/index.php", "Program.cs", "Main.java", "Application.java", "App.java",
    "main.swift", "main.kt", "main.lua", "main.dart", "src/main.rs", "src/main.go", "cmd/main.go", "src/main/java", "src/index.js", "src/index.ts", "src/App.jsx", "src/App.tsx", "src/main.tsx",
    "src/main.jsx", "pages/index.tsx", "pages/index.js", "app/page.tsx", "app/layout.tsx", "src/App.vue",
)

#: Project type by frameworks, the first that fits; else the language.
PROJECT_TYPES = (
    ("java_backend", ("Spring Boot", "Spring Cloud")), ("python_backend", ("Django", "FastAPI", "Flask")), ("php_backend", ("Laravel",)), ("ruby_backend", ("Ruby on Rails",)), ("go_backend", ("Gin", "Echo", "Fiber")),
    ("node_backend", ("Express", "Koa", "Fastify", "NestJS")), ("rust_backend", ("Actix Web", "Axum", "Rocket")), ("dotnet_backend", (".NET",)), ("frontend", ("Next.js", "React", "Vue.js", "Angular", "Svelte")),
    ("mobile", ("React Native",)), ("desktop", ("Tauri", "Electron")), ("ai_ml", ("TensorFlow", "PyTorch", "Transformers", "scikit-learn", "LangChain", "LlamaIndex")),
)
LANGUAGE_TYPES = ("python", "java", "javascript", "go", "rust", "php", "ruby")


def build_files(files: DataFrame, names=BUILD_FILES) -> DataFrame:
    """The build file (or directory) of each repository that counts: at the root or one level down, least depth, then path; and how
    many there are."""
    parts = F.split("path", "/")
    # a path holds itself and, of its first two levels, the directories
    levels = F.array_distinct(F.array("path", F.array_join(F.slice(parts, 1, 1), "/"), F.array_join(F.slice(parts, 1, 2), "/"), F.array_join(F.slice(parts, 1, 3), "/")))
    every = files.select("repo_id", F.explode(levels).alias("path")).distinct()
    depth = F.size(parts) - 1
    last, two = basename(F.col("path")), F.array_join(F.slice(parts, -2, 2), "/")
    spark = files.sparkSession
    table = spark.createDataFrame(list(names), "name string, project_type string, build_tool string, language string")
    near = every.where(depth <= 2).withColumns({"depth": depth, "name": F.when((depth >= 1) & two.isin(*[n for n, *_ in names if "/" in n]), two).otherwise(last)})
    near = near.withColumn("depth", F.col("depth") - F.when(F.contains("name", F.lit("/")), 1).otherwise(0)).where("depth <= 1")
    known = near.join(F.broadcast(table), "name")  # a catalogue of fixed size
    best = known.groupBy("repo_id").agg(F.min(F.struct("depth", "path", "project_type", "build_tool", "language")).alias("b"), F.count("*").alias("n_build_files"))
    return best.select("repo_id", F.col("b.path").alias("build_file"), "b.project_type", "b.build_tool", "b.language", "n_build_files")


def project_metadata(files: DataFrame) -> DataFrame:
    """name, version and description from a root package.json, composer.json, pyproject.toml, Cargo.toml, setup.py, pom.xml or go.mod,
    the first in path order that has a name."""
    path, content = F.col("path"), F.col("content")
    json, toml = path.isin("package.json", "composer.json"), path.isin("pyproject.toml", "Cargo.toml")

    def read(key: str, tag: str):
        return (
            F.when(json, F.get_json_object(content, f"$.{key}")).when(toml, F.regexp_extract(content, rf"(?m)^{key}\s*=\s*\"([^\"]*)\"", 1))
            .when(path == "setup.py", F.regexp_extract(content, rf"\b{key}\s*=\s*['\"]([^'\"]*)['\"]", 1)).when(path == "pom.xml", F.regexp_extract(content, f"<{tag}>([^<]*)<", 1))
        )

    name = F.when(path == "go.mod", F.regexp_extract(content, r"(?m)^module\s+(\S+)", 1)).otherwise(read("name", "artifactId"))
    rows = files.where(json | toml | path.isin("setup.py", "pom.xml", "go.mod"))
    rows = rows.select("repo_id", "path", name.alias("name"), read("version", "version").alias("version"), read("description", "description").alias("description"))
    best = rows.where("name is not null and name <> ''").groupBy("repo_id").agg(F.min(F.struct("path", "name", "version", "description")).alias("m"))
    return best.select("repo_id", "m.name", "m.version", F.nullif("m.description", F.lit("")).alias("description"))


def _keywords(files: DataFrame, catalogue: list[tuple[str, Column]], column: str) -> DataFrame:
    found = F.array(*(F.when(hit, F.lit(name)) for name, hit in catalogue))
    return files.select("repo_id", F.explode(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))).alias(column)).distinct()


def _structure(files: DataFrame) -> DataFrame:
    """Frameworks by the files and directories present, and by the mark of an application class."""
    path = F.col("path")
    name, low = basename(path), F.lower("path")
    spring = path.startswith("src/") & path.endswith(".java") & F.contains("content", F.lit("@SpringBootApplication"))
    hints = [
        ("Django", path.isin("manage.py", "settings.py", "urls.py")), ("Spring Boot", spring), (".NET", path.rlike(r"\.(csproj|sln|vbproj)$")),
        ("Electron", low.rlike("(^|/)electron/") | (name == "electron-builder.yml")), ("React", low.rlike(r"(^|/)src/app\.(jsx|tsx)$")), ("Vue.js", path.endswith(".vue")), ("Svelte", path.endswith(".svelte")),
    ]
    return _keywords(files, hints, "framework")


def detect_frameworks(files: DataFrame, catalogue=FRAMEWORKS, structure: bool = True) -> DataFrame:
    """repo_id, framework: a keyword in the lower-cased root build file, or what the files present tell."""
    text = F.lower("content")
    root = files.where(F.col("path").isin(*sorted({f for f, _, _ in catalogue})))
    found = _keywords(root, [(n, (F.col("path") == f) & F.contains(text, F.lit(k))) for f, k, n in catalogue], "framework")
    return found.unionByName(_structure(files)).distinct() if structure else found


def detect_databases(files: DataFrame) -> DataFrame:
    """repo_id, database: a keyword in a root build file or a known configuration file."""
    text = F.lower("content")
    root = files.where(F.col("path").isin(*sorted({n for n, *_ in BUILD_FILES} | set(CONFIG_FILES))))
    return _keywords(root, [(n, F.contains(text, F.lit(k))) for k, n in DATABASES], "database")


def detect_architecture(files: DataFrame, frameworks: DataFrame | None = None) -> DataFrame:
    """The pattern with most of its directories present, two at least; the first of the catalogue on ties; else by framework, else simply
    layered; unknown where there are frameworks but none that tells."""
    dirs = files.select("repo_id", F.explode(F.slice(F.split(F.lower("path"), "/"), F.lit(1), F.size(F.split("path", "/")) - 1)).alias("dir")).distinct()
    spark = files.sparkSession
    catalogue = spark.createDataFrame([(n, i, d) for i, (n, ds) in enumerate(ARCHITECTURES) for d in ds], "architecture string, place int, dir string")
    score = dirs.join(F.broadcast(catalogue), "dir").groupBy("repo_id", "architecture", "place").agg(F.count("*").alias("score")).where("score >= 2")
    best = score.groupBy("repo_id").agg(F.max_by(F.struct("architecture", "score"), F.struct("score", -F.col("place"))).alias("b"))
    frameworks = detect_frameworks(files) if frameworks is None else frameworks
    used = frameworks.groupBy("repo_id").agg(F.collect_set("framework").alias("used"))
    other = F.when(F.col("used").isNull(), PLAIN)
    for name, of in BY_FRAMEWORK:
        other = other.when(F.arrays_overlap("used", F.array(*map(F.lit, of))), name)
    rows = files.select("repo_id").distinct().join(best, "repo_id", "left").join(used, "repo_id", "left")
    return rows.select("repo_id", F.coalesce("b.architecture", other.otherwise("unknown")).alias("architecture"), F.coalesce("b.score", F.lit(0)).alias("score"))


def entry_points(files: DataFrame, n: int = 10) -> DataFrame:
    """Known paths that exist, as files or directories, the first n in the catalogue's order."""
    parts = F.split("path", "/")
    levels = F.array_distinct(F.array("path", *(F.array_join(F.slice(parts, 1, i), "/") for i in sorted({e.count("/") + 1 for e in ENTRY_POINTS}))))
    place = F.array_position(F.array(*map(F.lit, ENTRY_POINTS)), F.col("path"))
    found = files.select("repo_id", F.explode(levels).alias("path")).where(F.col("path").isin(*ENTRY_POINTS)).distinct().select("repo_id", "path", place.alias("place"))
    turn = F.row_number().over(Window.partitionBy("repo_id").orderBy("place"))
    return found.withColumn("rank", turn).where(F.col("rank") <= n).select("repo_id", "path", "rank")


def tech_stack(files: DataFrame) -> DataFrame:
    """One row per repository: language, build tool, frameworks and databases, comma-joined, and a project type."""
    joined = lambda rows, c: rows.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c + "s"))
    rows = (
        files.select("repo_id").distinct().join(build_files(files), "repo_id", "left").join(joined(detect_frameworks(files), "framework"), "repo_id", "left")
        .join(joined(detect_databases(files), "database"), "repo_id", "left")
    )
    used = F.split(F.coalesce("frameworks", F.lit("")), ",")
    kind = None
    for name, of in PROJECT_TYPES:
        hit = F.arrays_overlap(used, F.array(*map(F.lit, of)))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    kind = kind.when(F.col("language").isin(*LANGUAGE_TYPES), F.col("language")).otherwise(F.coalesce("project_type", F.lit("generic")))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("repo_id", empty("language"), empty("build_tool"), empty("frameworks"), empty("databases"), kind.alias("project_type"))
