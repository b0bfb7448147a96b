"""A repository for newcomers: artifacts, subprojects, roles of folders and files, entry points, key files, reading path.

Everything works on a table of paths (repository, path, and text where content matters), so many repositories are one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.functions.scalars import file_name, literal_map
from lintel.operators.ranking import first_per_key, top_per_key

# Folders that hold nothing of the project's own.
IGNORED = ".git .github node_modules __pycache__ .venv venv env .env target build dist out coverage .coverage htmlcov .idea .vscode .eclipse .mypy_cache .pytest_cache .tox bin obj".split()

# Folder name, role, confidence; the first name that a folder's name holds counts where no name equals it.
FOLDERS = {
    "src": ("Source", "high"),
    "source": ("Source", "high"),
    "lib": ("Library", "high"),
    "libs": ("Library", "high"),
    "core": ("Core", "high"),
    "main": ("Source", "medium"),
    "app": ("Application", "medium"),
    "controller": ("Controller", "high"),
    "controllers": ("Controller", "high"),
    "handler": ("Controller", "high"),
    "handlers": ("Controller", "high"),
    "route": ("Controller", "high"),
    "routes": ("Controller", "high"),
    "api": ("API", "high"),
    "service": ("Service", "high"),
    "services": ("Service", "high"),
    "usecase": ("Service", "high"),
    "usecases": ("Service", "high"),
    "business": ("Service", "high"),
    "logic": ("Service", "medium"),
    "domain": ("Domain", "high"),
    "repository": ("Repository", "high"),
    "repositories": ("Repository", "high"),
    "repo": ("Repository", "medium"),
    "dao": ("Repository", "high"),
    "persistence": ("Repository", "high"),
    "store": ("Repository", "medium"),
    "database": ("Repository", "high"),
    "db": ("Repository", "high"),
    "model": ("Data Model", "high"),
    "models": ("Data Model", "high"),
    "entity": ("Data Model", "high"),
    "entities": ("Data Model", "high"),
    "schema": ("Schema", "high"),
    "schemas": ("Schema", "high"),
    "dto": ("Data Model", "high"),
    "dtos": ("Data Model", "high"),
    "util": ("Utility", "high"),
    "utils": ("Utility", "high"),
    "helper": ("Utility", "high"),
    "helpers": ("Utility", "high"),
    "common": ("Utility", "medium"),
    "shared": ("Utility", "medium"),
    "support": ("Utility", "medium"),
    "tools": ("Utility", "medium"),
    "test": ("Tests", "high"),
    "tests": ("Tests", "high"),
    "spec": ("Tests", "high"),
    "specs": ("Tests", "high"),
    "__tests__": ("Tests", "high"),
    "config": ("Configuration", "high"),
    "configs": ("Configuration", "high"),
    "conf": ("Configuration", "high"),
    "settings": ("Configuration", "high"),
    "properties": ("Configuration", "medium"),
    "env": ("Configuration", "medium"),
    "doc": ("Documentation", "high"),
    "docs": ("Documentation", "high"),
    "wiki": ("Documentation", "medium"),
    "script": ("Scripts", "high"),
    "scripts": ("Scripts", "high"),
    "bin": ("Scripts", "medium"),
    "include": ("Headers", "high"),
    "includes": ("Headers", "high"),
    "header": ("Headers", "high"),
    "headers": ("Headers", "high"),
    "deploy": ("Deployment", "high"),
    "deployment": ("Deployment", "high"),
    "infra": ("Infrastructure", "high"),
    "infrastructure": ("Infrastructure", "high"),
    "k8s": ("Deployment", "high"),
    "kubernetes": ("Deployment", "high"),
    "docker": ("Deployment", "high"),
    "middleware": ("Middleware", "high"),
    "plugin": ("Plugin", "medium"),
    "plugins": ("Plugin", "medium"),
    "extension": ("Plugin", "medium"),
    "extensions": ("Plugin", "medium"),
    "auth": ("Auth", "high"),
    "security": ("Auth", "high"),
    "oauth": ("Auth", "high"),
    "migration": ("Migration", "high"),
    "migrations": ("Migration", "high"),
    "flyway": ("Migration", "high"),
    "liquibase": ("Migration", "high"),
}

# File name, category of artifact, tool.
TOOLS = [
    ("pom.xml", "build_tools", "Maven"),
    ("build.gradle", "build_tools", "Gradle"),
    ("build.gradle.kts", "build_tools", "Gradle"),
    ("makefile", "build_tools", "Make"),
    ("gnumakefile", "build_tools", "Make"),
    ("cmakelists.txt", "build_tools", "CMake"),
    ("meson.build", "build_tools", "Meson"),
    ("configure", "build_tools", "Autotools"),
    ("configure.ac", "build_tools", "Autotools"),
    ("gradlew", "build_tools", "Gradle Wrapper"),
    ("autogen.sh", "build_tools", "Autotools"),
    ("requirements.txt", "dependency_managers", "pip"),
    ("requirements-dev.txt", "dependency_managers", "pip"),
    ("pipfile", "dependency_managers", "Pipenv"),
    ("pyproject.toml", "dependency_managers", "pip/Poetry"),
    ("setup.py", "dependency_managers", "setuptools"),
    ("conanfile.txt", "dependency_managers", "Conan"),
    ("conanfile.py", "dependency_managers", "Conan"),
    ("pytest.ini", "testing", "pytest"),
    ("setup.cfg", "testing", "pytest"),
    ("tox.ini", "testing", "tox"),
    ("testng.xml", "testing", "TestNG"),
    ("dockerfile", "deployment", "Docker"),
    ("docker-compose.yml", "deployment", "Docker Compose"),
    ("docker-compose.yaml", "deployment", "Docker Compose"),
    ("vagrantfile", "deployment", "Vagrant"),
    ("kubernetes", "deployment", "Kubernetes"),
    ("k8s", "deployment", "Kubernetes"),
    (".travis.yml", "ci_cd", "Travis CI"),
    ("jenkinsfile", "ci_cd", "Jenkins"),
    ("appveyor.yml", "ci_cd", "AppVeyor"),
    ("azure-pipelines.yml", "ci_cd", "Azure Pipelines"),
]

# Manifests of subprojects; names of Python entry points; patterns of main functions.
MANIFESTS = {
    "pom.xml": "Maven module",
    "build.gradle": "Gradle module",
    "build.gradle.kts": "Gradle module (Kotlin DSL)",
    "package.json": "Node.js module",
    "pyproject.toml": "Python module",
    "setup.py": "Python module",
    "cmakelists.txt": "CMake module",
}
ENTRY_NAMES = "main.py app.py run.py server.py manage.py cli.py wsgi.py asgi.py start.py boot.py launcher.py application.py".split()
MAINS = {"py": r"""if\s+__name__\s*==\s*["']__main__["']""", "java": r"public\s+static\s+void\s+main\s*\(\s*String", "c": r"\b(?:int|void)\s+main\s*\([^)]*\)"}
# Parts of a file's stem and the role that they suggest, in order.
STEM_ROLES = {
    "Tests": "test spec mock stub fixture",
    "Service": "service svc",
    "Controller": "controller ctrl handler route router",
    "Repository": "repository repo dao store",
    "Data Model": "model entity dto schema",
    "Utility": "util utils helper helpers common shared",
    "Configuration": "config setting conf property",
    "Migration": "migration migrate",
}
#: Layers of the reading path, in order.
LAYERS = ("API", "Controller", "Service", "Domain", "Repository", "Data Model", "Schema", "Utility", "Headers", "Tests", "Configuration")
CONFIDENCE = {"high": 0, "medium": 1, "low": 2}


def folders_of(path: Column) -> Column:
    return F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)


def inside(path: Column) -> Column:
    """Is no folder of the path an ignored or hidden one?"""
    return ~F.exists(folders_of(path), lambda d: F.lower(d).isin(*IGNORED) | d.startswith("."))


def confidence_rank(c: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(CONFIDENCE), c), F.lit(9))


def artifacts(paths: DataFrame, by: str = "repository") -> DataFrame:
    """(by, category, tool, evidence): the first hit of each tool among the files at the root and one level below; workflows and test files count too."""
    dim = paths.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(TOOLS)], "pos int, file string, category string, tool string")
    rows = paths.select(by, "path", F.size(folders_of(F.col("path"))).alias("depth"), F.lower(file_name(F.col("path"))).alias("file"))
    top = F.lower(F.element_at(F.split("path", "/"), 1))
    known = rows.filter((F.col("depth") == 0) | (F.col("depth") == 1) & ~top.isin(*IGNORED)).join(F.broadcast(dim), "file")  # a row a name
    hits = known.select(by, "category", "tool", "path", "depth", "pos")
    flow = rows.filter((F.col("depth") == 2) & F.col("path").startswith(".github/workflows/") & F.col("file").rlike(r"\.ya?ml$"))
    hits = hits.unionByName(flow.select(by, F.lit("ci_cd").alias("category"), F.lit("GitHub Actions").alias("tool"), "path", F.lit(-1).alias("depth"), F.lit(0).alias("pos")))
    test = rows.filter((F.col("depth") == 0) & F.col("file").rlike(r"^test_.*\.py$|_test\.py$"))
    hits = hits.unionByName(test.select(by, F.lit("testing").alias("category"), F.lit("pytest").alias("tool"), "path", F.lit(2).alias("depth"), F.lit(0).alias("pos")))
    return first_per_key(hits, [by, "category", "tool"], [F.col("depth"), F.col("path"), F.col("pos")]).select(by, "category", "tool", F.col("path").alias("evidence"))


def subprojects(paths: DataFrame, by: str = "repository", limit: int = 10) -> DataFrame:
    """(by, folder, build_file, type): folders below the root that hold a manifest of their own, the first manifest of each, the first `limit` of a repository."""
    name = file_name(F.col("path"))
    kind = F.try_element_at(literal_map(MANIFESTS), F.lower(name))
    rows = paths.filter((F.size(folders_of(F.col("path"))) > 0) & inside(F.col("path")))
    found = rows.select(by, F.array_join(folders_of(F.col("path")), "/").alias("folder"), name.alias("build_file"), kind.alias("type")).filter("type IS NOT NULL")
    once = first_per_key(found, [by, "folder"], [F.col("build_file")])
    return top_per_key(once, [by], [F.col("folder")], limit, "place").drop("place")


def folder_role(name: Column, has_python_tests: Column, has_headers: Column) -> Column:
    """(role, confidence) of a folder: by its whole name, else by the first known name in it, else by what it holds, else Unknown."""
    low = F.lower(name)
    whole = F.try_element_at(F.create_map(*[x for k, (role, sure) in FOLDERS.items() for x in (F.lit(k), F.struct(F.lit(role).alias("role"), F.lit(sure).alias("confidence")))]), low)
    part = F.lit(None)
    for k, (role, sure) in reversed(FOLDERS.items()):
        part = F.when(low.contains(k), F.struct(F.lit(role).alias("role"), F.lit("medium" if sure == "high" else sure).alias("confidence"))).otherwise(part)
    other = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("confidence"))
    held = F.when(has_python_tests, other("Tests", "high")).when(has_headers, other("Headers", "medium")).otherwise(other("Unknown", "low"))
    return F.coalesce(whole, part, held)


def important_folders(paths: DataFrame, by: str = "repository", limit: int = 20) -> DataFrame:
    """(by, folder, role, confidence) of folders at the root, and one level into source roots, whose role is known; the surest `limit` of a repository."""
    parts = F.split("path", "/")
    rows = paths.select(by, "path", parts.alias("parts")).filter(F.size("parts") > 1)
    up = F.transform(F.sequence(F.lit(1), F.least(F.lit(2), F.size("parts") - 1)), lambda n: F.slice("parts", F.lit(1), n))
    seen = rows.select(by, F.explode(up).alias("f"), "parts").filter(~F.exists("f", lambda d: d.isin(*IGNORED) | d.startswith(".")))
    seen = seen.filter((F.size("f") == 1) | F.lower(F.element_at("f", 1)).isin("src", "source", "app", "core", "main"))
    file = F.when(F.size("parts") == F.size("f") + 1, F.lower(F.element_at("parts", -1)))
    grouped = seen.groupBy(by, F.array_join("f", "/").alias("folder"), F.element_at("f", -1).alias("name")).agg(
        F.coalesce(F.max(file.rlike(r"^test_.*|_test\.py$")) & F.max(file.endswith(".py")), F.lit(False)).alias("tests"), F.coalesce(F.max(file.endswith(".h")), F.lit(False)).alias("headers")
    )
    known = grouped.withColumn("r", folder_role(F.col("name"), F.col("tests"), F.col("headers"))).select(by, "folder", "r.role", "r.confidence").filter("role <> 'Unknown'")
    return top_per_key(known, [by], [confidence_rank(F.col("confidence")), F.col("folder")], limit, "place")


def entry_points(files: DataFrame, by: str = "repository") -> DataFrame:
    """(by, path, confidence, place): files with a main function (high), Python files named like an entry point (medium); sure ones first, then by path."""
    name = F.lower(file_name(F.col("path")))
    ending = F.regexp_extract(name, r"\.([^.]*)$", 1)
    content = F.lit(False)
    for e, pattern in MAINS.items():
        content = content | (ending == e) & F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    sure = F.when(content, "high").when(name.isin(*ENTRY_NAMES), "medium")
    found = files.select(by, "path", sure.alias("confidence")).filter("confidence IS NOT NULL")
    return found.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(confidence_rank(F.col("confidence")), "path")))


def source_role(path: Column, text: Column) -> Column:
    """The role of a source file: header, entry point, what its name suggests, else Application Source."""
    name = F.lower(file_name(path))
    ending, stem = F.regexp_extract(name, r"\.([^.]*)$", 1), F.regexp_replace(name, r"\.[^.]*$", "")
    has_text = F.coalesce(text != "", F.lit(False))
    role = F.when(ending == "h", "Header / Interface")
    for e, pattern in MAINS.items():
        role = role.when((ending == e) & has_text & text.rlike(pattern), "Entry Point")
    role = role.when((ending == "py") & has_text & name.isin(*ENTRY_NAMES), "Entry Point")
    for r, words in STEM_ROLES.items():
        role = role.when(stem.rlike("|".join(words.split())), r)
    return role.when(ending.isin("py", "java", "c"), "Application Source").otherwise("Unknown")


def key_files(files: DataFrame, edges: DataFrame, by: str = "repository", top: int = 15, widest: int = 10) -> DataFrame:
    """(by, path, role, score, importance): source files by what speaks for reading them first.

    edges (by, src, dst). Entry points 30 and 20 by role; the `widest` files by fan-in, at least two, 4 each up to 20; by fan-out, at least three, 10; layered roles 15."""
    into = edges.groupBy(by, F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("fan_in")).filter("fan_in >= 2")
    out = edges.groupBy(by, F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("fan_out")).filter("fan_out >= 3")
    wide_in = top_per_key(into, [by], [F.desc("fan_in"), F.col("path")], widest).drop("rank")
    wide_out = top_per_key(out, [by], [F.desc("fan_out"), F.col("path")], widest).drop("rank")
    entries = entry_points(files, by).select(by, "path", F.lit(True).alias("entry"))
    rows = files.select(by, "path", source_role(F.col("path"), F.col("text")).alias("role")).join(entries, [by, "path"], "left").join(wide_in, [by, "path"], "left").join(wide_out, [by, "path"], "left")
    score = (
        F.when(F.col("entry"), 30).otherwise(0)
        + F.coalesce(F.least(F.lit(20), 4 * F.col("fan_in")), F.lit(0))
        + F.when(F.col("fan_out").isNotNull(), 10).otherwise(0)
        + F.when(F.col("role").isin("Service", "Controller", "Repository", "Domain"), 15).otherwise(0)
        + F.when(F.col("role") == "Entry Point", 20).otherwise(0)
    )
    scored = rows.withColumn("score", score.cast("long")).filter("score > 0")
    ranked = top_per_key(scored, [by], [F.desc("score"), F.col("path")], top)
    return ranked.select(by, "path", "role", "score", F.when(F.col("score") >= 30, "high").when(F.col("score") >= 15, "medium").otherwise("low").alias("importance"))


def reading_path(important: DataFrame, entries: DataFrame, folders: DataFrame, by: str = "repository") -> DataFrame:
    """(by, step, path): what to read first. important (by, path, role, importance, pos): key files in order.

    The first readme, dependency manifests, important build files, sure entry points, then one folder of each layer. Each path once, at its first place."""
    readme = (F.col("role") == "Documentation") & F.lower(file_name(F.col("path"))).contains("readme")
    first = first_per_key(important.filter(readme), [by], [F.col("pos")]).select(by, "path", F.lit(1).alias("part"), F.col("pos").cast("long").alias("pos"))
    part = F.when(F.col("role") == "Dependency Manifest", 2).when((F.col("role") == "Build Configuration") & (F.col("importance") == "high"), 3)
    files = important.select(by, "path", part.alias("part"), F.col("pos").cast("long").alias("pos")).filter("part IS NOT NULL")
    mains = entries.filter("confidence = 'high'").select(by, "path", F.lit(4).alias("part"), F.col("place").cast("long").alias("pos"))
    layer = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("role"))
    one = first_per_key(folders.filter(F.col("role").isin(*LAYERS)), [by, "role"], [F.col("place")])
    layers = one.select(by, F.concat("folder", F.lit("/")).alias("path"), F.lit(5).alias("part"), layer.alias("pos"))
    every = first.unionByName(files).unionByName(mains).unionByName(layers)
    once = first_per_key(every, [by, "path"], [F.col("part"), F.col("pos")])
    return once.select(by, F.row_number().over(Window.partitionBy(by).orderBy("part", "pos", "path")).alias("step"), "path")
