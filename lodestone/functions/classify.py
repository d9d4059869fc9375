"""Rules over paths: layers, roles, tests, entry points, exclusion."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layers of the graph view, by prefix of the path.
GRAPH_LAYERS = [("routes/", "routes"), ("services/", "services"), ("models/", "models"), ("src/", "frontend"), ("config", "config"), ("main", "config")]
#: A part of a path that makes it frontend if no rule before ``config`` does.
GRAPH_FRONTEND = "frontend"
#: Layers of the guide.
GUIDE_LAYERS = [
    ("接口层", ["routes/", "routers/", "controllers/", "views/"]),
    ("服务层", ["services/", "service/", "use_cases/", "usecases/"]),
    ("数据层", ["models/", "model/", "entities/", "schemas/", "domain/"]),
    ("工具层", ["utils/", "helpers/", "common/", "lib/"]),
    ("配置/入口", ["config/", "settings/", "main.", "app.", "index.", "__init__"]),
    ("测试", ["tests/", "test/"]),
    ("数据库迁移", ["migrations/", "alembic/"]),
    ("前端", ["frontend/", "src/", "components/", "pages/"]),
]
#: Layers of the tour.
TOUR_LAYERS = [
    ("接口层", ["routes/", "routers/", "controllers/", "views/", "api/", "endpoints/"]),
    ("服务层", ["services/", "service/", "use_cases/", "usecases/", "core/", "domain/"]),
    ("数据层", ["models/", "model/", "entities/", "schemas/", "domain/", "dal/", "repositories/", "repository/"]),
    ("工具层", ["utils/", "util/", "helpers/", "common/", "lib/", "shared/"]),
    ("配置/入口", ["config/", "settings/", "main.", "app.", "index.", "__init__", "manage.", "run."]),
    ("测试", ["tests/", "test/", "spec/", "__tests__/"]),
    ("数据库迁移", ["migrations/", "alembic/", "db/"]),
    ("前端", ["frontend/", "src/", "components/", "pages/", "app/", "store/", "hooks/"]),
    ("基础设施", [".github/", ".circleci/", "docker", "terraform/", "k8s/"]),
]
#: Layers of the client, each by prefixes or, for two of them, by a part of the path.
CLIENT_LAYERS = [
    ("接口层", ["routes/", "routers/", "controllers/", "api/", "endpoints/"], None),
    ("服务层", ["services/", "service/", "core/", "domain/"], None),
    ("数据层", ["models/", "model/", "entities/", "schemas/", "dal/", "repositories/"], None),
    ("工具层", ["utils/", "util/", "helpers/", "common/", "lib/", "shared/"], None),
    ("配置/入口", ["config/", "settings/", "main.", "app.", "index.", "manage.", "run."], None),
    ("前端", ["src/", "components/", "pages/", "store/", "hooks/"], "frontend"),
    ("测试", ["tests/", "test/", "spec/", "__tests__/"], None),
    ("数据库迁移", ["migrations/", "alembic/", "db/"], None),
    ("基础设施", [".github/", "docker", "dockerfile", "terraform/", "k8s/"], "infra"),
]
#: Roles of modules, the first matching prefix decides.
ROLES = [
    ("routes/", "api_entry"), ("controllers/", "api_entry"), ("handlers/", "api_entry"), ("views/", "api_entry"),
    ("services/", "business_logic"), ("core/", "business_logic"), ("domain/", "business_logic"),
    ("models/", "data_model"), ("entities/", "data_model"), ("schemas/", "data_model"), ("types/", "data_model"), ("interfaces/", "data_model"),
    ("utils/", "utility"), ("helpers/", "utility"), ("lib/", "utility"), ("common/", "utility"),
    ("config/", "configuration"), ("settings/", "configuration"), ("components/", "ui_component"), ("pages/", "ui_page"),
    ("hooks/", "hook"), ("store/", "state_management"), ("middleware/", "middleware"), ("tests/", "test"),
]
#: What in a path marks a test.
TEST_MARKS = ["test_", "_test", "spec_", "_spec", "tests/", "test/", "spec/", "__tests__/", ".test.", ".spec."]
#: Exclusions of the scan, and infrastructure files that are kept.
EXCLUDES = ["__pycache__/", ".git/", "node_modules/", ".venv/", "venv/", "dist/", "build/", "*.pyc", ".mypy_cache/", ".pytest_cache/", ".tox/", "*.egg-info/"]
INFRA_NAMES = [
    "Dockerfile", "Dockerfile.*", "docker-compose.yml", "docker-compose.yaml", ".dockerignore", "Makefile", "Makefile.*", ".env.example", ".env.template", ".env.sample",
    "*.sql", "*.graphql", "*.gql", "*.tf", "*.tfvars", ".terraform.lock.hcl", "*.proto", "nginx.conf", "*.nginx.conf", ".gitlab-ci.yml", ".travis.yml", "Jenkinsfile",
]
INFRA_DIRS = [".github/workflows/", ".github/actions/", "deploy/", "deployment/", "infra/", "infrastructure/", "k8s/", "kubernetes/", "helm/", "terraform/"]
#: Usual names of entry files.
ENTRY_NAMES = ["main.py", "app.py", "index.py", "manage.py", "run.py", "server.py"]


#: Names, folders that are no entries, frameworks and points of the tour's entries.
TOUR_NAMES = ["main.py", "app.py", "index.py", "manage.py", "run.py", "server.py", "__init__.py"]
TOUR_NOT = ["alembic/", "migrations/", "tests/", "test/"]
TOUR_FRAMEWORKS = ["fastapi", "flask", "django", "express", "next"]
TOUR_POINTS = {"name": 5, "package": 2, "not imported": 1, "framework": 3}


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def in_repo(path: Column) -> Column:
    """The path below its repository."""
    return F.regexp_replace(slashes(path), "^[^/]*/", "")


def _first(path: Column, rules, other: str) -> Column:
    out = None
    for test, label in rules:
        out = F.when(test(path), label) if out is None else out.when(test(path), label)
    return out.otherwise(other)


def _prefixes(prefixes):
    def test(p):
        hit = F.lit(False)
        for x in prefixes:
            hit = hit | p.startswith(x)
        return hit

    return test


def graph_layer(path: Column) -> Column:
    rules: list = [(_prefixes([x]), y) for x, y in GRAPH_LAYERS]
    rules.insert(4, (lambda p: F.lower(p).contains(GRAPH_FRONTEND), "frontend"))
    return _first(slashes(path), rules, "other")


def layer(path: Column, layers=GUIDE_LAYERS) -> Column:
    return _first(F.lower(slashes(path)), [(_prefixes(p), name) for name, p in layers], "其他")


def client_layer(path: Column) -> Column:
    def test(prefixes, part):
        return lambda p: _prefixes(prefixes)(p) | (p.contains(part) if part else F.lit(False))

    return _first(F.lower(slashes(path)), [(test(prefixes, part), name) for name, prefixes, part in CLIENT_LAYERS], "其他")


def role(path: Column) -> Column:
    return _first(slashes(path), [(_prefixes([p]), r) for p, r in ROLES], "general")


def is_test(path: Column) -> Column:
    low = F.lower(slashes(path))
    hit = F.lit(False)
    for m in TEST_MARKS:
        hit = hit | low.contains(m)
    return F.coalesce(hit, F.lit(False))


def _glob(pattern: str) -> str:
    """A glob as a Java pattern for the whole string."""
    body = fnmatch.translate(pattern)
    body = body.removeprefix("(?s:").replace("\\z", "").replace("\\Z", "")
    return "(?s)^(?:" + body.removesuffix(")") + ")$"


def excluded(path: Column, patterns: list[str] = EXCLUDES) -> Column:
    """Whole path, base name or folder prefix matches a pattern."""
    p = slashes(path)
    name = F.element_at(F.split(p, "/"), -1)
    hit = F.lit(False)
    for x in dict.fromkeys(patterns):
        if x.endswith("/") and "*" not in x:
            hit = hit | p.startswith(x) | p.contains("/" + x) | (p == x[:-1])
        elif x.endswith("/"):
            hit = hit | p.rlike("(?:^|/)" + _glob(x[:-1]).removeprefix("(?s)^").removesuffix("$") + "/")
        else:
            hit = hit | p.rlike(_glob(x)) | name.rlike(_glob(x))
    return F.coalesce(hit, F.lit(False))


def infrastructure(path: Column) -> Column:
    p = slashes(path)
    name = F.element_at(F.split(p, "/"), -1)
    hit = F.lit(False)
    for x in INFRA_NAMES:
        hit = hit | name.rlike(_glob(x))
    for x in INFRA_DIRS:
        hit = hit | p.startswith(x) | p.contains("/" + x)
    return F.coalesce(hit, F.lit(False))


def entry_score(path: Column, imported: Column, external: Column) -> Column:
    """Points for being an entry file: its name, a package's entry, imported by nobody, a web framework."""
    p = F.lower(slashes(path))
    low = F.lower(F.concat_ws(",", external))
    one = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return (
        one(p.isin(ENTRY_NAMES), 3)
        + one(p.endswith("/__init__.py") | p.endswith("/__main__.py"), 1)
        + one(~imported & ~_prefixes(["alembic/", "migrations/", "tests/", "test/"])(p), 1)
        + one(low.contains("fastapi") | low.contains("flask"), 2)
        + one(_prefixes(["backend/", "src/"])(p) & (p.endswith("/__init__.py") | p.endswith("/main.py") | p.endswith("/app.py")), 1)
    ).cast("bigint")


def tour_score(path: Column, imported: Column, external: Column) -> Column:
    """Points for being a place to start a tour: an entry's name at the top, a package outside tests, imported
    by nobody, a framework among the imports."""
    p, used = F.lower(slashes(path)), F.lower(F.concat_ws(",", external))
    framework = F.lit(False)
    for name in TOUR_FRAMEWORKS:
        framework = framework | used.contains(name)
    rules = {
        "name": p.isin(TOUR_NAMES),
        "package": p.endswith("/__init__.py") & ~_prefixes(["tests/", "test/"])(p),
        "not imported": ~imported & ~_prefixes(TOUR_NOT)(p),
        "framework": framework,
    }
    return sum((F.when(F.coalesce(rules[k], F.lit(False)), n).otherwise(0) for k, n in TOUR_POINTS.items()), F.lit(0)).cast("bigint")
