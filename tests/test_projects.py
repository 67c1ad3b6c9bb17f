import json

from lodestack.operators import docstrings, frameworks, packaging
from lodestack.operators import rules as rule_scan
from lodestack.operators.facts import Facts
from lodestack.plans import reports
from lodestack.plans.corpus import Corpus
from lodestack.sources.files import of_columns
from lodestack.streaming import arrivals

DOCS = '''def google(a, b):
    """Sum up.

    Args:
        a (int): first
        gone: old
    Returns:
        int: the sum
    Raises:
        ValueError: if odd
    """

def sphinx(x):
    """Do.

    :param int x: a number
    :returns: y
    :raises KeyError: never
    """

def numpy(x, y):
    """Do.

    Parameters
    ----------
    x : int
        number
    y : str

    Returns
    -------
    float
    """

def none(z): ...
'''


def frame(spark, files):
    return of_columns(spark.createDataFrame(list(files.items()), "path string, content string"))


def test_docstrings(spark):
    facts = Facts(frame(spark, {"d.py": DOCS}))
    got = {r["full_name"]: r["doc"] for r in docstrings.parsed(facts).collect()}
    assert {k: v["style"] for k, v in got.items()} == {"google": "google", "sphinx": "sphinx", "numpy": "numpy"}
    assert [(p["name"], p["type"]) for p in got["google"]["params"]] == [("a", "int"), ("gone", None)] and got["google"]["raises"] == ["ValueError"] and got["google"]["returns"] == "int: the sum"
    assert [(p["name"], p["type"]) for p in got["sphinx"]["params"]] == [("x", "int")] and got["sphinx"]["raises"] == ["KeyError"]
    assert [(p["name"], p["type"]) for p in got["numpy"]["params"]] == [("x", "int"), ("y", "str")] and got["numpy"]["returns"] == "float"
    old = {r["full_name"]: (r["stale"], r["missing"]) for r in docstrings.outdated(facts).collect()}
    assert old == {"google": (["gone"], ["b"]), "none": ([], ["z"])}
    assert {r["s"] for r in facts.defs.select(docstrings.style("docstring").alias("s")).collect()} == {"google", "sphinx", "numpy", None}


def test_requirements(spark):
    text = "# c\nRequests[socks, x]>=2.0, <3 ; python_version > '3'\nflask\\\n==1.0 # why\n-r other.txt\n-e git+https://h/r#egg=My_Pkg\nname @ https://h/x.whl\n--no-index\n"
    rows = packaging.requirements(frame(spark, {"sub/requirements.txt": text})).orderBy("position").collect()
    assert [(r["name"], r["version"], r["extras"], r["editable"]) for r in rows] == [("requests", ">=2.0,<3", ["socks", "x"], False), ("flask", "==1.0", [], False), ("my-pkg", None, [], True), ("name", None, [], False)]
    assert [tuple(r) for r in packaging.includes(frame(spark, {"sub/requirements.txt": text})).collect()] == [("sub/requirements.txt", "sub/other.txt")]
    poetry = '[tool.poetry]\nname = "p"\nversion = "1.0"\n[tool.poetry.dependencies]\npython = "^3"\nrequests = "^2.0"\n[tool.poetry.group.dev.dependencies]\npytest = "*"\n'
    pep = packaging.convert(poetry, "poetry", "pep621")
    assert 'dependencies = ["requests>=2.0"]' in pep and 'dev = ["pytest"]' in pep
    assert packaging.convert(pep, "pep621", "requirements") == "requests>=2.0\n" and 'requests = ">=2.0"' in packaging.convert("requests>=2.0\n", "requirements", "poetry")
    assert 'dev-dependencies = ["pytest"]' in packaging.convert(poetry, "poetry", "uv")
    config = spark.createDataFrame([("p", json.dumps({"tool": {"poetry": {"dependencies": {"a_b": "~1.2"}}}})), ("q", json.dumps({"project": {"dependencies": ["c>1"]}}))], "path string, json string")
    assert {(r["path"], r["group"], r["name"], r["version"]) for r in packaging.project_dependencies(config).collect()} == {("p", "main", "a-b", "~=1.2"), ("q", "main", "c", ">1")}
    assert [r["f"] for r in config.select(packaging.package_format("json").alias("f")).collect()] == ["poetry", "pep621"]
    got = spark.createDataFrame([("1.2.3-rc1",), ("1.2",)], "v string").select(packaging.bump_version("v", "minor").alias("v")).collect()
    assert [r["v"] for r in got] == ["1.3.0", None]


WEB = '''app = Flask(__name__)
bp = Blueprint("admin", __name__)
@app.route("/a", methods=["GET", "post"])
def a(): pass
@bp.route("/b")
@login
def b(): pass
@router.get("/c", response_model=User, status_code=201)
async def c(db=Depends(get_db)): pass
def get_db(): pass
app.add_middleware(Cors, x=1)
class User(Base):
    __tablename__ = "users"
    id = Column(Integer, primary_key=True)
    posts = relationship("Post")
class Post(Base):
    text: str = mapped_column(String)
urlpatterns = [path("x/", views.x, name="x-page"), re_path(r"y", y)]
'''


def test_frameworks(spark):
    files = frame(spark, {"w.py": WEB})
    assert {(r["route"], r["function"], tuple(r["methods"]), r["owner"], r["response_model"], r["status_code"]) for r in frameworks.routes(files).collect()} == {("/a", "a", ("GET", "POST"), None, None, None), ("/b", "b", ("GET",), "bp", None, None), ("/c", "c", ("GET",), "router", "User", "201")}
    assert [tuple(r)[1:] for r in frameworks.groups_of_routes(files).collect()] == [("bp", "blueprint", "admin")]
    assert [tuple(r)[1:] for r in frameworks.injected(files).collect()] == [("get_db", False)] and [r["name"] for r in frameworks.middleware(files).collect()] == ["Cors"]
    found = frameworks.models(files)
    assert {(r["name"], r["table"]) for r in found.collect()} == {("User", "users"), ("Post", "post")}
    assert {tuple(r)[1:] for r in frameworks.columns(found).collect()} == {("User", "id", "Integer"), ("Post", "text", "String")}
    assert [tuple(r)[1:] for r in frameworks.relationships(files).collect()] == [("posts", "Post")]
    assert {(r["route"], r["view"], r["name"]) for r in frameworks.url_patterns(files).collect()} == {("x/", "views.x", "x-page"), ("y", "y", None)}


def test_reports_and_facade(spark, tmp_path):
    corpus = Corpus(frame(spark, {"a.py": 'password = "hunter22"\neval(x)\n', "b.py": DOCS}))
    found = corpus.security_issues().df
    doc = json.loads(reports.sarif_document(found))
    assert [(r["ruleId"], r["level"]) for r in doc["runs"][0]["results"]] == [("UNSAFE_EVAL", "error"), ("HARDCODED_PASSWORD", "error")]
    assert "- a.py: 2" in reports.markdown(found) and len(reports.table(found).split("\n")) == 3 and reports.as_json(found).count() == 2
    reports.as_csv(found, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert "- `google`: Sum up." in reports.api_summary(corpus.facts.defs).where("path = 'b.py'").first()["text"]
    assert corpus.find_functions("^n").count() == 2 and corpus.find_classes().count() == 0 and corpus.analysis_issues().df.count() > 0 and corpus.optimization_opportunities().df.count() == 0


def test_streaming(spark, tmp_path):
    frame(spark, {"a.py": "eval(x)\n"}).write.parquet(str(tmp_path / "in"))
    for want in (1, 2):
        arrivals.on_arrival(spark, str(tmp_path / "in"), "path string, module string, content string, is_test boolean", lambda f: rule_scan.vulnerabilities(f), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == want
        frame(spark, {"b.py": "eval(y)\n"}).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.sql("select timestamp_ntz'2020-01-01 10:00:00' as ts, 'a' as event_type union all select timestamp_ntz'2020-01-01 12:00:00', 'a'")
    assert [r["n"] for r in arrivals.windowed_counts(events).collect()] == [2]
