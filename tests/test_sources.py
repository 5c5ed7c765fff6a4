import json

import pytest
from pyspark.sql import functions as F

from palisade import Bundle, Registry
from palisade.functions.querytext import parse_query
from palisade.session import shared_folder
from palisade.sources.config import ConfigError, check_config, load_config, resolve_env
from palisade.sources.readers import Split, read_landed_json, reader_options

DB = {"host": "h", "database": "d", "username": "u", "password": "${TEST_DB_PASSWORD}"}


def source(kind, credentials=DB, **connection):
    return {"name": "s", "type": kind, "connection": connection, "credentials": credentials}


@pytest.fixture(autouse=True)
def password(monkeypatch):
    monkeypatch.setenv("TEST_DB_PASSWORD", "p")


def test_database_options():
    fmt, o = reader_options(source("postgres", host="db"), "t")
    assert fmt == "jdbc" and o["url"] == "jdbc:postgresql://db:5432/d"
    assert (o["user"], o["password"], o["dbtable"]) == ("u", "p", "t")
    assert reader_options(source("mysql", host="db"), "t")[1]["url"] == "jdbc:mysql://db:3306/d"
    assert reader_options(source("mariadb", port=99), "t")[1]["url"] == "jdbc:mariadb://h:99/d"
    split = Split("id", 8, "0", "1000")
    o = reader_options(source("postgres"), query="SELECT 1", split=split)[1]
    assert o["dbtable"] == "(SELECT 1) AS src"
    assert (o["partitionColumn"], o["numPartitions"]) == ("id", "8")


def test_cloud_options():
    place = {"project": "p", "region": "r", "instance": "i", "database": "d"}
    assert "cloudSqlInstance=p:r:i" in reader_options(source("cloud-sql-postgres", **place), "t")[1]["url"]
    assert reader_options(source("cloud-sql-mysql", **place), "t")[1]["url"].startswith("jdbc:mysql:///d?")
    assert "instances/i" in reader_options(source("alloydb", **place), "t")[1]["url"]
    assert reader_options(source("alloydb", host="h"), "t")[1]["url"] == "jdbc:postgresql://h:5432/d"
    assert reader_options(source("bigquery", **place), "t") == ("bigquery", {"parentProject": "p", "table": "t"})
    fmt, o = reader_options(source("spanner", **place), "t")
    assert fmt == "cloud-spanner" and o["instanceId"] == "i"


def test_missing_environment_variable(monkeypatch):
    monkeypatch.delenv("TEST_DB_PASSWORD")
    with pytest.raises(KeyError):
        resolve_env("x-${TEST_DB_PASSWORD}")


def test_landed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"repo": "x"}, {"repo": "y"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"repo": "z"}, indent=1))
    assert sorted(r["repo"] for r in read_landed_json(spark, str(tmp_path)).collect()) == ["x", "y", "z"]


def test_live_rest_rows(spark, tmp_path):
    """Pages are fetched by tasks; file URLs stand in for a service."""
    from palisade.sources.rest import read_rest

    (tmp_path / "p1").write_text(json.dumps([{"id": 1, "n": {"x": "a"}}, {"id": 2}]))
    (tmp_path / "p2").write_text(json.dumps({"id": 3, "extra": True}))
    api = source("rest", {"apiKey": "k"}, url=f"file://{tmp_path}/")
    df = read_rest(spark, api, ["p1", "p2"], "id bigint, n struct<x:string>")
    assert sorted((r["id"], r["n"] and r["n"]["x"]) for r in df.collect()) == [(1, "a"), (2, None), (3, None)]
    with pytest.raises(Exception, match="No such file"):
        read_rest(spark, api, ["none"], "id bigint").collect()


def test_registry(spark, sf, tmp_path):
    reg = Registry().add_files("files", sf, ["nation", "no_such_table"])
    assert reg.load(spark, "files", "nation").count() == 25
    with pytest.raises(ValueError, match="Duplicate"):
        reg.add_files("files", sf, [])
    with pytest.raises(KeyError, match="Available: files"):
        reg.load(spark, "other", "nation")
    probe = {r["table"]: r for r in reg.probe(spark).collect()}
    assert probe["nation"]["reachable"] and probe["nation"]["error"] is None
    assert not probe["no_such_table"]["reachable"] and probe["no_such_table"]["error"]
    reg.add_source({**source("rest", {"apiKey": "secret-key"}, url=str(tmp_path)), "name": "api"})
    for table, value in (("any", 1), ("other", 2)):
        (tmp_path / table).mkdir()
        (tmp_path / table / "a.json").write_text(json.dumps({"a": value}))
    assert reg.load(spark, "api", "any").first()["a"] == 1 and reg.load(spark, "api", "other").first()["a"] == 2
    shown = reg.listing(spark)
    assert "secret-key" not in str(shown.collect()) and shown.count() == 2


@pytest.mark.parametrize("fmt", ["csv", "json", "orc"])
def test_file_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    df.write.format(fmt).option("header", True).save(str(tmp_path / f"t.{fmt}"))
    options = {"header": True, "inferSchema": True} if fmt == "csv" else {}
    reg = Registry().add_files("s", str(tmp_path), ["t"], fmt, **options)
    assert [tuple(r) for r in reg.load(spark, "s", "t").select("id", "s").collect()] == [(1, "a")]


def test_one_unreadable_table_does_not_hide_the_others(spark, sf, tmp_path):
    for name in ("a", "b", "c", "d"):
        spark.range(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for file in (tmp_path / "c.parquet").glob("part-*"):
        file.write_bytes(b"PAR1 not a footer PAR1")
    reg = Registry().add_files("files", str(tmp_path), ["a", "b", "none"])
    reg.add("typed", lambda spark, t: spark.read.schema("id long").parquet(f"{tmp_path}/{t}.parquet"), ["c", "d"])
    reg.add("none", lambda spark, t: None)
    probe = {r["table"]: r for r in reg.probe(spark).collect()}
    assert {t: r["reachable"] for t, r in probe.items()} == {"a": True, "b": True, "none": False, "c": False, "d": True}
    assert probe["c"]["error"] and probe["d"]["error"] is None
    assert Registry().probe(spark).collect() == []


@pytest.mark.parametrize("values", [[], [None], [1], [3, 3, 3, 3], [5] * 90 + list(range(30)) + [None] * 7, [1.5, -2.25, 10.0], ["a", "it's", "b", None, "b"]])
@pytest.mark.parametrize("parts", [1, 2, 7])
def test_splits_of_equal_depth(values, parts):
    """The texts a database gets, run by one in this process: each row in exactly one part, none far above its share."""
    import duckdb

    from palisade.sources.readers import cuts_query, predicates

    con = duckdb.connect()
    kind = "VARCHAR" if any(isinstance(v, str) for v in values) else "DOUBLE" if any(isinstance(v, float) for v in values) else "BIGINT"
    con.execute(f"CREATE TABLE t (v {kind})")
    if values:
        con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    cuts = [r[0] for r in con.execute(cuts_query("t", "v", parts)).fetchall()]
    conditions = predicates("v", cuts)
    assert len(conditions) <= parts
    counts = [con.execute(f"SELECT count(*) FROM t WHERE {c}").fetchone()[0] for c in conditions]
    assert sum(counts) == len(values)
    hottest = max((values.count(v) for v in set(values) - {None}), default=0)
    assert all(n <= -(-len(values) // parts) + hottest + values.count(None) for n in counts)


def test_a_split_by_depth_reads_by_conditions(spark, monkeypatch):
    """Options only: there is no database here."""
    from pyspark.sql import DataFrameReader

    from palisade.sources import readers

    asked = {}
    monkeypatch.setattr(DataFrameReader, "load", lambda self: spark.createDataFrame([(10,), (20,)], "cut long"))
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda self, url, table, **options: asked.update(options, url=url, table=table))
    db = {**source("postgres", {"host": "h", "database": "d", "username": "u", "password": "p"}, host="h"), "name": "db"}
    readers.read_source(spark, db, "orders", split=Split("o_orderkey", 3, depth=True))
    assert asked["predicates"] == ["(o_orderkey <= 10 OR o_orderkey IS NULL)", "(o_orderkey > 10 AND o_orderkey <= 20)", "o_orderkey > 20"]
    assert asked["table"] == "orders" and asked["url"].startswith("jdbc:postgresql://h") and asked["properties"]["user"] == "u"


def test_config_defaults():
    config = check_config(
        {
            "sources": [source("rest", {"apiKey": "k"}, url="http://x")],
            "scopes": [],
            "governance": {
                "agentPolicies": [{"agent": "a"}],
                "sourcePolicies": [{"source": "s", "tables": [{"table": "t", "classification": "pii"}]}],
            },
        }
    )
    g = config["governance"]
    assert config["sources"][0]["credentials"]["headerName"] == "Authorization"
    assert g["agentPolicies"][0]["maxRowsPerQuery"] == 1000
    assert g["agentPolicies"][0]["allowedClassifications"] == ["internal", "public"]
    assert g["defaultAgentPolicy"]["allowedClassifications"] == ["public"]
    assert g["sourcePolicies"][0]["defaultClassification"] == "internal"
    assert g["sourcePolicies"][0]["tables"][0]["requireApprovalForWrites"] is True
    assert g["enabled"] and g["retention"]["auditLogDays"] == 365


@pytest.mark.parametrize(
    "bad, where",
    [
        ({"sources": ["x"], "scopes": [5]}, ["sources.0: Expected object, received str", "scopes.0: Expected object, received int"]),
        ({"sources": [], "scopes": [{"agent": "a", "sources": ["s"]}]}, ["scopes.0.sources.0: Expected object, received str"]),
        ({"sources": [], "scopes": [{"agent": "a", "sources": [{"name": "s", "rules": [None, {"fields": [1]}]}]}]},
         ["scopes.0.sources.0.rules.0: Expected object, received NoneType", "scopes.0.sources.0.rules.1.fields.0: Expected str, received int"]),
        ({"sources": [], "scopes": [], "governance": {"sourcePolicies": [1], "agentPolicies": [[]], "defaultAgentPolicy": "x"}},
         ["governance.sourcePolicies.0: Expected object, received int", "governance.agentPolicies.0: Expected object, received list",
          "governance.defaultAgentPolicy: Expected dict, received str"]),
    ],
)
def test_wrong_shapes_are_listed_and_never_crash(bad, where):
    with pytest.raises(ConfigError) as err:
        check_config(bad)
    assert sorted(err.value.problems) == sorted(where)


def test_every_problem_is_listed(tmp_path):
    bad = {
        "sources": [{"type": "oracle", "name": "x", "connection": {}, "credentials": {"host": "h"}}],
        "scopes": [{"agent": "", "sources": []}],
        "governance": {
            "sourcePolicies": [{"source": "s", "tables": [{"table": "t", "classification": "secret", "maxRows": -1}]}]
        },
    }
    with pytest.raises(ConfigError) as err:
        check_config(bad)
    text = "\n".join(err.value.problems)
    for part in (
        "sources.0.type",
        "sources.0.credentials.password: Required",
        "scopes.0.agent: Agent ID must not be empty",
        "scopes.0.sources: At least one source is required",
        "governance.sourcePolicies.0.tables.0.classification",
        "governance.sourcePolicies.0.tables.0.maxRows",
    ):
        assert part in text
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")


def test_config_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"sources": [], "scopes": []}))
    assert load_config(tmp_path / "c.json")["governance"]["enabled"]
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("sources: []\nscopes:\n  - agent: a\n    sources:\n      - {name: s, rules: []}\n")
    bundle = Bundle.from_config(spark, load_config(tmp_path / "c.yaml"))
    row = bundle.scope_rules.first()
    assert (row["agent"], row["source"], row["rule_pos"]) == ("a", "s", None)


@pytest.mark.parametrize(
    "query, table, operation, columns",
    [
        ("SELECT * FROM lots_shipped", "lots_shipped", "SELECT", []),
        ("SELECT 1", "SELECT", "SELECT", []),
        ("SELECT a FROM public.users", "public", "SELECT", ["a"]),
        ("UPDATE users SET a=1", "UPDATE", "UPDATE", []),
        ("  insert into t values (1)", "unknown", "INSERT", []),
        ("WITH c AS (SELECT x FROM t) DELETE", "t", "SELECT", ["x"]),
        ("SELECT a,\n b FROM t", "t", "SELECT", []),
        ("select t.c, x AS y , f(a, b) from t", "t", "SELECT", ["c", "y", "f(a", "b)"]),
        ("SELECT *, FROM t", "t", "SELECT", ["*"]),
        ("SELECT  *  FROM\tt", "t", "SELECT", []),
        ("SELECT a FROM t", "t", "SELECT", ["a"]),
        ("", "unknown", "SELECT", []),
        (" DELETE FROM　x", "x", "DELETE", []),
    ],
)
def test_query_texts(spark, query, table, operation, columns):
    row = spark.createDataFrame([(query,)], "q string").select(*parse_query(F.col("q"))).first()
    assert (row["table"], row["operation"], row["columns"], row["query_length"]) == (
        table,
        operation,
        columns,
        len(query),
    )


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
