"""The SQL twins against the Spark operators on hand-made rows that the given tables do not have."""

import random

import duckdb
import pyarrow as pa

from riskweave.llm import exact_dedup, secrets, urls
from riskweave.llm.oracles import ORACLE, URL_RULES
from test_secrets import TEXTS
from test_urls import URLS


def duck(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def alike(spark_rows, sql_rows, key):
    a = sorted((r.asDict() for r in spark_rows), key=lambda r: str(r[key]))
    b = sorted(sql_rows, key=lambda r: str(r[key]))
    for x, y in zip(a, b, strict=True):
        assert {k: round(v, 6) if isinstance(v, float) else v for k, v in x.items()} == \
            {k: round(v, 6) if isinstance(v, float) else v for k, v in y.items()}


def test_secret_twin(spark):
    rng = random.Random(8)
    parts = ["user=alice", "login: bob99", "Zq81xkPq02mVbb71LLsd9", "https://db.example.net/x?y=1", "password=supersecret1",
             "AKIAABCDEFGHIJKL12", "0123456789abcdef" * 2, "word " * 45, "é 😀", "\n\n", "s3://bucket/key", "client_id='abc' "]
    texts = TEXTS + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    rows = list(enumerate(texts))
    got = secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    table = pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})
    alike(got, duck(ORACLE["op1_secret_scan"], documents=table), "doc_id")
    assert sum("opaque" in r["spans"] for r in got) > 10 and sum("endpoint" in r["spans"] for r in got) > 10


def test_exact_twin(spark):
    rows = [(i, random.Random(i).choice(["a", "A", "é", "É", None, "", "x y"])) for i in range(60)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    table = pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})
    alike(got, duck(ORACLE["op2_exact_dedup"], documents=table), "doc_id")


def test_url_twin(spark):
    rng = random.Random(3)
    hosts = [f"{a}.d{b}.{t}" for a in "pqr" for b in range(3) for t in ("com", "net", "org")]
    rows = list(enumerate(URLS + [f"http://{rng.choice(hosts)}/{rng.choice(['fr', 'de', 'en', 'es'])}/{rng.randint(1, 20)}" for _ in range(300)]))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    table = pa.table({"page_id": [i for i, _ in rows], "url": pa.array([t for _, t in rows], pa.string())})
    alike(got, duck(ORACLE["op5_url_filter"], pages=table), "page_id")
    assert {r["verdict"] for r in got} == {"allow", "block"}
