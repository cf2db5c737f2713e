"""The filter audit against its SQL and against brute force on awkward rows."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gradus.llm import op11_filters

from . import fixtures, test_oracles

NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SPAN = " ".join(f"w{i}" for i in range(60))
DOCS = [
    *fixtures.DOCS,
    (30, SPAN, "en", "a", 1),
    (31, SPAN, "en", None, 1),
    (29, SPAN, "en", "", 1),
    (29, SPAN, "en", "a", 1),
    (None, SPAN, "en", "a", 1),
    (32, SPAN[:-1] + "x", "en", "a", 1),
    (33, SPAN.upper(), "en", "b", 1),
    (34, SPAN + " 5%", "en", "b", 1),
    (-3, "\x0b\x0c\r", "en", "b", 1),
    (35, "\x0b\x0c\r", "en", "b", 1),
    (36, "é" * 3000 + SPAN, "fr", "b", 1),
    (37, "é" * 3000 + SPAN, "fr", "b", 1),
    (38, "é" * 3000 + SPAN[:-1] + "y", "fr", "c", 1),
]
LABELS = [(30, 1, 0), (30, 0, 1), (31, 1, 1), (9, 1, None), (None, 1, 1), (33, None, 1), (37, 1, 1), (5, 1, 1)]


def masks(docs):
    out = []
    for doc, text, _, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append(
            {
                f
                for f, bad in {
                    "A": len(words) < 50,
                    "B": 100 * len(set(words)) < 65 * len(words),
                    "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                    "D": bool(re.search(r"[#$%&*|]", text)),
                    "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, *_ in docs),
                }.items()
                if bad
            }
        )
    return out


def audited(docs, labels):
    """Every order applied document by document."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    fails, out = masks(docs), {}
    parts = {r[3] or "" for r in docs}
    for part in parts:
        rows = [(r[0], f) for r, f in zip(docs, fails) if (r[3] or "") == part]
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(f in r[1] for r in rows) - len(gone),
                    sum(r[1] == {f} for r in rows),
                    sum(r[0] in good for r in gone),
                    sum(r[0] in toxic for r in gone),
                ]
        for f in "ABCDE":
            steps = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            whole = sum(out[k][1] for k in steps)
            for k in steps:
                out[k].append(whole)
    return out


def got(frame):
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES[3:]] for r in frame.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "1 AS n")
    return fixtures.documents(spark, DOCS).selectExpr("*", "'x' AS part", "2 AS mask", "3 AS hashes"), labels


def test_audit_equals_every_order_one_document_at_a_time(tables):
    assert got(op11_filters.audit(*tables)) == audited(DOCS, LABELS)


def test_long_texts_part_at_late_blocks(tables):
    found = {(r["doc_id"], r["mask"]) for r in op11_filters.masked(tables[0], ends=(8, 64, 512)).collect()}
    want = {(r[0], sum(1 << "ABCDE".index(f) for f in m)) for r, m in zip(DOCS, masks(DOCS))}
    assert found == want


def test_texts_of_one_key_are_told_apart_by_their_text(tables, monkeypatch):
    # Hashes that say nothing: only lengths split, so the full comparison has to do it.
    monkeypatch.setattr(op11_filters.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert got(op11_filters.audit(*tables)) == audited(DOCS, LABELS)


def test_hot_keys_are_not_gathered(tables, monkeypatch):
    monkeypatch.setattr(op11_filters.graph, "BROADCAST_ROWS", 0)
    assert got(op11_filters.audit(*tables)) == audited(DOCS, LABELS)


def test_empty_tables(tables):
    docs, labels = tables
    assert op11_filters.audit(docs.limit(0), labels).count() == 0
    assert got(op11_filters.audit(docs, labels.limit(0))) == audited(DOCS, [])


def test_given_tables_equal_sql(spark):
    found = sorted(tuple(r[n] for n in NAMES) for r in op11_filters.op11(spark, test_oracles.SF).collect())
    con = test_oracles.duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{test_oracles.SF}/{t}.parquet'")
    assert found == sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({test_oracles.queries.oracle_sql()['op11_filters']})").fetchall())
