"""Extracted propositions: exact spans, unique identities, SQL, defined edge cases."""

import duckdb

from evidara.operators import propositions
from evidara.plans import registry

SF = "/root/testdata/sf0.001"


def extracted(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df, {(r["doc_id"], r["ordinal"]): r for r in propositions.extract_propositions(df).collect()}


def test_grammar(spark):
    _, got = extracted(spark, "First. Low  dose is\tnot harmful in  adult mice...", "Is nothing.", "They are .", "Cells were lysed", None, "", "x is y. x is y.", "a is  in b.")
    r = got[0, 1]
    assert (r["subject"], r["predicate"], r["object"], r["qualifier"], r["role"], r["polarity"]) == ("Low  dose", "is\tnot", "harmful", "adult mice", "study-context", "negative")
    assert (r["subject_start"], r["predicate_start"], r["object_start"], r["qualifier_start"]) == (7, 17, 24, 36)
    assert sorted(got) == [(0, 1), (3, 0), (6, 0), (6, 1), (7, 0)]
    assert got[3, 0]["object"] == "lysed" and got[3, 0]["qualifier"] is None and got[3, 0]["role"] is None
    assert got[6, 0]["proposition_id"] != got[6, 1]["proposition_id"]  # equal words at two places
    assert got[7, 0]["object"] == "in b" and got[7, 0]["qualifier"] is None  # nothing stands before the preposition


def test_long_texts_take_linear_time(spark):
    _, got = extracted(spark, "a" + " " * 300_000 + "is" + " " * 300_000 + "b" + " " * 300_000, "word " * 200_000, "x is y" + "." * 300_000)
    assert sorted(got) == [(0, 0), (2, 0)] and got[0, 0]["object"] == "b"


def test_spans_of_documents_are_exact_and_identities_unique(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = propositions.extract_propositions(docs).cache()
    n = found.count()
    assert n > 100 and found.select("proposition_id").distinct().count() == n
    spans = propositions.spans_of_propositions(found, docs)
    assert spans.count() >= 3 * n and propositions.span_violations(spans).count() == 0
    assert propositions.extract_propositions(docs.limit(0)).count() == 0


def test_extraction_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = registry.queries()["extracted_propositions"](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({registry.oracle_sql()['extracted_propositions']})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))
