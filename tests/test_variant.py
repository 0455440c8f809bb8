"""JSON documents of unlike shape as Variant values."""

from __future__ import annotations

from spendlens.sources import reports


def test_documents_of_unlike_shape(spark):
    rows = [(1, '{"name": "A", "rows": [1, 2], "meta": {"k": 1}}'), (2, '{"name": "B", "score": 2.5}'), (3, "[1, 2]"),
            (4, "not json"), (5, None), (6, "{}")]
    docs = reports.as_variant(spark.createDataFrame(rows, "id long, text string"))
    fields = {(r.id, r.field, r.value) for r in reports.document_fields(docs, ["id"]).collect()}
    assert fields == {(1, "name", '"A"'), (1, "rows", "[1,2]"), (1, "meta", '{"k":1}'), (2, "name", '"B"'), (2, "score", "2.5")}
    got = {r.id: r.v for r in docs.select("id", reports.document_value(docs.doc, "$.name").alias("v")).collect()}
    assert got == {1: "A", 2: "B", 3: None, 4: None, 5: None, 6: None}
