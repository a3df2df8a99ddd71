"""Entries of contacts are dealt before they are counted."""

from sparkclean.operators import contacts


def test_entries_are_dealt_before_they_are_made_distinct(spark, monkeypatch):
    rows = [("a", ["15550000001", "15550000001"], ["x@a.example"]), ("a", ["15550000001"], []), ("b", [], ["x@a.example"]), ("c", [], [])]
    scanned = spark.createDataFrame(rows, "contact_id string, phones array<string>, emails array<string>")
    monkeypatch.setattr(contacts, "stage", lambda df, name: df)
    found = contacts.entries(scanned)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning(contact_id") :]
    assert sorted((r.contact_id, r.of, r.full) for r in found.collect()) == [("a", "email", "x@a.example"), ("a", "phone", "15550000001"), ("b", "email", "x@a.example")]
