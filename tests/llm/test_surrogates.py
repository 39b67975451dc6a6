"""Surrogates: size of the broadcast, small address ranges, national phone numbers."""

from pyspark.sql import functions as F

from softseek.llm import surrogates as S

KEY = b"key of the tests"


def test_mappings_are_broadcast_by_bytes(spark, monkeypatch):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("user"), i, F.lit("@mail.example.org"))))
    docs = spark.range(3).select(F.col("id").alias("doc_id"), text.alias("text"))
    asked, broadcast = [], F.broadcast
    monkeypatch.setattr(S.F, "broadcast", lambda df: asked.append(1) or broadcast(df))
    few = S.replace_entities(docs, KEY).orderBy("doc_id").collect()
    assert len(asked) == 1
    assert S.replace_entities(docs, KEY, broadcast_bytes=10_000).orderBy("doc_id").collect() == few
    assert len(asked) == 1


def test_small_address_range_is_left_when_it_is_full(spark):
    """All of 192.168.1-254.1-254 are entities, so none of them can be a surrogate."""
    rows = spark.range(254 * 254).select(
        F.lit("ip").alias("kind"), F.concat_ws(".", F.lit("192.168"), (F.col("id") / 254).cast("int") + 1, F.col("id") % 254 + 1).alias("value")
    )
    made = [r.made for r in S.assign(rows, KEY, rounds=20).collect()]
    assert len(made) == len(set(made)) == 254 * 254
    assert all(m.startswith("10.") for m in made)
    assert S.surrogate("ip", "192.168.3.4", KEY, 0).startswith("192.168.")


def test_national_phones_are_found():
    for number in ("(212) 555-0100", "030 1234567", "(030) 1234567", "0171-1234567", "089/1234567", "01 23 45 67 89", "212-555-0100", "1-212-555-0100", "212.555.0100"):
        text = f"call {number}, please"
        assert [(k, text[a:b]) for k, a, b in S.find_entities(text)] == [("phone", number)]
        made = S.surrogate("phone", S.canonical("phone", number), KEY, 0)
        new = S.shaped(number, made, "phone")
        assert new != number and len(new) == len(number)
    for other in ("01.02.2003 12:30", "2003-01-02", "pages 100-200", "200 300 4000", "v1.2.3", "f(212) 555", "3.14159265358", "12345678901"):
        assert not [x for x in S.find_entities(other) if x[0] == "phone"], other
    assert [k for k, _, _ in S.find_entities("0123 4567 8901 2345")] == ["card"]
    assert [k for k, _, _ in S.find_entities("123-45-6789")] == ["ssn"]
