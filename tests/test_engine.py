"""Pages to facts to relationships."""

import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.operators import candidates, classify, consistency, facts, scan
from ledgerloom.plans import evaluate, pipeline, store
from ledgerloom.sources import documents as D

PAGE = f"document_id string, document_name string, ingest_seq long, page int, text string, blocks {facts.BLOCKS_TYPE}"


def pages(spark, *rows):
    return spark.createDataFrame([(d, n, s, p, t, [(i, b, i * 100, i * 100 + len(b)) for i, b in enumerate(bs)]) for d, n, s, p, t, bs in rows], PAGE)


def test_narrative_pieces():
    got = list(scan.narrative("Real GDP is estimated to grow by 6.4 per cent in FY25. Prices rose 9.2% a year ago."))
    assert [(g["attribute"], g["raw_value"], g["period_text"]) for g in got] == [("Real GDP", "6.4 per cent", "FY25")]
    assert not list(scan.narrative("This page has words but no figures at all."))
    assert not list(scan.narrative("Value of 5 crore " + "x" * 400))


def test_table_pieces():
    blocks = [{"block_no": i, "text": t, "char_start": 0, "char_end": 0} for i, t in enumerate(["FY2023\nFY2024", "Total income (₹ in million)\n100.00\n120.00", "Team size(1)\n5\n6\n7", "Lone\n5"])]
    got = list(scan.tables("(1) Permanent staff only", blocks))
    assert [(g["attribute"], g["raw_value"], g["column"] and g["column"]["raw"], g["column_confidence"]) for g in got] == [
        ("Total income (₹ in million)", "100.00", "FY2023", 1.0), ("Total income (₹ in million)", "120.00", "FY2024", 1.0),
        ("Team size", "5", None, 0.6), ("Team size", "6", "FY2023", 0.6), ("Team size", "7", "FY2024", 0.6)]
    assert got[2]["definition"] == "Permanent staff only"


def test_headers():
    kinds = lambda text: [(c.kind, c.year, c.quarter, c.day) for c in scan.header_columns(text)]
    assert kinds("Q4 FY24 Q3 FY24 FY2023") == [("quarter", 2024, 4, None), ("quarter", 2024, 3, None), ("fiscal_year", 2023, None, None)]
    assert kinds("nine months ended December 31, 2021 fiscal 2020") == [("range", 2022, None, date(2021, 12, 31)), ("fiscal_year", 2020, None, date(2020, 3, 31))]
    assert kinds("Year ended March 31, 2024 and, on another day, as at June 30, 2024") == [("fiscal_year", 2024, None, date(2024, 3, 31)), ("as_of", 2025, None, date(2024, 6, 30))]
    assert kinds("FY ended December 31, 2023") == [("as_of", 2024, None, date(2023, 12, 31))] and kinds("half ended June 30, 2023")[0][0] == "range"
    assert kinds("FY1999-00 FY24/2025 2019") == [("fiscal_year", 2000, None, None), ("fiscal_year", 2025, None, None), ("calendar_year", None, None, date(2019, 12, 31))]
    assert kinds("FY123") == [] and kinds("February 31, 1850") == [] and kinds("February 31, 1950")[0][0] == "calendar_year" and kinds("February 28, 1850")[0][0] == "as_of"
    assert scan.column_scopes("Standalone Consolidated", 4) == ["standalone"] * 2 + ["consolidated"] * 2
    assert scan.column_scopes("Consolidated", 2) == ["consolidated"] * 2 and scan.column_scopes("", 1) == [None]


def test_column_periods_are_those_of_their_text(spark):
    """A typed column agrees with what the same span means in running text."""
    from ledgerloom.functions import periods as P

    texts = ["Q4 FY24", "FY2023-24", "FY1999-00", "March 31, 2024", "June 30, 2024", "2019", "FY 07", "February 31, 1950"]
    rows = spark.createDataFrame([(t, tuple(scan.header_columns(t)[0])) for t in texts], "text string, c struct<kind:string,raw:string,year:int,quarter:int,day:date>")
    got = rows.select("text", P.column_period(F.col("c")).alias("a"), P.parse_period(F.col("text")).alias("b")).collect()
    same = ("kind", "label", "fy_end_year", "quarter", "end_date")
    assert [[r["a"][n] for n in same] for r in got] == [[r["b"][n] for n in same] for r in got]


def test_names_of_metrics():
    assert scan.metric_name(" ,: And the total revenue ;") == "total revenue"
    assert scan.metric_name("In the meanwhile our net worth,") == "net worth" and scan.metric_name("the of") is None
    assert scan.metric_name(" ".join(f"word{i}" for i in range(20))) == " ".join(f"word{i}" for i in range(8, 20))


def test_a_new_heading_starts_a_new_table():
    block = lambda i, t: {"block_no": i, "text": t, "char_start": i, "char_end": i}
    got = list(scan.tables("", [block(0, "As at\nMarch 31,"), block(1, "2023\n2024"), block(2, "2025\nNet worth\n1\n2\n3"), block(3, "Standalone\nFY2020\nFY2021"), block(4, "Net worth\n4\n5"), block(5, "Other income\n6\n7")]))
    assert [(g["raw_value"], g["column"]["year"] or g["column"]["day"].year, g["scope"]) for g in got if g["column"]] == [("1", 2023, None), ("2", 2024, None), ("3", 2025, None), ("4", 2020, "standalone"), ("5", 2021, "standalone"), ("6", 2020, "standalone"), ("7", 2021, "standalone")]


@pytest.fixture(scope="module")
def known(spark):
    india = "India India India India India reports.\n\n"
    rows = pages(
        spark,
        ("d1", "survey-india.pdf", 1, 1, india + "Real GDP is estimated to grow by 6.4 per cent in FY25.", []),
        ("d2", "bulletin-india.pdf", 2, 1, india + "Real GDP growth was 6.5 per cent in FY25.\n\nConsolidated revenue from operations stood at ₹ 81,415.38 million in FY2024.", []),
        ("d3", "deck-india.pdf", 3, 1, india + "A deck.", ["₹8,142 Cr", "FY24 Revenue from Services YoY"]),
        ("d4", "table-india.pdf", 4, 1, india + "A table.", ["FY2023\nFY2024", "Total income (₹ in million)\n100.00\n120.00"]),
        ("d5", "blank.pdf", 5, 1, "", []),
        ("d6", "nulls.pdf", 6, 1, None, []),
    )
    return pipeline.build(rows)


def test_facts(known):
    got = {(r["document_id"], r["canonical_attribute"], r["period_key"]): r for r in known.facts.collect()}
    assert set(got) == {("d1", "gdp growth", "FY2025"), ("d2", "gdp growth", "FY2025"), ("d2", "revenue", "FY2024"), ("d3", "revenue", "FY2024"), ("d4", "total income", "FY2023"), ("d4", "total income", "FY2024")}
    first = got["d1", "gdp growth", "FY2025"]
    assert (first["canonical_entity"], first["status"], first["confidence"], first["raw_unit"]) == ("India", "estimate", 0.78, "%")
    revenue, tile = got["d2", "revenue", "FY2024"], got["d3", "revenue", "FY2024"]
    assert revenue["normalized_value"] == 8.141538e10 and revenue["scope"] == "consolidated" and revenue["status"] == "actual"
    assert tile["normalized_value"] == 8.142e10 and tile["confidence"] == 0.72 and tile["attribute"] == "Revenue from Services"
    assert got["d4", "total income", "FY2023"]["confidence"] == 0.7 and got["d4", "total income", "FY2024"]["normalized_value"] == 1.2e8


def test_relationships(known):
    rows = known.relationships.collect()
    kinds = {(r["relation"], r["confidence"]) for r in rows}
    assert ("corroborates", 0.894) in kinds and any(r["relation"] == "contradicts" for r in rows)
    five = next(r for r in rows if r["rule"] == "R5")
    assert five["context_differences"] == ["different units (cr vs million)", "different scope (unspecified vs consolidated)"] and "written in different units" in five["explanation"]


def test_store(spark, known):
    assert store.search(known.facts, "revenue").count() == 2 and store.facts_list(known.facts, entity="ind", fact_type="percentage").count() == 2
    assert store.relationships_of(known.relationships, known.facts.limit(0)).count() == 0
    both = store.enriched(known.relationships, known.facts, ["document_id"]).collect()
    assert all(r["fact_a"]["document_id"] > r["fact_b"]["document_id"] for r in both)
    left = store.without_document(known.documents, known.facts, known.relationships, F.col("document_id") == "d2")
    assert [x.count() for x in left][:2] == [5, 4] and left[2].count() == known.relationships.count() - known.relationships.where("rule IN ('R5', 'R8')").count()
    old, new = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, s int"), spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, s int")
    assert sorted((r["k"], r["v"]) for r in store.merged(old, new, "k", "s").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert evaluate.grounding(known.facts).first()["rate"] == 1.0


FACT = "fact_id string, canonical_entity string, canonical_attribute string, fact_type string, raw_value string, raw_unit string, normalized_unit string, kind string, period_key string, status string, scope string, definition string, document_name string, page int, confidence double"
CASES = [  # two facts as differences from a plain one, and what they are to each other
    ({"raw_value": "₹8,142 Cr"}, {"raw_value": "₹81,415.38 million"}, "corroborates", 0.91),
    ({"raw_value": "6.4 per cent", "normalized_unit": "percent"}, {"raw_value": "6.5 per cent", "normalized_unit": "percent"}, "contradicts", 0.84),
    ({"period_key": "range:2021-12-31"}, {"raw_value": "₹63,713"}, "contextually_different", 0.99),
    ({"scope": "standalone", "raw_value": "₹5 Cr"}, {"scope": "consolidated"}, "contextually_different", 0.99),
    ({"normalized_unit": "percent"}, {}, "related_not_comparable", 0.4),
    ({"canonical_entity": "Other"}, {}, None, None),
    ({"raw_value": "₹5 Cr", "confidence": 0.4}, {}, "uncertain", 0.38),
    ({"raw_value": "n/a"}, {}, "uncertain", 0.3),
    ({"kind": "unknown"}, {}, "corroborates", 0.77),
    ({"kind": "unknown", "raw_value": "₹5 Cr"}, {}, "uncertain", 0.35),
    ({"raw_value": "₹5 Cr", "definition": "alpha beta"}, {"definition": "gamma delta"}, "contextually_different", 0.99),
    ({"raw_value": "₹5 Cr", "status": "estimate"}, {"status": "actual"}, "contradicts", 0.714),
    ({"normalized_unit": "USD", "raw_value": "$8,142 Cr"}, {}, "contradicts", 0.84),
]


@pytest.mark.parametrize(("a", "b", "relation", "confidence"), CASES)
def test_rules(spark, a, b, relation, confidence):
    plain = {"fact_id": "x", "canonical_entity": "India", "canonical_attribute": "revenue", "fact_type": "monetary", "raw_value": "₹8,142 Cr", "raw_unit": None, "normalized_unit": "INR", "kind": "fiscal_year", "period_key": "FY2024",
             "status": "unknown", "scope": None, "definition": None, "document_name": "d", "page": 1, "confidence": 0.8}
    rows = spark.createDataFrame([tuple((plain | a | {"fact_id": "fa"}).values()), tuple((plain | b | {"fact_id": "fb"}).values())], FACT)
    rows = rows.withColumns({"period": F.struct("kind", F.col("period_key").alias("label")), "seq": F.struct(F.lit(1).alias("page"), F.lit(0).alias("ordinal"))})
    pair = rows.where("fact_id = 'fa'").select(F.col("fact_id").alias("a_id"), F.col("seq").alias("a_seq"), F.lit("fb").alias("b_id"))
    got = classify.classified(classify.paired(pair, rows, rows)).collect()
    assert ([(r["relation"], r["confidence"]) for r in got] or [(None, None)]) == [(relation, confidence)]


def test_identities(spark):
    cols = "document_id string, document_name string, canonical_entity string, period_key string, scope string, normalized_unit string, fact_type string, canonical_attribute string, normalized_value double, raw_value string, page int, confidence double"
    row = lambda doc, fam, v, page, conf=0.8: (doc, doc, "X", "FY2024", None, "INR", "monetary", fam, v, str(v), page, conf)
    data = [row("ok", "total income", 85942.34e6, 22), row("ok", "revenue", 81415.38e6, 22), row("ok", "other income", 4526.96e6, 22), row("ok", "revenue", 1.0, 22, 0.5),
            row("bad", "total income", 90000e6, 22), row("bad", "revenue", 81415.38e6, 22), row("bad", "other income", 4526.96e6, 22),
            row("far", "total income", 85942.34e6, 22), row("far", "revenue", 81415.38e6, 22), row("far", "other income", 4526.96e6, 80)]
    rows = spark.createDataFrame(data, cols).withColumns({"period": F.struct(F.lit("FY2024").alias("label")), "seq": F.struct(F.lit(1).alias("page"), F.lit(0).alias("ordinal"))})
    assert {r["document_id"]: r["ok"] for r in consistency.identity_checks(rows).collect()} == {"ok": True, "bad": False}


def test_uploads_and_hashes(spark):
    rows = spark.createDataFrame([("a b.pdf", bytearray(b"%PDF-1")), ("x.txt", bytearray(b"%PDF-1")), ("y.pdf", bytearray(b"no")), ("z.pdf", bytearray(b"%PDF-1"))], "name string, content binary")
    got = D.checked_uploads(rows, EngineConfig()).orderBy("name").collect()
    assert [(r["safe_name"], r["reject_reason"]) for r in got] == [("a_b.pdf", None), ("x.txt", "not a pdf name"), ("y.pdf", "not a pdf"), ("z.pdf", None)]
    hashed = D.hashed(rows.withColumn("n", F.monotonically_increasing_id()), "content")
    assert D.new_documents(hashed, None, "n").count() == 2 and D.new_documents(hashed, hashed.limit(1), "n").count() == 1


def test_block_offsets(spark):
    rows = spark.createDataFrame([("d", 1, "a b a", [(2, "zz"), (0, "b"), (1, "a")]), ("d", 2, None, [(0, "x")]), ("e", 1, "x", None), ("f", 1, "", [])], "document_id string, page int, text string, blocks array<struct<block_no:int,text:string>>")
    assert sorted(map(tuple, D.block_offsets(rows).collect())) == [("d", 1, 0, 2, 3), ("d", 1, 1, 4, 5), ("d", 1, 2, 0, 2), ("d", 2, 0, 0, 1)]


def test_files_from_a_folder(spark, tmp_path):
    from ledgerloom.sources import pdf

    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF-page of " + name.encode() + b" with some words")
    files = D.numbered(D.hashed(D.checked_uploads(D.binary_files(spark, str(tmp_path))), "content").where("accepted"), "path")
    assert [r["name"] for r in files.orderBy("ingest_seq").collect()] == ["a.pdf", "b.pdf"]
    rows = pdf.loaded(files, lambda content: [(content.decode().removeprefix("%PDF-"), [])])
    assert pipeline.build(rows.drop("error")).documents.count() == 2


def test_a_folder_of_files(spark, tmp_path):
    """Path to knowledge in one call; what fails or comes twice is told."""

    def loader(content: bytes):
        if b"broken" in content:
            raise ValueError("malformed")
        return [(content.decode().removeprefix("%PDF-"), [])]

    said = b"%PDF-Acme Acme Acme Acme Acme Acme.\n\nNet worth stood at 5 crore in FY2024."
    for name, content in (("a.pdf", said), ("b.pdf", b"%PDF-broken"), ("c.pdf", said), ("d.txt", said), ("e.pdf", b"no pdf"), ("f.pdf", b"%PDF-known already, long enough")):
        (tmp_path / name).write_bytes(content)
    known = spark.createDataFrame([(hashlib.sha256(b"%PDF-known already, long enough").hexdigest(),)], "sha256 string")
    report, knowledge = pipeline.ingested(spark, str(tmp_path), loader, known)
    assert {r["name"]: (r["status"], r["error"], r["page_count"]) for r in report.collect()} == {
        "a.pdf": ("processed", None, 1), "b.pdf": ("failed", "malformed", 0), "c.pdf": ("duplicate", None, None), "d.txt": ("rejected", "not a pdf name", None),
        "e.pdf": ("rejected", "not a pdf", None), "f.pdf": ("duplicate", None, None)}
    assert [r["canonical_attribute"] for r in knowledge.facts.collect()] == ["net worth"]
    assert store.by_content(knowledge.documents, said).count() == 1 and store.by_content(knowledge.documents, b"x").count() == 0


def test_labelled(known):
    cases = known.facts.sparkSession.createDataFrame([("r", "India", "revenue", "bulletin", "81,415.38", "deck", "8,142", "corroborates"), ("m", "India", "revenue", "none", "1", "deck", "8,142", "contradicts")],
                                                     "name string, entity string, family string, doc_a string, value_a string, doc_b string, value_b string, expected string")
    got = evaluate.labelled(cases, known.facts, known.relationships)
    assert {r["name"]: r["predicted"] for r in got.collect()} == {"r": "corroborates", "m": None}
    assert evaluate.accuracy(got).first()["accuracy"] == 0.5


def test_answers(spark, known):
    from ledgerloom.operators.augment import augmented

    text = "Some page that says: net worth was ₹5 crore in FY2024, which is plenty of text."
    rows = pages(spark, ("d", "n", 1, 1, text, []), ("d", "n", 1, 2, text, []), ("d", "n", 1, 3, "short", []))
    good = '{"attribute": "net worth", "value": "₹5 crore", "period": "FY2024", "status": "actual", "evidence": "net worth was ₹5 crore", "entity": "the company"}'
    answers = spark.createDataFrame([("d", 1, 'Sure: {"facts": [' + good + ', {"attribute": "x", "value": "7", "evidence": "made up"}]} done'), ("d", 2, "no json"), ("d", 3, '{"facts": [' + good + "]}")], "document_id string, page int, answer string")
    got = augmented(rows, answers, spark.createDataFrame([("d", "Acme")], "document_id string, primary_entity string")).collect()
    assert [(r["canonical_entity"], r["canonical_attribute"], r["normalized_value"], r["period_key"], r["status"], r["confidence"], r["page"]) for r in got] == [("Acme", "net worth", 5e7, "FY2024", "actual", 0.65, 1)]
    assert {f.name for f in augmented(rows, answers, spark.createDataFrame([], "document_id string, primary_entity string")).schema} == {f.name for f in known.facts.schema}


def test_loaded_files(spark):
    from ledgerloom.sources import pdf

    def loader(content: bytes):
        if not content.startswith(b"%PDF-"):
            raise ValueError("malformed")
        return [(p, p.split("\n")) for p in content.decode().removeprefix("%PDF-").split("|")]

    files = D.hashed(spark.createDataFrame([("a.pdf", bytearray(b"%PDF-one\ntwo and some more words|"), 1), ("b.pdf", bytearray(b"junk"), 2)], "name string, content binary, ingest_seq long"), "content")
    rows = pdf.loaded(files, loader)
    assert sorted((r["document_name"], r["page"] or 0, len(r["blocks"] or [])) for r in rows.collect()) == [("a.pdf", 1, 2), ("a.pdf", 2, 1), ("b.pdf", 0, 0)]
    assert {r["document_name"]: (r["status"], r["error"], r["page_count"], r["scanned_pages"]) for r in pdf.document_states(rows).collect()} == {"a.pdf": ("processed", None, 2, 1), "b.pdf": ("failed", "malformed", 0, 0)}
    assert pdf.block_spans("a b a", ["b", "a", "zz"]) == [{"block_no": 0, "text": "b", "char_start": 2, "char_end": 3}, {"block_no": 1, "text": "a", "char_start": 4, "char_end": 5}, {"block_no": 2, "text": "zz", "char_start": 0, "char_end": 2}]
    assert pdf.document_states(pdf.loaded(files)).where("status = 'failed'").count() == 2


def test_document_state(spark):
    cols = "document_id string, name string, status string, fact_count int"
    got = store.upserted_documents(spark.createDataFrame([("a", "first", "processing", 0), ("b", "b", "processed", 1)], cols), spark.createDataFrame([("a", "second", "processed", 3), ("c", "c", "failed", 0)], cols))
    assert sorted(map(tuple, got.collect())) == [("a", "first", "processed", 3), ("b", "b", "processed", 1), ("c", "c", "failed", 0)]
    shown = spark.createDataFrame([(2.5e9,), (81_420_000.0,), (-150_000.0,), (12.0,)], "v double").select(store.amounts_shown(F.col("v")).alias("s"))
    assert [r["s"] for r in shown.collect()] == ["2.50 B", "8.14 Cr", "-1.50 L", "12.00"]


def test_empty(spark):
    none = pipeline.build(pages(spark, ("d", "n", 1, 1, "", [])).limit(0))
    assert none.facts.count() == 0 and none.relationships.count() == 0
    assert candidates.candidate_pairs(none.facts, none.facts).count() == 0
