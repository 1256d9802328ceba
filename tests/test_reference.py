"""Hand-computed cases of the engine's own operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexloom.functions import classify, dates, text, urns
from lexloom.operators import enrich, expand, fusion, search, store, topics
from lexloom.sources import akn, files, xml
from lexloom.streaming import incremental


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'date'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_urns(spark):
    def u(x):
        return one(spark, urns.uri_to_urn(F.col("u")), u=x)

    cases = {
        "/akn/it/act/legge/stato/2024-01-11/2/!main": "urn:nir:stato:legge:2024-01-11;2",
        "/akn/it/bill/x": "urn:nir:it:akn:bill;x",
        "/akn/it": "urn:akn:/akn/it",
        "http://dati.senato.it/osr/Ddl/2022-10-13/1/main": "urn:senato:Ddl:2022-10-13;1",
        "http://dati.senato.it/osr/Ddl": "urn:senato:Ddl",
        "urn:nir:x": "urn:nir:x",
        "other": "urn:akn:other",
        "": "urn:akn:",
        None: None,
    }
    for given, want in cases.items():
        assert u(given) == want
        if given is not None:
            assert akn.uri_to_urn(given) == want
    assert one(spark, urns.node_id(F.lit("u"), F.lit("e"))) == "469eac030043f535"
    assert one(spark, urns.last_segments(F.lit("http://x/a/b/c"))) == "b:c"
    assert one(spark, urns.urns_in(F.lit('a urn:nir:b;1 "URN:NIR:c" urn:nir:b;1'))) == ["urn:nir:b;1", "URN:NIR:c"]
    assert one(spark, urns.urns_in(F.lit(None).cast("string"))) == []


def test_href(spark):
    def h(x):
        return one(spark, urns.resolve_href(F.lit("u"), F.col("h")), h=x)

    assert [h("#e"), h("/akn/x"), h("urn:y"), h("http://z"), h("art1")] == ["469eac030043f535", "/akn/x", "urn:y", "http://z", "u#art1"]


def test_text(spark):
    assert one(spark, text.normalize_text(F.lit("  Dell'Acqua\xa0 è_BELLA! "))) == "dellacqua è_bella"
    assert one(spark, text.lucene_escape(F.lit('a+b "c" (d/e)'))) == 'a\\+b \\"c\\" \\(d\\/e\\)'
    assert one(spark, text.inject_context(F.array(F.lit("Art. 1 - Oggetto")), F.lit("1."), F.lit("1.Testo"))) == "Art. 1 - Oggetto > 1: 1.Testo"
    assert one(spark, text.inject_context(F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(spark, text.embedding_payload(F.lit(None).cast("string"), F.lit(""), F.lit("d"))) == "Contesto: None\n\nTesto: d"
    assert len(one(spark, text.embedding_payload(F.lit("t"), F.repeat(F.lit("x"), 5000), F.lit("d")))) == 3500
    t = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1")), F.array(F.lit("2"), F.lit("3"), F.lit("4")))
    assert one(spark, text.table_markdown(t)) == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"
    assert one(spark, text.table_linear(t, F.lit(True))) == "Riga 1: a=1. Riga 2: a=2, b=3"
    assert one(spark, text.table_linear(t, F.lit(False))) == "Riga 1: a, b. Riga 2: 1. Riga 3: 2, 3, 4"
    assert one(spark, text.structural_label(F.lit("Art. 1"), F.lit(" "), F.lit("article"))) == "Art. 1"
    assert one(spark, text.structural_label(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("article"))) == "Article"


def test_classes(spark):
    m = lambda x: one(spark, classify.modification_class(F.col("x")), x=x)
    assert [m("è sostituito e ABROGATO"), m("sostituito"), m("Dopo il comma"), m("altro"), m(None), m("")] == ["REPEAL", "SUBSTITUTION", "INSERTION", "AMENDMENT", "AMENDMENT", "AMENDMENT"]
    s = lambda x: one(spark, classify.step_class(F.col("x")), x=x)
    assert [s("Votazione"), s("Assegnato"), s("emendamento"), s("esame"), s(None)] == ["VOTE", "ASSIGNMENT", "AMENDMENT", "DISCUSSION", "DDL_PRESENTATION"]


def test_dates(spark):
    d = lambda x: one(spark, dates.iso_date(F.col("x")), x=x)
    assert [d("2024-01-11"), d("20240111"), d("2024-1-5"), d("2024"), d(""), d(None)] == [dt.date(2024, 1, 11), dt.date(2024, 1, 11), None, None, None, None]
    assert one(spark, dates.promulgation_date(F.lit("x"))) == dt.date(1, 1, 1)
    for given, want in (((), (None, None)), (("2020-01-01",), ("2020-01-01", None)), (("2020-01-01", "2022-06-30", "2021-01-01", None), ("2020-01-01", "2022-06-30")), (("2020-01-01",) * 2, ("2020-01-01", None))):
        got = spark.createDataFrame([(x,) for x in given], "d string").agg(*(c.alias(n) for n, c in zip("ab", dates.validity(F.to_date("d")), strict=True))).first()
        assert tuple(x and x.isoformat() for x in got) == want


def test_fusion(spark):
    hits = spark.createDataFrame([("q", "a", "vector", 1), ("q", "a", "bm25", 2), ("q", "b", "graph", 1), ("q", "c", "bm25", 1), ("q", "a", "vector", 3)], "query_id string, id string, channel string, rank int")
    got = {r["id"]: (round(r["score"], 12), r["source"], r["place"]) for r in fusion.fuse(hits, fusion.Settings()).collect()}
    assert got == {"a": (round(0.8 / 61 + 1.5 / 62, 12), "bm25+vector", 1), "c": (round(1.5 / 61, 12), "bm25", 2), "b": (round(1 / 61, 12), "graph", 3)}
    assert got["a"][0] == 0.037308302485
    assert fusion.fuse(hits.limit(0), fusion.Settings()).count() == 0


def test_mark_and_merge(spark):
    m = lambda x, end: one(spark, fusion.mark(F.col("x"), F.to_date("end"), F.lit("2020-01-01").cast("date")), x=x, end=end)
    assert [m("t", "2019-12-31"), m("t", "2020-01-01"), m("t", None), m(fusion.MARK + "t", "2019-01-01")] == [fusion.MARK + "t", "t", "t", fusion.MARK + "t"]
    chunks = spark.createDataFrame(
        [("q", "x", "tx", "b", 3.0, "bm25", 1, "w"), ("q", "y", "ty", "a", 1.0, "bm25+vector", 3, "w"), ("q", "z", "tz", "", 2.0, "graph", 2, "v"), ("q", "n", "tn", None, 0.5, "graph", 4, "w")],
        "query_id string, id string, text string, context string, score double, source string, place int, work_key string",
    )
    got = [tuple(r) for r in fusion.merge(chunks).select("id", "text", "context", "score", "source", "place", "members").orderBy("place").collect()]
    assert got == [("merged_n", "tn\n\n--- a ---\nty\n\n--- b ---\ntx", "MULTIPLE_CHUNKS", 3.0, "bm25+graph+vector", 1, ["n", "y", "x"]), ("z", "tz", "", 2.0, "graph", 2, ["z"])]
    key = lambda t, u: one(spark, fusion.work_key(F.col("t"), F.col("u"), F.lit("id")), t=t, u=u)
    assert [key("t", "u"), key("", "u"), key(None, "urn:unknown"), key(None, None)] == ["t", "u", "id", "id"]


def test_search(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [1.0]), ("g", [-1.0, 0.0]), (None, [1.0, 0.0])], "id string, v array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None), ("zero", [0.0, 0.0])], "query_id string, vector array<float>")
    got = [(r["id"], round(r["cosine"], 6), r["rank"]) for r in search.vector_top_k(rows, q, "id", "v", 3).orderBy("rank").collect()]
    assert got == [("a", 1.0, 1), ("b", 1.0, 2), ("c", 0.0, 3)]
    assert search.vector_top_k(rows, q.limit(0), "id", "v", 3).count() == 0
    assert search.vector_top_k(rows.limit(0), q, "id", "v", 3).count() == 0
    many = spark.createDataFrame([(f"m{i:03}", [1.0, 0.0]) for i in range(300)], "id string, v array<float>")
    assert [r["id"] for r in search.vector_top_k(many, q, "id", "v", 5).orderBy("rank").collect()] == [f"m{i:03}" for i in range(5)]


def test_bm25(spark):
    texts = spark.createDataFrame([(1, "acqua acqua fiume"), (2, "acqua monte"), (3, "monte"), (4, None), (5, "")], "id int, t string")
    q = spark.createDataFrame([("q", "ACQUA acqua"), ("empty", "")], "query_id string, text string")
    got = [(r["id"], round(r["score"], 6)) for r in search.bm25_top_k(texts, q, "id", "t", 5).orderBy("rank").collect()]
    import math

    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert got == [(1, round(2 * idf * 2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)), 6)), (2, round(2 * idf * 1 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2)), 6))]
    assert sorted(tuple(r) for r in search.postings(texts, "id", "t").where("id = 1").collect()) == [(1, "acqua", 2, 3), (1, "fiume", 1, 3)]


def test_topics(spark):
    labels = spark.createDataFrame([("c1", "Sole", "pref"), ("c2", "sole", "pref"), ("c3", "SOLE!", "alt"), ("c4", "luce del sole", "alt"), ("c5", "luce", "alt"), ("c0", "luce", "alt"), (None, "x", "pref"), ("c9", None, "pref"), ("c9", "!", "alt")], "concept_id string, label string, kind string")
    d = topics.dictionary(labels)
    assert sorted(tuple(r) for r in d.collect()) == [("luce", "c0", "alt"), ("luce del sole", "c4", "alt"), ("sole", "c2", "pref")]
    texts = spark.createDataFrame([("t", "La LUCE del sole, la console"), ("u", "console"), ("v", None)], "id string, text string")
    assert sorted((r["id"], r["concept_id"], r["label"]) for r in topics.match(texts, d).collect()) == [("t", "c0", "luce"), ("t", "c2", "sole"), ("t", "c4", "luce del sole")]
    assert topics.match(texts, d.limit(0)).count() == 0
    b = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("b", "a"), (None, "a")], "child_id string, parent_id string")
    assert sorted(tuple(r) for r in topics.narrower(b, spark.createDataFrame([("a",)], "concept_id string"), 5).collect()) == [("b", 1), ("c", 2)]


def test_store(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = spark.createDataFrame([("a", "new", [2.0], t(2)), ("a", "old", None, t(1)), ("a", "newest", None, t(3)), ("b", None, None, t(1)), (None, "x", None, t(1))], "id string, text string, embedding array<double>, at timestamp")
    assert sorted(tuple(r) for r in store.upsert(rows, "id", "at", ("text",), ("embedding",)).collect()) == [("a", "old", [2.0]), ("b", None, None)]
    assert store.upsert(rows.unionByName(rows), "id", "at", ("text",), ("embedding",)).exceptAll(store.upsert(rows, "id", "at", ("text",), ("embedding",))).count() == 0
    edges = spark.createDataFrame([(1, "a", "b", "NEXT", 1.0, t(1)), (2, "a", "b", "NEXT", 1.0, t(2)), (3, "a", "x", "NEXT", 1.0, t(1)), (4, "a", "k", "HAS_TOPIC", 0.5, t(1)), (5, "a", "k", "HAS_TOPIC", 0.7, t(2))], "edge_id int, source_id string, target_id string, type string, score double, ingested_at timestamp")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in store.links(edges, ids, ("NEXT",)).collect()] == [("a", "b", "NEXT")]
    assert [tuple(r) for r in store.topic_links(edges, ids).collect()] == [("a", "k", 0.7)]


def test_citation_hops(spark):
    edges = spark.createDataFrame([("a", "b", "CITES"), ("b", "a", "CITES"), ("b", "/akn/it/act/legge/stato/2020-01-01/1/!main", "CITES"), ("a", "gone", "CITES"), ("a", "", "CITES"), ("a", "c", "NEXT")], "source_id string, target_id string, type string")
    own = spark.createDataFrame([("a", "w"), ("b", "w"), ("c", "urn:nir:stato:legge:2020-01-01;1"), ("d", "urn:nir:stato:legge:2020-01-01;1")], "id string, work_urn string")
    seeds = spark.createDataFrame([("q", "a")], "query_id string, id string")
    assert sorted(tuple(r) for r in expand.cited(seeds, edges, own, 1).collect()) == [("q", "b", 1)]
    assert sorted(tuple(r) for r in expand.cited(seeds, edges, own, 3).collect()) == [("q", "b", 1), ("q", "c", 2), ("q", "d", 2)]
    assert sorted(tuple(r) for r in expand.cited(seeds, edges, own, 3, 2).collect()) == [("q", "b", 1), ("q", "c", 2)]


ACT = """<?xml version="1.0"?><akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><meta><identification><FRBRWork>
<FRBRthis value="/akn/it/act/legge/stato/2024-01-11/2/!main"/><FRBRalias name="eli" value="eli/x"/><FRBRdate date="2024-01-11"/></FRBRWork></identification>
<lifecycle><eventRef date="2024-02-01"/><eventRef date="bad"/><eventRef date="2025-02-01"/></lifecycle></meta><preface><docTitle>Legge <b>nuova</b></docTitle></preface>
<body><article id="1"><num>Art. 1</num><heading>Oggetto</heading><paragraph><num>1.</num> <b>Testo</b> con <ref href="#x">rinvio</ref><mod>la parola <quotedText>a</quotedText> è sostituita, <ref href="urn:y">qui</ref></mod></paragraph></article>
<article id="1"><wrapper><table><tr><th>h</th><th>k</th></tr><tr><td>1</td></tr></table></wrapper><paragraph><content><rref from="a" upTo="b">x</rref><mref><ref href="urn:z">z</ref></mref></content></paragraph></article></body>
<attachments><doc><paragraph>Allegato uno</paragraph></doc></attachments></act></akomaNtoso>"""


def test_act():
    head, nodes, edges = akn.document(ACT)
    assert (head["urn"], head["eli"], head["title"], head["doc_type"], head["vigenza_start"], head["vigenza_end"]) == ("urn:nir:stato:legge:2024-01-11;2", "eli/x", "Legge nuova", "atto", "2024-02-01", "2025-02-01")
    assert [(n["eid"], n["type"], n["level"]) for n in nodes] == [
        ("body", "STRUCTURAL", 0), ("article1", "STRUCTURAL", 1), ("article1__gen_paragraph_1", "EXPRESSION", 2), ("article1-n2", "STRUCTURAL", 1), ("article1-n2__gen_table_2", "EXPRESSION", 2),
        ("article1-n2__gen_paragraph_3", "STRUCTURAL", 2), ("article1-n2__gen_paragraph_3__gen_content_4", "EXPRESSION", 3), ("attachments", "STRUCTURAL", 1), ("attachments__gen_doc_1", "STRUCTURAL", 2), ("attachments__gen_doc_1__gen_paragraph_2", "EXPRESSION", 3),
    ]
    assert nodes[2]["text_vector"].startswith("Art. 1 - Oggetto > 1: 1. Testo con rinvio") and nodes[2]["text_display"].startswith("**Testo** con [rinvio](#x)") and nodes[2]["is_modifier"]
    assert nodes[4]["text_content"] == "| h | k |\n| --- | --- |\n| 1 |  |" and nodes[4]["text_vector"] == "Article > Tabella: Riga 1: h=1"
    assert len({n["id"] for n in nodes}) == len(nodes)
    parts = [e["source_id"] for e in edges if e["type"] == "PART_OF"]
    assert sorted(parts) == sorted(n["id"] for n in nodes[1:])
    mods = [e for e in edges if e["type"] == "MODIFIES"]
    assert [(m["target_id"], m["properties"]["modification_type"], m["properties"]["quoted_text"]) for m in mods] == [("urn:y", "SUBSTITUTION", "a")]
    assert sorted(e["target_id"] for e in edges if e["type"] == "CITES") == sorted([akn.hashed("urn:nir:stato:legge:2024-01-11;2#x"), "urn:y", "urn:nir:stato:legge:2024-01-11;2#a", "urn:z"])


def test_awkward_xml():
    assert akn.document("<akomaNtoso><act><meta></meta></act></akomaNtoso>")[1] == []
    assert akn.document("<NIR><Legge><meta><descrittori><urn valore='urn:nir:x'/></descrittori></meta><intestazione><dataDoc norm='20240111'/><titoloDoc>T</titoloDoc></intestazione></Legge></NIR>")[0]["date_promulgation"] == "2024-01-11"
    head, nodes, _ = akn.document("<akomaNtoso><act><meta></meta><body><paragraph>a & b<p>c</body></act>")
    assert head["urn"] == "urn:fallback:" + akn.hashed("None_0001-01-01") and nodes[1]["text_content"] == "a & bc"
    for bad in (None, "", "plain", b""):
        with pytest.raises(ValueError):
            akn.document(bad)
    with pytest.raises(ValueError):
        akn.document("<a><b></a>", recover=False)
    assert xml.parse("﻿<a>\xe8</a>".encode("latin-1", "ignore")).text() == "è"


def test_files_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.xml").write_text(ACT)
    (src / "b.xml").write_text("nothing")
    docs = akn.parsed(akn.scan(spark, str(src)))
    assert akn.nodes(docs).count() == 10 and akn.errors(docs).count() == 1 and akn.acts(docs).first()["vigenza_start"] == dt.date(2024, 2, 1)
    files.write_jsonl(docs, str(tmp_path / "out"))
    (tmp_path / "out" / "z.json").write_text('\n{"frbr": {"urn": null}}\nnot json\n{"frbr": {"urn": "u"}, "nodes": [{"type": "EXPRESSION"}]}\n')
    assert files.documents_jsonl(spark, str(tmp_path / "out")).count() == 1
    target = str(tmp_path / "tables")
    for _ in range(2):  # a second run finds nothing new
        incremental.load(incremental.documents(spark, str(src)), target, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(f"{target}/nodes.parquet").count() == 10
    (src / "c.xml").write_text(ACT.replace("2024-01-11/2", "2024-01-11/3"))
    incremental.load(incremental.documents(spark, str(src)), target, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(f"{target}/nodes.parquet").count() == 20


def test_sources(spark, tmp_path):
    (tmp_path / "steps.jsonl").write_text('{"uri": "http://x/attocamera/ac19_1", "title": "Votazione", "date": "2024-01-01"}\n' * 2 + "bad\n")
    step = files.chamber_steps(spark, str(tmp_path / "steps.jsonl")).collect()
    assert [(s["related_work_urn"], s["step_type"], s["authority"]) for s in step] == [("attocamera:ac19_1", "VOTE", "Camera dei Deputati")]
    court = spark.createDataFrame([("/x/p_1.xml", b"<r><sentenza date='2020-01-01'>urn:nir:a;1 e urn:nir:a;1</sentenza><ordinanza><data valore='2020-01-02'/>x</ordinanza><decisione>y</decisione></r>"), ("/x/bad.xml", b"no")], "path string, content binary")
    assert sorted((j["date"], j["judgement_type"], j["affected_urns"]) for j in files.judgements(court).collect()) == [("2020-01-01", "Sentenza", ["urn:nir:a;1"]), ("2020-01-02", "Ordinanza", [])]
    page = spark.createDataFrame([("http://c.it/x/", '<a href="/dati/a.xml">A</a><a href="pronunce/b">XML</a><a href="/dati/a.xml">A</a><a href="c.xml">C</a><a>n</a>'), ("u", None)], "url string, html string")
    assert sorted(r["url"] for r in files.court_files(page).collect()) == ["http://c.it/dati/a.xml", "http://c.it/x/pronunce/b"]
    rdf = spark.createDataFrame([("<rdf:RDF xmlns:rdf='r' xmlns:s='s'><s:Concept rdf:about='c1'><s:prefLabel xml:lang='it'>Acqua</s:prefLabel><s:prefLabel xml:lang='en'>Water</s:prefLabel><s:broader rdf:resource='c0'/></s:Concept></rdf:RDF>",)], "content string")
    labels, broader = files.thesaurus(files.triples(rdf))
    assert [tuple(r) for r in labels.collect()] == [("c1", "Acqua", "pref")] and [tuple(r) for r in broader.collect()] == [("c1", "c0")]
    (tmp_path / "s.json").write_text('{"results": {"bindings": [{"uri": {"value": "u"}, "number": {"value": "N/A"}, "xml_url": {"value": "x"}}, {"uri": {"value": "v"}}]}}')
    assert [r["file"] for r in files.bills(spark, str(tmp_path / "s.json")).collect()] == ["ddl_NA.xml"]


def test_embedding_failures(spark):
    def fails(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[1.0]] * len(texts)

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, t string").repartition(1)
    got = {r["id"]: (r["embedding"], r["embed_error"]) for r in enrich.embed(df, "t", fails, 1).collect()}
    assert got == {1: ([1.0], None), 2: (None, "RuntimeError: down"), 3: (None, None)}


def test_windows_of_a_stream(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    batches = [["00:10", "00:20", "01:05"], ["00:30", "03:00"], ["00:40", "05:00"]]  # the last 00:40 comes too late
    for n, times in enumerate(batches):
        (src / f"{n}.json").write_text("".join(f'{{"ts": "2024-01-01T{t}:00Z", "kind": "k"}}\n' for t in times))
        rows = spark.readStream.schema("ts timestamp, kind string").json(str(src))
        q = incremental.counts_by_window(rows, "ts", "kind", "1 hour", "1 hour").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = sorted((r["start"].hour, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[0] == (0, 3) and (1, 1) in got
