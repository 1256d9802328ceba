"""From files to answers: both commands, enrichment, failing parts, exports and sources."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom import __main__ as cli
from lexloom import engine
from lexloom.functions import text, urns
from lexloom.functions.urns import known_urn
from lexloom.operators import expand, fusion, search, topics
from lexloom.operators.enrich import hash_provider
from lexloom.sources import akn, export
from lexloom.streaming import incremental
from lexloom.tables import Shelf, shared_dir

ACT = """<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><meta><identification><FRBRWork>
<FRBRthis value="/akn/it/act/legge/stato/2020-01-0{n}/{n}/!main"/><FRBRdate date="2020-01-0{n}"/></FRBRWork></identification></meta>
<preface><docTitle>Legge {n}</docTitle></preface><body><article eId="art_1"><num>Art. 1</num>
<paragraph eId="para_1"><num>1.</num><content eId="c"><p>{text} <ref href="/akn/it/act/legge/stato/2020-01-02/2/!main">legge 2</ref></p></content></paragraph></article></body></act></akomaNtoso>"""
RDF = """<rdf:RDF xmlns:rdf="r" xmlns:skos="s"><skos:Concept rdf:about="teseo:1"><skos:prefLabel xml:lang="it">pesca</skos:prefLabel></skos:Concept>
<skos:Concept rdf:about="teseo:2"><skos:prefLabel xml:lang="it">pesca a strascico</skos:prefLabel><skos:broader rdf:resource="teseo:1"/></skos:Concept></rdf:RDF>"""


def raw(folder, texts):
    for n, t in texts.items():
        (folder / f"{n}.xml").write_text(ACT.format(n=n, text=t), encoding="utf-8")


def test_load_then_retrieve(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "raw").mkdir()
    raw(tmp_path / "raw", {1: "La pesca nelle acque interne", 2: "I tributi dei comuni", 3: "La pesca a strascico"})
    (tmp_path / "raw" / "bad.xml").write_text("nothing")
    (tmp_path / "t.rdf").write_text(RDF)
    load = ["load", "--input", str(tmp_path / "raw"), "--output", str(tmp_path / "t"), "--thesaurus", str(tmp_path / "t.rdf")]
    cli.main(load)
    read = lambda t: spark.read.parquet(f"{tmp_path}/t/{t}.parquet")
    assert read("works").count() == 3 and read("errors").count() == 1
    assert {r[0] for r in read("edges").where("type = 'HAS_TOPIC'").select("target_id").collect()} == {"teseo:1", "teseo:2"}
    assert read("nodes").where("(type = 'EXPRESSION') <> (embedding is not null)").count() == 0
    cli.main(["retrieve", "--tables", str(tmp_path / "t"), "--query", "pesca nelle acque", "--verbose", "--top-k", "3"])
    said = capsys.readouterr().out
    assert "[1]" in said and "bm25+graph+vector" in said and "urn:nir:stato:legge:2020-01-01;1" in said and "topics: teseo:1" in said and "act: Legge 1" in said
    assert "citation_hop" in said or "Legge 2" in said
    # loading again takes up nothing, a new file only itself; the thesaurus stays
    raw(tmp_path / "raw", {4: "Un'altra legge sulla pesca"})
    cli.main(load[:5])
    assert read("works").count() == 4 and read("concepts").count() == 2


def test_load_of_json_lines(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    raw(tmp_path / "raw", {1: "La pesca"})
    cli.main(["parse-raw", "--input", str(tmp_path / "raw"), "--output", str(tmp_path / "j"), "--pretty", str(tmp_path / "p")])
    cli.main(["load", "--input", str(tmp_path / "j"), "--output", str(tmp_path / "t"), "--jsonl"])
    assert spark.read.parquet(f"{tmp_path}/t/works.parquet").count() == 1
    assert "Legge 1" in "".join(r[0] for r in spark.read.text(str(tmp_path / "p")).collect())
    cli.main(["retrieve", "--tables", str(tmp_path / "t"), "--query", "pesca"])


def small_graph(spark):
    works = spark.createDataFrame([("urn:unknown", "A", None, None)], "urn string, title string, vigenza_start date, vigenza_end date").withColumn("ingested_at", F.current_timestamp())
    nodes = spark.createDataFrame([("n1", "urn:unknown", "EXPRESSION", "e", "vedi urn:nir:stato:legge:2001;5, la pesca", "p", [1.0] * 64)], "id string, work_urn string, type string, eid string, text_display string, tag_name string, embedding array<float>").withColumn("ingested_at", F.current_timestamp())
    edges = spark.createDataFrame([], "edge_id bigint, source_id string, target_id string, type string, score double, ingested_at timestamp")
    concepts, broader = spark.createDataFrame([], incremental.LABELS), spark.createDataFrame([], incremental.BROADER)
    return engine.build(works, nodes, edges, concepts, broader)


def test_a_failing_embedder_and_a_failing_channel(spark, monkeypatch):
    graph = small_graph(spark)

    def fails(*_):
        raise RuntimeError("no")

    asked = engine.ask(spark, [("q", "pesca")], fails)
    assert asked.first()["vector"] is None
    day = F.lit("2020-01-01").cast("date")
    got = engine.retrieve(graph, asked, day).collect()
    assert [(r["id"], r["source"], r["urn"]) for r in got] == [("n1", "bm25", "urn:nir:stato:legge:2001;5")]
    monkeypatch.setattr(search, "bm25_top_k", fails)
    assert [r["source"] for r in engine.retrieve(graph, engine.ask(spark, [("q", "pesca")], hash_provider()), day).collect()] == ["vector"]


def test_urns_in_texts(spark):
    rows = [("urn:x", "urn:nir:a"), (None, "see URN:NIR:a:b;1~art2, x"), ("urn:unknown", None), ("", "none")]
    df = spark.createDataFrame(rows, "u string, t string")
    assert [r[0] for r in df.select(known_urn(F.col("u"), F.col("t"))).collect()] == ["urn:x", "URN:NIR:a:b;1~art2", "urn:unknown", "urn:unknown"]


def test_settings_of_an_environment(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# x\nexport RAG_TOP_K=7\nRRF_K='9'\nRRF_WEIGHT_BM25=abc\nnothing\n")
    monkeypatch.setenv("MAX_CITATION_HOPS", "2")
    monkeypatch.setenv("RRF_K", "11")
    s = fusion.Settings.of(fusion.environment(str(tmp_path / ".env")), final_k=3)
    assert (s.top_k, s.rrf_k, s.bm25, s.hops, s.final_k) == (7, 11, 1.5, 2, 3)


def test_the_parser_agrees_with_the_column_functions(spark):
    uris = ["/akn/it/act/legge/stato/2020-01-02/5/!main", "/akn/it/act/a/b", "/akn/eu/x", "http://dati.senato.it/x/y/z/w", "http://dati.senato.it/x/y", "http://dati.senato.it", "urn:nir:a;1/!main", "", "x"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    assert [r[0] for r in df.select(urns.uri_to_urn(F.col("u"))).collect()] == [akn.uri_to_urn(u) for u in uris]
    tables = [[["a", "b"], ["1", "2"]], [["a", "b"], ["1"]], [["a"], ["1", "2"]], [["a"]], [["", "b"], ["", ""]]]
    rows = spark.createDataFrame([(t,) for t in tables], "t array<array<string>>")
    assert [r[0] for r in rows.select(text.table_markdown(F.col("t"))).collect()] == [akn.markdown(t) for t in tables]
    for head in (True, False):
        assert [r[0] for r in rows.select(text.table_linear(F.col("t"), F.lit(head))).collect()] == [akn.linear(t, head) for t in tables]


class Service:
    def __init__(self, states, archive=b"zip"):
        self.states, self.archive, self.confirmed = list(states), archive, []

    def ask(self, request):
        return f'"{request["parametriRicerca"]["annoProvvedimento"]}"\n'

    def confirm(self, token):
        self.confirmed.append(token)

    def state(self, token):
        s = self.states.pop(0)
        if isinstance(s, Exception):
            raise s
        return s

    def fetch(self, token):
        return self.archive


def test_exports():
    now = [0.0]
    run = lambda s: export.export(s, export.request("2024-02-03"), 5, 20, lambda: now[0], lambda d: now.__setitem__(0, now[0] + d))
    s = Service([{"stato": 0}, OSError("x"), {"stato": 6}, {"stato": 3}])
    assert run(s) == export.Export("ready", "2024", b"zip") and s.confirmed == ["2024"]
    assert run(Service([{"stato": 4, "descrizioneErrore": "no"}])).status == "refused"
    assert run(Service([{}] * 9)).status == "late"
    assert run(Service([])).status in ("late", "failed")
    assert export.export(None, {}).status == "failed"


def test_archives(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/1.xml", ACT.format(n=1, text="x"))
        f.writestr("readme.txt", "x")
    (tmp_path / "x.zip").write_bytes(z.getvalue())
    (tmp_path / "y.zip").write_bytes(b"junk")
    got = export.read(spark, str(tmp_path))
    assert got.where("error is null").count() == 1 and got.where("error is not null").count() == 1
    assert akn.acts(akn.parsed(got.where("error is null"))).first()["title"] == "Legge 1"


def test_sources_fail_on_their_own(spark):
    def fails():
        raise ValueError("no")

    got = {r["source"]: r for r in export.statuses(spark, export.run_all({"a": lambda: 3, "b": fails, "c": lambda: None})).collect()}
    assert [(got[s]["status"], got[s]["rows"]) for s in "abc"] == [("done", 3), ("failed", None), ("done", None)] and "no" in got["b"]["error"]


def test_citations_of_a_much_cited_act(spark):
    own = spark.createDataFrame([(f"n{i:03}", "hot") for i in range(200)] + [(f"m{i}", f"act{i}") for i in range(30)], "id string, work_urn string")
    edges = spark.createDataFrame([(f"m{i}", "hot", "CITES") for i in range(30)] + [("n000", "hot", "CITES"), ("n000", "act3", "CITES"), ("m3", "n150", "CITES"), (None, "hot", "CITES")], "source_id string, target_id string, type string")
    seeds = spark.createDataFrame([(f"q{i}", f"m{i}") for i in range(30)] + [("s", "n000"), ("s", "n001"), ("s", "n001"), (None, "m1")], "query_id string, id string")

    def brute(hops, most):
        out = {}
        by_act, cites = {}, {}
        for i, a in own.collect():
            by_act.setdefault(a, []).append(i)
        for a, b, _ in edges.collect():
            cites.setdefault(a, set()).update(by_act.get(b, [b]))
        for q in {r[0] for r in seeds.collect() if r[0]}:
            seen = {r[1]: 0 for r in seeds.collect() if r[0] == q}
            level = set(seen)
            for h in range(1, hops + 1):
                level = {t for x in level for t in cites.get(x, ())} - set(seen)
                seen |= dict.fromkeys(level, h)
            out[q] = sorted((h, i) for i, h in seen.items() if h)[:most]
        return out

    for hops, most in ((1, 10), (2, 10), (3, 300)):
        got = {}
        for r in expand.cited(seeds, edges, own, hops, most).collect():
            got.setdefault(r["query_id"], []).append((r["hop"], r["id"]))
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in brute(hops, most).items() if v}


def test_shared_folder(spark):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://x"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        shared_dir(Elsewhere)
    df, place = Shelf(spark, "x").put(spark.range(3))
    assert df.count() == 3 and place.startswith(shared_dir(spark))


def test_large_sets_of_terms_and_labels(spark, monkeypatch):
    """Beyond the sizes looked up in lists the same rows come out by joins."""
    texts = spark.createDataFrame([(1, "la pesca nelle acque interne"), (2, "acque e acque"), (3, ""), (4, None), (None, "acque"), (5, "pesca a strascico, pesca")], "id bigint, text string").withColumn("term", F.lit("x"))
    asked = spark.createDataFrame([("q", "acque acque pesca"), ("r", ""), ("s", None)], "query_id string, text string")
    labels = spark.createDataFrame([("c1", "pesca", "pref"), ("c2", "pesca a strascico", "pref"), ("c3", "acque interne", "alt"), (None, "x", "pref"), ("c4", None, "pref")], "concept_id string, label string, kind string")
    words = lambda: sorted((r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in search.bm25_top_k(texts, asked, "id", "text", 3).collect())
    found = lambda: sorted((r["id"], r["concept_id"], r["label"]) for r in topics.match(texts.select("id", "text"), topics.dictionary(labels)).collect())
    few = words(), found()
    assert [r[:2] for r in few[0]] == [("q", 1), ("q", 2), ("q", 5)] and found() == [(1, "c1", "pesca"), (1, "c3", "acque interne"), (5, "c1", "pesca"), (5, "c2", "pesca a strascico")]
    monkeypatch.setattr(search, "TERMS", 0)
    monkeypatch.setattr(topics, "FIRST_WORDS", 0)
    assert (words(), found()) == few
    assert search.bm25_top_k(texts.limit(0), asked, "id", "text", 3).count() == 0
