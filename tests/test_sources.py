import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import detectors as dt
from palimpsest.sources import corpora, csvtext, office, pdf, vault
from palimpsest.streaming import numbering
from palimpsest.synth import generate
from palimpsest.synth.template import TemplateError, parse


def test_csv_sniffing_and_rewriting():
    assert csvtext.sniff_separator("a;b;c\n1;2,5;3") == ";" and csvtext.sniff_separator("a\tb\n") == "\t" and csvtext.sniff_separator("abc") == "\t"
    assert csvtext.looks_like_header(["Nom", "Ville"], ["Paul", "75001"]) and not csvtext.looks_like_header(["Nom", "Nom"], ["a", "1"]) and not csvtext.looks_like_header(["1x", "b"], ["a", "1"]) and not csvtext.looks_like_header(["a", "b"], None)
    doc = '﻿nom;note\r\nPaul;"une ""x""\r\nligne 2"\r\nAnne\r\n'
    assert [(i, j, h) for i, j, h, _ in csvtext.cells(doc)] == [(0, 0, True), (0, 1, True), (1, 0, False), (1, 1, False), (2, 0, False)]
    out = csvtext.rewrite(doc, {(1, 0): "⟦X⟧"})
    assert out.startswith("﻿nom;note\r\n⟦X⟧;") and csvtext.read_rows(out)[1][1] == 'une "x"\r\nligne 2'
    assert csvtext.rewrite(doc, {}) == doc


def test_csv_segments_and_sink(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nom,mail\nPaul,p@x.org\n,\n")
    (tmp_path / "b.csv").write_text("\n")
    segs = csvtext.read_segments(spark, str(tmp_path))
    assert sorted((r.row_no, r.col_no, r.is_header, r.text) for r in segs.collect()) == [(0, 0, True, "nom"), (0, 1, True, "mail"), (1, 0, False, "Paul"), (1, 1, False, "p@x.org")]
    originals = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    new = csvtext.write_documents(originals, segs.where("row_no = 1 and col_no = 1").withColumn("text", F.lit("hidden")))
    assert sorted(bytes(r.content).decode() for r in new.collect()) == ["\n", "nom,mail\nPaul,hidden\n,\n"]


def _docx(path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Jean </w:t></w:r><w:r><w:t>Dupont</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:del w:id="1"><w:r><w:t>gone</w:t></w:r></w:del><w:ins w:id="2"><w:r><w:t>new</w:t></w:r></w:ins></w:p></w:body></w:document>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Override PartName="/word/comments.xml"/><Override PartName="/docProps/core.xml"/></Types>')
        z.writestr("word/document.xml", body)
        z.writestr("word/comments.xml", '<w:comments xmlns:w="x"><w:comment w:id="1">note</w:comment></w:comments>')
        z.writestr("docProps/core.xml", "<author>Jean Dupont</author>")


def _odt(path):
    body = '<office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:text><text:h>Titre</text:h><text:p>un <text:span>Paul</text:span> deux</text:p><text:p> </text:p></office:text></office:body></office:document-content>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        z.writestr("content.xml", body)
        z.writestr("meta.xml", "<meta>Paul</meta>")


def test_office(spark, tmp_path):
    _docx(tmp_path / "a.docx")
    _odt(tmp_path / "b.odt")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    rows = office.read_segments(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path[-6:], []).append((r.kind, r.text))
    assert by["a.docx"] == [("paragraph", "Jean Dupont"), ("table", "cell"), ("paragraph", "gonenew")]
    assert by["/b.odt"] == [("heading", "Titre"), ("paragraph", "un "), ("paragraph", "Paul"), ("paragraph", " deux")]
    assert by["c.docx"] == [("error", "BadZipFile")]
    docs = spark.read.format("binaryFile").load([str(tmp_path / "a.docx"), str(tmp_path / "b.odt")]).select("path", "content")
    segs = spark.createDataFrame([(r.path, 0, "⟦PERSON_1_x⟧") for r in docs.collect()], "path string, seg_no int, text string")
    out = {r.path[-6:]: bytes(r.content) for r in office.write_documents(docs, segs).collect()}
    assert office.segments_of("x.docx", out["a.docx"]) == [(0, "paragraph", "⟦PERSON_1_x⟧"), (2, "table", "cell"), (3, "paragraph", "new")]
    assert office.segments_of("x.odt", out["/b.odt"])[0] == (0, "heading", "⟦PERSON_1_x⟧")
    names = zipfile.ZipFile(io.BytesIO(out["a.docx"])).namelist()
    assert "word/comments.xml" not in names and "docProps/core.xml" not in names
    assert office.sanitize("a.docx", (tmp_path / "a.docx").read_bytes())[1] == {"parts": 2, "revisions": 2, "comments": 1}


def test_pdf(spark, tmp_path):
    content = b"BT /F1 12 Tf 72 700 Td (Bonjour \\(Paul\\)) Tj 0 -20 Td [(Rue) -300 (du Lac)] TJ T* <FEFF00E9> Tj ET"
    data = zlib.compress(content)
    body = b"%%PDF-1.4\n1 0 obj<</Type /Page /Contents 2 0 R>>endobj\n2 0 obj<</Length %d /Filter /FlateDecode>>stream\n%s\nendstream endobj\n" % (len(data), data)
    (tmp_path / "a.pdf").write_bytes(body)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    got = [(r.page, r.text) for r in pdf.read_segments(spark, str(tmp_path)).orderBy("seg_no").collect()]
    assert got[:2] == [(0, "Bonjour (Paul)"), (0, "Rue du Lac é")] or got[:2] == [(0, "Bonjour (Paul)"), (0, "Rue du Lac")]
    assert pdf.cmap(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange") == {1: "A", 2: "a", 3: "b", 4: "c"}


def test_corpora(spark, tmp_path):
    (tmp_path / "a.conll").write_text("-DOCSTART-\tO\n\nJean\tB-PER\nvit\n\n\nici\tO\r\n")
    (tmp_path / "w.txt").write_text("// note\nJean|N|I-PER Dupont|N|I-PER vit|V|O\n\nParis|N|I-LOC\n")
    rows = corpora.conll(corpora.numbered_lines(spark, str(tmp_path / "a.conll"))).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.pos, r.word, r.tag) for r in rows] == [(0, 0, "Jean", "B-PER"), (0, 1, "vit", "O"), (1, 0, "ici", "O")]
    rows = corpora.wikiner(corpora.numbered_lines(spark, str(tmp_path / "w.txt"))).orderBy("sent_id", "pos").collect()
    assert [(r.word, r.tag) for r in rows] == [("Jean", "B-PER"), ("Dupont", "I-PER"), ("vit", "O"), ("Paris", "B-LOC")]
    lines = spark.createDataFrame([("p", 0, "# c"), ("p", 1, "Paris,3"), ("p", 2, "PARIS\t2"), ("p", 3, "")], "path string, line_no int, line string")
    assert [tuple(r) for r in corpora.word_list(lines, "loc").collect()] == [("loc", "paris", 2)]
    lines = spark.createDataFrame([("p", 0, "0101 Chat 3"), ("p", 1, "11 chat 4")], "path string, line_no int, line string")
    assert [tuple(r) for r in corpora.clusters(lines).collect()] == [("chat", "11")]
    lines = spark.createDataFrame([("p", 0, "chat 0.5 -1")], "path string, line_no int, line string")
    assert corpora.vectors(lines).first().vec == [0.5, -1.0]
    tsv = ["5\t1\t1\t1\t1\t2\t60\t10\t30\t8\t90\tPaul", "5\t1\t1\t1\t1\t1\t10\t10\t40\t8\t-1\tMr", "4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t"]
    words = corpora.tesseract(spark.createDataFrame([("p", i, x) for i, x in enumerate(tsv)], "path string, line_no int, line string"))
    line = corpora.recognised_lines(words)
    assert line.first().text == "Mr Paul"
    spans = line.select("path", "page", "line_id").withColumn("start", F.lit(3)).withColumn("end", F.lit(7))
    assert [round(r.x, 2) for r in corpora.boxes_of(line, spans, ["path", "page", "line_id"]).collect()] == [58.8]


def test_vault(spark, tmp_path):
    key = bytes(range(32))
    df = spark.createDataFrame([("a", {"⟦X⟧": "Paul"}), ("b", {})], "id string, m map<string,string>")
    store = vault.seal(df, "id", "m", key, 1000, 60)
    assert {r.id: r.mapping for r in vault.unseal(store, key, 1010).collect()} == {"a": {"⟦X⟧": "Paul"}, "b": {}}
    assert vault.unseal(store, key, 2000).count() == 0 and vault.unseal(store, bytes(32), 1010).count() == 0 and vault.purge(store, 2000).count() == 0
    assert [r.id for r in vault.entries(vault.delete(store, ["a"])).collect()] == ["b"]
    with pytest.raises(Exception):
        vault.unseal(store.withColumn("id", F.lit("z")), key, 1010).collect()
    state = vault.session_from_json(spark.createDataFrame([('{"version":2}',), ("x",), ('{"version":1,"nonce":"ab","counters":{"PER":2}}',)], "state string")).collect()
    assert [r.error is None for r in state] == [False, False, True] and state[2].session.counters == {"PER": 2}
    (tmp_path / "g.txt").write_text("x")
    rows = [{"kind": "gazetteer", "name": "loc", "languages": ["fr"], "file": "g.txt", "sha256": "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", "size": 1}, {"kind": "gazetteer", "name": "bad", "languages": [], "file": "g.txt", "sha256": "0", "size": 1}]
    (tmp_path / "manifest.json").write_text(json.dumps(rows))
    res = vault.Resources(spark, str(tmp_path))
    assert res.path("gazetteer", "loc").endswith("g.txt") and res.best_gazetteers().count() == 2
    for name in ("bad", "none"):
        with pytest.raises(vault.StoreError):
            res.path("gazetteer", name)


def test_templates_and_corpus(spark):
    t = parse("t", "type: x\nlang: fr\n---\n@block l\n{{decoy:designation}} {{amount:a}}\n@end\n{{PER:a|form=prenom_nom}}{{pad:2-3}}[?c]{{email:e|from=a}}[/]\n{{LINES:l:2-2}}{{ADDR:b|form=city}}")
    text, spans, sections, _ = generate.render(t, generate.DEFAULT_LISTS, 5)
    assert [s["label"] for s in spans] == ["PER", "LOC"] and all(text[s["start_off"] : s["end_off"]] == s["text"] for s in spans)
    assert generate.render(t, generate.DEFAULT_LISTS, 5)[0] == text
    for bad in ("no head", "a: b\n---\n{{UNKNOWN:x}}", "a: b\n---\n[?x]open", "a: b\n---\n[/]", "a: b\n---\n{{LINES:none:1-2}}", "a: b\n---\n{{pad:3-1}}", "a: b\n---\n{{ORG:x|famille=zoo}}", "a: b\n---\n@block l\nx"):
        with pytest.raises(TemplateError):
            parse("bad", bad)
    docs = generate.corpus(spark, [t], 40, seed=1, partitions=3)
    again = generate.corpus(spark, [t], 40, seed=1, partitions=5)
    assert {r.doc_index: r.text for r in docs.collect()} == {r.doc_index: r.text for r in again.collect()}
    assert generate.manifest(docs, "g").first().doc_count == 40


def test_streams(spark, tmp_path):
    for k, text in enumerate(["a@b.co x@y.org", "x@y.org c@d.net"]):
        spark.createDataFrame([("s1", text)], "session_id string, text string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("session_id string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = numbering.numbered(stream, detectors=dt.BUILTIN, timeout="NoTimeout")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    rows = sorted((r["index"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [i for i, _ in rows] == [1, 2, 3] and {t for _, t in rows} == {"a@b.co", "x@y.org", "c@d.net"}
    clean, bad = [], []
    run = numbering.verified_batches(on_clean=lambda df, n: clean.extend(df.collect()), on_rejected=lambda df, n: bad.extend(df.collect()))
    run(spark.createDataFrame([("mail a@b.co",), ("⟦EMAIL_1_abcdef⟧",)], "text string"), 0)
    assert len(clean) == 1 and len(bad) == 1
    with pytest.raises(RuntimeError):
        numbering.verified_batches()(spark.createDataFrame([("⟦EMAIL_1_abcdef⟧",)], "text string"), 0)
