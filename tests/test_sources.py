import gzip
import io
import json
import random
import tarfile

from driftglass.sources import documents


def archive(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as made:
        for name, body in members.items():
            about = tarfile.TarInfo(name)
            about.size = len(body)
            made.addfile(about, io.BytesIO(body))
    return out.getvalue()


def test_documents_are_decoded_by_kind(spark, tmp_path):
    noise = random.Random(1).randbytes(4000)
    made = {
        "a.html": b"<script>x</script>" + b"<p>word</p> " * 2500, "b.html": b"<p>short</p>", "b.tgz": archive({"x.tex": b"tex\n\n text", "y.png": noise, "z.BBL": b"refs"}),
        "c.gz": gzip.compress(noise + b"  plain  text"), "d.tgz": archive({"y.png": noise}), "e.tgz": noise, "f.tgz": b"tiny",
    }
    folder = tmp_path / "files"
    folder.mkdir()
    for name, body in made.items():
        (folder / name).write_bytes(body)
    got = {r.doc_id: (r.how, r.text) for r in documents.decoded(documents.files(spark, str(folder))).collect()}
    assert got["a"][0] == "html" and set(got["a"][1].split()) == {"word"}
    assert got["b"] == ("package", "tex text refs") and got["c"][0] == "compressed" and got["c"][1].endswith(" plain text")
    assert got["d"] == got["e"] == got["f"] == ("fail", None) and len(got) == 6


def test_manifest_and_cache(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"doc_id": "a", "year": 2001}, {"doc_id": "b"}, {"doc_id": "c", "title": "t"}]))
    wanted = documents.manifest(spark, str(tmp_path / "list.json"), "doc_id string, year int, title string")
    assert sorted(map(tuple, wanted.collect())) == [("a", 2001, None), ("b", None, None), ("c", None, "t")]
    cache = spark.createDataFrame([("a", "x" * 2001), ("b", "x" * 2000), ("z", "x" * 9000)], "doc_id string, text string")
    fetch = lambda rest: rest.selectExpr("doc_id", "CASE WHEN doc_id = 'b' THEN 'new' END AS text", "if(doc_id = 'b', 'html', 'fail') AS how")
    got = documents.read_through(wanted.select("doc_id"), cache, fetch)
    assert {(r.doc_id, r.how) for r in got.collect()} == {("a", "cached"), ("b", "html"), ("c", "fail")}
    assert {tuple(r) for r in documents.accounting(got).collect()} == {("cached", 1), ("html", 1), ("fail", 1)}


def test_packages_that_grow_without_end(tmp_path):
    noise = bytes(random.Random(1).randrange(97, 123) for _ in range(5000))
    packed = gzip.compress(noise + b"a" * 3_000_000)
    assert documents.unpacked(packed)[1] == "compressed" and documents.unpacked(packed, 1_000_000) == (None, "fail")
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        for name, body in (("a.tex", noise), ("b.dat", b"a" * 2_000_000), ("c.txt", b"end")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    assert documents.unpacked(buffer.getvalue()) == (noise.decode() + " end", "package")
    assert documents.unpacked(buffer.getvalue(), 1_000_000) == (None, "fail")
    assert documents.unpacked(packed[:2000]) == (None, "fail") and documents.unpacked(b"x" * 2000) == (None, "fail")
