import http.server
import json
import threading

import pytest

from driftglass.functions import text
from driftglass.sources import loader, series
from driftglass.streaming import audits

BODIES = ["Fat tails, a stylized fact of an artificial market. Fat tail and kurtosis.", "Volatility clustering.", None, "", "The leverage effect " * 4]


def put(spark, folder, first, files):
    for k in range(first, first + files):
        rows = [(str(10 * k + j), BODIES[(k + j) % len(BODIES)]) for j in range(3)]
        spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.mode("append").parquet(folder)


def shown(df):
    return sorted((r.doc_id, r.fetched, r.nchar, r.sf_mention, r.is_sim, sorted(r.counts.items()), r.ge1, r.ge3) for r in df.collect())


def test_batches_come_exactly_once(spark, tmp_path):
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    put(spark, source, 0, 5)
    stream = lambda then=None: audits.audit_stream(audits.arriving(spark, source, "doc_id string, text string", 2), out, marks, then=then)

    def dies(number):
        if number == 1:
            raise RuntimeError("killed after the write")

    with pytest.raises(Exception, match="killed"):
        stream(dies).awaitTermination()
    assert audits.results(spark, out).select("batch").distinct().count() == 2  # the second is there, but wasn't committed
    stream().awaitTermination()
    put(spark, source, 5, 3)  # more files arrive, and the stream starts again
    stream().awaitTermination()
    stream().awaitTermination()
    got = audits.results(spark, out)
    want = text.audit(spark.read.parquet(source), "doc_id", "text")
    assert got.count() == 24 and shown(got) == shown(want)
    last = max(audits.progress(got).collect(), key=lambda r: r.batch)
    assert (last.documents_so_far, last.fetched_so_far) == (24, want.where("fetched").count()) and last.batch >= 3


PAYLOAD = {"chart": {"result": [{"timestamp": [86400, 172800, 259200], "indicators": {"quote": [{"close": [1.0, None, 2.0]}]}}]}}


class Flaky(http.server.BaseHTTPRequestHandler):
    seen: dict = {}

    def do_GET(self):
        n = self.seen[self.path] = self.seen.get(self.path, 0) + 1
        body = json.dumps(PAYLOAD) if n > 2 else "{broken"
        if n == 1 or "never" in self.path:
            self.send_error(503)
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


def test_symbols_are_fetched_with_retries(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Flaky)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(loader.PayloadSource)
        read = spark.read.format("price_payloads").options(url=f"http://127.0.0.1:{server.server_port}/{{symbol}}", tries=3, delay=0.01)
        rows = read.option("symbols", "a=^A B,b").load()
        assert rows.rdd.getNumPartitions() == 2
        got = {r.series_id: r for r in rows.collect()}
        assert {k: (json.loads(r.payload), r.attempts, r.error) for k, r in got.items()} == {"a": (PAYLOAD, 3, None), "b": (PAYLOAD, 3, None)}
        assert set(Flaky.seen) == {"/%5EA%20B", "/b"}
        lost = read.options(symbols='{"x": "never", "b": "b"}', failures="row").load().collect()
        assert {(r.series_id, r.payload is None, r.attempts) for r in lost} == {("x", True, 3), ("b", False, 1)}
        with pytest.raises(Exception, match="503"):
            read.options(symbols="never", failures="raise").load().collect()
    finally:
        server.shutdown()
    prices = series.parsed(spark.createDataFrame([(r.series_id, r.payload) for r in got.values()], "series_id string, payload string"))
    assert series.returns(prices, False).where("abs(r - ln(2)) < 1e-12").count() == 2


def test_files_and_folders(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(PAYLOAD))
    (tmp_path / "two words.json").mkdir()
    (tmp_path / "two words.json" / "part-0").write_text(json.dumps(PAYLOAD))
    (tmp_path / "two words.json" / "_SUCCESS").write_text("")
    spark.dataSource.register(loader.PayloadSource)
    for base in (str(tmp_path), tmp_path.as_uri()):
        rows = spark.read.format("price_payloads").options(url=base + "/{symbol}.json", symbols="one,two words,three", tries=1, failures="row").load().collect()
        assert {r.series_id: (r.payload and json.loads(r.payload), (r.error or "").partition(":")[0]) for r in rows} == {"one": (PAYLOAD, ""), "two words": (PAYLOAD, ""), "three": (None, "FileNotFoundError")}
