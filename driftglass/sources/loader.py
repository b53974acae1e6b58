"""Payloads of price series as a data source: a partition for each symbol, fetched by URL with retries.

    spark.dataSource.register(PayloadSource)
    spark.read.format("price_payloads").options(url="https://host/chart/{symbol}?interval=1d", symbols="gspc=^GSPC,ftse=^FTSE").load()

Options: url (http, https, a file system that Arrow knows, or a path; {symbol} is filled in), symbols (name=symbol, or symbol, with commas; or a JSON
object of names and symbols), tries, delay (seconds before the second attempt; doubles), timeout, failures ('raise', or 'row' for a row with an error).
A payload must be JSON; what isn't is fetched again, like a fetch that fails.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Attempts, and the pause before the second one.
TRIES, DELAY, TIMEOUT = 4, 2.0, 60.0
AGENT = "Mozilla/5.0 (compatible; price-payloads)"


class Wanted(InputPartition):
    def __init__(self, name: str, symbol: str):
        self.name, self.symbol = name, symbol


def content(url: str, symbol: str, timeout: float) -> str:
    """What stands at a URL; of a folder, its files end to end."""
    if url.startswith(("http://", "https://")):
        request = urllib.request.Request(url.replace("{symbol}", urllib.parse.quote(symbol)), headers={"User-Agent": AGENT})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read().decode()
    from pyarrow import fs

    path = url.replace("{symbol}", symbol)
    store, path = fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/=,+-_.~")) if ":/" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = [path] if info.type == fs.FileType.File else sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name[0] not in "._")
    return "".join(store.open_input_stream(n).read().decode() for n in names)


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, symbols = options["url"], options["symbols"].strip()
        if symbols.startswith("{"):
            self.symbols = sorted(json.loads(symbols).items())
        else:
            self.symbols = [(x.partition("=")[0].strip(), (x.partition("=")[2] or x).strip()) for x in symbols.split(",") if x.strip()]
        self.tries, self.delay, self.timeout = int(options.get("tries", TRIES)), float(options.get("delay", DELAY)), float(options.get("timeout", TIMEOUT))
        self.failures = options.get("failures", "raise")

    def partitions(self) -> list[Wanted]:
        return [Wanted(*x) for x in self.symbols]

    def read(self, partition: Wanted) -> Iterator[tuple]:
        delay = self.delay
        for attempt in range(1, self.tries + 1):
            try:
                payload = content(self.url, partition.symbol, self.timeout)
                json.loads(payload)
                yield partition.name, payload, attempt, None
                return
            except (OSError, ValueError) as problem:  # no answer, or none that is whole
                if attempt == self.tries:
                    if self.failures == "raise":
                        raise
                    yield partition.name, None, attempt, f"{type(problem).__name__}: {problem}"
                else:
                    time.sleep(delay)
                    delay *= 2


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "price_payloads"

    def schema(self) -> str:
        return "series_id string, payload string, attempts int, error string"

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options)
