"""Fetching the pages of a pool of addresses, with time and error of each."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Address and seconds left to the final address and the page.
Fetcher = Callable[[str, float], tuple[str, str]]
#: Bytes of a page that are read at most over HTTP; a longer one is an error, not a cut page.
MOST_BYTES = 64 << 20


def over_http(url: str, seconds: float) -> tuple[str, str]:
    """A page over HTTP, decoded as its header says or as UTF-8; redirects are followed."""
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; pages)"})
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        content = answer.read(MOST_BYTES + 1)
        if len(content) > MOST_BYTES:
            raise ValueError(f"more than {MOST_BYTES} bytes")
        return answer.geturl(), content.decode(answer.headers.get_content_charset() or "utf-8", "replace")


def from_files(folder: str, name: Callable[[str], str]) -> Fetcher:
    """A fetcher that reads the files of ``folder/name(url)``, for tests and for mirrors."""

    def read(url: str, seconds: float) -> tuple[str, str]:
        store, top = fs.FileSystem.from_uri(folder)
        parts = store.get_file_info(fs.FileSelector(f"{top}/{name(url)}"))
        content = b"".join(store.open_input_stream(x.path).read() for x in sorted(parts, key=lambda x: x.path) if x.is_file and x.base_name[:1] not in "._")
        return url, content.decode()

    return read


def fetch(pool: DataFrame, fetcher: Fetcher = over_http, seconds: float = 20.0, at_once: int = 8, tasks: int | None = None, url_column: str = "url") -> DataFrame:
    """``pool`` with ``final_url, html, fetch_ms, error``.

    Addresses are dealt over ``tasks`` (as many as the session works in unless given), and
    each task has ``at_once`` calls under way.  A call that has no answer after ``seconds``
    is an error, and the task goes on without it; so is anything a fetcher raises
    (``<kind>: <message>``).  ``fetch_ms`` is the time of the call, also of one that fails.
    A null address is an error without a call.  A lost task calls again.
    """
    out = [f"{x.name} {x.dataType.simpleString()}" for x in pool.schema.fields if x.name not in ("final_url", "html", "fetch_ms", "error")]
    kept = [x.split()[0] for x in out]

    def call(url: str | None) -> tuple[str | None, str | None, float | None, str | None]:
        if url is None:
            return None, None, None, "no address"
        began = time.monotonic()
        try:
            final, html = fetcher(url, seconds)
            return final, html, 1000 * (time.monotonic() - began), None
        except Exception as e:
            return None, None, 1000 * (time.monotonic() - began), f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers = ThreadPoolExecutor(at_once)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, at_once):
                    some = batch.slice(start, at_once)
                    ends = time.monotonic() + seconds
                    calls, rows = [workers.submit(call, url) for url in some[url_column].to_pylist()], []
                    for one in calls:
                        try:
                            rows.append(one.result(max(0.0, ends - time.monotonic())))
                        except Late:
                            rows.append((None, None, 1000 * seconds, f"TimeoutError: no answer in {seconds:g} s"))
                    if any(not one.done() for one in calls):  # hung calls keep their threads
                        workers.shutdown(wait=False, cancel_futures=True)
                        workers = ThreadPoolExecutor(at_once)
                    fields = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*[some[c] for c in kept], *fields], names=[*kept, "final_url", "html", "fetch_ms", "error"])
        finally:
            workers.shutdown(wait=False, cancel_futures=True)

    spark = pool.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = pool.select(*[F.col(f"`{c}`") for c in kept]).repartition(tasks)
    return dealt.mapInArrow(run, ", ".join([*out, "final_url string, html string, fetch_ms double, error string"]))
