"""Fetching pages in parallel.

The requests are a distributed table (`plan_requests`); runs of consecutive requests are spread over
the cluster and fetched there. What fetches is passed in: any picklable callable
`(source_id, params) -> body text`, or, if it has a true `by_url`, `(url, params) -> body text`.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strata.checkpoints import ensure_checkpoint_dir
from strata.operators.urls import url_class
from strata.sources.requests import PAGE_SIZE, WAVE, plan_requests

Fetcher = Callable[[str, Mapping[str, str]], str]

# How long one request may take and how often it is tried.
TIMEOUT_SECONDS = 30
ATTEMPTS = 3

#: Pages that a source is probed at, once as far, twice as far, four times as far and so on, when its pages repeat.
PROBES = 7

#: `is_empty`: a page without records, which ends its source; `error`: why there is no usable page.
SCHEMA = "source_id string, seq bigint, page bigint, body string, attempts int, is_empty boolean, error string"


class FileFetcher:
    """Pages dumped below `<root>/source=<source_id>/`, each as `page=<n>.json` or as a folder `page=<n>`.

    The root has a scheme (`files.qualified` adds that of Spark's file system), so that workers read where Spark
    wrote. Pages beyond the last one are empty; a page that is missing before it is an error, and so is a
    source without a folder.
    """

    def __init__(self, root: str, page_param: str = "page"):
        if ":/" not in root:
            raise ValueError(f"the root needs a scheme: {root}")
        self.root, self.page_param = root.rstrip("/"), page_param
        self._pages: dict[str, dict[int, list]] = {}

    def _listed(self, files, where: str) -> dict[int, list]:
        """What lies directly below a source, by page, listed once per task."""
        from pyarrow import fs

        if where not in self._pages:
            found: dict[int, list] = {}
            for entry in files.get_file_info(fs.FileSelector(where)):
                number = entry.base_name.removeprefix("page=").removesuffix(".json")
                if number.isdigit():
                    found.setdefault(int(number), []).append(entry)
            self._pages = {where: found}
        return self._pages[where]

    @staticmethod
    def _files(files, entries: list) -> list[str]:
        """The files of one page; its folders are listed only when the page is asked for."""
        from pyarrow import fs

        found = []
        for entry in entries:
            inside = [entry] if entry.is_file else files.get_file_info(fs.FileSelector(entry.path, recursive=True))
            found += [e.path for e in inside if e.is_file and not e.base_name.startswith((".", "_"))]
        return sorted(found)

    def __call__(self, source_id: str, params: Mapping[str, str]) -> str:
        from pyarrow import fs

        page = int(params.get(self.page_param, 1))
        files, where = fs.FileSystem.from_uri(f"{self.root}/source={source_id}")
        pages = self._listed(files, where)
        found = self._files(files, pages.get(page, []))
        if not found:
            # The last page first, so that asking beyond the end looks into one folder at most, unless folders are empty.
            if any(self._files(files, pages[later]) for later in sorted((p for p in pages if p > page), reverse=True)):
                raise FileNotFoundError(f"page {page} of source {source_id} is missing")
            return "[]"
        return "".join(files.open_input_stream(f).read().decode("utf-8") for f in found)


class HttpFetcher:
    """Requests over HTTP, to the `url` column of the sources.

    GET puts the parameters into the query, other methods send them as a JSON body. Redirects are
    refused, since their target has not been screened.
    """

    by_url = True

    def __init__(self, method: str = "GET", headers: Mapping[str, str] | None = None):
        self.method, self.headers = method, dict(headers or {})

    def request(self, url: str, params: Mapping[str, str]):
        from urllib.parse import urlencode, urlsplit
        from urllib.request import Request

        if self.method != "GET":
            headers = {"Content-Type": "application/json", **self.headers}
            return Request(url, json.dumps(dict(params)).encode(), headers, method=self.method)
        joint = "&" if urlsplit(url).query else "?"
        return Request(f"{url}{joint}{urlencode(params)}" if params else url, headers=self.headers)

    def __call__(self, url: str, params: Mapping[str, str]) -> str:
        from urllib.request import HTTPRedirectHandler, build_opener

        class NoRedirect(HTTPRedirectHandler):
            def redirect_request(self, *args, **kwargs):
                return None

        with build_opener(NoRedirect).open(self.request(url, params), timeout=TIMEOUT_SECONDS) as response:
            return response.read().decode("utf-8")


def page_state(body: str, record_key: str | None = None, row_element: str | None = None) -> tuple[bool, str | None]:
    """Whether a page has no records, and what is wrong with it.

    JSON: a list, or an object with a list under `record_key` (else `data`, else `results`); null there is an
    empty page, anything else is an error. Other text (XML, CSV) is empty when blank, or, if a row element is
    named, when it holds none.
    """
    try:
        value = json.loads(body)
    except ValueError:
        start = body.lstrip()[:1]
        if start in ("[", "{"):
            return False, "the page is not JSON"
        return not start or bool(row_element and not re.search(rf"<{re.escape(row_element)}[\s/>]", body)), None
    if isinstance(value, dict):
        key = next((k for k in ([record_key] if record_key else ("data", "results")) if k in value), None)
        if key is None:
            return False, f"the page has no list of records under {record_key or 'data or results'}"
        value = value[key]
    if value is not None and not isinstance(value, list):
        return False, "the page holds no list of records"
    return not value, None


def _fetch(fetcher: Fetcher, source_id: str, params: Mapping[str, str], pause: float) -> tuple[str | None, int, str | None]:
    """Body, number of attempts and the last error; waits 1, 2, 4... pauses between attempts."""
    error = None
    for attempt in range(ATTEMPTS):
        try:
            return fetcher(source_id, params), attempt + 1, None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < ATTEMPTS:
                time.sleep(pause * 2**attempt)
    return None, ATTEMPTS, error


def _read_page(fetcher: Fetcher, source_id: str, params: Mapping[str, str], pause: float, record_key: str | None, row_element: str | None):
    """Body, attempts, is_empty, error of one request."""
    body, attempts, error = _fetch(fetcher, source_id, params, pause)
    if error is not None:
        return None, attempts, False, error
    return body, attempts, *page_state(body, record_key, row_element)


def fetch_pages(
    requests: DataFrame,
    fetcher: Fetcher,
    run_length: int = 10,
    pause: float = 1.0,
    tasks: int | None = None,
    record_key: str | None = None,
    row_element: str | None = None,
) -> DataFrame:
    """`(source_id, seq, params)` to rows of SCHEMA, one per page that was asked for.

    Runs of `run_length` requests of one source are fetched one after another and stop at the first
    page without records; runs are hashed over `tasks` tasks, so a source with most of the pages is fetched
    by many of them. What is fetched past the end is at most one request per run, and `stitch_pages`
    drops it. A request that fails for good has no body but an `error`, and so has a page without a list of
    records; the other requests go on (`require_pages` fails then). A `url` column is screened first: a URL that is
    not public fails the query.
    """
    url = F.lit(None).cast("string")
    if "url" in requests.columns:
        url, verdict = F.col("url"), url_class("url")
        refusal = F.raise_error(F.concat(F.lit("URL is not public ("), verdict, F.lit("): "), url))
        requests = requests.filter(
            F.when(url.isNull() | (verdict == "public"), F.lit(True)).otherwise(refusal.cast("boolean"))
        )
    tasks = tasks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_url = getattr(fetcher, "by_url", False)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ended = None
        for batch in batches:
            for source_id, seq, params, url in batch.itertuples(index=False):
                run = (source_id, (seq - 1) // run_length)
                if run == ended:
                    continue
                page = _read_page(fetcher, url if by_url else source_id, dict(params), pause, record_key, row_element)
                # One page at a time, so that a task never holds many bodies.
                yield pd.DataFrame([(source_id, seq, seq, *page)], columns=names)
                if page[2]:
                    ended = run

    return (
        requests.select(F.col("source_id").cast("string").alias("source_id"), "seq", "params", url.alias("url"))
        .repartition(tasks, "source_id", F.floor((F.col("seq") - 1) / run_length))
        .sortWithinPartitions("source_id", "seq")
        .mapInPandas(read, SCHEMA)
    )


def repeats(page, earlier) -> str:
    return f"page {page} repeats page {earlier}"


def _repeated(pages: DataFrame) -> DataFrame:
    """`source_id`, `seq`, `of`: pages that repeat earlier ones of their source, by digests of their bodies.

    A page repeats the one before it if they are equal; two pages in a row repeat two earlier ones if they are equal in
    the same order, as with a server that starts again. A page equal to one farther away is no sign of that.
    """
    digests = pages.filter("body IS NOT NULL AND NOT is_empty").select("source_id", "seq", F.sha2("body", 256).alias("digest"))
    before = digests.select("source_id", (F.col("seq") + 1).alias("seq"), F.col("digest").alias("before"))
    pairs = digests.join(before, ["source_id", "seq"])
    same = pairs.filter("digest = before").select("source_id", "seq", (F.col("seq") - 1).alias("of"))
    others = pairs.filter("digest <> before")
    first = others.groupBy("source_id", "before", "digest").agg(F.min("seq").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    both = F.array(*[F.struct((F.col("seq") - k).alias("seq"), (F.col("first") - k).alias("of")) for k in (0, 1)])
    again = others.join(first, ["source_id", "before", "digest"]).filter("seq > first").select("source_id", F.inline(both))
    return same.unionByName(again.filter("of < seq")).groupBy("source_id", "seq").agg(F.min("of").alias("of"))


def _endless(pages: DataFrame, repeated: DataFrame, going: DataFrame, asked: int, fetch: Callable[[DataFrame, list[int]], DataFrame]) -> DataFrame:
    """Of the sources whose last page is a repeated one, those that give pages they gave before wherever they are asked.

    They are probed at doubling distances; a page that is empty, an error or new there shows that the source gets on.
    """
    suspects = repeated.filter(F.col("seq") == asked).select("source_id").join(going, "source_id", "left_semi").distinct().checkpoint()
    if suspects.isEmpty():
        return suspects
    probes = fetch(suspects, [asked << k for k in range(1, PROBES + 1)])
    known = pages.join(suspects, "source_id", "left_semi").select("source_id", F.sha2("body", 256).alias("digest")).distinct()
    digest = F.when(F.col("body").isNotNull() & ~F.col("is_empty"), F.sha2("body", 256))
    moving = probes.select("source_id", digest.alias("digest")).join(known, ["source_id", "digest"], "left_anti")
    return suspects.join(moving, "source_id", "left_anti").checkpoint()


def _close(pages: DataFrame, repeated: DataFrame, endless: DataFrame) -> DataFrame:
    """The pages of endless sources after their last new one lose their body and get an error that names what they repeat."""
    own = pages.join(endless, "source_id", "left_semi").select("source_id", "seq")
    last = own.join(repeated, ["source_id", "seq"], "left_anti").groupBy("source_id").agg(F.max("seq").alias("_last"))
    found = repeated.join(endless, "source_id", "left_semi").join(last, "source_id", "left").filter(F.col("seq") > F.coalesce("_last", F.lit(1)))
    marked = pages.join(found.select("source_id", "seq", "of"), ["source_id", "seq"], "left")
    again = F.col("of").isNotNull()
    told = F.format_string("page %d repeats page %d", "seq", "of")
    return marked.withColumns({"body": F.when(~again, F.col("body")), "error": F.when(again, told).otherwise(F.col("error"))}).select(pages.columns)


def require_pages(pages: DataFrame) -> DataFrame:
    """The same pages; reading one with an error fails."""
    told = F.concat_ws(": ", F.concat_ws(" page ", "source_id", "page"), "error")
    return pages.filter(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


def read_paged(sources: DataFrame, fetcher: Fetcher, keep: bool = True, wave: int | None = None, run_length: int = 10, **options) -> DataFrame:
    """Plan the requests of a table of sources and fetch them, as rows of SCHEMA; a `url` column is screened first.

    The pages are fetched now and checkpointed in the shared folder. Sources without a known end are fetched in waves,
    the first of one run (or `wave` pages), each further one as long as all before it, until they have given a page
    without records or an error. So about twice as many pages are asked for as there are, at most. A source whose
    pages repeat is probed farther on (`_endless`); one that never gives anything new ends with errors that name the
    repeated pages, so no source is read for ever. With
    `keep=False` nothing is fetched now: every use of the frame fetches again, and reading fails where a source without
    a known end goes on after the first wave.
    """
    first_wave = wave or (run_length if keep else WAVE)
    requests = plan_requests(sources, 1, first_wave)
    pages = fetch_pages(requests, fetcher, run_length, **options)
    going = requests.filter("last IS NULL").select(F.col("source_id").cast("string").alias("source_id")).distinct()
    if not keep:
        last = going.select("source_id", F.lit(first_wave).cast("bigint").alias("seq"), F.lit(True).alias("open"))
        goes_on = F.col("open") & ~F.col("is_empty") & F.col("error").isNull()
        told = F.raise_error(F.concat(F.lit("more pages than one wave: "), F.col("source_id"))).cast("boolean")
        marked = pages.join(last, ["source_id", "seq"], "left")
        return marked.filter(F.when(goes_on, told).otherwise(F.lit(True))).select(pages.columns)
    ensure_checkpoint_dir(sources.sparkSession)
    named = F.col("source_id").cast("string") == F.col("_named")

    def fetch(wanted: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
        """Spans of pages (first, how many) of some sources."""
        more = sources.join(wanted.select(F.col("source_id").alias("_named")), named, "left_semi")
        planned = [plan_requests(more, first, many).filter("last IS NULL") for first, many in spans]
        return fetch_pages(reduce(DataFrame.unionByName, planned), fetcher, run_length, **options).checkpoint()

    found, asked, open_ended = pages.checkpoint(), first_wave, going
    while not (going := _going_on(found, open_ended)).isEmpty():
        repeated = _repeated(found.join(going, "source_id", "left_semi")).checkpoint()
        endless = _endless(found, repeated, going, asked, lambda wanted, at: fetch(wanted, [(p, 1) for p in at]))
        if not endless.isEmpty():
            found = _close(found, repeated, endless).checkpoint()
            going = going.join(endless, "source_id", "left_anti").checkpoint()
        if going.isEmpty():
            break
        found = found.unionByName(fetch(going, [(asked + 1, asked)]))
        asked *= 2
    return found


def _going_on(pages: DataFrame, open_ended: DataFrame) -> DataFrame:
    """The sources without a known end that have given pages, none of them empty or an error."""
    ended = pages.filter("is_empty OR error IS NOT NULL").select("source_id")
    return open_ended.join(pages.select("source_id"), "source_id", "left_semi").join(ended, "source_id", "left_anti").checkpoint()


class _Lane(InputPartition):
    """Every `step`-th run of pages from run `first` on."""

    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


class _PagedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.source_id = self.options.get("source_id", "source")
        self.page_param = self.options.get("page_param", "page")
        self.run_length = int(self.options.get("run_length", 10))
        self.last = int(self.options["max_pages"]) if "max_pages" in self.options else None
        if "max_items" in self.options:
            by_items = -(-int(self.options["max_items"]) // int(self.options.get("page_size", PAGE_SIZE)))
            self.last = by_items if self.last is None else min(self.last, by_items)

    def partitions(self):
        lanes = int(self.options.get("lanes", 16))
        if self.last is not None:
            lanes = max(1, min(lanes, -(-self.last // self.run_length)))
        return [_Lane(i, lanes) for i in range(lanes)]

    def fetcher(self) -> Fetcher:
        name = self.options.get("fetcher", "files")
        if name == "files":
            return FileFetcher(self.options["root"], self.page_param)
        module, _, attribute = name.partition(":")
        return getattr(importlib.import_module(module), attribute)

    def read(self, partition):
        fetcher = self.fetcher()
        pause = float(self.options.get("pause", 1))
        how = self.options.get("record_key"), self.options.get("row_element")
        ask = lambda page: _read_page(fetcher, self.source_id, {self.page_param: str(page)}, pause, *how)
        cleared = 0
        for run in count(partition.first, partition.step):
            start = run * self.run_length + 1
            # Without a known end the page before a run is asked for as well, to see pages that repeat.
            before = ask(start - 1)[0] if self.last is None and start > 1 else None
            for page in range(start, start + self.run_length):
                if self.last is not None and page > self.last:
                    return
                found = ask(page)
                if self.last is None and page > cleared and found[0] is not None and not found[2] and found[0] == before:
                    if all(ask(page << k)[0] == before for k in range(1, PROBES + 1)):
                        found = None, found[1], False, repeats(page, page - 1)
                    else:
                        cleared = 2 * page
                before = found[0] if found[0] is not None else before
                yield self.source_id, page, page, *found
                if found[2] or found[3] is not None:
                    return


class PagedSource(DataSource):
    """`spark.read.format("paged")` for one numbered-page source.

    Options: `fetcher` (`files`, which needs `root`, or "module:name" of a callable that executors can
    import), `source_id`, `page_param`, `page_size`, `max_pages`, `max_items`, `run_length`, `lanes`, `pause`,
    `record_key`, `row_element`. Runs of pages are dealt out over `lanes` input partitions, each of which goes on until it meets
    a page without records, an error or the given end; without an end the source is read to its own. A page that
    repeats the one before it, and comes at doubling distances as well, is an error then: a server that goes on with its
    last page is not read for ever.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("fetcher", "files") == "files" and "root" not in self.options:
            raise ValueError("the paged source needs the option 'root' or 'fetcher'")
        return _PagedReader(self.options)


def register_paged(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
