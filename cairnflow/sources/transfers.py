"""What is fetched: font subsets by way of their stylesheets, files into a folder, releases, assets under a digest.

A transfer is any function from an address to bytes (or an iterator of chunks), so nothing here opens a connection.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions import names
from cairnflow.sources.items import fetched

#: Releases that are looked at, and bytes between two reports of a download.
NEWEST, REPORT_BYTES = 100, 1 << 20


def _known(fetch: Callable[[str], bytes]) -> Callable[[str | None], bytes]:
    def run(url: str | None) -> bytes:
        if not url:
            raise ValueError("no address")
        return fetch(url)

    return run


def subsets(asked: DataFrame, fetch: Callable[[str], bytes], address: str) -> DataFrame:
    """Rows (family, weight, text, ...) with ``content``, ``container`` and ``error``: the stylesheet at ``address`` + query
    names the file; a failure of either step, or bytes that are no font, cost their row only."""
    rows = asked.withColumn("url", F.concat(F.lit(address), names.css_query(F.col("family"), F.col("weight").cast("string"), F.col("text"))))
    sheets = fetched(rows, _known(fetch)).withColumnsRenamed({"error": "_sheet_error"})
    files = fetched(sheets.withColumn("url", names.css_source(F.col("content").cast("string"))).drop("content"), _known(fetch))
    container = names.font_container(F.col("content"))
    error = F.coalesce("_sheet_error", "error", F.when(container.isNull(), F.lit("not a font")))
    return files.select(*asked.columns, F.when(error.isNull(), F.col("content")).alias("content"), F.when(error.isNull(), container).alias("container"), error.alias("error"))


def wanted(catalog: DataFrame, weights: list[int], text: str) -> DataFrame:
    """What a bulk download asks for: (family, requested, weight, text) of every catalog row (family, variants) and offered weight."""
    each = catalog.select("family", "variants", F.explode(F.array(*map(F.lit, weights))).alias("requested"))
    return each.withColumn("weight", names.api_weight(F.col("requested"), F.col("variants"))).where("weight is not null").select("family", "requested", "weight", F.lit(text).alias("text"))


def file_name(family: Column, requested: Column) -> Column:
    """``<Family>_Weight<w>.ttf``."""
    return F.concat(F.translate(family, " ", "_"), F.lit("_Weight"), requested.cast("string"), F.lit(".ttf"))


def save(files: DataFrame, folder: str) -> DataFrame:
    """Writes every row's content (name, content) below a folder that all executors reach (any file system that Arrow
    opens); returns (path, error). Rows without content are passed over."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(top, recursive=True)
        for p in parts:
            out = []
            for name, content in zip(p["name"], p["content"], strict=True):
                try:
                    if "/" in name:
                        system.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(f"{top}/{name}.part") as f:
                        f.write(bytes(content))
                    system.move(f"{top}/{name}.part", f"{top}/{name}")
                    out.append((f"{folder}/{name}", None))
                except OSError as e:
                    out.append((None, str(e)))
            yield pd.DataFrame(out, columns=["path", "error"])

    return files.where("content is not null").select("name", "content").mapInPandas(run, "path string, error string")


def preview(catalog: DataFrame, family: str, requested: int, text: str, fetch: Callable[[str], bytes], address: str) -> DataFrame:
    """One subset, of the catalog's family of exactly this name."""
    return subsets(wanted(catalog.where(F.col("family") == family), [requested], text), fetch, address)


def newest_releases(releases: DataFrame, n: int = NEWEST) -> DataFrame:
    """The n releases published last (published_at, id, ...)."""
    return releases.orderBy(F.desc("published_at"), "id").limit(n)


def download(chunks: Iterable[bytes], size: int, digest: str, report: Callable[[int], None] = lambda done: None, every: int = REPORT_BYTES) -> Iterator[bytes]:
    """Passes chunks on while their digest and length are kept: more bytes than stated end it at once, a wrong length or
    digest at the end. ``report`` gets the bytes so far about once every MiB, and at the end."""
    seen, done, told = hashlib.sha256(), 0, 0
    for chunk in chunks:
        done += len(chunk)
        if done > size:
            raise ValueError(f"more than the stated {size} bytes")
        seen.update(chunk)
        if done - told >= every:
            told = done
            report(done)
        yield chunk
    if done != size:
        raise ValueError(f"{done} bytes instead of {size}")
    if seen.hexdigest() != digest.lower().removeprefix("sha256:"):
        raise ValueError("the digest differs")
    report(done)
