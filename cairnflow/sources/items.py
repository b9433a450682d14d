"""Scans and sinks of item records, vectors, images, catalogs, model files and packed documents."""

from __future__ import annotations

import io
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.functions import names

ITEMS = (
    "safe_name string, source string, font_name string, family_name string, family_names map<string,string>, preferred_family_names map<string,string>, "
    "style_name string, style_names map<string,string>, preferred_style_names map<string,string>, publishers map<string,string>, designers map<string,string>, "
    "copyright string, trademark string, version string, postscript_name string, description string, vendor_url string, designer_url string, sample_text string, "
    "weight int, weights array<string>, font_index int"
)
COMPUTED = "safe_name string, vector_path string, clustering struct<k:int,join_height:float,leaf_angle:float,cluster_angle:float,color_index:int,two:array<float>>"
CATALOG = "family string, variants array<string>, subsets array<string>"
#: Bound of a manifest, and the preview cache's.
MANIFEST_BYTES, CACHE_BYTES = 64 * 1024, 500 * 1024 * 1024


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item records (one JSON document a file); what cannot be read is left out."""
    return spark.read.schema(ITEMS).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(path)


def read_computed(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.schema(COMPUTED).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "computed.json").json(path)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that there is, else the last one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = ((p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths)
    return next((p for p, x in at if x.getFileSystem(conf).exists(x)), paths[-1])


def read_catalog(spark: SparkSession, *paths: str) -> DataFrame:
    """An ordered JSON array of families, from the first of the paths that there is; the place in the file is the rank."""
    whole = spark.read.option("wholetext", True).text(first_existing(spark, *paths))
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{CATALOG.replace(' ', ':', 1).replace(', variants ', ',variants:').replace(', subsets ', ',subsets:')}>>")).alias("rank", "c")).select("rank", "c.*")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats(content: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a file."""
    return content.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of every ``<id>/vector.bin``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "vector.bin").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/vector\.bin$", 1).alias("id"), floats("content").alias("embedding")).where("embedding is not null")


def checked_vectors(vectors: DataFrame, images: DataFrame) -> DataFrame:
    """The vectors, refused unless there are as many as images."""
    n, m = vectors.count(), images.count()
    if n != m:
        raise ValueError(f"{n} vectors for {m} images")
    return vectors


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(id, content) of every sample image, bytes untouched (alpha included)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.png$", 1).alias("id"), "content")


def read_directions(spark: SparkSession, path: str, attributes: tuple[str, ...] = names.ATTRIBUTES, dim: int = 512) -> dict[str, list[float]]:
    """Attribute directions (a small JSON object), refused unless they are sound."""
    df = spark.read.schema("directions map<string,array<double>>").option("multiLine", True).json(path)
    row = df.where(names.valid_directions(F.col("directions"), attributes, dim)).select("directions").first()
    if row is None:
        raise ValueError(f"no sound directions in {path}")
    return dict(row.directions)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Valid manifests of local models by id; others are passed over."""
    schema = "api_version int, id string, name string, parameter_count bigint, digests array<string>"
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "model.json").json(path)
    return found.where(names.valid_manifest(F.struct(*found.columns), F.col("id")) & names.valid_model_id(F.col("id"))).orderBy("id")


def remote_models(releases: DataFrame) -> DataFrame:
    """Models of valid releases (id, draft, prerelease, assets) with their download size."""
    size = F.aggregate("assets", F.lit(0).cast("bigint"), lambda s, a: s + a["size"])
    return releases.where(names.valid_release(F.struct("draft", "prerelease", "assets"))).select("id", size.alias("download_size"))


def sound_manifest(content: Column, size: Column, digest: Column) -> Column:
    """At most 64 KiB, of the stated size and digest."""
    return (F.octet_length(content) <= MANIFEST_BYTES) & (F.octet_length(content) == size) & names.digest_matches(content, digest)


def fetched(rows: DataFrame, fetch, schema: str = "content binary, error string") -> DataFrame:
    """Rows (url, ...) with what ``fetch(url) -> bytes`` returns, or its error; a failure costs its row only."""
    keep = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for url in p["url"]:
                try:
                    out.append((fetch(url), None))
                except Exception as e:  # noqa: BLE001  reported beside the row
                    out.append((None, str(e)))
            yield p.assign(content=[o[0] for o in out], error=[o[1] for o in out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select(*keep).mapInPandas(run, f"{fields}, {schema}")


def seeded(sessions: DataFrame, examples: DataFrame, version: str) -> tuple[DataFrame, object]:
    """The sessions, or the examples under the running version where there is none; and the newest ``modified_at`` of what was added (else None)."""
    if sessions.limit(1).count():
        return sessions, None
    added = examples.withColumn("app_version", F.lit(version))
    return sessions.unionByName(added), added.agg(F.max("modified_at")).first()[0]


def evicted(cache: DataFrame, most: int = CACHE_BYTES) -> DataFrame:
    """Entries (key, bytes, used_at) beyond the cache's size, least recently used first."""
    from cairnflow.operators.selection import running_total

    return running_total(cache, [F.desc("used_at"), F.asc("key")], F.col("bytes"), "_total").where(F.col("_total") > most).drop("_total")


def pack_folder(folder: str, path: str) -> None:
    """A folder as one archive: entries sorted, stored as they are, complete or not there."""
    part = f"{path}.part"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_STORED) as z:
        files = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)
        for f in files:
            if os.path.islink(os.path.join(folder, f)):
                raise ValueError(f"{f} is a link")
            z.writestr(zipfile.ZipInfo(f.replace(os.sep, "/")), open(os.path.join(folder, f), "rb").read())
    os.replace(part, path)


def unpack(path: str, folder: str) -> None:
    """Only entries that stay below the folder."""
    top = os.path.realpath(folder)
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            to = os.path.realpath(os.path.join(top, info.filename))
            if not to.startswith(top + os.sep):
                raise ValueError(f"{info.filename} leaves the folder")
            if info.is_dir():
                os.makedirs(to, exist_ok=True)
                continue
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "wb") as f:
                f.write(z.read(info))


def member(path: str, name: str) -> bytes:
    """S15."""
    with zipfile.ZipFile(path) as z:
        return z.read(name)


def replace_member(path: str, name: str, content: bytes) -> None:
    """One entry replaced, the others copied."""
    part = f"{path}.part"
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(part, "w", zipfile.ZIP_STORED) as out:
        for info in z.infolist():
            out.writestr(zipfile.ZipInfo(info.filename), content if info.filename == name else z.read(info))
    os.replace(part, path)


def decode_png(content: bytes) -> np.ndarray:
    """An 8-bit PNG that is not interlaced as rows, columns, channels."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, raw, head = 8, b"", b""
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        head = body if kind == b"IHDR" else head
        raw += body if kind == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced or colour not in (0, 2, 4, 6):
        raise ValueError("unsupported PNG")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    data = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        kind, line = data[y, 0], data[y, 1:].astype(np.int32)
        if kind == 2:
            line = (line + above) & 255
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                b, c = above[x], above[x - channels] if x >= channels else 0
                if kind == 4:
                    p = a + b - c
                    a = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                line[x] = (line[x] + (a if kind != 3 else (a + b) // 2)) & 255
        out[y], above = line, line
    return out.reshape(height, width, channels)


def encode_png(grey: np.ndarray, alpha: np.ndarray) -> bytes:
    """An 8-bit grey and alpha PNG."""
    h, w = grey.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.stack([grey, alpha], axis=2).reshape(h, 2 * w)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    out = io.BytesIO()
    out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 4, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.astype(np.uint8).tobytes())) + chunk(b"IEND", b""))
    return out.getvalue()


def cropped(coverage: np.ndarray) -> bytes:
    """A PNG of the rows and columns that hold ink, white with the coverage as alpha; an empty image is refused."""
    rows, columns = np.flatnonzero(coverage.any(axis=1)), np.flatnonzero(coverage.any(axis=0))
    if not len(rows):
        raise ValueError("the image is empty")
    ink = np.ascontiguousarray(coverage[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1], dtype=np.uint8)
    return encode_png(np.full_like(ink, 255), ink)


def _resample(size: int, to: int) -> np.ndarray:
    """Weights of Catmull-Rom resampling, widened when shrinking."""
    scale = size / to
    reach = max(scale, 1.0)
    at = (np.arange(to) + 0.5) * scale - 0.5
    x = np.abs((np.arange(size)[None, :] - at[:, None]) / reach)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def preprocess(image: np.ndarray, side: int = 224) -> np.ndarray:
    """V1: fitted into a square, ink as ``255 - (L * A + 127) / 255`` in whole numbers, centred on white, over 255."""
    h, w = image.shape[:2]
    grey = image[..., :-1].mean(axis=2) if image.shape[2] in (2, 4) else image.mean(axis=2)
    alpha = image[..., -1].astype(float) if image.shape[2] in (2, 4) else np.full((h, w), 255.0)
    ratio = side / max(h, w)
    nh, nw = max(1, min(side, round(h * ratio))), max(1, min(side, round(w * ratio)))
    rows, columns = _resample(h, nh), _resample(w, nw)
    fit = lambda a: np.clip(np.rint(rows @ a @ columns.T), 0, 255).astype(np.int64)
    ink = 255 - (fit(grey) * fit(alpha) + 127) // 255
    out = np.full((side, side), 255, np.int64)
    top, left = (side - nh) // 2, (side - nw) // 2
    out[top : top + nh, left : left + nw] = ink
    return (out / 255.0).astype(np.float32)


def embed(images: DataFrame, make_encoder, batch: int = 8, width: int = 512) -> DataFrame:
    """(id, embedding, error) of images (id, content).

    ``make_encoder()`` gives a function from (n, 1, 224, 224) floats to (n, ``width``); it is made once in a worker. Short batches
    are padded with zeros and the padding's rows dropped. Images that fail, or hold no ink, carry their error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for p in parts:
            ready, errors = [], []
            for content in p["content"]:
                try:
                    image = decode_png(bytes(content))
                    if image.shape[2] in (2, 4) and not image[..., -1].any():
                        raise ValueError("the image is empty")
                    ready.append(preprocess(image))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  reported beside the row
                    ready.append(None)
                    errors.append(str(e))
            good = [i for i, r in enumerate(ready) if r is not None]
            out: list = [None] * len(ready)
            for k in range(0, len(good), batch):
                some = good[k : k + batch]
                x = np.zeros((batch, 1, 224, 224), np.float32)
                x[: len(some), 0] = [ready[i] for i in some]
                y = np.asarray(encoder(x))
                if y.ndim != 2 or y.shape[1] != width:
                    raise ValueError(f"the encoder's output is {y.shape}, not (n, {width})")
                for i, v in zip(some, y, strict=False):
                    out[i] = v.astype(np.float32)
            yield pd.DataFrame({"id": p["id"], "embedding": out, "error": errors})

    return images.select("id", "content").mapInPandas(run, "id string, embedding array<float>, error string")


def analyzed(images: DataFrame, make_encoder, batch: int = 8, width: int = 512) -> tuple[DataFrame, DataFrame]:
    """V3: (id, embedding) of the images that succeed, and (id, error) of the others; refused with the first error if none succeeds."""
    from cairnflow.sources.store import stored

    done = stored(embed(images, make_encoder, batch, width), "vectors")
    good, bad = done.where("error is null").select("id", "embedding"), done.where("error is not null").select("id", "error")
    if not good.limit(1).count():
        first = bad.orderBy("id").first()
        raise RuntimeError(first.error if first else "there are no images")
    return good, bad


#: Tags of the language numbers of Windows names that are told apart; 0 of Macintosh names is English.
LANGUAGE_TAGS = {0x0409: "en-US", 0x0809: "en-GB", 0x0407: "de", 0x040C: "fr", 0x0C0C: "fr-CA", 0x0410: "it", 0x040A: "es", 0x0C0A: "es", 0x0411: "ja", 0x0412: "ko", 0x0804: "zh-Hans", 0x0404: "zh-Hant", 0x0419: "ru", 0x0413: "nl", 0x041D: "sv", 0x0416: "pt-BR"}


def language_tag(platform: int, language: int) -> str:
    """The tag of a name's language; unknown numbers stay numbers, names without a language are ``und``."""
    if platform == 3:
        return LANGUAGE_TAGS.get(language, str(language))
    return "en" if platform == 1 and language == 0 else str(language) if platform == 1 else "und"


def _table(content: bytes, index: int, tag: bytes) -> bytes | None:
    at = struct.unpack(">I", content[12 + 4 * index : 16 + 4 * index])[0] if content[:4] == b"ttcf" else 0
    n = struct.unpack(">H", content[at + 4 : at + 6])[0]
    for k in range(n):
        name, _, offset, size = struct.unpack(">4sIII", content[at + 12 + 16 * k : at + 28 + 16 * k])
        if name == tag:
            return content[offset : offset + size]
    return None


def glyph_of(content: bytes, character: str, index: int = 0) -> int:
    """The glyph that a font's character map (formats 4 and 12) has for a character, 0 for none."""
    table, code = _table(content, index, b"cmap"), ord(character)
    for k in range(struct.unpack(">H", table[2:4])[0] if table else 0):
        at = struct.unpack(">HHI", table[4 + 8 * k : 12 + 8 * k])[2]
        kind = struct.unpack(">H", table[at : at + 2])[0]
        if kind == 12:
            for first, last, glyph in struct.iter_unpack(">III", table[at + 16 : at + 16 + 12 * struct.unpack(">I", table[at + 12 : at + 16])[0]]):
                if first <= code <= last:
                    return glyph + code - first
        elif kind == 4 and code < 0x10000:
            n = struct.unpack(">H", table[at + 6 : at + 8])[0] // 2
            part = lambda i: struct.unpack(f">{n}H", table[at + 14 + 2 * n * i + 2 * (i > 0) :][: 2 * n])  # noqa: B023, E731
            ends, starts, deltas, offsets = (part(i) for i in range(4))
            s = next((s for s in range(n) if code <= ends[s]), None)
            if s is None or code < starts[s]:
                continue
            if not offsets[s]:
                return (code + deltas[s]) & 0xFFFF
            place = at + 16 + 6 * n + 2 * s + offsets[s] + 2 * (code - starts[s])
            glyph = struct.unpack(">H", table[place : place + 2])[0]
            return (glyph + deltas[s]) & 0xFFFF if glyph else 0
    return 0


def parse_names(content: bytes, index: int = 0) -> list[tuple[int, int, int, int, str]]:
    """The name table of a font (platform, encoding, language, name id, value), Unicode and Mac Roman entries."""
    at = 0
    if content[:4] == b"ttcf":
        at = struct.unpack(">I", content[12 + 4 * index : 16 + 4 * index])[0]
    n = struct.unpack(">H", content[at + 4 : at + 6])[0]
    for k in range(n):
        tag, _, offset, _ = struct.unpack(">4sIII", content[at + 12 + 16 * k : at + 28 + 16 * k])
        if tag == b"name":
            _, count, strings = struct.unpack(">HHH", content[offset : offset + 6])
            out = []
            for i in range(count):
                platform, encoding, language, name, size, place = struct.unpack(">6H", content[offset + 6 + 12 * i : offset + 18 + 12 * i])
                raw = content[offset + strings + place : offset + strings + place + size]
                out.append((platform, encoding, language, name, raw.decode("mac_roman" if platform == 1 else "utf-16-be", "replace")))
            return out
    return []


def scan_fonts(spark: SparkSession, path: str, text: str = "") -> DataFrame:
    """(path, font_index, names) of every face that has a glyph for each character of the text and no internal
    name among its families, styles and full name; files that cannot be parsed are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ttf,otf,ttc}").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for where, content in zip(p["path"], p["content"], strict=True):
                content = bytes(content)
                faces = struct.unpack(">I", content[8:12])[0] if content[:4] == b"ttcf" else 1
                for i in range(faces):
                    try:
                        found = parse_names(content, i)
                        whole = all(c in "\0\ufffd" or glyph_of(content, c, i) for c in text)
                    except (struct.error, UnicodeDecodeError):
                        continue
                    if whole and not any("LastResort" in x[4] or x[4].startswith(".") for x in found if x[3] in (1, 2, 4, 16, 17)):
                        out.append((where, i, [{"language": language_tag(x[0], x[2]), "name_id": x[3], "value": x[4]} for x in found]))
            yield pd.DataFrame(out, columns=["path", "font_index", "names"])

    return files.mapInPandas(run, "path string, font_index int, names array<struct<language:string,name_id:int,value:string>>")
