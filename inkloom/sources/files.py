"""Archives and folders of files as DataFrames, and lookups on them."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
SETTINGS_FILE = "publican.cfg"
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "svg")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, path, content): every file below a folder, paths without the folder itself."""
    root = path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    bare = re.sub("^[a-z]+:/*", "/", root)
    return files.select(F.lit(root).alias("source_id"), F.substring(F.col("path"), F.locate(bare, F.col("path")) + len(bare), F.length("path")).alias("path"), "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, path, content, crc32, error): the entries of the ZIP archives below a path."""
    return unpack(spark.read.format("binaryFile").load(path).select("path", "content"))


def unpack(archives: DataFrame) -> DataFrame:
    """archives(source, content) to (source_id, path, content, crc32, error). An archive that can't be read gives one row with its error."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source_id", "path", "content", "crc32", "error"]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    entries = archive.infolist()
                    if any(e.flag_bits & 1 for e in entries):
                        raise ValueError("encrypted")
                    for e in entries:  # one entry at a time
                        if not e.is_dir():
                            row = (place, e.filename, archive.read(e), e.CRC, None)
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)
                except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((place, None, None, None, str(e)), kinds, strict=True)], names=names)

    return archives.mapInArrow(unzip, "source_id string, path string, content binary, crc32 long, error string")


# Archives of any size: entries are listed from the central directories, then read by range, many tasks to an archive.

_ENTRY = "source_id string, path string, offset long, packed long, size long, crc32 long, method int, error string"
#: Entries of so many bytes of an archive are read by one task.
STRETCH = 128 << 20
#: More than this doesn't fit into one value.
LARGEST = (1 << 31) - 64


def _open(path: str):
    """A file that tasks can open by themselves: local ones, and what pyarrow has a file system for."""
    if path.startswith("/") or path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), "rb")
    fs, name = pa.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def entries(archives: DataFrame) -> DataFrame:
    """archives(source_id: a path) to their entries (source_id, path, offset, packed, size, crc32, method, error); nothing but the directories is read.

    An archive that can't be read gives one row with its error, an entry that can't be (encrypted, of an unknown method, too large) one with its own.
    """
    names = [c.split()[0] for c in _ENTRY.split(", ")]

    def listed(place: str) -> Iterator[tuple]:
        with _open(place) as file:
            for e in zipfile.ZipFile(file).infolist():
                if not e.is_dir():
                    wrong = "encrypted" if e.flag_bits & 1 else f"method {e.compress_type}" if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) else "too large" if max(e.file_size, e.compress_size) > LARGEST else None
                    yield place, e.filename, e.header_offset, e.compress_size, e.file_size, e.CRC, e.compress_type, wrong

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            for place in batch.column(0).to_pylist():
                try:
                    rows = [*listed(place)]
                except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                    rows = [(place, None, None, None, None, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("source_id").mapInArrow(run, _ENTRY)


def read_entries(listed: DataFrame) -> DataFrame:
    """(source_id, path, content, crc32, error) of entries; those of one stretch of an archive are read together, in order."""

    def content(file, offset: int, packed: int, method: int) -> bytes:
        file.seek(offset)
        head = file.read(30)
        file.seek(offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        data = file.read(packed)
        return data if method == zipfile.ZIP_STORED else zlib.decompress(data, -zlib.MAX_WBITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in batches:
            for place, path, offset, packed, size, crc, method, error in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                data = None
                if error is None:
                    try:
                        if place != now:
                            now, file = place, _open(place)
                        data = content(file, offset, packed, method)
                        if len(data) != size or zlib.crc32(data) != crc:
                            data, error = None, "damaged"
                    except (OSError, zlib.error) as e:
                        error = str(e)
                row = [(place, pa.string()), (path, pa.string()), (data, pa.binary()), (crc, pa.int64()), (error, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=["source_id", "path", "content", "crc32", "error"])

    dealt = listed.repartition("source_id", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("source_id", "offset")
    return dealt.select(*(c.split()[0] for c in _ENTRY.split(", "))).mapInArrow(run, "source_id string, path string, content binary, crc32 long, error string")


def read_large_archives(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_archives`, for archives of any size and number of entries, in stores that tasks can open."""
    places = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"))
    return read_entries(entries(places.repartition(spark.sparkContext.defaultParallelism, "source_id")))


def strip_root(path: Column) -> Column:
    return F.regexp_replace(path, "^[^/]+/", "")


def is_file(path: Column) -> Column:
    """The last segment is neither empty nor hidden."""
    return ~F.regexp_extract(path, "([^/]*)$", 1).rlike(r"^(\.|$)")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def listing(files: DataFrame) -> DataFrame:
    """Entries with their place in the order by depth, then by lower-cased path."""
    order = Window.partitionBy("source_id").orderBy(depth(F.col("path")), F.lower("path"), "path")
    return files.withColumn("place", F.row_number().over(order))


def lookup(files: DataFrame, wanted: DataFrame, ignore_case: bool = False) -> DataFrame:
    """wanted(source_id, name) with the content of that entry: the exact name wins, else the last that differs in case alone. Of entries with one path the greatest content counts."""
    if not ignore_case:
        only = files.groupBy("source_id", F.col("path").alias("name")).agg(F.max("content").alias("content"))
        return wanted.join(only, ["source_id", "name"], "left")
    named = files.select("source_id", F.lower("path").alias("low"), "path", "content")
    both = wanted.withColumn("low", F.lower("name")).join(named, ["source_id", "low"], "left")
    best = both.groupBy("source_id", "name").agg(F.max_by("content", F.struct(F.col("path") == F.col("name"), F.col("path"), F.col("content"))).alias("content"))
    return wanted.join(best, ["source_id", "name"], "left")


def settings(files: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """``name: value`` lines with exactly one colon, quotation marks dropped; the first of a name wins."""
    lines = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    pairs = lines.withColumn("kv", F.split("line", ":")).where((F.size("kv") == 2) & ~F.col("line").startswith("#"))
    clean = lambda c: F.trim(F.regexp_replace(c, "[\"']", ""))
    return pairs.groupBy(key, clean(F.col("kv")[0]).alias("name")).agg(F.min_by(clean(F.col("kv")[1]), "line_no").alias("value"))


def main_file(files: DataFrame, max_entries: int | None = None) -> DataFrame:
    """The first XML file of each source, in listing order, that opens a book or an article."""
    ranked = listing(files)
    small = ranked if max_entries is None else ranked.join(files.groupBy("source_id").count().where(F.col("count") < max_entries).select("source_id"), "source_id", "left_semi")
    fit = small.where(F.col("path").endswith(".xml") & F.decode("content", "UTF-8").rlike(r"<\s*(book|article)(\s+|>)"))
    return fit.groupBy("source_id").agg(F.min_by("path", "place").alias("main_file"))


def is_office_text(files: DataFrame) -> DataFrame:
    """Which sources hold both parts of an office text."""
    return files.groupBy("source_id").agg((F.bool_or(F.col("path") == "content.xml") & F.bool_or(F.col("path") == "styles.xml")).alias("is_office_text"))


def book_problems(files: DataFrame, locale: str) -> DataFrame:
    """Sources with what keeps them from being a book: no root settings file, or no XML file of the locale outside tmp/."""
    xml = F.bool_or(F.col("path").rlike(rf"^{locale}/.*\.xml$") & ~F.col("path").startswith("tmp/"))
    found = files.groupBy("source_id").agg(F.bool_or(F.col("path") == SETTINGS_FILE).alias("cfg"), xml.alias("xml"))
    return found.select("source_id", F.array_compact(F.array(F.when(~F.col("cfg"), "no settings"), F.when(~F.col("xml"), "no text"))).alias("problems"))


def text_of(content: Column) -> Column:
    """The text of an entry."""
    return F.decode(content, "UTF-8")


def source_name(path: Column) -> Column:
    """A file's own name, or for paths of a folder the folder's: their first part."""
    return F.split(path, "/")[0]


def exists(files: DataFrame, wanted: DataFrame, ignore_case: bool = False) -> DataFrame:
    """wanted(source_id, name) with ``found``: whether the source has an entry of that name."""
    as_key = (lambda c: F.lower(c)) if ignore_case else F.col
    known = files.select("source_id", as_key("path").alias("__key")).distinct().withColumn("found", F.lit(True))
    return wanted.withColumn("__key", as_key("name")).join(known, ["source_id", "__key"], "left").select("source_id", "name", F.coalesce("found", F.lit(False)).alias("found"))


def candidates(files: DataFrame, kind: str = "xml") -> DataFrame:
    """Entries that may be a main file: XML files, or (asciidoc) all files that are no image."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.where(is_file(F.col("path")) & (suffix == "xml" if kind == "xml" else ~suffix.isin(*IMAGE_SUFFIXES)))


def main_file_of_book(files: DataFrame, locale: str) -> DataFrame:
    """(source_id, main_file) by the settings' mainfile, else by the title of the book's info file, where such a file exists.

    files(source_id, path, text). Settings name files of the locale's folder, with or without suffix; in titles spaces
    stand for underscores.
    """
    cfg = settings(files.where(F.col("path") == SETTINGS_FILE), "text", "source_id").where("name = 'mainfile'")
    named = cfg.select("source_id", F.concat(F.lit(f"{locale}/"), F.regexp_replace("value", r"\.xml$", ""), F.lit(".xml")).alias("path"), F.lit(0).alias("rank"))
    infos = files.where(F.col("path").isin(*(f"{locale}/{k}_Info.xml" for k in ("Book", "Article"))))
    first = infos.groupBy("source_id").agg(F.min_by(F.regexp_extract("text", "<title>(.*?)</title>", 1), F.struct(F.lower("path"), "path")).alias("title")).where("title <> ''")
    titled = first.select("source_id", F.concat(F.lit(f"{locale}/"), F.replace(F.col("title"), F.lit(" "), F.lit("_")), F.lit(".xml")).alias("path"), F.lit(1).alias("rank"))
    there = named.unionByName(titled).join(files.select("source_id", "path").distinct(), ["source_id", "path"])
    return there.groupBy("source_id").agg(F.min_by("path", "rank").alias("main_file"))


def config_names(files: DataFrame, prefix: str = "config") -> DataFrame:
    """(source_id, path, config_name) of settings files: theirs where it fits, else one made of their name, else prefix and a running number."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    own = listing(files.where(F.col("path").endswith(".cfg"))).withColumn("file", name)
    bare = F.replace(F.regexp_replace("file", r"\.cfg$", ""), F.lit(SETTINGS_FILE.removesuffix(".cfg")), F.lit(""))
    fine = (F.col("file") == SETTINGS_FILE) | F.col("file").rlike(rf"^\S+-{re.escape(SETTINGS_FILE)}$")
    kind = F.when(fine, 0).when(bare.rlike("^[A-Za-z]+[A-Za-z0-9]*$"), 1).otherwise(2)
    ranked = own.withColumn("kind", kind).withColumn("k", F.row_number().over(Window.partitionBy("source_id", "kind").orderBy("place")))
    made = F.when(F.col("kind") == 0, F.col("file")).when(F.col("kind") == 1, F.concat(bare, F.lit(f"-{SETTINGS_FILE}"))).otherwise(F.concat(F.lit(prefix), F.col("k").cast("string"), F.lit(f"-{SETTINGS_FILE}")))
    return ranked.select("source_id", "path", made.alias("config_name"))


def config_lines(files: DataFrame, ignored: list[str]) -> DataFrame:
    """(path, lines) of settings files without blank lines and ignored names. files(path, text)."""
    lines = F.filter(F.split("text", "\n"), lambda l: (F.trim(l) != "") & ~F.trim(F.split(l, ":")[0]).isin(*ignored))
    return files.select("path", lines.alias("lines"))


def pack(files: DataFrame) -> DataFrame:
    """(source_id, content): one ZIP archive for each source. files(source_id, path, content); an archive is one value, so its entries meet in a row."""

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, entries in zip(batch.column("source_id").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    for e in entries:
                        archive.writestr(zipfile.ZipInfo(e["path"]), e["content"] or b"")
                yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([out.getvalue()], pa.binary())], names=["source_id", "content"])

    held = files.groupBy(F.col("source_id").cast("string").alias("source_id")).agg(F.array_sort(F.collect_list(F.struct("path", F.col("content").cast("binary").alias("content")))).alias("entries"))
    return held.mapInArrow(zipped, "source_id string, content binary")


def in_files_folder(path: Column, locale: str, ignored: tuple[str, ...] = (".gitignore",)) -> Column:
    """Whether an entry lies in the locale's folder of additional files."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return path.startswith(f"{locale}/files/") & is_file(path) & ~name.isin(*ignored)


def first_found(files: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted(key, names) with what files(path, ...) holds under the first of the names that exists; nulls if none does."""
    named = wanted.select(key, F.posexplode("names").alias("pos", "path")).join(files, "path")
    values = [c for c in files.columns if c != "path"]
    best = named.groupBy(key).agg(F.min_by(F.struct("path", *values), "pos").alias("__x"))
    return wanted.join(best, key, "left").select(key, F.col("__x.path").alias("path"), *(F.col(f"__x.{v}").alias(v) for v in values))


def bytes_of(text: Column) -> Column:
    """The bytes of binary content that came as text: of each character the low eight bits of its code."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.lpad(F.hex(F.ascii(c).bitwiseAND(255)), 2, "0"))
    return F.unhex(F.array_join(codes, ""))
