"""Files below a prefix, listed and checked by executors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.checkpoints import ensure_checkpoint_dir
from strata.files import matching

FILES = "path string, size bigint, modified timestamp"
_CHUNK = 1 << 20

# The first bytes of formats that are no text, and the bytes at both ends of a Parquet file.
MAGIC = {b"PAR1": "Parquet", b"\x1f\x8b": "gzip", b"PK\x03\x04": "zip", b"Obj\x01": "Avro", b"ORC": "ORC", b"\xff\xfe": "UTF-16", b"\xfe\xff": "UTF-16"}
PARQUET_ENDS = (b"PAR1", b"PARE")


def _opened(uri: str):
    """The file system of a URI as Arrow knows it, and the path there."""
    from pyarrow import fs

    scheme, rest = uri.split(":", 1)
    rest = "//" + rest if scheme == "file" and not rest.startswith("//") else rest
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:=,@+~')}")


def _hidden(name: str) -> bool:
    """Names that Spark's own readers pass over: of files in the making, and of what is not data."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for uri in batch["path"]:
            files, where = _opened(uri)
            entry = files.get_file_info(where)
            inner = entry.type == fs.FileType.Directory
            entries = files.get_file_info(fs.FileSelector(where)) if inner else [entry]
            rows = [
                (f"{uri.rstrip('/')}/{e.base_name}" if inner else uri, e.size, e.mtime, e.type == fs.FileType.Directory)
                for e in entries
                if e.type != fs.FileType.NotFound and not (inner and _hidden(e.base_name))
            ]
            yield pd.DataFrame(rows, columns=["path", "size", "modified", "is_folder"]).astype({"size": "Int64"})


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of every file below a prefix or glob pattern, empty ones too; hidden files and folders are left out.

    Folders are listed by executors, a level of the tree each round, so neither the driver nor one task holds the listing. A folder
    with very many files directly in it is listed by one task. Each round is checkpointed; a prefix that is not there
    is an error.
    """
    roots = matching(spark, path)
    if not roots:
        raise FileNotFoundError(path)
    ensure_checkpoint_dir(spark)
    folders, found = spark.createDataFrame([(r,) for r in roots], "path string"), []
    while True:
        listed = folders.repartition("path").mapInPandas(_listed, f"{FILES}, is_folder boolean").checkpoint()
        found.append(listed.where(~F.col("is_folder")).drop("is_folder"))
        folders = listed.where("is_folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _parquet_fault(stream, size: int) -> str | None:
    import pyarrow.parquet as pq

    if size < 12:
        return "too short for Parquet"
    head = stream.read(4)
    stream.seek(size - 8)
    tail = stream.read(8)
    if head not in PARQUET_ENDS or tail[4:] != head:
        return "not Parquet, or cut off"
    if int.from_bytes(tail[:4], "little") > size - 12:
        return "footer longer than the file"
    if head == b"PAR1":
        stream.seek(0)
        pq.read_metadata(stream)
    return None


def _gzip_fault(stream) -> str | None:
    """The whole stream is unpacked, in chunks, as only its end tells whether it is complete."""
    unpacker, ended = zlib.decompressobj(31), True
    while chunk := stream.read(_CHUNK):
        while chunk:
            ended = False
            unpacker.decompress(chunk)
            chunk = unpacker.unused_data
            if unpacker.eof:
                unpacker, ended = zlib.decompressobj(31), True
    return None if ended else "gzip data cut off"


def fault(uri: str, size: int, fmt: str) -> str | None:
    """Why a file cannot be read as `fmt`; None if nothing speaks against it."""
    try:
        files, where = _opened(uri)
        with files.open_input_file(where) as stream:
            if fmt == "parquet":
                return _parquet_fault(stream, size)
            if uri.endswith(".gz"):
                return _gzip_fault(stream)
            if uri.rsplit("/", 1)[-1].rsplit(".", 1)[-1] in ("bz2", "zst", "snappy", "lz4", "deflate"):
                return None
            head = stream.read(4)
            return next((f"{name}, not {fmt} text" for magic, name in MAGIC.items() if head.startswith(magic)), None)
    except Exception as e:  # whatever keeps a file from being read is the answer here
        return f"{type(e).__name__}: {str(e)[:200]}"


def check_files(files: DataFrame, fmt: str) -> DataFrame:
    """Listed files with `reason`: why one cannot be read, null for good ones.

    Of Parquet, both ends and the footer are read; of gzip, all; of other text the first bytes, which must not be
    those of another format. Damage inside a Parquet file is not seen here, and stops the read later.
    """

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reasons = [fault(p, s, fmt) for p, s in zip(batch["path"], batch["size"], strict=True)]
            yield batch.assign(reason=pd.Series(reasons, dtype=object, index=batch.index))

    return files.select("path", "size", "modified").repartition("path").mapInPandas(checked, f"{FILES}, reason string")
