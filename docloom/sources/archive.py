"""Nested ZIP archives with budgets, and binary files with bounds."""

from __future__ import annotations

import io
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_FILE = 50 * 1024 * 1024


@dataclass(frozen=True)
class Budget:
    """Fixed limits of one upload: members of one archive, members and bytes of all its archives."""

    members: int = 1000
    all_members: int = 5000
    bytes: int = 100 * 1024 * 1024


def bounded_files(spark: SparkSession, path: str, glob: str = "*", limit: int = MAX_FILE) -> tuple[DataFrame, DataFrame]:
    """(files, errors): binary files of at most ``limit`` bytes, and the paths of the others. Spark's reader leaves empty files out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    good = F.col("length") <= limit
    errors = files.where(~good).select("path", F.lit("too large").alias("error"))
    return files.where(good).select("path", "length", "content"), errors


def listed_files(spark: SparkSession, paths: str | list[str], glob: str = "*", limit: int = MAX_FILE) -> tuple[DataFrame, DataFrame]:
    """(files, errors): path, length and content of files of 1 to ``limit`` bytes; path and error of every other one.

    ``paths`` is a file, a folder or a list of them, in any store that Spark reads. Spark lists empty files but doesn't
    scan them: those that its listing has and a scan of names and lengths (no content is read) lacks are empty. The
    listing is Spark's own, which the driver holds anyway.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths)
    # The listing escapes names and spells an empty authority; the path column does neither.
    listed = spark.createDataFrame([(re.sub("^([^:/]+):///", r"\1:/", unquote(name)),) for name in files.inputFiles()], "path string").distinct()
    large = files.where(F.col("length") > limit).select("path", F.lit("too large").alias("error"))
    empty = listed.join(files.where("length > 0").select("path"), "path", "left_anti").select("path", F.lit("empty").alias("error"))
    return files.where(F.col("length").between(1, limit)).select("path", "length", "content"), large.unionByName(empty)


def normal_path(path: Column) -> Column:
    """Slashes forward and no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", "")


def is_report(path: Column) -> Column:
    """data/files/PLReport*.zip, in any case."""
    return F.lower(normal_path(path)).rlike(r"^data/files/(?:.*/)?plreport[^/]*\.zip$")


def within_budget(entries: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """``entries`` (doc_id, entry_ord, size) with ok: the members and bytes so far are within the budget."""
    so_far = Window.partitionBy("doc_id").orderBy("entry_ord").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("ok", (F.sum("size").over(so_far) <= budget.bytes) & (F.count("*").over(so_far) <= budget.all_members))


_REPORT = re.compile(r"(?i)^data/files/(?:.*/)?plreport[^/]*\.zip$")


class _Member(NamedTuple):
    """A stored member of a plain archive: where its bytes are, and their CRC."""

    filename: str
    file_size: int
    start: int
    crc: int


_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s2B5H3L5H2L"), struct.Struct("<4s5H3L2H")
#: Of an entry and of a local header only what is looked at.
_HEAD, _NAMED = struct.Struct("<4s2xHHH4x3L4H6xL"), struct.Struct("<4s22x2H")


def _plain_members(raw: bytes) -> list[_Member] | None:
    """The members of an archive in its plainest form, None for any other, which zipfile reads.

    Plain: members stored one behind the other from the first byte, then the directory, then its end; ASCII names, no extra fields, no comments.
    """
    end = len(raw) - _END.size
    if end < 0:
        return None
    sign, disk, first, here, total, size, at, comment = _END.unpack_from(raw, end)
    if sign != b"PK\5\6" or disk or first or here != total or comment or at + size != end or (end >= 20 and raw[end - 20 : end - 16] == b"PK\6\7"):
        return None
    members, free, place = [], 0, at
    fixed, ahead = _ENTRY.size, _LOCAL.size
    for _ in range(total):
        if place + fixed > end:
            return None
        sign, needs, flags, method, crc, packed, size, name, extra, note, disk, local = _HEAD.unpack_from(raw, place)
        start, behind = local + ahead + name, place + fixed + name
        if sign != b"PK\1\2" or needs > 20 or flags or method or packed != size or extra or note or disk or local != free or start + size > at:
            return None
        named = raw[place + fixed : behind]
        sign, own, more = _NAMED.unpack_from(raw, local)
        if sign != b"PK\3\4" or own != name or more or raw[start - name : start] != named or not named.isascii() or b"\0" in named:
            return None
        members.append(_Member(named.decode(), size, start, crc))
        free, place = start + size, behind
    return members if place == end and free == at else None


class _Walk:
    """Members of an upload's archives, against its budget."""

    def __init__(self, budget: Budget):
        self.budget, self.members, self.bytes = budget, 0, 0

    def open(self, raw: bytes) -> tuple[zipfile.ZipFile | bytes, list]:
        """The archive and its members: plain archives are read where they lie, others by zipfile."""
        archive, members = raw, _plain_members(raw)
        if members is None:
            archive = zipfile.ZipFile(io.BytesIO(raw))
            members = archive.infolist()
        members = [x for x in members if not x.filename.endswith("/")]
        self.members += len(members)
        if len(members) > self.budget.members or self.members > self.budget.all_members:
            raise ValueError("too many members")
        return archive, members

    def read(self, archive: zipfile.ZipFile | bytes, member: zipfile.ZipInfo | _Member) -> bytes:
        self.bytes += member.file_size
        if self.bytes > self.budget.bytes:
            raise ValueError("too many bytes")
        if isinstance(member, _Member):
            raw = archive[member.start : member.start + member.file_size]
            if zlib.crc32(raw) != member.crc:
                raise zipfile.BadZipFile(f"Bad CRC-32 for file {member.filename!r}")
            return raw
        with archive.open(member) as file:
            raw = file.read(member.file_size + 1)
        if len(raw) != member.file_size:
            raise ValueError("a member's size is wrong")
        return raw


def _name(member: zipfile.ZipInfo | _Member) -> str:
    return re.sub(r"^(?:\./)+", "", member.filename.replace("\\", "/"))


class BadArchive(ValueError):
    """An upload that gives nothing, with all that is wrong with it."""

    def __init__(self, messages: list[str]):
        super().__init__("; ".join(messages))
        self.messages = messages


#: What reading a damaged archive raises.
_DAMAGED = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, OSError, NotImplementedError, RuntimeError, EOFError)


def sheets_of(raw: bytes, budget: Budget = Budget(), limit: int = MAX_FILE) -> list[tuple[str, str, bytes]]:
    """(report, sheet, payload) of an upload: an only member *_PRODUCT.ZIP is unwrapped, then reports, then *.xls.

    Reports that are no archive or hold no sheet are all collected before the upload fails with them (BadArchive); ValueError
    where the upload itself is too large, no archive, without reports, or breaks the budget.
    """
    if len(raw) > limit:
        raise ValueError("too large")
    walk, found, wrong = _Walk(budget), [], []
    try:
        archive, members = walk.open(raw)
        if len(members) == 1 and members[0].filename.upper().endswith("_PRODUCT.ZIP"):
            archive, members = walk.open(walk.read(archive, members[0]))
        reports = [(_name(x), walk.read(archive, x)) for x in members if _REPORT.match(_name(x))]
    except _DAMAGED as error:
        raise ValueError("not a ZIP") from error
    if not reports:
        raise ValueError("no report")
    for name, content in reports:
        try:
            inner, sheets = walk.open(content)
            own = [(name, x.filename, walk.read(inner, x)) for x in sheets if x.filename.lower().endswith(".xls")]
        except _DAMAGED:
            wrong.append(f"not a ZIP: {name}")
            continue
        if own:
            found += own
        else:
            wrong.append(f"no sheet in {name}")
    if wrong:
        raise BadArchive(wrong)
    return found


def archive_sheets(uploads: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """doc_id, file_ord, report, sheet, payload, error of uploads (doc_id, content): a bad one has a row for each error and no other."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "file_ord", "report", "sheet", "payload", "error"]
        for batch in batches:
            found = []
            for doc_id, raw in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    found += [(doc_id, i, *x, None) for i, x in enumerate(sheets_of(raw or b"", budget))]
                except BadArchive as error:
                    found += [(doc_id, None, None, None, None, message) for message in error.messages]
                except ValueError as error:
                    found.append((doc_id, None, None, None, None, str(error)))
            yield pd.DataFrame(found, columns=columns).astype({"file_ord": "Int32"})

    kind = dict(uploads.dtypes)["doc_id"]
    return uploads.select("doc_id", "content").mapInPandas(rows, f"doc_id {kind}, file_ord int, report string, sheet string, payload binary, error string")


def stored_zip(members: list[tuple[str, bytes]]) -> bytes:
    """An archive of uncompressed members with ASCII names, dated 1980."""
    files, directory, at = [], [], 0
    for name, content in members:
        named, crc, size = name.encode("ascii"), zlib.crc32(content), len(content)
        files += [_LOCAL.pack(b"PK\3\4", 20, 0, 0, 0, 33, crc, size, size, len(named), 0), named, content]
        directory += [_ENTRY.pack(b"PK\1\2", 20, 3, 20, 0, 0, 0, 33, crc, size, size, len(named), 0, 0, 0, 0, 0o600 << 16, at), named]
        at += _LOCAL.size + len(named) + size
    listing = b"".join(directory)
    return b"".join([*files, listing, _END.pack(b"PK\5\6", 0, 0, len(members), len(members), len(listing), at, 0)])
