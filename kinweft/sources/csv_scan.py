"""A strict, bounded CSV reader whose files are split: lines are read by many tasks, records are put together again.

``spark.read.csv`` cannot find a header behind a preamble, refuse rows of another width, or tell bad quoting and bad
encodings apart, and with line breaks in fields it reads a file in one task.  Here Spark's text reader deals out the
lines.  A line break ends a record if an even number of quotes stands before it, up to the file's first mistake in any
case; so the quotes of the blocks of a file, summed up before each block, tell where records begin, and only the small
table of blocks is put in order.  Records, rows and errors are those of :func:`parse`, which reads a file's bytes in one
go.  No task holds more than a block and a record of the largest size.
"""

from __future__ import annotations

import os
import re
import stat
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweft.config import ConfigError
from kinweft.functions.digest import canonical_json, sha256_hex
from kinweft.session import staged

# The fields a column can be mapped to, the transforms a mapping can name, and the hard limits.
TARGETS = ("first_name", "last_name", "full_name", "email", "profile_url", "company_name", "company_domain", "title", "connected_on", "source_observed_at", "provider_person_id", "provider_organization_id", "crm_contact_id", "crm_account_id")
TRANSFORMS = ("trim", "unicode_nfkc", "casefold", "email_normalize", "url_syntax_validate", "domain_normalize", "iso_date_parse", "control_character_reject")
LIMITS = {"file_bytes": 100 << 20, "rows": 100_000, "row_bytes": 1 << 20, "field_bytes": 256 << 10, "columns": 256}
_LIMIT_NAMES = {"maxFileBytes": "file_bytes", "maxDataRows": "rows", "maxRowBytes": "row_bytes", "maxFieldBytes": "field_bytes", "maxColumns": "columns"}
MODES = ("first_record", "detect_required_headers")


def header_key(text: str) -> str:
    return unicodedata.normalize("NFKC", text).strip().lower()


def _known(value: Any, names: set[str]) -> dict[str, Any]:
    """An object's entries by snake-case names; an entry of another name is an error."""
    if not isinstance(value, dict):
        raise ConfigError("INVALID_MAPPING")
    made = {re.sub("[A-Z]", lambda m: "_" + m[0].lower(), k): v for k, v in value.items()}
    if set(made) - names:
        raise ConfigError("INVALID_MAPPING")
    return made


def _texts(value: Any, most: int) -> list[str]:
    if not isinstance(value, (list, tuple)) or len(value) > most or any(not isinstance(v, str) or not 0 < len(v) <= 256 for v in value):
        raise ConfigError("INVALID_MAPPING")
    return list(value)


@dataclass(frozen=True)
class Mapping:
    """Which header fills which target field, and how the file is written."""

    columns: dict[str, str]
    required: tuple[str, ...] = ()
    delimiter: str = ","
    header: str = "first_record"
    max_preamble: int = 0
    limits: dict[str, int] = field(default_factory=lambda: dict(LIMITS))
    #: Target fields that no row may leave blank.
    values: tuple[str, ...] = ()

    @classmethod
    def read(cls, value: dict[str, Any]) -> Mapping:
        """A mapping from its JSON form, strictly: what is not known is refused.

        ``header`` is an object of ``mode``, ``requiredSourceHeaders`` (by default all that are mapped) and
        ``maxPreambleLines``.  Keys may be spelled in snake case, and ``headerMode`` and ``maxPreambleLines`` may stand
        at the top; the headers of required columns are those that are required then.
        """
        made = _known(value, {"delimiter", "header", "columns", "limits", "header_mode", "max_preamble_lines"})
        if not isinstance(made.get("columns"), (list, tuple)) or not 0 < len(made["columns"]) <= 256:
            raise ConfigError("INVALID_MAPPING")
        rows = [_known(c, {"source_header", "target_field", "required", "transforms"}) for c in made["columns"]]
        sources, targets = _texts([c.get("source_header") for c in rows], 256), [c.get("target_field") for c in rows]
        if any(t not in TARGETS for t in targets) or any(not isinstance(c.get("required", False), bool) or set(_texts(c.get("transforms", []), 8)) - set(TRANSFORMS) for c in rows):
            raise ConfigError("INVALID_MAPPING")
        if len({header_key(s) for s in sources}) < len(sources):
            raise ConfigError("DUPLICATE_SOURCE_MAPPING")
        if len(set(targets)) < len(targets):
            raise ConfigError("DUPLICATE_TARGET_FIELD")
        if "full_name" not in targets and not {"first_name", "last_name"} <= set(targets):
            raise ConfigError("PERSON_NAME_MAPPING_REQUIRED")
        must = [bool(c.get("required", False)) for c in rows]
        if "header" in made:
            head = _known(made["header"], {"mode", "required_source_headers", "max_preamble_lines"})
            mode, skip, wanted = head.get("mode"), head.get("max_preamble_lines"), _texts(head.get("required_source_headers", sources), 256)
        else:
            mode, skip, wanted = made.get("header_mode", "first_record"), made.get("max_preamble_lines", 0), [s for s, m in zip(sources, must, strict=True) if m]
        delimiter = made.get("delimiter", ",")
        if delimiter not in (",", ";", "\t", "|") or mode not in MODES or not isinstance(skip, int) or isinstance(skip, bool) or not 0 <= skip <= 100:
            raise ConfigError("INVALID_MAPPING")
        limits = dict(LIMITS)
        for k, v in (made.get("limits") or {}).items():
            k = _LIMIT_NAMES.get(k, k)
            if k not in LIMITS or not isinstance(v, int) or not 0 < v <= LIMITS[k]:
                raise ConfigError("INVALID_MAPPING")
            limits[k] = v
        return cls({header_key(s): t for s, t in zip(sources, targets, strict=True)}, tuple(map(header_key, wanted)), delimiter, mode, skip, limits, tuple(t for t, m in zip(targets, must, strict=True) if m))


class ScanError(ValueError):
    """A file that is not read at all; the message is the code."""


def _decode(raw: bytes) -> str:
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff") or raw[:4] == b"\x00\x00\xfe\xff":
        raise ScanError("UNSUPPORTED_BOM")
    if b"\x00" in raw:
        raise ScanError("NUL_BYTE_REJECTED")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise ScanError("INVALID_UTF8") from e


@lru_cache
def _whole_field(delimiter: str) -> re.Pattern:
    """A field and what ends it, where quotes stand as they should."""
    return re.compile(rf"""\r*(?:"([^"]*(?:""[^"]*)*)"\r*|([^"{re.escape(delimiter)}]*))(?:{re.escape(delimiter)}|\Z)""")


def _well_formed(text: str, delimiter: str) -> list[str] | None:
    """The fields of a record, or None if it is not plainly in order."""
    if '"' not in text:
        return text.replace("\r", "").split(delimiter)
    made, at, pattern = [], 0, _whole_field(delimiter)
    while True:
        m = pattern.match(text, at)
        if m is None:
            return None
        made.append(m[2].replace("\r", "") if m[1] is None else m[1].replace('""', '"'))
        at = m.end()
        if not m[0].endswith(delimiter):
            return made if at == len(text) else None
        if at == len(text):
            return [*made, ""]


def fields(text: str, mapping: Mapping, ended: bool = True) -> list[str] | None:
    """The fields of one record, without the line break that ends it; ``ended`` tells whether there is one.

    None if there is no record: nothing but carriage returns before the end of the file.  Raises at the first mistake.
    """
    limits = mapping.limits
    made = _well_formed(text, mapping.delimiter)
    if made is not None and len(made) <= limits["columns"] and len(text) * 4 < min(limits["row_bytes"], limits["field_bytes"]):
        return made if ended or len(made) > 1 or made[0] or '"' in text else None
    # character by character, so that of several mistakes the first is told
    row, value, size, width_of_field = [], [], 0, 0
    quoted = closed = False
    for c in text + "\n" * ended:
        width = len(c.encode("utf-8", "replace"))
        size += width
        if size > limits["row_bytes"]:
            raise ScanError("ROW_TOO_LARGE")
        if quoted:
            if c == '"':
                quoted, closed = False, True
            else:
                value.append(c)
                width_of_field += width
        elif closed and c == '"':
            quoted, closed = True, False
            value.append(c)
            width_of_field += 1
        elif closed and c not in (mapping.delimiter, "\r", "\n"):
            raise ScanError("MALFORMED_QUOTING")
        elif c == '"':
            if value:
                raise ScanError("MALFORMED_QUOTING")
            quoted = True
        elif c in (mapping.delimiter, "\n"):
            if len(row) >= limits["columns"]:
                raise ScanError("TOO_MANY_COLUMNS")
            row.append("".join(value))
            value, width_of_field, closed = [], 0, False
        elif c != "\r":
            value.append(c)
            width_of_field += width
        if width_of_field > limits["field_bytes"]:
            raise ScanError("FIELD_TOO_LARGE")
    if quoted:
        raise ScanError("MALFORMED_QUOTING")
    if not ended:
        if not row and not value and not closed:
            return None
        if len(row) >= limits["columns"]:
            raise ScanError("TOO_MANY_COLUMNS")
        row.append("".join(value))
    return row


def records(text: str, mapping: Mapping):
    """The records of a text, each a list of fields; raises at the first bad one."""
    held, quotes = [], 0
    lines = text.split("\n")
    for n, line in enumerate(lines):
        held.append(line)
        quotes += line.count('"')
        last = n + 1 == len(lines)
        if quotes % 2 == 0 or last:
            made = fields("\n".join(held), mapping, not last)
            if made is not None:
                yield made
            held, quotes = [], 0


def _is_header(record: list[str], mapping: Mapping, skipped: int) -> bool:
    """Whether a record is the header; False if it is one more line of the preamble, an error if it may be neither."""
    keys = [header_key(x) for x in record]
    found = mapping.header == "first_record" or set(mapping.required) <= set(keys)
    if len(set(keys)) < len(keys) and (found or not set(keys).isdisjoint(mapping.required)):
        raise ScanError("HEADER_COLLISION")
    if not found:
        if skipped + 1 > mapping.max_preamble:
            raise ScanError("HEADER_NOT_FOUND")
        return False
    if not all(keys):
        raise ScanError("HEADER_COLLISION")
    if not set(mapping.required) <= set(keys):
        raise ScanError("REQUIRED_HEADER_MISSING")
    return True


def parse(raw: bytes, mapping: Mapping) -> tuple[list[str], int, list[list[str]]]:
    """(keys of the header, preamble records, data rows) of a file's bytes, in one go."""
    if len(raw) > mapping.limits["file_bytes"]:
        raise ScanError("FILE_TOO_LARGE")
    header, skipped, rows = None, 0, []
    for record in records(_decode(raw), mapping):
        if header is None:
            if _is_header(record, mapping, skipped):
                header = [header_key(x) for x in record]
            else:
                skipped += 1
            continue
        if len(record) != len(header):
            raise ScanError("COLUMN_COUNT_MISMATCH")
        if len(rows) >= mapping.limits["rows"]:
            raise ScanError("TOO_MANY_ROWS")
        rows.append(record)
    if header is None:
        raise ScanError("HEADER_NOT_FOUND")
    return header, skipped, rows


def guard(path: str, roots: list[str]) -> str:
    """The path if it is a regular file under one of the roots, reached without a link; else an error."""
    if "://" in path:
        raise ConfigError("URL_INPUT_REJECTED")
    if not os.path.isabs(path):
        raise ConfigError("ABSOLUTE_PATH_REQUIRED")
    whole = os.path.normpath(path)
    if not any(Path(whole).is_relative_to(os.path.realpath(r)) for r in roots):
        raise ConfigError("OUTSIDE_IMPORT_ROOT")
    if os.path.realpath(whole) != whole or not stat.S_ISREG(os.lstat(whole).st_mode):
        raise ConfigError("REGULAR_FILE_REQUIRED")
    return whole


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


_RUNNING = ("line", "earlier", "k_0", "k_1", "sofar_0", "sofar_1")


def _running(batches):
    """Lines with their number in their block, the quotes before them there, and, should the block begin outside (0) or
    inside (1) of quotes: how many records have begun, and how many bytes of the line's record stand before it.

    A block's lines come one after another, as they are read, so nothing is sorted and only numbers are held.
    """
    key, line, quotes, size, k, base = None, 0, 0, 0, [0, 0], [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = batch.column("file"), batch.column("block").to_numpy()
        new = np.flatnonzero((block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1
        q, z = batch.column("quotes").to_numpy().astype("int64"), batch.column("size").to_numpy() + 1
        out = {c: np.empty(n, "int64") for c in _RUNNING}
        for at, end in zip([0, *new], [*new, n], strict=True):
            if key != (file[at].as_py(), block[at]):
                key, line, quotes, size, k, base = (file[at].as_py(), block[at]), 0, 0, 0, [0, 0], [0, 0]
            part = slice(at, end)
            earlier, before = quotes + np.cumsum(q[part]) - q[part], size + np.cumsum(z[part]) - z[part]
            out["line"][part], out["earlier"][part] = np.arange(line + 1, line + 1 + end - at), earlier
            for p in (0, 1):
                begins = earlier % 2 == p
                since = np.maximum.accumulate(np.where(begins, before, base[p]))
                out[f"k_{p}"][part], out[f"sofar_{p}"][part] = k[p] + np.cumsum(begins), before - since
                k[p], base[p] = int(out[f"k_{p}"][end - 1]), int(since[-1])
            line, quotes, size = line + end - at, int(earlier[-1] + q[end - 1]), int(before[-1] + z[end - 1])
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out.values())], names=[*batch.schema.names, *out])


def _records_of(spark: SparkSession, paths, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """(file, record, text, ended) of all records, and (file, bom, nul, utf8) of all files that have lines."""
    most = mapping.limits["row_bytes"]
    lines = spark.read.option("lineSep", "\n").text(paths).where(F.col("_metadata.file_size") <= mapping.limits["file_bytes"])
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value"))
    lines = lines.withColumns({"quotes": F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit(""))), "size": F.octet_length("value").cast("long"), "value": F.col("value").cast("binary")})
    lines = lines.mapInArrow(_running, "file string, file_size long, block long, i long, value binary, quotes int, size long, " + ", ".join(f"{c} long" for c in _RUNNING))
    lines = staged(lines.withColumn("value", F.col("value").cast("string")), "lines")

    # what stands before a block: the parity of its quotes, and once that is known how many records began
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), *[F.max(c).alias(c) for c in ("k_0", "k_1")])
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(order), F.lit(0)) % 2 == 1)
    blocks = blocks.withColumn("records", F.coalesce(F.sum(F.when(F.col("inside"), F.col("k_1")).otherwise(F.col("k_0"))).over(order), F.lit(0)))
    blocks = staged(blocks.select("file", "block", "inside", "records"), "blocks")
    of = lambda c: F.when(F.col("inside"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0"))
    numbered = lines.join(blocks, ["file", "block"]).withColumns({"record": F.col("records") + of("k"), "sofar": of("sofar")})

    raw = F.col("value").cast("binary")
    first = (F.col("block") == 0) & (F.col("line") == 1)
    start = F.hex(F.substring(raw, 1, 4))
    told = lines.groupBy("file").agg(
        F.max(first & (start.startswith("FFFE") | start.startswith("FEFF") | (start == "0000FEFF"))).alias("bom"), F.max(F.instr("value", "\0") > 0).alias("nul"), F.min(F.is_valid_utf8("value")).alias("utf8"),
        # one more byte for each line break, but perhaps the last; the reader leaves out a mark of three bytes
        (F.first("file_size") - F.sum(F.col("size") + 1)).isin(-1, 2).alias("open"),
    )
    lengths = numbered.groupBy("file").agg(F.max("record").alias("last"))
    # of a record that is too large anyway no more is gathered than shows that
    pieces = numbered.where(F.col("sofar") <= most).withColumn("piece", F.substring(raw, 1, most + 1))
    whole = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "i", "piece"))).alias("pieces"))
    ended = ~(F.col("open") & (F.col("record") == F.col("last")))
    made = whole.join(told.select("file", "open"), "file").join(lengths, "file").select("file", "record", F.col("pieces.piece").alias("pieces"), ended.alias("ended"))
    return made, told.drop("open")


def _parsed(mapping: Mapping):
    def run(batches):
        for batch in batches:
            out = []
            for file, number, pieces, ended in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text = b"\n".join(pieces).decode("utf-8", "replace")
                try:
                    row, error = fields(text.removeprefix("\ufeff") if number == 1 else text, mapping, ended), None
                except ScanError as e:
                    row, error = None, str(e)
                if row is not None or error is not None:
                    out.append((file, number, row, error))
            yield _batch(out, ["file", "record", "row", "error"], [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()])

    return run


def _headers(mapping: Mapping):
    def run(batches):
        for batch in batches:
            out = []
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = (file, None, None, None, None)
                for skipped, r in enumerate(first):
                    try:
                        if r["error"] is not None:
                            raise ScanError(r["error"])
                        if _is_header(r["row"], mapping, skipped):
                            made = (file, r["row"], r["record"], skipped, None)
                            break
                    except ScanError as e:
                        made = (file, None, None, None, str(e))
                        break
                out.append(made)
            yield _batch(out, ["file", "header", "header_record", "preamble", "header_error"], [pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.string()])

    return run


def _mapped(mapping: Mapping):
    """Rows and their headers to fields by target, and the digest of the row as it stood."""

    def run(batches):
        for batch in batches:
            out = []
            for file, number, row, header in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                at = [(i, mapping.columns[header_key(h)]) for i, h in enumerate(header) if header_key(h) in mapping.columns]
                out.append((file, number, [(t, row[i]) for i, t in at], sha256_hex(canonical_json(dict(zip(header, row, strict=True))))))
            yield _batch(out, ["file", "row_number", "fields", "row_digest"], [pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()])

    return run


def scan(spark: SparkSession, paths: str | list[str], mapping: Mapping, roots: list[str] | None = None) -> DataFrame:
    """(path, raw_sha256, byte_count, preamble_lines, row_number, fields: map of target to text, row_digest, error).

    A file that fails is one row with its ``error`` code and no fields; nothing of it is read.  With ``roots``, paths
    must be plain files under one of them (:func:`guard`); without, they are what the caller's file system has.  Names
    that Spark's reader would decompress are refused.
    """
    if roots is not None:
        paths = [guard(p, roots) for p in ([paths] if isinstance(paths, str) else paths)]
    listed = spark.read.format("binaryFile").load(paths)
    fit = F.col("length") <= mapping.limits["file_bytes"]
    files = listed.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("byte_count"), F.lower("path").rlike(r"\.(gz|bz2|deflate|lz4|snappy|zst|gzip)$").alias("packed"))
    digests = listed.where(fit).select(F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("raw_sha256"))
    raw, told = _records_of(spark, paths, mapping)
    parsed = staged(raw.mapInArrow(_parsed(mapping), "file string, record long, row array<string>, error string"), "records")
    first = parsed.where(F.col("record") <= mapping.max_preamble + 1).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("record", "row", "error"))).alias("first"))
    headers = staged(first.mapInArrow(_headers(mapping), "file string, header array<string>, header_record long, preamble int, header_error string"), "headers")
    rows = parsed.join(headers.where("header is not null"), "file").where(F.col("record") > F.col("header_record")).withColumn("row_number", (F.col("record") - F.col("header_record")).cast("int"))
    wrong = F.coalesce("error", F.when(F.size("row") != F.size("header"), "COLUMN_COUNT_MISMATCH"), F.when(F.col("row_number") > mapping.limits["rows"], "TOO_MANY_ROWS"))
    mistakes = rows.withColumn("wrong", wrong).where("wrong is not null").groupBy("file").agg(F.min_by("wrong", "record").alias("wrong"))
    about = files.join(digests, "file", "left").join(told, "file", "left").join(headers.drop("header"), "file", "left").join(mistakes, "file", "left")
    code = (
        F.when(F.col("byte_count") > mapping.limits["file_bytes"], "FILE_TOO_LARGE").when(F.col("packed"), "COMPRESSED_INPUT_REJECTED").when(F.col("bom"), "UNSUPPORTED_BOM").when(F.col("nul"), "NUL_BYTE_REJECTED").when(~F.col("utf8"), "INVALID_UTF8")
        .otherwise(F.coalesce("header_error", F.when(F.col("header_record").isNull(), "HEADER_NOT_FOUND"), "wrong"))
    )
    about = staged(about.select("file", "path", "raw_sha256", "byte_count", F.col("preamble").alias("preamble_lines"), code.alias("error")), "files")
    good = rows.join(about.where("error is null").select("file"), "file", "left_semi").select("file", "row_number", "row", "header")
    mapped = good.mapInArrow(_mapped(mapping), "file string, row_number int, fields map<string,string>, row_digest string")
    names = ["path", "raw_sha256", "byte_count", "preamble_lines", "row_number", "fields", "row_digest", "error"]
    whole = mapped.join(about.where("error is null"), "file").select(*names)
    # a file without rows has a line too: it is whole, and its digest and size are known
    rest = about.join(rows.select("file").distinct(), "file", "left_anti").where("error is null").unionByName(about.where("error is not null"))
    bare = rest.select("path", "raw_sha256", "byte_count", F.coalesce("preamble_lines", F.lit(0)).alias("preamble_lines"), F.lit(None).cast("int").alias("row_number"), F.lit(None).cast("map<string,string>").alias("fields"), F.lit(None).cast("string").alias("row_digest"), "error")
    return whole.unionByName(bare)


def failures(rows: DataFrame) -> DataFrame:
    """(path, error) of the files that were refused."""
    return rows.where(F.col("error").isNotNull()).select("path", "error")


def as_rows(scanned: DataFrame, *also: str) -> DataFrame:
    """The rows of a scan with a column for each target field, as an import takes them; with the columns ``also``."""
    rows = scanned.where("row_number is not null")
    return rows.select(*also, "row_number", "row_digest", *[F.col("fields")[t].alias(t) for t in TARGETS])
