"""Recruiter CSV files: headers through a synonym table, one record of each file (all with ``all_rows``).

With all rows, files are read as lines by Spark's own splits, so a large file is many tasks. Whether a line break stands in quotes depends on all that
is before it; so each split first tells in which state it ends for either state it may begin in, these maps compose from split to split, and
then each split cuts its own records. Only the record over the end of a split is put together from pieces."""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, normalize_whitespace, split_multivalue, stable_id, strip
from ..functions.values import normalize_email, normalize_phone, normalize_url, parse_date
from ..plans.tables import Tables, few
from .base import no_ids, null, email_items, fragments_of, phone_items, piece, record, register, skill_items
from .ordered import numbered

#: The headers that each field is found under.
HEADERS = {
    "full_name": ("full_name", "candidate_name", "name"), "emails": ("email", "emails", "mail"), "phones": ("phone", "mobile", "phone_number"), "company": ("company", "current_company", "employer"),
    "title": ("title", "designation", "position"), "headline": ("headline", "summary", "headline_text"), "skills": ("skills", "skill_list"), "education": ("education",), "linkedin": ("linkedin",), "github": ("github",),
    "website": ("website", "web", "url"), "portfolio": ("portfolio",), "country": ("country",), "city": ("city",), "state": ("state", "region"), "projects": ("projects",), "certifications": ("certifications", "certification"),
    "languages": ("languages", "language"), "recruiter_notes": ("recruiter_notes", "notes"), "start_date": ("start_date", "employment_start", "start"), "end_date": ("end_date", "employment_end", "end"),
    "institution": ("institution", "school", "college", "university"), "degree": ("degree",), "field": ("field", "specialization", "major"), "grade": ("grade", "cgpa", "percentage"),
}
SOURCE, QUALITY = "recruiter_csv", 0.92


BACK = {header: field for field, headers in HEADERS.items() for header in headers}
ROWS = "_file string, _row bigint, raw string, have map<string,string>"


#: Splits and files whose figures are broadcast; beyond, they are joined by shuffle.
FEW = 100_000
FIELD_END = re.compile(rb"[,\r]")
LINES = "_file string, _start bigint, _size bigint, _whole boolean, line binary"
SPLIT = "_file string, _start bigint, out boolean, inside boolean, n_out bigint, n_inside bigint, latin boolean"
PIECE = "_file string, _start bigint, _row bigint, _sub int, whole boolean, piece binary, cells array<string>"


def cells_of(text: str) -> Iterator[list[str]]:
    """Rows of a text, fields of any length."""
    csv.field_size_limit(sys.maxsize)
    return csv.reader(io.StringIO(text, newline=""))


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after a line that begins at the start of a record, or (``inside``) in a quoted field."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            inside, at = False, at + 1  # what follows up to the field's end is plain
        elif line[at : at + 1] == b'"':
            inside, at = True, at + 1
            continue
        if not (end := FIELD_END.search(line, at)):
            return False
        at = end.end()


def rows_of(content: bytes, all_rows: bool) -> Iterator[tuple[int, str, dict | None]]:
    """(row, raw, field -> text) of a file with its own header; of several headers of a field the last counts. A file without rows gives one without fields."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    reader = cells_of(text)
    fields = [BACK.get(h.strip().lower()) for h in next(reader, [])]
    n = 0
    for row in reader:
        if not row:
            continue
        have = {f: v for f, v in zip(fields, row, strict=False) if f}
        yield n, (json.dumps(row, ensure_ascii=False) if all_rows else text), have
        n += 1
        if not all_rows:
            return
    if n == 0:
        yield 0, text, None


def rows(files: DataFrame, all_rows: bool) -> DataFrame:
    """ROWS of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = rows_of(content.as_py() or b"", all_rows)
                while held := list(itertools.islice(found, 1000)):
                    have = [None if h is None else list(h.items()) for *_, h in held]
                    columns = [pa.array([path] * len(held)), pa.array([n for n, *_ in held], pa.int64()), pa.array([raw for _, raw, _ in held]), pa.array(have, pa.map_(pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["_file", "_row", "raw", "have"])

    return files.select("path", "content").mapInArrow(run, ROWS)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """LINES of the files at path, in order within each split; ``_whole`` if the file is one split."""
    m = lambda c: F.col(f"_metadata.{c}")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(m("file_path").alias("_file"), m("file_block_start").alias("_start"), m("file_size").alias("_size"), (m("file_block_length") >= m("file_size")).alias("_whole"), F.col("value").cast("binary").alias("line"))


def by_split(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """((file, start, more columns), lines) of each split of a task, as its rows come by."""
    names = ("_file", "_start", *more)
    rows = ((tuple(k), line) for b in batches for *k, line in zip(*(b.column(c).to_pylist() for c in names), b.column("line").to_pylist(), strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield key, (line for _, line in group)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def split_maps(lines: DataFrame) -> DataFrame:
    """SPLIT of each split: the state that it leads to and the records that begin in it, for either state at its start; whether it is no UTF-8."""
    schema = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("out", pa.bool_()), ("inside", pa.bool_()), ("n_out", pa.int64()), ("n_inside", pa.int64()), ("latin", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), held in by_split(batches):
            states, begun, latin = [False, True], [0, 0], False
            for line in held:
                for i, inside in enumerate(states):
                    begun[i] += not inside
                    states[i] = inside_after(line, inside)
                if not latin and not line.isascii():
                    try:
                        line.decode("utf-8")
                    except UnicodeDecodeError:
                        latin = True
            yield batch([(file, start, *states, *begun, latin)], schema)

    return lines.select("_file", "_start", "line").mapInArrow(run, SPLIT)


def entries(maps: DataFrame) -> DataFrame:
    """_file, _start, entry (whether the split begins in quotes), first (number of the first record that begins in it), latin: the maps
    composed from split to split of a file, which are few rows."""
    state = lambda inside, n: F.struct(inside.alias("inside"), n.cast("long").alias("n"))
    step = lambda acc, s: F.array_append(acc, F.when(F.element_at(acc, -1)["inside"], state(s["inside"], F.element_at(acc, -1)["n"] + s["n_inside"])).otherwise(state(s["out"], F.element_at(acc, -1)["n"] + s["n_out"])))
    files = maps.groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("_start", "out", "inside", "n_out", "n_inside"))).alias("splits"), F.max("latin").alias("latin"))
    files = files.withColumn("states", F.aggregate("splits", F.array(state(F.lit(False), F.lit(0))), step))
    each = files.select("_file", "latin", F.posexplode(F.transform("splits", lambda s: s["_start"])).alias("i", "_start"), "states")
    return each.select("_file", "_start", F.get("states", F.col("i"))["inside"].alias("entry"), F.get("states", F.col("i"))["n"].alias("first"), "latin")


def pieces(lines: DataFrame) -> DataFrame:
    """PIECE of lines with entry, first and latin, in order within their splits: whole records with their cells, and pieces of records that
    go on in another split (or begin the file: the record of the header)."""
    schema = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("_row", pa.int64()), ("_sub", pa.int32()), ("whole", pa.bool_()), ("piece", pa.binary()), ("cells", pa.list_(pa.string()))])

    def records(held: Iterator[bytes], entry: bool, first: int) -> Iterator[tuple[int, bool, bytes]]:
        """(record, whether it is whole, bytes)"""
        n, inside, now, began_here = first - 1, entry, [], not entry
        for line in held:
            if not inside:
                if now:
                    yield n, began_here, b"\n".join(now)
                n, now, began_here = n + 1, [], True
            now.append(line)
            inside = inside_after(line, inside)
        if now:
            yield n, began_here and not inside, b"\n".join(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (file, start, entry, first, latin), held in by_split(batches, "entry", "first", "latin"):
            for n, whole, data in records(held, entry, first):
                if whole and n > 0:
                    text = data.decode("latin-1" if latin else "utf-8")
                    out += [(file, start, n, i, True, None, cells) for i, cells in enumerate(cells_of(text)) if cells]
                else:
                    out.append((file, start, n, 0, False, data, None))
                if len(out) >= 1000:
                    yield batch(out, schema)
                    out.clear()
        yield batch(out, schema)

    return lines.select("_file", "_start", "entry", "first", "latin", "line").mapInArrow(run, PIECE)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def cells_in(data: pa.Array, latin: pa.Array) -> pa.Array:
    texts = (d.as_py().decode("latin-1" if x.as_py() else "utf-8-sig") for d, x in zip(data, latin, strict=True))
    return pa.array([[cells for cells in cells_of(t) if cells] for t in texts], pa.list_(pa.list_(pa.string())))


def split_rows(lines: DataFrame, tables: Tables) -> DataFrame | None:
    """ROWS of the files of several splits; None if there are none."""
    lines = lines.filter("not _whole")
    maps = tables.table(split_maps(lines), "maps")
    if maps.isEmpty():
        return None
    known = tables.table(entries(maps), "splits")
    if few(known, FEW):
        told = lines.join(F.broadcast(known), ["_file", "_start"])
    else:  # numbered first, since a shuffle loses the order within a split
        told = lines.withColumn("_at", F.monotonically_increasing_id()).join(known, ["_file", "_start"]).repartition("_file", "_start").sortWithinPartitions("_file", "_start", "_at")
    made = tables.table(pieces(told), "records")
    whole = made.filter("whole").select("_file", "_row", "_sub", "cells")
    # records over the end of a split: their pieces in order
    parts = made.filter("not whole").groupBy("_file", "_row").agg(F.array_sort(F.collect_list(F.struct("_start", F.hex("piece").alias("piece")))).alias("p"))
    joined = parts.select("_file", "_row", F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "0A")).alias("data")).join(known.select("_file", "latin").distinct(), "_file")
    joined = tables.table(joined.select("_file", "_row", F.posexplode(cells_in("data", "latin")).alias("_sub", "cells")), "joined")
    back = F.create_map(*(F.lit(x) for kv in BACK.items() for x in kv))
    heads = joined.filter("_row = 0 and _sub = 0").select("_file", F.transform("cells", lambda c: back[F.lower(strip(c))]).alias("fields"))
    rows = whole.unionByName(joined.filter("_row > 0 or _sub > 0")).join(F.broadcast(heads) if few(heads, FEW) else heads, "_file")
    pairs = F.filter(F.arrays_zip(F.slice("fields", 1, F.size("cells")).alias("f"), F.slice("cells", 1, F.size("fields")).alias("v")), lambda p: p["f"].isNotNull())
    # of several headers of a field the last counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size("fields")), lambda q: q["f"] == p["f"]))
    return rows.select("_file", "_row", "_sub", F.to_json("cells").alias("raw"), F.map_from_entries(last).alias("have"))


def all_rows_of(spark: SparkSession, path: str) -> DataFrame:
    """_file, _row, _sub, raw, have of all rows of the files at path. Spark's readers pass over files of no bytes, so those give no row."""
    lines = lines_of(spark, path)
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, _), held in by_split(batches):
            yield batch([(file, b"\n".join(held))], schema)

    small = rows(lines.filter("_whole").select("_file", "_start", "line").mapInArrow(files, "path string, content binary"), True).withColumn("_sub", F.lit(0))
    large = split_rows(lines, Tables(spark, "csv"))
    found = small.select("_file", "_row", "_sub", "raw", "have")
    return found if large is None else found.unionByName(large)


def shaped(have: Column) -> Column:
    """The parsed record of a row's texts by field; one without any has quality 0."""
    given = lambda f: blank_to_null(have[f])
    text = lambda f: blank_to_null(normalize_whitespace(have[f]))
    emails = F.filter(F.transform(split_multivalue(given("emails")), normalize_email), lambda e: e.isNotNull())
    phones = F.filter(F.transform(split_multivalue(given("phones")), normalize_phone), lambda p: p.isNotNull())
    headline = normalize_whitespace(F.coalesce(given("headline"), given("title"), given("recruiter_notes")))
    raw = blank_to_null(F.concat_ws(", ", text("city"), text("state"), text("country")))
    experience = F.struct(
        text("company").alias("company"), null().alias("company_canonical"), text("title").alias("title"), null().alias("title_canonical"), parse_date(given("start_date")).alias("start"),
        F.when(F.lower(given("end_date")) != "present", parse_date(given("end_date"))).alias("end"), text("recruiter_notes").alias("summary"), F.lit(None).alias("location"), F.lit(1.0).alias("confidence"), no_ids().alias("evidence_ids"),
    )
    degree = normalize_whitespace(F.coalesce(given("degree"), given("education")))
    education = F.struct(F.coalesce(text("institution"), F.lit("")).alias("institution"), F.coalesce(degree, F.lit("")).alias("degree"), null().alias("degree_canonical"), text("field").alias("field"), F.lit(None).cast("int").alias("start_year"), F.lit(None).cast("int").alias("end_year"), F.lit(1.0).alias("confidence"), no_ids().alias("evidence_ids"))
    told = [
        ("full_name", text("full_name")), ("headline", headline), ("company", text("company")), ("job_title", text("title")), ("degree", degree), ("country", text("country")), ("city", text("city")),
        ("recruiter_notes", text("recruiter_notes")), ("projects", text("projects")), ("certifications", text("certifications")), ("languages", text("languages")), ("skills", given("skills")),
    ]
    seen = F.filter(F.array(*(piece(f, v, "csv", "header") for f, v in told)), lambda e: e["original"].isNotNull())
    evidence = F.concat(seen, F.transform(emails, lambda e: piece("emails", e, "csv", "header")), F.transform(phones, lambda p: piece("phones", p, "csv", "header")))
    return record(
        external_id=stable_id(text("full_name"), F.get(emails, 0), F.col("record_id")), source=F.lit(SOURCE), record_id=F.col("record_id"), source_file=F.lit(SOURCE), quality=F.when(have.isNull(), 0.0).otherwise(QUALITY), full_name=text("full_name"), headline=headline,
        location=F.struct(raw.alias("raw"), text("city").alias("city"), text("state").alias("region"), text("country").alias("country"), null().alias("country_code")),
        links=F.struct(normalize_url(given("linkedin")).alias("linkedin"), normalize_url(given("github")).alias("github"), normalize_url(F.coalesce(given("portfolio"), given("website"))).alias("portfolio"), no_ids().alias("other")),
        emails=email_items(emails), phones=phone_items(phones), skills=skill_items(split_multivalue(given("skills")), SOURCE), evidence=evidence,
        experience=F.when(text("company").isNotNull() & text("title").isNotNull(), F.array(experience)).otherwise(F.array()),
        education=F.when(text("institution").isNotNull() | degree.isNotNull() | text("field").isNotNull(), F.array(education)).otherwise(F.array()),
    )


@register(SOURCE)
def read_csv(spark: SparkSession, path: str, all_rows: bool = False, first_ord: int = 0) -> DataFrame:
    """Fragments of the CSV files at ``path``, in order of file name and row; each file has its own header, in UTF-8 or else Latin-1."""
    found = all_rows_of(spark, path) if all_rows else rows(spark.read.format("binaryFile").load(path), False).withColumn("_sub", F.lit(0))
    found = found.withColumn("record_id", F.substring(F.sha2("raw", 256), 1, 12))
    return fragments_of(numbered(found, "_file", "_row", "_sub", first=first_ord).withColumn("parsed", shaped(F.col("have"))))
