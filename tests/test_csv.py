"""CSV files over many splits against one pass; long fields, odd files."""

import csv
import io
import random

import pytest

from entityfusion.sources import recruiter_csv

ODD = ["x", "a,b", 'say "hi"', "two\nlines", "win\r\nlines", "", '"', ',"\n,"', "é日本", " 5\" disk", "a\n\n\nb"]


def one_pass(data: bytes):
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    head, *rest = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    fields = [recruiter_csv.BACK.get(h.strip().lower()) for h in head]
    return [{f: v for f, v in zip(fields, row, strict=False) if f} for row in rest]


def written(rng, n, encoding="utf-8"):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    w.writerow(["name", "email", "notes\n", "city", "candidate_name", "odd"])
    for i in range(n):
        row = [f"N{i}", *(rng.choice(ODD) for _ in range(5))]
        w.writerow(row[: rng.choice([6, 6, 6, 3])])
        if rng.random() < 0.1:
            out.write('plain 5" x,a "b" c,"q" tail "z,\n')  # quotes that quote nothing
        if rng.random() < 0.1:
            out.write("\n")
    return out.getvalue().encode(encoding, "replace")


def test_inside_after():
    rng = random.Random(3)
    for _ in range(4000):
        line = "".join(rng.choice('",ax\r') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line + "\n"
            whole = list(csv.reader(io.StringIO(text + 'END"\n', newline="")))
            alone = list(csv.reader(io.StringIO(text, newline="")))
            # the next line is a row of its own unless a quoted field is open
            assert recruiter_csv.inside_after(line.encode(), inside) == (len(whole) == len(alone) and "END" in str(whole[-1:])), (line, inside)


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-8-sig"])
def test_many_splits_are_one_pass(spark, tmp_path, encoding, monkeypatch):
    rng = random.Random(len(encoding))
    files = {f"{c}.csv": written(rng, n, encoding) for c, n in (("a", 90), ("b", 2), ("c", 30))} | {"d.csv": b"name\n", "e.csv": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = [h for name in sorted(files) if name < "d.csv" for h in one_pass(files[name])]
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, few in {"utf-8": (("300", 100_000),), "latin-1": (("900", 0),), "utf-8-sig": (("900", 100_000), (default, 100_000))}[encoding]:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            monkeypatch.setattr(recruiter_csv, "FEW", few)
            rows = recruiter_csv.all_rows_of(spark, str(tmp_path)).orderBy("_file", "_row", "_sub").collect()
            assert [r["have"] for r in rows if r["have"] is not None] == want, (size, few)
            assert sum(r["have"] is None for r in rows) == 1  # the file with a header only
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)


def test_long_fields(spark, tmp_path):
    note = "so it goes " * 100_000
    (tmp_path / "a.csv").write_text(f'name,notes\nAda Quill,"{note}"\nBen Moss,short\n')
    for whole in (False, True):
        got = recruiter_csv.read_csv(spark, str(tmp_path), all_rows=whole).orderBy("frag_ord").collect()
        assert [r["full_name"] for r in got] == ["Ada Quill", "Ben Moss"][: 1 + whole] and got[0]["headline"] == note.strip()
