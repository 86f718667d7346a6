"""System files written here and read back, workbooks read by a plain zip and XML reader."""

import datetime
import random
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from tidewheel.sources import sav, xlsx

SYSMIS = -1.7976931348623157e308
NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def seconds(moment):
    return (moment - datetime.datetime(1582, 10, 14)).total_seconds()


#: (short name, long name, width, print format, label, missing values, value labels)
VARIABLES = [
    ("ID", "patient_id", 0, 5, "Number of the patient", (), {}),
    ("SEX", "sex", 0, 5, None, (9.0,), {1.0: "male", 2.0: "female"}),
    ("AGE", "age", 0, 5, "Age, years", ("range", 200.0, 999.0), {}),
    ("NAME", "full_name", 13, 1, "Näme", (), {}),
    ("KIND", "kind", 2, 1, None, (), {"a": "first", "b": "second"}),
    ("BORN", "born", 0, 20, None, (), {}),
    ("SEEN", "seen", 0, 22, None, (), {}),
    ("LONG", "long_text", 300, 1, None, (), {}),
]


def cases(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((float(i), rng.choice([1.0, 2.0, 9.0, None]), rng.choice([30.0, 55.5, -3.25, 250.0, 100.0]), rng.choice(["", "Ann", "Ünal Åse", "exactly 13 ch"]), rng.choice(["a", "b", ""]), datetime.datetime(1990, 1, 1) + datetime.timedelta(days=rng.randint(0, 9999)), rng.choice([None, datetime.datetime(2020, 5, 6, 7, 8, 9)]), rng.choice(["", "x" * 300, "some words " * 20])))
    return out


def write_sav(path, rows, compression, order="<"):
    """A system file of VARIABLES, by the published layout."""
    pack = lambda kind, *v: struct.pack(order + kind, *v)
    pad = lambda b, n: b.ljust(n)[:n]
    segments = [(255, 255), (48, 48)]
    head, index, elements = b"", {}, 0
    for short, _, width, form, label, missing, _ in VARIABLES:
        pieces = [(short, 255), ("LONG1", 48)] if width > 255 else [(short, width)]
        for k, (name, size) in enumerate(pieces):
            index.setdefault(short, elements + 1)
            m = b"".join(pack("d", x) for x in missing if x != "range")
            count = -2 if missing[:1] == ("range",) else len(missing)
            head += pack("i", 2) + pack("5i", size, int(bool(label) and not k), count, form << 16, form << 16) + pad(name.encode(), 8)
            if label and not k:
                text = label.encode()
                head += pack("i", len(text)) + text.ljust((len(text) + 3) // 4 * 4)
            head += m
            for _ in range((size + 7) // 8 - 1 if size else 0):
                head += pack("i", 2) + pack("5i", -1, 0, 0, 0, 0) + b" " * 8
            elements += max(1, (size + 7) // 8)
    for short, _, width, _, _, _, labels in VARIABLES:
        if labels:
            head += pack("2i", 3, len(labels))
            for value, text in labels.items():
                head += (pad(value.encode(), 8) if width else pack("d", value)) + bytes([len(text)]) + text.encode().ljust((len(text) + 8) // 8 * 8 - 1)
            head += pack("3i", 4, 1, index[short])
    head += pack("2i", 6, 1) + b" " * 80
    extra = [(4, 8, pack("3d", SYSMIS, -SYSMIS, -SYSMIS)), (13, 1, "\t".join(f"{s}={n}" for s, n, *_ in VARIABLES).encode()), (14, 1, b"LONG=00300\0\t"), (20, 1, b"UTF-8")]
    for sub, size, data in extra:
        head += pack("4i", 7, sub, size, len(data) // size) + data
    head += pack("2i", 999, 0)
    first = (b"$FL3" if compression == 2 else b"$FL2") + b"@(#) TEST".ljust(60) + pack("5i", 2, elements, compression, 0, len(rows)) + pack("d", 100.0) + b"01 Jan 24" + b"00:00:00" + b" " * 64 + b"\0" * 3
    items = []
    for row in rows:
        for (_, _, width, form, *_), v in zip(VARIABLES, row, strict=True):
            if not width:
                items.append(SYSMIS if v is None else seconds(v) if form in (20, 22) else v)
                continue
            text = v.encode()
            parts = [(text[:255], 256), (text[255:], 48)] if width > 255 else [(text, (width + 7) // 8 * 8)]
            for part, size in parts:
                b = part.ljust(size)
                items += [b[k : k + 8] for k in range(0, size, 8)]
    assert segments
    if compression == 0:
        body = b"".join(x if isinstance(x, bytes) else pack("d", x) for x in items)
    else:
        body, codes, raw = b"", [], b""
        for x in [*items, None]:
            if x is None:
                codes.append(252)
            elif isinstance(x, bytes):
                codes.append(254 if x == b" " * 8 else 253)
                raw += x if x != b" " * 8 else b""
            elif x == SYSMIS:
                codes.append(255)
            elif x == int(x) and 1 <= x + 100 <= 251:
                codes.append(int(x) + 100)
            else:
                codes.append(253)
                raw += pack("d", x)
            if len(codes) == 8 or x is None:
                body += bytes(codes).ljust(8, b"\0") + raw
                codes, raw = [], b""
        if compression == 2:
            at = len(first) + len(head)
            blocks = [zlib.compress(body[k : k + 1000]) for k in range(0, len(body), 1000)]
            data = b"".join(blocks)
            body = pack("3q", at, at + 24 + len(data), 24 + 24 * len(blocks)) + data + b"\0" * (24 + 24 * len(blocks))
    with open(path, "wb") as f:
        f.write(first + head + body)


def expected(rows):
    out = []
    for i, sex, age, name, kind, born, seen, long in rows:
        out.append((i, None if sex == 9.0 else sex, None if 200 <= age <= 999 else age, name.encode()[:13].decode("utf-8", "replace").rstrip(" "), kind, born.date(), seen, long.rstrip(" ")))
    return out


@pytest.mark.parametrize("compression", [0, 1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_system_file_round_trip(spark, tmp_path, monkeypatch, compression, order):
    rows = cases(60)
    write_sav(tmp_path / "a.sav", rows, compression, order)
    monkeypatch.setattr(sav, "CASES", 7)
    ranges = list(sav._ranges(str(tmp_path / "a.sav")))
    assert len(ranges) == (1 if compression == 2 else 9)
    df = sav.read_sav(spark, str(tmp_path / "a.sav"))
    assert df.columns == [v[1] for v in VARIABLES]
    assert sorted(map(tuple, df.collect())) == sorted(expected(rows), key=lambda r: r[0])
    # Every range read on its own, as tasks do.
    reader = sav.SavReader(str(tmp_path / "a.sav"), df.schema)
    parts = [[tuple(r.values()) for b in reader.read(p) for r in b.to_pylist()] for p in ranges]
    assert [r for p in parts for r in p] == expected(rows)
    if compression < 2:
        assert [len(p) for p in parts] == [7] * 8 + [4]


def test_labels_are_metadata(spark, tmp_path):
    write_sav(tmp_path / "a.sav", cases(3), 1)
    fields = {f.name: f.metadata for f in sav.read_sav(spark, str(tmp_path / "a.sav")).schema.fields}
    assert fields["age"]["comment"] == "Age, years" and fields["full_name"]["comment"] == "Näme"
    assert fields["sex"]["labels"] == {"1": "male", "2": "female"} and fields["kind"]["labels"] == {"a": "first", "b": "second"}
    assert fields["born"] == {}


def test_a_folder_of_system_files(spark, tmp_path):
    for i in range(3):
        write_sav(tmp_path / f"{i}.sav", cases(4, i), i)
    (tmp_path / "other.txt").write_text("not one of them")
    assert sav.read_sav(spark, str(tmp_path)).count() == 12
    write_sav(tmp_path / "empty.sav", [], 1)
    assert sav.read_sav(spark, str(tmp_path / "empty.sav")).collect() == []
    with pytest.raises(FileNotFoundError):
        sav.described(str(tmp_path / "none.sav"))
    (tmp_path / "bad.sav").write_bytes(b"x" * 300)
    with pytest.raises(ValueError, match="not a system file"):
        sav.described(str(tmp_path / "bad.sav"))


def read_xlsx(path):
    """{sheet: rows of values}, without a library for workbooks."""
    out = {}
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", NS):
            rows = []
            for row in ElementTree.fromstring(z.read("xl/" + targets[s.get(f"{{{NS['r']}}}id")])).iter(f"{{{NS['m']}}}row"):
                values = []
                for c in row:
                    v, text = c.find("m:v", NS), c.find("m:is/m:t", NS)
                    if text is not None:
                        values.append(text.text or "")
                    elif v is None:
                        values.append(None)
                    elif c.get("t") == "b":
                        values.append(v.text == "1")
                    elif c.get("s"):
                        values.append(datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(v.text)))
                    else:
                        values.append(float(v.text))
                rows.append(values)
            out[s.get("name")] = rows
    return out


def test_ten_sheets(spark, tmp_path):
    tables = {f"Table {i}: a/b": spark.range(i * 37).selectExpr("id", "concat('row <', id, '> & ', char(10), 'é') AS text", "id % 2 = 0 AS even", "IF(id % 3 = 0, NULL, id / 7) AS part", "DATE '2024-02-29' AS day", "TIMESTAMP_NTZ '2024-02-29 06:00:00' AS at").repartition(4).orderBy("id") for i in range(10)}
    path = str(tmp_path / "book.xlsx")
    xlsx.write_xlsx(tables, path)
    got = read_xlsx(path)
    assert list(got) == [f"Table {i}_ a_b" for i in range(10)]
    for i, rows in enumerate(got.values()):
        assert rows[0] == ["id", "text", "even", "part", "day", "at"] and len(rows) == i * 37 + 1
        for k, row in enumerate(rows[1:]):
            assert row == [float(k), f"row <{k}> & \né", k % 2 == 0, None if k % 3 == 0 else pytest.approx(k / 7), datetime.datetime(2024, 2, 29), datetime.datetime(2024, 2, 29, 6)]
    assert [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]
    xlsx.write_xlsx({"only": spark.range(2)}, path)
    assert read_xlsx(path) == {"only": [["id"], [0.0], [1.0]]}


def test_names_and_limits(spark, tmp_path, monkeypatch):
    assert xlsx.sheet_names(["a", "A", "", "x" * 40, "x" * 40, "[b]"]) == ["a", "A 2", "Sheet", "x" * 31, "x" * 29 + " 2", "_b_"]
    assert xlsx.cell("a\x00b") == '<c t="inlineStr"><is><t xml:space="preserve">a_x0000_b</t></is></c>' and xlsx.cell(float("nan")) == "<c/>"
    with pytest.raises(ValueError, match="characters"):
        xlsx.cell("x" * 40000)
    with pytest.raises(ValueError, match="one sheet"):
        xlsx.write_xlsx({}, str(tmp_path / "x.xlsx"))
    import decimal

    assert xlsx.cell(decimal.Decimal("1.50")) == "<c><v>1.50</v></c>" and xlsx.cell(True) == '<c t="b"><v>1</v></c>'
