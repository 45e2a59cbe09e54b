"""Byte ranges of text files give the lines that the file as a whole gives, wherever they are cut."""

import random
import re

import pytest
from pyspark.errors import PySparkException

from veilframe.functions.encoding import LINE, detect
from veilframe.functions.rules import DEFAULT_RULES
from veilframe.operators.audit import audit, unit_hits
from veilframe.operators.sanitize import mask_plain
from veilframe.sources import text_ranges
from veilframe.sources.text_ranges import Reader, line_units, scan_lines


def whole(content):
    codec, mark = detect(content)
    return re.findall(LINE, content[len(mark) :].decode(codec))


def by_ranges(path, size):
    reader = Reader({"path": str(path), "rangebytes": str(size)})
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    counts = Reader({"path": str(path), "rangebytes": str(size), "counting": "true"})
    return parts, rows, [r["lines"] for p in parts for b in counts.read(p) for r in b.to_pylist()]


def contents():
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "é", "\r", "\n", "\r\n", "x" * 30, " ", " ", "\x0b", "日", "𝄞", "ഊ", "਍"]) for _ in range(400))
    plain = re.sub("[^\x00-\xff]", "", text)
    yield "utf-8", ("words to begin with " + text).encode()
    yield "utf-8-mark", b"\xef\xbb\xbf" + text.encode()
    yield "utf-16-le", b"\xff\xfe" + text.encode("utf-16-le")
    yield "utf-16-be", b"\xfe\xff" + text.encode("utf-16-be")
    yield "utf-16 without mark", ("only letters here\r\n" * 40 + "end").encode("utf-16-le")
    yield "cp1252", ("caf\xe9 " + plain.replace("\x0b", "") + "words " * 99).encode("cp1252")
    yield "only ends", b"\r\r\n\n\r"
    yield "no end", b"one line"
    yield "ends in return", b"line\r"


@pytest.mark.parametrize("kind,content", list(contents()))
@pytest.mark.parametrize("block", [2, 7, 1 << 20])
def test_cut_anywhere(tmp_path, monkeypatch, kind, content, block):
    monkeypatch.setattr(text_ranges, "BLOCK", block * 2)
    monkeypatch.setattr(text_ranges, "BATCH_LINES", 3)
    (tmp_path / "a.txt").write_bytes(content)
    for size in (2, 3, 5, 8, 64, 1000, 1 << 20):
        parts, rows, counts = by_ranges(tmp_path / "a.txt", size)
        assert [r["line"] for r in rows] == whole(content) and not any(r["error"] for r in rows), (kind, size)
        assert sum(counts) == len(rows) and len(parts) >= len(content) // (size + 2)
        assert all([r["place"] for r in rows if r["range"] == p.number] == list(range(counts[p.number])) for p in parts)


def test_files_and_errors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.log").write_bytes(b"TESTSECRET\r\nlast")
    (tmp_path / "a.txt").write_bytes(b"x" * 70_000 + b"\n\xff\xfe")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(bytes(range(256)))
    (tmp_path / "_hidden").write_bytes(b"x")
    rows = {(r["file"], r["line_no"]): (r["line"], r["error"]) for r in scan_lines(spark, str(tmp_path), 1000).collect()}
    assert rows.pop(("sub/b.log", 1)) == ("TESTSECRET\r\n", None) and rows.pop(("sub/b.log", 2)) == ("last", None)
    assert rows.pop(("a.txt", 1)) == ("x" * 70_000 + "\n", None)
    assert rows == {("a.txt", None): (None, "not utf-8 throughout: a.txt"), ("c.bin", None): (None, "Unsupported text encoding or binary content: c.bin")}
    with pytest.raises(PySparkException, match="not utf-8 throughout|Unsupported text"):
        line_units(scan_lines(spark, str(tmp_path), 1000)).collect()
    assert scan_lines(spark, str(tmp_path / "empty.txt")).count() == 0
    assert scan_lines(spark, f"file://{tmp_path}/sub").count() == 2


def test_audit_of_ranges_is_that_of_whole_files(spark, tmp_path):
    rng = random.Random(3)
    want = set()
    for k in range(4):
        content = "".join(rng.choice(["10.20.30.40", " andy ", "é", "\n", "\r\n", "words ", "2023"]) for _ in range(3000)).encode(["utf-8", "utf-16-le"][k % 2])
        content = (b"\xff\xfe" if k % 2 else b"") + content
        (tmp_path / f"{k}.txt").write_bytes(content)
        hits = mask_plain(content, DEFAULT_RULES, f"{k}.txt")[1]
        for kind in {h[1] for h in hits}:
            own = [h for h in hits if h[1] == kind]
            first = next((h for h in own if not h[4]), own[0])
            want.add((f"{k}.txt", kind, sum(h[2] for h in own), first[3]))
    got = audit(unit_hits(line_units(scan_lines(spark, str(tmp_path), 2048)), DEFAULT_RULES)).collect()
    assert {(r["file"], r["match_type"], r["occurrences"], r["location"]) for r in got} == want


def test_a_sample_that_cuts_a_character(spark, tmp_path):
    from veilframe.functions.encoding import SAMPLE, whole_characters

    content = b"a" * (SAMPLE - 1) + "é\n\u0081 end".encode()
    (tmp_path / "a.txt").write_bytes(content)
    assert detect(content) == ("cp1252", b"") and detect(content, True) == ("utf-8", b"")
    assert any(r["error"] for r in scan_lines(spark, str(tmp_path)).collect())
    assert [r["line"] for r in scan_lines(spark, str(tmp_path), whole_characters=True).orderBy("line_no").collect()] == content.decode().splitlines(keepends=True)[:1] + ["\u0081 end"]
    for text in ("aé", "a日", "a𝄞", "a"):
        raw = text.encode()
        assert whole_characters(raw) == raw and all(whole_characters(raw[: 1 + k]) == b"a" for k in range(1, len(raw) - 1))
