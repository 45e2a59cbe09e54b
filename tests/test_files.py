import io
import random
import stat
import tarfile
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilframe.functions import paths, scalars
from veilframe.functions.encoding import detect, printable_share, with_lines
from veilframe.functions.rules import DEFAULT_RULES
from veilframe.operators import jobs
from veilframe.operators.audit import audit, report
from veilframe.operators.sanitize import checked, hit_rows, mask_archive, mask_file, mask_upload, sanitized
from veilframe.plans.job import main, run_job
from veilframe.sources.archives import Limits, pack, unpack
from veilframe.sources.office import WORD, mask_docx, mask_xlsx, part_label, write_xlsx
from veilframe.sources.samples import docx

SECRET = ["TESTSECRET"]


@pytest.mark.parametrize("mark, codec, end", [(b"\xff\xfe", "utf-16-le", "\r\n"), (b"\xfe\xff", "utf-16-be", "\n"), (b"\xef\xbb\xbf", "utf-8", "\r\n")])
def test_encodings_with_mark(mark, codec, end):
    text = f"User=TESTSECRET{end}next{end}"
    out, hits = mask_file("a.reg", mark + text.encode(codec), SECRET, "a.reg")
    assert out == mark + text.replace("TESTSECRET", "X" * 10).encode(codec) and hits == [("a.reg", "Credential / Secret", 1, "Line 1", False)]


def test_encodings_without_mark():
    out, _ = mask_file("a.log", "café user=TESTSECRET here\n".encode("cp1252"), SECRET, "a.log")
    assert out.decode("cp1252").startswith("cafX user=XXXXXXXXXX")
    assert detect("plain log line\n".encode("utf-16-le")) == ("utf-16-le", b"") and detect("plain log line\n".encode("utf-16-be")) == ("utf-16-be", b"")
    assert detect(b"") == ("utf-8", b"") and detect(b"\0\1\2") is None and detect(bytes(range(1, 32)) * 4) is None and printable_share("") == 1
    assert detect(b"a" * 65535 + "é".encode()) == ("cp1252", b"")  # the sample ends inside of a character


@pytest.mark.parametrize("name", ["a.pcap", "a.exe", "a.pdf", "a.xls", "a.7z"])
def test_refused_formats(name):
    with pytest.raises(ValueError):
        mask_upload(name, b"text", SECRET)


def test_lines(spark):
    df = spark.createDataFrame([("a\r\nb\rc\nd",), ("",), (None,), ("x\n\ny\n",)], "text string")
    assert [(r["line_no"], r["line"]) for r in with_lines(df, "text").collect()] == [(1, "a\r\n"), (2, "b\r"), (3, "c\n"), (4, "d"), (1, "x\n"), (2, "\n"), (3, "y\n")]


def word_xml(runs):
    return f'<w:document xmlns:w="{WORD}"><w:body><w:p>{"".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs)}</w:p></w:body></w:document>'.encode()


def test_docx():
    links = b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="http://x/TESTSECRET" TargetMode="External"/><Relationship Id="b" Target="TESTSECRET"/></Relationships>'
    core = b'<c:core xmlns:c="c" xmlns:d="d"><d:title>TESTSECRET</d:title></c:core>'
    out, hits = mask_docx(docx(["TESTSECRET", "no"], {"word/header1.xml": word_xml(["TEST", "SEC", "RET!"]), "docProps/core.xml": core, "docProps/app.xml": b"<a>TESTSECRET</a>", "word/_rels/document.xml.rels": links}), SECRET)
    assert sorted(h[0] for h in hits) == ["DOCX external relationship", "DOCX metadata: title", "Document paragraph 1", "Header 1 paragraph 1"]
    with zipfile.ZipFile(io.BytesIO(out)) as package:
        header = package.read("word/header1.xml").decode()
        assert "<w:t>XXXX</w:t>" in header and "<w:t>XXX</w:t>" in header and "<w:t>XXX!</w:t>" in header
        assert b"TESTSECRET" in package.read("docProps/app.xml") and package.read("word/_rels/document.xml.rels").count(b"TESTSECRET") == 1
    assert part_label("word/footer2.xml") == "Footer 2" and part_label("word/comments.xml") == "Comments"
    for more in ({"word/embeddings/object1.bin": b""}, {"word/vbaProject.bin": b""}):
        with pytest.raises(ValueError):
            mask_docx(docx(["x"], more), SECRET)
    with pytest.raises(ValueError, match="images"):
        mask_docx(docx([], {"word/media/a.png": b""}), SECRET)
    with pytest.raises(ValueError):
        mask_docx(b"no package", SECRET)


def test_xlsx():
    out, hits = mask_xlsx(write_xlsx([("One", [["head"], ["TESTSECRET", 12, None]]), ("Two", [["TESTSECRET"]])]), SECRET)
    assert hits == [("One!A2", "Credential / Secret", 1), ("Two!A1", "Credential / Secret", 1)]
    with zipfile.ZipFile(io.BytesIO(out)) as package:
        sheet = package.read("xl/worksheets/sheet1.xml").decode()
        assert "XXXXXXXXXX" in sheet and "TESTSECRET" not in sheet and "<v>12</v>" in sheet


@pytest.mark.parametrize("end", [".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".gz", ".bz2", ".xz"])
def test_archives_come_back(end):
    single = end in (".gz", ".bz2", ".xz")
    members = [("file", b"x TESTSECRET")] if single else [("d/a.txt", b"TESTSECRET"), ("e.log", b"ok")]
    content, packed = pack(members, end)
    assert packed == {".tgz": ".tar.gz", ".tbz2": ".tar.bz2"}.get(end, end)
    out, new_end, hits = mask_archive("in" + end, content, SECRET, "in" + end)
    back = dict(unpack("out" + new_end, out))
    assert list(back.values())[0] in (b"x XXXXXXXXXX", b"XXXXXXXXXX") and len(hits) == 1


def test_nested_archives_names_and_junk():
    inner, _ = pack([("TESTSECRET.txt", b"TESTSECRET")], ".zip")
    outer, _ = pack([("a/in.zip", inner), ("__MACOSX/x", b"\0"), ("TESTSECRET/b.txt", b""), ("a/.DS_Store", b"\0")], ".tgz")
    out, end, hits = mask_archive("o.tgz", outer, SECRET, "o.tgz")
    assert end == ".tar.gz" and [p for p, _ in unpack("x.tar.gz", out)] == ["XXXXXXXXXX/b.txt", "a/in.zip"]
    assert ("o.tgz/a/in.zip/TESTSECRET.txt", "Filename: Credential / Secret", 1, "Filename", False) in hits
    assert ("o.tgz/TESTSECRET", "Directory: Credential / Secret", 1, "Directory", False) in hits
    deep = b"end"
    for _ in range(8):
        deep, _ = pack([("in.zip" if deep != b"end" else "a.txt", deep)], ".zip")
    with pytest.raises(ValueError, match="nested"):
        mask_archive("o.zip", deep, SECRET, "o.zip")


def test_unsafe_archives():
    with pytest.raises(ValueError, match="unsafe"):
        unpack("a.zip", pack([("../escape.txt", b"")], ".zip")[0])
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as target:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc"
        target.addfile(link)
    with pytest.raises(ValueError, match="links"):
        unpack("a.tar", out.getvalue())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as target:
        info = zipfile.ZipInfo("l")
        info.external_attr = (stat.S_IFLNK | 0o777) << 16
        target.writestr(info, "/etc")
    with pytest.raises(ValueError, match="links"):
        unpack("a.zip", out.getvalue())
    many, _ = pack([(f"{i}.txt", b"x" * 1000) for i in range(3)], ".zip")
    for limits in (Limits(files=2), Limits(megabytes=0)):
        with pytest.raises(ValueError):
            unpack("a.zip", many, limits)
    with pytest.raises(ValueError):
        unpack("a.gz", b"no")


def test_names():
    assert paths.safe_name('a<b>:"|?*é\x01.txt. ') == ("aXbXXXXXXXX.txt", 9) and paths.safe_name("...") == ("file", 0)
    assert paths.masked_component("TESTSECRET.secret", SECRET) == ("XXXXXXXXXX.secret", 1, {"Credential / Secret": 1})
    assert paths.masked_component("csv.csv", []) == ("csv.csv", 0, {})
    assert paths.masked_path("..\\a//./TESTSECRET.d/csv.tar.gz", [*SECRET, "csv"])[0] == "a/XXXXXXXXXX.d/XXX.tar.gz"
    assert paths.masked_path("", []) == ("file", 0, {}) and paths.unique_names(["a.b", "a.b", "a_1.b"]) == ["a.b", "a_1.b", "a_1_1.b"]
    assert paths.download_name("x.tar.gz") == "x_SANITIZED.tar.gz" and paths.download_name("security.log") == "security_SANITIZED.log" and paths.download_name("x") == "x_SANITIZED"
    assert paths.suffix(".env") == "" and paths.suffix("a.b") == ".b" and paths.suffix("a.") == "" and paths.archive_stem("A.TAR.GZ") == "A"
    assert paths.is_single_file(["a.txt"]) and not paths.is_single_file(["d/a.txt"]) and not paths.is_single_file(["a", "b"])
    assert paths.is_mac_junk("__MACOSX/a") and paths.is_mac_junk("d/.DS_Store") and not paths.is_mac_junk("a.txt")


def test_name_columns_follow_the_plain_forms(spark):
    names = ["a.txt", ".env", "a.", "x.tar.gz", "X.TGZ", 'b<c".log', "é", "a b. .", "..", "a.b.c", "no"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    n = F.col("name")
    for row in df.select("name", paths.suffix_column(n).alias("s"), paths.archive_suffix_column(n).alias("a"), paths.safe_name_column(n).alias("f"), paths.download_name_column(n).alias("d")).collect():
        assert row["s"] == paths.suffix(row["name"]) and row["a"] == paths.archive_suffix(row["name"]) and tuple(row["f"]) == paths.safe_name(row["name"]) and row["d"] == paths.download_name(row["name"]), row


@pytest.mark.parametrize("rules", [[], [*SECRET, "csv"], [r"(a)\\1", r"x*"]])
def test_masked_paths_of_columns_are_those_of_lists(spark, rules):
    given = ["..\\\\a//./TESTSECRET.d/csv.tar.gz", "csv/csv.csv", "", None, "/", "é/ü.txt", "aa/aa.TGZ", "d. ./x", "csv/csv.csv", ".env", "a<b/c|d.csv"]
    df = spark.createDataFrame(list(enumerate(given)), "masked int, path string")
    rows = paths.with_masked_paths(df, "path", rules).collect()
    assert sorted(r["masked"] for r in rows) == list(range(len(given)))
    for row in rows:
        name, total, counts = paths.masked_path(row["path"], rules)
        assert row["masked_path"] == name and row["path_hits"] == counts and sum(row["path_hits"].values()) == total, row


def test_jobs_over_folders(spark, tmp_path):
    source = tmp_path / "in"
    (source / "Case-A" / "sub").mkdir(parents=True)
    (source / "Case-A" / "one.txt").write_text("TESTSECRET\nfine\n")
    (source / "Case-A" / "sub" / "two.log").write_text("a TESTSECRET TESTSECRET")
    result = run_job(spark, str(source), str(tmp_path / "out"), SECRET)
    assert result["status"] == "Done" and result["total_replacements"] == 3
    with zipfile.ZipFile(result["output_path"]) as package:
        assert package.read("Sanitized_Files/Case-A/one.txt") == b"XXXXXXXXXX\nfine\n" and any(n.endswith(".xlsx") for n in package.namelist())
    with zipfile.ZipFile(result["report_path"]) as book:
        assert "TESTSECRET" in book.read("xl/worksheets/sheet2.xml").decode()
    (source / "bad.zip").write_bytes(pack([("../escape.txt", b"")], ".zip")[0])
    failed = run_job(spark, str(source), str(tmp_path / "none"), SECRET)
    assert failed["status"] == "Failed" and "escape" in failed["error"] and not (tmp_path / "none").exists()


def test_job_for_one_file(spark, tmp_path):
    (tmp_path / "security.log").write_bytes(b"plain\r\nline\n")
    result = run_job(spark, str(tmp_path / "security.log"), str(tmp_path / "out"), SECRET)
    assert result["output_path"].endswith("security_SANITIZED.log") and open(result["output_path"], "rb").read() == b"plain\r\nline\n"
    assert main([str(tmp_path / "missing"), str(tmp_path)]) == 1


def test_failed_files_have_no_content(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"ok TESTSECRET")), ("b.exe", bytearray(b"x")), (None, None)], "path string, content binary")
    rows = {r["path"]: r for r in sanitized(files, SECRET).collect()}
    assert rows["b.exe"]["content"] is None and rows["b.exe"]["error"] and rows["a.txt"]["content"] == b"ok XXXXXXXXXX" and rows[None]["safe_path"] == "file"
    with pytest.raises(Exception, match="b.exe"):
        checked(sanitized(files, SECRET)).collect()


def test_audit_places_and_keywords(spark):
    rows = [("f", 1, "Line 1", "", "URL", 1), ("f", 2, "Line 2", "x", "URL", 2), ("g", 1, "Path", "x", "Path: Filename Format", 1), ("g", 2, "L", "", "Custom Rule 1", 1), ("g", 3, "M", "x", "Path: Custom Rule 1", 0)]
    hits = spark.createDataFrame(rows, "file string, ordinal long, location string, masked string, match_type string, n long")
    found = {(r["file"], r["match_type"]): r for r in report(audit(hits), ["abc", "http", "url"]).collect()}
    assert found["f", "URL"]["location"] == "Line 2" and found["f", "URL"]["occurrences"] == 3 and found["f", "URL"]["keywords"] == "http | url"
    assert found["g", "Path: Filename Format"]["keywords"] == "Invalid filename character" and found["g", "Custom Rule 1"]["keywords"] == "abc" and found["g", "Custom Rule 1"]["location"] == "L"
    assert len(found) == 3


def test_job_history(spark):
    now = datetime(2024, 5, 1)
    base = [("a", "Queued", now, None, "[\"x\"]", 3), ("b", "Done", now - timedelta(days=100), None, "broken", 5), ("c", "Processing", now - timedelta(days=1), "kept", None, None)]
    df = spark.createDataFrame(base, "job_id string, status string, created_at timestamp, error string, filenames string, total_replacements long")
    assert [r["job_id"] for r in jobs.latest(df, "no number").collect()] == ["a", "c", "b"] and jobs.latest(df, -5).count() == 1
    fixed = {r["job_id"]: r for r in jobs.after_restart(df, F.lit(now)).collect()}
    assert fixed["a"]["status"] == "Failed" and fixed["c"]["error"] == "kept" and fixed["b"]["status"] == "Done"
    assert {r["job_id"] for r in jobs.retained(df, F.lit(now)).collect()} == {"a", "c"}
    assert jobs.search(df, "QUEUED").count() == 1 and jobs.search(df, "zzz").count() == 0
    assert jobs.figures(df).first().asDict() == {"jobs": 3, "done": 1, "failed": 0, "replacements": 8}
    assert [r["n"] for r in df.orderBy("job_id").select(scalars.file_names(F.col("filenames")).alias("n")).collect()] == [["x"], [], []]
    changes = spark.createDataFrame([("b", "Queued", None), ("d", "Queued", "e"), ("d", "Done", None)], "job_id string, status string, error string").coalesce(1)
    up = jobs.upsert(df, changes)
    assert {(r["job_id"], r["status"], r["error"], r["filenames"], r["total_replacements"]) for r in up.collect()} == {("a", "Queued", None, '["x"]', 3), ("b", "Queued", None, "[]", 0), ("c", "Processing", "kept", None, None), ("d", "Done", None, "[]", 0)}
    with pytest.raises(Exception, match="no such role: root"):
        jobs.with_user(spark.createDataFrame([], jobs.USERS), spark.createDataFrame([("x", "root")], "username string, role string")).collect()
    assert scalars.upload_label(2048) == "2 GB" and scalars.upload_label(100) == "100 MB"
    shown = spark.createDataFrame([(0.0,), (-1.0,), (1280.0,), (3.5e12,), (1e16,)], "v double").select(scalars.human_bytes(F.col("v")).alias("s"))
    assert [r["s"] for r in shown.collect()] == ["0 B", "0 B", "1.2 KB", "3.2 TB", "9094.9 TB"]


def test_unique_names_of_columns_are_those_of_lists(spark):
    rng = random.Random(5)
    rows = [(k, f"f{rng.randrange(3)}", rng.choice(["a", "a", "a_1", "a_2", "a_1_1", "b_1", "b"]) + rng.choice([".txt", ".txt", ""])) for k in range(400)] + [(400 + k, "g", n) for k, n in enumerate(["a.txt", "a.txt", "a_1.txt", "a.txt", "a_1.txt", ".env", ".env"])]
    df = spark.createDataFrame(rows, "k int, folder string, name string").repartition(5)
    found = {r["k"]: r["unique_name"] for r in paths.with_unique_names(df, "folder", "name", "k").collect()}
    for folder in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == folder]
        assert [found[r[0]] for r in own] == paths.unique_names([r[2] for r in own])


def test_broken_packages_are_rows_with_an_error(spark):
    def package(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as target:
            for name, data in parts.items():
                target.writestr(name.replace("__", "/"), data)
        return out.getvalue()

    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>TESTSECRET</w:t></w:r></w:p></w:document>'
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="s"><v>7</v></c></row></sheetData></worksheet>'
    book = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'
    links = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    good = package(**{"word__document.xml": word})
    encrypted = bytearray(good)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        encrypted[encrypted.index(mark) + at] |= 1
    files = {
        "good.docx": good, "crc.docx": good.replace(b"TESTSECRET", b"TESTSECRXT"), "cut.docx": good[: len(good) // 2], "encrypted.docx": bytes(encrypted),
        "norels.xlsx": package(**{"xl__workbook.xml": book}), "index.xlsx": package(**{"xl__workbook.xml": book, "xl___rels__workbook.xml.rels": links, "xl__worksheets__sheet1.xml": sheet}),
        "empty.xlsx": b"", "noroot.docx": package(**{"word__document.xml": ""}),
    }
    done = {r["path"]: r for r in sanitized(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary"), SECRET).collect()}
    assert done["good.docx"]["error"] is None and done["good.docx"]["total"] == 1
    for name in set(files) - {"good.docx"}:
        assert done[name]["error"] and done[name]["content"] is None, name


def test_drop_folder(spark, tmp_path):
    from veilframe.streaming.drop_folder import mask_dropped

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("TESTSECRET")
    for expected in (1, 2):
        mask_dropped(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), SECRET).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (tmp_path / "in" / "b.csv").write_text("x")
